"""Answers for an unbounded table of user messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from utterlake.functions.text import strip
from utterlake.operators.classify import TextModel
from utterlake.operators.respond import answer
from utterlake.operators.retrieve import AnswerIndex
from utterlake.rules import STOP_MESSAGES, Rules
from utterlake.session import scratch_scope


def usable_messages(messages: DataFrame) -> DataFrame:
    """Trimmed, without blank messages and stop words."""
    tidy = messages.withColumn("text", strip("text"))
    return tidy.where((F.col("text") != "") & ~F.lower("text").isin(STOP_MESSAGES))


def answer_stream(
    messages: DataFrame,
    model: TextModel,
    index: AnswerIndex,
    rules: Rules,
    sink: str,
    checkpoint: str,
    report: bool = False,
    **trigger,
) -> StreamingQuery:
    """Answer a stream of ``(qid, text)`` into Parquet, one folder per micro-batch.

    A repeated batch overwrites its own folder, so a restart neither loses nor doubles answers. What a batch
    needs on the way is deleted once its answers are written.
    """

    def batch(rows: DataFrame, number: int) -> None:
        with scratch_scope(rows.sparkSession, "batch"):
            answer(rows, model, index, rules, report).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = usable_messages(messages).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
