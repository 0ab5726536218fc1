"""Writers of datasets, corpora, reports and answer tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake import schemas
from utterlake.operators.corpus import prompt_response

SPLITS = ("train", "val", "test")


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header; quotes, line breaks and outer blanks of a cell stay as they are."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def write_jsonl(df: DataFrame, path: str) -> str:
    """JSON lines with every character outside ASCII escaped."""
    df.write.mode("overwrite").option("writeNonAsciiCharacterAsCodePoint", True).json(path)
    return path


def write_prompt_jsonl(df: DataFrame, path: str) -> str:
    return write_jsonl(prompt_response(df), path)


def write_splits(df: DataFrame, path: str) -> dict[str, str]:
    """The whole table, its three parts and the prompt corpus, each in a folder of its own."""
    columns = schemas.UTTERANCE_COLUMNS
    files = {"full": write_csv(df.select(columns), f"{path}/prepared")}
    for name in SPLITS:
        files[name] = write_csv(df.where(F.col("split") == name).select(columns), f"{path}/{name}")
    files["gpt"] = write_prompt_jsonl(df, f"{path}/prompts")
    return files


def write_document(row: DataFrame, path: str) -> str:
    """A one-row table as one JSON document."""
    row.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_report(report: DataFrame, path: str) -> str:
    """A report, one row per label: as small as the label list, hence one file."""
    return write_csv(report.coalesce(1), path)


def write_answer_table(df: DataFrame, path: str) -> str:
    """``(ex_idx, text, response)`` rows as JSON lines in one folder per intent; no list is built."""
    df.select("intent", "ex_idx", "text", "response").write.mode("overwrite").partitionBy("intent").json(path)
    return path


def read_answer_table(spark: SparkSession, path: str) -> DataFrame:
    schema = "ex_idx bigint, text string, response string, intent string"
    return spark.read.schema(schema).json(path).select("intent", "ex_idx", "text", "response")


def write_response_pool(df: DataFrame, path: str) -> str:
    """Distinct answers in sorted order, one folder per label."""
    ordered = df.repartitionByRange("intent", "response").sortWithinPartitions("intent", "response")
    ordered.write.mode("overwrite").partitionBy("intent").json(path)
    return path


def run_id(family: str, at: datetime | None = None) -> str:
    return f"{family}_{(at or datetime.now(timezone.utc)):%Y%m%d_%H%M%S}"


def run_path(root: str, family: str, run: str) -> str:
    """History of a family lies under ``runs/``; the folder above holds the latest state."""
    return f"{root.rstrip('/')}/{family}/runs/run_id={run}"


def latest_run(spark: SparkSession, root: str, family: str, table: str) -> DataFrame:
    """Rows of ``table`` from the newest run."""
    everything = spark.read.option("basePath", f"{root.rstrip('/')}/{family}/runs").parquet(
        f"{root.rstrip('/')}/{family}/runs/run_id=*/{table}"
    )
    newest = everything.agg(F.max("run_id")).first()[0]
    return everything.where(F.col("run_id") == newest).drop("run_id")
