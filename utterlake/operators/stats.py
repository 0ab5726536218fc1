"""Counts and summaries of datasets and corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlake.functions.text import strip
from utterlake.operators.dedup import dedup_pair, with_rank
from utterlake.operators.joins import small_table


def group_counts(df: DataFrame, column: str, ordered: bool = True) -> DataFrame:
    """Rows per value, largest first, then by value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), column) if ordered else counts


def _facts(kind: str, key, value) -> list:
    return [F.lit(kind).alias("kind"), key.cast("string").alias("key"), value.cast("bigint").alias("value")]


def dataset_stats(df: DataFrame, focus: bool = False) -> DataFrame:
    """Long form ``(kind, key, value)``: rows in all and per split, intents, sources, mode.

    One pass groups by split, intent and source; every figure is summed from those few rows.
    """
    cells = df.groupBy("split", "intent", "source").agg(F.count(F.lit(1)).alias("n"))
    kinds = F.array(
        F.struct(F.lit("rows").alias("kind"), F.lit("total").alias("key")),
        F.struct(F.lit("rows").alias("kind"), F.col("split").alias("key")),
        F.struct(F.lit("intent").alias("kind"), F.col("intent").alias("key")),
        F.struct(F.lit("source").alias("kind"), F.col("source").alias("key")),
    )
    spread = cells.select("n", F.explode(kinds).alias("_k")).groupBy("_k.kind", "_k.key").agg(F.sum("n").alias("value"))
    intents = spread.where("kind = 'intent'").agg(F.count(F.lit(1)).alias("value")).select(
        *_facts("intents", F.lit("distinct"), F.col("value"))
    )
    mode = small_table(df.sparkSession, [("mode", "focus", int(focus))], "kind string, key string, value bigint")
    return spread.select("kind", "key", "value").unionByName(intents).unionByName(mode)


def stats_document(stats: DataFrame, files: dict[str, str] | None = None) -> DataFrame:
    """The statistics as one row with counts, sorted intents and maps; the row is as small as the
    label and source lists."""

    def table(kind: str):
        pair = F.when(F.col("kind") == kind, F.struct("key", "value"))
        return F.map_from_entries(F.sort_array(F.collect_list(pair)))

    def number(kind: str, key: str):
        return F.coalesce(F.max(F.when((F.col("kind") == kind) & (F.col("key") == key), F.col("value"))), F.lit(0))

    names = F.sort_array(F.collect_list(F.when(F.col("kind") == "intent", F.col("key"))))
    listed = F.create_map(*[F.lit(x) for pair in (files or {}).items() for x in pair]) if files else None
    row = stats.agg(
        number("rows", "total").alias("total_samples"),
        number("rows", "train").alias("train_samples"),
        number("rows", "val").alias("val_samples"),
        number("rows", "test").alias("test_samples"),
        names.alias("intents"),
        table("intent").alias("intent_distribution"),
        table("source").alias("sources"),
        (number("mode", "focus") == 1).alias("focus_only"),
    )
    return row.withColumn("files", listed) if files else row


def corpus_stats(df: DataFrame, position: str = "position") -> DataFrame:
    """Conversion summary in long form: rows, rows left after the null drop, duplicates, result, intents."""
    usable = df.where("text is not null and response is not null")
    kept = dedup_pair(usable, position)
    raw = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("text").isNotNull() & F.col("response").isNotNull()).alias("usable"),
    )
    # Grouping by intent first keeps the distinct count a sum over few rows.
    final = kept.groupBy("intent").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("final"), F.count(F.lit(1)).alias("intents")
    )
    long_raw = raw.selectExpr("stack(2, 'rows', rows, 'usable', usable) as (measure, value)")
    long_final = final.selectExpr("stack(2, 'final', final, 'intents', intents) as (measure, value)")
    both = long_raw.unionByName(long_final)
    duplicates = both.agg(
        F.sum(F.when(F.col("measure") == "usable", F.col("value")).when(F.col("measure") == "final", -F.col("value"))).alias("value")
    ).select(F.lit("duplicates").alias("measure"), "value")
    return both.unionByName(duplicates)


def response_pool(df: DataFrame, label: str = "intent", response: str = "response") -> DataFrame:
    """Distinct trimmed answers of each label, one row each; blank ones are left out."""
    tidy = df.select(F.col(label).cast("string").alias("intent"), strip(F.col(response).cast("string")).alias("response"))
    return tidy.where("intent is not null and response <> ''").distinct()


def build_answer_table(df: DataFrame, key: str = "row_id") -> DataFrame:
    """``(intent, ex_idx, text, response)``; ``ex_idx`` counts from 0 in row order inside an intent."""
    rows = df.select(key, "intent", "text", "response").where("intent is not null")
    return with_rank(rows, key, "intent", "ex_idx").select("intent", "ex_idx", "text", "response")
