"""Label maps, default answers and allow-lists."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlake.operators.joins import small_table
from utterlake.rules import DEFAULT_CHANNEL, DEFAULT_LANGUAGE


def taxonomy_table(spark, taxonomy: dict[str, Sequence[str]]) -> DataFrame:
    """``(src_label, core_intent)``; a label listed more than once belongs to its last core intent."""
    last = {label: core for core, labels in taxonomy.items() for label in labels}
    return small_table(spark, list(last.items()), "src_label string, core_intent string")


def map_taxonomy(
    df: DataFrame,
    label_col: str,
    taxonomy: dict[str, Sequence[str]],
    source: str,
    templates: dict[str, str] | None = None,
) -> DataFrame:
    """Six utterance columns for rows whose label is in the taxonomy; other rows are dropped."""
    spark = df.sparkSession
    table = taxonomy_table(spark, taxonomy)
    mapped = df.join(table, F.col(label_col).cast("string") == F.col("src_label"), "inner")
    mapped = mapped.withColumn("intent", F.col("core_intent")).drop("src_label", "core_intent", "response")
    answered = default_response(mapped, templates or {})
    kept = [c for c in ("row_id",) if c in df.columns]
    return answered.select(
        *kept,
        F.col("text").cast("string").alias("text"),
        "intent",
        "response",
        F.lit(DEFAULT_LANGUAGE).alias("language"),
        F.lit(DEFAULT_CHANNEL).alias("channel"),
        F.lit(source).alias("source"),
    )


def default_response(df: DataFrame, templates: dict[str, str], default: str | None = None) -> DataFrame:
    """Fill ``response``: the row's own, else the template of its intent, else ``default``."""
    table = small_table(df.sparkSession, list(templates.items()), "intent string, _template string")
    own = F.col("response") if "response" in df.columns else F.lit(None).cast("string")
    filled = F.coalesce(own, F.col("_template"), F.lit(default).cast("string"))
    return df.join(table, "intent", "left").withColumn("response", filled).drop("_template")


def labels_table(spark, names: Sequence[str]) -> DataFrame:
    """``(label, label_name)``: the place in the list is the id."""
    return small_table(spark, list(enumerate(names)), "label int, label_name string")


def add_label_name(df: DataFrame, names: Sequence[str], label: str = "label") -> DataFrame:
    """``label_name`` by id; an id outside the list is an error."""
    table = labels_table(df.sparkSession, names).withColumnRenamed("label", "_label")
    unknown = F.raise_error(F.concat(F.lit("label id without a name: "), F.col(label).cast("string")))
    named = df.join(table, F.col(label) == F.col("_label"), "left").drop("_label")
    return named.withColumn("label_name", F.coalesce("label_name", unknown.cast("string")))


def lookup_label(df: DataFrame, classes: Sequence[str], label: str = "label", name: str = "class") -> DataFrame:
    """Class name by id, or the id as text when the list has no such place."""
    table = labels_table(df.sparkSession, classes).select(F.col("label").alias("_label"), F.col("label_name").alias("_name"))
    named = df.join(table, F.col(label) == F.col("_label"), "left")
    return named.withColumn(name, F.coalesce("_name", F.col(label).cast("string"))).drop("_label", "_name")


def allow_intents(df: DataFrame, intents: Iterable[str]) -> DataFrame:
    """Rows whose intent is in the list."""
    table = small_table(df.sparkSession, [(i,) for i in dict.fromkeys(intents)], "intent string")
    return df.join(table, "intent", "left_semi")
