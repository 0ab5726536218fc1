"""Readers that bring files into the utterance layout."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from utterlake import schemas
from utterlake.functions.text import normalize_intent, strip
from utterlake.operators.checks import require_columns
from utterlake.operators.dedup import ROW_BITS, union_sources
from utterlake.operators.split import seeded_sample
from utterlake.operators.taxonomy import default_response, map_taxonomy
from utterlake.rules import (
    DEFAULT_CHANNEL,
    DEFAULT_LANGUAGE,
    INTENT_ALIASES,
    REGIONAL_SOURCE,
    RESPONSE_ALIASES,
    SEED,
    TEXT_ALIASES,
    Rules,
)

CORRUPT = "_corrupt_record"


def numbered(df: DataFrame) -> DataFrame:
    """Give file rows a ``row_id`` in scan order; it is the same for the same files and split size."""
    return df if "row_id" in df.columns else df.withColumn("row_id", F.monotonically_increasing_id())


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV with a header, quoted commas and quoted line breaks. With a schema, broken rows keep their line
    in ``_corrupt_record``; without one, columns are strings named by the header.

    As a quoted cell may hold line breaks, a file is read by one task: large tables belong in several files."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    if schema is None:
        return reader.csv(path)
    full = StructType([*schema.fields]).add(CORRUPT, "string")
    return reader.option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", True).schema(full).csv(path)


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the raw lines of broken ones."""
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, df.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def read_utterances(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV or JSON lines by file ending, numbered."""
    lines = path.lower().rstrip("/").endswith((".jsonl", ".json"))
    return numbered(read_jsonl(spark, path, schema) if lines else read_csv(spark, path, schema))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, text)``: one question per line, trimmed, blank lines skipped."""
    lines = spark.read.text(path).select(
        F.monotonically_increasing_id().alias("qid"), strip("value").alias("text")
    )
    return lines.where("text <> ''")


def read_answer_document(spark: SparkSession, path: str) -> DataFrame:
    """``(intent, ex_idx, text, response)`` from one nested ``{intent: [{text, response}]}`` document."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.explode(F.from_json("value", schemas.ANSWER_TABLE_DOCUMENT)).alias("intent", "_items"))
    rows = parsed.select("intent", F.posexplode("_items").alias("ex_idx", "_item"))
    return rows.select("intent", F.col("ex_idx").cast("bigint").alias("ex_idx"), "_item.text", "_item.response")


def empty_utterances(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.POSITIONED_UTTERANCES)


def optional(spark: SparkSession, path: str | None, load: Callable[[str], DataFrame]) -> DataFrame:
    """``load(path)``, or no rows when the path is empty or missing."""
    if not path:
        return empty_utterances(spark)
    try:
        return load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return empty_utterances(spark)
        raise


def first_available(loads: Sequence[Callable[[], DataFrame]], warn: Callable[[str], None] = print) -> DataFrame | None:
    """The first source that can be opened; each failure is reported and the next one is tried."""
    for load in loads:
        try:
            return load()
        except (AnalysisException, FileNotFoundError, ValueError) as error:
            warn(f"source not available: {str(error).splitlines()[0]}")
    return None


def detect_column(columns: Sequence[str], aliases: Sequence[str]) -> str | None:
    """The column named by the first alias present, ignoring case and outer blanks.

    Of columns that differ only in case and blanks, the last one counts.
    """
    by_name = {c.strip().lower(): c for c in columns}
    return next((by_name[a] for a in aliases if a in by_name), None)


def load_external(df: DataFrame, source: str, rules: Rules) -> DataFrame:
    """Utterance columns from a table with freely named columns; no rows without text or intent."""
    text = detect_column(df.columns, TEXT_ALIASES)
    intent = detect_column(df.columns, INTENT_ALIASES)
    response = detect_column(df.columns, RESPONSE_ALIASES)
    if text is None or intent is None:
        return empty_utterances(df.sparkSession)

    def named(name: str):
        return F.col("`" + name.replace("`", "``") + "`").cast("string")

    rows = numbered(df).select(
        "row_id",
        named(text).alias("text"),
        normalize_intent(named(intent), trimmed=False).alias("intent"),
        *([named(response).alias("response")] if response else []),
        F.lit(DEFAULT_LANGUAGE).alias("language"),
        F.lit(DEFAULT_CHANNEL).alias("channel"),
        F.lit(source).alias("source"),
    )
    if not response:
        rows = default_response(rows, rules.templates, rules.default_response)
    return rows.select("row_id", *schemas.UTTERANCE_COLUMNS)


def with_source_defaults(df: DataFrame) -> DataFrame:
    """Six utterance columns; text, intent and response must exist, the others get defaults."""
    require_columns(df, ["text", "intent", "response"], "Regional file")
    defaults = {"language": DEFAULT_LANGUAGE, "channel": DEFAULT_CHANNEL, "source": REGIONAL_SOURCE}
    out = numbered(df)
    for name, value in defaults.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(value))
    return out.select("row_id", *schemas.UTTERANCE_COLUMNS)


def load_taxonomy_corpus(
    train: DataFrame,
    test: DataFrame,
    rules: Rules,
    source: str = "banking77_local",
    max_rows: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Both parts of a labelled benchmark, mapped to core intents, with an optional seeded cap."""
    for part in (train, test):
        require_columns(part, ["label_name"], "Benchmark corpus")
    # One bit less, so that the numbers still fit a later union.
    both = union_sources([numbered(train), numbered(test)], bits=ROW_BITS - 1)
    mapped = map_taxonomy(
        both.withColumn("row_id", F.col("position")), "label_name", rules.taxonomy, source, rules.templates
    )
    return seeded_sample(mapped, max_rows, "row_id", seed) if max_rows else mapped
