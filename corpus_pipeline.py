"""A corpus from documents: stages that run one after the other, each over all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``, and each
result is written as Parquet and read again for the next one.

1. toxicity: texts with a score of 0.5 or more go; all others stay, null and empty ones too.
2. near_duplicates: of each group of texts linked by 5-word runs the row with the smallest id stays, of rows
   that share it the first by a hash of id and text. Rows that share an id but are not linked all stay. Of rows
   equal in id and text one stays, and of texts without words one for each id; rows without an id stay.
3. substring_dedup: words of passages of 20 words that occur earlier are cut out of the texts; a text that
   loses none keeps its blanks, one that loses all stays as an empty one.
4. pii: spans of personal data are replaced by their kind in brackets.
5. packing: texts become pieces with their place in sequences of 4,096 ids.

Empty tables pass through all stages. ``n_chars`` follows the text. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utterlake.llm.jaccard_join import jaccard_components
from utterlake.llm.packing import pack_documents, vocabulary
from utterlake.llm.pii import find_pii, fit_pii
from utterlake.llm.substring_dedup import substring_dedup
from utterlake.llm.tables import read
from utterlake.llm.toxicity import fit_toxicity, toxicity_scores
from utterlake.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CARRIED = COLUMNS[2:]
REJECT = 0.5


def with_text(rows: DataFrame, text) -> DataFrame:
    """The columns of documents with another text, whose length they tell."""
    changed = rows.withColumn("_text", text)
    return changed.select("doc_id", F.col("_text").alias("text"), "lang", "source", F.length("_text").cast("bigint").alias("n_chars"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    scored = toxicity_scores(docs, model, keep=CARRIED, carry_text=True)
    return scored.where(F.col("score") < REJECT).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(*COLUMNS)
    # A row is named by its id and text, as ids may be repeated with other texts.
    named = rows.where("doc_id IS NOT NULL").withColumn("_key", F.xxhash64("doc_id", "text"))
    found = jaccard_components(named.select(F.col("_key").alias("doc_id"), "text")).withColumnRenamed("doc_id", "_key").distinct()
    linked = found.join(named.select("_key", "doc_id").distinct(), "_key")
    groups = linked.groupBy(F.when(F.col("n_shingles") > 0, F.col("component_id")), F.when(F.col("n_shingles") == 0, F.col("doc_id")))
    kept = groups.agg(F.min(F.struct("doc_id", "_key")).alias("_first")).select("_first._key")
    first = Window.partitionBy("_key").orderBy("lang", "source", "n_chars")
    stay = named.join(kept, "_key", "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return stay.select(*COLUMNS).union(rows.where("doc_id IS NULL"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring_dedup(docs, keep=CARRIED)
    return with_text(cut, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = find_pii(docs, fit_pii(docs), keep=CARRIED)
    return with_text(found, F.col("redacted"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_stage),
    ("pii", pii_stage),
    ("packing", packing),
]
#: Trained models and a tokenizer cannot be written in SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
