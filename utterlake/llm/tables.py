"""What the operators share: columns of the input, words, and folders for cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.session import scratch_path

#: Bits of a piece of a bitmap (as Spark's ``bitmap_construct_agg`` makes them), bits for each key, and the most pieces of one bitmap (16 MB).
BITMAP_BITS, KEY_BITS, BITMAP_PIECES = 8 * 4096, 16, 4096
#: A word is a run of characters other than the space and the ASCII controls 9 to 13.
BLANKS = "[\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Key and text only, under the names ``doc_id`` and ``text``; other columns cannot clash. Null texts stay null."""
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), *keep)


def words(text: Column) -> Column:
    """The words of a text as an array; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def text_parts(docs: DataFrame, text: str, chars: int, least: int = 1) -> int:
    """How many parts of about ``chars`` characters the texts make up: one pass over the lengths."""
    total = docs.agg(F.sum(F.length(text))).first()[0] or 0
    return max(least, -(-int(total) // chars))


def keyed_table(df: DataFrame, key: str, name: str, dealt: bool = False) -> DataFrame:
    """``df`` written once to scratch, dealt and sorted by ``key``: joins on it move the other side only.

    ``dealt`` says that a shuffle by ``key`` was the last one of ``df``, so that its rows need not be moved again.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = (df if dealt else df.repartition(parts, key)).write.format("parquet").option("path", scratch_path(spark, name))
    writer.bucketBy(parts, key).sortBy(key).saveAsTable(table)
    return spark.table(table)


def likely(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The ``rows`` whose ``key`` is among ``keys``, a written table of distinct ones, and about one in ``KEY_BITS`` of the others.

    The keys are bits of a bounded bitmap that is broadcast, so that rows without a partner are not moved by the join
    that follows; that join stays exact. Past ``BITMAP_PIECES`` pieces more of the others pass.
    """
    pieces = min(BITMAP_PIECES, 1 + keys.count() * KEY_BITS // BITMAP_BITS)
    place = F.pmod(F.xxhash64(key, F.lit("bit")), F.lit(pieces * BITMAP_BITS))
    placed = keys.select(place.alias("_place"))
    piece = F.expr(f"_place div {BITMAP_BITS}")
    bits = placed.groupBy(piece.alias("_piece")).agg(F.bitmap_construct_agg(F.col("_place") % BITMAP_BITS).alias("_bits"))
    byte = f"cast(conv(hex(substring(_bits, cast(_place % {BITMAP_BITS} div 8 AS int) + 1, 1)), 16, 10) AS int)"
    held = F.expr(f"shiftright({byte}, cast(_place % 8 AS int)) & 1 = 1")
    return rows.withColumn("_place", place).join(F.broadcast(bits), (piece == F.col("_piece")) & held, "left_semi").drop("_place")


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
