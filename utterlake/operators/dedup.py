"""Keep-first duplicate removal and positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from utterlake.session import materialize

ROW_BITS = 56
MAX_SOURCES = 126


def union_sources(frames: Sequence[DataFrame], row_id: str = "row_id", bits: int = ROW_BITS) -> DataFrame:
    """Rows of all sources with a unique ``position`` that follows source order, then row order.

    The source number sits above ``bits`` bits of ``row_id``, so one BIGINT orders the whole union.
    56 bits hold the scan numbers of eight million file splits.
    """
    if len(frames) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    placed = []
    for order, df in enumerate(frames):
        inside = (F.col(row_id) >= 0) & (F.col(row_id) < F.lit(1 << bits))
        checked = F.when(inside, F.col(row_id)).otherwise(
            F.raise_error(F.concat(F.lit("row id out of range: "), F.col(row_id).cast("string"))).cast("bigint")
        )
        placed.append(df.withColumn("position", checked + F.lit(order << bits)))
    out = placed[0]
    for df in placed[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def key_digest(*columns: Column | str) -> Column:
    """SHA-256 over column values, with lengths so that neighbouring values cannot run together."""
    parts = []
    for c in columns:
        value = F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
        parts += [F.length(value).cast("string"), F.lit(":"), value]
    return F.sha2(F.concat(*parts), 256)


def first_positions(df: DataFrame, digest: Column, position: str) -> DataFrame:
    """Lowest position of each digest and the number of rows that share it.

    Copies meet in the map-side half of the aggregation, so a group of any size costs a few rows.
    """
    return df.groupBy(digest.alias("_digest")).agg(
        F.min(position).alias(position), F.count(F.lit(1)).alias("copies")
    )


def _keep(df: DataFrame, digest: Column, position: str) -> DataFrame:
    firsts = first_positions(df, digest, position).select(position)
    return df.join(firsts, position, "left_semi")


def dedup_first(df: DataFrame, keys: Sequence[str] = ("text", "intent"), position: str = "position") -> DataFrame:
    """The first row, by position, of each key."""
    return _keep(df, key_digest(*keys), position)


def pair_digest(text: str = "text", response: str = "response") -> Column:
    """Digest of ``text || response`` joined by a bar; pairs that join to one text are one pair."""
    return F.sha2(F.concat(F.col(text), F.lit(" || "), F.col(response)), 256)


def dedup_pair(df: DataFrame, position: str = "position") -> DataFrame:
    """The first row of each (text, response) pair, compared before trimming."""
    return _keep(df, pair_digest(), position)


def with_rank(df: DataFrame, key: str, group: str | None = None, name: str = "place") -> DataFrame:
    """Dense positions from 0 by a unique ``key``, inside ``group`` when given.

    Rows are range-partitioned once and written with the number of their range. Sizes of earlier
    ranges are summed and rows are ranked inside their range, so a large group takes many tasks.
    """
    groups = [group] if group else []
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *groups, key).withColumn("_range", F.spark_partition_id())
    placed = materialize(ranged, "ranges")
    before = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy(*groups, "_range").orderBy(key)
    joined = placed.withColumn("_rank", F.row_number().over(inside)).join(starts, [*groups, "_range"])
    return joined.withColumn(name, F.col("_start") + F.col("_rank") - 1).drop("_start", "_rank", "_range")
