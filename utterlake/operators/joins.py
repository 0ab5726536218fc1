"""Lookups that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.session import materialize

HOT_LIMIT = 4096
SALTS = 16
BROADCAST_ROWS = 10_000
#: Keys, 16 bytes each, up to which the chosen rows of a table are told by broadcast.
BROADCAST_KEYS = 4_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], weight: Column | str, limit: int = HOT_LIMIT) -> DataFrame:
    """The ``limit`` heaviest keys. Any key left out has less than 1/limit of the weight."""
    ranked = df.orderBy(F.desc(weight) if isinstance(weight, str) else weight.desc(), *keys)
    return ranked.select(*keys).limit(limit)


def salted_lookup(
    facts: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    hot: DataFrame,
    spread: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join ``facts`` with a keyed table; rows of hot keys are spread over ``salts`` parts.

    ``hot`` is bounded by ``hot_keys`` and is the only side that carries a broadcast hint. The
    table side is repeated for hot keys only, so its growth is bounded as well. Every row is kept; rows
    with a null key, which match nothing, are spread as well.
    """
    keys = list(keys)
    flags = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    open_key = reduce(or_, [F.col(k).isNull() for k in keys])
    part = F.when(F.col("_hot") | open_key, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = facts.join(flags, keys, "left").withColumn("_salt", part).drop("_hot")
    right = table.join(flags, keys, "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def chosen_rows(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``table`` whose key is among the distinct ``keys``; up to ``BROADCAST_KEYS`` of them move no row.

    ``keys`` are read twice, so they should be small or a written table.
    """
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return table.join(F.broadcast(keys) if few else keys, key, "left_semi")


def hot_values(table: DataFrame, keys: Sequence[str], weight: Column | str, limit: int = HOT_LIMIT) -> DataFrame:
    """The rows of the ``limit`` heaviest keys of a keyed table, values included, written once for many lookups."""
    ranked = table.orderBy(F.desc(weight) if isinstance(weight, str) else weight.desc(), *keys)
    return materialize(ranked.limit(limit), "hot-values")


def hybrid_lookup(facts: DataFrame, table: DataFrame, keys: Sequence[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """Inner or left equi-join of ``facts`` with a keyed table, in two parts.

    Facts of the heaviest keys meet their values, at most ``HOT_LIMIT`` rows of ``hot_values``, by broadcast and
    stay where they are; only the others are shuffled, and none of their keys holds more than 1/limit of the
    weight. Both parts read ``facts``, so it should be a written table. ``hot`` has the columns of ``table``.
    """
    keys = list(keys)
    heavy = facts.join(F.broadcast(hot), keys)
    rest = facts.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table, keys, how)
    return heavy.unionByName(rest)


def small_table(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A rule table given as rows; broadcast only while it is checked to be small."""
    df = spark.createDataFrame(list(rows), schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df
