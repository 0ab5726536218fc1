"""Seeded samples and exact splits that never order a whole class in one task.

Rows are ordered by MD5 of seed and row key. The first 16 bits of the hash cut every class into
65,536 buckets; bucket counts tell which one holds the quota, and only that bucket is ranked. The last
chosen row of each class is the cut that all rows are compared with.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from utterlake.functions.text import strip
from utterlake.operators.dedup import key_digest
from utterlake.operators.joins import BROADCAST_ROWS, hot_keys, salted_lookup
from utterlake.rules import EVAL_SHARE, SEED
from utterlake.session import materialize


def order_hash(seed: int | str, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def _bucket(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")


def _picked(df: DataFrame, key: str, seed: int | str, quotas: DataFrame | int, group: str | None) -> DataFrame:
    """``df`` with ``_in``: whether a row is among the first ``quota`` rows of its group.

    The order ends at one ``(hash, key)`` for each group. These cuts are found on hashes and keys alone;
    the rows themselves are compared with them where they are, so no wide row is moved.
    """
    groups = [group] if group else []
    hashed = order_hash(seed, key)
    lean = df.select(key, *groups, hashed.alias("_hash")).withColumn("_bucket", _bucket(F.col("_hash")))
    upto = W.partitionBy(*groups).orderBy("_bucket")
    counts = lean.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    summed = counts.withColumn("_end", F.sum("_n").over(upto))
    summed = summed.join(quotas, groups) if group else summed.withColumn("quota", F.lit(quotas))
    # One row per group: the bucket in which the quota is reached and how many rows it may give.
    edges = (
        summed.where((F.col("_end") >= F.col("quota")) & (F.col("quota") > 0))
        .groupBy(*groups)
        .agg(F.min(F.struct("_bucket", (F.col("quota") - F.col("_end") + F.col("_n")).alias("_left"))).alias("_edge"))
        .select(*groups, F.col("_edge._bucket").alias("_bucket"), F.col("_edge._left").alias("_left"))
    )
    edges = _small(materialize(edges, "edges"))
    near = lean.join(edges, [*groups, "_bucket"])
    ranked = near.withColumn("_rank", F.row_number().over(W.partitionBy(*groups, "_bucket").orderBy("_hash", key)))
    last = F.max(F.struct("_hash", F.col(key).alias("_key"))).alias("_cut")
    cuts = materialize(ranked.where("_rank <= _left").groupBy(*groups).agg(last), "cuts")
    if group:
        marked = df.join(_small(cuts), group, "left")
    else:
        cut = cuts.first()["_cut"]
        value = F.struct(F.lit(cut["_hash"]).alias("_hash"), F.lit(cut["_key"]).alias("_key")) if cut else F.lit(None).cast(cuts.schema["_cut"].dataType)
        marked = df.withColumn("_cut", value)
    inside = F.struct(hashed.alias("_hash"), F.col(key).alias("_key")) <= F.col("_cut")
    return marked.withColumn("_in", F.coalesce(inside, F.lit(False))).drop("_cut")


def _small(table: DataFrame) -> DataFrame:
    """A table of one row for each class; broadcast if there are few classes, which is counted."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def seeded_sample(df: DataFrame, n: int, key: str = "row_id", seed: int = SEED) -> DataFrame:
    """``min(n, rows)`` rows, the same ones on any partitioning."""
    if n >= df.count():
        return df
    return _picked(df, key, seed, n, None).where("_in").drop("_in")


def random_split(df: DataFrame, eval_share: float, key: str = "row_id", seed: int = SEED) -> DataFrame:
    """``df`` with ``split``: ``ceil(share * rows)`` rows are ``eval``, the rest ``train``."""
    total = df.count()
    train = total - math.ceil(eval_share * total)
    return _picked(df, key, seed, train, None).withColumn("split", _side("train", "eval")).drop("_in")


def _side(yes: str, no: str) -> Column:
    return F.when(F.col("_in"), F.lit(yes)).otherwise(F.lit(no))


def class_quotas(df: DataFrame, label: str, total: int, wanted: int) -> DataFrame:
    """``(label, quota)`` by largest remainder; equal remainders go to the first label."""
    share = F.col("n") * F.lit(wanted) / F.lit(total)
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("_share", share)
    counts = counts.withColumn("_floor", F.floor("_share"))
    # One row per class, so an unpartitioned window is small.
    order = W.orderBy(F.round(F.col("_share") - F.col("_floor"), 10).desc(), F.col(label))
    spare = F.lit(wanted) - F.sum("_floor").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    extra = (F.row_number().over(order) <= spare).cast("bigint")
    return counts.select(label, (F.col("_floor") + extra).alias("quota"))


class SplitError(ValueError):
    """A stratified split is not possible on these classes."""


def _check_classes(df: DataFrame, label: str, eval_share: float) -> tuple[int, int, int]:
    """Rows, evaluation rows and classes; raises when the classes are too small."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"), F.min("n").alias("least")).first()
    total, classes = row["total"] or 0, row["classes"]
    eval_rows = math.ceil(eval_share * total)
    if classes > 1:
        if row["least"] < 2:
            raise SplitError("the smallest class has fewer than 2 rows")
        if min(eval_rows, total - eval_rows) < classes:
            raise SplitError(f"{eval_rows} evaluation rows of {total} cannot hold {classes} classes")
    return total, eval_rows, classes


def stratified_split(
    df: DataFrame,
    label: str = "intent",
    eval_share: float = EVAL_SHARE,
    key: str = "row_id",
    seed: int | str = SEED,
    strict: bool = True,
    names: tuple[str, str] = ("train", "eval"),
) -> DataFrame:
    """``df`` with ``split``; class shares are kept to within one row.

    With one class, or when ``strict`` is off and the classes are too small, the split is plain.
    """
    try:
        total, eval_rows, classes = _check_classes(df, label, eval_share)
    except SplitError:
        if strict:
            raise
        total, classes = df.count(), 1
        eval_rows = math.ceil(eval_share * total)
    wanted = total - eval_rows
    if classes > 1:
        marked = _picked(df, key, seed, class_quotas(df, label, total, wanted), label)
    else:
        marked = _picked(df, key, seed, wanted, None)
    return marked.withColumn("split", _side(*names)).drop("_in")


def three_way_split(df: DataFrame, label: str = "intent", key: str = "row_id", seed: int = SEED) -> DataFrame:
    """80/10/10 ``train``, ``val`` and ``test``: the evaluation fifth is split in two by the same rule."""
    first = stratified_split(df, label, EVAL_SHARE, key, seed)
    held = materialize(first.where("split = 'eval'").drop("split"), "held")
    second = stratified_split(held, label, 0.5, key, f"{seed}|held", names=("val", "test"))
    return first.where("split = 'train'").unionByName(second)


def split_leakage(train: DataFrame, evaluation: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """Evaluation rows with ``leaked``: whether their text, trimmed and lower-cased, occurs in train."""
    digest = key_digest(strip(F.lower(F.col(text))))
    known = train.where(F.col(text).isNotNull()).select(digest.alias("_digest")).distinct()
    rows = evaluation.withColumn("_digest", digest)
    sizes = rows.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"))
    found = salted_lookup(
        rows, known.withColumn("_leaked", F.lit(True)), ["_digest"], hot_keys(sizes, ["_digest"], "_n"), [key], "left"
    )
    return found.withColumn("leaked", F.coalesce(F.col("_leaked"), F.lit(False))).drop("_digest", "_leaked")


def clean_evaluation(train: DataFrame, evaluation: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """Evaluation rows whose text is not in train."""
    return split_leakage(train, evaluation, key, text).where("not leaked").drop("leaked")
