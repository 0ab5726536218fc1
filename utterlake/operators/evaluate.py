"""Classification measures from one grouped pass over (truth, prediction)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from utterlake.functions.numeric import safe_ratio

SUMMARY = ["accuracy", "macro avg", "weighted avg"]


def confusion_matrix(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``(truth, predicted, n)`` for the pairs that occur."""
    pairs = df.select(F.col(truth).cast("string").alias("truth"), F.col(predicted).cast("string").alias("predicted"))
    return pairs.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def confusion_pivot(df: DataFrame, truth: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """The matrix with one column per predicted label."""
    return confusion_matrix(df, truth, predicted).groupBy("truth").pivot("predicted", list(labels)).agg(
        F.sum("n")
    ).na.fill(0)


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    same = (F.col(truth).cast("string") == F.col(predicted).cast("string")).cast("double")
    return df.agg(F.avg(same).alias("accuracy"))


def _per_class(matrix: DataFrame) -> DataFrame:
    """``(label, hits, said, support)`` over the labels of truth and prediction together."""
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("said")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("said")),
    )
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    rows = matrix.select(hit.alias("hit"), F.explode(sides).alias("_s"))
    # A hit shows up once for truth and once for prediction of the same label.
    return rows.groupBy("_s.label").agg(
        (F.sum("hit") / 2).cast("bigint").alias("hits"),
        F.sum("_s.said").alias("said"),
        F.sum("_s.support").alias("support"),
    )


def _scored(classes: DataFrame) -> DataFrame:
    precision = safe_ratio(F.col("hits"), F.col("said"))
    recall = safe_ratio(F.col("hits"), F.col("support"))
    f1 = safe_ratio(F.col("hits") * 2, F.col("said") + F.col("support"))
    return classes.select(
        "label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "hits"
    )


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``(label, precision, recall, f1, support)`` per class, then accuracy, macro and weighted rows.

    A measure without any row to divide by is 0.
    """
    scored = _scored(_per_class(confusion_matrix(df, truth, predicted)))
    measures = ["precision", "recall", "f1"]

    def weighted(name: str) -> Column:
        return safe_ratio(F.sum(F.col(name) * F.col("support")), F.sum("support"))

    hit_share = safe_ratio(F.sum("hits"), F.sum("support"))
    total = F.sum("support")
    summary = scored.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("label"), *[hit_share.alias(m) for m in measures], total.alias("support")),
            F.struct(F.lit("macro avg").alias("label"), *[F.avg(m).alias(m) for m in measures], total.alias("support")),
            F.struct(F.lit("weighted avg").alias("label"), *[weighted(m).alias(m) for m in measures], total.alias("support")),
        ).alias("_rows")
    ).select(F.inline("_rows"))
    return scored.drop("hits").unionByName(summary)


def macro_f1(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``(accuracy, f1_macro)`` in one row."""
    scored = _scored(_per_class(confusion_matrix(df, truth, predicted)))
    return scored.agg(
        safe_ratio(F.sum("hits"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("f1_macro")
    )


def metrics_long(report: DataFrame) -> DataFrame:
    """``(metric, value)`` rows from a report."""
    parts = report.unpivot(["label"], ["precision", "recall", "f1"], "measure", "value")
    return parts.select(F.concat("label", F.lit("."), "measure").alias("metric"), "value")


def best_model(metrics: DataFrame, order: Sequence[str]) -> DataFrame:
    """The ``(model, accuracy)`` row of highest accuracy; the earlier model in ``order`` wins ties."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    ranked = W.orderBy(F.desc("accuracy"), place)
    return metrics.withColumn("_r", F.row_number().over(ranked)).where("_r = 1").drop("_r")


def perplexity(df: DataFrame, loss: str = "loss", by: str | None = None) -> DataFrame:
    """``exp(mean loss)``, infinite from 50 on, and the mean of the perplexities of single rows."""

    def expo(value: Column) -> Column:
        return F.when(value < 50, F.exp(value)).otherwise(F.lit(float("inf")))

    mean = F.avg(loss)
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(
        mean.alias("eval_loss"),
        expo(mean).alias("eval_perplexity"),
        F.avg(expo(F.col(loss))).alias("mean_perplexity"),
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights: rows over classes times the rows of the class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weight = F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))
    return counts.withColumn("weight", weight)


def label_encode(train: DataFrame, evaluation: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``label_id``: places of the sorted train labels; a new label is an error."""
    names = train.select(F.col(label).cast("string").alias(label)).distinct()
    ids = names.withColumn("label_id", (F.row_number().over(W.orderBy(label)) - 1).cast("int"))

    def encoded(df: DataFrame) -> DataFrame:
        unknown = F.raise_error(F.concat(F.lit("label not seen in training: "), F.col(label))).cast("int")
        return df.join(ids, label, "left").withColumn("label_id", F.coalesce("label_id", unknown))

    return encoded(train), encoded(evaluation)


def argmax_class(df: DataFrame, key: str, label: str = "class", score: str = "score") -> DataFrame:
    """The best class of each key from long ``(key, class, score)`` rows; the first class wins ties."""
    top = df.groupBy(key).agg(F.max(score).alias("_top"))
    held = df.join(top, key).where(F.col(score) == F.col("_top"))
    return held.groupBy(key).agg(F.min(label).alias(label), F.max(score).alias(score))
