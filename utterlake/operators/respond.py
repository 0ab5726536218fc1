"""Routing, fallback ladders and batch answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.functions.numeric import argmax, fixed4, softmax
from utterlake.operators.classify import TextModel
from utterlake.operators.joins import SALTS, chosen_rows, hot_keys, salted_lookup, small_table
from utterlake.operators.retrieve import AnswerIndex, similarity_top1
from utterlake.operators.taxonomy import lookup_label
from utterlake.rules import (
    CONFIDENCE_GATE,
    LOW_CONFIDENCE_MARK,
    SIMILARITY_FLOOR,
    SIMILARITY_GATE,
    Rules,
)
from utterlake.session import materialize, scratch_path, scratch_scope


def _any(text: Column, patterns: Sequence[str]) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | text.rlike(pattern)
    return found


def route_intent(text: Column | str, routes: Sequence[dict]) -> Column:
    """Intent of the first matching route by priority, then name; null when none matches.

    A route has ``intent``, ``patterns``, ``neg_patterns`` and ``priority``. Routes are a short list,
    so they become one expression and need no join.
    """
    lowered = F.lower(F.col(text) if isinstance(text, str) else text)
    out = F.lit(None).cast("string")
    for rule in sorted(routes, key=lambda r: (-r["priority"], r["intent"]), reverse=True):
        hit = _any(lowered, rule["patterns"]) & ~_any(lowered, rule.get("neg_patterns", []))
        out = F.when(hit, F.lit(rule["intent"])).otherwise(out)
    return out


def keyword_route(df: DataFrame, routes: Sequence[dict], text: str = "text", intent: str = "predicted_intent") -> DataFrame:
    """Replace the model's intent where a route matches; ``routed`` says where."""
    found = route_intent(text, routes)
    return (
        df.withColumn("_route", found)
        .withColumn("routed", F.col("_route").isNotNull())
        .withColumn(intent, F.coalesce("_route", intent))
        .drop("_route")
    )


def first_example(index: AnswerIndex) -> DataFrame:
    """``(intent, ex_id, text, response)`` of the lowest id in each intent."""
    return index.intents.select(
        "intent",
        F.col("first_id").alias("ex_id"),
        F.col("first_text").alias("text"),
        F.col("first_response").alias("response"),
    )


def fallback_response(df: DataFrame, rules: Rules, intent: str = "predicted_intent") -> DataFrame:
    """``df`` with ``generic``: the general answer of the intent, or null."""
    table = small_table(df.sparkSession, list(rules.generic.items()), "_intent string, generic string")
    return df.join(table, F.col(intent) == F.col("_intent"), "left").drop("_intent")


def matched(predictions: DataFrame, index: AnswerIndex, conf_min: float = CONFIDENCE_GATE) -> DataFrame:
    """Predictions with the best example of their intent.

    ``predictions`` has ``qid, text, predicted_intent, confidence``. Questions below the confidence
    gate are not searched.
    """
    asked = predictions.where(F.col("confidence") >= conf_min).select(
        "qid", F.col("predicted_intent").alias("intent"), "text"
    )
    path = scratch_path(predictions.sparkSession, "top1")
    with scratch_scope(predictions.sparkSession, "search"):
        top = materialize(similarity_top1(asked, index).select("qid", "ex_id", "sim"), "top1", path)
    sizes = materialize(top.groupBy("ex_id").agg(F.count(F.lit(1)).alias("_n")), "top1-sizes")
    texts = index.examples.select(
        "ex_id", F.col("text").alias("match_text"), F.col("response").alias("match_response")
    )
    # Texts of examples are long: only those that were found move, once, and to the questions.
    texts = chosen_rows(texts, sizes.select("ex_id"), "ex_id")
    hot = hot_keys(sizes.where(F.col("_n") > SALTS), ["ex_id"], "_n")
    found = salted_lookup(predictions.join(top, "qid", "left"), texts, ["ex_id"], hot, ["qid"], "left")
    firsts = index.intents.select(F.col("intent").alias("predicted_intent"), "first_text", "first_response")
    return found.join(firsts.withColumn("has_examples", F.lit(True)), "predicted_intent", "left")


def answer_ladder(
    df: DataFrame, rules: Rules, conf_min: float = CONFIDENCE_GATE, sim_min: float = SIMILARITY_GATE
) -> DataFrame:
    """``response`` and ``fallback_type``: confidence, then known intent, then similarity."""
    work = fallback_response(df, rules)
    low = F.col("confidence") < conf_min
    unknown = F.col("has_examples").isNull()
    far = F.col("sim") < sim_min
    response = (
        F.when(low, F.lit(rules.clarification))
        .when(unknown, F.coalesce("generic", F.lit(rules.no_information)))
        .when(far, F.coalesce("generic", "first_response"))
        .otherwise(F.col("match_response"))
    )
    kind = F.when(low, "confidence").when(unknown, "generic_intent").when(far, "similarity").otherwise("none")
    return work.withColumn("response", response).withColumn("fallback_type", kind).drop("generic")


def report_ladder(
    df: DataFrame,
    rules: Rules,
    conf_min: float = CONFIDENCE_GATE,
    sim_min: float = SIMILARITY_GATE,
    floor: float = SIMILARITY_FLOOR,
) -> DataFrame:
    """Evaluation form: also the similar question and both scores as text with four decimals.

    Below ``floor`` the first example stands in for the best one; a general answer counts as a
    fallback only when it differs from the example's answer.
    """
    work = fallback_response(df, rules)
    low = F.col("confidence") < conf_min
    sim = F.coalesce("sim", F.lit(0.0))
    near = sim >= floor
    own = F.when(near, F.col("match_response")).otherwise(F.col("first_response"))
    like = F.when(near, F.col("match_text")).otherwise(F.col("first_text"))
    swap = (sim < sim_min) & F.col("generic").isNotNull() & ~F.col("generic").eqNullSafe(own)
    return work.select(
        "qid",
        F.col("text").alias("question"),
        "predicted_intent",
        fixed4("confidence").alias("intent_confidence"),
        F.when(low, F.lit(LOW_CONFIDENCE_MARK)).otherwise(like).alias("similar_question"),
        fixed4(F.when(low, F.lit(0.0)).otherwise(sim)).alias("similarity_score"),
        F.when(low, F.lit(rules.clarification)).when(swap, F.col("generic")).otherwise(own).alias("response"),
        F.when(low, F.lit("confidence")).when(swap, F.lit("similarity")).otherwise(F.lit("none")).alias("fallback_type"),
    )


def predict(df: DataFrame, model: TextModel, rules: Rules | None = None) -> DataFrame:
    """``(qid, text, predicted_intent, confidence)``, routed by keywords when the rules have routes."""
    out = model.predict(df.select("qid", "text"), "qid")
    return keyword_route(out, rules.routes).drop("routed") if rules and rules.routes else out


def answer(questions: DataFrame, model: TextModel, index: AnswerIndex, rules: Rules, report: bool = False) -> DataFrame:
    """Answer a table of ``(qid, text)`` questions."""
    path = scratch_path(questions.sparkSession, "predictions")
    with scratch_scope(questions.sparkSession, "predict"):
        predictions = materialize(predict(questions, model, rules), "predictions", path)
    found = matched(predictions, index)
    if report:
        return report_ladder(found, rules)
    return answer_ladder(found, rules).select(
        "qid", "text", "predicted_intent", "confidence", "sim", "response", "fallback_type"
    )


def score_logits(df: DataFrame, logits: str, classes: Sequence[str]) -> DataFrame:
    """``predicted_intent`` and ``confidence`` from a column of outside scores."""
    work = df.withColumn("_at", argmax(F.col(logits).cast("array<double>")))
    work = work.withColumn("confidence", softmax(logits)[F.col("_at")])
    return lookup_label(work, classes, "_at", "predicted_intent").drop("_at")


def score_with(df: DataFrame, fn, schema: str) -> DataFrame:
    """Hook for a user's own model: ``fn`` maps an iterator of pandas batches to another."""
    return df.mapInPandas(fn, schema)
