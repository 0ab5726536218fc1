"""Prompt corpora for language-model tuning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlake.functions.text import format_prompt
from utterlake.operators.checks import drop_null, require_columns
from utterlake.operators.dedup import dedup_pair


def prompt_response(df: DataFrame) -> DataFrame:
    """``(prompt, response, category)`` of an utterance table."""
    return df.select(F.col("text").alias("prompt"), "response", F.col("intent").alias("category"))


def to_lm_corpus(df: DataFrame, include_intent: bool = False, is_test: bool = False, position: str = "position") -> DataFrame:
    """``(position, text)``: training rows are distinct question-answer pairs, test rows questions only."""
    intent = "intent" if include_intent and "intent" in df.columns else None
    if is_test:
        rows = drop_null(df, ["text"])
        return rows.select(position, format_prompt("text", intent=intent).alias("text"))
    rows = dedup_pair(drop_null(df, ["text", "response"]), position)
    return rows.select(position, format_prompt("text", "response", intent).alias("text"))


def unify_corpus(df: DataFrame, prompt_col: str = "prompt", response_col: str = "response", eos: str = "") -> DataFrame:
    """``text`` of either corpus form: used as it is, or built from prompt and response."""
    if "text" in df.columns:
        return drop_null(df.select("text"), ["text"]).select(F.concat(F.col("text").cast("string"), F.lit(eos)).alias("text"))
    require_columns(df, [prompt_col, response_col], "Corpus")
    rows = drop_null(df, [prompt_col, response_col])
    return rows.select(
        format_prompt(F.col(prompt_col).cast("string"), F.col(response_col).cast("string"), eos=eos, trim=False).alias("text")
    )
