"""Synthetic fill of sparse intents and composed answers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.functions.text import focus_phrase, hash_mod, sentences, variant_key
from utterlake.operators.joins import small_table
from utterlake.rules import DEFAULT_CHANNEL, DEFAULT_LANGUAGE, NO_FOCUS, SEED_SOURCE, UNKNOWN_SOURCE, Rules

CHUNK = 1000


def _missing(df: DataFrame, rules: Rules, least: int, patterns: bool) -> DataFrame:
    """``(row_id, intent, response, pattern?, number)``: one row for every example an intent lacks.

    ``row_id`` numbers the rows in the order of the templates.
    """
    known = [
        (place, intent, response, rules.patterns.get(intent, [intent.replace("_", " ")]) if patterns else [])
        for place, (intent, response) in enumerate(rules.templates.items())
    ]
    table = small_table(
        df.sparkSession, known, "place bigint, intent string, response string, patterns array<string>"
    )
    have = df.groupBy("intent").agg(F.count(F.lit(1)).alias("have"))
    lacking = have.join(table, "intent", "right").withColumn(
        "need", F.greatest(F.lit(least) - F.coalesce("have", F.lit(0)), F.lit(0))
    )
    # Numbers are made in two steps, so a large need never becomes one large array.
    blocks = lacking.where("need > 0").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("need") - 1) / CHUNK)))
    )
    last = F.least(F.col("need"), (F.col("block") + 1) * CHUNK) - 1
    rows = blocks.withColumn("number", F.explode(F.sequence(F.col("block") * CHUNK, last)))
    return rows.withColumn("row_id", F.col("place") * F.lit(least) + F.col("number"))


def _seeded(rows: DataFrame, text: Column, source: str) -> DataFrame:
    return rows.select(
        "row_id",
        text.alias("text"),
        "intent",
        "response",
        F.lit(DEFAULT_LANGUAGE).alias("language"),
        F.lit(DEFAULT_CHANNEL).alias("channel"),
        F.lit(source).alias("source"),
    )


def synthetic_fill(df: DataFrame, min_per_intent: int, rules: Rules) -> DataFrame:
    """Rows that bring every known intent up to the minimum, from its patterns in turn."""
    rows = _missing(df, rules, min_per_intent, True)
    at = (F.col("number") % F.size("patterns") + 1).cast("int")
    text = F.concat(F.element_at("patterns", at), F.lit(" sample_"), (F.col("number") + 1).cast("string"))
    return _seeded(rows, text, SEED_SOURCE)


def synthetic_fill_focus(df: DataFrame, min_per_intent: int, rules: Rules) -> DataFrame:
    """The same with one text format over the words of the intent and the example number."""
    rows = _missing(df, rules, min_per_intent, False)
    words = F.replace(F.col("intent"), F.lit("_"), F.lit(" "))
    text = F.replace(F.lit(rules.focus_format), F.lit("{words}"), words)
    text = F.replace(text, F.lit("{number}"), (F.col("number") + 1).cast("string"))
    return _seeded(rows, text, rules.focus_seed_source)


def _variant_table(df: DataFrame, rules: Rules) -> DataFrame:
    """``(intent, bases)``: the answers an intent may start with, each cut into sentences."""
    bases = {**{i: [t] for i, t in rules.templates.items()}, **{i: v for i, v in rules.variants.items() if v}}
    table = small_table(df.sparkSession, list(bases.items()), "intent string, variants array<string>")
    return table.withColumn("_cut", F.transform("variants", sentences))


def _modulus(rules: Rules) -> int:
    """A modulus from which every index of the composition can be read."""
    sizes = [len(v) for v in rules.variants.values() if v]
    size = math.lcm(2, *sizes, len(rules.follow_ups) or 1, 7 * (len(rules.regionals) or 1))
    if size >= 1 << 31:
        raise ValueError("the variant list sizes have too large a common multiple")
    return size


def pick_variant(df: DataFrame, rules: Rules, name: str = "variant") -> DataFrame:
    """One of the answers of the intent, chosen by a hash of intent, text and source."""
    default = F.array(F.lit(rules.default_response))
    chosen = F.coalesce("variants", default)
    at = hash_mod(variant_key("intent", "text", "source"), F.size(chosen))
    table = _variant_table(df, rules).drop("_cut")
    return df.join(table, "intent", "left").withColumn(name, F.element_at(chosen, (at + 1).cast("int"))).drop("variants")


def compose_response(df: DataFrame, rules: Rules, name: str = "composed") -> DataFrame:
    """An answer of at most three sentences: a variant, then a follow-up, then a regional note."""
    mark = F.col("_m")
    pools = F.coalesce(F.col("_cut"), F.array(sentences(F.lit(rules.default_response))))
    picked = F.element_at(pools, (mark % F.size(pools) + 1).cast("int"))
    base = F.when(F.size(picked) > 0, picked).otherwise(F.array(F.lit(rules.default_response)))
    work = (
        df.join(_variant_table(df, rules).drop("variants"), "intent", "left")
        .withColumn("_m", hash_mod(variant_key("intent", "text", "source"), _modulus(rules)))
        .withColumn("_focus", focus_phrase("text", rules.stop_words, NO_FOCUS))
        .withColumn("_base", base)
    )
    parts = F.size("_base")
    full = F.col("source").isin(rules.full_length_sources)
    wanted = F.when(full, F.lit(3)).otherwise(mark % 2 + 2)
    extra = F.least(F.lit(3) - parts, wanted - parts)

    def option(texts: list[str], at: Column) -> Column:
        return F.element_at(F.array(*[F.lit(t) for t in texts]), (at % len(texts) + 1).cast("int"))

    joined = F.array_join("_base", " ")
    with_follow = joined
    if rules.follow_ups:
        follow = F.replace(option(rules.follow_ups, mark), F.lit("{focus}"), F.col("_focus"))
        with_follow = F.concat(joined, F.lit(" "), follow)
    with_both = with_follow
    if rules.regionals:
        regional = option(rules.regionals, F.floor(F.pmod(mark, F.lit(7 * len(rules.regionals))) / 7))
        with_both = F.concat(with_follow, F.lit(" "), regional)
    answer = (
        F.when(extra <= 0, F.array_join(F.slice("_base", 1, 3), " "))
        .when(extra == 1, with_follow)
        .otherwise(with_both)
    )
    return work.withColumn(name, answer).drop("_m", "_focus", "_base", "_cut")


def diversify_responses(df: DataFrame, rules: Rules) -> DataFrame:
    """``response`` replaced by a composed one; a table without ``source`` counts as unknown."""
    work = df if "source" in df.columns else df.withColumn("source", F.lit(UNKNOWN_SOURCE))
    return compose_response(work, rules, "_new").withColumn("response", F.col("_new")).drop("_new")
