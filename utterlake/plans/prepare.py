"""Dataset preparation: union, cleaning, filters, fill, duplicates, split, statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlake.functions.text import clean_text, contains_keyword, normalize_intent, strip
from utterlake.operators.augment import diversify_responses, synthetic_fill, synthetic_fill_focus
from utterlake.operators.checks import require_rows
from utterlake.operators.dedup import ROW_BITS, dedup_first, union_sources
from utterlake.operators.split import three_way_split
from utterlake.operators.stats import dataset_stats, stats_document
from utterlake.operators.taxonomy import allow_intents
from utterlake.rules import MIN_PER_INTENT, MIN_TEXT_LENGTH, SEED, Rules
from utterlake.session import materialize
from utterlake.sources.writers import write_document, write_splits


@dataclass
class PrepareOptions:
    min_per_intent: int = MIN_PER_INTENT
    synthetic: bool = True
    focus: bool = False
    diversify: bool = False
    seed: int = SEED


@dataclass
class PreparedDataset:
    """``full`` has a ``split`` column; the parts are filters on it."""

    full: DataFrame
    stats: DataFrame

    @property
    def train(self) -> DataFrame:
        return self.full.where("split = 'train'").drop("split")

    @property
    def val(self) -> DataFrame:
        return self.full.where("split = 'val'").drop("split")

    @property
    def test(self) -> DataFrame:
        return self.full.where("split = 'test'").drop("split")

    def write(self, path: str) -> dict[str, str]:
        files = write_splits(self.full, path)
        write_document(stats_document(self.stats, files), f"{path}/stats")
        return files


def min_length(df: DataFrame, least: int = MIN_TEXT_LENGTH) -> DataFrame:
    """Rows with a text longer than ``least`` and an intent."""
    return df.where((F.length("text") > least) & (F.length("intent") > 0))


def focus_filter(df: DataFrame, rules: Rules, word_boundary: bool = False) -> DataFrame:
    """Rows of the focus source or with a focus keyword in the text."""
    from_source = F.coalesce(F.lower("source") == rules.focus_source, F.lit(False))
    return df.where(from_source | contains_keyword("text", rules.keywords, word_boundary))


def clean_rows(df: DataFrame) -> DataFrame:
    """Cleaned text, normal intent, trimmed response; null texts are dropped."""
    return min_length(
        df.where("text is not null")
        .withColumn("text", clean_text("text"))
        .withColumn("intent", normalize_intent("intent"))
        .withColumn("response", strip("response"))
    )


def prepared_rows(sources: Sequence[DataFrame], rules: Rules, options: PrepareOptions) -> DataFrame:
    """Every row of the prepared dataset with its ``position``, before the split."""
    united = require_rows(union_sources(sources), "No source has any rows: the prepared table would be empty.")
    cleaned = clean_rows(united)
    if options.focus:
        cleaned = require_rows(focus_filter(cleaned, rules), "Focus mode produced an empty dataset.")
    known = materialize(allow_intents(cleaned, rules.templates), "cleaned")
    rows = known
    if options.synthetic:
        fill = synthetic_fill_focus if options.focus else synthetic_fill
        seeds = fill(known, options.min_per_intent, rules)
        # The fill comes after all sources, so its rows lose against equal ones.
        placed = seeds.withColumn("position", F.col("row_id") + F.lit(len(sources) << ROW_BITS))
        rows = known.unionByName(placed, allowMissingColumns=True)
    if options.diversify:
        rows = diversify_responses(rows, rules)
    return dedup_first(rows, ("text", "intent"))


def prepare_dataset(sources: Sequence[DataFrame], rules: Rules, options: PrepareOptions | None = None) -> PreparedDataset:
    """Run the whole preparation. ``sources`` hold ``row_id`` and the six utterance columns."""
    options = options or PrepareOptions()
    rows = materialize(prepared_rows(sources, rules, options), "prepared")
    full = materialize(three_way_split(rows, "intent", "position", options.seed), "split")
    return PreparedDataset(full, dataset_stats(full, options.focus))
