"""Ingest, prepare and train in one run."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from utterlake.plans.prepare import PreparedDataset, PrepareOptions, prepare_dataset
from utterlake.plans.train import TrainResult, train_classical
from utterlake.rules import Rules
from utterlake.schemas import BENCHMARK
from utterlake.session import materialize
from utterlake.sources.readers import (
    first_available,
    load_external,
    load_taxonomy_corpus,
    optional,
    read_csv,
    read_utterances,
    split_corrupt,
    with_source_defaults,
)


@dataclass
class RunConfig:
    """Paths of one run. ``benchmark`` lists folders to try in order, each with train and test CSV."""

    output: str
    benchmark: list[str] = field(default_factory=list)
    regional: list[str] = field(default_factory=list)
    external: dict[str, str] = field(default_factory=dict)
    max_benchmark_rows: int = 0
    model: str = "all"
    options: PrepareOptions = field(default_factory=PrepareOptions)


def gather(spark: SparkSession, config: RunConfig, rules: Rules, corrupt: list[DataFrame] | None = None) -> list[DataFrame]:
    """Sources in their fixed order; focus mode reads the regional files only. Broken lines go to ``corrupt``."""
    frames = []
    if not config.options.focus:

        def corpus(folder: str) -> DataFrame:
            read = [materialize(read_csv(spark, f"{folder}/{p}.csv", BENCHMARK), "benchmark") for p in ("train", "test")]
            parts, broken = zip(*[split_corrupt(rows) for rows in read], strict=True)
            if corrupt is not None:
                corrupt.extend(broken)
            return load_taxonomy_corpus(*parts, rules, max_rows=config.max_benchmark_rows or None, seed=config.options.seed)

        found = first_available([lambda f=f: corpus(f) for f in config.benchmark])
        frames += [found] if found is not None else []
        frames += [
            optional(spark, path, lambda p, n=name: load_external(read_utterances(spark, p), n, rules))
            for name, path in config.external.items()
        ]
    frames += [optional(spark, p, lambda p: with_source_defaults(read_utterances(spark, p))) for p in config.regional]
    return frames


def run_all(spark: SparkSession, config: RunConfig, rules: Rules) -> tuple[PreparedDataset, TrainResult]:
    """The whole run; lines that do not fit their file's layout are written to ``corrupt`` beside the dataset."""
    corrupt: list[DataFrame] = []
    dataset = prepare_dataset(gather(spark, config, rules, corrupt), rules, config.options)
    dataset.write(f"{config.output}/dataset")
    lines = reduce(DataFrame.unionByName, corrupt) if corrupt else spark.createDataFrame([], "_corrupt_record string")
    lines.write.mode("overwrite").json(f"{config.output}/corrupt")
    result = train_classical(dataset.train, config.model, key="position")
    result.save(f"{config.output}/models")
    return dataset, result
