"""Train, compare and keep classical models."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlake.operators.checks import drop_null, require_columns
from utterlake.operators.classify import fit_naive_bayes
from utterlake.operators.evaluate import accuracy, best_model, classification_report
from utterlake.operators.linear import fit_entries, fit_linear
from utterlake.operators.split import stratified_split
from utterlake.operators.stats import response_pool
from utterlake.rules import EVAL_SHARE, MODEL_ORDER, NB_ALPHA, SEED
from utterlake.session import materialize, sweep
from utterlake.sources.writers import run_id, run_path, write_report, write_response_pool


@dataclass
class TrainResult:
    models: dict[str, object]
    reports: dict[str, DataFrame]
    metrics: DataFrame
    best: str
    responses: DataFrame | None

    def save(self, root: str, run: str | None = None) -> str:
        """Models, reports and answers under a run folder, the same again as the latest state."""
        run = run or run_id("classical")
        history = run_path(root, "classical", run)
        for place in (history, f"{root.rstrip('/')}/classical/latest"):
            for name, model in self.models.items():
                model.save(f"{place}/{name}")
                write_report(self.reports[name], f"{place}/evaluation_{name}")
            self.metrics.coalesce(1).write.mode("overwrite").parquet(f"{place}/metrics")
            if self.responses is not None:
                write_response_pool(self.responses, f"{place}/responses")
        return history


def train_classical(
    df: DataFrame,
    model: str = "all",
    eval_df: DataFrame | None = None,
    text: str = "text",
    label: str = "intent",
    response: str = "response",
    key: str = "row_id",
    eval_share: float = EVAL_SHARE,
    seed: int = SEED,
) -> TrainResult:
    """Fit one or all models, report on held-out rows and name the best one.

    With ``eval_df`` all of ``df`` is for training; otherwise ``df`` is split, by class where the
    classes allow it. All models are fitted on all rows; the two linear ones share their entries and, beyond what the
    driver holds, are fitted side by side, as their steps wait for small results.
    """
    names = MODEL_ORDER if model == "all" else [model]
    unknown = [n for n in names if n not in MODEL_ORDER]
    if unknown:
        raise ValueError(f"no such model: {unknown[0]}")
    require_columns(df, [text, label])

    def lean(part: DataFrame) -> DataFrame:
        return drop_null(part, [text, label]).select(
            key, F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("intent")
        )

    if eval_df is None:
        marked = materialize(stratified_split(lean(df), "intent", eval_share, key, seed, strict=False), "train-split")
        train, held = (marked.where(F.col("split") == s).drop("split") for s in ("train", "eval"))
    else:
        train, held = lean(df), lean(require_columns(eval_df, [text, label], "Test dataset"))

    models, reports, metrics = {}, {}, None
    linear = [n for n in names if n != "naive_bayes"]
    fits, postings = {}, None
    if linear:
        entries = fit_entries(train, key, "intent", "text")
        # On packed terms the driver holds the vectors of a fit, so one goes after the other.
        with ThreadPoolExecutor(1 if entries.packed else len(linear)) as pool:
            jobs = {n: pool.submit(copy_context().run, fit_linear, entries, n) for n in linear}
            fits = {n: job.result() for n, job in jobs.items()}
        postings = entries.packed.postings if entries.packed else None
    for name in names:
        fitted = fits.get(name) or fit_naive_bayes(train, key, alpha=NB_ALPHA, postings=postings)
        sweep(df.sparkSession)
        scored = fitted.predict(held, key)
        scored = materialize(scored.select("intent", "predicted_intent"), f"scored-{name}")
        models[name] = fitted
        reports[name] = classification_report(scored, "intent", "predicted_intent")
        one = accuracy(scored, "intent", "predicted_intent").select(F.lit(name).alias("model"), "accuracy")
        metrics = one if metrics is None else metrics.unionByName(one)
    best = best_model(metrics, MODEL_ORDER).first()["model"]
    pool = response_pool(df, label, response) if response in df.columns else None
    return TrainResult(models, reports, metrics, best, pool)
