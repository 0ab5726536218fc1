"""Times the headline jobs; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores.

A query runs three times, or as often as begins within ``MOST_SECONDS``; its figure is the median.
"""

from __future__ import annotations

import json
import os
import re
import time
from statistics import median

from checks import queries as checks
from checks import views as v
from utterlake.operators.features import char_bags, word_bags
from utterlake.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS, MOST_SECONDS = 3, 15
QUERIES = [
    "clean_text",
    "focus_filter",
    "taxonomy_map",
    "dedup_first",
    "dedup_pair",
    "seeded_sample",
    "stratified_split",
    "three_way_split",
    "split_leakage",
    "synthetic_fill",
    "hash_pick",
    "compose_response",
    "lm_corpus",
    "corpus_stats",
    "classification_report",
    "response_pool",
    "answer_table",
    "word_ngrams",
    "tfidf_word",
    "prepare_dataset",
    "predict_batch",
    "similarity_top1",
    "answer_batch",
    "answer_batch_report",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    # Warm-up: starts the Python workers and compiles the common paths on the smallest table.
    items = v.table(spark, SF_DIR, "benchmark")
    run(v.utterances(spark, SF_DIR))
    run(word_bags(items, "item_id"))
    run(char_bags(items, "item_id"))
    seconds = {}

    def timed(name, job):
        start = time.time()
        out = job()
        seconds[name] = round(time.time() - start, 3)
        return out

    app = spark.sparkContext.applicationId
    timed("fit_naive_bayes", lambda: checks._model_path(app, spark, SF_DIR))
    timed("build_index", lambda: checks._index_path(app, spark, SF_DIR))
    runs = {}
    for name in QUERIES:
        figures, began = [], time.time()
        while len(figures) < REPEATS and time.time() - began < MOST_SECONDS:
            timed(name, lambda: run(checks.QUERIES[name](spark, SF_DIR)))
            figures.append(seconds[name])
        seconds[name], runs[name] = round(median(figures), 3), len(figures)
    asked = v.questions(spark, SF_DIR).count()
    scale = re.search(r"sf([\d.]+)", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "total time of the headline jobs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
                "questions": asked,
                "questions_per_sec": round(asked / seconds["answer_batch"], 1),
                "questions_per_sec_with_fit_and_index": round(
                    asked / (seconds["answer_batch"] + seconds["fit_naive_bayes"] + seconds["build_index"]), 1
                ),
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
