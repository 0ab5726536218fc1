"""The pipeline's stages beside plain Python, on a small corpus in the shared scratch folder."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from utterlake.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus(spark, prose):
    rng_bad = ["vile", "grubby", "nasty"]
    shared = prose(800, 60)
    rows, labels = [], []
    for n in range(160):
        text = prose(n, 50)
        if n % 4 == 0:
            text += " " + rng_bad[n % 3] + " " + prose(n + 500, 10)
        labels.append((n, 1, int(n % 4 == 0)))
        rows.append((n, text))
    rows += [(200, rows[1][1]), (201, rows[1][1] + " more"), (202, None), (203, ""), (None, prose(900, 30)), (205, rows[3][1]), (205, rows[3][1])]
    rows += [(210 + n, prose(600 + n, 40) + "\n" + shared + "\n" + prose(700 + n, 40)) for n in range(4)]
    rows += [(220, prose(950, 30) + " a@b.example.com 10.1.2.3")]
    folder = scratch_path(spark, "corpus")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select(
        "*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"), F.lit(1).alias("score")
    )
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_take_effect(spark, corpus):
    docs, kept = spark.read.parquet(f"{corpus}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, corpus)
        path = scratch_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == cp.COLUMNS
            kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert docs.where("n_chars IS DISTINCT FROM length(text)").count() == 0
    clean = {n for n in range(160) if n % 4}
    assert set(kept["toxicity"]) >= clean | {200, 201, 202, 203, None, 205, 210, 220}
    assert len(set(kept["toxicity"]) & {n for n in range(160) if n % 4 == 0}) <= 4
    near = set(kept["near_duplicates"])
    assert not near & {200, 201, 205} and near >= clean | {202, 203, None, 210, 211, 212, 213, 220}
    cut = kept["substring_dedup"]
    first = WORD.findall(kept["toxicity"][210])
    assert WORD.findall(cut[210]) == first
    for n in (211, 212, 213):
        words = WORD.findall(kept["toxicity"][n])
        assert WORD.findall(cut[n]) == words[:40] + words[100:]
    assert cut[1] == kept["toxicity"][1] and cut[202] is None
    assert "[email]" in kept["pii"][220] and "[ip]" in kept["pii"][220] and kept["pii"][1] == cut[1]
    assert {r["doc_id"] for r in docs.collect()} == set(kept["pii"])


def test_rows_that_share_an_id_but_no_group_all_stay(spark, table, prose):
    one, two, three, four = (prose(n, 50) for n in (41, 42, 43, 44))
    rows = [(3, one), (5, one + " more"), (5, two), (6, three), (6, four), (6, four), (7, three), (8, None), (8, None), (9, ""), (None, one)]
    kept = cp.near_duplicates(spark, table(rows), "").collect()
    want = [(3, one), (5, two), (6, three), (6, four), (8, None), (9, ""), (None, one)]
    assert sorted([(r["doc_id"], r["text"]) for r in kept], key=str) == sorted(want, key=str)


def test_run_and_an_empty_table(spark, corpus):
    assert cp.run(spark, corpus).columns[:6] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id"]
    empty = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, corpus)
    assert empty.count() == 0
