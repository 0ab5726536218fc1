"""Models by numeric gradients, plain formulas and held-out accuracy."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from utterlake.llm import gru
from utterlake.llm import quality_classifier as qc
from utterlake.llm import toxicity as tx
from utterlake.llm.boosting import fit_boosted, isotonic

DATA = "/root/testdata/sf0.1"


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    yes = np.asarray(y) == 1
    return (rank[yes].mean() - (yes.sum() - 1) / 2) / (~yes).sum()


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in gru.new_parameters(6).items()}
    x = rng.standard_normal((5, gru.WORD_SIZE + gru.CHAR_SIZE))
    windows = np.array([[0, 1, 2, 3], [4, 2, -1, -1], [1, -1, -1, -1]])
    weight = np.array([1.0, -2.0, 0.5])

    def loss():
        return float((gru.logits(p, x, windows) * weight).sum())

    _, kept = gru.logits(p, x, windows, keep=True)
    g, d_x = gru.gradients(p, x, windows, weight, kept)
    for name, value in [*[(k, p[k]) for k in g], ("x", x)]:
        flat, got = value.reshape(-1), (d_x if name == "x" else g[name]).reshape(-1)
        for at in rng.choice(len(flat), min(6, len(flat)), replace=False):
            before = flat[at]
            flat[at] = before + 1e-3
            up = loss()
            flat[at] = before - 1e-3
            down = loss()
            flat[at] = before
            assert abs((up - down) / 2e-3 - got[at]) < 2e-3, name


def test_windows_cover_every_word():
    texts = ["", None, "a", " ".join("abc" for _ in range(tx.LENGTH)), "x " * (tx.LENGTH + 1), "word " * 500]
    data = tx.Encoded(pa.array(texts))
    windows, row = data.windows()
    for n, text in enumerate(texts):
        own = windows[row == n]
        count = len((text or "").split())
        assert len(own) >= 1
        covered = {k * tx.STRIDE + j for k, w in enumerate(own) for j in range(tx.LENGTH) if w[j] >= 0}
        assert covered == set(range(count))


def test_one_bad_word_in_a_long_text(prose):
    rng = random.Random(2)
    bad = ["vile", "grubby", "nasty"]
    texts, y = [], []
    for n in range(300):
        words = prose(n, 60).split()
        y.append(int(n % 4 == 0))
        if y[-1]:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
    model = tx.learn(texts, np.array(y))
    long = prose(900, 3000)
    score = model.scores(pa.array([long, long + " NASTY!!", None, "", "12 34", "nasty"]))
    assert score[0] < 0.5 < score[1] and score[5] > 0.5
    assert score[2] == score[3] == score[4] and 0 <= score.min() and score.max() <= 1


def test_labelled_texts_are_read_to_their_end(table, spark, prose):
    rng = random.Random(6)
    rows, labels = [], []
    for n in range(160):
        text = prose(n, 4500)
        if n % 4 == 0:
            text += " " + rng.choice(["vile", "grubby"]) + " " + prose(n + 1000, 6)
        assert len(text.split(" vile ")[0].split(" grubby ")[0]) > 20_000
        rows.append((n, text))
        labels.append((n, int(n % 4 == 0)))
    model = tx.fit_toxicity(table(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    long = prose(2000, 4500)
    clean, bad = model.scores(pa.array([long, long + " vile " + prose(2001, 6)]))
    assert clean < 0.5 < bad
    words = tx.Encoded(pa.array(["vile grubby"]))
    assert (model.known(words.hash) > 0).all()


def test_sample_in_tasks_equals_sample_in_memory(table, spark, prose):
    rows = [(n, prose(n, 40 + n) + (" vile " if n % 3 == 0 else " ") + prose(n + 500, 30)) for n in range(60)]
    labels = spark.createDataFrame([(n, int(n % 3 == 0)) for n in range(60)], "doc_id bigint, toxic int")
    one, two = [tx.fit_toxicity(table(rows).repartition(n), labels) for n in (1, 7)]
    assert (one.vocabulary == two.vocabulary).all() and all((one.weights[k] == two.weights[k]).all() for k in one.weights)
    chosen = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    alone = tx.learn([t for _, t in chosen], np.array([n % 3 == 0 for n, _ in chosen]))
    assert (alone.vocabulary == one.vocabulary).all()


def test_nothing_to_learn(table, spark, edge_rows):
    labels = spark.createDataFrame([(1, 1), (4, None)], "doc_id bigint, toxic int")
    scored = tx.toxicity_scores(table(edge_rows), tx.fit_toxicity(table(edge_rows), labels))
    assert scored.count() == len(edge_rows) and scored.select("score").distinct().count() == 1
    assert tx.toxicity_scores(table([]), tx.fit_toxicity(table([]), labels)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name, label, least", [("toxicity", "toxic", 0.93), ("quality", "quality", 0.98)])
def test_held_out_documents(spark, name, label, least):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    if name == "toxicity":
        scored = tx.toxicity_scores(docs, tx.fit_toxicity(docs, labels)).withColumn("held_out", qc.held_out(F.col("doc_id")))
    else:
        scored = qc.quality_scores(docs, labels)
    rows = scored.join(labels, "doc_id").where("held_out").select("doc_id", "score", label).collect()
    assert rows and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert auc([r["score"] for r in rows], [r[label] for r in rows]) > least
    assert scored.count() == docs.count()


def brute_statistics(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line.split() for line in text.split("\n") if line.split()]
    low = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in words]
    grams = [tuple(low[n : n + 4]) for n in range(len(low) - 3)]
    low_lines = [tuple(x.lower() for x in line) for line in lines]
    data = text.encode()
    n, chars = len(words), len(data)
    sizes = [len(w.encode()) for w in words]
    mean = sum(sizes) / max(n, 1)

    def share(count, whole):
        return (count / max(whole, 1)) ** 0.5

    return [
        np.log1p(n),
        np.log1p(chars),
        mean,
        np.log1p(max(sum(s * s for s in sizes) / max(n, 1) - mean**2, 0) ** 0.5),
        share(sum(b in b"#*$%&|<>" for b in data), chars),
        share(sum(65 <= b <= 90 for b in data), chars),
        share(sum(48 <= b <= 57 for b in data), chars),
        share(sum(b in b".,;:?\"'()[]" for b in data), chars),
        share(data.count(b"!"), chars),
        share(sum(b > 127 for b in data), chars),
        share(sum(s <= 3 for s in sizes), n),
        np.log1p(len(set(low))) - 0.5 * np.log1p(n),
        share(max((low.count(w) for w in set(low)), default=0), n),
        share(sum(a == b for a, b in zip(low, low[1:])), n),
        share(len(grams) - len(set(grams)), len(grams)),
        np.log1p(len(lines)),
        np.log1p(n / max(len(lines), 1)),
        share(len(low_lines) - len(set(low_lines)), len(low_lines)),
    ]


def test_statistics_equal_plain_counts(edge_rows, prose):
    texts = [t for _, t in edge_rows] + ["a b\na b\n\nc d\nA B", "X!! Y!! 12 #|", "the the the cat", prose(3, 50) + "\n" + prose(3, 50)]
    got = qc.statistics(pa.array(texts))
    want = np.array([brute_statistics(t or "") for t in texts])
    assert np.allclose(got, want)


def test_discriminant_is_the_difference_of_log_densities(spark):
    rng = np.random.default_rng(4)
    d = len(qc.STATISTICS)
    mix = rng.standard_normal((2, d, d))
    x = [rng.standard_normal((n, d)) @ m + c for c, (n, m) in enumerate(zip((300, 700), mix, strict=True))]
    rows = [(c, [float(v) for v in r]) for c in (0, 1) for r in x[c]]
    model = qc.fit_discriminant(spark.createDataFrame(rows, "label int, statistics array<double>").repartition(3), 0.2, 0.1)
    point = np.concatenate([x[0][:5], x[1][:5]])
    spread = [np.cov(v.T, bias=True) for v in x]
    common = 0.3 * spread[0] + 0.7 * spread[1]
    common = 0.9 * common + 0.1 * np.diag(np.diag(common))
    logs = []
    for c in (0, 1):
        cov = 0.8 * spread[c] + 0.2 * common + qc.RIDGE * (np.diag(np.diag(common)) + qc.RIDGE * np.eye(d)) + 1e-9 * np.eye(d)
        z = point - x[c].mean(0)
        logs.append(np.log((0.3, 0.7)[c]) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ni,ij,nj->n", z, np.linalg.inv(cov), z))
    assert np.allclose(model.log_density(point), np.stack(logs, 1))


def test_quality_edges(table, spark, edge_rows):
    labels = spark.createDataFrame([(n, n % 2) for n in range(1, 11)] + [(5, None)], "doc_id bigint, quality int")
    scored = qc.quality_scores(table(edge_rows), labels).collect()
    assert len(scored) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in scored)
    assert len({r["score"] for r in scored if r["doc_id"] in (1, 2)}) == 1
    assert qc.quality_scores(table([]), labels).count() == 0


def test_boosted_trees_learn_and_calibrate():
    rng = np.random.default_rng(5)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    calibrate = np.arange(3000) % 4 == 0
    model = fit_boosted(x, y, calibrate)
    p = model.probability(x)
    assert ((p > 0.5) == y).mean() > 0.97
    points = isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 1, 1]))
    assert [b for _, b in points] == sorted(b for _, b in points)
