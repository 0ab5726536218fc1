"""Alignment, MinHash near-duplicates and clustering beside brute force; kernels without the package."""

import collections
import hashlib
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterlake.llm import alignment, centroids, minhash_dedup
from utterlake.llm.alignment import diagonal_runs
from utterlake.llm.tables import likely
from utterlake.session import materialize

from test_pairs_and_passages import brute_components, edited


def brute_alignment(rows):
    """Whole texts through both libraries, groups and links by plain loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment.vocabularies()
    first, second = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    first.encode_special_tokens = True
    spell = {}
    for v in (alignment.ByteVocabulary(path_a), alignment.PieceVocabulary(path_b)):
        ends = np.cumsum(v.size)
        spell[type(v)] = [v.flat[e - n : e].tobytes() for e, n in zip(ends, v.size, strict=True)]
    found, counts = [], collections.Counter()
    for key, text in rows:
        whole = (" " + (text or "")).encode()
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        b = second.encode(text or "")
        parts_a, parts_b = [spell[alignment.ByteVocabulary][i] for i in a], [spell[alignment.PieceVocabulary][i] for i in b]
        if not text or b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            found.append((key, [], [], [], []))
            continue
        spans = []
        for parts in (parts_a, parts_b):
            ends = np.cumsum([len(p) for p in parts]).tolist()
            spans.append(list(zip([0, *ends], ends, strict=False)))
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = []
        for low, high in zip([0, *cuts], cuts, strict=False):
            sides = ([str(i) for i, (x, y) in zip(ids, own, strict=True) if low <= x and y <= high] for ids, own in zip((a, b), spans, strict=True))
            groups.append("|".join(",".join(s) for s in sides))
        links = [(i, j) for i, (x, y) in zip(a, spans[0], strict=True) for j, (p, q) in zip(b, spans[1], strict=True) if max(x, p) < min(y, q)]
        counts.update(set(links))
        found.append((key, a, b, groups, links))
    best = collections.defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = []
    for key, a, b, groups, links in found:
        text = ";".join(groups)
        figures = (len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links))
        out.append((key, *figures, hashlib.sha256(text.encode()).hexdigest() if text else "", text))
    return sorted(out, key=str)


ODD = ["a     b  c　 d  e", "  x  y   ", "\n\n a\n b \tc", "<|endoftext|> </s> <s> it's 'S", " ", "é 日本 語  \U0001f600 z", "a▁b", "\x00 b\x1c d\x85 e", "ﬁ ½ Ａ"]


def test_alignment_equals_brute_force(table, prose, edge_rows):
    rows = [(k, t if t is None else t[:400]) for k, t in edge_rows] + [(100 + n, t) for n, t in enumerate(ODD)]
    rows += [(200 + n, prose(n, 60 + n) + ", 12.5%!") for n in range(12)] + [(300, "word " * 50)]
    found = alignment.align_documents(table(rows), *alignment.vocabularies(), with_groups=True)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")
    assert sorted([tuple(r[n] for n in names) for r in found.collect()], key=str) == brute_alignment(rows)
    assert alignment.align_documents(table([]), *alignment.vocabularies()).count() == 0


def test_runs_on_diagonals_of_any_shape():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 40, 300):
        for share in (0.05, 0.5, 0.95):
            cuts = np.arange(1, n + 1)
            a, b = (np.append(cuts[:-1][rng.random(n - 1) < share], n) for _ in range(2))
            ends_a, ends_b, link_a, link_b = diagonal_runs(a, b, np.array([0, len(a)]), np.array([0, len(b)]))
            assert a[ends_a - 1].tolist() == b[ends_b - 1].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
            want = {(i, j) for i in range(len(a)) for j in range(len(b)) if max(a[i - 1] if i else 0, b[j - 1] if j else 0) < min(a[i], b[j])}
            assert set(zip(link_a.tolist(), link_b.tolist(), strict=True)) == want and len(link_a) == len(want)


def test_near_duplicates_equal_brute_force(table, prose, edge_rows):
    rows = list(edge_rows)
    for n in range(10):
        text = prose(200 + n, 80 + 10 * n)
        for step in range(6):
            rows.append((1000 + 10 * n + step, text))
            text = edited(text, 40 + n, f"q{step}")
    rows += [(2000 + n, prose(300, 30) + " " + prose(400 + n, 40)) for n in range(20)]
    want = [(k, n, c, k == c) for k, n, c in brute_components(rows, 4, 80)]
    found = minhash_dedup.near_duplicate_groups(table(rows), bucket_block=3)
    assert sorted([tuple(r) for r in found.select("doc_id", "n_shingles", "component_id", "kept").collect()], key=str) == sorted(want, key=str)
    assert minhash_dedup.near_duplicate_groups(table([])).count() == 0


def test_pruning_keeps_the_chosen_probability():
    least = minhash_dedup.least_agreeing(80)
    assert len(least) == minhash_dedup.HASHES // minhash_dedup.BATCH and least == sorted(least)
    rng = np.random.default_rng(3)
    for similarity, kept in ((0.8, True), (0.4, False)):
        agree = np.cumsum(rng.random((20_000, minhash_dedup.HASHES)) < similarity, axis=1)[:, minhash_dedup.BATCH - 1 :: minhash_dedup.BATCH]
        assert (agree >= least).all(axis=1).mean() == (1.0 if kept else 0.0)


def brute_clusters(rows, k, rounds, seed, width):
    kept = [(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in start[:k]]
    for turn in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres] for _, v in kept]
        own = [d.index(min(d)) for d in far]
        if turn < rounds:
            for c in range(len(centres)):
                members = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
                if members:
                    centres[c] = tuple(sum(x) // len(members) for x in zip(*members, strict=True))
    return sorted([(i, o, min(d), hashlib.sha256(",".join(map(str, centres[o])).encode()).hexdigest()) for (i, _), o, d in zip(kept, own, far, strict=True)], key=str)


@pytest.mark.parametrize("k", [1, 2, 9])
def test_clusters_equal_brute_force(spark, k):
    rng = np.random.default_rng(k)
    points = np.round(rng.normal(size=(120, 4)) + 3 * rng.integers(0, 3, (120, 1)), 1)
    rows = [(n, [float(x) for x in p]) for n, p in enumerate(points)]
    rows += [(5, rows[5][1]), (6, rows[7][1]), (None, rows[8][1])]  # repeated rows and ids, ties
    rows += [(200, None), (201, []), (202, [1.0] * 3), (203, [1.0, None, 2.0, 3.0]), (204, [float("nan")] * 4), (205, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").select("*", *[F.lit(1).alias(c) for c in ("v", "cluster", "label", "upper")])
    found = centroids.cluster_vectors(df, k, 3, 2, 4).collect()
    exact = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute_clusters(exact, k, 3, 2, 4)
    assert sorted([(r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in found], key=str) == want
    sums = collections.Counter()
    for _, cluster, distance, _ in want:
        sums[cluster] += distance
    assert all(r.cluster_inertia == sums[r.cluster] and r.inertia == sum(sums.values()) for r in found)


def test_few_or_huge_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert centroids.cluster_vectors(make([]), 3, 2, 2, 2).count() == 0
    assert centroids.cluster_vectors(make([(1, [0.0, 1.0]), (2, [5.0, 1.0])]), 40, 2, 2, 2).count() == 2
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster_vectors(make([(1, [1e30, 1.0])]), 3, 2, 2, 2).count()


def test_workers_need_not_have_the_package(tmp_path):
    """Kernels travel with the job: the workers of this run cannot import the library."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from utterlake.session import build_session
spark = build_session("travel", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}})
from utterlake.llm import registry
for name in {["op1_substring_dedup", "op2_best_fit_packing", "op4_sentencepiece_sampling", "op5_ngram_jaccard_join", "op6_toxicity", "op9_quality_classifier", "op10_pii", "op11_tokenizer_alignment", "op12_minhash_dedup", "op13_centroid_clustering"]!r}:
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""
    own = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith("SPARK") and not k.startswith("PYSPARK")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=own, capture_output=True, text=True, timeout=900)
    assert "all ran" in done.stdout, done.stderr[-3000:]


def test_minhash_moves_texts_and_no_runs(spark, table, monkeypatch):
    words = [f"w{n}" for n in range(60)]
    rows = [(n, " ".join(words)) for n in range(3)] + [(3, " ".join([*words, "more"])), (4, "a b"), (5, "A  B"), (6, None), (7, "alone")]
    kept, plain = {}, minhash_dedup.materialize
    monkeypatch.setattr(minhash_dedup, "materialize", lambda df, name: kept.setdefault(name, plain(df, name)))
    nodes = []
    monkeypatch.setattr(minhash_dedup, "keyed_table", lambda df, *a, **k: nodes.append(df) or df)
    monkeypatch.setattr(minhash_dedup, "near_components", lambda *a: None)
    found = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicate_groups(table(rows)).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}
    assert "runs" not in kept["minhash-sets"].columns
    plan = nodes[0]._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert "MapInArrow" in plan[0] and "runs" not in "".join(plan[1:])
    assert {len(r.runs) for r in nodes[0].collect()} == {r.n for r in nodes[0].collect()}


def test_rows_without_partner_are_not_moved(spark, table, prose, monkeypatch):
    """Exact after the join; before it nearly all other rows are gone, null keys too."""
    keys = materialize(spark.range(0, 40_000, 20).withColumnRenamed("id", "node"), "keys")
    rows = spark.range(40_000).select(F.col("id").alias("node"), F.lit("x").alias("text")).union(spark.sql("SELECT cast(NULL AS bigint), 'x'"))
    some = likely(rows, keys, "node")
    assert some.columns == ["node", "text"] and some.join(keys, "node", "left_semi").count() == 2_000
    assert 2_000 <= some.count() < 2_000 + 38_000 // 8
    assert likely(rows, keys.where("node < 0"), "node").count() == 0
    nodes = []
    monkeypatch.setattr(minhash_dedup, "keyed_table", lambda df, *a, **k: nodes.append(df) or df)
    monkeypatch.setattr(minhash_dedup, "near_components", lambda *a: None)
    minhash_dedup.near_duplicate_groups(table([(1, prose(1, 40)), (2, prose(1, 40) + " tail"), (3, prose(2, 40))]))
    assert "bitmap_construct_agg" in nodes[0]._jdf.queryExecution().optimizedPlan().toString()
