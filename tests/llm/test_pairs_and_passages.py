"""Substring dedup and the Jaccard join beside brute force."""

import hashlib
import os
import re

import pytest

from utterlake.llm import jaccard_join
from utterlake.llm.components import components
from utterlake.llm.jaccard_join import jaccard_components
from utterlake.llm.substring_dedup import substring_dedup
from utterlake.session import scratch_scope

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_removed(rows, window):
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        words = WORD.findall(text or "")
        gone = set()
        for n in range(len(words) - window + 1):
            gram = tuple(words[n : n + window])
            if gram in seen:
                gone.update(range(n, n + window))
            seen.add(gram)
        out.append((key, len(words), len(gone), " ".join(w for n, w in enumerate(words) if n not in gone)))
    return sorted(out, key=str)


def found_removed(df):
    return sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect()], key=str)


def passages(prose):
    shared = prose(100, 55)
    rows = [(n, prose(n, 40) + " " + shared + " " + prose(1000 + n, 30)) for n in range(40)]
    rows += [(50, shared), (51, prose(7, 19)), (52, prose(7, 19)), (53, prose(8, 20)), (54, prose(8, 20))]
    rows += [(55, prose(10, 30) + " " + prose(11, 9) + " " + prose(10, 30) + " y"), (56, prose(12, 12) * 4)]
    rows += [(60, prose(9, 25) + "\n" + prose(9, 25)), (61, "x " * 200), (62, "x " * 19), (63, prose(9, 25).upper())]
    return rows


@pytest.mark.parametrize("chars", [2_000, 8_000_000])
def test_repeated_windows_go_but_for_the_first(table, prose, edge_rows, chars):
    rows = passages(prose) + [r for r in edge_rows if r[0] is None or r[0] < 20 and r[0] not in {n for n in range(40)}]
    assert found_removed(substring_dedup(table(rows), block_chars=chars)) == brute_removed(rows, 20)


def test_edges_of_substring_dedup(table, edge_rows):
    assert found_removed(substring_dedup(table(edge_rows), block_chars=1_500)) == brute_removed(edge_rows, 20)
    small = [(1, "a b c d e f g h"), (2, "z a b c d y"), (3, None)]
    assert found_removed(substring_dedup(table(small), window=4, phrase=2)) == brute_removed(small, 4)
    out = substring_dedup(table([]), keep=["lang"])
    assert out.count() == 0 and out.columns == ["doc_id", "text", "lang", "n_words", "n_removed", "kept_text"]


def brute_components(rows, size=5, percent=75):
    sets = []
    for key, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(words[n : n + size]) for n in range(max(1, len(words) - size + 1))} if words else set())
    root = list(range(len(rows)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = []
    for n, (key, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if find(m) == find(n) and rows[m][0] is not None] if sets[n] else [key]
        out.append((key, len(sets[n]), min(ids) if ids and ids != [None] else None))
    return sorted(out, key=str)


def found_components(df):
    return sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()], key=str)


def edited(text, every, mark):
    return " ".join(mark + w if n % every == every // 2 else w for n, w in enumerate(text.split()))


def test_links_equal_brute_force(table, prose, edge_rows):
    rows = list(edge_rows)
    for n in range(12):  # chains of edits, whose ends may not link with each other
        text = prose(200 + n, 80 + 10 * n)
        for step in range(6):
            rows.append((1000 + 10 * n + step, text))
            text = edited(text, 40 + n, f"q{step}")
    common = prose(300, 30)
    rows += [(2000 + n, common + " " + prose(400 + n, 60)) for n in range(30)]
    rows += [(2100 + n, common + " " + prose(500 + n, 3)) for n in range(10)]
    rows += [(2200, "A b"), (2201, "a B"), (2202, "a b c d e"), (2203, "A B C D E a b c d e a b c d e")]
    assert found_components(jaccard_components(table(rows), block_chars=3_000)) == brute_components(rows)


def mixed(template, seed, share, prose):
    """The template with stretches of other words in place of a share of it."""
    words, other = template.split(), prose(seed, len(template.split())).split()
    at = 0
    while at < len(words):
        n = 10 + (seed * 7 + at) % 31
        if (seed * 31 + at * 17) % 100 < share:
            words[at : at + n] = other[at : at + n]
        at += n
    return " ".join(words)


def test_long_texts_of_one_template(table, prose):
    """Texts of 1,000 to 5,000 words around the threshold: most share a template and do not link, some do."""
    rows = []
    for length, share in ((1000, 12), (1000, 8), (2500, 10), (5000, 14)):
        template = prose(length + share, length)
        rows += [(len(rows) + n, mixed(template, 3 * len(rows) + n, share, prose)) for n in range(10)]
    want = brute_components(rows)
    assert 1 < len({c for _, _, c in want}) < len(rows)
    assert found_components(jaccard_components(table(rows), block_chars=100_000, tile_block=3)) == want


def test_thresholds_are_exact(table):
    words = [f"w{n}" for n in range(200)]
    for cut in range(150, 170):  # around 75 percent of the union
        rows = [(1, " ".join(words[:cut])), (2, " ".join(words[: cut - 20] + [f"v{n}" for n in range(20 + cut % 7)]))]
        if cut in (150, 157, 163, 169):
            assert found_components(jaccard_components(table(rows))) == brute_components(rows)


def test_no_documents_no_links(table, prose):
    assert jaccard_components(table([])).count() == 0
    rows = [(n, prose(n, 30)) for n in range(5)]
    assert found_components(jaccard_components(table(rows))) == brute_components(rows)


def test_components_of_paths_stars_and_pairs(spark):
    edges = [(n, n + 1) for n in range(50)] + [(100, n) for n in range(101, 140)] + [(200, 201), (201, 200), (7, 7)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    want = {n: 0 for n in range(51)} | {n: 100 for n in range(100, 140)} | {200: 200, 201: 200}
    assert got == want


def test_digest_of_kept_words(spark, table):
    from pyspark.sql import functions as F

    row = substring_dedup(table([(1, "a\tb\n c")])).select(F.sha2("kept_text", 256).alias("h")).first()
    assert row["h"] == hashlib.sha256(b"a b c").hexdigest()


def test_join_leaves_only_its_result_in_scratch(spark, table, prose):
    """Sets, tiles and links are as large as the texts; later stages must not find them on the disk."""
    text = prose(1, 60)
    with scratch_scope(spark) as folder:
        out = jaccard_components(table([(1, text), (2, text + " tail"), (3, prose(2, 60)), (4, None)]))
        left = [p for p in os.listdir(folder) if not p.startswith(".")]
        assert len(left) == 1 and spark.read.parquet(f"{folder}/{left[0]}").columns == out.columns
        assert found_components(out) == [(1, 56, 1), (2, 57, 1), (3, 56, 3), (4, 0, 4)]


def test_open_pairs_are_made_in_one_tile(table, prose, monkeypatch):
    """Sets that share many tiles meet once; the join must not make a pair again in each of them."""
    template, counted, plain = prose(5, 400), [], jaccard_join._meetings

    def meetings(*args):
        out = plain(*args)
        counted.append((out.count(), out.distinct().count()))
        return out

    rows = [(n, mixed(template, 5 * n, 9 + n % 8, prose)) for n in range(40)]
    want = brute_components(rows)
    monkeypatch.setattr(jaccard_join, "_meetings", meetings)
    for tiles in (jaccard_join.FIRST_TILES, 0):
        monkeypatch.setattr(jaccard_join, "FIRST_TILES", tiles)
        assert found_components(jaccard_components(table(rows), tile_block=7)) == want
    (once, pairs), (often, same) = counted
    assert 0 < once == pairs == same < often
