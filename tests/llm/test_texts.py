"""Rules, fingerprints, packing, personal data and sampling beside brute force and round trips."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from utterlake.llm import fingerprints as fp
from utterlake.llm import packing as pk
from utterlake.llm import pii
from utterlake.llm import quality_rules as qr
from utterlake.llm import sentencepiece_sampling as sp
from utterlake.llm import url_filters as uf

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Quality rules.


def brute_repeats(words, size=8):
    grams = [tuple(words[n : n + size]) for n in range(len(words) - size + 1)]
    counts = collections.Counter(grams)
    return len({n + k for n, g in enumerate(grams) if counts[g] > 1 for k in range(size)})


def test_counts_of_rules(table, prose, edge_rows):
    extra = [(30, prose(5, 30) + "\n" + prose(5, 30)), (31, "the cat\nthe cat\n \nthe dog\nthe cat"), (32, "a b c d e f g h " * 2 + "x"), (33, "#$ %& ok")]
    rows = edge_rows + extra
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in qr.quality_rules(table(rows)).collect()), key=str)
    want = []
    for key, text in rows:
        words = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        repeats = brute_repeats(words)
        want.append((key, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeats, len(words) < 20 or 100 * repeats > 30 * len(words)))
    assert got == sorted(want, key=str)


def test_rules_table(table, prose):
    good = "the " + prose(1, 60) + " of the and to in the is it on"
    rows = [(1, good), (2, good.upper()), (3, re.sub(r"(\w+)", r"\1###", good)), (4, "zq " + " ".join(f"zxq{n}v" for n in range(60))), (5, None)]
    kept = {r["doc_id"]: r["kept"] for r in qr.quality_rules(table(rows)).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert qr.quality_rules(table([])).count() == 0
    assert {r["kept"] for r in qr.quality_rules(table(rows), [("any", "n_words", 0, None)]).where("doc_id < 5").collect()} == {True}
    with pytest.raises(ValueError):
        qr.compile_rules([("x", "unknown", 1, None)], {})


# Fingerprints.


def brute_winnow(text, k=fp.GRAM, w=fp.WINDOW):
    hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in WORD.findall(text.lower())]
    if not hashes:
        return []
    runs = []
    for n in range(max(1, len(hashes) - k + 1)):
        h = 42
        for value in hashes[n : n + k]:
            h = xxhash.xxh64(value.to_bytes(8, "little"), seed=h).intdigest()
        runs.append(h)
    out = []
    for n in range(max(1, len(runs) - w + 1)):
        window = runs[n : n + w]
        least = min(h >> 31 for h in window)
        place = max(i for i, h in enumerate(window) if h >> 31 == least) + n
        if not out or out[-1][1] != place:
            out.append((runs[place], place))
    return out


def test_winnowing_equals_brute_force(table, prose, edge_rows):
    rows = [r for r in edge_rows if r[0] is not None] + [(n, prose(n, n)) for n in range(20, 50)]
    for r in fp.fingerprint(table(rows)).collect():
        got = [(f["hash"] % (1 << 64), f["place"]) for f in r["fingerprint"]]
        assert got == brute_winnow(r["text"]), r["doc_id"]


def test_shared_passages_share_a_hash(table, prose):
    passage = prose(70, fp.GRAM + fp.WINDOW - 1)
    rows = [(1, prose(71, 40) + " " + passage + " " + prose(72, 9)), (2, passage + " " + prose(73, 50))]
    a, b = [{f["hash"] for f in r["fingerprint"]} for r in fp.fingerprint(table(rows)).collect()]
    assert a & b


@pytest.mark.parametrize("ranges", [1, 7])
def test_each_document_meets_the_next(table, ranges, edge_rows):
    rows = [r for r in edge_rows if r[0] != 6] + [(n, f"text {n}") for n in range(100, 160, 3)]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = sorted([(a[0], a[1] or "", b[1] or "") for a, b in zip(ordered, ordered[1:] + ordered[:1], strict=True)], key=str)
    got = fp.with_next(table(rows), ranges).select("doc_id", "text", "next_text").collect()
    assert sorted([tuple(r) for r in got], key=str) == want
    assert fp.with_next(table([]), ranges).count() == 0


def test_edited_text_and_likeness(spark):
    df = spark.createDataFrame([("abcdefgh", "XYZ"), ("abc", "q"), ("éééé", ""), ("", "a")], "text string, next_text string")
    assert [r[0] for r in df.select(fp.edited()).collect()] == ["abcdefXY", "abc", "ééé", ""]
    a, b, none = F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)), F.array().cast("array<int>")
    row = spark.range(1).select(fp.likeness(a, b), fp.likeness(a, a), fp.likeness(none, none), fp.likeness(a, none)).first()
    assert list(row) == [1 / 3, 1.0, 1.0, 0.0]


# Packing.


def test_ids_equal_the_tokenizer(edge_rows, prose):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(pk.vocabulary())
    texts = [t for _, t in edge_rows] + ["Don't x). É! ok(.). 12.5% a<|endoftext|>. $$ #x 3d.", "ΑΣ ΑΣ. ﬁ é́ — —. ’.", "A.B.C. ..a.. İstanbul", "\x00 \x85 ​"]
    ids, at = pk.text_ids(tokenizer, pa.array(texts), 1)
    for n, text in enumerate(texts):
        assert ids[at[n] : at[n + 1]].tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check_places(pieces, capacity):
    """Every sequence is gapless from 0 and not above the capacity."""
    places = collections.defaultdict(list)
    for p in pieces:
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_packed_documents(spark, table, edge_rows):
    rows = edge_rows + [(n, "word " * (n % 70)) for n in range(100, 300)]
    packed = pk.pack_documents(table(rows), pk.vocabulary(), capacity=64, with_ids=True).cache()
    pieces = packed.collect()
    n = check_places(pieces, 64)
    assert n <= math.ceil(sum(p["length"] for p in pieces) / 64) * 1.05 + 1
    for p in pieces:
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] and len(p["ids"]) == p["length"]
        assert p["start"] == 64 * p["piece"]
    long = sorted((p for p in pieces if p["doc_id"] == 8), key=lambda p: p["piece"])
    assert all(p["length"] == 64 for p in long[:-1])
    assert sum(p["length"] for p in pieces if p["doc_id"] == 6) % 2 == 0
    built = {r["sequence_id"]: r["ids"] for r in pk.sequences(packed).collect()}
    for p in pieces:
        assert built[p["sequence_id"]][p["offset"] : p["offset"] + p["length"]] == p["ids"]
    assert pk.pack_documents(table([]), pk.vocabulary()).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_are_gapless_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([30, 100, 4096])
    lengths = [rng.choice([capacity, rng.randint(1, capacity), rng.randint(1, max(1, capacity // 4))]) for _ in range(800)]
    counts = collections.Counter(lengths)
    rows, n = pk.packing_plan(counts, capacity)
    taken, pieces = collections.Counter(), []
    for length, low, high, base, offset in rows:
        assert low == taken[length]
        taken[length] = high
        pieces += [{"sequence_id": base + k, "offset": offset, "length": length} for k in range(high - low)]
    assert taken == counts and check_places(pieces, capacity) == n
    large = sum(c for length, c in counts.items() if 2 * length > capacity)
    assert n <= max(large, math.ceil(sum(lengths) / capacity)) * 1.1 + 2
    thirds = collections.Counter(p["sequence_id"] for p in pieces if 3 * p["length"] > capacity)
    assert max(thirds.values(), default=0) <= 2


# Personal data.

KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute_base(text):
    out = []
    for kind, pattern in KINDS:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


PERSONAL = [
    "mail a.b+c@x-y.example.com, or x@y",
    "a@b.c_d@e.f a@@b.co @c.de",
    "1.2.3.4.5 1.2.3.256 001.002.003.004 9.9.9.9",
    "4111 1111 1111 1111 and 4111111111111112 or 5500-0000-0000-0004",
    "+1 (555) 555-0123 +44 20 7946 0958 +1+2 +12 3",
    "é +1 (555) 555-0123 10.0.0.1",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"',
]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    texts = PERSONAL + ["".join(rng.choices("0123456789.+-() @ab", k=60)) for _ in range(3000)] + ["1" * 50_000, "a" * 50_000 + "@b.c", "+1" * 2000]
    for text in texts:
        assert pii.base_spans(text) == brute_base(text), text[:80]


def test_added_spans_and_redaction(table, prose, edge_rows):
    rng = random.Random(4)
    rows = list(edge_rows)
    for n in range(400):
        digits = "".join(rng.choices("0123456789abcdef", k=40))
        kind = [f"a{n}@mail.example.com", f"10.{n % 256}.3.4", "4111 1111 1111 1111", f"+1 (555) 555-{n:04d}", f'token = "{digits}"', f"{n} 12"][n % 6]
        rows.append((100 + n, prose(n, 12) + " " + kind + " " + prose(n + 1, 5)))
    docs = table(rows)
    model = pii.fit_pii(docs)
    found = pii.find_pii(docs, model).collect()
    assert len(found) == len(rows)
    texts = collections.defaultdict(list)
    for key, text in rows:
        texts[key].append(text)
    kinds = collections.Counter()
    for r in found:
        text = texts[r["doc_id"]][0]
        base = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]]
        assert r["doc_id"] is None or base == brute_base(text or "")
        kinds.update(s["kind"] for s in r["spans"])
        assert r["redacted"] is None or not any(brute_base(r["redacted"]))
    assert kinds["secret"] >= 60 and kinds["email"] >= 66
    assert pii.redacted("ab cd ef", [("x", 0, 4), ("y", 3, 5), ("z", 6, 8)]) == "[x] [z]"
    assert model.spans(None) == [] and model.redact(None) is None


def test_formats_that_the_base_patterns_miss(table, prose):
    rng = random.Random(8)
    rows = []
    for n in range(600):
        number = "".join(rng.choices("0123456789", k=15))
        number += next(d for d in "0123456789" if pii.luhn(number + d))
        kind = [f"a{n}@mail{n % 9}.example.com", f"10.{n % 256}.3.4", number, f"+1 ({rng.randint(200, 999)}) 555-{n:04d}", f"{n} 12", f"{rng.randint(10**7, 10**9)}"][n % 6]
        rows.append((n, prose(n, 12) + " " + kind + " " + prose(n + 1, 5)))
    model = pii.fit_pii(table(rows))
    planted = [
        ("phone", "555-123-4567"),
        ("phone", "(555) 123-4567"),
        ("phone", "555 123 4567"),
        ("phone", "555.123.4567"),
        ("email", "joe@intranet"),
        ("card", "4111 - 1111 - 1111 - 1112"),
    ]
    for kind, body in planted:
        for n in range(3):
            before = prose(900 + n, 8) + " "
            text = before + body + " " + prose(950 + n, 8)
            assert pii.base_spans(text) == []
            assert [s[:3] for s in model.spans(text)] == [(kind, len(before), len(before) + len(body))], text
    for body in ("12", "1984", "12345678", "in 1999 2000 and"):
        assert model.spans(prose(990, 8) + " " + body + " " + prose(991, 8)) == []


def test_labels_from_context_and_format():
    def label(text, kind, body):
        a = text.index(body)
        return pii.weak_label(text, (kind, a, a + len(body)), set(pii.base_spans(text)))

    assert label("tel: 555-123-4567 x", "phone", "555-123-4567") == 1
    assert label("tel (555) 123-4567 x", "phone", "(555) 123-4567") == 1
    assert label("mail joe@host x", "email", "joe@host") == 1
    assert label("see 555-123-4567 x", "phone", "555-123-4567") is None
    assert label("x +1 (555) 555-0123 y", "phone", "(555) 555-0123") == 0
    assert label("x +1 (555) 555-0123 y", "phone", "+1 (555) 555-0123") == 1


def test_personal_data_of_no_documents(table):
    model = pii.fit_pii(table([]))
    assert pii.find_pii(table([]), model).count() == 0
    assert [s[:3] for s in model.spans("a@b.cd")] == [("email", 0, 6)]


def test_written_spans(spark):
    df = spark.createDataFrame([([("email", 3, 9, 1.0, True), ("ip", 1, 2, 1.0, False)],)], f"spans {pii.SPAN}")
    assert df.select(pii.written(F.col("spans"))).first()[0] == "email:3:9,ip:1:2"


# SentencePiece sampling.


def segmentations(pieces, data):
    if not data:
        return [()]
    fit = [n for n, p in enumerate(pieces.bytes) if n > 258 and p and data.startswith(p) and b" " not in p[1:]]
    return [(n, *rest) for n in fit for rest in segmentations(pieces, data[len(pieces.bytes[n]) :])]


def test_samples_follow_the_distribution():
    path = sp.vocabulary()
    pieces = sp.load_pieces(path)
    n, text = 3000, "inter on"
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array([text] * n)})
    rows = [r for b in sp.sample_rows(pieces, 3, 5)([batch]) for r in b.to_pylist()]
    ways = [a + b for a in segmentations(pieces, b" inter") for b in segmentations(pieces, b" on")]
    weight = np.array([sum(pieces.weight[i] for i in w) for w in ways])
    p = dict(zip(ways, np.exp(weight - np.logaddexp.reduce(weight)), strict=True))
    first = collections.Counter(tuple(r["ids"]) for r in rows if r["sample"] == 0)
    assert max(abs(first[w] / n - p[w]) for w in ways) < 0.04
    by_key, total = collections.defaultdict(list), 0.0
    for r in rows:
        by_key[r["doc_id"]].append((r["score"], tuple(r["ids"])))
        assert abs(math.exp(r["log_probability"]) - p[tuple(r["ids"])]) < 1e-9
        total += math.exp(r["log_probability"] - r["log_inclusion"]) / n
    assert all(len({ids for _, ids in own}) == 3 and own == sorted(own, reverse=True) for own in by_key.values())
    assert abs(total - 1) < 0.02  # weights by inclusion probability are unbiased


def all_segmentations(pieces, data):
    if not data:
        return [()]
    fit = [n for n, p in enumerate(pieces.bytes) if n > 258 and p and data.startswith(p)]
    return [(n, *rest) for n in fit for rest in all_segmentations(pieces, data[len(pieces.bytes[n]) :])]


@pytest.mark.parametrize("text", ["a   b", "  in", "on  ", "in    a", "     "])
def test_runs_of_blanks_equal_the_whole_vocabulary(text):
    path = sp.vocabulary()
    pieces = sp.load_pieces(path)
    ways = all_segmentations(pieces, b" " + text.encode())
    weight = np.array([sum(pieces.weight[i] for i in w) for w in ways])
    p = dict(zip(ways, np.exp(weight - np.logaddexp.reduce(weight)), strict=True))
    assert any(b"  " in pieces.bytes[i] for w in ways for i in w)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, 3], pa.int64()), "text": pa.array(["x ", text, "  y"])})
    rows = [r for b in sp.sample_rows(pieces, len(ways) + 1, 5)([batch]) for r in b.to_pylist() if r["doc_id"] == 2]
    assert {tuple(r["ids"]) for r in rows} == set(ways) and len(rows) == len(ways)
    assert all(abs(math.exp(r["log_probability"]) - p[tuple(r["ids"])]) < 1e-9 and r["log_inclusion"] == 0 for r in rows)


def test_round_trip_and_seeds(spark, table, edge_rows):
    docs = table(edge_rows + [(11, "  two  blanks ☃\r\n\ttab"), (12, "x")])
    path = sp.vocabulary()
    found = sp.sample_encodings(docs, path)
    spelled = {(r["doc_id"], r["text"]) for r in sp.decode(found, path).collect()}
    want = {(k, t or "") for k, t in [*edge_rows, (11, "  two  blanks ☃\r\n\ttab"), (12, "x")]}
    assert spelled == want
    again = sp.sample_encodings(docs.repartition(5), path)
    one, two = [sorted((str(r["doc_id"]), r["sample"], r["ids"]) for r in d.collect()) for d in (found, again)]
    assert one == two
    assert sp.sample_encodings(table([]), path).count() == 0
    counts = collections.Counter(r["doc_id"] for r in found.collect())
    assert counts[1] == counts[2] == 1 and counts[5] == 2 and counts[6] == 4


def test_decoding_equals_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sp.vocabulary())
    texts = ["Hello wörld", " a  b\n", "日本 ☃", ""]
    lists = spark.createDataFrame([(n, model.encode(t)) for n, t in enumerate(texts)], "doc_id bigint, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in sp.decode(lists, sp.vocabulary()).collect()} == dict(enumerate(texts))


# URL filters.


def test_entries_hold_from_their_day(spark):
    entries = spark.createDataFrame(
        [
            ("bad.example.com", "block", "2024-02-01"),
            ("bad.example.com", "remove", "2024-03-01"),
            ("bad.example.com/ok", "allow", "2024-02-10"),
            ("tie.example.com", "allow", "2024-02-01"),
            ("tie.example.com", "block", "2024-02-01"),
            (None, "block", "2024-01-01"),
            ("null.example.com", None, "2024-01-01"),
        ],
        "pattern string, action string, since string",
    )
    cases = [
        (1, "https://bad.example.com/x", "2024-01-31", True),
        (2, "https://www.bad.example.com:80/x?q", "2024-02-01", False),
        (3, "https://bad.example.com/x", "2024-03-01", True),
        (4, "http://bad.example.com/ok/deep#top", "2024-02-20", True),
        (5, "http://bad.example.com/okay", "2024-02-20", False),
        (6, "http://tie.example.com", "2024-02-20", True),
        (7, None, "2024-02-20", True),
        (8, "no url", "2024-02-20", True),
        (9, "http://notbad.example.com/", "2024-02-20", True),
        (10, "http://BAD.example.com./", None, True),
        (2, "https://www.bad.example.com:80/x?q", "2024-02-01", False),
    ]
    captures = spark.createDataFrame([c[:3] for c in cases], "page_id bigint, url string, fetched string").withColumn("host", F.lit(1)).withColumn("pattern", F.lit(2))
    got = sorted((r["page_id"], r["kept"]) for r in uf.url_filter(captures, entries).collect())
    assert got == sorted((c[0], c[3]) for c in cases)
    assert uf.url_filter(captures.limit(0), entries).count() == 0
    assert uf.url_filter(captures, entries.limit(0)).where("NOT kept").count() == 0


def test_words_met_often_are_built_once(prose, monkeypatch):
    """Clearing the kept lattices leaves the words that come again, and changes no sample."""
    import pyarrow as pa

    pieces = sp.load_pieces(sp.vocabulary())
    rows = pa.record_batch({"doc_id": list(range(60)), "text": ["again and again " + prose(3000 + n, 40) for n in range(60)]})
    plain, built = sp.Lattice, []

    def lattice(pieces, data, at):
        built.extend(data[a:b].tobytes() for a, b in zip(at, at[1:], strict=False))
        return plain(pieces, data, at)

    monkeypatch.setattr(sp, "Lattice", lattice)
    monkeypatch.setattr(sp, "SLICE_CHARS", 600)
    wanted = [b.to_pylist() for b in sp.sample_rows(pieces, 2, 20)([rows])]
    assert built.count(b" again") == 1
    built.clear()
    monkeypatch.setattr(sp, "KEPT_BYTES", 1_500)
    assert [b.to_pylist() for b in sp.sample_rows(pieces, 2, 20)([rows])] == wanted
    assert built.count(b" again") == 1 and len(built) > len(set(built))


def test_known_words_stay_in_arrow_and_in_place(prose, monkeypatch):
    """Words are found as an Arrow array; clearing keeps the memory, and what is kept equals lattices built anew."""
    import pyarrow as pa

    pieces = sp.load_pieces(sp.vocabulary())
    monkeypatch.setattr(sp, "KEPT_BYTES", 400)
    known = sp.KnownWords(pieces)
    often = pa.array([b" again", " \u00e9t\u00e9".encode(), b" and"], pa.large_binary())
    for n in range(8):
        other = sorted({f" {word}{n}".encode() for word in prose(n, 30).split()})
        found = known.find(pa.concat_arrays([often, pa.array(other, pa.large_binary())]))
        assert len(set(found.tolist())) == len(often) + len(other)
        held = known.lattice.room.get("to")
        if n > 2:
            assert held is not None and np.shares_memory(held, known.lattice.to)
    again = known.find(often)
    assert known.words.take(pa.array(again)).to_pylist() == often.to_pylist()
    for place, word in zip(again.tolist(), often.to_pylist(), strict=True):
        one, kept = sp.Lattice(pieces, np.frombuffer(word, np.uint8), np.array([0, len(word)])), known.lattice
        low, high = kept.first[kept.base[place]], kept.first[kept.end[place] + 1]
        assert kept.piece[low:high].tolist() == one.piece.tolist()
        assert (kept.to[low:high] - kept.base[place]).tolist() == one.to.tolist()
        assert np.allclose(kept.log[low:high], one.log) and np.allclose(kept.rest[low:high], one.rest)
        # The last edge of each node takes every number that is left.
        assert np.isinf(one.key[one.first[1:][one.first[1:] > one.first[:-1]] - 1]).all()


def test_packing_holds_a_bounded_slice(prose):
    """Arrays of a few million characters, whatever the batch; smaller slices give the same pieces."""
    import tracemalloc

    import pyarrow as pa
    from utterlake.llm import packing

    text = prose(5, 5_000)
    rows = pa.record_batch({"doc_id": list(range(200)), "text": [text[n % 50 :] for n in range(200)]})
    tracemalloc.start()
    whole = pa.Table.from_batches(packing.piece_rows(packing.vocabulary(), 4096, 1, False)([rows]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) * 200 > 4_000_000 and peak < 60_000_000, peak
    parts = [rows.slice(n, 50) for n in range(0, 200, 50)]
    assert whole.to_pylist() == pa.Table.from_batches(packing.piece_rows(packing.vocabulary(), 4096, 1, False)(parts)).to_pylist()
