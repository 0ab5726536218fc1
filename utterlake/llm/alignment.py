"""Alignment of two tokenizers over the same bytes, by diagonal run skipping.

Both tokenizers cut ``" " + text`` into tokens; the tokens' byte ends are two ascending arrays. Where both
have an end, a group ends. The walk keeps an index into each array; their difference is the shift of the
diagonal. At a group border it probes slices of 1, 2, 4, ... ends at this shift: equal slices are
one-to-one tokens and are jumped at once; after the first unequal slice the probe is halved until it stands
at the first end that differs. There an irregular group is resolved locally: the array whose end lies
lower moves on until the ends meet, which also lists the token pairs that overlap; the shift is updated.
Slices are compared by sums of 64-bit hashes of their ends. Many walks run side by side in NumPy: the texts of
a slice of rows lie one after the other and are cut into lanes at blanks before which both tokenizers end.

How many documents hold a pair of ids linked is counted over the whole corpus. Texts are walked once: a text
keeps the numbers of its distinct pairs in the list of pairs of its block and how often it holds each, packed. The lists
of blocks are added up with map-side aggregation, and the counts of its own pairs go back to each block.
Tokens and links are never shuffled.

Null and empty texts, and texts that a tokenizer does not give back byte by byte (a text with the sign that
the second vocabulary writes for a blank), have no tokens: zeros and an empty digest. Repeated rows stay
rows and each counts as a document. An empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.llm.grams import mix
from utterlake.llm.packing import _byte_letters, _slices
from utterlake.llm.tables import lean, read
from utterlake.session import materialize

#: Bytes of text of a block, and of what is walked at once.
BLOCK_CHARS, SLICE_CHARS = 4_000_000, 500_000
#: A lane may begin at one of so many blanks.
LANE_BLANKS = 64
BLANK = "▁"
#: Fixed value: the pattern by which byte-level vocabularies of this kind part a text.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _spelled(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens one after the other, and how many each has."""
    return np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens], np.int64)


class ByteVocabulary:
    """A byte-level vocabulary in a ``tokenizers`` file; strings of special tokens are plain text.

    If ids follow the order of merges, they are ranks and a faster encoder gives the same ids. Tables are
    made where the object is made; a task that gets it opens the encoder only.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as file:
            about = json.load(file)
        byte = {letter: value for value, letter in _byte_letters().items()}
        plain, added = about["model"]["vocab"], {t["content"]: t["id"] for t in about["added_tokens"]}
        tokens = [b""] * (1 + max(*plain.values(), *added.values()))
        for name, n in (plain | added).items():
            tokens[n] = bytes(byte.get(c, 63) for c in name)
        self.flat, self.size = _spelled(tokens)
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in about["model"]["merges"]]
        cut = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        known = {name: n for name, n in plain.items() if name not in added}
        ordered = len(known) == 256 + len(merges) and all(known.get(m) == 256 + n for n, m in enumerate(merges))
        ranks = ordered and about["pre_tokenizer"] == cut and not about["normalizer"]
        self.ranks = {tokens[n]: n for n in known.values()} if ranks else None

    def open(self):
        if self.ranks is not None:
            import tiktoken

            encoder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
            return lambda texts: [encoder.encode_to_numpy(t, allowed_special=set(), disallowed_special=()) for t in texts]
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(self.path)
        model.encode_special_tokens = True
        return lambda texts: [code.ids for code in model.encode_batch(texts, add_special_tokens=False)]


class PieceVocabulary:
    """A ``sentencepiece`` model, which puts a blank before a text itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.path = path
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        numbers = list(range(model.get_piece_size()))
        single = [model.is_byte(n) for n in numbers]
        pieces = zip(model.id_to_piece(numbers), single, strict=True)
        self.flat, self.size = _spelled([bytes([int(p[3:-1], 16)]) if byte else p.replace(BLANK, " ").encode() for p, byte in pieces])

    def open(self):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return lambda texts: model.encode([t[1:] for t in texts], num_threads=1)


def _ranges(begin: np.ndarray, size: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The places ``begin[p]`` to ``begin[p] + size[p]`` of all picked ranges, one after the other."""
    count = size[pick]
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(begin[pick], count)


def lane_starts(data: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers at which lanes begin, and the numbers of tokens: places behind which both tokenizers begin a token."""
    blanks = np.flatnonzero((data[1:] == 32) & (data[:-1] != 32))[::LANE_BLANKS] + 1
    at_a, at_b = np.searchsorted(ends_a, blanks), np.searchsorted(ends_b, blanks)
    both = (ends_a[np.minimum(at_a, len(ends_a) - 1)] == blanks) & (ends_b[np.minimum(at_b, len(ends_b) - 1)] == blanks) if len(blanks) else np.zeros(0, bool)
    return tuple(np.concatenate([[0], at[both] + 1, [len(ends)]]) for at, ends in ((at_a, ends_a), (at_b, ends_b)))


def diagonal_runs(a: np.ndarray, b: np.ndarray, lanes_a: np.ndarray, lanes_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ends of groups as indices into ``a`` and ``b`` (one beyond the last token), and the linked tokens of both, in no order.

    ``a`` and ``b`` are ascending ends; lane n goes from ``lanes_a[n]`` and ``lanes_b[n]`` to those of n + 1, where both have the same end.
    """
    sum_a, sum_b = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x.astype(np.uint64)), dtype=np.uint64)]) for x in (a, b))
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    link_a, link_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    i, j, stop_i, stop_j = lanes_a[:-1].copy(), lanes_b[:-1].copy(), lanes_a[1:], lanes_b[1:]

    def jump(x, y, step, some, stop):
        """Moves lanes ``some`` on by their step where the slices are equal; tells which."""
        size = np.minimum(step[some], stop[some])
        at, to = x[some], y[some]
        same = (size > 0) & (sum_a[at + size] - sum_a[at] == sum_b[to + size] - sum_b[to])
        moved = some[same]
        x[moved] += size[same]
        y[moved] += size[same]
        stop[moved] -= size[same]
        return moved

    live = np.flatnonzero(i < stop_i)
    while len(live):
        x, y = i[live], j[live]
        begin, shift, room = x.copy(), y - x, np.minimum(stop_i[live] - x, stop_j[live] - y)
        step = np.ones(len(live), np.int64)
        probe = np.arange(len(live))
        while len(probe):
            probe = jump(x, y, step, probe, room)
            step[probe] *= 2
        probe = np.flatnonzero(step > 1)
        while len(probe):
            step[probe] //= 2
            jump(x, y, step, probe, room)
            probe = probe[step[probe] > 1]
        token = _ranges(begin, x - begin, np.arange(len(live)))
        other = token + np.repeat(shift, x - begin)
        last_a[token] = last_b[other] = True
        link_a.append(token)
        link_b.append(other)
        on = np.flatnonzero(x < stop_i[live])
        p, q = x[on], y[on]
        apart = np.arange(len(on))
        while len(apart):
            link_a.append(p[apart])
            link_b.append(q[apart])
            low, high = a[p[apart]], b[q[apart]]
            apart, behind = apart[low != high], (low < high)[low != high]
            p[apart] += behind
            q[apart] += ~behind
        last_a[p] = last_b[q] = True
        x[on], y[on] = p + 1, q + 1
        i[live], j[live] = x, y
        live = live[x < stop_i[live]]
    return np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1, np.concatenate(link_a), np.concatenate(link_b)


class Aligned:
    """The alignment of a column of texts: ids, groups and links of all texts one after the other."""

    def __init__(self, column, first: tuple, second: tuple) -> None:
        texts = [" " + (t or "") for t in column.to_pylist()]
        sides, size = [], np.array([len(t.encode()) for t in texts], np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        whole = size > 1
        for vocabulary, encode in (first, second):
            lists = encode(texts)
            count = np.array([len(x) for x in lists], np.int64)
            if lists and isinstance(lists[0], np.ndarray):
                ids = np.concatenate(lists).astype(np.int64)
            else:
                ids = np.fromiter(chain.from_iterable(lists), np.int64, int(count.sum()))
            token_at = np.concatenate([[0], np.cumsum(count)])
            bytes_at = np.concatenate([[0], np.cumsum(vocabulary.size[ids])])[token_at]
            # A text counts if its tokens spell it byte by byte.
            spelled = vocabulary.flat[_ranges(np.cumsum(vocabulary.size) - vocabulary.size, vocabulary.size, ids)]
            for r in np.flatnonzero(whole).tolist():
                whole[r] = np.array_equal(spelled[bytes_at[r] : bytes_at[r + 1]], data[at[r] : at[r + 1]])
            sides.append((ids, count, vocabulary.size))
        self.ids, self.at, ends = [], [], []
        for ids, count, length in sides:
            self.ids.append(ids[np.repeat(whole, count)])
            self.at.append(np.concatenate([[0], np.cumsum(np.where(whole, count, 0))]))
            ends.append(np.cumsum(length[self.ids[-1]]))
        lanes = lane_starts(data[np.repeat(whole, size)], *ends)
        self.ends_a, self.ends_b, self.link_a, self.link_b = diagonal_runs(*ends, *lanes)
        self.text = np.repeat(np.arange(len(whole)), np.diff(self.at[0]))[self.link_a]
        self.group_at = np.searchsorted(self.ends_a, self.at[0], "right")

    def pairs(self, width: int) -> np.ndarray:
        """The pair of ids of each link as one number."""
        return self.ids[0][self.link_a] * width + self.ids[1][self.link_b]

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The groups spelled ``a1,a2|b1;a3|b2,b3`` as bytes with offsets of each text; a mark follows each text."""
        size_a, size_b = np.diff(self.ends_a, prepend=0), np.diff(self.ends_b, prepend=0)
        group = np.arange(len(size_a))
        place_a = np.arange(len(self.ids[0])) + np.repeat(self.ends_b - size_b, size_a)
        place_b = np.arange(len(self.ids[1])) + np.repeat(self.ends_a, size_b)
        ids = np.empty(len(place_a) + len(place_b), np.int64)
        ids[place_a], ids[place_b] = self.ids[0], self.ids[1]
        marks = np.full(len(ids), ord(","), np.uint8)
        marks[place_a[self.ends_a[group] - 1]] = ord("|")
        marks[place_b[self.ends_b[group] - 1]] = ord(";")
        digits = np.ones(len(ids), np.int64)
        for n in range(1, 10):
            digits += ids >= 10**n
        begin = np.cumsum(digits + 1) - digits - 1
        out = np.empty(int((digits + 1).sum()), np.uint8)
        out[begin + digits] = marks
        left = ids.copy()
        for n in range(int(digits.max(initial=1))):
            own = digits > n
            out[(begin + digits - 1 - n)[own]] = 48 + (left % 10)[own]
            left //= 10
        return out, np.append(begin, len(out))[self.at[0] + self.at[1]]


def packed(codes: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending numbers and how often each occurs: differences and counts, their bytes by place, compressed."""
    rows = np.stack([np.diff(codes, prepend=0), times]).astype("<u4")
    return zlib.compress(np.ascontiguousarray(rows.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(value: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.ascontiguousarray(np.frombuffer(zlib.decompress(value), np.uint8).reshape(4, -1).T).reshape(-1).view("<u4").astype(np.int64).reshape(2, -1)
    return np.cumsum(rows[0]), rows[1]


TEXT_FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def block_schema(with_groups: bool) -> str:
    figures = ", ".join(f"{n} long" for n in ("block", "doc_id", *TEXT_FIGURES))
    return f"{figures}, groups_sha256 string, links binary, a array<int>, b array<int>, n array<long>" + (", groups string" if with_groups else "")


def walked(byte_level: ByteVocabulary, by_piece: PieceVocabulary, with_groups: bool):
    """A row for each text with its figures and packed pairs, and one for each block with its pairs ``a, b`` and how many texts hold each."""
    width = len(by_piece.size)

    def block_rows(block: int, table):
        columns: dict[str, list] = {n: [] for n in ("doc_id", *TEXT_FIGURES, "groups_sha256", "groups")}
        names, held = [np.zeros(0, np.int64)], []
        for low, high in _slices(table, SLICE_CHARS):
            part = table.slice(low, high - low)
            aligned = Aligned(part.column("text"), *opened)
            rows = part.num_rows
            own, code = np.unique(aligned.pairs(width), return_inverse=True)
            once, times = np.unique(aligned.text * max(len(own), 1) + code, return_counts=True)
            names.append(own)
            held.append((once // max(len(own), 1), once % max(len(own), 1), times, rows))
            spelled, at = aligned.groups()
            view = memoryview(spelled)
            texts = [bytes(view[i : max(i, j - 1)]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            columns["doc_id"] += part.column("doc_id").to_pylist()
            for name, values in zip(TEXT_FIGURES, (np.diff(aligned.at[0]), np.diff(aligned.at[1]), np.diff(aligned.group_at), np.bincount(aligned.text, minlength=rows)), strict=True):
                columns[name] += values.tolist()
            columns["groups_sha256"] += [hashlib.sha256(t).hexdigest() if t else "" for t in texts]
            if with_groups:
                columns["groups"] += [t.decode() for t in texts]
        pairs = np.unique(np.concatenate(names))
        n, links = np.zeros(len(pairs), np.int64), []
        for own, (text, code, times, rows) in zip(names[1:], held, strict=True):
            number = np.searchsorted(pairs, own)[code]
            n += np.bincount(number, minlength=len(pairs))
            cut = np.searchsorted(text, np.arange(rows + 1)).tolist()
            links += [packed(number[i:j], times[i:j]) if j > i else None for i, j in zip(cut, cut[1:], strict=False)]
        texts = len(links)
        nothing = [None] * texts
        out = {"block": [block] * (texts + 1)} | {k: [*v, None] for k, v in columns.items() if k != "groups"}
        out |= {"links": [*links, None], "a": [*nothing, (pairs // width).astype(np.int32)], "b": [*nothing, (pairs % width).astype(np.int32)], "n": [*nothing, n]}
        if with_groups:
            out["groups"] = [*columns["groups"], None]
        kinds = {"groups_sha256": pa.string(), "groups": pa.string(), "links": pa.binary(), "a": pa.list_(pa.int32()), "b": pa.list_(pa.int32()), "n": pa.list_(pa.int64())}
        return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], names=list(out))

    opened: list[tuple] = []

    def run(batches):
        opened[:] = [(v, v.open()) for v in (byte_level, by_piece)]
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for low, high in _slices(batch, BLOCK_CHARS):
                yield block_rows(number, batch.slice(low, high - low))
                number += 1

    return run


def counted(with_groups: bool):
    """Figures of each text of a block, from the corpus-wide counts of the block's pairs, which stand in ascending order."""

    def run(key, table, counts):
        a, b = counts.column("a").to_numpy(), counts.column("b").to_numpy()
        order = np.lexsort((b, a))
        number, best = counts.column("n").to_numpy()[order], counts.column("best").to_numpy(zero_copy_only=False)[order]
        most, total = [], []
        for links in table.column("links").to_pylist():
            code, times = unpacked(links) if links else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            most.append(int(times[best[code]].sum()))
            total.append(int((times * number[code]).sum()))
        columns = {n: table.column(n) for n in ("doc_id", *TEXT_FIGURES)}
        columns |= {"n_best": pa.array(most, pa.int64()), "count_sum": pa.array(total, pa.int64())}
        columns |= {n: table.column(n) for n in ("groups_sha256", *(["groups"] if with_groups else []))}
        return pa.table(columns)

    return run


def pair_counts(held: DataFrame) -> DataFrame:
    """``a, b, n, best`` from ``a, b, n`` of blocks: the corpus-wide count of each pair, and whether it is the highest of its ``a``."""
    counts = held.groupBy("a", "b").agg(F.sum("n").alias("n"))
    most = counts.groupBy("a").agg(F.max("n").alias("_most"))
    return counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("_most")).alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` (and ``groups``) of every text.

    ``path_a`` names a byte-level ``tokenizers`` file, ``path_b`` a ``sentencepiece`` model.
    """
    both = ByteVocabulary(path_a), PieceVocabulary(path_b)
    rows = materialize(lean(docs).mapInArrow(walked(*both, with_groups), block_schema(with_groups)), "walked")
    zipped = rows.where("a IS NOT NULL").select("block", F.explode(F.arrays_zip("a", "b", "n")).alias("p"))
    held = zipped.select(F.col("block").alias("holder"), "p.a", "p.b", "p.n")
    counts = materialize(pair_counts(held.select("a", "b", "n")), "pair-counts")
    known = held.select("holder", "a", "b").join(counts, ["a", "b"])
    texts = rows.where("a IS NULL").drop("a", "b", "n")
    numbers = ", ".join(f"{n} long" for n in ("doc_id", *TEXT_FIGURES, "n_best", "count_sum"))
    schema = f"{numbers}, groups_sha256 string" + (", groups string" if with_groups else "")
    return texts.groupBy("block").cogroup(known.groupBy("holder")).applyInArrow(counted(with_groups), schema)


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(read(spark, sf_dir, "documents"), *vocabularies())
