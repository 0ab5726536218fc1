"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents longer than the capacity are cut into pieces. Pieces above a third of the capacity share a
sequence with at most one other such piece: from the longest down, each meets the longest one that still
fits. Smaller pieces, from the longest down, go to the smallest gap that holds them; a new sequence is
opened only when no gap does.

How pieces are placed depends on their lengths alone, so the plan is made of counts per length: at most
``capacity`` rows come to the driver, whatever the number of documents, and pieces of one length move in
bulk. Ranks of pieces inside their length tell which of the planned places each piece takes; they are
counted over buckets, so a length that a third of all pieces have is split over many tasks.

Null and empty texts are one piece with the end token only. Repeated rows are packed each. An empty table
gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utterlake.llm.grams import _BLANK, Words
from utterlake.llm.tables import lean, read
from utterlake.session import materialize

CAPACITY = 4096
END_ID = 1
#: Characters of text that a worker holds as arrays at once.
SLICE_CHARS = 2_000_000


def _byte_letters() -> dict[int, str]:
    """The letters that a byte-level vocabulary writes for bytes: visible ones stand for themselves, others follow 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


def unit_ids(tokenizer, units: list[str]) -> list[list[int]]:
    """Ids of each string. Plain words go straight to the vocabulary, the rest through the whole tokenizer."""
    letters = _byte_letters()
    found: list = [None] * len(units)
    rest = []
    for n, unit in enumerate(units):
        if unit.isascii() and unit.isalpha():
            found[n] = [t.id for t in tokenizer.model.tokenize(unit)]
        elif unit.isalpha() and max(unit) < "ɐ" and unit == unit.lower():
            found[n] = [t.id for t in tokenizer.model.tokenize("".join(letters[b] for b in unit.encode()))]
        else:
            rest.append(n)
    for n, code in zip(rest, tokenizer.encode_batch([units[n] for n in rest], add_special_tokens=False), strict=True):
        found[n] = code.ids
    return found


def _units(words):
    """Words cut into a core and a tail of marks, in order: string array and the number of units of each word.

    The vocabulary drops blanks, lowers letters and never joins a letter or digit with a mark, so ids
    of a text are those of its units. A-Z are lowered first, which makes more units equal.
    """
    import numpy as np
    import pyarrow as pa

    data = words.data.copy()
    upper = (data >= 65) & (data <= 90)
    data[upper] += 32
    mark = np.zeros(256, bool)
    mark[list(b".,;:!?#$%&*")] = True
    plain = np.zeros(256, bool)
    plain[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
    cut = words.end.copy()
    alive = np.arange(len(words))
    while len(alive):
        alive = alive[(cut[alive] > words.start[alive]) & mark[data[cut[alive] - 1]]]
        cut[alive] -= 1
    split = (cut > words.start) & (cut < words.end)
    split &= plain[data[np.maximum(cut, 1) - 1]]
    cut = np.where(split, cut, words.end)
    ends = np.stack([cut, words.end], 1).reshape(-1)
    begins = np.stack([words.start, cut], 1).reshape(-1)
    kept = ends > begins
    lengths = (ends - begins)[kept]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    text = data[~_BLANK[data]]
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(text)), 1 + split.astype(np.int64)


def text_ids(tokenizer, column, end_id: int):
    """Ids of each text followed by ``end_id``, as one array with offsets."""
    import numpy as np

    words = Words(column)
    units, per_word = _units(words)
    coded = units.dictionary_encode()
    names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lists = unit_ids(tokenizer, names)
    size = np.array([len(x) for x in lists], np.int64)
    flat = np.fromiter((i for x in lists for i in x), np.uint32, int(size.sum()))
    begin = np.cumsum(size) - size
    count = size[code]
    ends = np.concatenate([[0], np.cumsum(count)])
    first_unit = np.concatenate([[0], np.cumsum(per_word)])[words.first]
    at = ends[first_unit] + np.arange(words.rows + 1)
    ids = np.full(int(at[-1]), end_id, np.uint32)
    body = np.ones(len(ids), bool)
    body[at[1:] - 1] = False
    ids[body] = flat[np.arange(int(ends[-1])) - np.repeat(ends[:-1], count) + np.repeat(begin[code], count)]
    return ids, at


def _slices(batch, chars: int):
    """Row ranges of a batch with about ``chars`` bytes of text each."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // chars
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def piece_rows(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for batch in batches:
            for low, high in _slices(batch, SLICE_CHARS):
                part = batch.slice(low, high - low)
                ids, at = text_ids(tokenizer, part.column("text"), end_id)
                pieces = -(-np.diff(at) // capacity)
                row = np.repeat(np.arange(len(pieces)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(np.diff(at)[row] - start, capacity)
                begin = at[row] + start
                bytes_ = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(bytes_[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
                columns = {
                    "doc_id": part.column("doc_id").take(pa.array(row)),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if wanted, the ``ids`` of each piece.

    ``path`` names a ``tokenizers`` file whose ids do not depend on blanks between words.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return lean(docs).mapInArrow(piece_rows(path, capacity, end_id, with_ids), schema)


def packing_plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places for ``counts[length]`` pieces: rows ``(length, from_rank, to_rank, sequence, offset)`` and the number of sequences.

    The piece of rank r in a row goes to sequence ``sequence + r - from_rank`` at ``offset``.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    taken: dict[int, int] = defaultdict(int)
    rows: list[tuple[int, int, int, int, int]] = []
    opened = 0
    gaps: list[int] = []
    bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, how many)

    def free(gap: int, base: int, many: int) -> None:
        if gap and many:
            if not bins[gap]:
                insort(gaps, gap)
            bins[gap].append((base, many))

    def place(length: int, many: int, base: int, offset: int) -> None:
        rows.append((length, taken[length], taken[length] + many, base, offset))
        taken[length] += many
        left[length] -= many

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        length = large[-1]
        if not left[length]:
            large.pop()
            continue
        while large and not left[large[0]]:
            large.pop(0)
        at = bisect_left(large, capacity - length + 1) - 1
        while at >= 0 and (not left[large[at]] or (large[at] == length and left[length] < 2)):
            at -= 1
        if at < 0:
            many = left[length]
            place(length, many, opened, 0)
            free(capacity - length, opened, many)
        else:
            other = large[at]
            many = left[length] // 2 if other == length else min(left[length], left[other])
            place(length, many, opened, 0)
            place(other, many, opened, length)
            free(capacity - length - other, opened, many)
        opened += many
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                many = -(-left[length] // (capacity // length))
                free(capacity, opened, many)
                opened += many
                continue
            gap = gaps[at]
            base, many = bins[gap].pop()
            if not bins[gap]:
                gaps.pop(at)
            used = min(many, left[length])
            place(length, used, base, capacity - gap)
            free(gap - length, base, used)
            free(gap, base + used, many - used)
    return rows, opened


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table with ``doc_id, piece, length``) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")
    held = pieces.groupBy("length", bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    held = materialize(held, "length-counts")
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    rows, _ = packing_plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("_bucket", bucket).withColumn("_row", F.row_number().over(inside) - 1)
    ranked = ranked.join(starts, ["length", "_bucket"]).withColumn("_rank", F.col("_start") + F.col("_row"))
    plan = spark.createDataFrame(rows, "length long, _from long, _to long, _base long, offset long")
    # The plan has rows for lengths and gaps only, both below the capacity, so it may be sent to all tasks.
    placed = ranked.join(F.broadcast(plan), "length").where("_rank >= _from AND _rank < _to")
    return placed.withColumn("sequence_id", F.col("_base") + F.col("_rank") - F.col("_from")).select(*pieces.columns, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the pieces of each sequence one after the other; a sequence holds ``capacity`` ids at most."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    return parts.select("sequence_id", F.flatten("_p.ids").alias("ids"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenise once, write the pieces, place them."""
    return pack(materialize(token_pieces(docs, path, capacity, end_id, with_ids), "pieces"), capacity)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(read(spark, sf_dir, "documents"), vocabulary())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
