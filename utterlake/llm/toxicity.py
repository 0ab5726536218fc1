"""Toxicity: a bidirectional gated recurrent network with attention pooling, scoring overlapping windows.

Words are runs of letters with A-Z lowered. Every text is cut into windows of ``LENGTH`` words, each half
over the one before, to its end; each window gets a logit from the network in ``gru``, and the highest one
makes the score of the text. The network is trained here, in NumPy, on a bounded sample of labelled
texts: all rows of the rarer class and as many times ``PER_POSITIVE`` of the other, at most ``SAMPLE``
of each, chosen by hash. A text's label holds for one of its windows: training takes the window
with the most telling words, then the one that the network itself rates highest, and leaves out positive
texts that it finds nothing in, as labels may be wrong. Near copies share their weight. Texts of the sample
are read whole, by Spark tasks: sums for each word and, in each round, two windows of each text come back.

Null and empty texts, and texts without letters, score as one empty window. Labels that are null are
ignored; without labels of both classes every score is the share of positives. Repeated rows are scored
one by one. An empty table gives an empty result. Columns named in ``keep`` are carried, others left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlake.llm import gru
from utterlake.llm.grams import Words, mix, runs
from utterlake.llm.packing import _slices
from utterlake.llm.quality_classifier import held_out
from utterlake.llm.tables import lean, read
from utterlake.session import materialize

LENGTH = 24
STRIDE = LENGTH // 2
#: Labelled texts of each class to learn from, at most.
SAMPLE = 3000
PER_POSITIVE = 3
#: Texts of the sample that must hold a word before it gets a vector of its own.
LEAST_TEXTS = 5
#: Words in a row whose least hash is shared by near copies, and the unit of their weights, so that sums are exact.
COPY_RUN, UNIT = 5, 1 << 32
SLICE_CHARS = 3_000_000
#: Windows in a training step, and steps of each round at least, so that a small sample is passed more often.
BATCH = 128
LEAST_STEPS = 40


class Encoded:
    """Texts as numbers of distinct words, with each distinct word's hash and character buckets."""

    def __init__(self, column) -> None:
        letters = np.ones(256, bool)
        letters[65:91] = letters[97:123] = False
        letters[128:] = False
        words = Words(column, letters)
        hashes = words.hashes(lower=True)
        self.hash, one, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        self.first, self.counts, self.rows = words.first, words.counts, words.rows
        self.data, self.start, self.end = words.data, words.start, words.end
        start, size = words.start[one], (words.end - words.start)[one]
        codes = words.data.astype(np.int64)
        codes[(codes >= 65) & (codes <= 90)] += 32
        # Every byte of a word with its neighbours, blanks beyond its ends.
        at = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(int(at[-1])) - np.repeat(at[:-1], size) if len(one) else np.zeros(0, np.int64)
        byte = np.repeat(start, size) + place
        last = np.repeat(size, size) - 1
        left = np.where(place > 0, codes[np.maximum(byte - 1, 0)], 0) if len(byte) else byte
        right = np.where(place < last, codes[np.minimum(byte + 1, len(codes) - 1)], 0) if len(byte) else byte
        mixed = ((left * 257 + codes[byte]) * 257 + right) * 2654435761 if len(byte) else byte
        self.grams, self.at = (mixed >> 8) % gru.CHAR_BUCKETS, at

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Windows of word numbers, -1 beyond the end, and the row of each; a text without words has one empty window."""
        n = np.maximum(-(-(self.counts - LENGTH) // STRIDE), 0) + 1
        row = np.repeat(np.arange(self.rows), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        begin = self.first[:-1][row] + step * STRIDE
        place = begin[:, None] + np.arange(LENGTH)
        inside = place < self.first[1:][row][:, None]
        if not len(self.word):
            return np.full(place.shape, -1, np.int64), row
        return np.where(inside, self.word[np.minimum(place, len(self.word) - 1)], -1), row

    def window_text(self, row: int, step: int) -> str:
        """The words of a window, joined by one blank."""
        low = int(self.first[row]) + step * STRIDE
        ends = zip(self.start[low : low + LENGTH].tolist(), self.end[low : min(low + LENGTH, int(self.first[row + 1]))].tolist(), strict=False)
        return b" ".join(self.data[a:b].tobytes() for a, b in ends).decode()


@dataclass
class ToxicityModel:
    """Network weights and the sorted hashes of the words that have a vector; ``constant`` replaces both if there was nothing to learn."""

    weights: dict | None
    vocabulary: np.ndarray
    constant: float = 0.5

    def known(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.vocabulary, hashes)
        hit = np.zeros(len(hashes), bool)
        if len(self.vocabulary):
            hit = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == hashes
        return np.where(hit, at + 1, 0)

    def window_logits(self, texts: Encoded, windows: np.ndarray, step: int = 4096) -> np.ndarray:
        x = gru.inputs(self.weights, self.known(texts.hash), texts.grams, texts.at)
        parts = [gru.logits(self.weights, x, windows[k : k + step]) for k in range(0, len(windows), step)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def scores(self, column) -> np.ndarray:
        texts = Encoded(column)
        if self.weights is None:
            return np.full(texts.rows, self.constant)
        windows, row = texts.windows()
        found = self.window_logits(texts, windows)
        best = np.maximum.reduceat(found, np.searchsorted(row, np.arange(texts.rows))) if texts.rows else found
        return 1.0 / (1.0 + np.exp(-np.clip(best.astype(float), -30, 30)))


@dataclass
class Telling:
    """Words in order of their hashes and how much each speaks for the label; rates windows before there is a network."""

    hashes: np.ndarray
    value: np.ndarray

    def window_logits(self, texts: Encoded, windows: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, texts.hash), max(len(self.hashes) - 1, 0))
        value = np.where(self.hashes[at] == texts.hash, self.value[at], 0.0) if len(self.hashes) else np.zeros(len(texts.hash))
        return np.append(value, -np.inf)[windows].max(1)


def copy_keys(column) -> list[int | None]:
    """The least hash of ``COPY_RUN`` neighbouring words of each text, which near copies share; none for shorter texts."""
    texts = Encoded(column)
    grams = runs(texts.hash[texts.word], COPY_RUN).view(np.int64)
    low, n = texts.first.tolist(), texts.counts.tolist()
    return [int(grams[a : a + k - COPY_RUN + 1].min()) if k >= COPY_RUN else None for a, k in zip(low, n, strict=False)]


def word_sums(column, yes: np.ndarray, no: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words by hash, with the weights of the texts of either class that hold them."""
    texts = Encoded(column)
    pairs = np.unique(np.repeat(np.arange(texts.rows), texts.counts) * max(len(texts.hash), 1) + texts.word)
    row, word = np.divmod(pairs, max(len(texts.hash), 1))
    sums = np.zeros((2, len(texts.hash)), np.int64)
    for total, weight in zip(sums, (yes, no), strict=True):
        np.add.at(total, word, weight[row])
    return texts.hash, sums[0], sums[1]


def best_windows(column, seeds: np.ndarray, rater: Telling | ToxicityModel, turn: int) -> tuple[np.ndarray, list[str], list[str]]:
    """Of all windows of each text: the highest rating, the first window that has it, and one drawn by the text's seed."""
    texts = Encoded(column)
    windows, row = texts.windows()
    rating = rater.window_logits(texts, windows)
    begin = np.searchsorted(row, np.arange(texts.rows))
    count = np.diff(np.append(begin, len(row)))
    top = np.lexsort((-rating, row))[begin] - begin if texts.rows else begin
    spare = mix(seeds.astype(np.int64).view(np.uint64) + np.uint64(turn)) % np.maximum(count, 1).astype(np.uint64)
    chosen = [[texts.window_text(n, int(k)) for n, k in enumerate(steps)] for steps in (top, spare)]
    return (rating[begin + top] if texts.rows else rating).astype(float), *chosen


def weights_of_copies(keys: Sequence[int | None]) -> np.ndarray:
    """One over the number of texts with the same key."""
    sizes: dict = {}
    for k in keys:
        sizes[k] = sizes.get(k, 0) + 1
    return np.array([1.0 if k is None else 1.0 / sizes[k] for k in keys])


def in_units(weight: np.ndarray) -> np.ndarray:
    return np.rint(weight * UNIT).astype(np.int64)


def train_model(y: np.ndarray, keys: Sequence[int | None], sums: Callable, pick: Callable, rounds: int = 3, epochs: int = 4, rate: float = 0.02) -> ToxicityModel:
    """A model from labels and copy keys of texts that lie elsewhere.

    ``sums(weight)`` gives the ``word_sums`` of all texts whose words occur in ``LEAST_TEXTS`` of them, by
    hash, ``pick(rater, turn)`` the ``best_windows`` of all texts.
    """
    import pyarrow as pa

    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(None, np.zeros(0, np.uint64), float((y.sum() + 0.5) / (len(y) + 1)))
    weight = weights_of_copies(keys)
    vocabulary, yes, no = sums(weight)
    value = np.log((yes / UNIT + 0.5) / ((weight * y).sum() + 1)) - np.log((no / UNIT + 0.5) / ((weight * (1 - y)).sum() + 1))
    model = ToxicityModel(gru.new_parameters(len(vocabulary) + 1), vocabulary)
    rater: Telling | ToxicityModel = Telling(vocabulary, value)
    for turn in range(rounds):
        best, top, spare = pick(rater, turn)
        alive = (y == 0) | (best > 0) if turn else np.ones(len(y), bool)
        if not (alive & (y == 1)).any():
            alive[:] = True
        use = np.concatenate([np.flatnonzero(alive), np.flatnonzero(alive & (y == 0))])
        data = Encoded(pa.array([top[n] for n in np.flatnonzero(alive)] + [spare[n] for n in np.flatnonzero(alive & (y == 0))], pa.large_string()))
        often = max(epochs, -(-LEAST_STEPS * BATCH // len(use)))
        gru.train(model.weights, model.known(data.hash), data.grams, data.at, data.windows()[0], y[use], weight[use] / weight.mean(), often, rate / (1 + turn), BATCH)
        rater = model
    return model


def frequent(hashes: np.ndarray, yes: np.ndarray, no: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    # Units are rounded, so a word of just as many texts may miss the mark by a few of them.
    own = np.flatnonzero(yes + no >= LEAST_TEXTS * UNIT - (UNIT >> 16))
    own = own[np.argsort(hashes[own])]
    return hashes[own], yes[own], no[own]


def learn(texts: Sequence[str], y: np.ndarray, rounds: int = 3, epochs: int = 4, rate: float = 0.02) -> ToxicityModel:
    """A model from texts in memory and their labels."""
    import pyarrow as pa

    column, y = pa.array(texts, pa.large_string()), np.asarray(y, float)

    def sums(weight):
        return frequent(*word_sums(column, in_units(weight * y), in_units(weight * (1 - y))))

    return train_model(y, copy_keys(column), sums, lambda rater, turn: best_windows(column, np.arange(len(y)), rater, turn), rounds, epochs, rate)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """``row, seed, doc_id, label`` and whole ``text`` of a sample chosen by hash among labelled documents that are not held out."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    known = known.where("label IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    by_hash = F.xxhash64("doc_id", F.lit("sample"))
    some = known.where("label = 1").orderBy(by_hash, "doc_id").limit(sample)
    ids = [(r["doc_id"], 1) for r in some.collect()]
    rest = known.where("label = 0").orderBy(by_hash, "doc_id").limit(max(1, min(sample, PER_POSITIVE * len(ids))))
    ids += [(r["doc_id"], 0) for r in rest.collect()]
    wanted = docs.sparkSession.createDataFrame(ids, "doc_id bigint, label int")
    # At most ``2 * sample`` ids are sent to the tasks, and so many texts are written to scratch.
    found = lean(docs).join(F.broadcast(wanted), "doc_id").where("text IS NOT NULL")
    return materialize(found.select(F.monotonically_increasing_id().alias("row"), F.xxhash64("doc_id", "text").alias("seed"), "doc_id", "label", "text"), "toxicity-sample")


def in_slices(body: Callable):
    """Arrow batches from ``body(part)``, which gives the columns of a result for a slice of rows."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for low, high in _slices(batch, SLICE_CHARS):
                columns = body(batch.slice(low, high - low))
                yield pa.RecordBatch.from_arrays([pa.array(v) if not isinstance(v, pa.Array) else v for v in columns.values()], names=list(columns))

    return run


def key_columns(part) -> dict:
    import pyarrow as pa

    columns = {n: part.column(n) for n in ("row", "seed", "doc_id", "label")}
    return columns | {"key": pa.array(copy_keys(part.column("text")), pa.int64())}


def sum_columns(rows: np.ndarray, yes: np.ndarray, no: np.ndarray):
    """``rows`` are sorted; ``yes`` and ``no`` are the weights of each."""

    def body(part) -> dict:
        at = np.searchsorted(rows, part.column("row").to_numpy(zero_copy_only=False))
        hashes, one, two = word_sums(part.column("text"), yes[at], no[at])
        return {"hash": hashes.view(np.int64), "yes": one, "no": two}

    return body


def window_columns(rater: Telling | ToxicityModel, turn: int):
    def body(part) -> dict:
        import pyarrow as pa

        best, top, spare = best_windows(part.column("text"), part.column("seed").to_numpy(zero_copy_only=False), rater, turn)
        return {"row": part.column("row"), "best": best, "top": pa.array(top, pa.string()), "spare": pa.array(spare, pa.string())}

    return body


def score_rows(model: ToxicityModel, names: Sequence[str], carry_text: bool):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for low, high in _slices(batch, SLICE_CHARS):
                part = batch.slice(low, high - low)
                columns = [part.column(n) for n in names] + ([part.column("text")] if carry_text else [])
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(model.scores(part.column("text")))], names=[*names, *(["text"] if carry_text else []), "score"]
                )

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    rows = training_rows(docs, labels, label, sample)
    keys = rows.mapInArrow(in_slices(key_columns), "row long, seed long, doc_id long, label int, key long").collect()
    keys.sort(key=lambda r: (r["doc_id"], r["seed"], r["row"]))
    y = np.array([r["label"] for r in keys], float)
    numbers = np.array([r["row"] for r in keys], np.int64)
    order = np.argsort(numbers)

    def sums(weight):
        body = sum_columns(numbers[order], in_units(weight * y)[order], in_units(weight * (1 - y))[order])
        parts = rows.mapInArrow(in_slices(body), "hash long, yes long, no long")
        # The same mark as in ``frequent``, so that only words with a vector come back.
        found = parts.groupBy("hash").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        table = found.where(F.col("yes") + F.col("no") >= LEAST_TEXTS * UNIT - (UNIT >> 16)).toPandas()
        return frequent(table["hash"].to_numpy(np.int64).view(np.uint64), table["yes"].to_numpy(np.int64), table["no"].to_numpy(np.int64))

    def pick(rater, turn):
        parts = rows.mapInArrow(in_slices(window_columns(rater, turn)), "row long, best double, top string, spare string")
        table = parts.toPandas().set_index("row").loc[numbers]
        return table["best"].to_numpy(float), table["top"].tolist(), table["spare"].tolist()

    return train_model(y, [r["key"] for r in keys], sums, pick)


def toxicity_scores(docs: DataFrame, model: ToxicityModel, keep: Sequence[str] = (), carry_text: bool = False) -> DataFrame:
    """``doc_id, *keep, score`` (and the ``text``) for every document."""
    rows = lean(docs, keep=keep)
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep)
    schema = f"doc_id long{kept}" + (", text string" if carry_text else "") + ", score double"
    return rows.mapInArrow(score_rows(model, ["doc_id", *keep], carry_text), schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity_scores(docs, fit_toxicity(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
