"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class is a normal distribution over statistics of whole texts, made nearly normal by logarithms and
roots. Its covariance is shrunk towards the pooled one and that towards its diagonal; the Cholesky factor
of each is inverted once, so a score is two matrix products: the difference of the log densities
(Mahalanobis distances and determinants) plus that of the log priors, as a probability.

Texts are read once, into a row of numbers for each document; learning and scoring read those rows.
Learning needs sums only, which Spark adds up over all labelled rows: no sample, nothing but the sums
comes to the driver.

Null and empty texts have all statistics zero and get the score of such a text. Labels that are null are
ignored; repeated rows count each. Without labels of both classes all scores are the prior. An empty
table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.llm.grams import Words, inside, runs
from utterlake.llm.packing import _slices
from utterlake.llm.tables import lean, read
from utterlake.session import materialize

STATISTICS = (
    "words chars word_length word_length_spread symbols upper digits marks exclamations not_ascii short_words "
    "distinct_words top_word stutter repeated_runs lines line_length repeated_lines"
).split()
#: Shares of the pooled covariance in that of a class, and of the diagonal in the pooled one.
POOLED, DIAGONAL = 0.1, 0.05
RIDGE = 1e-3


def _share(part, whole):
    return part / np.maximum(whole, 1)


def statistics(column) -> np.ndarray:
    """One row of transformed statistics for each text."""
    words = Words(column)
    n, data = words.counts, words.data
    chars = np.diff(words.at)

    def in_rows(mask):
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[words.at])

    def of_words(values):
        return np.diff(np.concatenate([[0], np.cumsum(values)])[words.first])

    def distinct(row, values):
        """How many different values a row has, and how often the most frequent one occurs."""
        order = np.lexsort((values, row))
        r, v = row[order], values[order]
        head = np.ones(len(r), bool)
        head[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
        heads = np.flatnonzero(head)
        most = np.zeros(len(n), np.int64)
        np.maximum.at(most, r[heads], np.diff(np.append(heads, len(r))))
        return np.bincount(r[heads], minlength=len(n)), most

    table = np.zeros(256, np.uint8)
    table[list(b"#*$%&|<>")] = 1
    table[65:91] = 2
    table[48:58] = 3
    table[list(b".,;:?\"'()[]")] = 4
    table[33] = 5
    table[128:] = 6
    kind = table[data]
    symbols, upper, digits, marks, shouts, high = (in_rows(kind == k) for k in range(1, 7))
    lengths = words.end - words.start
    row, hashes = words.row(), words.hashes(lower=True)
    n_distinct, most = distinct(row, hashes)
    near = np.zeros(len(words), bool)
    near[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    whole = inside(words, 4)
    run_row = row[: len(whole)][whole]
    n_runs = np.bincount(run_row, minlength=len(n))
    different, _ = distinct(run_row, runs(hashes, 4)[whole])
    # Lines are told apart by a hash of their words.
    line_word = np.zeros(len(words), bool)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line = breaks[words.start] + np.repeat(np.arange(len(n)), n)
    if len(words):
        line_word[0] = True
        line_word[1:] = line[1:] != line[:-1]
    heads = np.flatnonzero(line_word)
    spread = hashes * (np.arange(len(words)) - np.repeat(heads, np.diff(np.append(heads, len(words)))) + 1).astype(np.uint64)
    sums = np.add.reduceat(spread, heads) if len(heads) else np.zeros(0, np.uint64)
    n_lines = np.bincount(row[heads], minlength=len(n))
    other_lines, _ = distinct(row[heads], sums)
    mean = _share(of_words(lengths), n)
    square = _share(of_words(lengths.astype(float) ** 2), n)
    root = np.sqrt
    return np.stack(
        [
            np.log1p(n),
            np.log1p(chars),
            mean,
            np.log1p(root(np.maximum(square - mean**2, 0))),
            root(_share(symbols, chars)),
            root(_share(upper, chars)),
            root(_share(digits, chars)),
            root(_share(marks, chars)),
            root(_share(shouts, chars)),
            root(_share(high, chars)),
            root(_share(of_words(lengths <= 3), n)),
            np.log1p(n_distinct) - 0.5 * np.log1p(n),
            root(_share(most, n)),
            root(_share(of_words(near), n)),
            root(_share(n_runs - different, n_runs)),
            np.log1p(n_lines),
            np.log1p(_share(n, n_lines)),
            root(_share(n_lines - other_lines, n_lines)),
        ],
        1,
    ).astype(float)


def statistic_rows(chars: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for low, high in _slices(batch, chars):
                part = batch.slice(low, high - low)
                values = statistics(part.column("text"))
                at = pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32())
                lists = pa.ListArray.from_arrays(at, pa.array(values.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "statistics"])

    return run


def document_statistics(docs: DataFrame, chars: int = 4_000_000) -> DataFrame:
    return lean(docs).mapInArrow(statistic_rows(chars), "doc_id long, statistics array<double>")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document belongs to the fold that no label may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors, log determinants and log priors of the classes 0 and 1."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def log_density(self, x: np.ndarray) -> np.ndarray:
        scaled = [(x - m) @ f.T for m, f in zip(self.means, self.factors, strict=True)]
        return np.stack([c - 0.5 * (z * z).sum(1) for z, c in zip(scaled, self.constants, strict=True)], 1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        densities = self.log_density(x)
        return 1.0 / (1.0 + np.exp(-np.clip(densities[:, 1] - densities[:, 0], -30, 30)))


def sum_rows():
    """Count, sums and sums of products of each class in a partition, as ``label, place, value``."""

    def run(batches):
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            x = np.array(batch.column("statistics").to_pylist(), float).reshape(len(labels), -1)
            for label in np.unique(labels).tolist():
                own = x[labels == label]
                part = np.concatenate([[len(own)], own.sum(0), (own.T @ own).reshape(-1)])
                total[label] = total.get(label, 0) + part
        for label, values in total.items():
            size = len(values)
            columns = [pa.array([label] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(values)]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "place", "value"])

    return run


def fit_discriminant(labelled: DataFrame, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
    """Learns from ``label`` (0 or 1) and ``statistics`` of all rows given."""
    sums = labelled.select("label", "statistics").mapInArrow(sum_rows(), "label int, place int, value double")
    found: dict[int, dict[int, float]] = {0: {}, 1: {}}
    for r in sums.groupBy("label", "place").agg(F.sum("value").alias("v")).collect():
        found[r["label"]][r["place"]] = r["v"]
    d = len(STATISTICS)
    count, mean, spread = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for c in (0, 1):
        if found[c]:
            v = np.array([found[c][k] for k in range(1 + d + d * d)])
            count[c], mean[c] = v[0], v[1 : 1 + d] / v[0]
            spread[c] = v[1 + d :].reshape(d, d) / v[0] - np.outer(mean[c], mean[c])
    if not count.all():
        prior = (count + 0.5) / (count.sum() + 1)
        return Discriminant(np.zeros((2, d)), np.zeros((2, d, d)), np.log(prior))
    common = np.tensordot(count / count.sum(), spread, 1)
    common = (1 - diagonal) * common + diagonal * np.diag(np.diag(common))
    scale = np.diag(np.diag(common)) + RIDGE * np.eye(d)
    factors, constants = [], []
    for c in (0, 1):
        covariance = (1 - pooled) * spread[c] + pooled * common + RIDGE * scale + 1e-9 * np.eye(d)
        low = np.linalg.cholesky(covariance)
        factors.append(np.linalg.inv(low))
        constants.append(np.log(count[c] / count.sum()) - np.log(np.diag(low)).sum())
    return Discriminant(mean, np.array(factors), np.array(constants))


def score_rows(model: Discriminant):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array(batch.column("statistics").to_pylist(), float).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.probability(x))], names=["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``doc_id, held_out, score`` for every document; labels of held-out documents are not read into the fit."""
    rows = materialize(document_statistics(docs), "statistics")
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label IN (0, 1)").where(~held_out(F.col("doc_id")))
    model = fit_discriminant(rows.join(known, "doc_id"))
    scored = rows.mapInArrow(score_rows(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    scored = quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
