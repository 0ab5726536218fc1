"""Logistic regression and linear SVM on TF-IDF weights, by L-BFGS over rows of texts.

From weights of 0 on, every vector of the solver, gradients and history included, is a sum of texts, ``X' a`` with one
number of ``a`` for each text and class. So a vector is kept as these numbers and its margins ``X X' a``, which are
rows ``(row, k values each)``, and dot products are sums over the texts. The vocabulary takes part in one product
``X X' r`` a step and is not written again; weights by term are made once, at the end. Only dot products and
sums of losses come to the driver. All classes share a pass.

The entries of the texts are blocks of terms, written once as packed arrays. A product sends the numbers of the texts to each
block, and a block returns one row for each text. The bias is kept beside the vectors, one number for each class.

Up to ``LOCAL_NUMBERS`` numbers, texts times classes, a vector is an array on the driver, its numbers are broadcast, and entries
are the packed terms of ``postings``; terms of one text take no part in products but by the sum of their squares. Beyond that,
vectors are rows of tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.functions.numeric import argmax, sigmoid, softmax
from utterlake.operators.features import Tfidf, fit_idf, term_rows, word_bags
from utterlake.operators.joins import hot_values, hybrid_lookup
from utterlake.operators.postings import Postings, _packer, _term_packer, block_count, build_postings, whole_keys
from utterlake.session import bucketed, materialize, sweep

#: A fit ends when the gradient has this part of its first length, or after so many steps.
TOLERANCE = 1e-2
MOST_STEPS = 100
HISTORY = 3
#: Step lengths that are tried, in the first step for a direction of length 1.
FIRST_LENGTHS = [0.1, 0.3, 1, 3, 10, 30, 100, 300]
LENGTHS = [0.03, 0.1, 0.25, 0.5, 1, 1.5, 2.5, 4]
BIAS = ""
#: Entries of a block of terms, and of a packed piece of it.
BLOCK_ENTRIES = 4_000_000
PACK = 1 << 18
#: Numbers of a vector, texts times classes, up to which the driver holds vectors: 18 at a time, 8 bytes each.
LOCAL_NUMBERS = 3_000_000
#: Bytes that the tasks of a product return together, if these are more than two.
RETURNED_BYTES = 16 << 20


def _softmax_loss(margins: Sequence[Column], label: Column) -> tuple[Column, list[Column]]:
    """Multinomial log-loss and its derivative by each margin."""
    most = F.greatest(*margins) if len(margins) > 1 else margins[0]
    powers = [F.exp(m - most) for m in margins]
    total = reduce(add, powers)
    own = reduce(add, [F.when(label == n, m).otherwise(0.0) for n, m in enumerate(margins)])
    return most + F.log(total) - own, [p / total - F.when(label == n, 1.0).otherwise(0.0) for n, p in enumerate(powers)]


def _hinge_loss(margins: Sequence[Column], label: Column) -> tuple[Column, list[Column]]:
    """Squared hinge loss of one class against all others, added over the classes, and its derivatives."""
    signs = [F.when(label == n, 1.0).otherwise(-1.0) for n in range(len(margins))]
    short = [F.greatest(1.0 - s * m, F.lit(0.0)) for s, m in zip(signs, margins, strict=True)]
    return reduce(add, [v * v for v in short]), [-2.0 * s * v for s, v in zip(signs, short, strict=True)]


LOSSES = {"logreg": _softmax_loss, "svm": _hinge_loss}


def _dot(a: str, b: str, k: int) -> str:
    """Dot product of two vectors without their biases: numbers of one times margins of the other."""
    return "sum(" + " + ".join(f"{a}a{j} * {b}m{j}" for j in range(k)) + ")"


@dataclass
class Fit:
    """What a fit has reached: its numbers ``row, a0, a1, ...`` and biases, objective, length of the gradient and steps."""

    numbers: DataFrame
    bias: np.ndarray
    objective: float
    gradient: float
    steps: int
    converged: bool


@dataclass
class Blocks:
    """Entries packed by block of terms: ``block, rows, terms, x``, dealt by block, and how many blocks there are."""

    table: DataFrame
    count: int

    def product(self, numbers: DataFrame, k: int) -> DataFrame:
        """``(row, q0, q1, ...)``, the margins that the vectors ``X' r`` give to all texts, from ``(row, r0, r1, ...)``."""

        def run(left, right):
            import numpy as np
            import pyarrow as pa

            schema = pa.schema([("row", pa.int64()), *[(f"q{j}", pa.float64()) for j in range(k)]])
            if not left.num_rows or not right.num_rows:
                return schema.empty_table()
            right = right.sort_by("row")
            rows = right.column("row").to_numpy()
            known = [right.column(f"r{j}").to_numpy() for j in range(k)]
            pieces = [
                (np.searchsorted(rows, np.frombuffer(piece["rows"], "int64")), np.frombuffer(piece["terms"], "int32"), np.frombuffer(piece["x"], "float64"))
                for piece in left.select(["rows", "terms", "x"]).to_pylist()
            ]
            size = max(int(term.max()) for _, term, _ in pieces) + 1
            out = []
            for r in known:
                sums = np.zeros(size)
                for at, term, x in pieces:
                    sums += np.bincount(term, x * r[at], minlength=size)
                back = np.zeros(len(rows))
                for at, term, x in pieces:
                    back += np.bincount(at, x * sums[term], minlength=len(rows))
                out.append(back)
            return pa.Table.from_arrays([pa.array(rows), *[pa.array(q) for q in out]], schema=schema)

        names = ", ".join(f"q{j} double" for j in range(k))
        sent = numbers.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.count - 1))))
        found = self.table.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(run, f"row bigint, {names}")
        return found.groupBy("row").agg(*[F.sum(f"q{j}").alias(f"q{j}") for j in range(k)])


def pack_entries(entries: DataFrame) -> Blocks:
    """``entries`` of ``(row, term, x)`` cut into blocks of terms by hash, so that none has much more than ``BLOCK_ENTRIES``."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        codes = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy().astype("int32")
        rows, x = table.column("row").to_numpy(), table.column("x").to_numpy()
        block = table.column("block")[0].as_py()
        cuts = [slice(low, low + pack) for low in range(0, len(x), pack)]
        columns = [pa.array([block] * len(cuts), pa.int32()), *[pa.array([np.ascontiguousarray(v[c]).tobytes() for c in cuts], pa.binary()) for v in (rows, codes, x)]]
        return pa.Table.from_arrays(columns, names=["block", "rows", "terms", "x"])

    pack = PACK
    count = max(entries.sparkSession.sparkContext.defaultParallelism, -(-entries.count() // BLOCK_ENTRIES))
    dealt = entries.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(count)).cast("int")).groupBy("block")
    return Blocks(bucketed(dealt.applyInArrow(run, "block int, rows binary, terms binary, x binary"), "block", "entries-by-block"), count)


def _two_loops(gram: np.ndarray, pairs: int) -> np.ndarray:
    """Coefficients of the L-BFGS direction over the vectors s1.., y1.., g from their dot products."""
    out = np.zeros(2 * pairs + 1)
    out[-1] = -1.0
    alpha = np.zeros(pairs)
    for n in reversed(range(pairs)):
        alpha[n] = gram[n] @ out / gram[n, pairs + n]
        out[pairs + n] -= alpha[n]
    if pairs:
        out *= gram[pairs - 1, 2 * pairs - 1] / gram[2 * pairs - 1, 2 * pairs - 1]
    for n in range(pairs):
        out[n] += alpha[n] - gram[pairs + n] @ out / gram[n, pairs + n]
    return out


def minimise(blocks: Blocks, rows: DataFrame, k: int, loss, c: float, free_bias: bool, tolerance: float, most: int) -> Fit:
    """Least ``|w|^2 / 2 + c * sum of weighted losses``, from packed entries and texts ``row, y, weight``.

    With ``free_bias`` the biases are not part of ``|w|``.
    """
    classes, rest = range(k), 0.0 if free_bias else 1.0

    def margins(own: np.ndarray) -> list[Column]:
        return [F.col(f"wm{j}") + F.lit(float(own[j])) for j in classes]

    def with_gradient(at: DataFrame, own: np.ndarray) -> DataFrame:
        """``at`` with the gradient at its weights: numbers ``na`` and margins ``nm``."""
        _, slopes = loss(margins(own), F.col("y"))
        known = at.select("row", *[(F.lit(c) * F.col("weight") * v).alias(f"r{j}") for j, v in enumerate(slopes)])
        joined = at.join(known, "row").join(blocks.product(known, k), "row", "left")
        return joined.selectExpr("*", *[f"wa{j} + r{j} AS na{j}" for j in classes], *[f"wm{j} + coalesce(q{j}, 0D) AS nm{j}" for j in classes])

    def products(state: DataFrame, names: list[str], new: list[int], known: np.ndarray, bias: dict[str, np.ndarray], old: np.ndarray | None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Dot products of the vectors, those of ``new`` ones from the table, and the biases, of which the gradient's is a sum."""
        pairs = [(a, b) for a in new for b in range(len(names)) if b not in new or b >= a]
        sums = [F.expr(f"{_dot(names[a], names[b], k)} AS p{a}_{b}") for a, b in pairs]
        row = state.agg(*sums, *[F.expr(f"sum(ga{j} - wa{j}) AS b{j}") for j in classes]).first()
        bias["g"] = rest * bias["w"] + np.array([row[f"b{j}"] or 0.0 for j in classes])
        if old is not None:
            bias[names[-2]] = bias["g"] - old
        for a, b in pairs:
            known[a, b] = known[b, a] = (row[f"p{a}_{b}"] or 0.0) + bias[names[a]] @ bias[names[b]]
        return known, bias

    def result(state: DataFrame, steps: int, converged: bool) -> Fit:
        return Fit(state.selectExpr("row", *[f"wa{j} AS a{j}" for j in classes]), bias["w"], value, float(np.sqrt(max(gram[-1, -1], 0.0))), steps, converged)

    own = np.zeros(k)
    at = rows.selectExpr("row", "y", "weight", *[f"0D AS w{kind}{j}" for kind in "am" for j in classes])
    start = with_gradient(at, own).selectExpr(*at.columns, *[f"n{kind}{j} AS g{kind}{j}" for kind in "am" for j in classes])
    state, held, names = materialize(start, "solver"), [], ["w", "g"]
    gram, bias = products(state, names, [0, 1], np.zeros((2, 2)), {"w": own}, None)
    first = gram[-1, -1]
    value = state.agg(F.sum(F.lit(c) * F.col("weight") * loss(margins(own), F.col("y"))[0]).alias("f")).first()["f"] or 0.0
    for step in range(most):
        if gram[-1, -1] <= tolerance**2 * first or not first:
            return result(state, step, True)
        parts = np.concatenate([[0.0], _two_loops(gram[1:, 1:], len(held))])
        if not held:
            parts /= np.sqrt(gram[-1, -1])
        way = [(f"d{kind}{j}", " + ".join(f"{float(p)!r}D * {n}{kind}{j}" for p, n in zip(parts[1:], names[1:], strict=True))) for kind in "am" for j in classes]
        moved = state.selectExpr("*", *[f"{d} AS {name}" for name, d in way])
        bias["d"] = sum(p * bias[n] for p, n in zip(parts, names, strict=True))
        lengths = LENGTHS if held else FIRST_LENGTHS
        losses = [loss([F.expr(f"wm{j} + {float(t)!r}D * dm{j}") + F.lit(float(bias["w"][j] + t * bias["d"][j])) for j in classes], F.col("y"))[0] for t in lengths]
        found = moved.agg(*[F.sum(F.lit(c) * F.col("weight") * v).alias(f"f{n}") for n, v in enumerate(losses)]).first()
        ww, wd, dd = gram[0, 0], gram[0] @ parts, parts @ gram @ parts
        if free_bias:
            ww, wd, dd = ww - bias["w"] @ bias["w"], wd - bias["w"] @ bias["d"], dd - bias["d"] @ bias["d"]
        tried = [found[f"f{n}"] + 0.5 * (ww + 2 * t * wd + t * t * dd) for n, t in enumerate(lengths)]
        best = int(np.argmin(tried))
        if tried[best] >= value:
            return result(state, step, False)
        t, value = float(lengths[best]), tried[best]
        kept = held[1:] if len(held) == HISTORY else held
        after = moved.selectExpr(
            "row", "y", "weight",
            *[f"w{kind}{j} + {t!r}D * d{kind}{j} AS w{kind}{j}" for kind in "am" for j in classes],
            *[f"{side}{n}_{kind}{j}" for side in "sy" for n in kept for kind in "am" for j in classes],
            *[f"{t!r}D * d{kind}{j} AS s{step}_{kind}{j}" for kind in "am" for j in classes],
            *[f"g{kind}{j}" for kind in "am" for j in classes],
        )
        old = bias["g"]
        bias = {n: v for n, v in bias.items() if n not in ("d", "g")} | {"w": bias["w"] + t * bias["d"], f"s{step}_": t * bias["d"]}
        state = with_gradient(after, bias["w"]).selectExpr(
            *[n for n in after.columns if not n.startswith("g")],
            *[f"n{kind}{j} - g{kind}{j} AS y{step}_{kind}{j}" for kind in "am" for j in classes],
            *[f"n{kind}{j} AS g{kind}{j}" for kind in "am" for j in classes],
        )
        state = materialize(state, "solver")
        # Dot products of the new vectors with all; those of the others are known.
        grown = [*kept, step]
        known = [f"{side}{n}_" for side in "sy" for n in kept]
        before, names = names, ["w", *[f"s{n}_" for n in grown], *[f"y{n}_" for n in grown], "g"]
        dots = np.zeros((len(names), len(names)))
        dots[np.ix_([names.index(n) for n in known], [names.index(n) for n in known])] = gram[np.ix_([before.index(n) for n in known], [before.index(n) for n in known])]
        fresh = [names.index(n) for n in ("w", f"s{step}_", f"y{step}_", "g")]
        gram, bias = products(state, names, fresh, dots, bias, old)
        held, bend = grown, gram[fresh[1], fresh[2]]
        if bend <= 1e-12 * gram[fresh[2], fresh[2]]:
            # A step without curvature says nothing about the next one.
            held, names, gram = [], ["w", "g"], gram[np.ix_([0, -1], [0, -1])]
    return result(state, most, False)


@dataclass
class Packed:
    """Packed terms of the fitted texts and what the driver knows of each text, in the order of ``rows``: its class, the length of
    its vector, the sum of squares of its terms that no other text has, and whether it has a key. Texts without one take part
    in the frequencies of terms only."""

    postings: Postings
    solver: DataFrame
    total: int
    rows: np.ndarray
    y: np.ndarray
    lengths: np.ndarray
    single: np.ndarray
    keyed: np.ndarray

    @classmethod
    def build(cls, source: DataFrame, key: str, labels: Sequence[str], total: int, chars: int) -> Packed:
        postings = build_postings(source, key, "_class", "_doc", "linear-postings", block_count(source, chars), True)
        sweep(source.sparkSession)
        texts = postings.texts.toArrow().sort_by("row")
        rows, keyed = texts.column("row").to_numpy(), texts.column("key").is_valid().to_numpy()
        places = {label: n for n, label in enumerate(labels)}
        encoded = texts.column("class").combine_chunks().dictionary_encode()
        y = np.array([places[n] for n in encoded.dictionary.to_pylist()], "int64")[encoded.indices.to_numpy()] if len(rows) else np.zeros(0, "int64")
        squares, several, single = postings.squares(total).toArrow(), np.zeros(len(rows)), np.zeros(len(rows))
        at = np.searchsorted(rows, squares.column("row").to_numpy())
        several[at], single[at] = squares.column("several").to_numpy(), squares.column("single").to_numpy()
        lengths = np.sqrt(several + single)
        lengths[lengths == 0] = 1.0
        known = postings.table.sparkSession.sparkContext.broadcast(rows)

        def placed(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                at = [squeeze(np.searchsorted(known.value, expand(r, "int64")).astype("int32")) for r in batch.column("rows").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("counts"), batch.column("tfs"), pa.array(at, pa.binary())], names=["counts", "tfs", "at"])

        squeeze, expand = _packer()
        shared = postings.parts.where("not single").select("counts", "tfs", "rows")
        solver = materialize(shared.mapInArrow(placed, "counts binary, tfs binary, at binary"), "linear-solver")
        return cls(postings, solver, total, rows, y, lengths, single, keyed)

    def product(self, numbers: np.ndarray) -> np.ndarray:
        """The margins that the vectors ``X' r`` give to all texts."""
        spark, (n, k), total = self.solver.sparkSession, numbers.shape, self.total
        sent = spark.sparkContext.broadcast(numbers / self.lengths[:, None])

        def run(batches):
            import numpy as np
            import pyarrow as pa

            r, out = sent.value, np.zeros((k, n))
            for part in (row for b in batches for i in range(b.num_rows) for row in b.slice(i, 1).to_pylist()):
                counts, tf, at = (expand(part[c], "int32") for c in ("counts", "tfs", "at"))
                tf = tf.astype("float64")
                sums = np.add.reduceat(r[at] * tf[:, None], np.cumsum(counts) - counts, axis=0)
                sums *= ((np.log((total + 1) / (counts + 1.0)) + 1) ** 2)[:, None]
                for j in range(k):
                    out[j] += np.bincount(at, np.repeat(sums[:, j], counts) * tf, minlength=n)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["out"])

        _, expand = _packer()
        tasks = min(spark.sparkContext.defaultParallelism, max(2, RETURNED_BYTES // max(8 * n * k, 1)))
        # All tasks side by side; what they return is bounded.
        found = self.solver.coalesce(tasks).mapInArrow(run, "out binary").collect() if n else []
        back = np.zeros((k, n))
        for row in found:
            back += np.frombuffer(row["out"], "float64").reshape(k, n)
        sent.destroy()
        return (back.T + self.single[:, None] * numbers / self.lengths[:, None]) / self.lengths[:, None]

    def weights(self, numbers: np.ndarray) -> DataFrame:
        """``(term, df, idf, w0, w1, ...)`` of the vector ``X' r``, made when it is read."""
        spark, k, total = self.solver.sparkSession, numbers.shape[1], self.total
        sent = spark.sparkContext.broadcast((self.rows, numbers / self.lengths[:, None], self.keyed))

        def run(batches):
            import numpy as np
            import pyarrow as pa

            rows, r, keyed = sent.value
            for part in (row for b in batches for i in range(b.num_rows) for row in b.slice(i, 1).to_pylist()):
                counts, tf = expand(part["counts"], "int32"), expand(part["tfs"], "int32")
                at, idf, starts = np.searchsorted(rows, expand(part["rows"], "int64")), np.log((total + 1) / (counts + 1.0)) + 1, np.cumsum(counts) - counts
                sums = np.add.reduceat(r[at] * tf[:, None], starts, axis=0) * idf[:, None]
                columns = [expand_terms(part["terms"]), pa.array(counts.astype("int64")), pa.array(idf), *[pa.array(np.ascontiguousarray(sums[:, j])) for j in range(k)]]
                out = pa.RecordBatch.from_arrays(columns, names=["term", "df", "idf", *[f"w{j}" for j in range(k)]])
                yield out.filter(pa.array(np.logical_or.reduceat(keyed[at], starts)))

        (_, expand), (_, expand_terms) = _packer(), _term_packer()
        names = ", ".join(f"w{j} double" for j in range(k))
        return self.postings.parts.mapInArrow(run, f"term string, df bigint, idf double, {names}")

    def sums(self, asked: Postings, numbers: np.ndarray) -> DataFrame:
        """``(row, uu, s0, s1, ...)``, parts by block of the squared lengths of asked texts and of their products with ``X' r``."""
        spark, k, total = self.solver.sparkSession, numbers.shape[1], self.total
        sent = spark.sparkContext.broadcast((self.rows, numbers / self.lengths[:, None], self.keyed))
        def run(left, right):
            import numpy as np
            import pyarrow as pa
            import pyarrow.compute as pc

            rows, r, keyed = sent.value
            held = right.to_pylist()
            names = pa.concat_arrays([expand_terms(p["terms"]) for p in held]) if held else pa.array([], pa.string())
            idf, weight = np.zeros(len(names)), np.zeros((len(names), k))
            for part in (row for i in range(left.num_rows) for row in left.slice(i, 1).to_pylist()):
                counts, tf = expand(part["counts"], "int32"), expand(part["tfs"], "int32")
                terms = expand_terms(part["terms"])
                mine = pc.index_in(terms, value_set=names)
                hit = np.nonzero(mine.is_valid().to_numpy(zero_copy_only=False))[0]
                if not len(hit):
                    continue
                own = np.repeat(mine.is_valid().to_numpy(zero_copy_only=False), counts)
                at = np.searchsorted(rows, expand(part["rows"], "int64")[own])
                place, sizes = mine.take(pa.array(hit)).to_numpy().astype("int64"), counts[hit]
                starts = np.cumsum(sizes) - sizes
                one = (np.log((total + 1) / (sizes + 1.0)) + 1) * np.logical_or.reduceat(keyed[at], starts)
                idf[place] = one
                weight[place] = np.add.reduceat(r[at] * tf[own][:, None], starts, axis=0) * one[:, None]
            found, at = [], 0
            for part in held:
                counts = expand(part["counts"], "int32")
                term = np.repeat(np.arange(at, at + len(counts)), counts)
                at += len(counts)
                kept = idf[term] > 0
                term, row = term[kept], expand(part["rows"], "int64")[kept]
                found.append((term, row, expand(part["tfs"], "int32")[kept] * idf[term]))
            term, row, u = (np.concatenate([np.zeros(0, t), *[f[n] for f in found]]) for n, t in enumerate(("int64", "int64", "float64")))
            texts, which = np.unique(row, return_inverse=True)
            # Sums of no values would be whole numbers.
            columns = [texts, *[np.bincount(which, v, minlength=len(texts)).astype("float64") for v in (u * u, *(u * weight[term, j] for j in range(k)))]]
            return pa.Table.from_arrays([pa.array(c) for c in columns], names=["row", "uu", *[f"s{j}" for j in range(k)]])

        (_, expand), (_, expand_terms) = _packer(), _term_packer()
        names = ", ".join(f"s{j} double" for j in range(k))
        both = [p.parts.groupBy("block") for p in (self.postings, asked)]
        return both[0].cogroup(both[1]).applyInArrow(run, f"row bigint, uu double, {names}")


def _softmax_here(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_softmax_loss`` of arrays."""
    most = margins.max(axis=1, keepdims=True)
    powers = np.exp(margins - most)
    total, at = powers.sum(axis=1, keepdims=True), np.arange(len(y))
    loss = most[:, 0] + np.log(total[:, 0]) - margins[at, y]
    powers /= total
    powers[at, y] -= 1.0
    return loss, powers


def _hinge_here(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_hinge_loss`` of arrays."""
    signs = np.full(margins.shape, -1.0)
    signs[np.arange(len(y)), y] = 1.0
    short = np.maximum(1.0 - signs * margins, 0.0)
    return (short * short).sum(axis=1), -2.0 * signs * short


LOCAL_LOSSES = {"logreg": _softmax_here, "svm": _hinge_here}


def minimise_here(packed: Packed, weight: np.ndarray, k: int, loss, c: float, free_bias: bool, tolerance: float, most: int) -> tuple[np.ndarray, Fit]:
    """The steps of ``minimise`` on arrays: a vector is its numbers, its margins and its bias."""
    y, rest = packed.y, 0.0 if free_bias else 1.0
    weight = c * weight * packed.keyed

    def gradient(w):
        r = loss(w[1] + w[2], y)[1] * weight[:, None]
        return w[0] + r, w[1] + packed.product(r), rest * w[2] + r.sum(axis=0)

    def dot(u, v):
        return float(np.vdot(u[0], v[1]) + u[2] @ v[2])

    def mixed(parts, vectors):
        out = [np.zeros((len(y), k)), np.zeros((len(y), k)), np.zeros(k)]
        for part, vector in zip(parts, vectors, strict=True):
            for o, v in zip(out, vector, strict=True):
                o += part * v
        return tuple(out)

    def losses(w):
        return float(weight @ loss(w[1] + w[2], y)[0])

    w = mixed([], [])
    g, held = gradient(w), []
    value, gg = losses(w), dot(g, g)
    first = gg

    def result(steps, converged):
        return w[0], Fit(None, w[2], value, float(np.sqrt(max(gg, 0.0))), steps, converged)

    for step in range(most):
        if gg <= tolerance**2 * first or not first:
            return result(step, True)
        vectors = [*[s for s, _ in held], *[v for _, v in held], g]
        gram = np.array([[dot(a, b) for b in vectors] for a in vectors])
        parts = _two_loops(gram, len(held))
        if not held:
            parts /= np.sqrt(gg)
        d = mixed(parts, vectors)
        ww, wd, dd = dot(w, w), dot(w, d), dot(d, d)
        if free_bias:
            ww, wd, dd = ww - w[2] @ w[2], wd - w[2] @ d[2], dd - d[2] @ d[2]
        lengths = LENGTHS if held else FIRST_LENGTHS
        tried = [losses(mixed([1.0, t], [w, d])) + 0.5 * (ww + 2 * t * wd + t * t * dd) for t in lengths]
        best = int(np.argmin(tried))
        if tried[best] >= value:
            return result(step, False)
        value = tried[best]
        s = mixed([float(lengths[best])], [d])
        del d, vectors
        w = mixed([1.0, 1.0], [w, s])
        after = gradient(w)
        turn = mixed([1.0, -1.0], [after, g])
        g, gg = after, dot(after, after)
        held = [*(held[1:] if len(held) == HISTORY else held), (s, turn)]
        if dot(s, turn) <= 1e-12 * dot(turn, turn):
            # A step without curvature says nothing about the next one.
            held = []
    return result(most, False)


@dataclass
class LinearModel:
    """``terms(term, df, idf, w0, w1, ...)``, the bias of each class and the sorted classes; how the fit ended is in ``about``."""

    name: str
    terms: DataFrame
    bias: list[float]
    labels: list[str]
    about: dict = field(default_factory=dict)
    #: Packed terms and the numbers of the texts, of a model that was fitted on them and not loaded.
    packed: tuple[Packed, np.ndarray] | None = None

    @property
    def converged(self) -> bool:
        return bool(self.about.get("converged"))

    def scores(self, df: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
        """``(key, scores[k])`` in class order; a text without known terms scores the biases."""
        k = len(self.labels)
        if self.packed and whole_keys(df, key):
            return self._packed_scores(df, key, text)
        rows = term_rows(materialize(word_bags(df, key, text), "linear-asked"), key)
        joined = hybrid_lookup(rows, self.terms.drop("df"), ["term"], hot_values(self.terms, ["term"], "df").drop("df"))
        joined = joined.withColumn("_u", F.col("tf") * F.col("idf"))
        sums = [F.sum(F.col("_u") * F.col(f"w{j}")).alias(f"_a{j}") for j in range(k)]
        parts = joined.groupBy(key).agg(F.sqrt(F.sum(F.col("_u") * F.col("_u"))).alias("_n"), *sums)
        total = F.array(*[F.coalesce(F.col(f"_a{j}") / F.col("_n"), F.lit(0.0)) + F.lit(b) for j, b in enumerate(self.bias)])
        return df.select(key).join(parts, key, "left").select(key, total.alias("scores"))

    def _packed_scores(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """The same by blocks of packed terms: no row for a term of a text or of the model is made."""
        packed, numbers = self.packed
        asked = df.select(F.col(key).alias("_key"), F.lit("").alias("_class"), F.col(text).alias("_doc"))
        asked = build_postings(asked, "_key", "_class", "_doc", "linear-asked", packed.postings.blocks)
        sums = packed.sums(asked, numbers).join(asked.texts.select("row", F.col("key").alias(key)), "row")
        sums = sums.groupBy(key).agg(F.sqrt(F.sum("uu")).alias("_n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(len(self.labels))])
        parts = materialize(sums, "linear-sums")
        total = F.array(*[F.coalesce(F.col(f"s{j}") / F.col("_n"), F.lit(0.0)) + F.lit(b) for j, b in enumerate(self.bias)])
        return df.select(key).join(parts, key, "left").select(key, total.alias("scores"))

    def predict(self, df: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
        """``df`` with ``predicted_intent`` and ``confidence``; the first class wins ties."""
        names = F.array(*[F.lit(label) for label in self.labels])
        out = self.scores(df, key, text).withColumn("_at", argmax("scores"))
        sure = softmax("scores")[F.col("_at")] if self.name == "logreg" else sigmoid(F.array_max("scores"))
        return df.join(out.select(key, names[F.col("_at")].alias("predicted_intent"), sure.alias("confidence")), key)

    def save(self, path: str) -> None:
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        rows = [(n, c, self.bias[n], self.name, self.converged, *[float(self.about.get(m, 0)) for m in ("objective", "gradient", "steps")]) for n, c in enumerate(self.labels)]
        about = SparkSession.active().createDataFrame(
            rows, "place int, class string, bias double, name string, converged boolean, objective double, gradient double, steps double"
        )
        about.coalesce(1).write.mode("overwrite").parquet(f"{path}/classes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearModel:
        rows = spark.read.parquet(f"{path}/classes").orderBy("place").collect()
        about = {m: rows[0][m] for m in ("converged", "objective", "gradient", "steps")} if rows else {}
        return cls(rows[0]["name"], spark.read.parquet(f"{path}/terms"), [r["bias"] for r in rows], [r["class"] for r in rows], about)


@dataclass
class Entries:
    """The fitted rows ``key, _class, _doc``, the sorted classes with their sizes and, of few rows, their packed terms.

    The other tables are made when they are asked for: the rows as sparse unit vectors, ``row, term, x`` with the empty term as bias,
    the same packed by blocks of terms without it, the texts and the vocabulary."""

    source: DataFrame
    key: str
    sizes: list[tuple[str, int]]
    packed: Packed | None = None

    @cached_property
    def bags(self) -> DataFrame:
        return materialize(word_bags(self.source, self.key, "_doc", ["_class"]), "linear-bags")

    @cached_property
    def vocab(self) -> DataFrame:
        return materialize(fit_idf(self.bags, sum(n for _, n in self.sizes)), "linear-vocabulary")

    @cached_property
    def entries(self) -> DataFrame:
        key = self.key
        weighed = materialize(Tfidf(self.vocab).weigh(self.bags, key).select(F.col(key).alias("row"), "term", "weight"), "linear-weights")
        length = weighed.groupBy("row").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_n"))
        return materialize(weighed.join(length, "row").select("row", "term", (F.col("weight") / F.col("_n")).alias("x")), "linear-entries")

    @cached_property
    def by_row(self) -> DataFrame:
        return self.entries.union(self.bags.select(F.col(self.key), F.lit(BIAS), F.lit(1.0)))

    @cached_property
    def rows(self) -> DataFrame:
        number = reduce(lambda c, p: c.when(F.col("_class") == p[1][0], p[0]), enumerate(self.sizes), F.when(F.lit(False), -1))
        return materialize(self.bags.select(F.col(self.key).alias("row"), number.alias("y")), "linear-rows")

    @cached_property
    def blocks(self) -> Blocks:
        return pack_entries(self.entries)


def fit_entries(df: DataFrame, key: str = "row_id", label: str = "intent", text: str = "text") -> Entries:
    """TF-IDF over the whole vocabulary of all labelled rows; both linear models are fitted on it."""
    rows = df.select(key, F.col(label).cast("string").alias("_class"), F.col(text).alias("_doc")).where("_class is not null and _doc is not null")
    held = rows.groupBy("_class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("_doc").cast("bigint")).alias("chars")).collect()
    sizes = sorted((r["_class"], r["n"]) for r in held)
    found = Entries(rows, key, sizes)
    total, chars = sum(n for _, n in sizes), sum(r["chars"] for r in held)
    if whole_keys(rows, key) and total * len(sizes) <= LOCAL_NUMBERS:
        found.packed = Packed.build(rows, key, [label for label, _ in sizes], total, chars)
    else:
        found.by_row, found.rows, found.blocks  # noqa: B018 - made once, before fits run side by side
    return found


def fit_linear(entries: Entries, name: str, c: float = 1.0, tolerance: float = TOLERANCE, most: int = MOST_STEPS) -> LinearModel:
    """``logreg``: multinomial, balanced class weights, free bias. ``svm``: squared hinge, one class against the others."""
    k, total = len(entries.sizes), sum(n for _, n in entries.sizes)
    balanced = [total / (k * n) if name == "logreg" else 1.0 for _, n in entries.sizes]
    labels = [label for label, _ in entries.sizes]
    if entries.packed:
        packed = entries.packed
        numbers, fit = minimise_here(packed, np.array(balanced)[packed.y], k, LOCAL_LOSSES[name], c, name == "logreg", tolerance, most)
        about = {"converged": fit.converged, "objective": float(fit.objective), "gradient": fit.gradient, "steps": fit.steps}
        return LinearModel(name, packed.weights(numbers), [float(b) for b in fit.bias], labels, about, (packed, numbers))
    weight = F.element_at(F.array(*[F.lit(float(b)) for b in balanced]), F.col("y") + 1)
    rows = entries.rows.withColumn("weight", weight)
    fit = minimise(entries.blocks, rows, k, LOSSES[name], c, name == "logreg", tolerance, most)
    weights = entries.by_row.where(F.col("term") != BIAS).join(fit.numbers, "row").groupBy("term").agg(*[F.expr(f"sum(x * a{j}) AS w{j}") for j in range(k)])
    terms = materialize(entries.vocab.join(weights, "term"), f"linear-{name}")
    about = {"converged": fit.converged, "objective": float(fit.objective), "gradient": fit.gradient, "steps": fit.steps}
    return LinearModel(name, terms, [float(b) for b in fit.bias], labels, about)
