"""Exact k-means in integers by Shallot search.

A vector keeps an upper bound of the distance to its centroid, the number of its second-nearest centroid and
a lower bound of the distance to every centroid but its own. A vector whose upper bound lies below its lower
bound, or below half the way from its centroid to the next one, stays without a look at its components. A
survivor starts from the closer one of its own and its remembered second centroid. Other centroids lie in a
ball around that one: its neighbours, sorted by distance, are tried until they are farther away than the
distance to it plus the distance to the second-best one found, and the ball shrinks with every better find.
Distances that decide are squared integers; bounds are rounded outwards by ``SLACK``.

A pass reads the vectors with their bounds and writes them again; sums for new centroids are added up in the
tasks, so a row for each task and cluster is shuffled and only ``k`` rows reach the driver. No vector is shuffled, so no
cluster can be too large. Each pass is a written table: a lost executor costs its part of one pass.

Rows whose embedding is null, has another length, or has a null or non-finite component are left out. A
component becomes ``floor(scale * x)``; one of ``LARGEST`` or more ends the job, since squared distances must fit in 64 bits. Repeated
rows and ids stay rows. A null id comes last in the order of first centroids; equal hashes are ordered by
components. Fewer vectors than ``k`` give fewer centroids, an empty table an empty result; extra columns are
left out.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.llm.tables import read
from utterlake.session import materialize

WIDTH = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
SEED = 2
#: Components below this one leave room for the sum of squares of up to 64 differences.
LARGEST = 1 << 27
SLACK = 1e-9
#: Vectors compared at once.
STEP = 8192


def whole_numbers(width: int, scale: int):
    """Rows ``vec_id, v`` of the vectors that are kept."""

    def run(batches):
        for batch in batches:
            lists = batch.column("embedding")
            long_enough = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == width
            rows = batch.filter(pa.array(long_enough))
            values = rows.column("embedding").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
            good = np.isfinite(values).all(axis=1)
            found = np.floor(scale * values[good])
            if len(found) and np.abs(found).max() >= LARGEST:
                raise ValueError(f"a component reaches {LARGEST}: squared distances may not fit in 64 bits")
            ids = rows.column("vec_id").filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([ids, _lists(found.astype(np.int32))], names=["vec_id", "v"])

    return run


def _lists(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] if rows.ndim == 2 else 0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows.reshape(-1), pa.int32()))


def _vectors(batch, width: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


class Centroids:
    """Centroids with their distances: each one's others by distance, and the way to the next one."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows
        k = len(rows)
        squares = np.stack([((rows - c) ** 2).sum(axis=1) for c in rows]) if k else np.zeros((0, 0), np.int64)
        own = squares.copy()
        np.fill_diagonal(own, -1)
        self.near = np.argsort(own, axis=1, kind="stable")[:, 1:]
        self.far = np.sqrt(np.take_along_axis(squares, self.near, axis=1).astype(float)) if k > 1 else np.zeros((k, 0))
        self.next = self.far[:, 0] if k > 1 else np.full(k, np.inf)

    def squared(self, vectors: np.ndarray, which: np.ndarray) -> np.ndarray:
        gap = vectors - self.rows[which]
        return np.einsum("ij,ij->i", gap, gap)


def shallot(vectors: np.ndarray, c: Centroids, own: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """The nearest centroid (smallest number on ties) of each vector from bounded guesses: ``own, second, upper, lower``, and how many distances were needed.

    ``own`` and ``second`` differ; ``upper`` bounds the distance to ``own`` from above, ``lower`` that to all others from below.
    """
    own, second, upper, lower = own.copy(), second.copy(), upper.copy(), lower.copy()
    if len(c.rows) == 1 or not len(vectors):
        return own, second, upper, lower, 0
    limit = np.maximum(lower, c.next[own] / 2)
    live = np.flatnonzero(upper * (1 + SLACK) >= limit)
    exact = c.squared(vectors[live], own[live])
    needed = len(live)
    upper[live] = np.sqrt(exact) * (1 + SLACK)
    open_ = upper[live] >= limit[live] * (1 - SLACK)
    live, first = live[open_], exact[open_]
    if not len(live):
        return own, second, upper, lower, needed
    x = vectors[live]
    a, b = own[live], second[live]
    other = c.squared(x, b)
    needed += len(live)
    swap = (other < first) | ((other == first) & (b < a))
    best, best_d = np.where(swap, b, a), np.where(swap, other, first)
    next_, next_d = np.where(swap, a, b), np.where(swap, first, other)
    centre, reach = best.copy(), np.sqrt(best_d.astype(float))
    seen = next_.copy()
    scan = np.arange(len(live))
    for place in range(c.near.shape[1]):
        # The ball is as wide as the way to its centre and to the second-best centroid found so far.
        inside = c.far[centre[scan], place] <= (reach[scan] + np.sqrt(next_d[scan].astype(float))) * (1 + SLACK)
        scan = scan[inside]
        if not len(scan):
            break
        who = c.near[centre[scan], place]
        fresh = who != seen[scan]
        rows, who = scan[fresh], who[fresh]
        d = c.squared(x[rows], who)
        needed += len(rows)
        wins = (d < best_d[rows]) | ((d == best_d[rows]) & (who < best[rows]))
        w = rows[wins]
        next_[w], next_d[w] = best[w], best_d[w]
        best[w], best_d[w] = who[wins], d[wins]
        close = ~wins & (d < next_d[rows])
        w = rows[close]
        next_[w], next_d[w] = who[close], d[close]
    own[live], second[live] = best, next_
    upper[live] = np.sqrt(best_d.astype(float)) * (1 + SLACK)
    lower[live] = np.sqrt(next_d.astype(float)) * (1 - SLACK)
    return own, second, upper, lower, needed


def assigned(rows: np.ndarray, drift: np.ndarray | None, width: int):
    """Vectors with their bounds under centroids ``rows``, which moved by ``drift`` since the bounds were written."""

    def run(batches):
        c = Centroids(rows)
        for batch in batches:
            for low in range(0, batch.num_rows, STEP):
                part = batch.slice(low, STEP)
                vectors = _vectors(part, width)
                n = len(vectors)
                if drift is None:
                    own, second = np.zeros(n, np.int64), np.full(n, min(1, len(rows) - 1))
                    upper, lower = np.full(n, np.inf), np.zeros(n)
                else:
                    own, second = (part.column(name).to_numpy().astype(np.int64) for name in ("cluster", "second"))
                    # A centroid's own way, and the longest way of all others.
                    order = np.argsort(-drift, kind="stable")
                    others = np.full(len(drift), drift[order[0]])
                    others[order[0]] = drift[order[1]] if len(drift) > 1 else 0.0
                    upper = part.column("upper").to_numpy() + drift[own]
                    lower = part.column("lower").to_numpy() - others[own]
                own, second, upper, lower, _ = shallot(vectors, c, own, second, upper, lower)
                columns = [part.column("vec_id"), part.column("v"), pa.array(own.astype(np.int32)), pa.array(second.astype(np.int32))]
                columns += [pa.array(upper), pa.array(lower), pa.array(c.squared(vectors, own))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "cluster", "second", "upper", "lower", "distance"])

    return run


def summed(k: int, width: int):
    """One row for each cluster of a task: members, distances and componentwise sums."""

    def run(batches):
        count, total, sums = np.zeros(k, np.int64), np.zeros(k, object), np.zeros((k, width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("cluster").to_numpy()
            order = np.argsort(own, kind="stable")
            found, begin = np.unique(own[order], return_index=True)
            sums[found] += np.add.reduceat(_vectors(batch, width)[order], begin, axis=0)
            count += np.bincount(own, minlength=k)
            distance = batch.column("distance").to_numpy()[order]
            # A batch's sum may pass 64 bits, so halves of the numbers are added apart.
            high, low = np.add.reduceat(distance >> 32, begin), np.add.reduceat(distance & 0xFFFFFFFF, begin)
            for cluster, h, l in zip(found.tolist(), high.tolist(), low.tolist(), strict=True):
                total[cluster] += (h << 32) + l
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(held.astype(np.int32)),
                pa.array(count[held]),
                pa.array([Decimal(int(t)) for t in total[held]], pa.decimal128(38, 0)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * width, pa.int32()), pa.array(sums[held].reshape(-1))),
            ],
            names=["cluster", "n", "distance", "sums"],
        )

    return run


def cluster_sums(state: DataFrame, k: int, width: int) -> list:
    """``cluster, n, distance, sums`` of each cluster that has vectors: at most ``k`` rows."""
    parts = state.mapInArrow(summed(k, width), "cluster int, n long, distance decimal(38,0), sums array<long>")
    wide = parts.select("cluster", "n", "distance", F.posexplode("sums").alias("place", "s"))
    added = wide.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("distance").alias("distance"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    rows = added.groupBy("cluster").agg(F.max("n").alias("n"), F.max("distance").alias("distance"), F.array_sort(F.collect_list(F.struct("place", "s"))).alias("sums"))
    return [(r["cluster"], int(r["n"]), int(r["distance"]), [int(s["s"]) for s in r["sums"]]) for r in rows.collect()]


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of seed and id."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(name.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster_vectors(
    embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH, scale: int = SCALE
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256`` of every vector that is kept."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    vectors = materialize(rows.mapInArrow(whole_numbers(width, scale), "vec_id long, v array<int>"), "whole-vectors")
    centroids, drift, state = first_centroids(vectors, k, seed), None, vectors
    schema = "vec_id long, v array<int>, cluster int, second int, upper double, lower double, distance long"
    if not len(centroids):
        about = spark.createDataFrame([], "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).join(about, "cluster")
    for turn in range(rounds + 1):
        state = materialize(state.mapInArrow(assigned(centroids, drift, width), schema), "bounded-vectors")
        found = cluster_sums(state, len(centroids), width)
        if turn < rounds:
            moved = centroids.copy()
            for cluster, n, _, sums in found:
                moved[cluster] = [s // n for s in sums]
            drift = np.sqrt(((moved - centroids) ** 2).sum(axis=1).astype(float)) * (1 + SLACK)
            centroids = moved
    inertia = sum(distance for _, _, distance, _ in found)
    about = []
    for cluster, _, distance, _ in found:
        centroid = centroids[cluster].tolist()
        digest = hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
        about.append((cluster, distance, inertia, centroid, digest))
    # One row for each of at most k clusters.
    table = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(table), "cluster")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster_vectors(read(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    pick = "min_by(c, (d, c))"
    square = "list_sum(list_transform(list_zip(v.v, m.m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    ctes = [
        f"""v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {WIDTH})""",
        f"""m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m
    FROM (SELECT sha256('{SEED}:' || vec_id::VARCHAR) AS h, v FROM v ORDER BY h, v LIMIT {CLUSTERS}))""",
    ]
    for n in range(ROUNDS + 1):
        ctes.append(
            f"""a{n} AS MATERIALIZED (SELECT r, {pick} AS c, min(d) AS d
    FROM (SELECT v.r, m.c, {square} AS d FROM v, m{n} m) GROUP BY r)"""
        )
        if n < ROUNDS:
            ctes.append(
                f"""s{n} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS k
    FROM (SELECT a.c, unnest(range(1, {WIDTH + 1})) AS i, unnest(v.v) AS x FROM a{n} a JOIN v USING (r)) GROUP BY c, i)"""
            )
            ctes.append(
                f"""m{n + 1} AS MATERIALIZED (SELECT m.c, coalesce(t.m, m.m) AS m FROM m{n} m LEFT JOIN
    (SELECT c, list((s - ((s % k) + k) % k) // k ORDER BY i) AS m FROM s{n} GROUP BY c) t USING (c))"""
            )
    last = ROUNDS
    return (
        "WITH "
        + ",\n".join(ctes)
        + f"""
SELECT v.vec_id, a.c::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
    (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m.m, ',')) AS centroid_sha256
FROM v JOIN a{last} a USING (r) JOIN m{last} m ON m.c = a.c"""
    )


SQL = _sql()
