"""MinHash near-duplicates with sequential Bayesian verification.

A document is the set of its distinct runs of ``size`` words (A-Z lowered), hashed to 64 bits; two
documents link when ``100 * common >= percent * union``.

* Banding. ``BANDS`` keys of ``BAND_ROWS`` min-hashes each propose candidates: sets at the threshold share none with
  probability ``(1 - 0.8 ** 4) ** 32``, less than 5e-8, and more similar ones still more rarely. A key's sets are
  named by two min-hashes over them, so keys that about the same sets hold make one bucket.
* Sequential verification. A candidate pair is compared in batches of ``BATCH`` min-hashes, of which one byte
  each is kept. After m of n bytes agree the similarity's posterior, from a uniform prior, tells how likely
  it is to reach the threshold; a pair for which this is below ``MISS`` is pruned, the others see the next
  batch. For whole numbers that posterior is a binomial sum, so the least m for each n is a short table.
* Survivors are confirmed on their full sets, so every link is exact; what may be missed is a pair that no key
  proposes or that is pruned, with the chances above.
* Components. In each turn a component meets a few sets of its buckets that are not in it yet, and the likeliest pair is
  verified, until few turn out to link; then all pairs of a bucket that still lie in two components are
  compared, large buckets in pairs of blocks; there the join itself looks at the first batches, and at bitmaps
  of the sets that bound what two of them can share, so that a large group just below the threshold does not
  leave all its pairs. Pairs inside a component need no comparison, so thousands of
  copies cost a few pairs each, and no group is collected.

Null texts and texts without words have an empty set, link with nothing and are their own component. A text
with fewer words than ``size`` is one run. Repeated rows stay rows and share their component; one with the
component's id is kept. A row without an id is never the one kept, unless no row of its component has an id. An empty
table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.llm.components import components
from utterlake.llm.grams import mix
from utterlake.llm.jaccard_join import _open, _placed, _side, bitmap, block_sets, exact
from utterlake.llm.packing import _slices
from utterlake.llm.tables import keyed_table, lean, likely, read
from utterlake.session import materialize

SIZE = 4
PERCENT = 80
BANDS, BAND_ROWS = 32, 4
#: Min-hashes of a signature, compared so many at a time; eight bytes of them are one number.
HASHES, BATCH = 384, 32
#: A pair whose similarity reaches the threshold with less than this probability is pruned.
MISS = 1e-9
#: Numbers of a signature that a join compares itself: one batch, then three more.
FIRST, JOINED = BATCH // 8, BATCH // 2
PIVOTS, WORTH = 4, 20
BUCKET_BLOCK = 4_000
SLICE_CHARS = 1_000_000


def least_agreeing(percent: int, miss: float = MISS) -> list[int]:
    """For 1, 2, ... batches the least number of agreeing bytes of a pair that is not pruned.

    Bytes of different hashes agree by chance in one of 256 cases. With a uniform prior, m of n agreeing
    bytes leave a Beta(m + 1, n - m + 1) posterior, whose tail from t on is P(Binomial(n + 1, t) <= m).
    """
    t = percent / 100 + (1 - percent / 100) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, 0
        while (below := below + comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)) < miss:
            m += 1
        out.append(m)
    return out


def min_hashes(grams: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """``count`` min-hashes of each set ``grams[at[i]:at[i + 1]]``; no set may be empty."""
    out = np.empty((len(at) - 1, count), np.uint64)
    keys = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for k in range(count if len(out) else 0):
        out[:, k] = np.minimum.reduceat((grams ^ keys[2 * k]) * (keys[2 * k + 1] | np.uint64(1)), at[:-1])
    return mix(out)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    out = np.empty((len(hashes), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(hashes), band + 1, np.uint64)
        for row in range(BAND_ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + hashes[:, band * BAND_ROWS + row])
        out[:, band] = key
    return out


def set_rows(size: int):
    """Texts with the digest, size and band keys of their sets; the runs of a set have twice the bytes of its text and are not kept."""

    def run(batches):
        for batch in batches:
            for low, high in _slices(batch, SLICE_CHARS):
                part = batch.slice(low, high - low)
                _, grams, at, digest = block_sets(pa.Table.from_batches([part]), size)
                n = np.diff(at)
                full = np.flatnonzero(n)
                keys = band_keys(min_hashes(grams, np.append(at[full], at[-1]), BANDS * BAND_ROWS))
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(digest),
                        pa.array(n.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.reshape(-1).view(np.int64))),
                        part.column("text"),
                    ],
                    names=["doc_id", "node", "n_shingles", "keys", "text"],
                )

    return run


def signed(size: int):
    """``runs`` of each text, none empty, ``sign``, a byte of each of ``HASHES`` min-hashes, eight in a number, and ``wide``, a bitmap of eight bits or more for each run."""

    def run(batches):
        for batch in batches:
            for low, high in _slices(batch, SLICE_CHARS):
                part = batch.slice(low, high - low)
                _, runs, at, _ = block_sets(pa.Table.from_batches([part]), size)
                sign = (min_hashes(runs, at, HASHES) & np.uint64(0xFF)).astype(np.uint8).reshape(-1).view(np.int64)
                ends = np.arange(part.num_rows + 1) * (HASHES // 8)
                wide = [bitmap(runs[i:j], 1 << max(0, int(j - i - 1).bit_length() - 3)) for i, j in zip(at[:-1], at[1:], strict=True)]
                lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(v)) for e, v in ((at, runs.view(np.int64)), (ends, sign))]
                columns = [part.column("node"), part.column("n"), *lists, pa.array(wide, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "runs", "sign", "wide"])

    return run


def sequential(percent: int, begin: int = 0):
    """Keeps pairs ``a, b`` that no batch of their signatures prunes, from batch ``begin`` on all earlier ones counted too."""
    least = least_agreeing(percent)

    def run(batches):
        for batch in batches:
            one, two = (batch.column(n).flatten().to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, HASHES) for n in ("a_sign", "b_sign"))
            alive = np.arange(batch.num_rows)
            agree = np.zeros(batch.num_rows, np.int64)
            for turn, bound in enumerate(least):
                part = slice(turn * BATCH, (turn + 1) * BATCH)
                agree[alive] += (one[alive, part] == two[alive, part]).sum(axis=1)
                if turn >= begin:
                    alive = alive[agree[alive] >= bound]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return run


def confirmed(pairs: DataFrame, nodes: DataFrame, percent: int, begin: int = 0) -> DataFrame:
    """The pairs ``a, b`` that link: verified in batches, then on full sets."""
    both = pairs.join(_side(nodes, "a", "sign"), "a").join(_side(nodes, "b", "sign"), "b")
    near = materialize(both.mapInArrow(sequential(percent, begin), "a long, b long"), "likely-pairs")
    full = near.join(_side(nodes, "a", "runs"), "a").join(_side(nodes, "b", "runs"), "b")
    return materialize(full.mapInArrow(exact(percent), "a long, b long"), "near-links")


def buckets(leads: DataFrame) -> DataFrame:
    """Buckets ``tile, node, n`` of the band keys of ``node, n, keys``, without keys of one set."""
    rows = leads.select("node", "n", F.explode("keys").alias("key"))
    names = [F.min(F.xxhash64("node", F.lit(k))).alias(f"_m{k}") for k in range(2)]
    held = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), *names).where("_n > 1").select("key", F.xxhash64("_m0", "_m1").alias("tile"))
    held = materialize(held, "shared-keys")
    return materialize(likely(rows, held, "key").join(held, "key").select("tile", "node", "n").distinct(), "buckets")


def agreeing(first: str, second: str, numbers: range) -> str:
    """How many bytes of two signatures agree, in columns ``<side>{k}``: halves of the XOR's bytes are folded until a bit tells which differ."""
    parts = []
    for k in numbers:
        bits = f"({first}{k} ^ {second}{k})"
        for shift, mask in ((4, 0x0F), (2, 0x03), (1, 0x01)):
            bits = f"(({bits} | shiftright({bits}, {shift})) & {mask * 0x0101010101010101}L)"
        parts.append(f"bit_count({bits})")
    return f"({8 * len(numbers)} - ({' + '.join(parts)}))"


def _words(column: str, side: str, numbers: range) -> list:
    return [F.get(column, F.lit(k)).alias(f"{side}{k}") for k in numbers]


def likeliest(rows: DataFrame, nodes: DataFrame, turn: int, percent: int) -> DataFrame:
    """For each component the pair ``a, b`` with a few sets of its buckets, others in each turn, whose first batches agree most."""
    fits = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND x.component <> y.component"
    salts = [F.struct(F.xxhash64("node", F.lit(PIVOTS * turn + k)).alias("h"), "component", "n", "node") for k in range(PIVOTS if turn else 1)]
    some = rows.groupBy("tile").agg(F.array(*[F.min(salt) for salt in salts]).alias("p"))
    some = some.select("tile", F.explode("p").alias("p")).select("tile", "p.component", "p.n", "p.node")
    met = rows.alias("x").join(some.alias("y"), "tile").where(fits)
    pairs = met.select(F.col("x.component").alias("c"), F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    numbers = range(2 * FIRST)
    both = pairs.join(_side(nodes, "a", "sign"), "a").join(_side(nodes, "b", "sign"), "b")
    split = both.select("c", "a", "b", *_words("a_sign", "x", numbers), *_words("b_sign", "y", numbers))
    score = F.expr(agreeing("x", "y", numbers))
    return split.groupBy("c").agg(F.max(F.struct(score.alias("s"), "a", "b")).alias("p")).select("p.a", "p.b")


def open_pairs(rows: DataFrame, nodes: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs ``a, b`` of sets of one bucket in two components that the first batches do not prune."""
    least = least_agreeing(percent)
    numbers = range(JOINED)
    known = rows.join(nodes.select("node", "sign", "wide"), "node").select("tile", "node", "n", "component", "held", "wide", *_words("sign", "s", numbers))
    known = known.withColumn("ones", F.aggregate("wide", F.lit(0), lambda s, v: s + F.bit_count(v)))
    # A bucket of many sets is dealt to blocks; a set goes to each pair of blocks that holds its own.
    parts = F.ceil(F.col("held") / block)
    known = known.withColumn("own", F.pmod(F.xxhash64("node", "tile"), parts))
    dealt = known.select("*", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
    dealt = dealt.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).drop("other", "held")
    dealt = materialize(dealt, "open-sets")
    fits = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND x.component <> y.component AND (x.p = x.q OR x.own <> y.own)"
    one = f"{agreeing('x.s', 'y.s', range(FIRST))} >= {least[0]}"
    more = f"{agreeing('x.s', 'y.s', numbers)} >= {least[8 * JOINED // BATCH - 1]}"
    # A bit of one set that the other lacks is a run that they do not share; bitmaps of one size can tell.
    shared = "aggregate(zip_with(x.wide, y.wide, (a, b) -> bit_count(a & b)), 0, (s, v) -> s + v)"
    may = f"size(x.wide) <> size(y.wide) OR {100 + percent} * ({shared} + least(x.n - x.ones, y.n - y.ones)) >= {percent} * (x.n + y.n)"
    both = dealt.alias("x").join(dealt.alias("y"), ["tile", "p", "q"]).where(F.expr(f"x.node < y.node AND {fits} AND {one} AND {more} AND ({may})"))
    return both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def near_components(tiles: DataFrame, nodes: DataFrame, percent: int, block: int) -> DataFrame | None:
    """Components ``node, component`` of all links inside buckets, or None without a link."""
    links, labels, turn = None, None, 0
    while True:
        rows = materialize(_open(_placed(tiles, labels)), "open-buckets")
        pairs = materialize(likeliest(rows, nodes, turn, percent), "likeliest")
        found = confirmed(pairs, nodes, percent)
        tried, hits = pairs.count(), found.count()
        if hits:
            links = found if links is None else links.union(found)
            labels = materialize(components(links), "near-labels")
        if hits * WORTH <= tried:
            break
        tiles, turn = rows.drop("component", "held"), turn + 1
    rows = _open(_placed(tiles, labels))
    rest = confirmed(open_pairs(rows, nodes, percent, block), nodes, percent)
    if not rest.isEmpty():
        links = rest if links is None else links.union(rest)
        labels = materialize(components(links), "near-labels")
    return labels


def near_duplicate_groups(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, bucket_block: int = BUCKET_BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document."""
    schema = "doc_id long, node long, n_shingles long, keys array<long>, text string"
    sets = materialize(lean(docs).mapInArrow(set_rows(size), schema), "minhash-sets")
    some = sets.where("n_shingles > 0").withColumnRenamed("n_shingles", "n")
    tiles = buckets(materialize(some.select("node", "n", "keys").dropDuplicates(["node"]), "leads"))
    # One text of each set, dealt by set; its runs are made there and are not moved before they are written.
    wanted = materialize(tiles.select("node").distinct(), "met-nodes")
    met = likely(some.select("node", "n", "text"), wanted, "node").join(wanted, "node", "left_semi").dropDuplicates(["node"])
    schema = "node long, n long, runs array<long>, sign array<long>, wide array<long>"
    nodes = keyed_table(met.mapInArrow(signed(size), schema), "node", "minhash-nodes", dealt=True)
    labels = near_components(tiles, nodes, percent, bucket_block)
    rows = sets.select("doc_id", "node", "n_shingles")
    if labels is None:
        named = rows.withColumn("_group", F.col("node"))
    else:
        named = rows.join(labels, "node", "left").withColumn("_group", F.coalesce("component", "node"))
    least = named.where("n_shingles > 0").groupBy("_group").agg(F.min("doc_id").alias("_least"))
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("_least"))
    found = named.join(least, "_group", "left").select("doc_id", "n_shingles", own.alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(read(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE t AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SIZE} THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - {SIZE - 2}), lambda i: array_to_string(w[i:i + {SIZE - 1}], ' '))) END AS g FROM t
), e AS (
    SELECT doc_id, len(g) AS n, unnest(g) AS k FROM s
), links AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.k = b.k AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT doc_id, len(g)::BIGINT AS n_shingles, least_id AS component_id, doc_id = least_id AS kept
FROM s JOIN (SELECT x, min(y) AS least_id FROM reach GROUP BY x) r ON r.x = s.doc_id
"""
