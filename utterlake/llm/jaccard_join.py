"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersection of sorted arrays.

A document is the set of its distinct runs of ``size`` words (A-Z lowered), hashed to 64 bits; two
documents link when ``100 * common >= percent * union``. The result is exact up to hash collisions.

* Documents with equal sets are one node. Texts are dealt to blocks; one exchange of the texts serves
  both passes over them.
* Tiles. Sets that link share a number of their first runs in any common order (``prefixes``), and their
  sizes differ by no more than the threshold. Two sets that share a hundred of these runs need not meet a
  hundred times: the sets of a run are named by two min-hashes over them, so runs that about the same sets
  hold have one name, and a tile is one such name and one band of sizes. Sets of a run are always in one
  tile together; a set lies in the tiles of its band and of the next one, if enough of its first runs are
  shared at all. The order is by hash, with runs last that occur in many documents of a sample: this
  decides how large tiles get, never which pairs are found.
* Links inside a tile are followed, not listed: in each turn a component is compared with the likeliest of
  a few sets of its tiles that are not in it yet, until few turn out to link. Then every pair of a tile
  that is still in two components is compared; large tiles are cut into blocks, and each pair of blocks is
  a key of its own, and a pair is made in the first tile that it shares. Pairs inside a component need no
  comparison, so a group of thousands of near copies costs a few pairs for each of them.
* A pair is bounded by its signatures: a bit set in one and not in the other is a run that they do not
  share. Bitmaps of a fixed size keep most pairs from being made, bitmaps with four bits or more for each run of
  the tile's largest set nearly all others, and only pairs that may still link load their sorted arrays.

Null texts and texts without words have an empty set, link with nothing and are their own component.
A text with fewer words than ``size`` is one run. Repeated rows stay rows and share their component.
An empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utterlake.llm.components import components
from utterlake.llm.grams import Words, inside, mix, runs
from utterlake.llm.tables import keyed_table, lean, read, text_parts
from utterlake.session import materialize, scratch_path, scratch_scope

SIZE = 5
PERCENT = 75
BLOCK_CHARS = 4_000_000
#: One of so many documents is read to find frequent runs; only the order of runs depends on it.
SAMPLE = 32
FREQUENT = 6
MOST_FREQUENT = 1 << 16
#: Linked sets share one run for each so many runs among their first ones.
AGREED_OF = 16
#: Numbers of 64 bits in the signature that travels with the sets of a tile.
SHORT_WORDS = 8
#: Sets of a tile that its other sets are compared with in a turn; turns end when fewer than one pair in WORTH links.
PIVOTS, WORTH = 4, 20
#: Tiles of a set, the first ones, that tell whether a pair was already met in one of them.
FIRST_TILES = 16
#: Sets of a block, when a tile is cut into pairs of blocks.
TILE_BLOCK = 4_000


def block_sets(table, size: int):
    """Sorted distinct runs of each row, as one array with offsets, and a digest of each set."""
    words = Words(table["text"])
    hashes = words.hashes(lower=True)
    whole = inside(words, size)
    row, grams = words.row()[: len(whole)][whole], runs(hashes, size)[whole]
    for n in range(1, size):
        short = np.flatnonzero(words.counts == n)
        if len(short):
            row = np.concatenate([row, short])
            grams = np.concatenate([grams, runs(hashes, n, n)[words.first[short]]])
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
    row, grams = row[new], grams[new]
    at = np.searchsorted(row, np.arange(words.rows + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams), dtype=np.uint64)])
    digest = mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)
    return row, grams, at, digest


def spare(n, percent: int):
    """How many runs of a set of n runs a linked set may lack, at most."""
    return n - (-(-(percent * n) // 100))


def agreed(n):
    """How many of the first runs two sets must have in common if the smaller one has n runs."""
    return 1 + n // AGREED_OF


def prefixes(row, grams, at, percent: int, frequent):
    """Which runs are among the first ``spare(n) + agreed(n)`` of their set, frequent ones last.

    The first runs that two linked sets have in common, as many as the smaller set asks for, stand there in both.
    """
    n = np.diff(at)
    length = spare(n, percent) + agreed(n)
    late = np.isin(grams, frequent)
    order = np.lexsort((grams, late, row))
    rank = np.arange(len(grams)) - at[row[order]]
    out = np.zeros(len(grams), bool)
    out[order] = rank < length[row[order]]
    return out


def sample_runs(size: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                _, grams, _, _ = block_sets(pa.Table.from_batches([batch]), size)
                found, counts = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts, pa.int64())], names=["run", "n"])

    return run


def frequent_runs(docs: DataFrame, size: int) -> list[int]:
    """Runs found in many documents of the sample, at most ``MOST_FREQUENT`` of them."""
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(size)), F.lit(SAMPLE)) == 0).select("text")
    counted = some.mapInArrow(sample_runs(size), "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))
    top = counted.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "run").limit(MOST_FREQUENT)
    return [r["run"] for r in top.collect()]


def run_rows(size: int, percent: int, frequent):
    def run(key, table):
        row, grams, at, digest = block_sets(table, size)
        first = prefixes(row, grams, at, percent, frequent)
        grams, owner = grams[first], digest[row[first]]
        order = np.lexsort((owner, grams))
        grams, owner = grams[order], owner[order]
        # Of all sets that hold a run here, the first and the last: enough to see whether it is shared.
        same = grams[1:] == grams[:-1]
        head, tail = np.append(True, ~same)[: len(grams)], np.append(~same, True)[: len(grams)]
        head_owner = owner[np.maximum.accumulate(np.where(head, np.arange(len(grams)), 0))] if len(grams) else owner
        use = head | (tail & (owner != head_owner))
        block = pa.array(np.full(int(use.sum()), key[0].as_py(), np.int64))
        return pa.table({"run": pa.array(grams[use].view(np.int64)), "block": block, "owner": pa.array(owner[use])})

    return run


def band_of(n, percent: int):
    """The band of sizes; sets that may link lie in one band or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / percent) + 1e-9).astype(np.int32)


def band_words(band: int, percent: int) -> int:
    """Numbers of 64 bits in the bitmaps of a band: a power of two, four bits at least for each run of its largest set."""
    largest = (100 / percent) ** (band + 1)
    return max(SHORT_WORDS, 1 << max(0, int(np.ceil(np.log2(4 * largest / 64)))))


def bitmap(places, words: int):
    """Bits at ``places`` (modulo the size) as ``words`` numbers of 64 bits; a longer bitmap folds into a shorter one by OR of its halves."""
    flags = np.zeros(64 * words, bool)
    flags[(places % np.uint64(64 * words)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view(np.int64)


def set_rows(size: int, percent: int, frequent):
    def run(key, table, shared):
        row, grams, at, digest = block_sets(table, size)
        wanted = np.unique(shared["run"].to_numpy()).view(np.uint64)
        first = np.flatnonzero(prefixes(row, grams, at, percent, frequent))
        hit = first[np.isin(grams[first], wanted)]
        _, one = np.unique(digest, return_index=True)
        n = np.diff(at)
        enough = np.bincount(row[hit], minlength=len(n)) >= agreed(-(-(percent * n) // 100))
        lead = np.zeros(len(digest), bool)
        lead[one] = True
        lead &= enough & (n > 0)
        tiles, sets, signs, short, half = [], [], [], [], []
        bands = band_of(n, percent)
        begin, end = np.searchsorted(row[hit], np.arange(len(n))), np.searchsorted(row[hit], np.arange(1, len(n) + 1))
        for k in range(len(n)):
            own, band = grams[at[k] : at[k + 1]], int(bands[k])
            # As long as the next band asks for; sets are folded for their own band if that takes half.
            words = band_words(band + 1, percent)
            tiles.append(grams[hit[begin[k] : end[k]]].view(np.int64) if lead[k] else None)
            sets.append(own.view(np.int64) if lead[k] else None)
            signs.append(bitmap(own, words) if lead[k] else None)
            short.append(bitmap(own >> np.uint64(40), SHORT_WORDS) if lead[k] else None)
            half.append(band_words(band, percent) < words)
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "node": pa.array(digest),
                "n_shingles": pa.array(n.astype(np.int64)),
                "band": pa.array(bands),
                "tiles": pa.array(tiles, pa.list_(pa.int64())),
                "runs": pa.array(sets, pa.list_(pa.int64())),
                "bits": pa.array(signs, pa.list_(pa.int64())),
                "half": pa.array(half, pa.bool_()),
                "short": pa.array(short, pa.list_(pa.int64())),
            }
        )

    return run


def bounded(percent: int):
    """Keeps pairs whose signatures allow a link."""

    def may(one, two, a, b):
        while len(one) > len(two):
            one = one[: len(one) // 2] | one[len(one) // 2 :]
        while len(two) > len(one):
            two = two[: len(two) // 2] | two[len(two) // 2 :]
        both = int(np.bitwise_count(one & two).sum())
        common = min(a - int(np.bitwise_count(one).sum()) + both, b - int(np.bitwise_count(two).sum()) + both)
        return 100 * common >= percent * (a + b - common)

    def run(batches):
        for batch in batches:
            sizes = zip(batch.column("a_n").to_pylist(), batch.column("b_n").to_pylist(), strict=True)
            signs = zip(batch.column("a_bits"), batch.column("b_bits"), strict=True)
            views = ((a.values.to_numpy().view(np.uint64), b.values.to_numpy().view(np.uint64)) for a, b in signs)
            keep = [may(*pair, *size) for pair, size in zip(views, sizes, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def exact(percent: int):
    """Keeps pairs that link, by intersection of their sorted arrays."""
    def run(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("a_runs"), batch.column("b_runs"), strict=True):
                one, two = left.values.to_numpy(), right.values.to_numpy()
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * common >= percent * (len(one) + len(two) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _side(nodes: DataFrame, side: str, *columns: str) -> DataFrame:
    return nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])


def linked(pairs: DataFrame, nodes: DataFrame, percent: int, signed: bool = False) -> DataFrame:
    """The pairs ``a, b`` that link: bounded by signatures unless ``signed``, then compared exactly."""
    near = pairs
    if not signed:
        both = pairs.join(_side(nodes, "a", "n", "bits"), "a").join(_side(nodes, "b", "n", "bits"), "b")
        near = materialize(both.mapInArrow(bounded(percent), "a long, b long"), "near-pairs")
    full = near.join(_side(nodes, "a", "runs"), "a").join(_side(nodes, "b", "runs"), "b")
    return materialize(full.mapInArrow(exact(percent), "a long, b long"), "links")


def distinct_tiles(rows: DataFrame) -> DataFrame:
    """Tiles ``tile, band, home, node, n`` from ``node, n, band, run``: runs that about the same sets hold make one tile, runs of one set none.

    ``home`` sets are of the tile's own band. Pairs without one are in the tile of the band before.
    """
    names = [F.min(F.xxhash64("node", F.lit(k))).alias(f"_m{k}") for k in range(2)]
    held = rows.groupBy("run").agg(F.count(F.lit(1)).alias("_n"), *names).where("_n > 1").select("run", F.xxhash64("_m0", "_m1").alias("_name"))
    members = rows.join(held, "run").select("_name", "node", "n", "band").distinct()
    placed = members.select("_name", "node", "n", F.posexplode(F.array("band", F.col("band") + 1)).alias("_next", "band"))
    return materialize(placed.select(F.xxhash64("_name", "band").alias("tile"), "band", (F.col("_next") == 0).alias("home"), "node", "n"), "tiles")


def may_link(common: str, percent: int) -> str:
    """Whether sets x and y may link if they share no more runs than ``common``."""
    return f"{100 + percent} * {common} >= {percent} * (x.n + y.n)"


def _placed(tiles: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Tile rows with the component of each set, so far."""
    if labels is None:
        return tiles.withColumn("component", F.col("node"))
    named = labels.withColumnRenamed("component", "_c")
    return tiles.join(named, "node", "left").withColumn("component", F.coalesce("_c", "node")).drop("_c")


def _open(rows: DataFrame) -> DataFrame:
    """Rows of tiles whose sets lie in two components or more, with the number of sets ``held``; tiles without a set of their own band are left out."""
    own = F.max("home") if "home" in rows.columns else F.lit(True)
    ends = rows.groupBy("tile").agg(F.min("component").alias("l"), F.max("component").alias("h"), F.count(F.lit(1)).alias("held"), own.alias("own"))
    ends = ends.where("l <> h AND own")
    return rows.drop("held").join(ends.select("tile", "held"), "tile")


def _best_pairs(rows: DataFrame, nodes: DataFrame, turn: int, percent: int) -> DataFrame:
    """For each component the pair ``a, b`` with a few sets of its tiles, others in each turn, that its signature likes best."""
    compatible = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND x.component <> y.component"
    salts = [F.struct(F.xxhash64("node", F.lit(PIVOTS * turn + k)).alias("h"), "component", "n", "node") for k in range(PIVOTS if turn else 1)]
    some = rows.groupBy("tile").agg(F.array(*[F.min(salt) for salt in salts]).alias("p"))
    some = some.select("tile", F.explode("p").alias("p")).select("tile", "p.component", "p.n", "p.node")
    met = rows.alias("x").join(some.alias("y"), "tile").where(compatible)
    pairs = met.select(F.col("x.component").alias("c"), F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    signed = pairs.join(_side(nodes, "a", "n", "short"), "a").join(_side(nodes, "b", "n", "short"), "b")
    words = [F.get(f"{side}_short", F.lit(k)).alias(f"{side}{k}") for side in "ab" for k in range(SHORT_WORDS)]
    split = signed.select("c", "a", "b", "a_n", "b_n", *words)
    lacks = {s: " + ".join(f"bit_count({s}{k} & ~{t}{k})" for k in range(SHORT_WORDS)) for s, t in ("ab", "ba")}
    score = F.expr(f"least(a_n - ({lacks['a']}), b_n - ({lacks['b']})) / greatest(a_n, b_n)")
    return split.groupBy("c").agg(F.max(F.struct(score.alias("s"), "a", "b")).alias("p")).select("p.a", "p.b")


def open_pairs(rows: DataFrame, nodes: DataFrame, percent: int, block: int = TILE_BLOCK) -> DataFrame:
    """Pairs ``a, b`` of sets of one tile in two components whose bitmaps allow a link, from rows of ``_open``."""
    return _meetings(rows, nodes, percent, block).distinct()


def _meetings(rows: DataFrame, nodes: DataFrame, percent: int, block: int) -> DataFrame:
    """``open_pairs``; a pair comes once, unless its sets have more than ``FIRST_TILES`` tiles of a band."""
    # Tiles of one band that come before a row's own one: a pair that shares one of them is made there.
    firsts = rows.groupBy("node", "band").agg(F.slice(F.array_sort(F.collect_set("tile")), 1, FIRST_TILES).alias("firsts"))
    rows = rows.join(firsts, ["node", "band"]).withColumn("before", F.filter("firsts", lambda t: t < F.col("tile")))
    signed = rows.join(nodes.select("node", "short", "bits", "half"), "node")
    count = F.size("bits") / 2
    halves = [F.slice("bits", start, count.cast("int")) for start in (F.lit(1), (count + 1).cast("int"))]
    folded = F.zip_with(*halves, lambda a, b: a.bitwiseOR(b))
    wide = F.when(F.col("home") & F.col("half"), folded).otherwise(F.col("bits"))
    words = [F.get("short", F.lit(k)).alias(f"s{k}") for k in range(SHORT_WORDS)]
    ones = F.aggregate("wide", F.lit(0), lambda s, v: s + F.bit_count(v))
    signed = signed.select("tile", "home", "node", "n", "component", "held", "before", *words, wide.alias("wide")).withColumn("ones", ones)
    signed = signed.withColumn("short_ones", F.expr(" + ".join(f"bit_count(s{k})" for k in range(SHORT_WORDS))))
    # A tile of many sets is dealt to blocks; a set goes to each pair of blocks that holds its own.
    parts = F.ceil(F.col("held") / block)
    signed = signed.withColumn("own", F.pmod(F.xxhash64("node", "tile"), parts))
    other = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other")
    dealt = signed.select("*", other).withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))
    dealt = materialize(dealt.drop("other", "held", "short", "bits"), "open-sets")
    compatible = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND x.component <> y.component AND (x.home OR y.home) AND (x.p = x.q OR x.own <> y.own)"
    near = " + ".join(f"bit_count(x.s{k} & y.s{k})" for k in range(SHORT_WORDS))
    least = may_link(f"least(x.n - x.short_ones + {near}, y.n - y.short_ones + {near})", percent)
    full = "aggregate(zip_with(x.wide, y.wide, (a, b) -> bit_count(a & b)), 0, (s, v) -> s + v)"
    most = may_link(f"({full} + least(x.n - x.ones, y.n - y.ones))", percent)
    both = dealt.alias("x").join(dealt.alias("y"), ["tile", "p", "q"]).where(F.expr(f"x.node < y.node AND {compatible} AND {least} AND {most} AND NOT arrays_overlap(x.before, y.before)"))
    return both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def follow(tiles: DataFrame, nodes: DataFrame, percent: int, tile_block: int = TILE_BLOCK) -> DataFrame | None:
    """Components of all links inside tiles ``tile, band, home, node, n``: ``node, component``, or None without a link."""
    links, labels, turn = None, None, 0
    while True:
        rows = materialize(_open(_placed(tiles, labels)), "open-tiles")
        pairs = materialize(_best_pairs(rows, nodes, turn, percent), "pairs")
        found = linked(pairs, nodes, percent)
        tried, hits = pairs.count(), found.count()
        if hits:
            links = found if links is None else links.union(found)
            labels = materialize(components(links), "labels")
        # Turns go on while they link many; what is left open is compared in full.
        if hits * WORTH <= tried:
            break
        tiles, turn = rows.drop("component"), turn + 1
    rows = _open(_placed(tiles.drop("held"), labels))
    rest = linked(open_pairs(rows, nodes, percent, tile_block), nodes, percent, signed=True)
    if not rest.isEmpty():
        links = rest if links is None else links.union(rest)
        labels = materialize(components(links), "labels")
    return labels


def jaccard_components(
    docs: DataFrame, size: int = SIZE, percent: int = PERCENT, block_chars: int = BLOCK_CHARS, tile_block: int = TILE_BLOCK
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document, written to scratch; all other scratch tables are gone by then."""
    spark = docs.sparkSession
    path = scratch_path(spark, "jaccard-components")
    with scratch_scope(spark, "jaccard"):
        return materialize(_jaccard_components(docs, size, percent, block_chars, tile_block), "jaccard-components", path)


def _jaccard_components(docs: DataFrame, size: int, percent: int, block_chars: int, tile_block: int) -> DataFrame:
    rows = lean(docs)
    frequent = np.array(frequent_runs(rows, size), np.int64).view(np.uint64)
    block = F.pmod(F.xxhash64("doc_id"), F.lit(text_parts(rows, "text", block_chars))).alias("block")
    blocks = rows.select(block, "doc_id", "text")
    held = blocks.groupBy("block").applyInArrow(run_rows(size, percent, frequent), "run long, block long, owner long")
    over = Window.partitionBy("run")
    ends = held.select("run", "block", F.min("owner").over(over).alias("_l"), F.max("owner").over(over).alias("_h"))
    shared = ends.where("_l <> _h").select("block", "run")
    schema = "doc_id long, node long, n_shingles long, band int, tiles array<long>, runs array<long>, bits array<long>, half boolean, short array<long>"
    found = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(set_rows(size, percent, frequent), schema)
    sets = materialize(found, "sets")
    some = sets.where("tiles IS NOT NULL").withColumnRenamed("n_shingles", "n")
    tiles = distinct_tiles(some.select("node", "n", "band", F.explode("tiles").alias("run")).distinct())
    # Only sets that share a tile with another one are compared; they are written once, dealt by node, so that turns move pairs and not sets.
    met = tiles.join(tiles.groupBy("tile").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "tile", "left_semi")
    some = some.select("node", "n", "band", "half", "runs", "bits", "short").join(met.select("node").distinct(), "node", "left_semi")
    nodes = keyed_table(some.dropDuplicates(["node"]), "node", "set-nodes")
    labels = follow(tiles, nodes, percent, tile_block)
    lean_sets = sets.select("doc_id", "node", "n_shingles")
    if labels is None:
        named = lean_sets.withColumn("_group", F.col("node"))
    else:
        named = lean_sets.join(labels, "node", "left").withColumn("_group", F.coalesce("component", "node"))
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    least = named.where("n_shingles > 0").groupBy("_group").agg(F.min("doc_id").alias("_least"))
    return named.join(least, "_group", "left").select(
        "doc_id", "n_shingles", F.coalesce(alone, "_least").alias("component_id")
    )


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


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
SELECT doc_id, len(g)::BIGINT AS n_shingles, least_id AS component_id
FROM s JOIN (SELECT x, min(y) AS least_id FROM reach GROUP BY x) r ON r.x = s.doc_id
"""
