"""Document fingerprints by winnowing, in column expressions only.

The words of a text, in lower case, are hashed; every run of ``k`` words gets a hash, and of each window
of ``w`` neighbouring runs the least hash is kept, the rightmost one on ties, with its position. Texts
that share a passage of ``k + w - 1`` words share a kept hash, and no match shorter than ``k`` words
counts. A text with fewer than ``k`` words is one run, one with fewer than ``w`` runs one window. The
order of hashes is that of their first 33 bits, so that hash and position fit one BIGINT.

Null and empty texts, and texts without words, have an empty fingerprint; two empty ones are alike
(1.0), an empty one and another are not (0.0). Equal texts have equal fingerprints. Repeated rows are
documents of their own, ordered by id, then by text. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterlake.llm.tables import lean, let, read, words

GRAM = 5
WINDOW = 16
PLACE_BITS = 30


def gram_hashes(text: Column, k: int = GRAM) -> Column:
    """Hashes of all runs of ``k`` words, in order."""

    def runs(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(hashes) - F.lit(k - 1), F.lit(1)))
        rolled = F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, F.lit(k))))
        return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(rolled)

    return let(F.transform(words(F.lower(text)), lambda w: F.xxhash64(w)), runs)


def winnow(text: Column, k: int = GRAM, w: int = WINDOW) -> Column:
    """``array<struct<hash, place>>``: the kept runs by place, a place being a word number from 0."""
    last = (1 << PLACE_BITS) - 1

    def ranks(hashes: Column) -> Column:
        # Least hash first, then the greatest place: one number that a plain minimum compares.
        return F.transform(
            hashes, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, PLACE_BITS + 1), PLACE_BITS) + (F.lit(last) - i).cast("bigint")
        )

    def minima(ranked: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(ranked) - F.lit(w - 1), F.lit(1)))
        least = F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(ranked, i, F.lit(w)))))
        return F.when(F.size(ranked) == 0, F.array().cast("array<bigint>")).otherwise(least)

    def kept(hashes: Column) -> Column:
        places = F.transform(let(ranks(hashes), minima), lambda r: (F.lit(last) - r.bitwiseAND(F.lit(last))).cast("int"))
        return F.transform(places, lambda p: F.struct(F.get(hashes, p).alias("hash"), p.alias("place")))

    return let(gram_hashes(text, k), kept)


def written(fingerprint: Column) -> Column:
    """``hash:place`` of each kept run, hash in hex, joined by blanks."""
    return F.array_join(F.transform(fingerprint, lambda f: F.concat_ws(":", F.hex(f["hash"]), f["place"].cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Shared share of two sets of hashes."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def hash_set(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda f: f["hash"]))


def fingerprint(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """``doc_id, text, fingerprint`` for every row; a null text counts as empty."""
    rows = lean(docs).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("fingerprint", winnow(F.col("text"), k, w))


def range_firsts(rows: DataFrame, ranges: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``doc_id, text`` dealt to ranges of ids, and a copy of the first row of every next range.

    Ranges are cut at quantiles. With the copies, which sort last, each row finds the next one inside its
    range; the last row of all meets the first. Only the first id of each range comes to the driver.
    """
    place = F.coalesce("doc_id", F.lit(-(1 << 63)))
    shares = [n / ranges for n in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx(place, shares, 10 * ranges).alias("c")).first()["c"] if shares else None
    bounds = F.array(*[F.lit(int(c)) for c in sorted(set(cuts or []))]).cast("array<bigint>")
    placed = rows.withColumn("_place", place).withColumn("_range", F.size(F.filter(bounds, lambda b: b < F.col("_place"))))
    firsts = sorted(placed.groupBy("_range").agg(F.min("_place").alias("p")).collect())
    heads = [(firsts[(n + 1) % len(firsts)]["p"], f["_range"]) for n, f in enumerate(firsts)]
    named = rows.sparkSession.createDataFrame(heads, "_place bigint, _to int")
    found = placed.join(F.broadcast(named), "_place").groupBy("_to").agg(F.min(F.struct("_place", "text", "doc_id")).alias("_f"))
    copies = found.select("_f.doc_id", "_f.text", "_f._place", F.col("_to").alias("_range"), F.lit(True).alias("_copy"))
    return placed.withColumn("_copy", F.lit(False)), copies


def with_next(docs: DataFrame, ranges: int, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """``fingerprint`` rows with ``next_text`` and ``next_fingerprint`` of the following document."""
    rows = lean(docs).withColumn("text", F.coalesce("text", F.lit("")))
    placed, copies = range_firsts(rows, ranges)
    both = placed.unionByName(copies).withColumn("fingerprint", winnow(F.col("text"), k, w))
    inside = Window.partitionBy("_range").orderBy("_copy", "_place", "text")
    led = both.select("*", *[F.lead(c).over(inside).alias(f"next_{c}") for c in ("text", "fingerprint")])
    return led.where(~F.col("_copy")).drop("_place", "_range", "_copy")


def edited(text: str = "text", other: str = "next_text") -> Column:
    """The text with its last quarter replaced by as much of the other text's start."""
    cut = f"cast(floor(length({text}) / 4) as int)"
    return F.expr(f"concat(substring({text}, 1, length({text}) - {cut}), substring({other}, 1, {cut}))")


def op7_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    paired = with_next(read(spark, sf_dir, "documents"), ranges).withColumn("_edited", edited())
    marked = paired.withColumn("edited_fingerprint", winnow(F.col("_edited")))
    return marked.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        written(F.col("fingerprint")).alias("fingerprint"),
        written(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(hash_set(F.col("fingerprint")), hash_set(F.col("edited_fingerprint"))).alias("near_edited"),
        likeness(hash_set(F.col("fingerprint")), hash_set(F.col("next_fingerprint"))).alias("near_next"),
    )
