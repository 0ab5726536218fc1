"""Quality rules: a threshold table compiled into one projection, without user functions.

Every text is measured by column expressions only: counts of words, characters, symbols, repeated
lines and repeated words, and shares made of them. ``THRESHOLDS`` lists the measure and the least
and the greatest value that a kept document may have; ``compile_rules`` turns the table into
Boolean columns of the same projection. No shuffle: a document is judged by itself.

Null and empty texts have no words, all counts are 0 and the base fails, so they are not kept.
Repeated rows are measured one by one. An empty table gives an empty result. Of other columns only
those named in ``keep`` stay.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.llm.tables import lean, let, read, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages that the corpus is known to hold.
STOP_WORDS = {
    "en": "a an and are as at be by for from in is it of on or that the this to was with",
    "fr": "au dans de des du elle en est et il la le les ou par pas pour que qui sur un une",
    "de": "auf das dem den der die ein eine für im in ist mit nicht sich und von zu",
    "es": "al con de del el en es la las los no para por que se su un una y",
}

#: (rule, measure, least, greatest); None is no bound.
THRESHOLDS: list[tuple[str, str, float | None, float | None]] = [
    ("word_length", "mean_word_chars", 2.5, 10.0),
    ("symbols", "symbol_ratio", None, 0.1),
    ("stop_words", "stop_ratio", 0.1, None),
    ("upper_case", "upper_ratio", None, 0.5),
    ("exclamations", "exclamation_ratio", None, 0.5),
    ("duplicate_lines", "dup_line_ratio", None, 0.4),
    ("distinct_words", "distinct_per_root", 1.5, None),
]


def repeated_words(tokens: Column, size: int = WINDOW) -> Column:
    """Words covered by windows of ``size`` words that occur twice or more in the text.

    Windows are hashed to 64 bits. Most texts repeat none, which one set of hashes shows; only in the
    others windows are sorted with their places, equal neighbours marked and the marked spans measured.
    """
    starts = F.size(tokens) - F.lit(size - 1)
    hashes = F.when(
        starts > 1, F.transform(F.sequence(F.lit(1), starts), lambda i: F.xxhash64(F.slice(tokens, i, F.lit(size))))
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(grams: Column) -> Column:
        ordered = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return let(ordered, lambda grams: let(F.array_sort(F.filter(F.transform(grams, twice(grams)), lambda p: p.isNotNull())), length))

    def twice(grams: Column):
        def place(g: Column, i: Column) -> Column:
            same = F.equal_null(g["h"], F.get(grams, i - 1)["h"]) | F.equal_null(g["h"], F.get(grams, i + 1)["h"])
            return F.when(same, g["at"])

        return place

    def length(places: Column) -> Column:
        spans = F.transform(places, lambda p, i: F.least(F.lit(size), F.coalesce(F.get(places, i + 1) - p, F.lit(size))))
        return F.aggregate(spans, F.lit(0), lambda a, b: a + b)

    return let(hashes, lambda grams: F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(covered(grams)))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def measures(tokens: Column, text: Column) -> dict[str, Column]:
    """Counts of one text, named; ``text`` is not null."""
    stops = sorted({w for line in STOP_WORDS.values() for w in line.split()})
    bare = words(F.lower(F.regexp_replace(text, "[.,;:!?]+", "")))
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit("[^\\x20\\x09-\\x0D]")))

    def of_lines(found: Column) -> Column:
        return F.struct(F.size(found).alias("n"), (F.size(found) - F.size(F.array_distinct(found))).alias("dup"))

    def of_words(found: Column) -> Column:
        stopped = F.size(F.filter(found, lambda w: w.isin(*stops)))
        return F.struct(stopped.alias("stops"), F.size(F.array_distinct(found)).alias("distinct"))

    return {
        "n_words": F.size(tokens),
        "word_chars": F.length(F.array_join(tokens, "")),
        "n_symbols": _count(text, f"[{SYMBOLS}]"),
        "n_exclamations": _count(text, "!"),
        "n_upper": _count(text, "\\p{Lu}"),
        "n_repeat_words": repeated_words(tokens),
        "_lines": let(lines, of_lines),
        "_bare": let(bare, of_words),
    }


def ratios() -> dict[str, Column]:
    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))

    words_, chars = F.col("n_words"), F.col("word_chars")
    return {
        "mean_word_chars": share(chars, words_),
        "symbol_ratio": share(F.col("n_symbols"), chars),
        "stop_ratio": share(F.col("_bare.stops"), words_),
        "upper_ratio": share(F.col("n_upper"), chars),
        "exclamation_ratio": share(F.col("n_exclamations"), words_),
        "dup_line_ratio": share(F.col("n_dup_lines"), F.col("n_lines")),
        # Divided by the root of the length, since in long texts few words are new.
        "distinct_per_root": F.coalesce(F.col("_bare.distinct") / F.sqrt(F.nullif(words_, F.lit(0))), F.lit(0.0)),
    }


def compile_rules(thresholds: Sequence[tuple[str, str, float | None, float | None]], known: Mapping[str, Column]) -> dict[str, Column]:
    """One Boolean column for each row of the table: true where the rule holds."""
    out = {}
    for rule, measure, least, greatest in thresholds:
        if measure not in known or (least is None and greatest is None):
            raise ValueError(f"rule {rule}: unknown measure {measure} or no bound")
        value, holds = F.col(measure), F.lit(True)
        if least is not None:
            holds = holds & (value >= F.lit(float(least)))
        if greatest is not None:
            holds = holds & (value <= F.lit(float(greatest)))
        out[f"ok_{rule}"] = holds
    return out


def quality_rules(
    docs: DataFrame, thresholds: Sequence[tuple[str, str, float | None, float | None]] = THRESHOLDS, keep: Sequence[str] = ()
) -> DataFrame:
    """Measures, one column for each rule, ``base_failed`` and ``kept`` for every document."""
    rows = lean(docs, keep=keep).withColumn("text", F.coalesce("text", F.lit("")))
    split = rows.withColumn("_tokens", words(F.col("text")))
    counts = {n: c if n[0] == "_" else c.cast("bigint") for n, c in measures(F.col("_tokens"), F.col("text")).items()}
    counted = split.select("doc_id", *keep, *[c.alias(n) for n, c in counts.items()])
    counted = counted.withColumns({"n_lines": F.col("_lines.n").cast("bigint"), "n_dup_lines": F.col("_lines.dup").cast("bigint")})
    shares = ratios()
    measured = counted.select("*", *[c.alias(n) for n, c in shares.items()])
    rules = compile_rules(thresholds, {n: F.col(n) for n in measured.columns})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = measured.select("*", *[c.alias(n) for n, c in rules.items()], failed.alias("base_failed"))
    kept = ~F.col("base_failed")
    for name in rules:
        kept = kept & F.col(name)
    return judged.withColumn("kept", kept).drop(*[n for n in judged.columns if n.startswith("_")])


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = quality_rules(read(spark, sf_dir, "documents"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*first)


_STOP_LIST = ", ".join(f"'{w}'" for w in sorted({w for line in STOP_WORDS.values() for w in line.split()}))
SQL = f"""
WITH t AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
), grams AS (
    SELECT r, unnest(range(1, len(w) - {WINDOW} + 2)) AS pos, w FROM t WHERE len(w) > {WINDOW}
), counted AS (
    SELECT r, pos, count(*) OVER (PARTITION BY r, array_to_string(w[pos:pos + {WINDOW - 1}], ' ')) AS n FROM grams
), spans AS (
    SELECT r, least({WINDOW}, coalesce(lead(pos) OVER (PARTITION BY r ORDER BY pos) - pos, {WINDOW})) AS span FROM counted WHERE n > 1
), repeats AS (
    SELECT r, sum(span)::BIGINT AS n_repeat_words FROM spans GROUP BY r
), lines AS (
    SELECT r, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM t
), m AS (
    SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        length(regexp_replace(text, '[^!]', '', 'g')) AS n_marks, length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) AS n_upper,
        regexp_extract_all(lower(regexp_replace(text, '[.,;:!?]+', '', 'g')), '[^\\x20\\x09-\\x0D]+') AS bare
    FROM t JOIN lines USING (r) LEFT JOIN repeats USING (r)
), judged AS (
    SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND word_chars / n_words BETWEEN 2.5 AND 10 AND n_symbols / word_chars <= 0.1
    AND len(list_filter(bare, lambda x: list_contains([{_STOP_LIST}], x))) / n_words >= 0.1
    AND n_upper / word_chars <= 0.5 AND n_marks / n_words <= 0.5 AND n_dup_lines / n_lines <= 0.4
    AND len(list_distinct(bare)) / sqrt(n_words) >= 1.5 AS kept
FROM judged
"""
