"""Substring dedup with repeated-phrase automata.

Of every window of ``window`` words that occurs more than once, the first occurrence stays (smallest id,
then smallest start) and the words of all others go. Windows are judged on the input.

1. Confirming. Documents are dealt to blocks of bounded text. Of each run of neighbouring phrases (``phrase``
   words) a window picks the one with the least hash, so equal windows pick equal phrases. A block sends every
   picked phrase once, with a mark if it was picked at two places; phrases that two blocks send, or one with
   the mark, recur. This counts over all documents, repeats inside one block and one document included.
2. Automata. The phrases that recur and that a block holds are one shard: an Aho-Corasick automaton over word
   numbers, cut so that no document need pass a shard without a phrase of its own. All documents of the block
   stream through it, and its hits alone tell which places are candidates: a window is looked at if the place
   that it picked was hit. Candidates are hashed to 128 bits and sent once for each block, and one row for each
   block carries a bit for every word, set where a candidate starts.
3. The block that holds a window's first occurrence keeps it there. To remove the others, each block reads its
   candidates from these bits: of equal ones in the block all but the first go, and the first too if another
   block has an earlier one.

A passage that a third of all rows share is one row for each block in both exchanges. No row, phrase or
window is dropped, and no task holds more than the rows of one block or the blocks of one phrase.

Null texts and texts without words give no words and nothing removed. Rows with equal ids count as one
document after another, ordered by text. An empty table gives an empty result. Extra columns named in
``keep`` are carried; all others are left out. Texts shorter than a window stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utterlake.llm.grams import Words, inside, runs
from utterlake.llm.tables import lean, read, text_parts
from utterlake.session import materialize

WINDOW = 20
PHRASE = 8
#: Characters of text in a block.
BLOCK_CHARS = 8_000_000


def picked(hashes, whole, window: int, phrase: int):
    """Place of the phrase that each window picks (the least hash, the last on ties), for windows inside a row.

    ``whole`` says for each window start whether the window lies in one row; returns the starts and the places.
    """
    import numpy as np

    span = window - phrase + 1
    starts = np.flatnonzero(whole)
    if not len(starts):
        return starts, starts
    least = hashes[: len(hashes) - span + 1].copy()
    at = np.arange(len(least))
    for step in range(1, span):
        other = hashes[step : len(least) + step]
        better = other <= least
        least = np.where(better, other, least)
        at = np.where(better, np.arange(len(least)) + step, at)
    return starts, at[starts]


def _sorted_block(table):
    """Rows by id, then text, so that the first of equal windows is the first in word order."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if table.num_rows > 1 else table


def phrase_rows(window: int, phrase: int):
    def run(key, table):
        import numpy as np
        import pyarrow as pa

        words = Words(table["text"])
        hashes = words.hashes()
        grams = runs(hashes, phrase)
        _, places = picked(grams, inside(words, window), window, phrase)
        found, counts = np.unique(grams[np.unique(places)], return_counts=True)
        block = pa.array(np.full(len(found), key[0].as_py()), pa.int64())
        return pa.table({"block": block, "phrase": pa.array(found.view(np.int64)), "again": pa.array(counts > 1)})

    return run


def spell(hashes, known):
    """All words as one string in which each known word is a few letters of its own, and how many.

    Automata search the children of a node one by one, so letters are few: 64 for each place in a word,
    with other letters at each place, so that no phrase matches across words. Unknown words look alike.
    """
    import numpy as np

    number = np.searchsorted(known, hashes)
    inside = known[np.minimum(number, len(known) - 1)] == hashes
    digits = max(1, -(-(len(known) - 1).bit_length() // 6))
    codes = np.zeros((len(hashes), digits), np.uint32)
    for n in range(digits):
        codes[:, n] = np.where(inside, 0x100 + 64 * n + ((number >> (6 * n)) & 63), 0x20)
    return codes.reshape(-1).astype("<u4").tobytes().decode("utf-32-le"), digits


def _candidates(words, hashes, wanted, window: int, phrase: int):
    """Starts of windows whose picked phrase recurs, with both halves of their hashes.

    ``wanted`` are hashes of phrases that recur. Their word numbers make the automaton, and the stream of
    all documents through it tells where they occur.
    """
    import ahocorasick
    import numpy as np

    grams = runs(hashes, phrase)
    starts, places = picked(grams, inside(words, window), window, phrase)
    if not len(starts) or not len(wanted):
        return starts[:0], np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    own = np.unique(places)
    _, one = np.unique(grams[own], return_index=True)
    texts = own[one][np.isin(grams[own[one]], wanted)]
    hit = np.zeros(len(grams), bool)
    if len(texts):
        spans = texts[:, None] + np.arange(phrase)
        letters, digits = spell(hashes, np.unique(hashes[spans]))
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_STRING)
        for place in texts.tolist():
            automaton.add_word(letters[place * digits : (place + phrase) * digits], place)
        automaton.make_automaton()
        ends = np.fromiter((end for end, _ in automaton.iter(letters)), np.int64)
        hit[(ends + 1) // digits - phrase] = True
    starts = starts[hit[places]]
    return starts, runs(hashes, window)[starts], runs(hashes, window, 1)[starts]


def _groups(high, low):
    """Sorted order of windows, where each group of equal ones begins, and each window's first place in its group."""
    import numpy as np

    order = np.lexsort((np.arange(len(high)), low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    heads = order[np.flatnonzero(new)]
    first = np.empty(len(order), np.int64)
    first[order] = heads[np.cumsum(new) - 1] if len(order) else heads
    return first


def window_rows(window: int, phrase: int):
    def run(key, table, wanted):
        import numpy as np
        import pyarrow as pa

        table = _sorted_block(table)
        words = Words(table["text"])
        hashes = words.hashes()
        recurring = np.sort(wanted["phrase"].to_numpy().view(np.uint64))
        starts, high, low = _candidates(words, hashes, recurring, window, phrase)
        heads = np.unique(_groups(high, low)) if len(starts) else np.zeros(0, np.int64)
        row = words.row()[starts[heads]] if len(heads) else np.zeros(0, np.int64)
        ids = table["doc_id"].combine_chunks() if table.num_rows else pa.array([], pa.int64())
        rows = pa.table(
            {
                "block": pa.array(np.full(len(heads), key[0].as_py()), pa.int64()),
                "high": pa.array(high[heads].view(np.int64)),
                "low": pa.array(low[heads].view(np.int64)),
                "doc_id": ids.take(pa.array(row)).cast(pa.int64()),
                "start": pa.array(starts[heads], pa.int64()),
                "hits": pa.nulls(len(heads), pa.binary()),
            }
        )
        if not len(starts):
            return rows
        bits = np.zeros(len(words), bool)
        bits[starts] = True
        own = [[key[0].as_py()], [key[0].as_py()], [-1], [None], [None], [np.packbits(bits).tobytes()]]
        return pa.concat_tables([rows, pa.table([pa.array(v, t) for v, t in zip(own, rows.schema.types, strict=True)], schema=rows.schema)])

    return run


def removal(window: int, keep: Sequence[str]):
    def run(key, table, found):
        import numpy as np
        import pyarrow as pa

        table = _sorted_block(table)
        words = Words(table["text"])
        hashes = words.hashes()
        gone = np.zeros(len(words) + 1, np.int64)
        bits = found["hits"].drop_null().to_pylist()
        if bits:
            starts = np.flatnonzero(np.unpackbits(np.frombuffer(bits[0], np.uint8), count=len(words)))
            high, low = runs(hashes, window)[starts], runs(hashes, window, 1)[starts]
            # A window that starts earlier in another block, told by the place of its first occurrence here.
            elsewhere = np.isin(starts, found["start"].drop_null().to_numpy())
            first = _groups(high, low)
            drop = starts[(first != np.arange(len(starts))) | elsewhere[first]]
            np.add.at(gone, drop, 1)
            np.add.at(gone, drop + window, -1)
        removed = np.cumsum(gone)[:-1] > 0
        n_removed = np.diff(np.concatenate([[0], np.cumsum(removed)])[words.first])
        columns = {name: table[name] for name in ["doc_id", "text", *keep]}
        columns["n_words"] = pa.array(words.counts.astype(np.int64))
        columns["n_removed"] = pa.array(n_removed.astype(np.int64))
        columns["kept_text"] = words.joined(~removed)
        return pa.table(columns)

    return run


def substring_dedup(
    docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, block_chars: int = BLOCK_CHARS, keep: Sequence[str] = ()
) -> DataFrame:
    """``doc_id, text, *keep, n_words, n_removed, kept_text``: kept words joined by one space."""
    if not 0 < phrase <= window:
        raise ValueError("a phrase is a part of a window")
    rows = lean(docs, keep=keep)
    parts = text_parts(rows, "text", block_chars)
    block = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("block")
    blocks = rows.select(block, "doc_id", "text", *keep)
    texts = blocks.select("block", "doc_id", "text")
    phrases = texts.groupBy("block").applyInArrow(phrase_rows(window, phrase), "block long, phrase long, again boolean")
    over = Window.partitionBy("phrase")
    counted = phrases.select("block", "phrase", (F.count(F.lit(1)).over(over) > 1).alias("_many"), F.max("again").over(over).alias("_again"))
    shared = materialize(counted.where("_many OR _again").select("block", "phrase"), "phrases")
    found = (
        texts.groupBy("block")
        .cogroup(shared.groupBy("block"))
        .applyInArrow(window_rows(window, phrase), "block long, high long, low long, doc_id long, start long, hits binary")
    )
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.col("block").alias("b"))
    first = F.min(place).over(Window.partitionBy("high", "low"))
    later = found.withColumn("_first", first).where("_first.b <> block OR hits IS NOT NULL").select("block", "start", "hits")
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep)
    schema = f"doc_id long, text string{kept}, n_words long, n_removed long, kept_text string"
    return blocks.groupBy("block").cogroup(later.groupBy("block")).applyInArrow(removal(window, keep), schema)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = f"""
WITH t AS (
    SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), windows AS (
    SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS pos, w FROM t WHERE len(w) >= {WINDOW}
), hashed AS (
    SELECT doc_id, pos, md5(array_to_string(w[pos:pos + {WINDOW - 1}], ' ')) AS h FROM windows
), later AS (
    SELECT doc_id, pos FROM hashed QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) > 1
), gone AS (
    SELECT DISTINCT doc_id, pos + i AS pos FROM later, unnest(range(0, {WINDOW})) AS u(i)
), dropped AS (
    SELECT doc_id, list(pos) AS l FROM gone GROUP BY doc_id
), kept AS (
    SELECT doc_id, list(word ORDER BY p.pos) AS k
    FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM t) p ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(len(l), 0)::BIGINT AS n_removed,
    sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM t LEFT JOIN dropped USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
