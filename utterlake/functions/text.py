"""Column expressions over text. All of them run inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes.
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Patterns of the cleaning, sentence and token rules.
NOT_PLAIN = r"[^a-z0-9]+"
BLANKS = r"\s+"
BLANK_RUNS = r"[\s\x1c-\x1f\x85\p{Z}]{2,}"
SENTENCE_GAP = r"(?<=[.!?])\s+"
WORD = r"[\p{L}\p{N}_]{2,}"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, whatever number of times body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column | str) -> Column:
    return F.btrim(_col(text), F.lit(STRIP_CHARS))


def clean_text(text: Column | str) -> Column:
    """Lower-case, keep a-z, 0-9 and blanks, one blank between words.

    Other characters become blanks and runs of blanks one, so every run that is not a-z or 0-9 is one blank. A class
    that also excludes blanks takes Java twelve times as long.
    """
    return F.trim(F.regexp_replace(F.lower(_col(text).cast("string")), NOT_PLAIN, " "))


def normalize_intent(intent: Column | str, trimmed: bool = True) -> Column:
    """Lower-case label with blanks as underscores; loaders pass ``trimmed=False``."""
    value = _col(intent).cast("string")
    return F.replace(F.lower(strip(value) if trimmed else value), F.lit(" "), F.lit("_"))


def contains_keyword(text: Column | str, keywords: Sequence[str], word_boundary: bool = False) -> Column:
    """Case-insensitive search for any keyword, as a substring unless ``word_boundary``."""
    quoted = "|".join(r"\Q" + k.replace(r"\E", r"\E\\E\Q") + r"\E" for k in keywords)
    pattern = rf"(?iu)\b(?:{quoted})\b" if word_boundary else f"(?iu)(?:{quoted})"
    return F.coalesce(_col(text).rlike(pattern), F.lit(False))


def sentences(text: Column | str) -> Column:
    """Sentences of a text: cut after . ! ? and blanks, trimmed, empty ones left out."""
    parts = F.split(strip(text), SENTENCE_GAP)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def focus_phrase(text: Column | str, stop_words: Sequence[str], when_empty: str, words: int = 3) -> Column:
    """The first content words of a text, or its first longer words, or ``when_empty``."""
    stops = F.array(*[F.lit(w) for w in stop_words]) if stop_words else F.array().cast("array<string>")
    longer = F.filter(F.split(_col(text).cast("string"), BLANKS), lambda t: F.length(t) > 2)

    def phrase(tokens: Column) -> Column:
        chosen = bind(
            F.filter(tokens, lambda t: ~F.array_contains(stops, t)),
            lambda kept: F.when(F.size(kept) > 0, kept).otherwise(tokens),
        )
        return F.when(F.size(tokens) == 0, F.lit(when_empty)).otherwise(
            F.array_join(F.slice(chosen, 1, words), " ")
        )

    return bind(longer, phrase)


def variant_key(intent: Column | str, text: Column | str, source: Column | str) -> Column:
    parts = [F.coalesce(_col(c).cast("string"), F.lit("")) for c in (intent, text, source)]
    return F.concat(parts[0], F.lit("|"), parts[1], F.lit("|"), parts[2])


def hash_mod(key: Column | str, modulus: int | Column) -> Column:
    """SHA-256 of the key, as a 256-bit number, modulo ``modulus`` (below 2**31).

    The digest is folded in eight 32-bit words, so every step fits a BIGINT.
    """
    digest = F.sha2(_col(key).cast("string"), 256)
    base = F.lit(modulus).cast("bigint") if isinstance(modulus, int) else modulus.cast("bigint")

    def fold(hexed: Column) -> Column:
        rest = F.lit(0).cast("bigint")
        for word in range(8):
            value = F.conv(F.substring(hexed, 8 * word + 1, 8), 16, 10).cast("bigint")
            rest = (rest * F.lit(1 << 32) + value) % base
        return rest

    return bind(digest, fold)


def format_prompt(
    text: Column | str,
    response: Column | str | None = None,
    intent: Column | str | None = None,
    eos: str = "",
    trim: bool = True,
) -> Column:
    """``User:``/``Assistant:`` text of one example; a null intent gives no ``Intent:`` line."""
    tidy = strip if trim else _col
    body = F.concat(F.lit("User: "), tidy(text))
    if response is not None:
        body = F.concat(body, F.lit("\nAssistant: "), tidy(response))
    if intent is not None:
        line = F.concat(F.lit("Intent: "), tidy(intent), F.lit("\n"))
        body = F.concat(F.coalesce(line, F.lit("")), body)
    return F.concat(body, F.lit(eos)) if eos else body


def extract_reply(text: Column | str, marker: str = "Assistant:") -> Column:
    """What follows the first marker, trimmed; the whole text when there is no marker."""
    value = _col(text)
    at = F.instr(value, F.lit(marker))
    return F.when(at > 0, strip(F.substring(value, at + len(marker), F.length(value)))).otherwise(value)


def _accent_table() -> tuple[str, str]:
    """Accented letters and their base letters, worked out from Unicode decomposition."""
    source, target = [], []
    for code in (*range(0x00C0, 0x0250), *range(0x0370, 0x0530), *range(0x1E00, 0x2000)):
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(base) == 1 and base != char:
            source.append(char)
            target.append(base)
    marks = "".join(chr(code) for code in range(0x0300, 0x0370) if unicodedata.combining(chr(code)))
    return "".join(source) + marks, "".join(target)


ACCENTED, PLAIN = _accent_table()


def strip_accents(text: Column | str) -> Column:
    """Drop accents of Latin, Greek and Cyrillic letters."""
    return F.translate(_col(text), ACCENTED, PLAIN)


def word_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(strip_accents(F.lower(_col(text))), F.lit(WORD), F.lit(0))


def _adjacent(items: Column, width: int, glue: str) -> Column:
    """Runs of ``width`` neighbouring items, joined; one linear pass per extra item."""
    count = F.size(items) - (width - 1)
    runs = F.slice(items, F.lit(1), count)
    for step in range(1, width):
        runs = F.zip_with(runs, F.slice(items, F.lit(step + 1), count), lambda a, b: F.concat(a, F.lit(glue), b))
    return F.when(count > 0, runs).otherwise(F.array().cast("array<string>"))


def word_ngrams(text: Column | str) -> Column:
    """Words of two or more characters and pairs of neighbouring ones, in order, repeats kept."""
    return bind(word_tokens(text), lambda t: F.concat(t, _adjacent(t, 2, " ")))


def fold_blanks(text: Column | str) -> Column:
    """Lower-case text with every run of two or more blanks as one blank."""
    return F.regexp_replace(F.lower(_col(text)), BLANK_RUNS, " ")


def char_ngrams(text: Column | str, low: int = 2, high: int = 3) -> Column:
    """Character n-grams of the folded text, blanks included, repeats kept."""
    return bind(
        F.split(fold_blanks(text), ""),
        lambda chars: F.concat(*[_adjacent(chars, n, "") for n in range(low, high + 1)]),
    )


def preview(text: Column | str, width: int, always: bool = True) -> Column:
    """Text cut at ``width`` with ``...``; ``always`` adds the dots to short texts as well."""
    value = _col(text)
    cut = F.concat(F.substring(value, 1, width), F.lit("..."))
    return cut if always else F.when(F.length(value) > width, cut).otherwise(value)
