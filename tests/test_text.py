import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from utterlake.functions import numeric as num
from utterlake.functions import text as tx
from utterlake.operators.features import char_bags, gram_text, term_rows, word_bags
from utterlake.rules import STOP_WORDS


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("  How MUCH?\n\tis it  ", "how much is it"),
        ("Café_Ünï 12", "caf n 12"),
        ("", ""),
        ("¿¡!", ""),
        ("a b", "a b"),
        (None, None),
    ],
)
def test_clean_text(spark, raw, want):
    assert one(spark, raw, tx.clean_text) == want


def test_normalize_intent(spark):
    assert one(spark, " Card Issue\t", tx.normalize_intent) == "card_issue"
    assert one(spark, " Card Issue", lambda c: tx.normalize_intent(c, trimmed=False)) == "_card_issue"


def test_keywords_match_inside_words_unless_bounded(spark):
    df = spark.createDataFrame([("from Surabaya",), ("pay ABA now",), ("a+b",), (None,)], "t string")
    loose = df.select(tx.contains_keyword("t", ["aba", "a+b"]).alias("y"))
    assert [r.y for r in loose.collect()] == [True, True, True, False]
    bound = df.select(tx.contains_keyword("t", ["aba"], word_boundary=True).alias("y"))
    assert [r.y for r in bound.collect()] == [False, True, False, False]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("One. Two!  Three?\nFour", ["One.", "Two!", "Three?", "Four"]),
        ("3.5 percent", ["3.5 percent"]),
        ("   ", []),
        ("", []),
    ],
)
def test_sentences(spark, raw, want):
    assert one(spark, raw, tx.sentences) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("please help with my wallet topup failed again", "wallet topup failed"),
        ("what can now", "what can now"),
        ("a to me", "your request"),
        ("", "your request"),
    ],
)
def test_focus_phrase(spark, raw, want):
    assert one(spark, raw, lambda c: tx.focus_phrase(c, STOP_WORDS, "your request")) == want


@pytest.mark.parametrize("modulus", [1, 2, 3, 84, 2**31 - 1])
def test_hash_mod_is_the_whole_digest(spark, modulus):
    for key in ("", "a|b|c", "é|ü|ß", "x" * 1000):
        want = int(hashlib.sha256(key.encode()).hexdigest(), 16) % modulus
        assert one(spark, key, lambda c: tx.hash_mod(c, modulus)) == want


def test_prompt_forms(spark):
    df = spark.createDataFrame([(" q ", " a\n", "pay"), ("q", "a", None)], "t string, r string, i string")
    full = df.select(tx.format_prompt("t", "r", "i", eos="<e>").alias("y")).collect()
    assert full[0].y == "Intent: pay\nUser: q\nAssistant: a<e>"
    assert full[1].y == "User: q\nAssistant: a<e>"
    raw = df.select(tx.format_prompt("t", "r", trim=False).alias("y")).first()
    assert raw.y == "User:  q \nAssistant:  a\n"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("User: x\nAssistant: yes ", "yes"),
        ("Assistant: a Assistant: b", "a Assistant: b"),
        (" none ", " none "),
        ("Assistant:", ""),
    ],
)
def test_extract_reply(spark, raw, want):
    assert one(spark, raw, tx.extract_reply) == want


def test_word_ngrams_pair_kept_tokens(spark):
    assert one(spark, "Où I am, A-é1 x_y", tx.word_ngrams) == ["ou", "am", "e1", "x_y", "ou am", "am e1", "e1 x_y"]
    assert one(spark, "solo", tx.word_ngrams) == ["solo"]
    assert one(spark, "a b", tx.word_ngrams) == []


def grams_of(text):
    folded = re.sub(r"\s\s+", " ", text.lower())
    return Counter(folded[i : i + n] for n in (2, 3) for i in range(len(folded) - n + 1))


TEXTS = ["", "a", "ab", "abc", "aBAb  ab", "tab\tone\n\ntwo", "naïve 日本語 \U0001f600\U0001f600", "\x00a\x00"]


def test_char_bags_match_plain_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string")
    rows = term_rows(char_bags(df, "id"), "id").select("id", gram_text("term").alias("g"), "tf").collect()
    for number, text in enumerate(TEXTS):
        assert {r.g: r.tf for r in rows if r.id == number} == dict(grams_of(text))
    listed = {r.id: r.y for r in df.select("id", tx.char_ngrams("text").alias("y")).collect()}
    for number, text in enumerate(TEXTS):
        assert Counter(listed[number]) == grams_of(text)


def test_word_bags_count_and_skip_null(spark):
    df = spark.createDataFrame([(1, "red red blue"), (2, None), (3, "x")], "id bigint, text string")
    rows = {(r.id, r.term): r.tf for r in term_rows(word_bags(df, "id"), "id").collect()}
    assert rows == {(1, "red"): 2, (1, "blue"): 1, (1, "red red"): 1, (1, "red blue"): 1}


def test_preview(spark):
    assert one(spark, "abcdef", lambda c: tx.preview(c, 3)) == "abc..."
    assert one(spark, "ab", lambda c: tx.preview(c, 3)) == "ab..."
    assert one(spark, "ab", lambda c: tx.preview(c, 3, always=False)) == "ab"


def test_scores(spark):
    got = one(spark, [1000.0, 1001.0], num.softmax, "array<double>")
    assert got == pytest.approx([0.26894142, 0.73105858])
    assert one(spark, [2.0, 5.0, 5.0], num.argmax, "array<double>") == 1
    assert one(spark, 0.0, num.sigmoid, "double") == 0.5
    assert one(spark, 0.12344, num.fixed4, "double") == "0.1234"


@pytest.mark.parametrize("tokens", [[], [1, 2], [1, 2, 3], [1, 2, 3, 4]])
def test_pad_truncate(spark, tokens):
    assert one(spark, tokens, lambda c: num.pad_truncate(c, 3), "array<int>") == (tokens + [0] * 3)[:3]
    kept = min(len(tokens), 3)
    assert one(spark, tokens, lambda c: num.attention_mask(c, 3), "array<int>") == [1] * kept + [0] * (3 - kept)


def test_clean_text_is_one_pass_and_equals_two(spark):
    odd = [" ", "\u00a0a\u00a0", "a\u2003b", "A-B\t\n c", "\U0001f600x\U0001f600\U0001f600y", "\x0b\x0c\x1cq\x85z", "!!", "\u0130stanbul 1\u00bd", "a.b ,c", ""]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    two = F.trim(F.regexp_replace(F.regexp_replace(F.lower("t"), r"[^a-z0-9\s]", " "), r"\s+", " "))
    assert [r[0] for r in df.select(tx.clean_text("t")).collect()] == [r[0] for r in df.select(two).collect()]
    plan = df.select(tx.clean_text("t").alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
