import hashlib
import math

import pytest
from pyspark.errors import PySparkException

from utterlake.operators import augment, checks, dedup, evaluate, split, stats, taxonomy
from utterlake.rules import Rules

RULES = Rules(
    templates={"pay": "Open Pay. Then choose.", "card": "Lock it.", "loan_info": "See loans."},
    variants={"pay": ["Go to Pay.", "Use Pay. It is easy.", "Pay there. Then wait. Then look. Done."]},
    patterns={"pay": ["pay bill", "pay now"]},
    follow_ups=["For {focus}, one.", "For {focus}, two.", "For {focus}, three.", "For {focus}, four."],
    regionals=["R1.", "R2.", "R3.", "R4."],
    full_length_sources=["always"],
)


def test_dedup_keeps_the_first_by_source_then_row(spark):
    a = spark.createDataFrame([(5, "x", "i", "a5"), (2, "x", "i", "a2")], "row_id bigint, text string, intent string, response string")
    b = spark.createDataFrame([(0, "x", "i", "b0"), (1, "y", "i", "b1"), (2, "x", "j", "b2")], a.schema)
    kept = dedup.dedup_first(dedup.union_sources([a, b]))
    assert {r.response for r in kept.collect()} == {"a2", "b1", "b2"}
    again = dedup.dedup_first(kept)
    assert again.count() == kept.count()


def test_union_rejects_row_ids_that_do_not_fit(spark):
    bad = spark.createDataFrame([(-1, "x")], "row_id bigint, text string")
    with pytest.raises(PySparkException, match="row id out of range"):
        dedup.union_sources([bad]).collect()


def test_key_digest_keeps_columns_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc")], "x string, y string")
    assert df.select(dedup.key_digest("x", "y").alias("d")).distinct().count() == 3


def test_dedup_pair_compares_the_joined_text(spark):
    rows = [(0, "a", "b || c"), (1, "a || b", "c"), (2, "a", "c")]
    df = spark.createDataFrame(rows, "position bigint, text string, response string")
    assert sorted(r.position for r in dedup.dedup_pair(df).collect()) == [0, 2]


@pytest.mark.parametrize("group", [None, "g"])
def test_with_rank_is_dense(spark, group):
    keys = [3, 10, 11, 500, 7_000_000_000, 7_000_000_001]
    df = spark.createDataFrame([(k, "a" if k % 2 else "b") for k in keys], "id bigint, g string")
    got = {r.id: r.place for r in dedup.with_rank(df, "id", group).collect()}
    for side in ("ab",) if group is None else ("a", "b"):
        mine = [k for k in keys if ("a" if k % 2 else "b") in side]
        assert [got[k] for k in mine] == list(range(len(mine)))


def md5_order(seed, keys):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}|{k}".encode()).hexdigest(), k))


@pytest.mark.parametrize("n", [0, 1, 17, 200, 999])
def test_seeded_sample_takes_the_first_by_hash(spark, n):
    df = spark.range(200).withColumnRenamed("id", "row_id")
    got = {r.row_id for r in split.seeded_sample(df, n).collect()}
    assert got == set(md5_order(42, range(200))[:n])
    assert {r.row_id for r in split.seeded_sample(df.repartition(7), n).collect()} == got


@pytest.mark.parametrize("rows", [1, 2, 10, 101])
def test_random_split_sizes(spark, rows):
    df = spark.range(rows).withColumnRenamed("id", "row_id")
    marked = split.random_split(df, 0.1).collect()
    assert sum(r.split == "eval" for r in marked) == math.ceil(0.1 * rows)
    assert len(marked) == rows


def published(sizes):
    return [(sum(sizes[:c]) + i, f"c{c:02d}") for c, n in enumerate(sizes) for i in range(n)]


def test_three_way_split_of_known_class_sizes(spark):
    # Two classes of 68 and ten of 40: 536 rows give 428, 54 and 54, train quotas 54 and 32.
    df = spark.createDataFrame(published([68, 68] + [40] * 10), "row_id bigint, intent string")
    marked = split.three_way_split(df).collect()
    sizes = {s: sum(r.split == s for r in marked) for s in ("train", "val", "test")}
    assert sizes == {"train": 428, "val": 54, "test": 54}
    assert len({r.row_id for r in marked}) == 536
    for c, n in enumerate([68, 68] + [40] * 10):
        mine = [r for r in marked if r.intent == f"c{c:02d}"]
        assert sum(r.split == "train" for r in mine) == (54 if n == 68 else 32)


def test_split_quotas_are_within_one_row(spark):
    sizes = [7, 11, 301, 2, 55]
    df = spark.createDataFrame(published(sizes), "row_id bigint, intent string")
    marked = split.stratified_split(df, eval_share=0.3).collect()
    total, wanted = sum(sizes), sum(sizes) - math.ceil(0.3 * sum(sizes))
    assert sum(r.split == "train" for r in marked) == wanted
    for c, n in enumerate(sizes):
        got = sum(r.split == "train" for r in marked if r.intent == f"c{c:02d}")
        assert abs(got - n * wanted / total) < 1


def test_impossible_split_fails_or_falls_back(spark):
    df = spark.createDataFrame(published([1, 9]), "row_id bigint, intent string")
    with pytest.raises(ValueError, match="fewer than 2"):
        split.stratified_split(df)
    plain = split.stratified_split(df, strict=False).collect()
    assert sum(r.split == "eval" for r in plain) == 2
    small = spark.createDataFrame(published([2, 2, 2]), "row_id bigint, intent string")
    with pytest.raises(ValueError, match="cannot hold"):
        split.stratified_split(small)


def test_one_class_is_split_plainly(spark):
    df = spark.createDataFrame(published([10]), "row_id bigint, intent string")
    assert sum(r.split == "eval" for r in split.stratified_split(df).collect()) == 2


def test_leakage_ignores_case_and_outer_blanks(spark):
    train = spark.createDataFrame([(1, "Pay bill "), (2, "x"), (3, None)], "row_id bigint, text string")
    held = spark.createDataFrame([(4, "pay BILL"), (5, "y"), (6, "pay bill"), (7, None)], train.schema)
    got = {r.row_id: r.leaked for r in split.split_leakage(train, held).collect()}
    assert got == {4: True, 5: False, 6: True, 7: False}
    assert {r.row_id for r in split.clean_evaluation(train, held).collect()} == {5, 7}


def test_taxonomy_last_listing_wins_and_unmapped_rows_go(spark):
    tax = {"pay": ["a", "b"], "card": ["b", "c"]}
    df = spark.createDataFrame([(1, "t1", "a"), (2, "t2", "b"), (3, "t3", "z"), (4, "t4", None)], "row_id bigint, text string, label_name string")
    got = {r.row_id: (r.intent, r.response) for r in taxonomy.map_taxonomy(df, "label_name", tax, "s", {"pay": "P"}).collect()}
    assert got == {1: ("pay", "P"), 2: ("card", None)}


def test_label_names_and_fallback(spark):
    df = spark.createDataFrame([(0,), (1,), (9,)], "label int")
    assert [r["class"] for r in taxonomy.lookup_label(df, ["zero", "one"]).orderBy("label").collect()] == ["zero", "one", "9"]
    with pytest.raises(PySparkException, match="label id without a name"):
        taxonomy.add_label_name(df, ["zero", "one"]).collect()


def test_synthetic_fill_counts_patterns_and_zero_need(spark):
    df = spark.createDataFrame([("pay",)] * 3 + [("card",)], "intent string")
    rows = augment.synthetic_fill(df, 3, RULES).orderBy("row_id").collect()
    assert [(r.intent, r.text) for r in rows] == [
        ("card", "card sample_1"),
        ("card", "card sample_2"),
        ("loan_info", "loan info sample_1"),
        ("loan_info", "loan info sample_2"),
        ("loan_info", "loan info sample_3"),
    ]
    assert {r.source for r in rows} == {"synthetic_seed"}
    empty = spark.createDataFrame([], "intent string")
    texts = [r.text for r in augment.synthetic_fill(empty, 3, RULES).orderBy("row_id").collect()][:3]
    assert texts == ["pay bill sample_1", "pay now sample_2", "pay bill sample_3"]
    assert augment.synthetic_fill(df, 0, RULES).count() == 0
    assert augment.synthetic_fill(empty, 2500, RULES).count() == 3 * 2500


def test_synthetic_focus_text(spark):
    empty = spark.createDataFrame([], "intent string")
    row = augment.synthetic_fill_focus(empty, 1, RULES).where("intent = 'loan_info'").first()
    assert row.text == "cambodia loan info in phnom penh sample_1"
    assert row.source == "synthetic_seed_cambodia"


def composed_by_hand(intent, text, source):
    digest = int(hashlib.sha256(f"{intent}|{text}|{source or ''}".encode()).hexdigest(), 16)
    options = RULES.variants.get(intent) or [RULES.templates.get(intent, RULES.default_response)]
    base = [s for s in options[digest % len(options)].replace(". ", ".\n").split("\n") if s]
    words = [w for w in text.split() if len(w) > 2]
    kept = [w for w in words if w not in RULES.stop_words] or words
    focus = " ".join(kept[:3]) or "your request"
    goal = 3 if source == "always" else 2 + digest % 2
    extra = [RULES.follow_ups[digest % 4].format(focus=focus), RULES.regionals[digest // 7 % 4]]
    return " ".join((base + extra[: max(0, min(3, goal) - len(base))])[:3])


def test_composition_against_plain_hashing(spark):
    rows = [
        (n, intent, f"please pay the electric bill {n}" if n % 5 else "a b", source)
        for n, (intent, source) in enumerate([(i, s) for i in ("pay", "card", "other") for s in ("web", "always", None)] * 8)
    ]
    df = spark.createDataFrame(rows, "id int, intent string, text string, source string")
    for r in augment.compose_response(df, RULES).collect():
        assert r.composed == composed_by_hand(r.intent, r.text, r.source)


def test_diversify_counts_a_missing_source_as_unknown(spark):
    df = spark.createDataFrame([("pay", "pay my bill", "old")], "intent string, text string, response string")
    row = augment.diversify_responses(df, RULES).first()
    assert row.response == composed_by_hand("pay", "pay my bill", "unknown")


def test_dataset_stats_document(spark):
    rows = [("train", "b", "s"), ("train", "a", "s"), ("val", "a", "t"), ("test", "b", "s")]
    long = stats.dataset_stats(spark.createDataFrame(rows, "split string, intent string, source string"), True)
    row = stats.stats_document(long, {"full": "/p"}).first()
    assert (row.total_samples, row.train_samples, row.val_samples, row.test_samples) == (4, 2, 1, 1)
    assert row.intents == ["a", "b"] and row.sources == {"s": 3, "t": 1}
    assert row.focus_only is True and row.files == {"full": "/p"}


def test_corpus_stats(spark):
    rows = [(0, "a", "b", "i"), (1, "a", "b", "j"), (2, "c", None, "k"), (3, None, "d", "k"), (4, "e", "f", "j")]
    df = spark.createDataFrame(rows, "position bigint, text string, response string, intent string")
    got = {r.measure: r.value for r in stats.corpus_stats(df).collect()}
    assert got == {"rows": 5, "usable": 3, "final": 2, "intents": 2, "duplicates": 1}
    lost = checks.null_rows(df, ["text", "response"]).first()
    assert (lost.rows, lost.dropped) == (5, 2)


def test_response_pool(spark):
    rows = [("a", " x "), ("a", "x"), ("a", None), ("b", "  "), ("a", "y")]
    pool = stats.response_pool(spark.createDataFrame(rows, "intent string, response string"))
    assert sorted((r.intent, r.response) for r in pool.collect()) == [("a", "x"), ("a", "y")]


def test_report_with_classes_missing_on_one_side(spark):
    pairs = [("a", "a")] * 3 + [("a", "x")] + [("b", "a")] * 2
    df = spark.createDataFrame(pairs, "t string, p string")
    got = {r.label: r for r in evaluate.classification_report(df, "t", "p").collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].support) == (0.6, 0.75, 4)
    assert got["a"].f1 == pytest.approx(2 * 0.6 * 0.75 / 1.35)
    assert (got["b"].precision, got["b"].recall, got["b"].f1) == (0, 0, 0)
    assert (got["x"].precision, got["x"].recall, got["x"].support) == (0, 0, 0)
    assert got["accuracy"].f1 == 0.5 and got["macro avg"].precision == pytest.approx(0.2)
    assert got["weighted avg"].recall == pytest.approx(0.5)
    both = evaluate.macro_f1(df, "t", "p").first()
    assert both.accuracy == 0.5 and both.f1_macro == pytest.approx(got["macro avg"].f1)


def test_best_model_ties_go_to_the_earlier_one(spark):
    df = spark.createDataFrame([("svm", 0.9), ("naive_bayes", 0.9), ("logreg", 0.8)], "model string, accuracy double")
    assert evaluate.best_model(df, ["logreg", "naive_bayes", "svm"]).first().model == "naive_bayes"


@pytest.mark.parametrize("losses, want", [([1.0, 3.0], math.exp(2)), ([50.0], math.inf), ([49.0], math.exp(49))])
def test_perplexity(spark, losses, want):
    row = evaluate.perplexity(spark.createDataFrame([(x,) for x in losses], "loss double")).first()
    assert row.eval_perplexity == pytest.approx(want)


def test_label_encode(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",)], "intent string")
    held = spark.createDataFrame([("b",)], "intent string")
    a, b = evaluate.label_encode(train, held, "intent")
    assert sorted((r.intent, r.label_id) for r in a.collect()) == [("a", 0), ("b", 1), ("b", 1)]
    assert b.first().label_id == 1
    with pytest.raises(PySparkException, match="label not seen"):
        evaluate.label_encode(held, train, "intent")[1].collect()


def test_argmax_class_ties(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (1, "a", 2.0), (1, "c", 1.0)], "id int, class string, score double")
    row = evaluate.argmax_class(df, "id").first()
    assert (row["class"], row.score) == ("a", 2.0)


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "intent string")
    got = {r.intent: r.weight for r in evaluate.class_weights(df, "intent").collect()}
    assert got == {"a": pytest.approx(4 / 6), "b": 2.0}


def test_guards(spark):
    df = spark.createDataFrame([], "a string")
    with pytest.raises(ValueError, match="no column"):
        checks.require_columns(df, ["b"])
    with pytest.raises(RuntimeError, match="nothing"):
        checks.require_rows(df, "nothing")
