import math
import os
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from utterlake.operators import classify, joins, respond, retrieve
from utterlake.operators.classify import NaiveBayesModel, fit_naive_bayes
from utterlake.rules import Rules
from utterlake.session import scratch_scope
from utterlake.streaming.answers import answer_stream

SF = "/root/testdata/sf0.001"
RULES = Rules(generic={"pay": "general pay"}, clarification="please rephrase", no_information="nothing known")

EXAMPLES = [
    ("pay", 0, "how to pay my bill", "r0"),
    ("pay", 1, "pay the electric bill now", "r1"),
    ("pay", 2, "How  to pay my bill", "r2"),
    ("pay", 3, "monthly payment date", "r3"),
    ("pay", 9, "x", "r9"),
    ("card", 4, "my card is lost", "r4"),
    ("card", 5, "card declined at store", "r5"),
    ("card", 6, "block my card please", "r6"),
    ("loan", 7, "loan interest rate", "r7"),
    ("loan", 8, "apply for a loan", "r8"),
]

QUESTIONS = [
    (100, "how to pay my bill"),
    (101, "pay bill"),
    (102, "where is my lost card"),
    (103, "zzz qqq"),
    (104, "loan rate please"),
    (105, "Ünïcode café 日本"),
    (106, ""),
    (107, "q"),
]


def grams(text):
    folded = re.sub(r"\s\s+", " ", text.lower())
    return Counter(folded[i : i + n] for n in (2, 3) for i in range(len(folded) - n + 1))


def unit(counts, idf):
    raw = {t: n * idf[t] for t, n in counts.items() if t in idf}
    size = math.sqrt(sum(x * x for x in raw.values()))
    return {t: x / size for t, x in raw.items()}


def idf_of(bags):
    held = Counter(t for b in bags for t in b)
    return {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in held.items()}


def nearest(intent, text):
    mine = [e for e in EXAMPLES if e[0] == intent]
    bags = [grams(e[2]) for e in mine]
    idf = idf_of(bags)
    ask = unit(grams(text), idf)
    sims = []
    for e, bag in zip(mine, bags):
        vector = unit(bag, idf) if bag else {}
        sims.append((round(sum(w * vector.get(t, 0) for t, w in ask.items()), 10), -e[1]))
    best = max(sims)
    return -best[1], best[0]


@pytest.fixture(scope="module")
def examples(spark):
    return spark.createDataFrame(EXAMPLES, "intent string, ex_id bigint, text string, response string")


@pytest.fixture(scope="module")
def index(examples):
    return retrieve.build_index(examples)


@pytest.fixture(scope="module")
def model(examples):
    return fit_naive_bayes(examples.withColumnRenamed("ex_id", "row_id"))


@pytest.mark.parametrize("blocks", [(16384, 32768, 1024, 4096), (1, 1, 1, 3), (2, 3, 2, 7), (99, 99, 3, 5)])
def test_nearest_example_against_brute_force(spark, index, monkeypatch, blocks):
    monkeypatch.setattr(retrieve, "EXAMPLE_ROWS", blocks[0])
    monkeypatch.setattr(retrieve, "QUESTION_ROWS", blocks[1])
    monkeypatch.setattr(retrieve, "CHUNK_ROWS", blocks[2])
    monkeypatch.setattr(retrieve, "SLICE", blocks[3])
    rows = [(n * 10 + k, intent, text) for n, text in QUESTIONS for k, intent in enumerate(("pay", "card", "loan", "none"))]
    asked = spark.createDataFrame(rows, "qid bigint, intent string, text string")
    got = {r.qid: (r.ex_id, r.sim) for r in retrieve.similarity_top1(asked, index).collect()}
    assert len(got) == 3 * len(QUESTIONS)
    for qid, intent, text in rows:
        if intent != "none":
            want = nearest(intent, text)
            assert got[qid][0] == want[0] and got[qid][1] == pytest.approx(want[1], abs=1e-9)


def test_similarity_join_gives_all_pairs_over_the_gate(spark, index, monkeypatch):
    monkeypatch.setattr(retrieve, "EXAMPLE_ROWS", 1)
    asked = spark.createDataFrame([(1, "pay", "how to pay my bill")], "qid bigint, intent string, text string")
    pairs = {r.ex_id: (r.sim, r.copies) for r in retrieve.similarity_join(asked, index, 0.2).collect()}
    assert pairs[0] == (pytest.approx(1.0), 2)
    assert 2 not in pairs and 1 in pairs
    assert all(sim >= 0.2 for sim, _ in pairs.values())


def test_one_hot_intent_is_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "EXAMPLE_ROWS", 16)
    monkeypatch.setattr(retrieve, "QUESTION_ROWS", 16)
    many = spark.range(300).select(
        F.lit("hot").alias("intent"), F.col("id").alias("ex_id"),
        F.concat(F.lit("number "), F.md5(F.col("id").cast("string"))).alias("text"), F.lit("r").alias("response"),
    )
    hot = retrieve.build_index(many)
    asked = many.select((F.col("ex_id") + 1000).alias("qid"), "intent", "text")
    got = retrieve.similarity_top1(asked, hot)
    assert got.where("qid - 1000 = ex_id and sim = 1.0").count() == 300


def test_repeated_questions_all_get_their_answer(spark, index):
    rows = [(n, "card", "where is my  lost card" if n % 2 else "Where is my lost card") for n in range(50)]
    rows += [(60, "pay", "where is my lost card"), (61, "card", "block")]
    asked = spark.createDataFrame(rows, "qid bigint, intent string, text string")
    got = {r.qid: r.ex_id for r in retrieve.similarity_top1(asked, index).collect()}
    assert got == {n: nearest(i, t)[0] for n, i, t in rows}


def bayes(train, text, alpha=0.5):
    def bag(t):
        words = re.findall(r"\w\w+", t.lower())
        return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])

    bags = [(e[0], bag(e[2])) for e in train]
    idf = idf_of([b for _, b in bags])
    held = defaultdict(lambda: defaultdict(float))
    for name, b in bags:
        for t, w in (unit(b, idf) if b else {}).items():
            held[name][t] += w
    ask = unit(bag(text), idf) if set(bag(text)) & set(idf) else {}
    scores = {}
    for name in sorted({e[0] for e in train}):
        total = sum(held[name].values()) + alpha * len(idf)
        prior = math.log(sum(e[0] == name for e in train) / len(train))
        scores[name] = prior + sum(w * math.log((held[name][t] + alpha) / total) for t, w in ask.items())
    top = max(scores.values())
    share = {n: math.exp(s - top) for n, s in scores.items()}
    best = min(n for n, s in scores.items() if round(s, 10) == round(top, 10))
    return best, share[best] / sum(share.values())


def test_naive_bayes_against_plain_python(spark, model):
    asked = spark.createDataFrame(QUESTIONS[:5] + QUESTIONS[6:], "qid bigint, text string")
    for r in model.predict(asked, "qid").collect():
        intent, sure = bayes(EXAMPLES, r.text)
        assert r.predicted_intent == intent
        assert r.confidence == pytest.approx(sure, abs=1e-9)


def test_naive_bayes_of_five_hundred_classes_lists_few_of_them_for_a_term(spark):
    known = [(f"c{n:03d}", n, f"word{n} common thing{n % 7} word{(n * 3) % 500}", "r") for n in range(500)]
    rows = spark.createDataFrame(known, "intent string, row_id bigint, text string, response string")
    fitted = fit_naive_bayes(rows)
    held = {r["term"]: [x["place"] for x in r["lifts"]] for r in fitted.terms.collect()}
    assert held["common"] == list(range(500)) and held["word0"] == [0] and held["word1"] == [1, 167]
    assert len(fitted.heavy.columns) == 4 and fitted.heavy.count() <= 4096
    asked = [(1, "word7 common"), (2, "thing3"), (3, "unknown only"), (4, "word9 word9 thing2 word27")]
    for r in fitted.predict(spark.createDataFrame(asked, "qid bigint, text string"), "qid").collect():
        intent, sure = bayes(known, r.text)
        assert r.predicted_intent == intent
        assert r.confidence == pytest.approx(sure, abs=1e-9)


def test_model_and_index_survive_saving(spark, model, index, tmp_path):
    model.save(str(tmp_path / "m"))
    again = NaiveBayesModel.load(spark, str(tmp_path / "m"))
    asked = spark.createDataFrame(QUESTIONS, "qid bigint, text string")
    assert sorted(again.predict(asked, "qid").collect()) == sorted(model.predict(asked, "qid").collect())


def ladder_rows(spark):
    rows = [
        (1, "q", "pay", 0.39, None, None, None, "first", True),
        (2, "q", "none", 0.9, None, None, None, None, None),
        (3, "q", "pay", 0.9, 0.59, "mt", "mr", "first", True),
        (4, "q", "card", 0.9, 0.59, "mt", "mr", "first", True),
        (5, "q", "card", 0.9, 0.05, "mt", "mr", "first", True),
        (6, "q", "pay", 0.40, 0.60, "mt", "mr", "first", True),
        (7, "q", "pay", 0.9, 0.59, "mt", "general pay", "first", True),
    ]
    schema = (
        "qid bigint, text string, predicted_intent string, confidence double, sim double, match_text string, "
        "match_response string, first_response string, has_examples boolean"
    )
    return spark.createDataFrame(rows, schema).withColumn("first_text", F.when(F.col("has_examples"), F.lit("ft")))


def test_production_ladder(spark):
    got = {r.qid: (r.response, r.fallback_type) for r in respond.answer_ladder(ladder_rows(spark), RULES).collect()}
    assert got == {
        1: ("please rephrase", "confidence"),
        2: ("nothing known", "generic_intent"),
        3: ("general pay", "similarity"),
        4: ("first", "similarity"),
        5: ("first", "similarity"),
        6: ("mr", "none"),
        7: ("general pay", "similarity"),
    }


def test_report_ladder(spark):
    rows = respond.report_ladder(ladder_rows(spark), RULES).collect()
    got = {r.qid: (r.similar_question, r.similarity_score, r.response, r.fallback_type) for r in rows}
    assert got == {
        1: ("N/A (confidence too low)", "0.0000", "please rephrase", "confidence"),
        2: (None, "0.0000", None, "none"),
        3: ("mt", "0.5900", "general pay", "similarity"),
        4: ("mt", "0.5900", "mr", "none"),
        5: ("ft", "0.0500", "first", "none"),
        6: ("mt", "0.6000", "mr", "none"),
        7: ("mt", "0.5900", "general pay", "none"),
    }


def test_routes_by_priority_name_and_exclusion(spark):
    routes = [
        {"intent": "card", "patterns": ["block", "card"], "neg_patterns": ["transfer"], "priority": 8},
        {"intent": "balance", "patterns": ["how much"], "priority": 5},
        {"intent": "status", "patterns": ["where"], "priority": 8},
    ]
    texts = ["BLOCK where", "card transfer how much", "where", "hello"]
    df = spark.createDataFrame([(t, "model") for t in texts], "text string, predicted_intent string")
    got = respond.keyword_route(df, routes).collect()
    assert [(r.predicted_intent, r.routed) for r in got] == [
        ("card", True), ("balance", True), ("status", True), ("model", False),
    ]


def test_scores_of_an_outside_model(spark):
    df = spark.createDataFrame([(1, [0.0, 2.0, 1.0]), (2, [0.0, 0.0, 3.0])], "id int, logits array<double>")

    def double(batches):
        for pdf in batches:
            yield pdf.assign(logits=[[2 * x for x in row] for row in pdf.logits])

    scored = respond.score_logits(respond.score_with(df, double, "id int, logits array<double>"), "logits", ["a", "b"])
    got = {r.id: (r.predicted_intent, round(r.confidence, 6)) for r in scored.collect()}
    assert got == {1: ("b", round(math.exp(4) / (1 + math.exp(4) + math.exp(2)), 6)), 2: ("2", round(math.exp(6) / (2 + math.exp(6)), 6))}


@pytest.mark.parametrize("report", [False, True])
def test_stream_gives_the_batch_answers(spark, model, index, tmp_path, report):
    rows = [(n, f"  {t} ") for n, t in QUESTIONS] + [(200, "EXIT"), (201, "quit "), (202, "  ")]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "qid bigint, text string").repartition(3).write.parquet(source)
    stream = spark.readStream.schema("qid bigint, text string").option("maxFilesPerTrigger", 1).parquet(source)
    sink = str(tmp_path / "out")
    answer_stream(stream, model, index, RULES, sink, str(tmp_path / "cp"), report).awaitTermination()
    kept = spark.createDataFrame([(n, t) for n, t in QUESTIONS if t], "qid bigint, text string")
    batch = respond.answer(kept, model, index, RULES, report)
    got = spark.read.parquet(sink).select(batch.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))
    assert batch.count() == 7


def test_every_rung_of_both_ladders_is_checked():
    """The rows that ``answer_rungs`` and its report form are compared with hold each outcome."""
    import duckdb

    from checks.oracle import SQL

    con = duckdb.connect()
    for name in ("documents", "conversations", "benchmark", "part", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.01/{name}.parquet'")
    kinds = con.execute(f"SELECT fallback_type, count(*) FILTER (sim < 0.10), count(DISTINCT response) FROM ({SQL['answer_rungs']}) GROUP BY 1").fetchall()
    assert {kind for kind, _, _ in kinds} == {"none", "similarity", "confidence", "generic_intent"}
    assert dict((kind, n) for kind, n, _ in kinds)["similarity"] > 0  # below the floor
    assert dict((kind, n) for kind, _, n in kinds)["generic_intent"] == 2  # with a general answer and without
    report = con.execute(f"SELECT DISTINCT fallback_type FROM ({SQL['answer_rungs_report']})").fetchall()
    assert {kind for (kind,) in report} == {"none", "similarity", "confidence"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stream_reads_a_table_that_is_a_folder_of_files(spark, tmp_path):
    from checks.queries import QUERIES

    for name in ("documents", "benchmark"):
        os.symlink(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    turns.repartition(2).write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["answer_stream"](spark, str(tmp_path))
    assert got.count() == turns.where("role = 'user' and trim(text) != '' and lower(trim(text)) not in ('exit', 'quit')").count() > 0


@pytest.mark.parametrize("known", [0, 5, 40])
def test_grams_that_kernels_do_not_hold_count_as_well(spark, examples, monkeypatch, known):
    monkeypatch.setattr(retrieve, "KNOWN_GRAMS", known)
    few = retrieve.build_index(examples)
    assert few.heavy.count() == known < few.vocab.count()
    rows = [(n * 10 + k, intent, text) for n, text in QUESTIONS for k, intent in enumerate(("pay", "card", "loan"))]
    asked = spark.createDataFrame(rows, "qid bigint, intent string, text string")
    got = {r.qid: (r.ex_id, r.sim) for r in retrieve.similarity_top1(asked, few).collect()}
    for qid, intent, text in rows:
        want = nearest(intent, text)
        assert got[qid][0] == want[0] and got[qid][1] == pytest.approx(want[1], abs=1e-9)
    for r in few.vectors.where("intent = 'card'").collect():
        want = unit(grams(EXAMPLES[[e[1] for e in EXAMPLES].index(r.ex_id)][2]), idf_of([grams(e[2]) for e in EXAMPLES if e[0] == "card"]))
        assert sorted(r.weights) == pytest.approx(sorted(want.values()))


def test_cells_move_texts_and_not_vectors(spark, index):
    asked = spark.createDataFrame([(1, "pay", "how to pay my bill")], "qid bigint, intent string, text string")
    for plan in (retrieve.similarity_join(asked, index, 0.2), retrieve.similarity_top1(asked, index)):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "CoGroup" in text and "weights" not in text
    # Pairs go out of the cells as they are: no join or shuffle comes after.
    text = retrieve.similarity_join(asked, index, 0.2)._jdf.queryExecution().optimizedPlan().toString()
    assert text.strip().startswith("FlatMapCoGroupsInArrow")


def test_fits_by_columns_and_by_pairs_agree_and_look_up_no_single_terms(spark, examples, monkeypatch):
    rows = examples.withColumnRenamed("ex_id", "row_id")
    looked, plain = [], classify.Tfidf.lengths
    monkeypatch.setattr(classify.Tfidf, "lengths", lambda self, *a: looked.append(self.vocab) or plain(self, *a))
    wide = fit_naive_bayes(rows)
    monkeypatch.setattr(classify, "WIDE_CLASSES", 1)
    monkeypatch.setattr(classify, "BROADCAST_TEXTS", 1)
    monkeypatch.setattr(classify, "HEAVY_TERMS", 2)
    long = fit_naive_bayes(rows)
    one, two = [{r["term"]: (r["df"], [tuple(x) for x in r["lifts"]]) for r in m.terms.collect()} for m in (wide, long)]
    assert one.keys() == two.keys()
    for term, (df, lifts) in one.items():
        assert df == two[term][0] and [p for p, _ in lifts] == [p for p, _ in two[term][1]]
        assert [x for _, x in lifts] == pytest.approx([x for _, x in two[term][1]])
    assert all(v.where("df < 2").count() == 0 < v.count() for v in looked)
    asked = spark.createDataFrame(QUESTIONS, "qid bigint, text string")
    one, two = [{r.qid: (r.predicted_intent, r.confidence) for r in m.predict(asked, "qid").collect()} for m in (wide, long)]
    assert {q: i for q, (i, _) in one.items()} == {q: i for q, (i, _) in two.items()}
    assert [one[q][1] for q in sorted(one)] == pytest.approx([two[q][1] for q in sorted(two)])


def test_only_tables_that_are_read_later_stay_in_scratch(spark, examples):
    asked = spark.createDataFrame([(n, text) for n, text in QUESTIONS], "qid bigint, text string")
    with scratch_scope(spark) as folder:
        fitted = fit_naive_bayes(examples.withColumnRenamed("ex_id", "row_id"))
        known = retrieve.build_index(examples)
        got = respond.answer(asked, fitted, known, Rules(), report=True)
        assert got.count() == len(QUESTIONS)
        left = {name.rsplit("-", 1)[0] for name in os.listdir(folder.removeprefix("file:"))}
    assert left == {"nb-vocabulary", "nb-sums", "hot-values", "answer-index", "predictions", "top1", "top1-sizes"}


def test_texts_of_examples_move_only_where_they_were_found(spark, examples, index, model, monkeypatch):
    asked = spark.createDataFrame([(n, text) for n, text in QUESTIONS], "qid bigint, text string")
    want = sorted(respond.answer(asked, model, index, Rules(), report=True).collect())
    plan = respond.answer(asked, model, index, Rules(), report=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    monkeypatch.setattr(joins, "BROADCAST_KEYS", 0)
    assert sorted(respond.answer(asked, model, index, Rules(), report=True).collect()) == want


def test_null_keys_of_a_left_lookup_are_kept_and_spread(spark):
    facts = spark.range(400).select("id", F.when(F.col("id") < 4, F.col("id")).alias("k"))
    table = spark.createDataFrame([(n, f"v{n}") for n in range(3)], "k bigint, v string")
    hot = spark.createDataFrame([], "k bigint")
    got = joins.salted_lookup(facts, table, ["k"], hot, ["id"], "left")
    assert {r.id: r.v for r in got.collect()} == {n: f"v{n}" if n < 3 else None for n in range(400)}
    assert "isnull(k" in got._jdf.queryExecution().optimizedPlan().toString()
