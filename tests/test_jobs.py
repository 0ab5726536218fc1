import json
import os
import re

import numpy as np
import pytest

from utterlake import schemas
from utterlake.operators import corpus, stats
from utterlake.operators.features import word_bags
from utterlake.operators.linear import LinearModel, fit_entries, fit_linear
from utterlake.operators.split import stratified_split
from utterlake.plans.prepare import PrepareOptions, prepare_dataset
from utterlake.plans.run_all import RunConfig, run_all
from utterlake.plans.train import train_classical
from utterlake.rules import Rules
from utterlake.sources import readers, writers

RULES = Rules(
    templates={"pay": "Open Pay.", "card": "Lock it.", "loan": "See loans."},
    taxonomy={"pay": ["pay_bill"], "card": ["card_lost", "pay_bill_card"]},
    focus_source="local",
    keywords=["riel"],
    routes=[],
)


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_with_quotes_and_broken_rows(spark, tmp_path):
    path = put(tmp_path / "a.csv", 'text,intent,response\n"pay, now",pay,"say ""yes"""\nbroken,row,with,four\n')
    good, bad = readers.split_corrupt(readers.read_csv(spark, path, schemas.UTTERANCES).cache())
    loose = readers.read_csv(spark, path)
    assert (loose.first().text, loose.first().response) == ("pay, now", 'say "yes"')
    assert good.columns == schemas.UTTERANCE_COLUMNS and bad.count() + good.count() == 2


def test_questions_skip_blank_lines(spark, tmp_path):
    path = put(tmp_path / "q.txt", "first \n\n   \n  second\n")
    rows = readers.read_questions(spark, path).orderBy("qid").collect()
    assert [r.text for r in rows] == ["first", "second"]


def test_alias_columns(spark):
    assert readers.detect_column([" Query ", "Text"], ["text", "query"]) == "Text"
    assert readers.detect_column(["LABEL", "label "], ["intent", "label"]) == "label "
    assert readers.detect_column(["x"], ["text"]) is None
    df = spark.createDataFrame([("q1", "Card Issue", None)], "`Question ` string, Class string, other string")
    row = readers.load_external(df, "kaggle", RULES).first()
    assert (row.text, row.intent, row.response, row.source) == ("q1", "card_issue", RULES.default_response, "kaggle")
    assert readers.load_external(df.drop("Class"), "kaggle", RULES).count() == 0


def test_regional_defaults_and_required_columns(spark):
    df = spark.createDataFrame([("t", "i", "r", "km")], "text string, intent string, response string, language string")
    row = readers.with_source_defaults(df).first()
    assert (row.language, row.channel, row.source) == ("km", "mobile", "regional_aug")
    with pytest.raises(ValueError, match="response"):
        readers.with_source_defaults(df.drop("response"))


def test_missing_sources(spark, tmp_path):
    missing = str(tmp_path / "none.csv")
    load = lambda p: readers.with_source_defaults(readers.read_utterances(spark, p))
    assert readers.optional(spark, missing, load).count() == 0
    assert readers.optional(spark, "", load).columns == ["row_id", *schemas.UTTERANCE_COLUMNS]
    said = []
    path = put(tmp_path / "ok.csv", "text,intent,response\na,b,c\n")
    found = readers.first_available([lambda: load(missing), lambda: load(path)], said.append)
    assert found.count() == 1 and len(said) == 1
    assert readers.first_available([lambda: load(missing)], said.append) is None


def test_answer_table_round_trip(spark, tmp_path):
    rows = [(0, "b", "t0", "r0"), (1, "a", "t1", None), (2, "b", "t2", "r2")]
    df = spark.createDataFrame(rows, "row_id bigint, intent string, text string, response string")
    flat = stats.build_answer_table(df)
    path = writers.write_answer_table(flat, str(tmp_path / "answers"))
    assert sorted(readers_rows(writers.read_answer_table(spark, path))) == sorted(readers_rows(flat))
    nested = {"b": [{"text": "t0", "response": "r0"}, {"text": "t2", "response": "r2"}], "a": [{"text": "t1", "response": None}]}
    doc = readers.read_answer_document(spark, put(tmp_path / "n.json", json.dumps(nested, indent=2)))
    assert sorted(readers_rows(doc)) == sorted(readers_rows(flat))


def readers_rows(df):
    return [(r.intent, r.ex_idx, r.text, r.response or "") for r in df.collect()]


def test_prompt_lines_are_ascii(spark, tmp_path):
    df = spark.createDataFrame([("café", "ok", "pay")], "text string, response string, intent string")
    path = writers.write_prompt_jsonl(df, str(tmp_path / "p"))
    lines = "".join(open(f"{path}/{f}", encoding="utf-8").read() for f in os.listdir(path) if f.endswith(".json"))
    assert lines.isascii()
    assert json.loads(lines) == {"prompt": "café", "response": "ok", "category": "pay"}
    assert readers.read_jsonl(spark, path, schemas.PROMPT_CORPUS).first().prompt == "café"


def test_runs(spark, tmp_path):
    for run in ("f_20240101_000000", "f_20250101_000000"):
        spark.createDataFrame([(run,)], "x string").write.parquet(f"{writers.run_path(str(tmp_path), 'f', run)}/t")
    assert writers.latest_run(spark, str(tmp_path), "f", "t").first().x == "f_20250101_000000"


def test_corpus_forms(spark):
    rows = [(0, " q ", "a", "i"), (1, " q ", "a", "j"), (2, "z", None, "i"), (3, None, "b", "i")]
    df = spark.createDataFrame(rows, "position bigint, text string, response string, intent string")
    train = corpus.to_lm_corpus(df, include_intent=True).collect()
    assert [r.text for r in train] == ["Intent: i\nUser: q\nAssistant: a"]
    test = corpus.to_lm_corpus(df, is_test=True).orderBy("position").collect()
    assert [r.text for r in test] == ["User: q", "User: q", "User: z"]
    built = corpus.unify_corpus(spark.createDataFrame([("p", "r"), (None, "r")], "prompt string, response string"), eos="!")
    assert [r.text for r in built.collect()] == ["User: p\nAssistant: r!"]
    with pytest.raises(ValueError, match="response"):
        corpus.unify_corpus(spark.createDataFrame([("p",)], "prompt string"))


def sample(spark, n=12):
    rows = [(i, f"Pay bill number {i} in riel" if i % 2 else f"My card {i} is lost", "Pay" if i % 2 else " card ", " r ", "en", "m", "web") for i in range(n)]
    return spark.createDataFrame(rows, schemas.POSITIONED_UTTERANCES)


def test_prepare_dataset(spark):
    base = sample(spark)
    odd = [
        (0, "pay BILL number 1, in riel!", "pay", "late", "en", "m", "dup"),
        (1, "ab", "pay", "short", "en", "m", "web"),
        (2, None, "pay", "null", "en", "m", "web"),
        (3, "unknown intent here", "other", "x", "en", "m", "web"),
    ]
    data = prepare_dataset([base, spark.createDataFrame(odd, schemas.POSITIONED_UTTERANCES)], RULES, PrepareOptions(min_per_intent=10))
    rows = data.full.collect()
    assert len(rows) == len({(r.text, r.intent) for r in rows}) == 12 + 4 + 3 + 10
    assert {r.intent for r in rows} == {"pay", "card", "loan"}
    first = [r for r in rows if r.text == "pay bill number 1 in riel"]
    assert [(r.source, r.response) for r in first] == [("web", "r")]
    counts = {(r.kind, r.key): r.value for r in data.stats.collect()}
    assert counts[("rows", "total")] == 29
    assert counts[("rows", "test")] == 3 and counts[("rows", "val")] == 3
    assert data.train.count() + data.val.count() + data.test.count() == 29


def test_focus_mode(spark):
    data = prepare_dataset([sample(spark)], RULES, PrepareOptions(min_per_intent=20, focus=True))
    texts = [r.text for r in data.full.collect()]
    assert sum("riel" in t for t in texts) == 6
    assert sum(t.startswith("cambodia card in phnom penh") for t in texts) == 20
    with pytest.raises(RuntimeError, match="empty"):
        prepare_dataset([sample(spark).where("intent = ' card '")], RULES, PrepareOptions(focus=True))
    with pytest.raises(RuntimeError, match="empty"):
        prepare_dataset([readers.empty_utterances(spark)], RULES)


def test_training_names_a_best_model(spark, tmp_path):
    rows = sample(spark, 60)
    result = train_classical(rows)
    scores = {r.model: r.accuracy for r in result.metrics.collect()}
    assert set(scores) == {"logreg", "naive_bayes", "svm"}
    assert min(scores.values()) >= 0.9
    assert result.best == max(["logreg", "naive_bayes", "svm"], key=lambda m: scores[m])
    held = sample(spark, 10)
    single = train_classical(rows, "naive_bayes", eval_df=held)
    report = {r.label: r.support for r in single.reports["naive_bayes"].collect()}
    assert report["accuracy"] == 10
    with pytest.raises(ValueError, match="no such model"):
        train_classical(rows, "tree")


def test_full_run(spark, tmp_path):
    bench = tmp_path / "bench"
    bench.mkdir()
    lines = ["text,label,label_name"] + [f'"pay my bill, number {i}",0,pay_bill' for i in range(20)]
    lines += [f"lost card {i},1,card_lost" for i in range(20)] + ["ignored,2,other"]
    put(bench / "train.csv", "\n".join(lines) + "\n")
    put(bench / "test.csv", "text,label,label_name\nextra card text,1,card_lost\n")
    regional = put(tmp_path / "regional.csv", "text,intent,response\nloan in riel, loan,ask\nanother loan text,loan,ask\n")
    external = put(tmp_path / "ext.jsonl", '{"question": "what about loans", "answer": "see", "label": "Loan"}\n')
    config = RunConfig(
        output=str(tmp_path / "out"),
        benchmark=[str(tmp_path / "missing"), str(bench)],
        regional=[regional, ""],
        external={"faq": external},
        model="naive_bayes",
        options=PrepareOptions(min_per_intent=12),
    )
    data, result = run_all(spark, config, RULES)
    sources = {r.key: r.value for r in data.stats.where("kind = 'source'").collect()}
    assert sources == {"banking77_local": 41, "faq": 1, "regional_aug": 2, "synthetic_seed": 9}
    assert result.best == "naive_bayes"
    stats_file = [f for f in os.listdir(tmp_path / "out/dataset/stats") if f.endswith(".json")][0]
    document = json.loads((tmp_path / "out/dataset/stats" / stats_file).read_text())
    assert document["total_samples"] == 53 and document["intents"] == ["card", "loan", "pay"]
    again = spark.read.option("header", True).csv(str(tmp_path / "out/dataset/train"))
    assert again.count() == document["train_samples"]


def test_rules_from_json(tmp_path):
    rules = Rules.from_json(put(tmp_path / "r.json", json.dumps({"templates": {"a": "b"}})))
    assert rules.templates == {"a": "b"} and rules.default_response
    with pytest.raises(ValueError, match="unknown rule names"):
        Rules.from_json(put(tmp_path / "s.json", json.dumps({"tempaltes": {}})))


def test_csv_keeps_quotes_breaks_and_blanks(spark, tmp_path):
    rows = [("1", 'say "yes",\nthen "no"'), ("2", "  outer blanks \n"), ("3", "é, ü"), ("4", None)]
    path = writers.write_csv(spark.createDataFrame(rows, "id string, text string"), str(tmp_path / "c"))
    assert sorted(tuple(r) for r in readers.read_csv(spark, path).collect()) == rows


def test_linear_models_keep_every_term_and_load(spark, tmp_path):
    rows = sample(spark, 40)
    result = train_classical(rows, "svm")
    model = result.models["svm"]
    assert model.converged
    terms = set()
    for r in rows.collect():
        words = [w for w in re.split(r"[^0-9a-z_]+", r.text.lower()) if w]
        terms.update(words)
    known = {r.term for r in model.terms.select("term").collect()}
    assert {t for t in terms if len(t) > 1} >= {t for t in known if " " not in t}
    train = rows.join(stratified_split(rows, "intent", 0.2).where("split = 'train'").select("row_id"), "row_id")
    assert known == {t for r in word_bags(train, "row_id").collect() for t in r.terms}
    model.save(str(tmp_path / "svm"))
    again = LinearModel.load(spark, str(tmp_path / "svm"))
    asked = rows.select("row_id", "text")
    one, two = [sorted(tuple(r) for r in m.predict(asked, "row_id").select("row_id", "predicted_intent").collect()) for m in (model, again)]
    assert one == two and (again.name, again.labels) == ("svm", model.labels)


def plain_fit(x, y, k, name, weight):
    """Gradient descent in NumPy on the same objective, with the last column of ``x`` as the bias."""
    free = np.ones(x.shape[1])
    free[-1] = 0.0 if name == "logreg" else 1.0
    one = np.eye(k)[y]

    def value(w):
        m = x @ w
        if name == "logreg":
            p = np.exp(m - m.max(1, keepdims=True))
            total = p.sum(1, keepdims=True)
            loss = weight @ (np.log(total[:, 0]) + m.max(1) - (m * one).sum(1))
            slope = weight[:, None] * (p / total - one)
        else:
            short = np.maximum(0, 1 - (2 * one - 1) * m)
            loss, slope = (short**2).sum(), -2 * (2 * one - 1) * short
        return loss + 0.5 * (free[:, None] * w * w).sum(), x.T @ slope + free[:, None] * w

    w, step = np.zeros((x.shape[1], k)), 0.1
    f, g = value(w)
    for _ in range(20_000):
        while (new := value(w - step * g))[0] > f - 0.3 * step * (g * g).sum():
            step /= 2
            if step < 1e-12:
                return w, f
        w, (f, g), step = w - step * g, new, step * 1.5
        if (g * g).sum() < 1e-12:
            break
    return w, f


@pytest.mark.parametrize("name", ["logreg", "svm"])
def test_linear_fits_equal_plain_ones(spark, name):
    rows = sample(spark, 12).limit(30)
    entries = fit_entries(rows)
    model = fit_linear(entries, name, tolerance=1e-4)
    found = entries.by_row.collect()
    terms = sorted({r.term for r in found} - {""}) + [""]
    keys = sorted({r.row for r in found})
    x = np.zeros((len(keys), len(terms)))
    for r in found:
        x[keys.index(r.row), terms.index(r.term)] = r.x
    label = {r.row: r.y for r in entries.rows.collect()}
    y, k = np.array([label[n] for n in keys]), len(entries.sizes)
    weight = np.array([len(keys) / (k * entries.sizes[c][1]) for c in y])
    w, f = plain_fit(x, y, k, name, weight)
    assert abs(model.about["objective"] - f) < 1e-4 * f and model.converged
    got = {r.term: [r[f"w{j}"] for j in range(k)] for r in model.terms.collect()}
    assert np.abs(np.array([got[t] for t in terms[:-1]]) - w[:-1]).max() < 2e-3
    margins = {r.row_id: r.scores for r in model.scores(rows.select("row_id", "text")).collect()}
    assert np.abs(np.array([margins[n] for n in keys]) - x @ w).max() < 5e-3



def test_a_product_over_blocks_is_that_of_the_whole_matrix(spark, monkeypatch):
    from pyspark.sql import functions as F

    from utterlake.operators import linear

    monkeypatch.setattr(linear, "PACK", 7)
    monkeypatch.setattr(linear, "BLOCK_ENTRIES", 10)
    entries = fit_entries(sample(spark, 12).limit(30))
    assert entries.blocks.count > 4
    found = entries.by_row.where("term != ''").collect()
    keys, terms = sorted({r.row for r in entries.rows.collect()}), sorted({r.term for r in found})
    x = np.zeros((len(keys), len(terms)))
    for r in found:
        x[keys.index(r.row), terms.index(r.term)] = r.x
    numbers = np.arange(2.0 * len(keys)).reshape(-1, 2) - 9
    got = entries.blocks.product(spark.createDataFrame([(n, *map(float, v)) for n, v in zip(keys, numbers)], "row bigint, r0 double, r1 double"), 2)
    rows = {r["row"]: (r["q0"], r["q1"]) for r in got.collect()}
    assert np.abs(np.array([rows[n] for n in keys]) - x @ x.T @ numbers).max() < 1e-9
    # What a fit keeps has one row for each text and none for a term.
    fit = linear.minimise(entries.blocks, entries.rows.withColumn("weight", F.lit(1.0)), len(entries.sizes), linear.LOSSES["svm"], 1.0, False, 1e-2, 5)
    assert fit.numbers.count() == len(keys) < len(terms)
