import numpy as np
import pytest

from utterlake.operators import linear
from utterlake.operators.linear import LinearModel, fit_entries, fit_linear

WORDS = "pay bill card lost loan rate open close account app login code".split()


def rows(spark, keys=lambda n: n):
    draw = np.random.default_rng(5)
    texts = [" ".join([["pay bill", "lost card", "loan rate"][n % 3], *draw.choice(WORDS, 4), f"only{n}"]) for n in range(40)]
    held = [(keys(n), ["a", "b", "c"][n % 3], t) for n, t in enumerate(texts)]
    return spark.createDataFrame([*held, (900, "a", "?"), (901, None, "pay"), (902, "b", None)], "row_id bigint, intent string, text string")


@pytest.mark.parametrize("name", ["logreg", "svm"])
def test_fits_of_arrays_and_of_tables_agree(spark, monkeypatch, tmp_path, name):
    df = rows(spark)
    monkeypatch.setattr(linear, "word_bags", None)  # packed texts need no rows of terms
    packed = fit_linear(fit_entries(df), name, tolerance=1e-4)
    asked = spark.createDataFrame([(n, t) for n, t in enumerate(["pay my bill", "lost the card only7", "zzz", "loan loan rate", None])], "qid bigint, text string")
    got = {r.qid: r.scores for r in packed.scores(asked, "qid").collect()}
    monkeypatch.undo()
    packed.save(str(tmp_path / "m"))
    loaded = {r.qid: r.scores for r in LinearModel.load(spark, str(tmp_path / "m")).scores(asked, "qid").collect()}
    assert got.keys() == loaded.keys() and got[2] == got[4] == packed.bias
    for n, s in got.items():
        assert s == pytest.approx(loaded[n], abs=1e-9)
    monkeypatch.setattr(linear, "LOCAL_NUMBERS", 0)
    entries = fit_entries(df)
    assert not entries.packed
    plain = fit_linear(entries, name, tolerance=1e-4)
    assert packed.about["objective"] == pytest.approx(plain.about["objective"], rel=1e-6) and packed.converged and plain.converged
    one, two = [{r["term"]: [r["df"], r["idf"], *[r[f"w{j}"] for j in range(3)]] for r in m.terms.collect()} for m in (packed, plain)]
    assert one.keys() == two.keys()
    for term, v in one.items():
        assert v == pytest.approx(two[term], abs=2e-3)


def test_repeated_and_null_keys_are_texts_of_their_own_or_left_out(spark):
    plain, twice = rows(spark), rows(spark, lambda n: n // 2 if n else None)
    fit = fit_linear(fit_entries(twice), "svm")
    assert fit.converged
    terms = {r.term for r in fit.terms.select("term").collect()}
    every = {r.term for r in fit_linear(fit_entries(plain), "svm").terms.select("term").collect()}
    assert "only0" not in terms and {f"only{n}" for n in range(1, 40)} <= terms < every


def test_a_product_of_packed_terms_is_that_of_the_whole_matrix(spark, monkeypatch):
    from utterlake.operators import postings

    monkeypatch.setattr(postings, "PART_ENTRIES", 5)
    entries = fit_entries(rows(spark))
    found = entries.by_row.where("term != ''").collect()
    keys, terms = sorted({r.row_id for r in entries.source.collect()}), sorted({r.term for r in found})
    x = np.zeros((len(keys), len(terms)))
    for r in found:
        x[keys.index(r.row), terms.index(r.term)] = r.x
    known = {r["row"]: r["key"] for r in entries.packed.postings.texts.collect()}
    order = [keys.index(known[r]) for r in entries.packed.rows]
    numbers = np.arange(2.0 * len(keys)).reshape(-1, 2) - 9
    assert np.abs(entries.packed.product(numbers[order]) - (x @ x.T @ numbers)[order]).max() < 1e-9
