"""The plain-string functions against the model, and the SQL functions against the engine."""

import random

import pytest

from inflecta import api
from inflecta.functions import sql
from inflecta.functions.kernel import Dictionary, Kernel, tokens
from inflecta.plans.engine import MorphEngine
from inflecta.sources import fixture as X
from inflecta.sources import lexicon as L
from inflecta.sources import shared
from tests.model import Model
from tests.test_engine import DOC, EN, PAIRS, RU, SEARCHES, random_text


def dictionary(models, lemmas, prefixes):
    return Dictionary([(m, f, *(x if isinstance(x, tuple) else ("", x))) for m, forms in enumerate(models) for f, x in enumerate(forms)], lemmas, prefixes)


@pytest.fixture(scope="module")
def kernel():
    return Kernel({"ru": dictionary(*RU), "en": dictionary(*EN)})


def test_fixed_cases(kernel):
    assert {p: kernel.search(DOC, p) for p in SEARCHES} == SEARCHES
    for d, s, one, two in PAIRS:
        assert kernel.str_intersect_str(d, s) == pytest.approx(one) and kernel.str_intersect_str2(d, s) == pytest.approx(two)
    assert kernel.normalize_phrase("книга, книгой столик вот и зашел сосед") == "книга книга столик вот и зайти сосед "
    assert kernel.normalize_phrase("a") == "" and tokens("Don't a--b x_1 v2.0 ½ ²".lower()) == ["don't", "a", "b", "x_1", "v2", "0"]


def test_against_the_model(kernel):
    model, rng = Model({"ru": RU, "en": EN}), random.Random(21)
    for _ in range(300):
        d, s = random_text(rng, rng.randint(0, 12)), random_text(rng, rng.randint(0, 4)).replace("\n", " ")
        assert kernel.search(d, s) == model.search(d.lower(), s.lower())
        assert kernel.str_intersect_str(d, s) == pytest.approx(model.intersect(d, s))
        assert kernel.normalize_phrase(d) == model.normalize_phrase(d)


def test_sql_functions(spark):
    lexicon = X.lexicon(spark, ("ru", "en"), corpus=False)
    sql.register(spark, Kernel.from_lexicon(lexicon))
    rows = spark.createDataFrame([(i, d, s) for i, (d, s, _, _) in enumerate(PAIRS)] + [(99, None, "x")], "id long, d string, s string")
    rows.createOrReplaceTempView("pairs")
    got = {r["id"]: r for r in spark.sql("SELECT id, str_intersect_str(d, s) AS a, str_intersect_str2(d, s) AS b, str_case_str(d, s) AS c, normalize_phrase(d) AS n FROM pairs").collect()}
    e = MorphEngine(spark, lexicon)
    for name, found in (("a", e.intersect_pairs(rows, "id", "d", "s")), ("b", e.intersect_pairs(rows, "id", "d", "s", False))):
        want = {r["id"]: r["score"] for r in found.collect()}
        assert {i: pytest.approx(want[i]) for i in want} == {i: r[name] for i, r in got.items()}
    assert {r["id"]: r["normalized"] for r in e.normalize_phrase(rows, "id", "d").collect()} == {i: r["n"] for i, r in got.items()}
    assert {r["id"]: r["contained"] for r in e.contains_pairs(rows, "id", "d", "s").collect()} == {i: r["c"] for i, r in got.items()}
    assert [tuple(r) for r in spark.sql("SELECT pos, token FROM tokens('A b_1')").collect()] == [(0, "a"), (1, "b_1")]
    some = spark.sql("SELECT detect_language('cats') AS a, detect_language('x_1') AS b, lemmas('saw', 'en') AS c, word_forms('colder', 'en') AS d, lemmas('saw', 'xx') AS e, lemmas(null, 'en') AS f").first()
    assert tuple(some) == ("en", None, ["saw", "see"], ["cold", "colder", "coldest"], [], [])
    assert [r[0] for r in spark.sql("SELECT match FROM search('The cats saw a cat', 'cat')").collect()] == ["cat", "cats"]
    with pytest.raises(ValueError):
        Kernel.from_lexicon(lexicon, limit=3)


def test_api(spark, tmp_path):
    with pytest.raises(RuntimeError):
        api.normalize_phrase("x")
    assert api.init() == 1 and api.str_intersect_str("cats", "cat") == 0.0
    flex, lemmas = X.rows("en", 0, X.EN_MODELS, X.EN_LEMMAS)
    (tmp_path / "01en").mkdir()
    (tmp_path / "01en" / "morphs.mrd").write_text(L.write_mrd(flex, [("en", 0, "re")], lemmas))
    (tmp_path / "01en" / "gramtab.tab").write_text(X.GRAMMAR_TAB)
    assert api.init(str(tmp_path), spark) == 1
    assert api.str_intersect_str("cats", "cat") == 1.0 and api.str_intersect_str("cats") == 0.0 and api.str_intersect_str2() == 0.0
    assert api.str_case_str(DOC, "two city") == 1 and api.str_case_str(DOC, "dog") == 0 and api.normalize_phrase() == ""
    assert api.normalize_phrase("rewalked cities") == "rewalk city "
    with pytest.raises(Exception):
        api.init(str(tmp_path / "absent"), spark)
    api.destroy()
    with pytest.raises(RuntimeError):
        api.str_case_str("a", "a")


def test_built_tables(spark, tmp_path):
    e = MorphEngine(spark, X.lexicon(spark, corpus=False))
    e.build(str(tmp_path / "t"))
    again = MorphEngine.from_tables(spark, str(tmp_path / "t"))
    words = spark.createDataFrame([("walks",), ("stalked",), ("rewalked",)], "token string")
    assert sorted(map(tuple, again.word_forms(words).collect())) == sorted(map(tuple, e.word_forms(words).collect()))
    assert again.word_forms(words, True).count() >= again.word_forms(words).count()
    e.close()


def test_contains_in_compat_mode(spark):
    e = MorphEngine.identity(spark)
    pairs = spark.createDataFrame([(1, 1)], "id long, phrase_id long")
    index = e.index(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "b")], "phrase_id long, phrase string")
    assert e.contains(index, asked, pairs).first()["contained"] == 0
    assert e.contains(index, asked, pairs, compat=True).first()["contained"] == 1


def test_shared_tables_are_forgotten(spark):
    import os

    df = shared.written(spark.range(3).toDF("n"), "test")
    path = shared._tables[-1].removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(path)
    shared.forget(spark)
    assert not os.path.isdir(path)
