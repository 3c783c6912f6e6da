"""Text functions, dictionary files, streams, and the registered queries against their SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from inflecta.functions import text as T
from inflecta.operators import forms
from inflecta.plans.queries import ORACLES, QUERIES
from inflecta.sources import fixture as X
from inflecta.sources import lexicon as L
from inflecta.streaming import tokens as S

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column).first()[0]


def test_tokens(spark):
    assert one(spark, T.tokens("t"), t="Don't как-нибудь a--b x_1 v2.0 -z- ½ ²") == ["don't", "как-нибудь", "a", "b", "x_1", "v2", "0", "z"]
    assert one(spark, T.tokens("t"), t="") == []


def test_garbage(spark):
    assert [one(spark, T.is_garbage("t"), t=w) for w in ("cat", "x_1", "42", "don't", "a`b-c")] == [False, True, True, False, False]


def test_split_docs_by_any_delimiter(spark):
    assert one(spark, T.split_docs("t", ".]-"), t="a..b]c-d.") == ["a", "b", "c", "d"]


def test_strip_line_and_phrase_lines(spark):
    assert one(spark, T.phrase_lines("t"), t=" a \n\n\t b\r\n") == ["a", "b"]


@pytest.mark.parametrize("code, text", [((0, 0, 3), "3"), ((4, 2, 1), "5MO1"), ((18, 214, 135), "QGLJ")])
def test_annotation(spark, code, text):
    lits = [F.lit(x) for x in code]
    assert one(spark, T.pack_annotation(*lits)) == text
    assert tuple(one(spark, T.unpack_annotation(F.lit(text)))) == code


def test_forms_are_capped_only_on_request(spark):
    lex = X.lexicon(spark)
    assert forms.generate_forms(lex, 5).count() == 5
    assert forms.generate_forms(lex).count() == sum(len(X.EN_MODELS[m]) for _, m in X.EN_LEMMAS + X.EN_CORPUS_LEMMAS)


def test_auto_keys(spark):
    keys = {r["auto_key"] for r in forms.distinct_forms(forms.generate_forms(X.lexicon(spark, ("ru", "en"), corpus=False))).select("auto_key").collect()}
    assert {"tac|3", "stac|77", "seitic|2TQB", "deklaw|1EYS", "was|3", "was|5MO1", "лешаз|2TQA"} <= keys


def test_dictionary_files(spark, tmp_path):
    flex, lemmas = X.rows("en", 0, X.EN_MODELS, X.EN_LEMMAS)
    prefixes = [("en", 0, p) for p in X.EN_PREFIXES]
    for name in ("02en", "01xx", "not a dictionary", "03"):
        (tmp_path / name).mkdir()
    (tmp_path / "02en" / "morphs.mrd").write_text(L.write_mrd(flex, prefixes, lemmas))
    (tmp_path / "02en" / "gramtab.tab").write_text(X.GRAMMAR_TAB)
    skipped = []
    lex = L.load_dictionaries(spark, str(tmp_path), skipped)
    assert skipped == ["01xx", "03"]
    assert [tuple(r) for r in lex.languages.collect()] == [("en", 0)]
    assert sorted(map(tuple, lex.flex.collect())) == sorted(flex)
    assert sorted(map(tuple, lex.prefixes.collect())) == sorted(prefixes)
    assert sorted((r["base"], r["model_no"]) for r in lex.lemmas.collect()) == sorted(X.EN_LEMMAS)
    assert {r["ancode"]: (r["pos"], list(r["grammemes"])) for r in lex.grammar.collect()} == {"aa": ("ADJECTIVE", []), "na": ("NOUN", ["sg", "narr"]), "xx": ("NOUN", ["prop"]), "vb": ("VERB", ["past", "sg"])}
    lex.write(str(tmp_path / "tables"))
    assert sorted(map(tuple, L.read_tables(spark, str(tmp_path / "tables")).lemmas.collect())) == sorted(map(tuple, lex.lemmas.collect()))
    with pytest.raises(Exception):
        L.load_dictionaries(spark, str(tmp_path / "absent"))


def mrd(spark, text):
    return {name: sorted((tuple(r) for r in rows.collect()), key=str) for name, rows in L.parse_mrd(spark.createDataFrame([(text,)], "value string"), "en", 0).items()}


def test_mrd_comments_and_empty_bases(spark):
    got = mrd(spark, "1\r\n%S*NA*UN%*nbq//q note\r\n0\r\n0\r\n1\r\nRE,UN X\r\n4\r\n# 0 1 0 - 0\r\nCAT 0 - 0 Aa -\r\nBAD x 0 0 - -\r\nSHORT\r\n")
    assert got["flex"] == [("en", 0, 0, "s", "NA", "un"), ("en", 0, 1, "", "nb", "")]
    assert got["prefixes"] == [("en", 0, p) for p in ("re", "un", "x")]
    assert got["lemmas"] == [("en", 0, "", 0, 1, None, 0), ("en", 0, "cat", 0, None, "Aa", -1)]
    assert mrd(spark, "") == mrd(spark, "no number\n") == {"flex": [], "prefixes": [], "lemmas": []}


def test_lower_case_is_by_code_point(spark):
    got = spark.createDataFrame([("\u03a3\u0391\u03a3 \u0130X \u1e9e",)], "t string").select(T.normalize("t")).first()[0]
    assert got == "\u03c3\u03b1\u03c3 ix \u00df"


def test_bytes_that_are_not_text(spark):
    rows = [(bytearray(b"caf\xc3\xa9"),), (bytearray(b"caf\xc3"),), (bytearray(b""),), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "b binary").select(T.valid_text("b")).collect()] == ["caf\u00e9", "", "", None]


def test_no_folder_of_one_machine_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from inflecta.sources import shared

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        shared.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


@pytest.mark.parametrize("name, lang", [("01ru", "ru"), ("en", "en"), ("12", ""), ("1-x", None), ("a1", None)])
def test_folder_names(name, lang):
    assert L.folder_language(name) == lang


def test_stream_works_off_each_file_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A b_1"), (2, None)], "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "in" / "t"))
    for _ in range(2):
        S.run_once(S.stream_tokens(S.read_texts(spark, str(tmp_path / "in"), "t", rows.schema)), str(tmp_path / "out"), str(tmp_path / "log"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, 0, "a", False), (1, 1, "b_1", True)]


def values(df):
    return sorted((tuple(None if v is None else v for v in r) for r in df), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = got.select(*columns).collect()
    if name not in ORACLES:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert values(rows) == values(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_a_missing_module_of_others_is_not_taken_for_a_missing_subpackage(monkeypatch):
    import builtins

    real = builtins.__import__

    def without(name):
        def load(wanted, *args, **kwargs):
            if wanted == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)
            return real(wanted, *args, **kwargs)

        return load

    monkeypatch.setattr(builtins, "__import__", without("some_hash_library"))
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__.queries()
    monkeypatch.setattr(builtins, "__import__", without("corpus_pipeline"))
    assert set(__spark_entry__.queries()) == set(QUERIES)
