"""One registered query per operator, and the SQL each is held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inflecta.functions import text as T
from inflecta.operators import analyze, forms, search
from inflecta.plans import oracle as O
from inflecta.plans.engine import MorphEngine
from inflecta.sources import fixture as X
from inflecta.sources import lexicon as L
from inflecta.sources.shared import by_sort, shared_dir, spread, written
from inflecta.streaming import tokens as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


_engines: dict[tuple, MorphEngine] = {}


def engine(spark: SparkSession, *languages: str) -> MorphEngine:
    """The engine of the fixture lexicon, one for each session and languages."""
    key = (spark.sparkContext.applicationId, id(spark), languages)
    if key not in _engines:
        _engines[key] = MorphEngine(spark, X.lexicon(spark, languages or ("en",)))
    return _engines[key]


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of the corpus."""
    return spread(documents(spark, sf_dir)).select(F.explode_outer(T.tokens("text")).alias("token")).where("token is not null").distinct()


def as_long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# --- texts ---


@query("SELECT doc_id, lower(text) AS text FROM documents")
def q01_normalize_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.normalize("text").alias("text"))


@query(f"WITH {O.TOKENS} SELECT doc_id, pos, token FROM tok")
def q02_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_long(documents(spark, sf_dir).select("doc_id", F.posexplode_outer(T.tokens("text")).alias("pos", "token")).where("token is not null"), "pos")


@query(f"WITH {O.TOKENS} SELECT lang, count(*) AS n_tokens, count(*) FILTER (regexp_matches(token, '{O.GARBAGE}')) AS n_garbage FROM tok JOIN documents USING (doc_id) GROUP BY lang")
def q03_garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").select("lang", F.explode(T.tokens("text")).alias("token"))
    return each.groupBy("lang").agg(F.count("*").alias("n_tokens"), F.count_if(T.is_garbage("token")).alias("n_garbage"))


@query("SELECT doc_id, unnest(range(len(p))) AS piece_no, unnest(p) AS piece FROM (SELECT doc_id, list_filter(string_split_regex(text, '[.\n]'), lambda x: x <> '') AS p FROM documents)")
def q04_split_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_long(documents(spark, sf_dir).select("doc_id", F.posexplode(T.split_docs("text", ".\n")).alias("piece_no", "piece")), "piece_no")


@query("SELECT doc_id, strlen(text) AS n_bytes FROM documents")
def q05_byte_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.byte_length("text").alias("n_bytes"))


PHRASES = ["cat", "!cat", "en|walks", "en|!walks", "ru|cat", "|x", "!", "a|b|c", "e|!a!b", "", "!en|x", "мастер"]
_parsed = "CASE WHEN contains(p, '|') THEN substr(p, instr(p, '|') + 1) ELSE p END"


@query(f"SELECT p AS phrase, CASE WHEN contains(p, '|') THEN left(p, instr(p, '|') - 1) END AS lang, starts_with({_parsed}, '!') AS exact, CASE WHEN starts_with({_parsed}, '!') THEN substr({_parsed}, 2) ELSE {_parsed} END AS text FROM ({O.values([(p,) for p in PHRASES])}) AS v(p)")
def q06_parse_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(p,) for p in PHRASES], "phrase string")
    return rows.withColumn("p", T.parse_phrase("phrase")).select("phrase", "p.lang", "p.exact", "p.text")


# --- lexicon ---


@query(f"SELECT * FROM ({O.values([('en', 'aa', 'ADJECTIVE', ''), ('en', 'na', 'NOUN', 'sg,narr'), ('en', 'xx', 'NOUN', 'prop'), ('en', 'vb', 'VERB', 'past,sg')])}) AS v(lang, ancode, pos, grammemes)")
def q07_grammar_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.parse_grammar(spark.createDataFrame([(X.GRAMMAR_TAB,)], "value string"), "en")
    return rows.withColumn("grammemes", F.array_join("grammemes", ","))


@query(f"WITH {O.lexicon()} SELECT lang, form, CAST(model_no AS BIGINT) AS model_no, CAST(form_no AS BIGINT) AS form_no, CAST(flex_len AS BIGINT) AS flex_len, CAST(base_len AS BIGINT) AS base_len FROM gen")
def q08_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_long(forms.generate_forms(X.lexicon(spark)).drop("ancode"), "model_no", "form_no", "flex_len", "base_len")


@query(f"WITH {O.lexicon()} SELECT form, code36, CAST(model_no AS BIGINT) AS model_no, CAST(flex_len AS BIGINT) AS flex_len, CAST(base_len AS BIGINT) AS base_len FROM frm")
def q09_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    unpacked = engine(spark).forms.select("form", "code36", T.unpack_annotation(F.col("code36")).alias("u"))
    return as_long(unpacked.select("form", "code36", "u.*"), "model_no", "flex_len", "base_len")


_found = "token, CAST(model_no AS BIGINT) AS model_no, CAST(flex_len AS BIGINT) AS flex_len, CAST(base_len AS BIGINT) AS base_len"


def _candidates(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    found = engine(spark).candidates(words(spark, sf_dir)).where(F.col("kind") == kind)
    return as_long(found.select("token", "model_no", "flex_len", "base_len"), "model_no", "flex_len", "base_len")


@query(O.analysis(f"SELECT {_found} FROM can WHERE kind = 'exact'"))
def q10_exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, "exact")


@query(O.analysis("SELECT token, known_len FROM knw"))
def q11_longest_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_long(engine(spark).known_suffix(words(spark, sf_dir)).select("token", "known_len"), "known_len")


@query(O.analysis(f"SELECT {_found} FROM can WHERE kind = 'guess'"))
def q12_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, "guess")


@query(O.analysis(f"SELECT {_found} FROM can WHERE kind = 'prefix'"))
def q13_known_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, "prefix")


@query(O.analysis("SELECT token, word, frequency, rank FROM lmm"))
def q14_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_long(engine(spark).lemmas(words(spark, sf_dir)).select("token", "word", "frequency", "rank"), "rank")


@query(O.analysis("SELECT token, word, frequency, rank FROM fms"))
def q15_all_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_long(engine(spark).word_forms(words(spark, sf_dir)).select("token", "word", "frequency", "rank"), "rank")


_grammar = O.values([("en", a, p, ",".join(g)) for a, p, g in X.EN_ANCODES])


@query(O.analysis(f"SELECT token, word, ancode, pos, grammemes FROM fms LEFT JOIN (SELECT * FROM ({_grammar}) AS v(lang, ancode, pos, grammemes)) USING (lang, ancode)"))
def q16_grammar_of_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark)
    out = forms.forms_with_grammar(e.word_forms(words(spark, sf_dir)), e.lexicon)
    return out.select("token", "word", "ancode", "pos", F.array_join("grammemes", ",").alias("grammemes"))


# --- languages ---


@query(O.analysis(f"SELECT token, CASE WHEN NOT regexp_matches(token, '{O.GARBAGE}') THEN d END AS detected FROM (SELECT DISTINCT token FROM src) LEFT JOIN (SELECT token, arg_max(lang, known_len * 10 - lang_ord) AS d FROM knw JOIN lng USING (lang) GROUP BY token) USING (token)", ("en", "de")))
def q17_detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, "en", "de").detect_language(words(spark, sf_dir))


# a word's letters: its language (- for none, nothing for garbage) and the languages that have a lemma for it; the fold
# appends two letters a word, the language of analysis and the state
_letter = "CASE {} WHEN 'en' THEN 'e' WHEN 'de' THEN 'd' ELSE '-' END"


@query(O.analysis(f"""
, lml AS (SELECT token, lang, list(word ORDER BY rank) AS ls FROM lmm GROUP BY token, lang),
det AS (SELECT token, arg_max(lang, known_len * 10 - lang_ord) AS d FROM knw JOIN lng USING (lang) GROUP BY token),
cod AS (SELECT token, {_letter.format("d")} || coalesce(m, '') AS x FROM wrd LEFT JOIN det USING (token)
  LEFT JOIN (SELECT token, string_agg({_letter.format("lang")}, '') AS m FROM lml GROUP BY token) USING (token)),
dcs AS (SELECT doc_id, list(coalesce(x, '') ORDER BY pos) AS xs FROM tok LEFT JOIN cod USING (token) GROUP BY doc_id),
fld AS (SELECT doc_id, list_reduce(list_prepend('-', xs), lambda a, x: a || CASE
  WHEN x = '' THEN '-' || right(a, 1)
  WHEN right(a, 1) <> '-' AND contains(substr(x, 2), right(a, 1)) THEN right(a, 1) || right(a, 1)
  WHEN x[1] = '-' THEN 'e' || right(a, 1)
  ELSE x[1] || x[1] END) AS path FROM dcs),
wds AS (SELECT doc_id, pos, token, CASE substr(path, 2 + 2 * CAST(pos AS INT), 1) WHEN 'e' THEN 'en' WHEN 'd' THEN 'de' END AS lang FROM tok JOIN fld USING (doc_id))
SELECT doc_id, pos, w.token AS surface, w.lang AS lang, array_to_string(list_append(list_filter(coalesce(ls, []), lambda k: k <> w.token), w.token), '.') AS keys
FROM wds w LEFT JOIN lml USING (token, lang)""".lstrip(), ("en", "de")))
def q18_context_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language carried from word to word."""
    index = engine(spark, "en", "de").index(documents(spark, sf_dir))
    return index.words.select(F.col("id").alias("doc_id"), F.explode("words").alias("w")).select("doc_id", F.col("w.pos").cast("long").alias("pos"), F.col("w.surface").alias("surface"), F.col("w.lang").alias("lang"), F.array_join("w.keys", ".").alias("keys"))


# --- documents ---


@query(f"WITH {O.TOKENS}, src AS (SELECT token FROM tok), {O.lexicon()}, {O.ANALYSIS}, {O.KEYS} SELECT token, array_to_string(keys, '.') AS keys FROM dsc")
def q19_word_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = words(spark, sf_dir).select(F.col("token").alias("id"), F.array("token").alias("tokens"), F.lit(None).cast("string").alias("state"))
    return engine(spark).describe(each).select(F.col("id").alias("token"), F.array_join(F.col("words")[0]["keys"], ".").alias("keys"))


_docs = "SELECT doc_id AS id, text FROM documents"
_no_probe = "SELECT 0 AS phrase_id, 0 AS piece_no, 0 AS line_no, false AS exact, 1 AS n, 0 AS token_no, 'x' AS token WHERE false"


@query(O.described(_docs, _no_probe, "SELECT key, count(DISTINCT id) AS n_docs, count(*) AS n_postings FROM pst GROUP BY key"))
def q20_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = engine(spark).index(documents(spark, sf_dir)).postings
    per_doc = posts.groupBy("key", "id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("key").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_postings"))


SEARCHES = {
    "q21_phrase_search": [(1, "the that", [(False, ["the", "that"])]), (2, "threing of", [(False, ["threing", "of"])]), (3, "in the and", [(False, ["in", "the", "and"])]), (4, "nowhere at all", [(False, ["nowhere", "at", "all"])])],
    "q22_multi_phrase": [(1, "that\n  thre \n\nthe that", [(False, ["that"]), (False, ["thre"]), (False, ["the", "that"])]), (2, "tioned\nnowhere", [(False, ["tioned"]), (False, ["nowhere"])])],
    "q23_exact_phrase": [(1, "!that", [(True, ["that"])]), (2, "!thats", [(True, ["thats"])]), (3, "!the that", [(True, ["the", "that"])])],
    "q24_lang_phrase": [(1, "en|thats", [(False, ["thats"])]), (2, "ru|thats", [(False, ["thats"])]), (3, "e|!thats", [(True, ["thats"])]), (4, "|tions the", [(False, ["tions", "the"])])],
}
_joined = "SELECT id AS doc_id, CAST(phrase_id AS BIGINT) AS phrase_id, string_agg(surface, chr(10) ORDER BY surface) || chr(10) AS result FROM (SELECT DISTINCT id, phrase_id, surface FROM mat) GROUP BY id, phrase_id"


def _phrases(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([(i, p) for i, p, _ in SEARCHES[name]], "phrase_id long, phrase string")


def _search(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark)
        return e.search(e.index(documents(spark, sf_dir)), _phrases(spark, name)).withColumnRenamed("id", "doc_id")

    run.__name__ = name
    return run


for _name, _asked in SEARCHES.items():
    query(O.described(_docs, O.phrase_probes([(i, lines) for i, _, lines in _asked]), _joined))(_search(_name))


@query(O.described(_docs, O.phrase_probes([(i, lines) for i, _, lines in SEARCHES["q21_phrase_search"]]), "SELECT d.id AS doc_id, CAST(p.phrase_id AS BIGINT) AS phrase_id, CAST(m.id IS NOT NULL AS BIGINT) AS contained FROM dcs d CROSS JOIN (SELECT DISTINCT phrase_id FROM ask) p LEFT JOIN (SELECT DISTINCT id, phrase_id FROM mat) m ON d.id = m.id AND p.phrase_id = m.phrase_id"))
def q25_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, docs = engine(spark), documents(spark, sf_dir)
    phrases = [i for i, _, _ in SEARCHES["q21_phrase_search"]]
    pairs = docs.select(F.col("doc_id").alias("id"), F.explode(F.array(*[F.lit(i).cast("long") for i in phrases])).alias("phrase_id"))
    found = e.contains(e.index(docs), _phrases(spark, "q21_phrase_search"), pairs)
    return as_long(found.withColumnRenamed("id", "doc_id"), "contained")


# --- scores ---

_searches = "SELECT item_id AS phrase_id, text FROM benchmark"
_scores = "SELECT id AS doc_id, phrase_id AS item_id, score FROM scr"


def _scored(spark: SparkSession, sf_dir: str, e: MorphEngine, guard: bool) -> DataFrame:
    found = e.intersect(e.index(documents(spark, sf_dir)), table(spark, sf_dir, "benchmark"), "item_id", "text", guard)
    return found.select(F.col("id").alias("doc_id"), F.col("phrase_id").alias("item_id"), "score")


@query(O.scored(_docs, _searches, True, _scores))
def q26_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, engine(spark), True)


@query(O.scored(_docs, _searches, False, _scores))
def q27_intersect2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, engine(spark), False)


_turns = "SELECT DISTINCT text AS id, text FROM conversations WHERE text IS NOT NULL"
_first = "list_transform(list(keys[1] || ' ' ORDER BY pos), lambda x: x)"


@query(O.described(_turns, _no_probe, f"""SELECT id AS text, CASE WHEN strlen(array_to_string(f, '')) < 2 * strlen(id) THEN array_to_string(f, '')
  ELSE list_reduce(list_prepend('', f), lambda a, k: CASE WHEN strlen(a) + strlen(k) < 2 * strlen(id) THEN a || k ELSE a END) END AS normalized
FROM (SELECT d.id, coalesce(f, CAST([] AS VARCHAR[])) AS f FROM dcs d LEFT JOIN (SELECT id, {_first} AS f FROM tok JOIN dsc USING (token) GROUP BY id) USING (id))"""))
def q28_normalize_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("text").dropna().distinct()
    return engine(spark).normalize_phrase(turns, "text", "text").withColumnRenamed("id", "text")


_piece_docs = "SELECT CAST(unnest(range(len(p))) AS VARCHAR) || '#' || id AS id, unnest(p) AS text FROM (SELECT id, list_filter(string_split_regex(id, '[.!?\n]'), lambda x: x <> '') AS p FROM (SELECT DISTINCT text AS id FROM conversations WHERE text IS NOT NULL))"


@query(O.scored(_piece_docs, _searches, False, "SELECT id AS piece, phrase_id AS item_id, score FROM scr"))
def q29_doc_array_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("text").dropna().distinct()
    pieces = turns.select("text", F.posexplode(T.split_docs("text", ".!?\n")).alias("n", "t")).select(F.concat(F.col("n").cast("string"), F.lit("#"), "text").alias("id"), "t")
    # numbers, as an id that holds the whole turn would go along with each word
    pieces, e = written(pieces.withColumn("no", F.monotonically_increasing_id()), "pieces"), engine(spark)
    found = e.intersect(e.index(pieces, "no", "t"), table(spark, sf_dir, "benchmark"), "item_id", "text", False).withColumnRenamed("id", "no")
    return by_sort(found, pieces.select("no", "id"), "no").select(F.col("id").alias("piece"), F.col("phrase_id").alias("item_id"), "score")


@query(f"WITH {O.TOKENS} SELECT doc_id AS id, pos, token, regexp_matches(token, '{O.GARBAGE}') AS garbage FROM tok")
def q30_stream_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream, worked off once into a table of the shared folder."""
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{sf_dir}/documents.parquet"
    stream = S.stream_tokens(S.read_texts(spark, sf_dir, "documents.parquet", spark.read.parquet(path).schema))
    S.run_once(stream, f"{out}/tokens", f"{out}/log")
    return as_long(spark.read.schema(stream.schema).parquet(f"{out}/tokens"), "pos")


@query(f"""WITH {O.TOKENS},
pst AS (SELECT DISTINCT doc_id, token FROM tok),
pcs AS (SELECT DISTINCT item_id, piece_no, unnest({O.words_of("piece")}) AS token FROM
  (SELECT item_id, unnest(range(len(ps))) AS piece_no, unnest(ps) AS piece FROM (SELECT item_id, string_split(lower(text), ' ') AS ps FROM benchmark))),
cov AS (SELECT doc_id, item_id, sum(strlen(token) + 1)::DOUBLE AS covered FROM pst JOIN pcs USING (token) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CASE WHEN strlen(b.text) > strlen(d.text) THEN 0.0 WHEN covered >= strlen(d.text) THEN 1.0 ELSE covered / strlen(d.text) END AS score
FROM cov JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)""")
def q31_intersect_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores without a lexicon; the SQL takes every line of a search's pieces as one word, which holds for `benchmark`."""
    return _scored(spark, sf_dir, MorphEngine.identity(spark), True)


# --- more of the surface ---


@query(O.analysis(f"""
, det AS (SELECT token, arg_max(lang, known_len * 10 - lang_ord) AS d FROM knw JOIN lng USING (lang) GROUP BY token),
asg AS (SELECT token, unnest([NULL, 'en', 'de']) AS suggested FROM wrd),
own AS (SELECT a.token, suggested, d, suggested IS NOT NULL AND EXISTS (SELECT 1 FROM fms f WHERE f.token = a.token AND f.lang = suggested) AS own FROM asg a LEFT JOIN det USING (token)),
lgd AS (SELECT *, CASE WHEN own THEN suggested ELSE coalesce(d, 'en') END AS lang FROM own)
SELECT l.token AS token, suggested, CASE WHEN word IS NULL THEN NULL WHEN own THEN suggested ELSE d END AS detected, word, frequency, rank FROM lgd l LEFT JOIN fms f ON l.token = f.token AND l.lang = f.lang""".lstrip(), ("en", "de")))
def q32_context_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All forms of every word that isn't garbage, without a suggested language and with each."""
    suggested = F.explode(F.array(F.lit(None).cast("string"), F.lit("en"), F.lit("de")))
    asked = words(spark, sf_dir).where(~T.is_garbage("token")).select("token", suggested.alias("suggested"))
    return as_long(engine(spark, "en", "de").contextual_forms(asked).select("token", "suggested", "detected", "word", "frequency", "rank"), "rank")


@query(O.scored(_docs, _searches, False, _scores, "text"))
def q33_raw_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and searches as they are written, neither lower-cased."""
    e = engine(spark)
    found = e.intersect(e.index(documents(spark, sf_dir), normalize=False), table(spark, sf_dir, "benchmark"), "item_id", "text", False, False)
    return found.select(F.col("id").alias("doc_id"), F.col("phrase_id").alias("item_id"), "score")


_odd_docs = "SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1, '' UNION ALL SELECT -2, NULL"
_asked_pairs = "SELECT id, item_id FROM dcs, (SELECT DISTINCT item_id FROM benchmark) b WHERE item_id IN (id % 7 + 1, (id * 3) % 11 + 12, 1)"


@query(O.scored(_odd_docs, _searches, True, f"""SELECT p.id AS doc_id, p.item_id AS item_id, coalesce(score, CASE WHEN strlen(b.text) > coalesce(strlen(d.text), 0) THEN 0.0 WHEN coalesce(strlen(d.text), 0) = 0 THEN 1.0 ELSE 0.0 END) AS score
FROM ({_asked_pairs}) p JOIN dcs d USING (id) JOIN benchmark b USING (item_id) LEFT JOIN scr s ON s.id = p.id AND s.phrase_id = p.item_id"""))
def q34_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of given pairs, those without a match and those of empty and null documents included."""
    docs = documents(spark, sf_dir).union(spark.createDataFrame([(-1, ""), (-2, None)], "doc_id long, text string"))
    searches, e = table(spark, sf_dir, "benchmark"), engine(spark)
    asked = docs.select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(F.array(F.col("doc_id") % 7 + 1, (F.col("doc_id") * 3) % 11 + 12, F.lit(1).cast("long")))).alias("phrase_id"))
    pairs = asked.join(searches.select(F.col("item_id").alias("phrase_id")).distinct(), "phrase_id", "left_semi").select("id", "phrase_id")
    found = e.intersect(e.index(docs), searches, "item_id", "text", True, True, pairs)
    return found.select(F.col("id").alias("doc_id"), F.col("phrase_id").alias("item_id"), "score")


_mrd_rows = X.rows("en", 0, X.EN_MODELS, X.EN_LEMMAS + X.EN_CORPUS_LEMMAS)
_mrd = [("flex", str(m), f, a, p) for _, m, _, f, a, p in _mrd_rows[0]] + [("lemma", str(m), b, a, str(s)) for _, _, b, m, _, a, s in _mrd_rows[1]] + [("prefix", "0", p, None, None) for p in X.EN_PREFIXES]


@query(f"SELECT * FROM ({O.values(_mrd)}) AS v(section, model, word, ancode, more)")
def q35_mrd_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of a dictionary file."""
    text = L.write_mrd(*_mrd_rows[:1], [("en", 0, p) for p in X.EN_PREFIXES], _mrd_rows[1])
    got = L.parse_mrd(spark.createDataFrame([(text,)], "value string"), "en", 0)
    flex = got["flex"].selectExpr("'flex' as section", "string(model_no) as model", "flexion as word", "ancode", "prefix as more")
    lemmas = got["lemmas"].selectExpr("'lemma'", "string(model_no)", "base", "ancode", "string(prefix_set)")
    return flex.union(lemmas).union(got["prefixes"].selectExpr("'prefix'", "string(set_no)", "prefix", "null", "null"))


@query(O.described(_docs, O.phrase_probes([(1, [(False, ["the", "that"])])]), f"""SELECT d.id AS doc_id, CAST(m.id IS NOT NULL AS INT) AS contained, coalesce(result, '') AS result,
  CASE WHEN NOT regexp_matches(w, '{O.GARBAGE}') THEN w END AS first_word, array_to_string(coalesce(k, []), ',') AS lemmas
FROM dcs d LEFT JOIN (SELECT id, string_agg(surface, chr(10) ORDER BY surface) || chr(10) AS result FROM mat GROUP BY id) m ON m.id = d.id
LEFT JOIN (SELECT id, token AS w FROM tok WHERE pos = 0) f ON f.id = d.id LEFT JOIN (SELECT token, list(word ORDER BY rank) AS k FROM lmm GROUP BY token) l ON l.token = w"""))
def q36_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions that SQL texts call."""
    from inflecta.functions import sql
    from inflecta.functions.kernel import Kernel

    sql.register(spark, Kernel.from_lexicon(engine(spark).lexicon))
    spread(documents(spark, sf_dir)).createOrReplaceTempView("inflecta_documents")
    rows = spark.sql("""
        select doc_id, str_case_str(text, 'the that') as contained, phrase_search(text, 'the that') as result, t.token as word, array_join(lemmas(t.token, 'en'), ',') as lemmas
        from inflecta_documents left join lateral (select * from tokens(text) where pos = 0) t""")
    return rows.select("doc_id", "contained", "result", F.when(~T.is_garbage("word"), F.col("word")).alias("first_word"), "lemmas")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS text FROM documents")
def q37_text_of_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes as text; a third of the documents get a byte that UTF-8 doesn't have, which leaves them empty."""
    data = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text").cast("binary"), F.lit(b"\xff"))).otherwise(F.col("text").cast("binary"))
    return documents(spark, sf_dir).select("doc_id", T.valid_text(data).alias("text"))
