"""DuckDB SQL that recomputes the registered queries from the corpus and the fixture lexicon."""

from __future__ import annotations

from inflecta.sources import fixture as X

TOKEN = r"[\p{L}\p{Nd}]+(?:[-''`_][\p{L}\p{Nd}]+)*"
GARBAGE = r"[^\p{L}''`-]"


def values(rows: list[tuple]) -> str:
    """A VALUES list."""
    text = lambda v: "NULL" if v is None else "true" if v is True else "false" if v is False else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)


def base36(code: str) -> str:
    digit = lambda power: f"substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(({code} // {36**power}) % 36 AS INT) + 1, 1)"
    return "ltrim(" + " || ".join(digit(p) for p in (5, 4, 3, 2, 1, 0)) + ", '0')"


def words_of(text: str) -> str:
    return f"regexp_extract_all({text}, '{TOKEN}')"


TOKENS = f"""tok AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS token
  FROM (SELECT doc_id, {words_of("lower(text)")} AS w FROM documents))"""


def lexicon(languages: tuple[str, ...] = ("en",)) -> str:
    """CTEs lem, flx, lng, frm (forms), sfx (suffixes) and gss (guesses) of the fixture."""
    lem, flx = [], []
    for lang in languages:
        models, stems = (X.EN_MODELS, X.EN_LEMMAS + X.EN_CORPUS_LEMMAS) if lang == "en" else (X.DE_MODELS, X.DE_LEMMAS)
        more = X.rows(lang, 0, models, stems)
        flx += [(g, m, f, p, x, a) for g, m, f, x, a, p in more[0]]
        lem += [(g, b, m) for g, _, b, m, *_ in more[1]]
    return f"""lng(lang, lang_ord) AS ({values([(g, i) for i, g in enumerate(languages)])}),
lem(lang, base, model_no) AS ({values(lem)}),
flx(lang, model_no, form_no, prefix, flexion, ancode) AS ({values(flx)}),
gen AS (SELECT l.lang, l.base, f.model_no, f.form_no, f.ancode, f.prefix || l.base || f.flexion AS form,
  length(f.flexion) AS flex_len, length(l.base) AS base_len FROM lem l JOIN flx f ON l.lang = f.lang AND l.model_no = f.model_no),
frm AS (SELECT *, {base36("code")} AS code36, reverse(form) || '|' || {base36("code")} AS auto_key FROM
  (SELECT DISTINCT lang, form, model_no, flex_len, base_len, model_no * 65536 + flex_len * 256 + base_len AS code FROM gen)),
sfx AS (SELECT DISTINCT lang, right(form, n) AS suffix FROM (SELECT lang, form, unnest(range(1, length(form) + 1)) AS n FROM frm)),
gss AS (SELECT lang, suffix, model_no, arg_min(flex_len, auto_key) AS flex_len, min(auto_key) AS auto_key FROM
  (SELECT lang, right(form, n) AS suffix, model_no, flex_len, auto_key FROM (SELECT *, unnest(range(4, length(form) + 1)) AS n FROM frm)) GROUP BY ALL)"""


#: Analysis of the words in `src`: wrd, knw (known suffix), exa, opn, pre, gue, can (candidates), lmm (lemmas) and fms (all forms).
ANALYSIS = f"""wrd AS (SELECT DISTINCT token FROM src WHERE NOT regexp_matches(token, '{GARBAGE}')),
knw AS (SELECT token, lang, max(length(suffix)) AS known_len FROM
  (SELECT token, right(token, n) AS suffix FROM (SELECT token, unnest(range(1, length(token) + 1)) AS n FROM wrd)) JOIN sfx USING (suffix) GROUP BY token, lang),
exa AS (SELECT token, lang, 'exact' AS kind, model_no, flex_len, base_len, code36 AS ord FROM wrd JOIN frm ON token = form),
opn AS (SELECT token, lang, right(token, known_len) AS suffix, left(token, length(token) - known_len) AS head FROM knw k
  WHERE known_len >= 4 AND NOT EXISTS (SELECT 1 FROM exa e WHERE e.token = k.token AND e.lang = k.lang)),
pre AS (SELECT o.token, o.lang, 'prefix' AS kind, model_no, flex_len, base_len + length(head) AS base_len, code36 AS ord
  FROM opn o JOIN frm f ON o.suffix = f.form AND o.lang = f.lang WHERE o.lang = 'en' AND regexp_full_match(head, '({"|".join(sorted(X.EN_PREFIXES + X.EN_CORPUS_PREFIXES))})+')),
gue AS (SELECT o.token, o.lang, 'guess' AS kind, model_no, flex_len, length(o.token) - flex_len AS base_len, auto_key AS ord
  FROM opn o JOIN gss g ON o.suffix = g.suffix AND o.lang = g.lang
  WHERE length(o.token) - flex_len >= 3 AND NOT EXISTS (SELECT 1 FROM pre p WHERE p.token = o.token AND p.lang = o.lang)),
can AS (SELECT * FROM (SELECT * FROM exa UNION ALL SELECT * FROM pre) QUALIFY row_number() OVER (PARTITION BY token, lang, model_no ORDER BY ord) = 1
  UNION ALL SELECT * FROM gue),
num AS (SELECT *, row_number() OVER (PARTITION BY token, lang ORDER BY ord, model_no) AS n FROM can),
vrs AS (SELECT c.token, c.lang, n * 1000 + form_no AS first, form_no, ancode,
  prefix || substring(token, CASE WHEN kind = 'guess' THEN 1 ELSE length(token) - flex_len - base_len + 1 END, base_len) || flexion AS word
  FROM num c JOIN flx f ON c.lang = f.lang AND c.model_no = f.model_no),
lmm AS (SELECT *, row_number() OVER (PARTITION BY token, lang ORDER BY frequency DESC, first) AS rank FROM
  (SELECT token, lang, word, count(*) - 1 AS frequency, min(first) AS first, arg_min(ancode, first) AS ancode FROM vrs WHERE form_no = 0 GROUP BY token, lang, word)),
fms AS (SELECT *, row_number() OVER (PARTITION BY token, lang ORDER BY frequency DESC, first) AS rank FROM
  (SELECT token, lang, word, count(*) - 1 AS frequency, min(first) AS first, arg_min(ancode, first) AS ancode FROM vrs GROUP BY token, lang, word))"""

#: dsc: keys of every word in `src` under the English lexicon.
KEYS = """dsc AS (SELECT token, list_append(coalesce(k, []), token) AS keys FROM (SELECT DISTINCT token FROM src)
  LEFT JOIN (SELECT token, list(word ORDER BY rank) AS k FROM lmm WHERE word <> token GROUP BY token) USING (token))"""


def analysis(select: str, languages: tuple[str, ...] = ("en",)) -> str:
    return f"WITH {TOKENS}, src AS (SELECT token FROM tok), {lexicon(languages)}, {ANALYSIS}{'' if select.startswith(',') else ' '}{select}"


def described(docs: str, probes: str, select: str, text: str = "lower(text)") -> str:
    """docs: SQL of (id, text), whose words are those of `text`; probes: SQL of (phrase_id, piece_no, line_no, exact, n, token_no, token).

    mat holds the distinct (id, phrase_id, piece_no, surface) that match.
    """
    return f"""WITH dcs AS ({docs}),
tok AS (SELECT id, unnest(range(len(w))) AS pos, unnest(w) AS token FROM (SELECT id, {words_of(text)} AS w FROM dcs)),
ask AS ({probes}),
src AS (SELECT token FROM tok UNION SELECT token FROM ask), {lexicon()}, {ANALYSIS}, {KEYS},
pst AS (SELECT id, pos, t.token AS surface, unnest(keys) AS key FROM tok t JOIN dsc USING (token)),
prb AS (SELECT a.phrase_id, a.piece_no, a.line_no, a.n, a.token_no, unnest(CASE WHEN exact THEN [a.token] ELSE keys END) AS key FROM ask a JOIN dsc USING (token)),
hit AS (SELECT DISTINCT id, phrase_id, piece_no, line_no, n, pos - token_no AS start, token_no, surface FROM
  (SELECT id, phrase_id, piece_no, line_no, n, CASE WHEN n = 1 THEN 0 ELSE pos END AS pos, token_no, surface FROM pst JOIN prb USING (key))),
mat AS (SELECT DISTINCT id, phrase_id, piece_no, surface FROM hit WHERE n = 1
  UNION SELECT id, phrase_id, piece_no, string_agg(surface, ' ' ORDER BY token_no) FROM hit WHERE n > 1 GROUP BY id, phrase_id, piece_no, line_no, n, start HAVING count(*) = n)
{select}"""


def phrase_probes(phrases: list[tuple[int, list[tuple[bool, list[str]]]]]) -> str:
    """Probes of fixed phrases: (phrase_id, [(exact, words of the line)])."""
    rows = [(pid, 0, line_no, exact, len(words), i, w) for pid, lines in phrases for line_no, (exact, words) in enumerate(lines) for i, w in enumerate(words)]
    return f"SELECT * FROM ({values(rows)}) AS v(phrase_id, piece_no, line_no, exact, n, token_no, token)"


def text_probes(searches: str, text: str = "lower(text)") -> str:
    """Probes of search texts (SQL of phrase_id, text): their blank-separated pieces, whose lines are `[lang|][!]words`."""
    return f"""SELECT phrase_id, piece_no, line_no, exact, len(w) AS n, unnest(range(len(w))) AS token_no, unnest(w) AS token FROM
  (SELECT phrase_id, piece_no, line_no, starts_with(p, '!') AS exact, {words_of("CASE WHEN starts_with(p, '!') THEN substr(p, 2) ELSE p END")} AS w FROM
    (SELECT phrase_id, piece_no, line_no, CASE WHEN contains(line, '|') THEN substr(line, instr(line, '|') + 1) ELSE line END AS p FROM
      (SELECT phrase_id, piece_no, unnest(range(len(ls))) AS line_no, trim(unnest(ls), ' ' || chr(9) || chr(10) || chr(13)) AS line FROM
        (SELECT phrase_id, piece_no, string_split(piece, chr(10)) AS ls FROM
          (SELECT phrase_id, unnest(range(len(ps))) AS piece_no, unnest(ps) AS piece FROM (SELECT phrase_id, string_split({text}, ' ') AS ps FROM ({searches})))))))"""


def scored(docs: str, searches: str, guard: bool, select: str, text: str = "lower(text)") -> str:
    """scr holds (id, phrase_id, score) of the pairs with a match."""
    share = "CASE WHEN covered >= d.b THEN 1.0 ELSE covered / d.b END"
    if guard:
        share = f"CASE WHEN s.b > d.b THEN 0.0 ELSE {share} END"
    scr = f""", scr AS (SELECT id, phrase_id, CAST({share} AS DOUBLE) AS score FROM
  (SELECT id, phrase_id, sum(strlen(surface) + 1)::DOUBLE AS covered FROM mat GROUP BY id, phrase_id)
  JOIN (SELECT id, strlen(text) AS b FROM dcs) d USING (id) JOIN (SELECT phrase_id, strlen(text) AS b FROM ({searches})) s USING (phrase_id))"""
    return described(docs, text_probes(searches, text), "", text).rstrip() + scr + "\n" + select
