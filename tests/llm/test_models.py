"""HTML extraction, toxicity, language identification, SentencePiece, nearest neighbours and packing."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inflecta.llm import ann_mih, html_crf, langid_ppm, packing, simhash, spm_codec, toxicity_fm
from inflecta.llm._common import fold

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


# --- HTML ---

PAGE = """<!doctype html><html><head><title>Site</title><style>p{color:red}</style><script>if (a<b) "</p>"</script></head><body>
<header class="site-header"><a href=/>Logo</a></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><!-- <p>not shown</p> -->
<article><h1>A  title &amp; more</h1><p>First &lt;b&gt; <b>bold</b>
 text&nbsp;here.<p>Second&#33; &eacute;&hellip;<br>line</p><ul><li>point</ul><div class="ad">Buy now</div><p>All rights reserved.</p></article>
<aside class=sidebar><h3>Related</h3><p>Some other story that is rather long and reads like an article would.</p></aside>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I liked this article very much, thank you for it.</p></div></section>
<form><label>Name</label><input><button>Send</button></form><footer>&copy; 2024 Site</footer></body></html>"""
TEXT = "A title & more\nFirst <b> bold text here.\nSecond! é… line\npoint\nAll rights reserved."


@pytest.fixture(scope="module")
def crf():
    return html_crf.trained()


def test_html_page(crf):
    assert crf.extract(PAGE) == TEXT


def texts(page):
    return [b.text for b in html_crf.read(page).blocks]


def test_html_blocks():
    assert texts("a<p>b<p>c <i>d</i>e<div>f</div>g</p>h<td>i<script>x") == ["a", "b", "c de", "f", "g", "h", "i"]
    assert texts(None) == texts("") == texts("<!-- x") == []
    assert texts('<a href="x>y</a> z') == ["y z"] and texts("a<b c='d'") == ["a"]
    assert texts("<p a=b/c title=don't d='>' e=\">\">x</p><p / = =x y=>z</p>") == ["x", "z"]
    assert texts("<!-->a<!--->b<!-- c --!>d<!doctype x>e</3>f<?g?>h") == ["abdefh"]
    assert texts("<script src=x />a</script>b<svg/>c<svg><text>d</text><svg></svg>e</svg>f<template><template></template>g</template>h") == ["bcfh"]
    assert texts("<textarea><p>a</textarea>b<title>c<b></title>") == ["<p>a", "b", "c<b>"]
    assert texts("a<span hidden>b</span>c<i style='display : none'>d</i>e") == ["ace"]


@pytest.mark.parametrize("depth", [0, 70, 500, 20_000])
def test_html_of_any_depth(crf, depth):
    """Unclosed elements before the page hide neither its furniture nor its article, and end tags close their own."""
    assert crf.extract(PAGE.replace("<header", '<font><b><span class="x">' * (depth // 3) + "<header", 1)) == TEXT
    assert crf.extract(PAGE.replace("<header", '<div class="x">' * depth + "<header", 1)) == TEXT
    page = html_crf.read('<div class="y">' * depth + "<nav>a</nav><p>b")
    paths = [page.path(b) for b in page.blocks]
    assert "t=nav" in paths[0] and "t=nav" not in paths[1] and paths[1].count("Wc=y") <= 1


def test_html_text_of_ordinary_elements(crf):
    page = PAGE.replace("First ", "First <math><mi>x</mi></math> <noscript>y</noscript> <object>z</object> <canvas>w ")
    assert crf.extract(page) == TEXT.replace("First ", "First x y z w ")


def test_viterbi_is_the_best_labelling(crf):
    """Against all labellings of short pages."""
    for marked in html_crf.training_pages(60, seed=77):
        page, _ = html_crf.labelled(marked)
        if len(page.blocks) > 10:
            continue
        e = [sum(crf.weight.get(f, 0.0) for f in (*page.path(b), *b.own)) for b in page.blocks]
        score = lambda y: crf.first[y[0]] + sum(crf.pair[a][b] for a, b in zip(y, y[1:], strict=False)) + sum(x for x, k in zip(e, y, strict=True) if k)  # noqa: E731, B023
        best = max(score([n >> i & 1 for i in range(len(e))]) for n in range(1 << len(e)))
        assert score([int(k) for k in crf.decode(page)]) == pytest.approx(best)


def test_marginals_are_sums_over_all_labellings():
    rng = np.random.default_rng(2)
    pair, first, e, lengths = rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=(3, 5)), np.array([5, 3, 1])
    p, both = html_crf.marginals(e, lengths, pair, first)
    for i, n in enumerate(lengths):
        want, joint, total = np.zeros(n), np.zeros((n - 1, 2, 2)), 0.0
        for bits in range(1 << n):
            y = [bits >> t & 1 for t in range(n)]
            weight = np.exp(first[y[0]] + sum(pair[a][b] for a, b in zip(y, y[1:], strict=False)) + sum(e[i, t] for t in range(n) if y[t]))
            total += weight
            want += weight * np.array(y)
            for t in range(1, n):
                joint[t - 1, y[t - 1], y[t]] += weight
        assert np.allclose(p[i, :n, 1], want / total) and np.allclose(both[i, : n - 1], joint / total) and not both[i, n - 1 :].any()


def test_html_held_out_pages(crf):
    pages = [html_crf.labelled(p) for p in html_crf.training_pages(150, seed=5_000)]
    right = sum(a == b for page, labels in pages for a, b in zip(crf.decode(page), labels, strict=True))
    assert right / sum(len(page.blocks) for page, _ in pages) > 0.97


def test_html_table(spark, crf):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "y"), (2, None, None, "y"), (None, "v", "", None), (3, "w", "<p>" + "word " * 50_000, "z")]
    got = html_crf.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), crf).collect()
    assert [r["page_id"] for r in got] == [1, 2, 2, None, 3]
    assert got[0]["text"] == TEXT and got[0]["n_chars"] == len(TEXT) and got[1]["text"] == "" and got[1]["n_chars"] == 0
    assert html_crf.extract(spark.createDataFrame([], "page_id long, url string, html string"), crf).count() == 0


# --- toxicity ---


def test_machine_learns_a_pair_that_weights_cannot():
    """Label 1 if both or neither of two terms occur: no additive weights separate this."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(400):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array([s for s, on in ((1, a), (2, b), (3, 1)) if on], np.int32))
        labels.append(int(a == b))
    fm = toxicity_fm.fitted(rows, np.array(labels), slots=4, epochs=300, batch=100, x=np.ones(4, np.float32))
    right = sum(int(fm.logit(r) > 0) == y for r, y in zip(rows, labels, strict=True))
    assert right / 400 > 0.95


def test_pairwise_term_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    x, w, v = rng.random(5), rng.normal(size=5), rng.normal(size=(5, 3))
    fm = toxicity_fm.FactorizationMachine(0.3, x, w, v)
    want = 0.3 + sum(w[i] * x[i] for i in (0, 2, 4)) + sum(x[i] * x[j] * (v[i] @ v[j]) for i, j in ((0, 2), (0, 4), (2, 4)))
    assert fm.logit(np.array([0, 2, 4])) == pytest.approx(want)


def test_evidence_is_the_shrunk_chi_square():
    rng = np.random.default_rng(3)
    labels = np.array([1] * 40 + [0] * 60)
    rows = [np.array(sorted({int(s) for s in rng.integers(0, 30, 6)} | ({30} if y and rng.random() < 0.8 else set()) | ({31} if i == 3 else set())), np.int32) for i, y in enumerate(labels)]
    got = toxicity_fm.evidence(rows, labels, 33)
    for s in range(33):
        a, b = sum(s in r for r, y in zip(rows, labels, strict=True) if y), sum(s in r for r, y in zip(rows, labels, strict=True) if not y)
        p = (a + b) / 100
        chi = (a / 40 - b / 60) ** 2 / (p * (1 - p)) * 24 if a + b else 0
        assert got[s] == pytest.approx(chi / (chi + toxicity_fm.SHRINK), abs=1e-6)
    assert got[31] > 0 and got[32] == 0 and got.argmax() == 30


def test_scores_equal_a_plain_sum_in_sql(spark):
    """The machine's weights as a table, the logit as joins and sums: another way to the same scores."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["foul", "Group", "plain", "word", "longerword"]) for _ in range(rng.randint(0, 6)))) for i in range(1500)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(lower(text) like '%foul%' and lower(text) like '%group%' as int) as toxic")
    fm = toxicity_fm.fit(docs, labels)
    slots = np.flatnonzero(fm.evidence)
    weights = spark.createDataFrame([(int(s), float(fm.evidence[s]), float(fm.weights[s]), [float(f) for f in fm.factors[s]]) for s in slots], "s int, x double, w double, v array<double>")
    terms = spark.createDataFrame([(r["doc_id"], int(s)) for r in docs.collect() for s in toxicity_fm.text_slots(r["text"])], "doc_id long, s int")
    weights.createOrReplaceTempView("weights"), terms.createOrReplaceTempView("terms")
    want = spark.sql(f"""
        with used as (select doc_id, x, w, v from terms join weights using (s)),
        pairs as (select doc_id, sum(t * t - q) / 2 as p from (select doc_id, f, sum(x * v[f]) as t, sum(x * x * v[f] * v[f]) as q from used lateral view explode(sequence(0, {toxicity_fm.RANK - 1})) e as f group by doc_id, f) group by doc_id)
        select doc_id, 1 / (1 + exp(-({fm.bias} + sum(w * x) + max(p)))) as score from used join pairs using (doc_id) group by doc_id""")
    want = {r["doc_id"]: r["score"] for r in want.collect()}
    got = {r["doc_id"]: r["score"] for r in toxicity_fm.score(docs, fm).collect()}
    assert len(got) == 1500 and all(abs(got[i] - want.get(i, 1 / (1 + np.exp(-fm.bias)))) < 1e-5 for i in got)
    assert sum((got[r["doc_id"]] >= 0.5) == bool(r["toxic"]) for r in labels.collect()) > 1400


def test_toxicity_fit_of_repeated_rows_and_any_ids(spark):
    """Ids that are text; 300 rows of one id count once; the bound of terms leaves a document of each class at least."""
    rows = [("same", "some vile words"), *[("a" + str(i), "vile thing") for i in range(8)], *[("b" + str(i), "kind thing") for i in range(8)]] + [("same", f"some vile words {i}") for i in range(299)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(k, int(k[0] != "b"), 9) for k in sorted({r[0] for r in rows}) for _ in range(3)], "doc_id string, toxic int, y int")
    fitted, seen = toxicity_fm.fitted, []
    toxicity_fm.fitted = lambda r, y: seen.append(len(r)) or fitted(r, y)
    try:
        fm = toxicity_fm.fit(docs, labels)
        toxicity_fm.fit(docs, labels, fit_terms=1)
    finally:
        toxicity_fm.fitted = fitted
    assert seen[0] <= 17 and seen[1] == 2
    got = {r["doc_id"]: r["score"] for r in toxicity_fm.score(docs, fm).collect()}
    assert min(v for k, v in got.items() if k[0] == "a") > max(v for k, v in got.items() if k[0] == "b")


@needs_data
def test_toxicity_held_out(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fm = toxicity_fm.fit(documents, labels)
    got = toxicity_fm.score(documents, fm).join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    assert sum(r["toxic"] == r["predicted"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_toxicity_of_odd_rows(spark):
    rows = [(1, "", 1), (2, None, 2), (2, None, 2), (None, "x " * 200_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity_fm.score(docs, toxicity_fm.fit(docs, none)).collect()
    assert [(r["doc_id"], r["predicted"]) for r in got] == [(1, 0), (2, 0), (2, 0), (None, 0)]
    assert toxicity_fm.score(docs.limit(0), toxicity_fm.fit(docs.limit(0), none)).count() == 0


# --- languages ---


def test_code_lengths_are_those_of_a_plain_ppm():
    rng = random.Random(3)
    texts = {lang: ["".join(rng.choice(letters) for _ in range(400)).encode() for _ in range(3)] for lang, letters in (("x", "aab "), ("y", "abbc "), ("z", "cdé "))}
    trees = langid_ppm.trained(texts)
    counts = {lang: {} for lang in texts}
    shown: dict[bytes, int] = {}
    for lang, parts in texts.items():
        for t in parts:
            for i in range(len(t)):
                for n in range(min(i, langid_ppm.ORDER) + 1):
                    c = counts[lang].setdefault(t[i - n : i], {})
                    c[t[i : i + 1]] = c.get(t[i : i + 1], 0) + 1
            for i in range(len(t)):
                for n in range(1, langid_ppm.ORDER + 1):
                    if i + n <= len(t):
                        shown[t[i : i + n]] = shown.get(t[i : i + n], 0) + 1
    contexts = {c for c, n in shown.items() if n >= 2} | {b""}

    def bits(lang, context, byte):
        while context not in contexts:
            context = context[1:]
        total = 0.0
        while True:
            seen = counts[lang].get(context)
            if seen:
                n = sum(seen.values()) + len(seen)
                if byte in seen:
                    return total - np.log2(seen[byte] / n)
                total -= np.log2(len(seen) / n)
            if not context:
                return total + 8
            context = context[1:]

    for _ in range(20):
        t = "".join(rng.choice("abcdé f") for _ in range(rng.randint(1, 60))).encode()
        want = [sum(bits(lang, t[max(0, i - langid_ppm.ORDER) : i], t[i : i + 1]) for i in range(len(t))) for lang in sorted(texts)]
        assert trees.code_lengths(t) == pytest.approx(want, rel=1e-5)


def test_blocks_of_long_texts_keep_their_context(monkeypatch):
    rng = random.Random(4)
    t = "".join(rng.choice("abc ") for _ in range(3000)).encode()
    trees = langid_ppm.trained({"x": [t[:1500]], "y": [b"cba" * 300]})
    whole = trees.code_lengths(t)
    monkeypatch.setattr(langid_ppm, "BLOCK", 97)
    assert trees.code_lengths(t) == pytest.approx(whole)


@needs_data
def test_language_held_out(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    trees = langid_ppm.fit(documents)
    got = langid_ppm.predict(documents, trees).join(documents.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.98
    assert langid_ppm.kept(documents, trees).count() >= documents.where("text rlike '[a-zA-Z]'").count() - 2


def test_language_of_odd_rows(spark):
    rows = [(1, None, "en"), (2, "12 !", "en"), (2, "12 !", "en"), (None, "abc", None), (3, "abc " * 50_000, "fr"), (5, "", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = langid_ppm.trained({"aa": [b"abc abc"], "bb": [b"abc abc"]})
    got = [tuple(r)[2:4] for r in langid_ppm.predict(docs, trees).collect()]
    assert got == [("und", 0.0), ("und", 0.0), ("und", 0.0), ("aa", 0.5), ("aa", 0.5), ("und", 0.0)]
    assert [r["doc_id"] for r in langid_ppm.kept(docs, trees).collect()] == [None, 3]
    assert langid_ppm.predict(docs, langid_ppm.fit(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    noise = spark.createDataFrame([(1, "".join(random.Random(1).choice("QJXZÿþ漢") for _ in range(400)), "en")], "doc_id long, text string, lang string")
    assert langid_ppm.kept(noise, trees).count() == 0


def test_languages_of_long_documents_are_learned(spark):
    """A language with a script of its own, all of whose documents are long, is predicted, and its documents stay."""
    rng = random.Random(9)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(i, text("αβγδ ", 50_000), "el") for i in range(12)] + [(i, text("abcd ", 2_000), "en") for i in range(12, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = langid_ppm.fit(docs)
    assert trees.languages == ["el", "en"]
    assert langid_ppm.predict(docs, trees).join(docs, "doc_id").where("lang = lang_pred").count() == 40
    assert langid_ppm.kept(docs, trees).count() == 40
    assert langid_ppm.fit(docs.where("lang = 'el'")).languages == ["el"]


def test_every_labelled_language_is_learned(spark):
    """300 languages, the rarest of them with letters of its own; the others don't make its tree shallower."""
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 2 + str(i % 299) for _ in range(8)), f"l{i % 299:03}") for i in range(6 * 299)]
    rows += [(i, "".join(rng.choice("жзий ") for _ in range(300)), "rare") for i in range(9_000, 9_003)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = langid_ppm.fit(docs, max_contexts=60)
    assert trees.languages == [*(f"l{i:03}" for i in range(299)), "rare"]
    only = langid_ppm.fit(docs.where("lang = 'rare'"), max_contexts=60)
    assert sum(t.step.nbytes + t.bits.nbytes for t in langid_ppm.fit(docs, model_bytes=1 << 20).trees) <= 2 << 20
    assert trees.code_lengths("жзий жж".encode())[-1] == only.code_lengths("жзий жж".encode())[0]
    rare = docs.where("lang = 'rare'")
    assert [r["lang_pred"] for r in langid_ppm.predict(rare, trees).collect()] == ["rare"] * 3 and langid_ppm.kept(rare, trees).count() == 3


def test_language_fit_takes_repeated_rows_once(spark, monkeypatch):
    """300 rows of one id and language, of one text or many, reach the driver as one."""
    rows = [(1, "abc abd", "en")] * 300 + [(2, f"abc {i}", "en") for i in range(300)] + [(i, "xyz", "fr") for i in range(3, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    monkeypatch.setattr(langid_ppm, "trained", lambda texts, **_: seen.update(texts))
    langid_ppm.fit(docs)
    assert len(seen["en"]) <= 2 and set(seen) <= {"en", "fr"}


def test_signs_that_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "½ ② 12", 5, 6.0), (2, "ª", 5, 6.0), (3, "1 é", 5, 6.0)], "doc_id long, text string, score long, lang_pred double")
    trees = langid_ppm.trained({"aa": [b"abc abc"]})
    assert [r["lang_pred"] for r in langid_ppm.predict(docs, trees).collect()] == ["und", "aa", "aa"]
    assert [r["doc_id"] for r in langid_ppm.kept(docs, trees).collect()] == [2, 3]


def test_unlabelled_documents_are_kept(spark):
    docs = spark.createDataFrame([(1, "some words " * 20, None), (2, "漢字", None), (3, "12 34 " * 30, None), (4, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in langid_ppm.kept(docs, langid_ppm.fit(docs)).collect()] == [1, 2]


# --- SentencePiece ---


@pytest.fixture(scope="module")
def piece_model():
    public = pytest.importorskip("public_tokenizers")
    return public.path("piece_bpe_32k.model")


TEXTS = ["", " ", "  ", "a", " a ", "a  b\n c ▁x", "▁", "▁▁a▁", "\t\r\n", "naïve façade 漢字 \U0001f600 é", "x" * 5000, "<s> </s> <unk> <0x41>", "a b　c", "0 1,2.3 don't", "\x00\x01 b"]


def test_sentencepiece_equals_the_library(spark, piece_model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("ab é▁ \n.漢xX1") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    for t in texts:
        ids = sp.encode(t)
        chunks = spm_codec.chunks_of(t)
        table = spm_codec.entries(chunks, *spm_codec.segmented(chunks, piece_model))
        assert spm_codec.put_together(t, table) == (",".join(map(str, ids)), sp.decode(ids)), t
    rows = spark.createDataFrame([*enumerate(texts), (None, None), (5, texts[5])], "doc_id long, text string").repartition(3)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(x := sp.encode(t or "")), digest(",".join(map(str, x))), digest(sp.decode(x) if x else "")) for i, t in [*enumerate(texts), (None, None), (5, texts[5])]]
    assert sorted(map(str, (tuple(r) for r in spm_codec.digests(rows, piece_model).collect()))) == sorted(map(str, want))
    assert spm_codec.digests(rows.limit(0), piece_model).count() == 0


def test_sentencepiece_columns_of_any_name(spark, piece_model):
    """Columns that are called as the operator calls its own; the output replaces a column of its name; repeated rows."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    names = ["t", "c", "i", "p", "__b", "__z", "c0", "n_tokens", "a.b"]
    rows = spark.createDataFrame([(n, f"word {n % 3} " * (n % 5), "old", *names) for n in range(20)] + [(3, "word 0 " * 3, "old", *names)] * 5 + [(99, None, None, *[None] * len(names))], "doc_id long, text string, ids string, " + ", ".join(f"`{n}` string" for n in names))
    got = spm_codec.encode(rows, piece_model)
    assert got.columns == ["doc_id", "text", *names, "ids"]
    got = got.collect()
    assert len(got) == 26 and all(r["ids"] == sp.encode(r["text"] or "") and (r["doc_id"] == 99 or [r[n] for n in names] == names) for r in got)
    assert spm_codec.digests(rows, piece_model).count() == 26


# --- nearest neighbours ---


def brute(ids, x, k):
    out = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = np.add.reduce(x * x[i], axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), n + 1, int(ids[j]), float(s[j])) for n, j in enumerate(order)]
    return out


@pytest.mark.parametrize("norms", [False, True])
def test_recall(spark, norms):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 32))
    x = (centres[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 32))).astype(np.float32).astype(float)
    if not norms:
        x /= np.linalg.norm(x, axis=1)[:, None]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann_mih.search(table, F.col("vec_id") % 20 == 0).collect()]
    want = brute(np.arange(3000), x, 20)
    hits = {(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}
    assert len(got) == len(want) and len(hits) / len(want) >= 0.9
    assert all(abs(s - x[q] @ x[v]) < 1e-9 for q, _, v, s in got)


def test_probing_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(6)
    n, m = 800, ann_mih.PARTS
    parts = np.repeat(rng.integers(0, 1 << ann_mih.WIDTH, (m, 1)).astype(np.uint16), n, 1)
    for i in range(n):  # codes at all distances from the first
        flips = rng.choice(m * ann_mih.WIDTH, int(rng.integers(0, 500)) if i else 0, replace=False)
        np.bitwise_xor.at(parts[:, i], flips // ann_mih.WIDTH, (1 << flips % ann_mih.WIDTH).astype(np.uint16))
    far = np.bitwise_count(parts ^ parts[:, :1]).sum(0)
    index = ann_mih.BlockIndex(np.arange(n), np.zeros((n, 2)), ann_mih.Codes(parts, np.zeros((n, ann_mih._WORDS), np.uint64)))
    for radius in (0, 1, 3, 60, 127, 128, 190, 255, 256, 300, 384):
        found = index.retrieved(parts[:, :1], radius)[0]
        assert found[far <= radius].all() and found[0], radius
        # and just the rows that a plain look at every substring gives
        near = [(np.bitwise_count(parts[j] ^ parts[j, 0]) <= ann_mih.reach(radius, j)) for j in range(m)]
        assert (found == np.any(near, 0)).all()
    assert index.retrieved(parts[:, :1], m * ann_mih.WIDTH).all()


@pytest.mark.parametrize("folder", ["sf0.1", "check_l"])
def test_recall_of_the_query_over_all_its_rows(spark, folder):
    from inflecta.llm import queries

    if not os.path.exists(f"/root/testdata/{folder}/embeddings.parquet"):
        pytest.skip("needs the test tables")
    rows = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(float)
    got = {(r["query_id"], r["vec_id"]) for r in queries.op4_nearest(spark, f"/root/testdata/{folder}").collect()}
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[ids == ids[i]] = -np.inf
        near = np.argpartition(-score, 20)[:20]
        hits += sum((ids[i], ids[j]) in got for j in near)
        total += 20
    assert len(got) == total and hits / total >= 0.9


def test_vectors_that_take_no_part_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, nan]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.0])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, id long")
    got = [tuple(r) for r in ann_mih.search(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 2, 0.5), (0, 4, 20, -1.0), (20, 1, 1, -0.5), (20, 2, 2, -0.5), (20, 3, 2, -0.5), (20, 4, 0, -1.0)]
    assert ann_mih.search(table.where("vec_id = 0"), F.lit(True)).count() == 0
    assert ann_mih.search(table.limit(0), F.lit(True)).count() == 0


# --- packing ---


def plain_packing(sizes):
    """The same policy without any index: looks through all bins and all pieces still to come."""
    room, used, bins = [], [], []
    for i, size in enumerate(sizes):
        fits = [(r, b) for b, r in enumerate(room) if r >= size]
        if fits:
            b = min(fits)[1]
        else:
            cost = {c: (c + packing.OVERHEAD) / (size + min(c - size, sum(x for x in sizes[i + 1 :] if x <= c - size))) for c in packing.CAPACITIES if c >= size}
            b = len(room)
            room.append(min(cost, key=lambda c: (cost[c], c)))
            used.append(0)
        bins.append(b)
        room[b] -= size
        used[b] += size
    return bins, [min(c for c in packing.CAPACITIES if c >= u) for u in used]


@pytest.mark.parametrize("seed", range(6))
def test_packing_policy(seed):
    rng = random.Random(seed)
    sizes = sorted((min(32_768, int(rng.lognormvariate(7.5, 1.3)) + 1) for _ in range(rng.randint(0, 300))), reverse=True)
    bins, offsets, capacities = packing.packed(sizes)
    assert (bins, capacities) == plain_packing(sizes)
    ends = {}
    for b, o, n in zip(bins, offsets, sizes, strict=True):
        assert o == ends.get(b, 0)
        ends[b] = o + n
    assert all(ends[b] <= capacities[b] for b in ends)


def test_packing_table(spark):
    rng = random.Random(9)
    rows = [(i, "é" * rng.randint(0, 9000), i) for i in range(200)] + [(200, None, 0), (201, "", 0), (201, "", 0), (202, "x" * 100_000, 0), (None, "abc", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long")
    for shard in (packing.SHARD, 100_000):
        got = packing.pack(docs, shard=shard).collect()
        by_doc, by_bin = {}, {}
        for r in got:
            by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
            if r["bin_id"] is not None:
                by_bin.setdefault((r["bin_id"], r["bin_capacity"]), []).append((r["bin_offset"], r["length"]))
        for doc_id, text, _ in rows:
            parts = sorted(by_doc[doc_id])
            assert sum(n for *_, n in parts) == len((text or "").encode())
            if doc_id != 201:
                assert [s for _, s, _ in parts] == [sum(n for *_, n in parts[:i]) for i in range(len(parts))]
        assert len(by_doc[201]) == 2 and len(by_doc[202]) == 4
        assert len({b for b, _ in by_bin}) == len(by_bin)
        for (_, capacity), parts in by_bin.items():
            parts.sort()
            assert capacity in packing.CAPACITIES
            assert all(o == sum(n for _, n in parts[:i]) for i, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= capacity
    assert sorted(map(tuple, packing.pack(docs).collect()), key=str) == sorted(map(tuple, packing.pack(docs.repartition(7)).collect()), key=str)
    assert packing.pack(docs.limit(0)).count() == 0


def test_fold(spark):
    import zlib

    got = [tuple(r) for r in spark.createDataFrame([(0,), (17,), (None,)], "i long").select("i", fold(F.col("i")).cast("int")).collect()]
    assert got == [(0, zlib.crc32(b"0") % 5), (17, zlib.crc32(b"17") % 5), (None, 0)]


# --- batches ---


def test_batches_are_cut_and_the_session_stays(spark):
    """Whatever the session says of batches, with a unit or without."""
    import pyarrow as pa

    from inflecta.llm import _common

    big = pa.RecordBatch.from_arrays([pa.array(["x" * (3 << 20)] * 7 + [None, ""])], ["t"])
    cut = list(_common.slices([big, big.slice(0, 0)]))
    assert [t for b in cut for t in b.column(0).to_pylist()] == big.column(0).to_pylist() and all(b.nbytes <= 10 << 20 for b in cut)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")
        docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
        assert simhash.near_duplicates(docs).count() == 2
        assert spark.conf.get(name) == "64m"
    finally:
        spark.conf.set(name, was)
