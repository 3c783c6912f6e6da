"""The pipeline, stage by stage and as a whole, against a plain version of it."""

import os
import random

import pytest

import corpus_pipeline
from inflecta.llm import langid_ppm, queries
from tests.llm.test_dedup import brute_components, covered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def table(tmp_path_factory, spark):
    """Two languages, copies, near copies, repeated windows of lines, long shared passages, noise, null and empty texts."""
    rng = random.Random(12)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(400)] for lang, letters in (("aa", "abcdefg"), ("bb", "uvwxyzä"))}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    block = "\n".join(text("aa", 6) for _ in range(4))
    passage = text("bb", 70)
    rows = []
    for i in range(120):
        lang = rng.choice(["aa", "bb"])
        t = "\n".join(text(lang, rng.randint(1, 25)) for _ in range(rng.randint(1, 8)))
        if rng.random() < 0.2:
            t = f"{t}\n{block}\nlast {i}"
        if rng.random() < 0.2:
            t = f"{t} {passage} {text(lang, 12)}"
        rows.append([i, t, lang, f"s{i % 3}"])
    for i in range(120, 150):
        t = rows[rng.randrange(120)][1]
        rows.append([i, t if i % 2 else t + " extra", "aa", "copy"])
    rows += [[150, None, "aa", "x"], [151, "", "aa", "x"], [152, "12 34", "bb", "x"], [153, "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(300)), None, "x"]]
    rows = [tuple(r) + (len(r[1] or ""),) for r in rows]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path), rows


def plain(rows, trees):
    """(rows after each stage but the last)."""
    stages = []
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1]) and (len(b := langid_ppm.prepared(r[1])) < langid_ppm.REJECT_BYTES or trees.code_lengths(b).min() <= langid_ppm.REJECT_BITS * len(b))]
    stages.append(rows)
    seen, out = set(), []
    for r in sorted(rows):
        lines, gone = r[1].split("\n"), set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        t = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out.append((r[0], t, *r[2:4], len(t)))
    rows = out
    stages.append(rows)
    keep = {c for _, _, c in brute_components([r[:2] for r in rows])}
    rows = [r for r in rows if r[0] in keep]
    stages.append(rows)
    cut = []
    for r, (data, mask) in zip(rows, covered([r[:2] for r in rows], 200), strict=True):
        t = bytes(b for b, m in zip(data, mask, strict=True) if not m).decode("utf-8", "ignore")
        cut.append((r[0], t, *r[2:4], len(t)))
    stages.append(cut)
    return stages


def test_stages(spark, table):
    path, rows = table
    docs = spark.read.parquet(f"{path}/documents.parquet")
    want = plain(rows, langid_ppm.fit(docs))
    assert [len(w) for w in want][0] < len(rows) and len(want[2]) < len(want[1])
    assert [r[1] for r in want[1]] != [r[1] for r in sorted(want[0])] and [r[1] for r in want[3]] != [r[1] for r in want[2]]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        docs = stage(spark, docs, path)
        assert docs.columns == COLUMNS and [str(t) for t in docs.dtypes] == [str(t) for t in spark.createDataFrame([], SCHEMA).dtypes], name
        got = sorted(tuple(r) for r in docs.collect())
        assert got == sorted(expected), name
        docs = spark.createDataFrame(got, SCHEMA)
    packed = corpus_pipeline.run(spark, path).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in packed} == {r[0]: len(r[1].encode()) for r in want[3]}


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name


def test_stages_keep_clashing_columns(spark, tmp_path):
    """Extra columns named like those inside the operators come through as they are."""
    extra = ["k", "d", "h", "s", "p", "f", "n_lines", "n_removed", "spans", "__k", "w"]
    rows = [(i, f"some words of document number {i}\nand a second line {i}", "aa", "s", 50, *[f"{e}{i}" for e in extra]) for i in range(1, 9)]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", `{e}` string" for e in extra))
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert all(r["k"] == f"k{r['doc_id']}" and r["__k"] == f"__k{r['doc_id']}" and r["n_lines"] == f"n_lines{r['doc_id']}" for r in out.collect()), name


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_registered_query(spark, name):
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    source = "pages" if name.startswith("op1_") else "embeddings" if name.startswith("op4_") else "documents"
    if name == "op4_nearest":
        assert got.groupBy("query_id").count().where("count <> 20").count() == 0
        return
    key = "page_id" if source == "pages" else "doc_id"
    ids = spark.read.parquet(f"/root/testdata/sf0.001/{source}.parquet").select(key)
    assert got.select(key).distinct().count() == ids.count()
    if name != "op6_packing":
        assert got.count() == ids.count()
