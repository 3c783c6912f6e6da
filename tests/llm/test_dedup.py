"""Suffix dedup, SimHash, fingerprints and line dedup against brute force."""

import collections
import functools
import hashlib
import random
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from inflecta.llm import _common, fingerprint, line_dedup, simhash, suffix_dedup

SCHEMA = "doc_id long, text string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def docs():
    """Passages that recur whole and changed, exact copies, repeated rows, null, empty and periodic texts."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(rng.randint(1, 60)) for _ in range(12)]
    out = []
    for i in range(60):
        t = " ".join(rng.choice(base) if rng.random() < 0.5 else text(rng.randint(0, 30)) for _ in range(rng.randint(0, 4)))
        if rng.random() < 0.3 and t:
            j = rng.randrange(len(t))
            t = f"{t[:j]}X{t[j + 1:]}"
        out.append((i, t))
    return [*out, (60, None), (61, "a" * 300), (62, "ab" * 150), (63, out[5][1]), (63, out[5][1]), (None, out[7][1]), (64, "a" * 90), (65, "")]


def covered(docs, n):
    data = [(t or "").encode() for _, t in docs]
    count = collections.Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        mask = bytearray(len(d))
        for i in range(len(d) - n + 1):
            if count[d[i : i + n]] > 1:
                mask[i : i + n] = b"\1" * n
        out.append((d, mask))
    return out


@pytest.mark.parametrize("length, gram, group", [(200, 40, 5_000), (60, 12, 5_000), (60, 12, 3), (60, 12, 1), (40, 20, 5_000), (40, 20, 2)])
def test_suffix_dedup(spark, docs, length, gram, group):
    """group=3 walks all but the smallest groups down, group=1 all of them."""
    want = []
    for (doc_id, _), (d, mask) in zip(docs, covered(docs, length), strict=True):
        runs = sum(1 for i in range(len(mask)) if mask[i] and (not i or not mask[i - 1]))
        want.append((doc_id, len(d), sum(mask), runs, hashlib.sha256(bytes(b for b, m in zip(d, mask, strict=True) if not m)).hexdigest()))
    assert sum(r[2] for r in want)
    got = suffix_dedup.removed(spark.createDataFrame(docs, SCHEMA), length, gram, group)
    assert rows_of(got) == sorted(want, key=str)


def test_suffix_dedup_of_long_documents_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    fill = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    monkeypatch.setattr(suffix_dedup, "BLOCK", 257)
    whole = (fill(700) + passage + fill(333)).encode()
    p, h, s = suffix_dedup.anchors(np.frombuffer(whole, np.uint8), 200, 40)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 20)
    q, g, t = suffix_dedup.anchors(np.frombuffer(whole, np.uint8), 200, 40)
    assert p.tolist() == q.tolist() and h.tolist() == g.tolist() and s.tolist() == t.tolist()
    assert np.diff(q).max() <= 161  # every 200 bytes hold an anchor


def test_text_without_repeats_keeps_whole_characters_and_columns(spark):
    shared = "é" * 150
    # the first byte of ñ is that of é, so the repeated string runs into it and what is left of it goes too
    rows = [(1, "x" + shared, "a", 0), (2, shared + "ñn", "b", 0), (3, None, "c", 7), (4, "plain", "d", 7)]
    got = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long"))
    assert rows_of(got) == [(1, "x", "a", 1), (2, "n", "b", 1), (3, None, "c", 7), (4, "plain", "d", 7)]


def test_interval_tree():
    """Suffixes of banana$ in order, with the common prefixes of neighbours."""
    assert sorted(zip(*suffix_dedup.intervals([0, 0, 1, 3, 0, 0, 2]), strict=True)) == [(0, 0, 6), (1, 1, 3), (2, 5, 6), (3, 2, 3)]


def test_tree_holds_suffixes_in_few_copies():
    """A group of 30,000 suffixes that share a gram takes a few times their 360 bytes each, and is covered right."""

    class Parts:  # the rows as a worker gets them, in order
        repartition = sortWithinPartitions = select = lambda self, *columns: self
        mapInArrow = lambda self, scan, schema: scan

    rng, n = np.random.default_rng(5), 30_000
    left, right = (np.ascontiguousarray(rng.integers(97, 123, (n, w), dtype=np.uint8)) for w in (160, 200))
    right[:, :40] = 120
    left[1], right[1] = left[0], right[0]
    right[1, 190] ^= 1  # 160 bytes before the anchor and 190 from it on
    by = np.argsort(right.view("V200").ravel(), kind="stable")
    batches = []
    for at in range(0, n, 10_000):
        some = by[at : at + 10_000]
        ids = pa.array(some, pa.int64())
        sides = [pa.array([bytes(x) for x in side[some]], pa.binary()) for side in (left, right)]
        batches.append(pa.RecordBatch.from_arrays([pa.array(np.zeros(len(some), np.int64)), ids, ids, pa.array(np.full(len(some), 500)), *sides], list("gdkplr")))
    tracemalloc.start()
    found = [r for b in suffix_dedup.tree_cover(Parts(), 200, 40)(iter(batches)) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted((r["d"], r["s"], r["e"]) for r in found) == [(0, 340, 690), (1, 340, 690)]
    assert peak < 700 * n, peak / n


def brute_components(docs):
    prints = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w)] if 0 < len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), 1 << 60), doc_id)
    return [(doc_id, f"{prints[i]:016x}", least.get(root(i))) for i, (doc_id, _) in enumerate(docs)]


def test_simhash(spark, docs):
    rng = random.Random(2)
    more = docs + [(100 + i, "same words here and there Over and over\t" * 40 + rng.choice("abcdefgh") * i) for i in range(30)]
    got = simhash.near_duplicates(spark.createDataFrame(more, SCHEMA)).select("doc_id", "fingerprint", "component_id")
    want = sorted(brute_components(more), key=str)
    assert rows_of(got) == want
    assert len({r[2] for r in want}) < len(want)
    kept = simhash.one_of_each(spark.createDataFrame([(*r, "x") for r in more], f"{SCHEMA}, component_id string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r[2] for r in want})
    assert kept.columns == ["doc_id", "text", "component_id"]


def test_simhash_keeps_one_of_each_component_whatever_the_ids(spark):
    """Unlinked rows without an id all stay, linked ones leave one; an id with two unlinked texts keeps both."""
    rng = random.Random(11)
    a, b, *alone = [" ".join(rng.choice("abcdefgh") * 3 + str(i) for i in range(80)) for _ in range(8)]
    rows = [(5, a), (5, b), (9, b), *[(None, t) for t in alone], (None, alone[0]), (None, alone[0].upper()), (7, alone[1])]
    assert len({c for _, c, _ in brute_components(rows)}) == 8
    got = rows_of(simhash.one_of_each(spark.createDataFrame(rows, SCHEMA)))
    assert len(got) == 8
    assert sorted(t.lower() for _, t in got) == sorted([a, b, *alone])
    assert sorted(d for d, _ in got if d is not None) == [5, 5, 7]


def test_simhash_links_within_two_bits_exactly(spark):
    rng = random.Random(5)
    near = set()
    for _ in range(50):
        x = rng.getrandbits(64)
        for _ in range(40):
            y = x
            for _ in range(rng.randint(0, 3)):
                y ^= 1 << rng.randrange(64)
            near.add(y)
    near = sorted(near | {0, 1, 3, 7, 15, 2**64 - 1})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = {r["v"]: r["root"] for r in simhash.components(simhash.links(spark.createDataFrame([(signed(x),) for x in near], "f long"))).collect()}
    parent = {x: x for x in near}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(near):
        for y in near[:i]:
            if (x ^ y).bit_count() <= 2:
                parent[root(x)] = root(y)
    groups = [collections.defaultdict(set), collections.defaultdict(set)]
    for x in near:
        groups[0][found.get(signed(x), signed(x))].add(x)
        groups[1][root(x)].add(x)
    assert sorted(map(sorted, groups[0].values())) == sorted(map(sorted, groups[1].values()))


def test_long_chain_of_links(spark):
    """Components follow links to any depth."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {tuple(r) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 201)}


def test_embedding_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 500, dtype=np.int64).astype(np.uint64)
    b = a ^ rng.integers(0, 1 << 63, 500, dtype=np.int64).astype(np.uint64)
    parts = lambda x: np.stack([(simhash.segment_counts(x) >> np.uint64(4 * j)) & np.uint64(15) for j in range(16)], 1).astype(int)
    assert (np.abs(parts(a) - parts(b)).sum(1) <= np.bitwise_count(a ^ b)).all()
    assert (parts(a).sum(1) == np.bitwise_count(a)).all()


def chunks(text):
    return fingerprint.chunk_set(np.frombuffer(text.encode(), np.uint8))


@pytest.mark.parametrize("length, gram, group", [(60, 12, 5_000), (40, 20, 5_000), (40, 20, 2)])
def test_maximal_repeats(spark, docs, length, gram, group):
    """Groups have all places of their string; together they cover what is removed."""
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    data = {i: (t or "").encode() for i, t in docs}
    groups = {}
    for r in suffix_dedup.maximal_repeats(spark.createDataFrame(docs, SCHEMA), length, gram, group).collect():
        groups.setdefault((r["repeat"], r["n_bytes"]), []).append((r["doc_id"], r["start"]))
    spans = {i: set() for i in data}
    for (name, n), places in groups.items():
        d, at = places[0]
        text = data[d][at : at + n]
        assert len(text) == n >= length and hashlib.sha256(text).hexdigest() == name
        every = [(i, m) for i, x in data.items() for m in range(len(x) - n + 1) if x[m : m + n] == text]
        assert sorted(places) == sorted(every) and len(every) > 1
        for i, m in places:
            spans[i] |= set(range(m, m + n))
    for (i, _), (_, mask) in zip(docs, covered(docs, length), strict=True):
        assert spans[i] == {j for j, x in enumerate(mask) if x}


def test_repeats_of_a_small_array():
    """abXcd, zbXcd and abXce around the anchor X: the sets that share a string of four, each as long as it goes."""
    left, right = [b"ba", b"bz", b"ba"], [b"Xcd", b"Xcd", b"Xce"]
    got = suffix_dedup.repeats(np.zeros(3, np.int64), left, right, 4, 1)
    # bXc is three bytes; bXcd has two places, abXc two; all of b and Xcd's other sets go further to a side
    assert sorted(got) == [(1, 3, [0, 1]), (2, 2, [0, 2])]


def test_repeated_rows_are_cut_once_a_task(spark):
    """500 rows of one id and text and one that shares a part: a few snippets, and the same bytes go."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(260)
    rows = [(1, text(100) + shared + text(200))] * 500 + [(2, text(90) + shared + text(50))]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    keyed = suffix_dedup.keyed(docs)
    wanted = suffix_dedup.anchor_table(keyed, 200, 40).select("h", "d", "k", "p").distinct()
    assert suffix_dedup.snippets(keyed, wanted, 200, 40).count() <= 4 * wanted.count()
    got = {(r["doc_id"], r["n_removed"]) for r in suffix_dedup.removed(docs).collect()}
    assert got == {(1, 560), (2, 260)}


def plain_chunks(text):
    """The chunks of a text byte by byte: a rolling gear hash, boundaries as they come, digests as sums of powers."""
    data, gear, word = text.encode(), [int(g) for g in _common.GEAR], (1 << 64) - 1
    found, start, h = set(), 0, 0

    def digest(part):
        x = sum(gear[c] * pow(_common._BASE, j, 1 << 64) for j, c in enumerate(part)) + len(part) * 0xA24BAED4963EE407 & word
        for _ in range(2):
            x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & word
        return (x ^ x >> 32) >> 12 << 12 | len(part)

    for i, c in enumerate(data):
        h = (h << 1) + (gear[c] >> 20) & 0xFFFFFFFF
        n = i + 1 - start
        zeros = 7 if n < fingerprint.NORMAL else 5
        if n >= fingerprint.MAX or n >= fingerprint.MIN and not h >> 25 & (1 << zeros) - 1:
            found.add(digest(data[start : i + 1]))
            start = i + 1
    if start < len(data):
        found.add(digest(data[start:]))
    return np.array(sorted(found), np.uint64)


def plain_likeness(a, b):
    a, b = ({int(x): int(x) & 0xFFF for x in y} for y in (a, b))
    whole = max(sum(a.values()), sum(b.values()))
    return sum(n for x, n in a.items() if x in b) / whole if whole else 1.0


def test_chunks_equal_a_plain_chunker():
    rng = random.Random(12)
    for n in [0, 1, 15, 16, 17, 63, 64, 65, 300, 600, 5_000]:
        t = "".join(rng.choice("abcdefgh é\n") for _ in range(n))
        assert chunks(t).tolist() == plain_chunks(t).tolist(), n
    assert chunks("a" * 3_000).tolist() == plain_chunks("a" * 3_000).tolist()


def wanted_fingerprints(spark, rows):
    hashed = [r[0] for r in spark.createDataFrame([(i, t or "") for i, (_, t) in enumerate(rows)], "i int, t string").orderBy("i").select(F.xxhash64("t")).collect()]
    order = [r for _, r in sorted(zip(hashed, rows, strict=True), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))]
    want = []
    for i, (doc_id, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + following[:n]
        c, e, f = (plain_chunks(x) for x in (t, edited, following))
        want.append((doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.as_text(c), fingerprint.as_text(e), plain_likeness(c, e), plain_likeness(c, f)))
    return sorted(want, key=str)


@pytest.mark.parametrize("range_bytes", [1 << 25, 200])
def test_fingerprints(spark, docs, range_bytes, monkeypatch):
    """Ids with several texts and with repeated ones; ranges smaller than what one id holds."""
    monkeypatch.setattr(fingerprint, "in_order", functools.partial(fingerprint.in_order, range_bytes=range_bytes))
    rows = docs + [(30, f"text {i} " * 9) for i in range(12)] + [(31, "same " * 30)] * 9 + [(None, f"x{i} " * 20) for i in range(6)]
    assert rows_of(fingerprint.fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(3))) == wanted_fingerprints(spark, rows)


def test_one_id_goes_to_many_partitions(spark):
    """200,000 rows of one id, and as many of one id and text."""
    rows = spark.range(200_000).selectExpr("7 as doc_id", "concat('text ', id) as text")
    sizes = [r[0] for r in fingerprint.in_order(rows, 1 << 18).groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 40_000 and sum(sizes) < 200_000 + 1_000
    same = fingerprint.in_order(rows.select("doc_id", F.lit("one").alias("text")))
    assert same.count() < 100 and same.where("role = 0").agg(F.sum("n")).first()[0] == 200_000
    assert fingerprint.fingerprints(rows.select("doc_id", F.lit("one").alias("text"))).groupBy("near_next", "edited_sha256").count().first()["count"] == 200_000


def test_fingerprint_of_a_single_row(spark):
    r = fingerprint.fingerprints(spark.createDataFrame([(9, "abcdefgh")], SCHEMA)).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and r["near_next"] == 1.0


def test_chunks_resist_shifts_and_blocks_do_not_show(monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefghij ") for _ in range(20_000))
    data = np.frombuffer(text.encode(), np.uint8)
    ends = fingerprint.boundaries(data)
    sizes = np.diff(np.concatenate([[0], ends]))
    assert ends[-1] == len(data) and sizes.max() <= fingerprint.MAX and sizes[:-1].min() >= fingerprint.MIN
    assert fingerprint.likeness(chunks(text), chunks("shift " + text)) > 0.97
    assert fingerprint.containment(chunks(text[5_000:9_000]), chunks(text)) > 0.9
    again = fingerprint.from_text(fingerprint.as_text(chunks(text)))
    assert (again == chunks(text)).all()
    monkeypatch.setattr(fingerprint, "BLOCK", 777)
    assert (fingerprint.boundaries(data) == ends).all()


def test_line_dedup_against_sql(spark):
    rng = random.Random(7)
    rows = [(i, "\n".join(rng.choice("abcdef") for _ in range(rng.randint(0, 9)))) for i in range(60)] + [(60, None), (61, ""), (62, "\n\n\n\n\n"), (63, " \n\n \n")]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841  read by the SQL
    want = sorted(duckdb.sql(line_dedup.oracle_sql()).fetchall(), key=str)
    got = line_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "text", "n_lines", "n_removed")
    assert rows_of(got) == want and sum(r[3] for r in want)


def test_line_dedup_columns_and_repeated_rows(spark):
    rows = [(1, "a\nb\nc", 5), (1, "a\nb\nc", 5), (2, "z\na\nb\nc\ny", 6), (None, "a\nb\nc", 7)]
    got = line_dedup.deduplicated(spark.createDataFrame(rows, f"{SCHEMA}, n_removed long"))
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    # the row without an id comes first; the repeated rows are one document
    assert rows_of(got) == sorted([(None, "a\nb\nc", 3, 0), (1, "", 3, 3), (1, "", 3, 3), (2, "z\ny", 5, 3)], key=str)


def test_line_dedup_plan_has_no_python(spark):
    plan = line_dedup.deduplicated(spark.createDataFrame([(1, "a")], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("apply", [suffix_dedup.removed, suffix_dedup.without_repeats, fingerprint.fingerprints, simhash.near_duplicates, simhash.one_of_each, line_dedup.deduplicated])
def test_empty_tables(spark, apply):
    assert apply(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("apply", [suffix_dedup.removed, fingerprint.fingerprints, simhash.near_duplicates, line_dedup.deduplicated])
def test_clashing_columns_and_nulls(spark, apply):
    names = ["d", "k", "t", "h", "s", "p", "spans", "f", "v", "root", "b", "role", "first", "places", "__k", "__p", "d2", "k2", "n", "w"]
    rows = [(None, None, *names), (1, None, *[None] * len(names)), (2, "a\nb\nc " * 80, *names), (3, "a\nb\nc " * 80, *names)]
    got = apply(spark.createDataFrame(rows, f"{SCHEMA}, " + ", ".join(f"{n} string" for n in names)))
    assert len(got.select("doc_id").collect()) == 4


def test_very_long_texts(spark):
    """A text of a million words, and one of 300,000 lines, most of them the lines of another."""
    words = " ".join(f"w{i % 9973}x{i}" for i in range(1_000_000))
    rows = spark.createDataFrame([(1, words), (2, words + " more")], SCHEMA)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(rows).collect()}
    assert got[1]["component_id"] == got[2]["component_id"] == 1 and got[1]["fingerprint"] == f"{simhash.fingerprint(words):016x}"
    lines = [f"line {i}" for i in range(300_000)]
    rows = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["first", *lines[:200_000], "last"]))], SCHEMA)
    got = {r["doc_id"]: r for r in line_dedup.deduplicated(rows).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["text"] == "first\nlast" and got[2]["n_removed"] == 200_000
