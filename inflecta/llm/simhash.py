"""SimHash near-duplicates through a segment-popcount embedding.

Fingerprints are embedded by the bit counts of their 16 four-bit segments. The Manhattan distance of two embeddings is a
lower bound of the Hamming distance, so pairs within two bits lie within Manhattan distance two, and then some point of
the integer grid is within one of both: each distinct fingerprint is put into its own cell and the at most 32 cells next
to it, and pairs that meet in a cell are verified exactly. Inside a cell only fingerprints that agree in one of three bit
blocks are compared (two differing bits leave a block whole). A task sends one edge per linked fingerprint (to the root
of its part), never all pairs; parts are joined to components by alternating large-star and small-star rounds over tables
in the shared folder. Equal fingerprints are one node from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inflecta.llm._common import row_key, slices, written

SHINGLE = 3
SEED = 42
MAX_BITS = 2
CHUNK_ROWS = 200_000
#: Bits of the three blocks of which one is equal where at most two bits differ.
_BLOCKS = [np.uint64((1 << 22) - 1), np.uint64(((1 << 21) - 1) << 22), np.uint64(((1 << 21) - 1) << 43)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is one if it is set in over half of the shingles' XXH64; no words: zero."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only ASCII space parts
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def segment_counts(f: np.ndarray) -> np.ndarray:
    """The embedding: bit count of each four-bit segment, in the same four bits."""
    f = f - ((f >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return (f & np.uint64(0x3333333333333333)) + ((f >> np.uint64(2)) & np.uint64(0x3333333333333333))


def cells(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (cell, fingerprint) with the cell within Manhattan distance one of the embedding."""
    base = segment_counts(f)
    keys, owner = [base], [f]
    for j in range(16):
        unit = np.uint64(1 << (4 * j))
        count = (base >> np.uint64(4 * j)) & np.uint64(15)
        up, down = count < 4, count > 0
        keys += [base[up] + unit, base[down] - unit]
        owner += [f[up], f[down]]
    return np.concatenate(keys), np.concatenate(owner)


def cell_edges(cell: np.ndarray, f: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, root) that connect just what the verified pairs inside the cells connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for block in _BLOCKS:
        part = f & block
        order = np.lexsort((f, part, cell))
        c, p, g = cell[order], part[order], f[order]
        step, left = 1, np.arange(len(g))
        while True:
            left = left[left + step < len(g)]
            left = left[(c[left] == c[left + step]) & (p[left] == p[left + step])]
            if not len(left):
                break
            x, y = g[left], g[left + step]
            near = (np.bitwise_count(x ^ y) <= max_bits) & (x != y)
            for a, b in zip(x[near].tolist(), y[near].tolist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            step += 1
    pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
    return np.array([a for a, _ in pairs], np.uint64), np.array([b for _, b in pairs], np.uint64)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64), pa.int64())


def links(fingerprints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints f whose components are those of the links of at most two bits."""
    if max_bits != 2:
        raise ValueError("cells and blocks are laid out for two bits")

    def spread(batches):
        for b in slices(batches):
            cell, f = cells(b.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([_signed(cell), _signed(f)], ["cell", "f"])

    def linked(batches):
        cell, f = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

        def edges(c, g):
            a, b = cell_edges(c, g)
            return pa.RecordBatch.from_arrays([_signed(a), _signed(b)], ["a", "b"])

        for b in slices(batches):
            cell = np.concatenate([cell, b.column(0).to_numpy().view(np.uint64)])
            f = np.concatenate([f, b.column(1).to_numpy().view(np.uint64)])
            if len(cell) >= CHUNK_ROWS and cell[0] != cell[-1]:
                end = int(np.flatnonzero(cell != cell[-1])[-1]) + 1  # the last cell may go on
                yield edges(cell[:end], f[:end])
                cell, f = cell[end:], f[end:]
        if len(cell):
            yield edges(cell, f)

    spread_out = fingerprints.select("f").distinct().mapInArrow(spread, "cell long, f long")
    return spread_out.repartition("cell").sortWithinPartitions("cell").mapInArrow(linked, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every node of the edges but the roots; root is the least node of its component.

    Large-star and small-star rounds until the edges stay the same; each round is a table in the shared folder, so a lost
    executor costs at most a part of one round. Least neighbours are pre-aggregated; joins on a hot node can be split.
    """

    def turned(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    edges, last = written(turned(edges), "simhash-edges"), None
    while True:
        sym = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        # the least neighbours are written down, so that joins are of plain tables, whose hot nodes Spark can split
        least = written(sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "simhash-least")
        large = written(turned(sym.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))), "simhash-edges")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "simhash-least")
        small = turned(large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m")))
        edges = written(small, "simhash-edges")
        state = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if state == last:
            return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
        last = state


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id, root and key k of every row.

    Null and blank texts have fingerprint zero and are linked like any other; repeated rows share a component. component_id
    is the least non-null doc_id reachable (null if there is none), root the least fingerprint: components without an id, and
    those that share one, are told apart by it. An empty table gives an empty one; other columns are ignored.
    """

    def printed(batches):
        for b in slices(batches):
            f = np.array([fingerprint(t) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _signed(f)], ["doc_id", "k", "f"])

    id_type = dict(documents.dtypes)["doc_id"]
    rows = documents.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("k"), F.col("text").alias("t"))
    prints = written(rows.mapInArrow(printed, f"doc_id {id_type}, k long, f long"), "simhash-prints")
    nodes = prints.groupBy("f").agg(F.min("doc_id").alias("least"))
    roots = nodes.join(components(links(prints)), nodes["f"] == F.col("v"), "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    named = written(roots.join(roots.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("f", "component_id", "root"), "simhash-named")
    return prints.join(named, "f").select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id", "root", "k")


def one_of_each(documents: DataFrame) -> DataFrame:
    """One row, all columns as they are, of each component: one that gives the component its id, of several the lowest key.

    A component without any id keeps one of its rows; an id that two components share stays in both.
    """
    names = documents.columns
    kept = near_duplicates(documents).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id").agg(F.min("k").alias("k"))
    rows = documents.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = F.col(f"c{names.index('doc_id')}"), F.col(f"c{names.index('text')}")
    rows = rows.withColumn("row", row_key(doc_id, text))
    joined = rows.join(kept, doc_id.eqNullSafe(F.col("doc_id")) & (F.col("row") == F.col("k")), "left_semi")
    return joined.dropDuplicates([f"c{names.index('doc_id')}", "row"]).drop("row").toDF(*names)
