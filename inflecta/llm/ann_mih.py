"""Nearest neighbours by inner product with multi-index hashing of learned rotated binary codes.

Codes. A vector x gets one more component sqrt(M^2 - |x|^2) (M: the largest norm; a query gets 0), which makes the order
of inner products one of angles. Of a bounded sample (SAMPLE vectors, lowest hash first) the mean, principal directions and,
by iterative quantization from several starts, rotations are learned that lose least when only signs are kept: PARTS
substrings of WIDTH bits.

Index. Every vector is indexed. Rows are dealt into blocks by a hash, so any hot group is split and a block fits a task. In
a block each substring has its own table: rows in order of the substring's value, with where each value begins.

Search. Two codes within Hamming radius r differ by at most r // m bits in some of m substrings (by one less in all but the
first r % m + 1 of them): probing each table with all values that close to the query's retrieves every code within r
(pigeonhole), and others that share a substring by chance. What is retrieved goes through a distance on the first CHECKED
bits, then is ranked by inner product in double precision; a block sends at most k rows per query on, and the best k of all
blocks stay.

The radius and that distance are the least with which TARGET of the neighbours of sample queries among sample vectors are
found, a query itself left out. Where the corpus is f times the sample, a query's k nearest lie among its k / f nearest of
the sample, and those are calibrated on. A query that finds fewer than k rows in all is searched once more over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inflecta.llm._common import slices, written

SAMPLE = 8_192
WIDTH = 12
PARTS = 128
CHECKED = 512
#: Principal directions that are kept at most.
DIRECTIONS = 256
#: Rows of a block: as many as leave two blocks a core, within these.
LEAST_BLOCK, BLOCK = 8_192, 65_536
TARGET = 0.96
ROUNDS = 10
TRIALS = 256
QUERIES = 64
_WORDS = CHECKED // 64
_MASKS = np.arange(1 << WIDTH, dtype=np.uint16)
_MASKS = _MASKS[np.lexsort((_MASKS, np.bitwise_count(_MASKS)))]  # by number of bits
_UPTO = np.cumsum(np.bincount(np.bitwise_count(_MASKS), minlength=WIDTH + 1))  # masks of at most so many bits


@dataclass
class Codes:
    """parts[j]: the j-th substring of every row; checked: the first CHECKED bits as words."""

    parts: np.ndarray
    checked: np.ndarray


@dataclass
class Coder:
    """bits = signs of ([x, rest] - mean) @ project; radius and distance: what neighbours are found within."""

    mean: np.ndarray
    project: np.ndarray
    norm2: float
    radius: int = (WIDTH + 1) * PARTS
    distance: int = CHECKED

    def codes(self, x: np.ndarray, query: bool) -> Codes:
        parts, checked = np.empty((PARTS, len(x)), np.uint16), np.empty((len(x), _WORDS), np.uint64)
        powers = (1 << np.arange(WIDTH)).astype(np.float32)
        for at in range(0, len(x), 4096):
            y = x[at : at + 4096]
            rest = np.zeros(len(y)) if query else np.sqrt(np.maximum(self.norm2 - (y * y).sum(1), 0))
            z = np.concatenate([y, rest[:, None]], 1)
            bits = (z if query else z - self.mean) @ self.project > 0
            parts[:, at : at + 4096] = (bits.reshape(len(y), PARTS, WIDTH) @ powers).T
            checked[at : at + 4096] = np.packbits(bits[:, :CHECKED], axis=1).view(np.uint64)
        return Codes(parts, checked)


def lifted(x: np.ndarray, norm2: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(norm2 - (x * x).sum(1), 0))[:, None]], 1)


def learned(sample: np.ndarray, norm2: float, k: int, rows: int, target: float = TARGET) -> Coder:
    """Rotations of the principal directions, and the radius and distance that find `target` of the neighbours.

    rows: size of the corpus that the sample stands for.
    """
    n, dim = sample.shape
    z = lifted(sample, norm2)
    mean = z.mean(0)
    _, vectors = np.linalg.eigh(np.cov((z - mean).T) if n > 1 else np.eye(dim + 1))
    keep = vectors[:, ::-1][:, :DIRECTIONS]
    rng = np.random.default_rng(3)
    v = (z - mean)[: SAMPLE // 2] @ keep
    turned = []
    while sum(t.shape[1] for t in turned) < PARTS * WIDTH:
        rotation = np.linalg.qr(rng.normal(size=(keep.shape[1], keep.shape[1])))[0]
        for _ in range(ROUNDS if n > 1 else 0):
            u, _, w = np.linalg.svd(np.sign(v @ rotation).T @ v)
            rotation = (u @ w).T
        turned.append(keep @ rotation)
    coder = Coder(mean, np.concatenate(turned, 1)[:, : PARTS * WIDTH], norm2)
    trial = rng.permutation(n)[:TRIALS]
    score = sample[trial] @ sample.T
    score[np.arange(len(trial)), trial] = -np.inf  # the query itself
    own = min(n - 1, max(1, -(-k * n // max(rows, n))))
    if own > 0:
        near = np.argsort(-score, axis=1, kind="stable")[:, :own]
        asked, held = coder.codes(sample[trial], True), coder.codes(sample, False)
        owner = np.repeat(np.arange(len(trial)), own)
        apart = np.bitwise_count(asked.parts[:, owner] ^ held.parts[:, near.ravel()]).astype(np.int64)
        # the least radius that probes a table with the neighbour's value
        reached = (apart * PARTS + np.arange(PARTS)[:, None]).min(0)
        far = np.bitwise_count(asked.checked[owner] ^ held.checked[near.ravel()]).sum(1)
        at = min(len(owner) - 1, int(np.ceil(target * len(owner))))
        coder.radius = int(np.sort(reached)[at])
        coder.distance = int(np.sort(far)[min(len(owner) - 1, int(np.ceil((1 - (1 - target) / 8) * len(owner))))])
    return coder


def reach(radius: int, part: int) -> int:
    """Bits by which some substring differs at most, this one being among those that may; -1: it needs no probe."""
    return radius // PARTS - (part > radius % PARTS)


class BlockIndex:
    """The tables of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: Codes):
        by = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.checked = ids[by], vectors[by], codes.checked[by]
        self.tables = []
        for part in codes.parts[:, by]:
            order = np.argsort(part, kind="stable").astype(np.int32)
            self.tables.append((order, np.searchsorted(part[order], np.arange((1 << WIDTH) + 1)).astype(np.int32)))

    def retrieved(self, parts: np.ndarray, radius: int) -> np.ndarray:
        """found[query, row]: whether some probe of the query's substrings meets the row."""
        queries = parts.shape[1]
        found = np.zeros((queries, len(self.ids)), bool)
        if radius >= WIDTH * PARTS:
            found[:] = True
            return found
        flat = found.reshape(-1)
        for j, (order, starts) in enumerate(self.tables):
            bits = reach(radius, j)
            if bits < 0:
                break
            value = (parts[j][:, None] ^ _MASKS[: _UPTO[bits]]).astype(np.int32)
            low, size = starts[value], starts[value + 1] - starts[value]
            each = size.ravel()
            total = int(each.sum())
            if total:
                place = np.arange(total) - np.repeat(np.cumsum(each) - each, each) + np.repeat(low.ravel(), each)
                flat[order[place] + np.repeat(np.arange(queries) * len(self.ids), size.sum(1))] = True
        return found

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, codes: Codes, radius: int, distance: int, k: int):
        """For each query (ids, scores) of the k best rows retrieved but the query's own; ties to the smaller id."""
        for at in range(0, len(query_ids), QUERIES):
            found = self.retrieved(codes.parts[:, at : at + QUERIES], radius)
            for i, hit in enumerate(found, at):
                rows = np.flatnonzero(hit)
                rows = rows[self.ids[rows] != query_ids[i]]
                if distance < CHECKED:
                    rows = rows[np.bitwise_count(self.checked[rows] ^ codes.checked[i]).sum(1) <= distance]
                score = inner(queries[i], self.vectors[rows])
                best = np.lexsort((self.ids[rows], -score))[:k]
                yield self.ids[rows[best]], score[best]


def inner(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the order of its components, so that equal vectors tie."""
    return np.add.reduce(vectors * query, axis=1) if len(vectors) else np.zeros(0)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, empty or zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def search(vectors: DataFrame, is_query: Column, k: int = 20, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found to every query.

    Vectors that are null, empty, zero or not finite, rows without an id, and vectors of another length than the most
    frequent one (of equally frequent ones, the least) take no part. Rows that repeat an id are candidates one by one, and
    queries once (least vector first); a query never meets rows of its own id. An empty table gives an empty one; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("x"), is_query.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("x")))
    square = F.aggregate("x", F.lit(0.0), lambda a, b: a + b.cast("double") * b.cast("double"))
    sizes = rows.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("c"), F.max(square).alias("m")).orderBy(F.desc("c"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == sizes["n"])
    # about twice the sample by hash, however many rows there are; only those meet in one task
    u = F.xxhash64("id", "x") / float(1 << 64) + 0.5
    sample = rows.select("id", "x", u.alias("u")).where(F.col("u") <= (2.0 * SAMPLE + 100) / sizes["c"]).distinct().orderBy("u", "id").limit(SAMPLE).toPandas()
    coder = spark.sparkContext.broadcast(learned(np.stack(sample["x"].to_numpy()).astype(np.float64), sizes["m"], k, sizes["c"], target))
    size = min(BLOCK, max(LEAST_BLOCK, sizes["c"] // (2 * spark.sparkContext.defaultParallelism)))
    blocks = max(1, -(-sizes["c"] // size))

    def found(queries: DataFrame, everything: bool) -> DataFrame:
        indexed = rows.select(F.pmod(F.xxhash64("id", "x"), F.lit(blocks)).cast("int").alias("b"), F.lit(0).alias("kind"), "id", "x")
        asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(1).alias("kind"), "id", "x")

        def matrix(batch: pa.RecordBatch) -> np.ndarray:
            return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)

        def scan(batches):
            model, held, index, now = coder.value, [], None, None
            radius, distance = (WIDTH * PARTS, CHECKED) if everything else (model.radius, model.distance)
            for batch in slices(batches):
                b, kind = batch.column("b").to_numpy(), batch.column("kind").to_numpy()
                cuts = [0, *(np.flatnonzero((b[1:] != b[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(b)]
                for low, high in zip(cuts, cuts[1:], strict=False):
                    part = batch.slice(low, high - low)
                    if b[low] != now:
                        held, index, now = [], None, b[low]
                    if not kind[low]:
                        held.append((part.column("id").to_numpy(), matrix(part)))
                        continue
                    if index is None:
                        if not held:
                            continue
                        ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                        index, held = BlockIndex(ids, x, model.codes(x, False)), []
                    ids, x = part.column("id").to_numpy(), matrix(part)
                    hits = list(index.nearest(ids, x, model.codes(x, True), radius, distance, k))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(h[0]) for h in hits])), pa.array(np.concatenate([h[0] for h in hits])), pa.array(np.concatenate([h[1] for h in hits]))], ["query_id", "vec_id", "score"])

        dealt = indexed.union(asked).repartition(blocks, "b").sortWithinPartitions("b", "kind", "id")
        best = dealt.mapInArrow(scan, "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    queries = rows.where("q").groupBy("id").agg(F.min("x").alias("x"))
    first = written(found(queries, False), "ann-found")
    counts = queries.join(first.groupBy("query_id").agg(F.count("*").alias("c")), F.col("id") == F.col("query_id"), "left")
    short = counts.where(F.coalesce("c", F.lit(0)) < F.lit(k)).select("id", "x")
    if not short.limit(1).count():
        return first
    return first.join(short.select("id"), F.col("query_id") == F.col("id"), "left_anti").union(found(short, True))
