"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct lower-cased words, each with its first and last four letters, hashed into 2**20 slots. All
slots that a labelled text shows are inputs of the machine:

    logit = b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j          (x_i = evidence of slot i, if one of its terms occurs)

The evidence of a slot, chi / (chi + SHRINK) by the chi-square of its occurrence against the label, lies between 0 and 1:
terms that say little count little, and none is left out. The factors v learn what two terms say together, such as an
insult beside the mention of a group, which additive weights can't express. Fitting uses a bounded sample of the labelled
rows: at most SAMPLE documents per class, lowest hash of doc_id first, and no more than FIT_TERMS distinct terms per class
in all (a document at least). Scoring reads every whole text in one pass without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inflecta.llm._common import fold, slices, written

SAMPLE = 5_000
FIT_TERMS = 5_000_000
SLOTS = 1 << 20
SHRINK = 15.0
RANK = 8
KEEP = 0.8
#: Steps of fitting at least, for small samples.
STEPS = 300
WORD = re.compile(r"[^\W\d_]+")
#: Words whose slots a worker remembers; further words are hashed anew.
MEMO = 400_000


def word_slots(word: str) -> tuple[int, ...]:
    """The hashed terms that one lower-cased word adds."""
    if len(word) < 5:
        return (zlib.crc32(word.encode("utf-8", "replace")) % SLOTS,)
    return zlib.crc32(word.encode("utf-8", "replace")) % SLOTS, zlib.crc32(word[:4].encode("utf-8", "replace"), 1) % SLOTS, zlib.crc32(word[-4:].encode("utf-8", "replace"), 2) % SLOTS


class Remembered(dict):
    """word_slots of the words met so far, up to MEMO of them; of further words anew each time."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        hit = word_slots(word)
        if len(self) < MEMO:
            self[word] = hit
        return hit


def text_slots(text: str | None, memo: Remembered | None = None) -> np.ndarray:
    """Sorted distinct slots of a text."""
    memo = Remembered() if memo is None else memo
    words = set(WORD.findall(text.lower())) if text else ()
    return np.unique(np.fromiter(chain.from_iterable(map(memo.__getitem__, words)), np.int32))


@dataclass
class FactorizationMachine:
    """b; of each slot its evidence x, weight w and factors v (all zero for slots that no labelled text showed)."""

    bias: float
    evidence: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def logit(self, slots: np.ndarray) -> float:
        x = self.evidence[slots]
        v = self.factors[slots] * x[:, None]
        total = v.sum(0, dtype=np.float64)
        flat = v.ravel()
        return float(self.bias + x @ self.weights[slots] + 0.5 * (total @ total - flat @ flat))

    def score(self, slots: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(slots), -35, 35))))


def evidence(rows: list[np.ndarray], labels: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """chi / (chi + SHRINK) of each slot, classes in balance; 0 for slots that don't occur."""
    count = lambda label: np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y == label] or [np.zeros(0, np.int32)]), minlength=slots)
    toxic, other = count(1), count(0)
    n1, n0 = max(int(labels.sum()), 1), max(int((1 - labels).sum()), 1)
    # the smaller class is weighed up, so that a rare class counts as much as a common one
    gap = toxic / n1 - other / n0
    rate = np.clip((toxic + other) / (n1 + n0), 1e-9, 1 - 1e-9)
    chi = gap**2 / (rate * (1 - rate)) * (n1 * n0 / (n1 + n0))
    return (chi / (chi + SHRINK)).astype(np.float32)


def fitted(rows: list[np.ndarray], labels: np.ndarray, slots: int = SLOTS, rank: int = RANK, epochs: int = 6, batch: int = 64, rate: float = 0.15, keep: float = KEEP, x: np.ndarray | None = None) -> FactorizationMachine:
    """AdaGrad on the log loss with classes in balance; one class or no rows: a constant machine.

    Each step sees a random share `keep` of the inputs, so that terms which mostly come together each learn their own part.
    """
    n, n1 = len(labels), int(labels.sum())
    x = evidence(rows, labels, slots) if x is None else x
    rng = np.random.default_rng(7)
    b, gb = 0.0, 1e-3
    w, gw = np.zeros(slots, np.float32), np.full(slots, 1e-3, np.float32)
    v, gv = rng.normal(0, 0.02, (slots, rank)).astype(np.float32), np.full((slots, rank), 1e-3, np.float32)
    v[x == 0] = 0
    if not 0 < n1 < n:
        share = n1 / n if n else 0.0
        return FactorizationMachine(float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros_like(x), w, v)
    weigh = np.where(labels == 1, 0.5 * n / n1, 0.5 * n / (n - n1)).astype(np.float32)
    order, batches = rng.permutation(n), []
    for at in range(0, n, batch):
        pick = order[at : at + batch]
        use, inverse = np.unique(np.concatenate([rows[i] for i in pick]), return_inverse=True)
        batches.append((pick, use, inverse, np.repeat(np.arange(len(pick)), [len(rows[i]) for i in pick])))
    epochs = max(epochs, -(-STEPS // len(batches)))
    for step in rng.permuted(np.tile(np.arange(len(batches)), (epochs, 1)), axis=1).ravel():
        pick, use, inverse, owner = batches[step]
        by_row = lambda e: np.bincount(owner, e, len(pick))  # noqa: B023, E731
        by_slot = lambda e: np.bincount(inverse, e, len(use))  # noqa: B023, E731
        xs = (x[use] * (rng.random(len(use)) < keep))[inverse]
        ws, vs = w[use], v[use]
        each = [xs * vs[inverse, f] for f in range(rank)]
        sums = [by_row(e) for e in each]
        z = b + by_row(xs * ws[inverse]) + 0.5 * sum(s * s - by_row(e * e) for s, e in zip(sums, each, strict=True))
        g = weigh[pick] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) / len(pick)
        gx = g[owner] * xs
        steps = [by_slot(gx) + 1e-5 * ws, np.stack([by_slot(gx * (s[owner] - e)) for s, e in zip(sums, each, strict=True)], 1) + 1e-4 * vs]
        gb += float(g.sum()) ** 2
        b -= rate * float(g.sum()) / gb**0.5
        for p, sizes, d in ((w, gw, steps[0]), (v, gv, steps[1])):
            sizes[use] += d * d
            p[use] -= rate * d / np.sqrt(sizes[use])
    return FactorizationMachine(b, x, w, v)


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, fit_terms: int = FIT_TERMS) -> FactorizationMachine:
    """Learns from labelled rows outside fold 0: at most `sample` toxic and `sample` other documents, and `fit_terms` distinct
    terms of each. A document with several labels is toxic if one is 1; of one with several texts one text is taken.

    Ids, of any type, are compared as text. A table of the sample's terms is written; the driver reads what is within bounds.
    """
    rows = labels.select(F.col("doc_id").cast("string").alias("k"), F.col("toxic").cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("k")) != 0))
    rows = rows.groupBy("k").agg(F.max("y").alias("y")).withColumn("u", F.xxhash64("k") / float(1 << 64) + 0.5)  # uniform in [0, 1)
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # about twice the sample of each class by hash, however many rows there are; only those are ordered
    near = F.lit(0.0)
    for y, n in counts.items():
        near = F.when(F.col("y") == y, min(1.0, (2.0 * sample + 100) / n)).otherwise(near)
    picked = rows.where(F.col("u") <= near).withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("u", "k"))).where(F.col("r") <= sample).select("k", "y", "r")

    def terms(batches):
        memo = Remembered()
        for b in slices(batches):
            found = [text_slots(t, memo) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["k", "y", "r", "n", "s"])

    # 2 * sample rows of three small values: a fixed bound, so the broadcast can't grow with the data
    texts = documents.select(F.col("doc_id").cast("string").alias("k"), F.col("text").alias("t")).join(F.broadcast(picked), "k").select("k", "y", "r", "t")
    each = texts.mapInArrow(terms, "k string, y int, r int, n long, s binary")
    once = written(each.groupBy("k", "y", "r").agg(F.min(F.struct("n", "s")).alias("one")).select("y", "r", "one.n", "one.s"), "toxicity-terms")
    within = once.select("y", "r", "n").withColumn("total", F.sum("n").over(Window.partitionBy("y").orderBy("r"))).where(F.col("total") - F.col("n") < fit_terms).select("y", "r")
    got = once.join(F.broadcast(within), ["y", "r"]).select("y", "r", "s").toPandas().sort_values(["y", "r"])
    return fitted([np.frombuffer(s, np.int32) for s in got["s"]], got["y"].to_numpy(np.int64))


def score(documents: DataFrame, machine: FactorizationMachine) -> DataFrame:
    """doc_id, held_out, score and predicted of every row. Null or empty texts get the score of no terms at all.

    Rows are scored one by one: repeated rows give repeated results, an empty table an empty one, other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(machine)

    def scored(batches):
        fm, memo = shared.value, Remembered()
        for b in slices(batches):
            out = [fm.score(text_slots(text, memo)) for text in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64()), pa.array([int(s >= 0.5) for s in out], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    id_type = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text").alias("t")).mapInArrow(scored, f"doc_id {id_type}, held_out boolean, score double, predicted int")
