"""Document fingerprints by content-defined chunking.

A gear hash (each byte's fixed random value, shifted one bit per later byte, 32 bits: a window of 32 bytes) proposes
boundaries; normalised chunking asks for more zero bits below NORMAL bytes than above, within MIN and MAX. A chunk's
boundaries depend only on bytes near them, so an insertion moves chunks without changing them. A fingerprint is the set
of distinct chunks, each as 52 bits of digest and 12 bits of length, in order, as hexadecimal. Its length-weighted
overlap with another set measures containment; likeness is the smaller of the containments in both directions.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inflecta.llm._common import GEAR, prefix_sums, slices, span_hash

MIN, NORMAL, MAX = 16, 64, 512
HARD, EASY = np.uint32(0x7F << 25), np.uint32(0x1F << 25)
_GEAR32 = (GEAR >> np.uint64(20)).astype(np.uint32)
BLOCK = 1 << 22
#: Bytes of text in a range of documents, and keys that are drawn for each to find its bounds.
RANGE_BYTES = 32 << 20
DRAWN = 24


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear[data[i - j]] << j over the last 32 bytes, by doubling the window five times."""
    h = _GEAR32[data]
    span = 1
    while span < 32:
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint32(span) if len(h) > span else np.zeros(0, np.uint32)
        h, span = longer, 2 * span
    return h


def boundaries(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks, in order; the last is len(data). Long data are hashed in blocks."""
    n = len(data)
    easy, hard = [], []
    for at in range(0, n, BLOCK):
        lead = min(at, 31)
        h = gear_hashes(data[at - lead : at + BLOCK])[lead:]
        e = np.flatnonzero((h & EASY) == 0)
        easy += (e + (at + 1)).tolist()
        hard += (e[(h[e] & HARD) == 0] + (at + 1)).tolist()
    ends, start = [], 0
    while n - start > MIN:
        i = bisect_left(hard, start + MIN)
        end = hard[i] if i < len(hard) else n
        if end >= start + NORMAL:
            i = bisect_left(easy, start + NORMAL)
            end = easy[i] if i < len(easy) else n
        start = min(end, start + MAX, n)
        ends.append(start)
    if start < n:
        ends.append(n)
    return np.array(ends, np.int64)


def chunk_set(data: np.ndarray) -> np.ndarray:
    """Sorted distinct chunks as digest << 12 | length."""
    if not len(data):
        return np.zeros(0, np.uint64)
    ends = boundaries(data)
    starts = np.concatenate([[0], ends[:-1]])
    return np.unique((span_hash(prefix_sums(data), starts, ends) & np.uint64(0xFFFFFFFFFFFFF000)) | (ends - starts).astype(np.uint64))


def as_text(chunks: np.ndarray) -> str:
    """The fingerprint: 16 hexadecimal digits a chunk; of an empty text the empty string."""
    return chunks.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's chunk bytes that b's chunks hold too; an empty set is contained in any."""
    whole = int((a & np.uint64(0xFFF)).sum())
    return int((np.intersect1d(a, b, assume_unique=True) & np.uint64(0xFFF)).sum()) / whole if whole else 1.0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The smaller containment: 1 for equal sets, 0 without a common chunk (or if just one set is empty)."""
    both = int((np.intersect1d(a, b, assume_unique=True) & np.uint64(0xFFF)).sum())
    whole = max(int((a & np.uint64(0xFFF)).sum()), int((b & np.uint64(0xFFF)).sum()))
    return both / whole if whole else 1.0


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "replace")


def range_bounds(rows: DataFrame, parts: int, n: int, whole: int) -> list[tuple[int, int, int]]:
    """Ascending keys that part rows (f, i, h, t) into at most `parts` ranges of about equal bytes; the first is the least key.

    Every bound is the key of a row. About DRAWN keys a range, by a hash and each with the bytes of its rows, reach the driver.
    """
    drawn = F.xxhash64("h", "i", F.lit(7)) / float(1 << 64) + 0.5 <= DRAWN * parts / max(n, 1)
    keys = rows.where(drawn).groupBy("f", "i", "h").agg(F.sum(F.octet_length("t") + 64).alias("w")).collect()
    total, at, bounds = sum(r["w"] for r in keys), 0, []
    for key, weight in sorted(((r["f"], r["i"], r["h"]), r["w"]) for r in keys):
        if at * parts >= len(bounds) * total:
            bounds.append(key)
        at += weight
    return bounds


def in_order(documents: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, text t, copies n, range b and role: rows dealt into ranges of (doc_id, hash of the text), each range sorted in
    its partition.

    The first row of a range comes once more, with role 1, behind the range before it (behind the last range: the first row
    of all), so that every row has its successor in its own partition. Ranges hold about range_bytes, but there are as many
    as shuffles have partitions at least. An id may have any number of rows: they go by the text's hash, and rows that repeat
    each other in a batch are one row with a number of copies before anything is shuffled. Nulls come first.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").isNotNull().cast("int").alias("f"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("i"), F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    n, whole, least = rows.agg(F.count("*"), F.sum(F.octet_length("t").cast("long")), F.min(F.struct("f", "i", "h"))).first()
    parts = max(-(-(whole or 0) // range_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted({tuple(least), *range_bounds(rows, parts, n, whole)}) if n else [(0, 0, 0)]
    shared = spark.sparkContext.broadcast(bounds)

    def dealt(batches):
        bounds = shared.value
        for batch in slices(batches):
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("f", "i", "h")), strict=True))
            text = batch.column("t")
            first: dict[tuple, list[int]] = {}  # rows of a key, one for each text
            copies: dict[int, int] = {}
            for at, key in enumerate(keys):
                for other in (had := first.setdefault(key, [])):
                    if text[at].as_py() == text[other].as_py():
                        copies[other] += 1
                        break
                else:
                    had.append(at)
                    copies[at] = 1
            at, b, role = list(copies), [], []
            for i in copies:
                b.append(bisect_right(bounds, keys[i]) - 1)
                role.append(0)
            for i, of in zip(list(copies), list(b), strict=True):
                if keys[i] == bounds[of]:
                    at.append(i), b.append((of - 1) % len(bounds)), role.append(1)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("f", "i", "h", "t")), pa.array([copies[i] for i in at], pa.int64()), pa.array(b, pa.int32()), pa.array(role, pa.int32())], ["f", "i", "h", "t", "n", "b", "role"])

    moved = rows.select("f", "i", "h", "t").mapInArrow(dealt, "f int, i long, h long, t string, n long, b int, role int")
    sorted_rows = moved.repartitionById(len(bounds), F.col("b")).sortWithinPartitions("role", "f", "i", "h", "t")
    return sorted_rows.select(F.when(F.col("f") == 1, F.col("i")).alias("doc_id"), "t", "n", "b", "role")


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text is the row's text with its last quarter (floor of n_chars / 4) of code points replaced by as many (or
    all) first code points of the next row by doc_id; the last row is followed by the first, a single row by itself.
    Ids are numbers or text of numbers. Null texts count as empty; rows with equal ids go by a hash of the text and repeated
    rows follow each other; an empty table gives an empty one; other columns are ignored. One shuffle of the texts, no group,
    no state but one row.
    """

    def marked(batches):
        held = None  # (doc_id, text, chunks) of the row that waits for its successor

        def compared(row: tuple, text: str, chunks: np.ndarray) -> tuple:
            doc_id, was, was_chunks = row
            quarter = len(was) // 4
            edited = _bytes(was[: len(was) - quarter] + text[:quarter])
            edited_chunks = chunk_set(np.frombuffer(edited, np.uint8))
            return doc_id, len(was), hashlib.sha256(edited).hexdigest(), as_text(was_chunks), as_text(edited_chunks), likeness(was_chunks, edited_chunks), likeness(was_chunks, chunks)

        for batch in slices(batches):
            out: list[tuple] = []
            for doc_id, text, copies, role in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if role and held is None:
                    continue
                chunks = chunk_set(np.frombuffer(_bytes(text), np.uint8))
                if held is not None:
                    out.append(compared(held, text, chunks))
                held = None if role else (doc_id, text, chunks)
                if held and copies > 1:
                    out += [compared(held, text, chunks)] * (copies - 1)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows = in_order(documents.withColumn("doc_id", F.col("doc_id").cast("long")))
    return rows.select("doc_id", "t", "n", "role").mapInArrow(marked, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
