"""Helpers shared by the operators: Arrow views, folds, shared tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inflecta.sources.shared import shared_dir, written

__all__ = ["GEAR", "fold", "mix", "prefix_sums", "row_key", "shared_dir", "slices", "span_hash", "table", "utf8", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that a Python worker works on at once (it holds several copies of what it works on).
BATCH_BYTES = 8 << 20


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about BATCH_BYTES, a row at least, however large the session's batches are."""
    for b in batches:
        rows = max(1, b.num_rows * BATCH_BYTES // max(b.nbytes, BATCH_BYTES))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as fold 0, which is never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0))


def row_key(doc_id: Column, text: Column) -> Column:
    """Identity of a row for joins back: equal id and equal text are the same document, nulls included."""
    return F.xxhash64(doc_id, text)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its len+1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) or pa.types.is_string(column.type) else b"")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


# --- rolling hashes over bytes, all vectorised, arithmetic modulo 2**64 ---

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        step = np.full(max(n, 2 * len(have), 1 << 14), _BASE if kind == "up" else _INVERSE, np.uint64)
        step[0] = 1
        have = _powers[kind] = np.multiply.accumulate(step)
    return have[:n]


#: Fixed pseudo-random value of each byte.
GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (multiply and shift)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_sums(data: np.ndarray, values: np.ndarray = GEAR) -> np.ndarray:
    """S with S[i] = sum of values[data[j]] * B**j for j < i: the hash of any span follows by span_hash."""
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * _power("up", len(data)), out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes in [start, end), independent of where they lie; the length is mixed in."""
    h = (s[end] - s[start]) * _power("down", len(s))[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
