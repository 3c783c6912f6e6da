"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are dealt into shards of about SHARD length units by a hash, so that a shard is packed in one task at any size of
the corpus; longer documents than the greatest capacity are cut into pieces. In a shard pieces go by descending length
into the open bin that they leave least room in. If no bin has room, one is opened of the capacity whose cost per unit of
content is least, where cost(c) = c + OVERHEAD (what a sequence costs besides its units) and the content counted on is
the piece and as much of the smaller pieces still to come as the bin could hold. At last every bin is brought down to the
least capacity that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inflecta.llm._common import row_key

CAPACITIES = (2_048, 4_096, 8_192, 16_384, 32_768)
OVERHEAD = 64
SHARD = 1 << 24


def packed(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each piece and the capacity of each bin; sizes descend, and none is over the greatest capacity."""
    n = len(sizes)
    ascending = sizes[::-1]
    mass = np.concatenate([[0], np.cumsum(ascending)]).tolist() if n else [0]
    rooms: list[tuple[int, int]] = []  # (room, bin) of open bins, ascending
    opened: list[int] = []
    used: list[int] = []
    bins, offsets = [], []
    for i, size in enumerate(sizes):
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            best = None
            for c in capacities:
                if c >= size:
                    # pieces still to come that the rest could hold: the smallest n - i - 1 of all, up to that size
                    left = mass[min(n - i - 1, bisect_left(ascending, c - size + 1))]
                    cost = (c + overhead) / (size + min(c - size, left))
                    if best is None or cost < best[0]:
                        best = (cost, c)
            room, b = best[1], len(opened)
            opened.append(best[1])
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        if room > size:
            insort(rooms, (room - size, b))
    return bins, offsets, [next(c for c in capacities if c >= u) for u in used]


def pieces(length: int, greatest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; an empty one has none."""
    return [(s, min(greatest, length - s)) for s in range(0, length, greatest)]


def pack(documents: DataFrame, length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, shard: int = SHARD) -> DataFrame:
    """doc_id, piece, start, length, bin_id, bin_offset and bin_capacity: one row per piece of every document.

    Ids are numbers, or text of numbers. length defaults to the bytes of text (the tokens of a byte-level model). Documents of no length (null and empty texts)
    have one row of piece 0 and length 0 without a bin. Ties in length go by doc_id (nulls first) and a hash of the text;
    repeated rows are packed one by one. An empty table gives an empty one; other columns are ignored.
    """
    capacities = tuple(sorted(set(capacities)))
    length = F.octet_length("text") if length is None else length
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("k"), F.coalesce(length, F.lit(0)).cast("long").alias("n"))
    shards = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // shard))
    dealt = rows.withColumn("s", F.pmod(F.xxhash64("k", "n"), F.lit(shards)).cast("long")).repartition(shards, "s").sortWithinPartitions("s", F.desc("n"), "doc_id", "k")
    names = ["doc_id", "piece", "start", "length", "bin_id", "bin_offset", "bin_capacity"]

    def run(shard_no: int, ids: list, lengths: list[int]):
        cut = [(n, j, d, s) for d, total in zip(ids, lengths, strict=True) for j, (s, n) in enumerate(pieces(total, capacities[-1]))]
        cut.sort(key=lambda x: -x[0])  # stable: else in the order of the rows
        bins, offsets, sizes = packed([x[0] for x in cut], capacities, overhead)
        empty = [d for d, total in zip(ids, lengths, strict=True) if not total]
        m = len(empty)
        columns = [
            [x[2] for x in cut] + empty, [x[1] for x in cut] + [0] * m, [x[3] for x in cut] + [0] * m, [x[0] for x in cut] + [0] * m,
            [(shard_no << 32) + b for b in bins] + [None] * m, offsets + [None] * m, [sizes[b] for b in bins] + [None] * m,
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

    def scan(batches):
        now, ids, lengths = None, [], []
        for b in batches:
            for s, d, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s != now and now is not None:
                    yield run(now, ids, lengths)
                    ids, lengths = [], []
                now = s
                ids.append(d)
                lengths.append(n)
        if now is not None:
            yield run(now, ids, lengths)

    return dealt.select("s", "doc_id", "n").mapInArrow(scan, "doc_id long, piece int, start long, length long, bin_id long, bin_offset long, bin_capacity long")
