"""SentencePiece encoding and decoding through a table of distinct chunks.

A model whose pieces hold the whitespace marker only at their start can't form a piece across the start of a marked
word. So a text falls apart into chunks (markers, then what follows up to the next marker), each chunk's ids don't depend
on its neighbours, and a text's ids are its chunks' ids in order. A model with a piece that crosses a marker, or that
changes texts before segmenting, is refused.

1. Texts are dealt by a hash into blocks of about BLOCK_BYTES, and each block gives its distinct chunks.
2. Dealt by a hash of the chunk, each distinct chunk of the corpus is segmented once by the sentencepiece library, for all
   blocks that hold it: the table of distinct chunks (block, chunk, ids).
3. Each block meets its part of the table, and its texts are put together from it, chunk by chunk in order of position.

What moves is the text once, and each block's distinct chunks twice, in compressed batches; a frequent chunk moves once a
block, whatever its number of places.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inflecta.llm._common import slices

MARK = "▁"
CHUNK = re.compile(" +[^ ]*")
#: Bytes of text in a block; fewer where that leaves cores without one, but not under the least.
BLOCK_BYTES, LEAST_BLOCK_BYTES = 64 << 20, 4 << 20


@lru_cache(maxsize=2)
def processor(path: str):
    """The library's processor; checks that chunks are independent under this model."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(sp.serialized_model_proto())
    spec, train = proto.normalizer_spec, proto.trainer_spec
    if len(spec.precompiled_charsmap) or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or train.treat_whitespace_as_suffix:
        raise ValueError("this model rewrites texts before it segments them")
    if any(p.type == 4 for p in proto.pieces) or any(MARK in p.piece.lstrip(MARK) for p in proto.pieces):
        raise ValueError("this model has pieces that can cross a whitespace marker")
    return sp


def chunks_of(text: str | None) -> list[str]:
    """The chunks of a text with markers as spaces; the first starts with the marker that encoding puts in front."""
    return CHUNK.findall(" " + text.replace(MARK, " ")) if text else []


def segmented(chunks: list[str], path: str) -> tuple[list[list[int]], list[str | None]]:
    """Of each chunk the ids, and what they decode to if that is another text than the chunk."""
    sp = processor(path)
    # the library puts one marker before what it encodes, which is the chunk's first; alone it is a piece by itself
    ids = [x if len(c) > 1 else [sp.piece_to_id(MARK)] for c, x in zip(chunks, sp.encode([c[1:] for c in chunks], num_threads=1), strict=True)]
    # behind another chunk the first marker is a space; decode() drops it only at the start of a text
    plain = [" " + t if c != " " else " " for c, t in zip(chunks, sp.decode(ids), strict=True)] if chunks else []
    return ids, [t if t != c else None for c, t in zip(chunks, plain, strict=True)]


Entry = tuple[str, str]


def entries(chunks: list[str], ids: list[list[int]], plain: list[str | None]) -> dict[str, Entry]:
    """Of each chunk the ids, joined by commas, and the decoded text."""
    return {c: (",".join(map(str, x)), c if p is None else p) for c, x, p in zip(chunks, ids, plain, strict=True)}


def by_hash(chunks: set[str], parts: int) -> dict[int, list[str]]:
    """The chunks in order, dealt into parts by their hash."""
    out: dict[int, list[str]] = {}
    for c in sorted(chunks):
        out.setdefault(zlib.crc32(c.encode("utf-8", "surrogatepass")) % parts, []).append(c)
    return out


def checksum(chunks: list[str]) -> int:
    return zlib.crc32("\n".join(chunks).encode("utf-8", "surrogatepass"))


def put_together(text: str | None, table: dict[str, Entry]) -> tuple[str, str]:
    """The ids of a text, joined by commas, and the decoded text, from the entries (ids, decoded) of its chunks."""
    rows = [table[c] for c in chunks_of(text)]
    return ",".join([r[0] for r in rows]), "".join([r[1] for r in rows])[1:]


def number(joined: str) -> int:
    return joined.count(",") + 1 if joined else 0


def blob(batch: pa.RecordBatch) -> bytes:
    """A batch, compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unblob(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def coded(rows: DataFrame, path: str, out: str, names: list[str], finish: Callable[[list[tuple[str, str]]], list[pa.Array]]) -> DataFrame:
    """rows (t, and other columns) with t replaced by the columns `out`, of these names, that finish makes of each (ids, decoded)."""
    spark = rows.sparkSession
    whole = rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    size = min(BLOCK_BYTES, max(LEAST_BLOCK_BYTES, whole // (2 * spark.sparkContext.defaultParallelism)))
    blocks = max(1, -(-whole // size))
    rest = [c for c in rows.columns if c != "t"]
    # rows that repeat each other go to the blocks of their partitions
    dealt = rows.select(*rest, "t", F.pmod(F.xxhash64("t") + F.spark_partition_id(), F.lit(blocks)).cast("int").alias("__b"))

    def packed(batches):
        for batch in slices(batches):
            block, batch = batch.column(batch.num_columns - 1).to_numpy(), batch.select(batch.schema.names[:-1])
            for b in np.unique(block).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob(batch.take(pa.array(np.flatnonzero(block == b))))], pa.binary())], ["b", "z"])

    def distinct(batches):
        found: dict[int, set[str]] = {}  # a partition holds one block, or a few
        for batch in batches:
            for b, z in zip(batch.column("b").to_pylist(), batch.column("z").to_pylist(), strict=True):
                for t in unblob(z).column("t").to_pylist():
                    found.setdefault(b, set()).update(chunks_of(t))
        for b, chunks in found.items():
            for h, part in by_hash(chunks, blocks).items():
                yield pa.RecordBatch.from_arrays([pa.array([h], pa.int32()), pa.array([b], pa.int32()), pa.array([blob(pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["c"]))], pa.binary())], ["h", "b", "z"])

    def table(batches):
        now, held = None, []

        def rows_of():
            lists = [unblob(z).column("c").to_pylist() for _, z in held]
            new = list(set().union(*lists))
            known = dict(zip(new, zip(*segmented(new, path), strict=True), strict=True))
            for (b, _), chunks in zip(held, lists, strict=True):
                # the block has its chunks in the same order, so the ids alone go back, with a checksum of what they belong to
                rows = pa.RecordBatch.from_arrays([pa.array([known[c][0] for c in chunks], pa.list_(pa.int32())), pa.array([known[c][1] for c in chunks], pa.string())], ["i", "p"])
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([now], pa.int32()), pa.array([checksum(chunks)], pa.int64()), pa.array([blob(rows)], pa.binary())], ["b", "h", "s", "z"])

        for batch in batches:
            for h, b, z in zip(*(batch.column(c).to_pylist() for c in ("h", "b", "z")), strict=True):
                if h != now and held:
                    yield from rows_of()
                    held = []
                now = h
                held.append((b, z))
        if held:
            yield from rows_of()

    def rebuilt(texts: pa.Table, answers: pa.Table) -> pa.Table:
        chunks: set[str] = set()
        for z in texts.column("z").to_pylist():
            for t in unblob(z).column("t").to_pylist():
                chunks.update(chunks_of(t))
        own, known = by_hash(chunks, blocks), {}
        for h, s, z in zip(*(answers.column(c).to_pylist() for c in ("h", "s", "z")), strict=True):
            part, rows = own.pop(h), unblob(z)
            if checksum(part) != s:
                raise ValueError("a block's texts have changed between two readings of them")
            known.update(entries(part, rows.column("i").to_pylist(), rows.column("p").to_pylist()))
        done = []
        for z in texts.column("z").to_pylist():
            part = unblob(z)
            made = finish([put_together(t, known) for t in part.column("t").to_pylist()])
            done.append(pa.table([*(part.column(c) for c in rest), *made], names=[*rest, *names]))
        return pa.concat_tables(done)

    schema = "".join(f"`{n}` {k}, " for n, k in rows.select(*rest).dtypes)
    texts = dealt.mapInArrow(packed, "b int, z binary").repartition(blocks, "b")
    asked = texts.mapInArrow(distinct, "h int, b int, z binary")
    answers = asked.repartition(blocks, "h").sortWithinPartitions("h", "b").mapInArrow(table, "b int, h int, s long, z binary")
    return texts.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(rebuilt, schema + out)


def encode(documents: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns, and `out`, replaced if there: the ids of each whole text. Null and empty texts: no ids.

    Columns may have any name. Repeated rows repeat, an empty table gives an empty one; the order of rows is not kept.
    """
    names = [c for c in documents.columns if c != out]
    rows = documents.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))

    def finish(made: list[tuple[str, str]]) -> list[pa.Array]:
        return [pa.array([[int(i) for i in ids.split(",") if i] for ids, _ in made], pa.list_(pa.int32()))]

    done = coded(rows, path, "ids array<int>", ["ids"], finish)
    return done.toDF(*names, out)


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; null and empty texts have no ids.

    Rows are coded one by one: repeated rows repeat, an empty table gives an empty one, other columns are ignored.
    """

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def finish(made: list[tuple[str, str]]) -> list[pa.Array]:
        return [pa.array([number(ids) for ids, _ in made], pa.int64()), pa.array([digest(ids) for ids, _ in made], pa.string()), pa.array([digest(plain) for _, plain in made], pa.string())]

    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return coded(rows, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", ["n_tokens", "ids_sha256", "decoded_sha256"], finish)
