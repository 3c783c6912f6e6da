"""Language identification by prediction by partial matching (PPM).

Each language has frozen byte statistics in a context tree of variable order: the contexts (up to ORDER bytes) that its
training text shows. The code length of a byte after a context is

    -log2(count / (total + distinct))                     if the context has seen the byte,
    -log2(distinct / (total + distinct)) + next shorter   otherwise (an escape); after the empty context: 8 bits,

and a context that a language has never seen costs nothing to leave. A text's code length under a language is the exact
sum over all its bytes; the language with the shortest code is the answer. As the statistics are frozen, every
(context, byte) length is worked out once; the contexts of a language form an automaton, so that a text is scored by
ORDER + 1 table look-ups per byte and language. Each language has up to MAX_CONTEXTS contexts of its own, however many
languages there are, as long as all tables stay within MODEL_BYTES (about 20 languages); beyond that each has fewer.

Fitting learns every labelled language from a bounded sample: at most SAMPLE documents each, lowest hash of doc_id first, of
each its middle FIT_BYTES bytes; fewer documents each, but one at least, where all samples would exceed FIT_TOTAL bytes.
Rows that repeat an id and language are one document: one of its texts is taken.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inflecta.llm._common import fold, slices

ORDER = 3
SAMPLE = 400
FIT_BYTES = 65_536
FIT_TOTAL = 128 << 20
#: Contexts of each language, and bytes of all languages' tables.
MAX_CONTEXTS = 16_000
MODEL_BYTES = 256 << 20
UNKNOWN = "und"
#: Bits a byte above which no learned language explains a text (a byte costs 8 if nothing is known of it).
REJECT_BITS = 7.0
#: Texts of fewer bytes than this are too short to be rejected by their rate.
REJECT_BYTES = 64
BLOCK = 1 << 20
LETTER_OR_NUMBER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether some character is a letter by its Unicode category; signs such as ½ are not."""
    return bool(text) and any(m[0].isalpha() for m in LETTER_OR_NUMBER.finditer(text))


@dataclass
class Tree:
    """symbol: class of a byte (0: never seen). step[context * width + symbol]: next context * width; bits likewise."""

    symbol: np.ndarray
    step: np.ndarray
    bits: np.ndarray


@dataclass
class ContextTrees:
    languages: list[str]
    trees: list[Tree]
    order: int

    def code_lengths(self, data: bytes) -> np.ndarray:
        """Exact bits of the whole data under each language; long data goes in blocks that keep their context."""
        total = np.zeros(len(self.languages))
        k = self.order
        raw = np.frombuffer(data, np.uint8)
        for at in range(0, len(raw), BLOCK):
            lead = min(at, k)
            part = raw[at - lead : at + BLOCK]
            n = len(part) - lead
            padded = np.zeros(k + n, np.int32)
            for i, tree in enumerate(self.trees):
                padded[k - lead :] = tree.symbol[part]
                cell = padded[:n]  # of the empty context
                for lag in range(1, k + 1):
                    cell = tree.step[cell] + padded[lag : lag + n]
                total[i] += tree.bits[cell].sum(dtype=np.float64)
        return total


def grams(symbols: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams that hold no symbol 0, and the positions where they start."""
    size = len(symbols) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, whole = np.zeros(size, np.int64), np.ones(size, bool)
    for i in range(n):
        part = symbols[i : i + size]
        code = code * width + part
        whole &= part > 0
    at = np.flatnonzero(whole)
    return code[at], at


def trained(texts: dict[str, list[bytes]], order: int = ORDER, max_contexts: int = MAX_CONTEXTS, model_bytes: int = MODEL_BYTES) -> ContextTrees:
    """Context trees from each language's texts; contexts seen once in all are left out, and a language's rarer ones beyond
    max_contexts or its share of model_bytes (8 bytes for each symbol after each context)."""
    languages = sorted(texts)
    counted = []
    for lang in languages:
        s, _, letters = _symbols(texts[lang], order)
        found = [np.unique(grams(s, n, len(letters))[0], return_counts=True) for n in range(1, order + 1)]
        counted.append([(codes, _bytes_code(codes, n, letters), c) for n, (codes, c) in enumerate(found, 1)])
    often = []
    for n in range(order):
        codes, at = np.unique(np.concatenate([c[n][1] for c in counted] or [np.zeros(0, np.int64)]), return_inverse=True)
        often.append(codes[np.bincount(at, np.concatenate([c[n][2] for c in counted] or [np.zeros(0)]), len(codes)) >= 2])
    trees = []
    for lang, own in zip(languages, counted, strict=True):
        kept = [(codes[use], c[use]) for (codes, plain, c), shown in zip(own, often, strict=True) for use in [np.isin(plain, shown)]]
        width = int((np.bincount(np.frombuffer(b"\x00".join(texts[lang]), np.uint8), minlength=256)[1:] > 0).sum()) + 1
        least, most = 1, max(1, min(max_contexts, model_bytes // len(languages) // (8 * width)))
        while sum(int((c >= least).sum()) for _, c in kept) > most:
            least *= 2
        trees.append(_tree(texts[lang], order, [np.zeros(1, np.int64), *(codes[c >= least] for codes, c in kept)]))
    return ContextTrees(languages, trees, order)


def _symbols(parts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as symbols, the symbol of each byte, and the byte of each symbol."""
    raw = np.frombuffer(b"\x00".join(parts), np.uint8)
    seen = np.bincount(raw, minlength=256) > 0
    seen[0] = False  # parts the documents
    symbol = np.zeros(256, np.int32)
    symbol[seen] = 1 + np.arange(seen.sum())
    return np.concatenate([np.zeros(order, np.int32), symbol[raw]]), symbol, np.concatenate([[0], np.flatnonzero(seen)])


def _bytes_code(codes: np.ndarray, n: int, letters: np.ndarray) -> np.ndarray:
    """Codes of n-grams by bytes, which are the same for all languages, from those by symbols."""
    out, width = np.zeros(len(codes), np.int64), len(letters)
    for i in range(n):
        out += letters[codes // width**i % width] << (8 * i)
    return out


def _tree(parts: list[bytes], order: int, levels: list[np.ndarray]) -> Tree:
    """One language's automaton over the contexts of each length, and the bits of each byte after each of them."""
    s, symbol, letters = _symbols(parts, order)
    width = len(letters)
    starts = np.cumsum([0, *(len(x) for x in levels)])
    nodes = int(starts[-1])

    step = np.zeros((nodes, width), np.int32)
    shorter = np.zeros(nodes, np.int32)
    for n, codes in enumerate(levels):
        own = slice(starts[n], starts[n + 1])
        if n:
            # dropping the oldest byte of a context leaves a context that is at least as common
            shorter[own] = starts[n - 1] + np.searchsorted(levels[n - 1], codes % width ** (n - 1)) if n > 1 else 0
            step[own] = step[shorter[own]]
        if n < order:
            child = levels[n + 1]
            parent = starts[n] + np.searchsorted(codes, child // width)
            step[parent, child % width] = starts[n + 1] + np.arange(len(child))

    size = len(s) - order
    state = np.zeros(size, np.int32)
    for lag in range(order):
        state = step[state, s[lag : lag + size]]
    target = s[order:]
    count = np.zeros((nodes, width))
    # every suffix of the longest context counts the byte as well
    while True:
        use = target > 0
        np.add.at(count, (state[use], target[use]), 1)
        on = state > 0
        if not on.any():
            break
        state, target = shorter[state[on]], target[on]
    total, distinct = count.sum(1), (count > 0).sum(1)
    known = total > 0
    hit = np.zeros((nodes, width))
    hit[known] = -np.log2(np.maximum(count[known], 1) / (total + distinct)[known, None])
    escape = np.zeros(nodes)
    escape[known] = -np.log2(distinct[known] / (total + distinct)[known])
    bits = np.zeros((nodes, width), np.float32)
    for n in range(len(levels)):
        own = slice(starts[n], starts[n + 1])
        below = bits[shorter[own]] if n else np.full((1, width), 8.0)
        bits[own] = np.where(count[own] > 0, hit[own], escape[own, None] + below)
    return Tree(symbol, (step * width).astype(np.int32).reshape(-1), bits.reshape(-1))


def prepared(text: str) -> bytes:
    """What is coded: the lower-cased text in UTF-8, so that capitals don't hide a language."""
    return text.lower().encode("utf-8", "replace")


def fit(documents: DataFrame, sample: int = SAMPLE, max_contexts: int = MAX_CONTEXTS, model_bytes: int = MODEL_BYTES) -> ContextTrees:
    """Learns from text and non-null lang of documents outside fold 0; of a long document, from a slice in its middle."""
    rows = documents.select(F.col("doc_id").alias("k"), F.col("lang").alias("g"), F.octet_length("text").alias("n")).where(F.col("k").isNotNull() & F.col("g").isNotNull() & (fold(F.col("k")) != 0) & (F.col("n") > 0))
    rows = rows.withColumn("u", F.xxhash64("k") / float(1 << 64) + 0.5)  # uniform in [0, 1)
    counts = rows.groupBy("g").agg(F.approx_count_distinct("k").alias("c"), F.avg(F.least("n", F.lit(FIT_BYTES))).alias("mean"))
    # s: documents of each language, of which all languages together hold about FIT_TOTAL bytes at most
    counts = counts.select("g", "c", F.greatest(F.lit(1), F.least(F.lit(sample), F.floor(FIT_TOTAL / max(1, counts.count()) / F.col("mean")))).alias("s"))
    # about twice s ids of each language by hash, however many it has; only those are ordered, each once
    few = rows.join(F.broadcast(counts), "g").where(F.col("u") < 2.0 * F.col("s") / F.col("c") + 100.0 / F.col("c")).groupBy("g", "k").agg(F.min("u").alias("u"), F.first("s").alias("s"))
    order = Window.partitionBy("g").orderBy("u", "k")
    picked = few.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("s")).select("k", "g")
    size = F.octet_length("text")
    piece = F.substring(F.col("text").cast("binary"), F.when(size > FIT_BYTES, F.floor((size - FIT_BYTES) / 2) + 1).otherwise(1).cast("int"), F.lit(FIT_BYTES))
    each = documents.where(size > 0).select(F.col("doc_id").alias("k"), F.col("lang").alias("g"), piece.alias("t")).join(F.broadcast(picked), ["k", "g"])
    got = each.groupBy("k", "g").agg(F.min("t").alias("t")).toPandas().sort_values(["k", "t"])
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(got["g"], got["t"], strict=True):
        texts.setdefault(lang, []).append(prepared(bytes(text).decode("utf-8", "ignore")))  # a character that the slice cuts is left out
    return trained(texts, max_contexts=max_contexts, model_bytes=model_bytes)


def predict(documents: DataFrame, trees: ContextTrees) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte of every row.

    lang_pred is `und` (score 0) if the text is null, holds no letter, or nothing was learned. score is the share of the
    best language in the sum of 2**-bits over languages; equal code lengths go to the language that sorts first.
    Rows are judged one by one: repeated rows repeat, an empty table gives an empty one, other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(trees)

    def predicted(batches):
        model = shared.value
        for b in slices(batches):
            langs, scores, rates = [], [], []
            for text in b.column(2).to_pylist():
                if not model.languages or not has_letter(text):
                    langs.append(UNKNOWN), scores.append(0.0), rates.append(8.0)
                    continue
                data = prepared(text)
                lengths = model.code_lengths(data)
                best = int(lengths.argmin())
                langs.append(model.languages[best])
                scores.append(float(1 / np.exp2(-np.minimum(lengths - lengths[best], 1000)).sum()))
                rates.append(float(lengths[best] / len(data)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    id_type = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text").alias("t")).mapInArrow(predicted, f"doc_id {id_type}, held_out boolean, lang_pred string, score double, bits_per_byte double")


def kept(documents: DataFrame, trees: ContextTrees, reject_bits: float = REJECT_BITS) -> DataFrame:
    """The rows, all columns as they are, whose text some learned language explains.

    Rejected are texts without a letter (nulls too), and texts of REJECT_BYTES or more that cost over reject_bits a byte
    under every language. If nothing was learned, only the former are.
    """
    shared = documents.sparkSession.sparkContext.broadcast(trees)
    at = documents.columns.index("text")

    def accepted(batches):
        model = shared.value
        for b in slices(batches):
            keep = []
            for text in b.column(at).to_pylist():
                good = has_letter(text)
                if good and model.languages:
                    data = prepared(text)
                    good = len(data) < REJECT_BYTES or model.code_lengths(data).min() <= reject_bits * len(data)
                keep.append(good)
            yield b.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(accepted, documents.schema)
