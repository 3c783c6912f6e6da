"""Exact removal of long repeated byte strings by suffix sorting and a common-prefix interval tree.

A byte is removed if it lies in a string of LENGTH bytes that also starts anywhere else. Sorting every suffix of the
corpus would move LENGTH times its size, so suffixes are sorted only where they can matter:

1. Anchors. A hash of every GRAM bytes is taken; the least of each LENGTH - GRAM + 1 neighbours are anchors. Every string
   of LENGTH bytes holds an anchor, at the same place wherever the string occurs (about one anchor in 80 bytes).
2. Only anchors whose hash occurs again (a count with map-side combine) go on. Around an anchor, only the LENGTH bytes
   from it and the LENGTH - GRAM before it can share a string with it. A hash of these surroundings finds the anchors
   whose surroundings are identical elsewhere: they are covered whole, and one of them stands for all from here on, so
   thousands of copies are one row.
3. Suffix array. Of each anchor that has several distinct surroundings, the suffixes are sorted by Spark (the sort of a
   shuffle, which spills), giving for each hash a part of the corpus's suffix array in order. The common prefixes of
   neighbours enhance it; a stack scan over them yields the interval tree, each interval being all suffixes that share a
   prefix of that many bytes.
4. Left extension. In each interval the members are ordered by what precedes them (backwards), and neighbours in that order
   give the longest common left extension that a member has with any other. A member whose common prefix and left
   extension together reach LENGTH is covered from the one end to the other.

`maximal_repeats` gives the repeats themselves, as groups with all their occurrences: a second stack scan in each interval,
over the left extensions, finds the sets of members that extend alike, up to where they differ (`repeats`).

However frequent a hash is, no group of suffixes that goes into a tree has more than GROUP rows: a larger one is the top of
the tree, and is walked down by Spark. What all its members share around the anchor follows from the least and the greatest
of them; if that reaches LENGTH, they are covered so far at once. What is left are windows that go further to the left or to
the right. Windows that begin a to z bytes before an anchor all hold what lies from a bytes before it to LENGTH - z behind,
so for them the group falls apart by the hash of just that: two suffixes that share a window meet again in its part. Parts
that are still large are walked down in turn, each time over at most half of the windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inflecta.llm._common import prefix_sums, row_key, slices, span_hash, utf8, written

LENGTH = 200
GRAM = 40
#: Rows of a group that is put into one tree: about 160 MB in a worker.
GROUP = 100_000
#: What a worker holds at once: bytes of a text, surroundings cut out, suffixes of the tree, and members of intervals.
BLOCK = 1 << 18
CUT_ROWS = 16_384
CHUNK_ROWS = 20_000
MEMBERS = 500_000
#: Rows that are laid out or compared at once, where that takes a few times their bytes.
STRIP = 4_096


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """best over every `width` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        values = best(values[:-span], values[span:])
        span *= 2
    return best(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash of the gram, hash of the surroundings) of the anchors of one document; long ones go in blocks."""
    n, width, reach = len(data), length - gram + 1, length - gram
    found = []
    for at in range(0, n if n >= length else 0, BLOCK):
        low, high = max(0, at - 2 * length), min(n, at + BLOCK + 2 * length)
        part = data[low:high]
        if len(part) < length:
            continue
        s = prefix_sums(part)
        starts = np.arange(len(part) - gram + 1)
        h = span_hash(s, starts, starts + gram)
        rank = (h >> np.uint64(32)).astype(np.uint32)
        least = _slide(rank, width, np.minimum)
        pad = np.zeros(width - 1, np.uint32)
        chosen = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), width, np.maximum) == rank)
        chosen = chosen[(chosen + low >= at) & (chosen + low < at + BLOCK)]
        left, right = np.maximum(chosen - reach, 0), np.minimum(chosen + length, len(part))
        around = span_hash(s, left, right) ^ ((chosen - left).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        found.append((chosen + low, h[chosen], around))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def own_anchor(text: bytes, at: int, length: int, gram: int) -> bool:
    """Whether a string makes the gram at a place an anchor by itself, wherever it stands: by a window inside it."""
    data = np.frombuffer(text, np.uint8)
    width = length - gram + 1
    starts = np.arange(len(data) - gram + 1)
    rank = (span_hash(prefix_sums(data), starts, starts + gram) >> np.uint64(32)).astype(np.uint32)
    if len(rank) < width:
        return False
    least = _slide(rank, width, np.minimum)
    return bool((least[max(0, at - width + 1) : at + 1] == rank[at]).any())


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def anchor_table(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, s, d, k, p) of every anchor of rows (d, k, t)."""

    def scan(batches):
        for b in slices(batches):
            data, ends = utf8(b.column(2))
            found, owner = [], []
            for i in range(b.num_rows):
                if ends[i + 1] - ends[i] >= length:
                    p, h, s = anchors(data[ends[i] : ends[i + 1]], length, gram)
                    found.append((h, s, p))
                    owner.append(np.full(len(p), i))
            if found:
                h, s, p = (np.concatenate(x) for x in zip(*found, strict=True))
                at = pa.array(np.concatenate(owner))
                yield pa.RecordBatch.from_arrays([_signed(h), _signed(s), b.column(0).take(at), b.column(1).take(at), pa.array(p, pa.int64())], ["h", "s", "d", "k", "p"])

    return rows.mapInArrow(scan, "h long, s long, d long, k long, p long")


# --- the enhanced suffix array of a run of groups ---


def padded(parts: list[bytes] | pa.Array | pa.ChunkedArray, width: int, more: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `width` bytes, zero behind each part, and `more` zeros at their ends; and the parts' lengths."""
    data, ends = utf8(pa.array(parts, pa.binary()) if isinstance(parts, list) else parts)
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), width + more), np.uint8)
    for at in range(0, len(sizes), STRIP):
        some = sizes[at : at + STRIP]
        out[at : at + STRIP, :width][np.arange(width) < some[:, None]] = data[ends[at] : ends[at + len(some)]]
    return out, sizes


def neighbours_common(rows: np.ndarray, lengths: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """c[i]: common prefix of rows i-1 and i, taken in this order; c[0] = 0."""
    n, width = rows.shape
    order = np.arange(n) if order is None else order
    common = np.zeros(n, np.int64)
    for at in range(1, n, STRIP):
        upto = min(n, at + STRIP)
        some, sizes = rows[order[at - 1 : upto]], lengths[order[at - 1 : upto]]
        differs = some[1:] != some[:-1]
        first = np.where(differs.any(1), differs.argmax(1), width)
        common[at:upto] = np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))
    return common


def intervals(common: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Stack scan: (prefix length, first, last) of every interval of the common-prefix tree; -1 parts groups."""
    depth, low, high, stack = [], [], [], []
    for i, c in enumerate([*common[1:], -1]):
        start = i
        while stack and stack[-1][0] > c:
            d, start = stack.pop()
            depth.append(d), low.append(start), high.append(i)
        if c >= 0 and (not stack or stack[-1][0] < c):
            stack.append((c, start))
    return depth, low, high


@dataclass
class Tree:
    """The interval tree of suffixes in order of (group, right), and their order by what stands before them.

    Interval i holds suffixes low[i] to high[i], which share a prefix of depth[i] bytes (and no more). rank: place of each
    suffix in the order of the left sides, read backwards.
    """

    depth: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rank: np.ndarray
    least: list[np.ndarray]  # common left extension of neighbours by rank: its least over runs of 1, 2, 4 ... of them

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common left extension of the suffixes at ranks a < b."""
        level = np.log2(b - a).astype(np.int64)
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            on = level == k
            out[on] = np.minimum(self.least[k][a[on] + 1], self.least[k][b[on] - 2**k + 1])
        return out

    def members(self, most: int = MEMBERS):
        """(interval, suffix) of the members of some intervals at a time, each interval's in order of rank; about `most`."""
        counts = self.high - self.low + 1
        ends = np.cumsum(counts)
        at = 0
        while at < len(counts):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            size = counts[at:upto]
            node = np.repeat(np.arange(at, upto), size)
            member = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.low[at:upto], size)
            by = np.lexsort((self.rank[member], node))
            yield node[by], member[by]
            at = upto


def tree(groups: np.ndarray, left: list[bytes] | pa.ChunkedArray, right: list[bytes] | pa.ChunkedArray, length: int, gram: int) -> Tree:
    """left holds the bytes before an anchor, backwards, right those from it on; shorter intervals than `gram` are left out."""
    n, reach = len(groups), length - gram
    common = neighbours_common(*padded(right, length))
    common[1:][groups[1:] != groups[:-1]] = -1
    depth, low, high = (np.array(x, np.int64) for x in intervals(common.tolist()))
    use = depth >= gram
    back, back_sizes = padded(left, reach, 2)
    back[:, reach:] = back_sizes.astype(">u2").view(np.uint8).reshape(n, 2)
    order = np.argsort(back.view(f"V{reach + 2}").ravel(), kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    least = [neighbours_common(back[:, :reach], back_sizes, order)]
    while 2 ** len(least) <= n:
        half = 2 ** (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    return Tree(depth[use], low[use], high[use], rank, least)


def covers(groups: np.ndarray, left: list[bytes] | pa.ChunkedArray, right: list[bytes] | pa.ChunkedArray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in order of (group, right): how far each is covered to the left and right of its anchor; 0, 0 if not."""
    t = tree(groups, left, right, length, gram)
    to_left, to_right = np.full(len(groups), -1, np.int64), np.zeros(len(groups), np.int64)
    for node, member in t.members():
        same = np.flatnonzero(node[1:] == node[:-1])
        ext = t.extension(t.rank[member[same]], t.rank[member[same + 1]])
        # neighbours by what stands before them give the longest left extension that a member has with any other
        best = np.full(len(member), -1, np.int64)
        np.maximum.at(best, same, ext)
        np.maximum.at(best, same + 1, ext)
        hit = np.flatnonzero(best + t.depth[node] >= length)
        np.maximum.at(to_left, member[hit], best[hit])
        np.maximum.at(to_right, member[hit], t.depth[node[hit]])
    to_left[to_right == 0] = 0
    return to_left, to_right


def repeats(groups: np.ndarray, left: list[bytes], right: list[bytes], length: int, gram: int) -> list[tuple[int, int, list[int]]]:
    """Maximal repeats of at least `length` bytes: (bytes before the anchor, bytes from it on, all suffixes that have them).

    The members of an interval share just its depth to the right; a second stack scan, over their left extensions, gives the
    sets that share one. Such a set can't be extended to the left: its members differ there, or one ends. It is reported
    where it can't be extended to the right either, that is, unless all of it lies in one deeper interval.
    """
    t = tree(groups, left, right, length, gram)
    rows, sizes = padded(right, length)
    common = neighbours_common(rows, sizes)
    found = []
    for node, member in t.members():
        cuts = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            own, depth = member[begin:end], int(t.depth[node[begin]])
            ext = t.extension(t.rank[own[:-1]], t.rank[own[1:]])
            if ext.max() + depth < length:
                continue
            for e, low, high in zip(*intervals([0, *ext.tolist()]), strict=True):
                some = np.sort(own[low : high + 1])
                if e + depth >= length and common[some[0] + 1 : some[-1] + 1].min() == depth:
                    found.append((e, depth, some.tolist()))
    return found


def snippets(rows: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, d, k, p, l, r): the bytes before, backwards, and from the wanted anchors (h, d, k, p)."""

    kinds = [*[pa.int64()] * 4, pa.binary(), pa.binary()]

    def batch(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["h", "d", "k", "p", "l", "r"])

    def cut(batches):
        seen = set()  # of rows that repeat each other one will do
        for b in slices(batches):
            data, ends = utf8(b.column(2))
            out: list[list] = [[] for _ in kinds]
            for i, (d, k, places) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if (d, k) in seen:
                    continue
                seen.add((d, k))
                x = data[ends[i] : ends[i + 1]].tobytes()
                for place in places:
                    p = place["p"]
                    for column, value in zip(out, (place["h"], d, k, p, x[max(0, p - (length - gram)) : p][::-1], x[p : p + length]), strict=True):
                        column.append(value)
                    if len(out[0]) >= CUT_ROWS:
                        yield batch(out)
                        out = [[] for _ in kinds]
            if out[0]:
                yield batch(out)

    asked = wanted.groupBy("d", "k").agg(F.collect_list(F.struct("h", "p")).alias("places")).select(F.col("d").alias("d2"), F.col("k").alias("k2"), "places")
    joined = rows.join(asked, F.col("d").eqNullSafe(F.col("d2")) & (F.col("k") == F.col("k2")), "left").where("places is not null")
    return joined.select("d", "k", "t", "places").mapInArrow(cut, "h long, d long, k long, p long, l binary, r binary")


def by_group(parts: DataFrame, run: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """run over whole groups g of parts (g, d, k, p, l, r), the suffixes r of each in order; groups meet about CHUNK_ROWS at
    a time."""

    def scan(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for b in slices(batches):
            held.append(b)
            size += b.num_rows
            if size >= CHUNK_ROWS:
                table = pa.Table.from_batches(held)
                g = table.column("g").to_numpy()
                end = int(np.searchsorted(g, g[-1]))  # the last group may go on in the next batch
                if end:
                    yield run(table.slice(0, end))
                    held = table.slice(end).combine_chunks().to_batches()
                    size -= end
        if size:
            yield run(pa.Table.from_batches(held))

    return parts.repartition("g").sortWithinPartitions("g", "r").select("g", "d", "k", "p", "l", "r").mapInArrow(scan, schema)


def tree_cover(parts: DataFrame, length: int, gram: int) -> DataFrame:
    """(d, k, s, e): spans covered according to the interval tree of the suffixes of each group g."""

    def run(table: pa.Table) -> pa.RecordBatch:
        a, z = covers(table.column("g").to_numpy(), table.column("l"), table.column("r"), length, gram)
        on = np.flatnonzero(z)
        p, take = table.column("p").to_numpy()[on], pa.array(on)
        flat = lambda c: table.column(c).combine_chunks().take(take)
        return pa.RecordBatch.from_arrays([flat("d"), flat("k"), pa.array(p - a[on]), pa.array(p + z[on])], ["d", "k", "s", "e"])

    return by_group(parts, run, "d long, k long, s long, e long")


def tree_repeats(parts: DataFrame, length: int, gram: int) -> DataFrame:
    """(repeat, e, n_bytes, d, k, p): the maximal repeats of each group g, with the anchors whose surroundings hold them.

    Only strings count that have the anchor by themselves: it stands at all their places, so the group has them all.
    """

    def run(table: pa.Table) -> pa.RecordBatch:
        left, right = table.column("l").to_pylist(), table.column("r").to_pylist()
        out, at = [], []
        for e, depth, some in repeats(table.column("g").to_numpy(), left, right, length, gram):
            text = left[some[0]][:e][::-1] + right[some[0]][:depth]
            if own_anchor(text, e, length, gram):
                # the string itself names the group, whichever anchor finds it
                out += [(hashlib.sha256(text).hexdigest(), e, e + depth)] * len(some)
                at += some
        columns = [pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))]
        take = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([*columns, *(table.column(c).combine_chunks().take(take) for c in ("d", "k", "p"))], ["repeat", "e", "n_bytes", "d", "k", "p"])

    return by_group(parts, run, "repeat string, e long, n_bytes long, d long, k long, p long")


def whole_repeats(parts: DataFrame, length: int, gram: int) -> DataFrame:
    """The same of parts (l, r, d, k, p) that are each a repeat as a whole."""

    def scan(batches):
        for b in slices(batches):
            rows = [(i, left[::-1] + right, len(left)) for i, (left, right) in enumerate(zip(b.column("l").to_pylist(), b.column("r").to_pylist(), strict=True))]
            rows = [r for r in rows if len(r[1]) >= length and own_anchor(r[1], r[2], length, gram)]
            take = pa.array([r[0] for r in rows], pa.int64())
            columns = [pa.array([hashlib.sha256(r[1]).hexdigest() for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *(b.column(c).take(take) for c in ("d", "k", "p"))], ["repeat", "e", "n_bytes", "d", "k", "p"])

    return parts.mapInArrow(scan, "repeat string, e long, n_bytes long, d long, k long, p long")


def parted(parts: DataFrame, ranges: Column, length: int) -> DataFrame:
    """parts (g, d, k, p, l, r) in groups of the windows of each of its ranges (structs a, z: windows that begin a to z bytes
    before the anchor): (g, a, z, d, k, p, l, r), without the members that are too short for any such window."""
    each = parts.withColumn("range", F.explode(ranges)).select("g", "range.a", "range.z", "d", "k", "p", "l", "r")
    each = each.where((F.octet_length("l") >= F.col("a")) & (F.octet_length("r") >= length - F.col("z")))
    shared = F.concat(F.expr("substring(l, 1, a)"), F.expr(f"substring(r, 1, {length} - z)"))
    return each.withColumn("g", F.xxhash64("g", "a", "z", shared))


def common_to_all(parts: DataFrame) -> DataFrame:
    """(g, n, e, f) of each group of several of parts (g, l, r): its size, and how many bytes before the anchor and from it
    on all members share."""

    def shared(batches):
        def lcp(x: bytes, y: bytes) -> int:
            n = min(len(x), len(y))
            differs = np.flatnonzero(np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n))
            return int(differs[0]) if len(differs) else n

        for b in slices(batches):
            sides = [[lcp(x, y) for x, y in zip(b.column(i).to_pylist(), b.column(i + 1).to_pylist(), strict=True)] for i in (2, 4)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int32()) for x in sides)], ["g", "n", "e", "f"])

    # what the least and the greatest share, all share
    ends = parts.groupBy("g").agg(F.count("*").alias("n"), F.min("l"), F.max("l"), F.min("r"), F.max("r")).where("n > 1")
    return ends.mapInArrow(shared, "g long, n long, e int, f int")


def split(parts: DataFrame, length: int, gram: int, group: int) -> tuple[DataFrame, DataFrame]:
    """Parts (h, d, k, p, l, r) of hashes that are too frequent for one tree: groups (g, d, k, p, l, r) that are small enough,
    and (d, k, p, l, r) with l and r cut to what all members of a larger group share, where that is of `length` at least."""
    level = parts.select(F.col("h").alias("g"), F.lit(0).alias("a"), F.lit(length - gram).alias("z"), "d", "k", "p", "l", "r")
    small = whole = None
    while True:
        # written down, so that the join is one of plain tables, whose hot groups Spark can split
        level = written(level, "suffix-level")
        groups = written(common_to_all(level), "suffix-groups")
        sized = level.join(groups, "g")
        one, large = sized.where(F.col("n") <= group).select("g", "d", "k", "p", "l", "r"), sized.where(F.col("n") > group)
        reaches = F.col("e") + F.col("f") >= length
        two = large.where(reaches).select("d", "k", "p", F.expr("substring(l, 1, e)").alias("l"), F.expr("substring(r, 1, f)").alias("r"))
        small, whole = (one, two) if small is None else (small.union(one), whole.union(two))
        if not groups.where(F.col("n") > group).limit(1).count():
            return small, whole
        # windows that go on beyond what is shared: to the right of it, and to the left; else all
        middle = F.floor((F.col("a") + F.col("z")) / 2).cast("int")
        span = lambda a, z: F.struct(a.cast("int").alias("a"), z.cast("int").alias("z"))
        beyond = F.array(span(F.col("a"), F.least("z", length - 1 - F.col("f"))), span(F.greatest("a", F.col("e") + 1), F.col("z")))
        halves = F.array(span(F.col("a"), middle), span(middle + 1, F.col("z")))
        cut = lambda x: F.when(x["z"] - x["a"] > 8, F.array(span(x["a"], F.floor((x["a"] + x["z"]) / 2)), span(F.floor((x["a"] + x["z"]) / 2) + 1, x["z"]))).otherwise(F.array(x))
        ranges = F.when(reaches, F.flatten(F.transform(beyond, cut))).otherwise(halves)
        level = parted(large, F.filter(ranges, lambda x: x["a"] <= x["z"]), length)


def keyed(documents: DataFrame) -> DataFrame:
    """(d, k, t): id, key and text of every row, null texts empty."""
    return documents.select(F.col("doc_id").cast("long").alias("d"), row_key(F.col("doc_id"), F.col("text")).alias("k"), F.coalesce("text", F.lit("")).alias("t"))


def surroundings(rows: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Anchors (h, s, d, k, p) whose hash occurs again, and their classes (h, s, n, one) of equal surroundings."""
    found = anchor_table(rows, length, gram)
    # written down, so that joins are of plain tables, whose hot keys Spark can split
    again = written(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "suffix-again")
    repeated = written(found.join(again, "h").select("h", "s", "d", "k", "p"), "suffix-anchors")
    return repeated, written(repeated.groupBy("h", "s").agg(F.count("*").alias("n"), F.min(F.struct("d", "k", "p")).alias("one")), "suffix-classes")


def lost_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(d2, k2, spans) of the rows (d, k, t) that lose anything: the spans (s, e), unordered, to be clipped to the text."""
    reach = length - gram
    repeated, classes = surroundings(rows, length, gram)
    identical = repeated.join(classes.where("n > 1").select("h", "s"), ["h", "s"]).select("d", "k", (F.col("p") - reach).alias("s"), (F.col("p") + length).alias("e"))
    many = written(classes.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "suffix-many")
    wanted = classes.join(many, "h").select("h", "m", "one.d", "one.k", "one.p")
    small = snippets(rows, wanted.where(F.col("m") <= group), length, gram)
    spans = identical.union(tree_cover(small.withColumnRenamed("h", "g"), length, gram))
    if many.where(F.col("m") > group).limit(1).count():
        more, whole = split(snippets(rows, wanted.where(F.col("m") > group), length, gram), length, gram, group)
        spans = spans.union(tree_cover(more, length, gram))
        spans = spans.union(whole.select("d", "k", F.col("p") - F.octet_length("l"), F.col("p") + F.octet_length("r")))
    return spans.groupBy("d", "k").agg(F.collect_list(F.struct("s", "e")).alias("spans")).select(F.col("d").alias("d2"), F.col("k").alias("k2"), "spans")


def merged(spans: list[dict] | None, n: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans, clipped to [0, n)."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((max(0, x["s"]), min(n, x["e"])) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def kept_bytes(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in runs:
        out.append(data[at:s])
        at = e
    return b"".join([*out, data[at:]])


def maximal_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """repeat, n_bytes, doc_id, start: the maximal repeats of at least length bytes, as groups with all occurrences.

    A group (repeat: SHA-256 of its string) has a row for each place of the string; its places differ before and behind it,
    so no longer string has the same ones. Strings are followed up to length - gram bytes before an anchor and length from
    it: a longer repeat is several groups that overlap, each cut off there. The groups of a document together cover just the bytes that `removed` removes.
    Null texts are empty; rows that repeat id and text have places of their own; an empty table gives an empty one; other
    columns are ignored.
    """
    rows = keyed(documents)
    repeated, classes = surroundings(rows, length, gram)
    sized = classes.join(classes.groupBy("h").agg(F.count("*").alias("m")), "h").select("h", "n", "m", "one.d", "one.k", "one.p")
    parts = written(snippets(rows, sized.select("h", "d", "k", "p"), length, gram).dropDuplicates(["h", "d", "k", "p"]).join(sized, ["h", "d", "k", "p"]), "repeat-parts")
    found = tree_repeats(parts.where((F.col("m") > 1) & (F.col("m") <= group)).withColumnRenamed("h", "g"), length, gram)
    # surroundings that are equal elsewhere are a group as they are
    found = found.union(whole_repeats(parts.where((F.col("n") > 1) & (F.col("m") <= group)).select("l", "r", "d", "k", "p"), length, gram))
    if parts.where(F.col("m") > group).limit(1).count():
        hot = parts.where(F.col("m") > group)
        # twice, so that they meet an equal in every half that they come to
        hot = hot.union(hot.where("n > 1")).select("h", "d", "k", "p", "l", "r")
        small, whole = split(hot, length, gram, group)
        found = found.union(tree_repeats(small, length, gram)).union(whole_repeats(whole.select("l", "r", "d", "k", "p"), length, gram))
    # from one anchor of a class to all of them
    named = written(found.join(classes.select("h", "s", "one.d", "one.k", "one.p"), ["d", "k", "p"]).select("h", "s", "repeat", "e", "n_bytes").distinct(), "repeat-found")
    return repeated.join(named, ["h", "s"]).select("repeat", "n_bytes", F.col("d").alias("doc_id"), "k", (F.col("p") - F.col("e")).alias("start")).dropDuplicates(["repeat", "doc_id", "k", "start"]).drop("k")


def removed(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    Ids are numbers, or text of numbers. Null texts are empty; texts under `length` bytes lose nothing; repeated rows (same id and text) repeat each other and
    lose what they share; an empty table gives an empty one; other columns are ignored.
    """

    def measured(batches):
        for b in slices(batches):
            n, gone, runs_n, digest = [], [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = text.encode("utf-8", "replace")
                runs = merged(spans, len(data))
                n.append(len(data)), gone.append(sum(e - s for s, e in runs)), runs_n.append(len(runs))
                digest.append(hashlib.sha256(kept_bytes(data, runs)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, runs_n)), pa.array(digest)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = keyed(documents)
    lost = lost_spans(rows, length, gram, group)
    joined = rows.join(lost, F.col("d").eqNullSafe(F.col("d2")) & (F.col("k") == F.col("k2")), "left")
    return joined.select("d", "t", "spans").mapInArrow(measured, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """The rows, all columns, with the repeated bytes gone from text (null stays null) and n_chars, if there, anew.

    Ids are numbers, or text of numbers; rows that repeat id and text lose the same bytes. An empty table gives an empty one. Where a run begins or ends inside a character, the bytes that are left of it are dropped too.
    """
    lost = lost_spans(keyed(documents), length, gram, group)
    names = documents.columns
    own = documents.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = F.col(f"c{names.index('doc_id')}"), F.col(f"c{names.index('text')}")
    joined = own.join(lost, doc_id.cast("long").eqNullSafe(F.col("d2")) & (row_key(doc_id, text) == F.col("k2")), "left").drop("d2", "k2")
    at, count_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def cut(batches):
        for b in slices(batches):
            columns = list(b.columns)
            spans = columns.pop().to_pylist()
            hit = [i for i, s in enumerate(spans) if s]
            if hit:
                texts = columns[at].to_pylist()
                for i in hit:
                    data = texts[i].encode("utf-8", "replace")
                    texts[i] = kept_bytes(data, merged(spans[i], len(data))).decode("utf-8", "ignore")
                columns[at] = pa.array(texts, columns[at].type)
                if count_at is not None:
                    counts = columns[count_at].to_pylist()
                    for i in hit:
                        counts[i] = len(texts[i])
                    columns[count_at] = pa.array(counts, columns[count_at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(cut, documents.schema)
