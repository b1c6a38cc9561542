"""Line deduplication as an exact set-similarity join.

A line is the set of its blank-separated words, A-Z in lower case. Two lines match if the Jaccard similarity of their sets is at
least ``THRESHOLD``; a line that matches an earlier one, in order of document id and line number, is removed.
Lines with the same set are one class, which stands where its first line stands.

1. Words are counted in a sketch of ``CELLS`` cells over all documents. Its levels order words by rarity; a word of count one
   occurs nowhere else and is no key. Any order is correct, the sketch only makes it a good one.
2. Each class lists its rarest words as keys (prefix filter): matching lines share one of them.
3. Per key, classes are compared by length, by the key's place in either line (positional filter) and by a
   digest, the parity of the words at each bit, whose differing bits bound the differing words from below; long lines have longer ones.
   A key that very many classes share is dealt to tasks as pairs of blocks. A key does not list its pairs but joins each
   class with one other of its candidates, so a group of n variants gives some n rows.
4. Classes that are connected so are a group; each pair of matching classes lies in one. The words of a group's classes are brought together once, and
   all its pairs are verified there, on the words themselves, and counted where they are found. A very large group is dealt to tasks as pairs of blocks.

Defined results: null text and lines without words have no class and stay. Documents with a null id come last in the order.
Rows that repeat id and text are one document; each of them is returned and loses the same lines. A document that loses all its
lines with words leaves the corpus. Empty tables give empty results. Columns of the input are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import bit_set, free_finished, give_back, may_be_in, python_tasks
from .links import components

THRESHOLD = 0.8
CELLS = 1 << 22
#: The sketch travels in so many parts.
PARTS = 64
#: Bytes of text that are handled at a time; a line is never split, a document may be.
BATCH = 1 << 18
LAST = (1 << 63) - 1
#: Classes under a key up to which all keys of a batch are compared at once; larger ones are compared one by one, in blocks.
FEW, BLOCK = 48, 1_000
#: Occurrences of a word from which its rows are dealt to several tasks, and rows of a block of them.
HOT = 1 << 15
#: Longs of a digest, for lines of up to so many words: lines that are not alike differ in about half of its bits, alike ones in fewer than two ninths of their words.
WIDTHS, LENGTHS = np.array([1, 2, 4, 8, 16]), np.array([64, 150, 300, 600])
#: Classes of a group from which it is dealt to several tasks, in blocks of about so many.
CROWD = 1 << 12
#: For removal alone, a class meets so many small blocks of the earliest classes of its group before it meets whole ones.
ROUNDS = 3
#: Word places that are looked up at once, and pairs of two blocks from which their words are multiplied as matrices of so many columns.
LOOKUPS, DENSE, COLUMNS = 1 << 20, 1 << 14, 1 << 12

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, up to ``n``."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, BATCH + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word of lower-case bytes: a polynomial over its bytes, from running sums, then mixed."""
    word = ~_BLANK[data]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    up, down = _power_tables(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])))
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return starts, h ^ (h >> np.uint64(33))


def _pieces(text: str | None) -> Iterator[tuple[int, bytes]]:
    """Lower-case bytes of a text in pieces of whole lines, with the number of each piece's first line."""
    data = (text or "").encode("utf-8", "replace").lower()
    at = line = 0
    while len(data) - at > BATCH:
        end = data.rfind(b"\n", at, at + BATCH)
        end = data.find(b"\n", at) if end < 0 else end
        if end < 0:
            break
        yield line, data[at:end]
        line += data.count(b"\n", at, end) + 1
        at = end + 1
    yield line, data[at:]


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) & (CELLS - 1)


def word_levels(docs: DataFrame, hashes: Callable[[bytes], np.ndarray] | None = None) -> np.ndarray:
    """Per cell 0 for a count of 0 or 1, else a level that grows with the logarithm of the count: CELLS bytes. Words are counted, or the
    ``hashes`` of each whole text in lower case."""
    python_tasks(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        waiting, size = [], 0

        def take():
            if hashes is None:
                _, h = _tokens(np.frombuffer(b"\n".join(waiting), np.uint8))
            else:
                h = np.concatenate([np.zeros(0, np.uint64), *map(hashes, waiting)])
            waiting.clear()
            np.add.at(cells, _cell(h), np.uint32(1))

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for _, piece in _pieces(text) if hashes is None else [(0, (text or "").encode("utf-8", "replace").lower())]:
                    waiting.append(piece)
                    size += len(piece)
                    if size >= BATCH:
                        take()
                        size = 0
        take()
        each = CELLS // PARTS
        for k in range(PARTS):
            used = np.flatnonzero(cells[k * each:(k + 1) * each]) + k * each
            row = k, used.astype("<u4").tobytes(), cells[used].astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.binary()))], names=["part", "cells", "n"])
        del cells
        give_back()

    def add(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, low = np.zeros(CELLS // PARTS, np.int64), key[0] * (CELLS // PARTS)
        for part in parts:
            for x, n in zip(part["cells"], part["n"]):
                total[np.frombuffer(x, "<u4").astype(np.int64) - low] += np.frombuffer(n, "<u4")
        levels = np.where(total > 1, np.minimum(255, 8 * np.log2(np.maximum(total, 2))), 0).astype(np.uint8)
        yield pd.DataFrame({"part": [key[0]], "levels": [levels.tobytes()]})

    parts = docs.select("text").mapInArrow(count, "part int, cells binary, n binary")
    out = np.zeros((PARTS, CELLS // PARTS), np.uint8)
    for r in parts.groupBy("part").applyInPandas(add, "part int, levels binary").collect():  # PARTS rows, CELLS bytes
        out[r.part] = np.frombuffer(r.levels, np.uint8)
    return out.reshape(-1)


def overlap_needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least number of shared words of matching sets of ``n`` and ``m`` words."""
    return np.ceil((n + m) * (THRESHOLD / (1 + THRESHOLD)) - 1e-9).astype(np.int64)


def _by_line(line: np.ndarray, level: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The order by line, level and hash."""
    if len(line) and line[-1] < 1 << 16:
        key = (line.astype(np.uint64) << np.uint64(48)) | (level.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
        order = np.argsort(key)
        key = key[order]
        if not ((key[1:] == key[:-1]) & (h[order[1:]] != h[order[:-1]])).any():  # else 40 bits of the hash do not tell all words apart
            return order
    return np.lexsort((h, level, line))


def _parities(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each line, each the parity of the words that fall on it."""
    bit, high = np.uint64(1) << (h & np.uint64(63)), (h >> np.uint64(6) & np.uint64(1)).astype(bool)
    zero = np.uint64(0)
    return tuple(np.bitwise_xor.reduceat(np.where(side, bit, zero), starts) for side in (~high, high))


def _digests(h: np.ndarray, n: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parities of each line's words in the number of longs that tells lines of ``n`` words apart, one after another, and these numbers. A word's bits above the
    lowest six choose the long, so a digest folds to half as many longs by exclusive or."""
    width = WIDTHS[np.searchsorted(LENGTHS, n)]
    begins = np.cumsum(width) - width
    flat = np.zeros(width.sum(), np.uint64)
    bit = np.uint64(1) << (h & np.uint64(63))
    for w in np.unique(width):
        of = np.flatnonzero(width == w)
        words = np.repeat(width, n) == w
        long, own = (h[words] >> np.uint64(6)) & np.uint64(w - 1), bit[words]
        first = np.cumsum(n[of]) - n[of]
        for k in range(w):
            flat[begins[of] + k] = np.bitwise_xor.reduceat(np.where(long == np.uint64(k), own, np.uint64(0)) if w > 1 else own, first)
    return flat, width


class _Digests:
    """Digests of some lines, as the bytes of their longs."""

    def __init__(self, digests: np.ndarray):
        self.width = np.fromiter(map(len, digests), np.int64, len(digests)) >> 3
        flat = np.frombuffer(b"".join(digests), "<u8")
        begins = np.cumsum(self.width) - self.width
        self.levels, rows, matrix = [], np.zeros(0, np.int64), None
        for w in WIDTHS[::-1].tolist():  # those of at least w longs, folded to w
            own = np.flatnonzero(self.width == w)
            folded = np.zeros((0, w), np.uint64) if matrix is None else matrix[:, :w] ^ matrix[:, w:]
            matrix = np.concatenate((folded, flat[begins[own][:, None] + np.arange(w)]))
            rows = np.concatenate((rows, own))
            place = np.zeros(len(digests), np.int64)
            place[rows] = np.arange(len(rows))
            self.levels.insert(0, (w, place, matrix))

    def differ_less(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Indexes of the pairs that differ in no more bits than ``most``."""
        left = np.arange(len(x))
        narrower = np.minimum(self.width[x], self.width[y])
        for w, place, matrix in self.levels:
            there = narrower[left] >= w
            if not there.any():
                break
            at = left[there]
            bits = np.bitwise_count(matrix[place[x[at]]] ^ matrix[place[y[at]]]).sum(axis=1, dtype=np.int64)
            there[there] = bits > most[at]
            left = left[~there]
        return left


def _line_rows(data: bytes, levels: np.ndarray):
    """Of the lines with words in lower-case bytes: ``(number, n, class hash 1, class hash 2, two halves of a digest)`` of each, ``(index of the line, key, place)`` of
    each key, and the digests and their widths."""
    array = np.frombuffer(data, np.uint8)
    at, h = _tokens(array)
    number = np.searchsorted(np.flatnonzero(array == 10), at)
    level = levels[_cell(h)]
    order = _by_line(number, level, h)
    h, number, level = h[order], number[order], level[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (number[1:] != number[:-1])
    h, number, level = h[first], number[first], level[first]
    starts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))) if len(h) else np.zeros(0, int)
    n = np.diff(np.append(starts, len(h)))
    if not len(n):
        return (*[np.zeros(0, np.int64)] * 9, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    one = np.add.reduceat(h * (h | np.uint64(1)) ^ (h >> np.uint64(29)), starts)
    two = np.add.reduceat((h ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) ^ (h >> np.uint64(31)), starts)
    d1, d2 = _parities(h, starts)
    prefix = n - np.ceil(n * THRESHOLD - 1e-9).astype(np.int64) + 1
    place = np.arange(len(h)) - np.repeat(starts, n)
    # sets of up to three words match equal sets only, and a word that occurs once is in no other line
    key = np.flatnonzero((place < np.repeat(prefix, n)) & (level > 0) & np.repeat(n > 3, n))
    owner = np.searchsorted(starts, key, side="right") - 1
    return number[starts], n, one.view(np.int64), two.view(np.int64), d1.view(np.int64), d2.view(np.int64), owner, h[key].view(np.int64), place[key], *_digests(h, n, starts)


def busy_level(hot: int) -> int:
    """The level that a word of ``hot`` occurrences has at least."""
    return int(8 * math.log2(max(2, hot)))


def lines(docs: DataFrame, levels: np.ndarray, hot: int = HOT) -> DataFrame:
    """``(doc, version, line, n, c1, c2, d1, d2, keys, places, busy, digest)`` for each line with words of ``docs(doc_id, text)``. ``doc`` is the id,
    the largest number for a null one; ``(c1, c2)`` is the class; ``busy`` marks keys whose word occurs ``hot`` times or more. Of lines of one class within a batch the first one carries the keys, so
    a line that stands in a third of all rows has few."""
    spark = docs.sparkSession
    python_tasks(spark)
    shared = spark.sparkContext.broadcast(levels)
    names = ["doc", "version", "line", "n", "c1", "c2", "d1", "d2", "keys", "places", "busy", "digest"]
    from_level = busy_level(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []

        def out():
            number, n, one, two, d1, d2, owner, h, place, digests, width = _line_rows(b"\n".join(w[3] for w in waiting), shared.value)
            sizes = np.array([w[3].count(b"\n") + 1 for w in waiting])
            begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            piece = np.searchsorted(begins, number, side="right") - 1
            doc, version, low = (np.array([w[k] for w in waiting], np.int64)[piece] for k in range(3))
            line = number - begins[piece] + low
            waiting.clear()
            order = np.lexsort((line, doc, two, one))
            again = np.zeros(len(n), bool)
            again[order[1:]] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
            kept = ~again[owner]
            owner, h, place = owner[kept], h[kept], place[kept]
            offsets = pa.array(np.searchsorted(owner, np.arange(len(n) + 1)), pa.int32())
            arrays = [pa.array(x, t) for x, t in ((doc, None), (version, None), (line, pa.int32()), (n, pa.int32()), (one, None), (two, None), (d1, None), (d2, None))]
            arrays += [pa.ListArray.from_arrays(offsets, pa.array(h)), pa.ListArray.from_arrays(offsets, pa.array(place, pa.int32()))]
            arrays.append(pa.ListArray.from_arrays(offsets, pa.array(shared.value[_cell(h.view(np.uint64))] >= from_level)))
            ends = pa.array(np.concatenate(([0], np.cumsum(8 * width))), pa.int32())
            arrays.append(pa.Array.from_buffers(pa.binary(), len(n), [None, ends.buffers()[1], pa.py_buffer(digests.astype("<u8").tobytes())]))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        size = 0
        for batch in batches:
            for doc, version, text in zip(*(c.to_pylist() for c in batch.columns)):
                for low, piece in _pieces(text):
                    waiting.append((LAST if doc is None else doc, version, low, piece))
                    size += len(piece)
                    if size >= BATCH:
                        yield out()
                        size = 0
        if waiting:
            yield out()
        give_back()

    return docs.select("doc_id", F.xxhash64("text"), "text").mapInArrow(
        run, "doc long, version long, line int, n int, c1 long, c2 long, d1 long, d2 long, keys array<bigint>, places array<int>, busy array<boolean>, digest binary")


def _pairs(n, i, digests, x, y):
    """Which index pairs pass the length, positional and digest filters."""
    nx, ny = n[x], n[y]
    need = overlap_needed(nx, ny)
    ok = (np.minimum(nx, ny) >= need) & (np.minimum(nx - i[x], ny - i[y]) >= need)
    at = np.flatnonzero(ok)
    ok[:] = False
    ok[at[digests.differ_less(x[at], y[at], (nx + ny - 2 * need)[at])]] = True
    return ok


def _other_block(p, x, y):
    """Which index pairs are this task's: of two blocks, pairs within either are another task's."""
    return (p[x] & 4 == 0) | ((p[x] ^ p[y]) & 2 != 0)


def _near(starts, sizes, key):
    """Index pairs of all rows of the keys of at most FEW rows."""
    few = np.repeat(sizes <= FEW, sizes)
    for step in range(1, FEW):
        y = np.flatnonzero(few[step:] & (key[step:] == key[:-step])) + step
        if not len(y):
            break
        yield y - step, y


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of ``n`` points the smallest one that it is connected with by the edges ``x``, ``y``."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        differ = low < high
        if not differ.any():
            return root
        x, y = x[differ], y[differ]
        np.minimum.at(root, high[differ], low[differ])
        while (root[root] != root).any():
            root = root[root]


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each id of the pairs to the smallest id that the pairs connect it with."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = _roots(len(ids), at[:len(a)], at[len(a):])
    other = root != np.arange(len(ids))
    return ids[other], ids[root[other]]


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows in the order of the first one, so that equal values of it come together."""
    carried = None
    for batch in batches:
        columns = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        if carried is not None:
            columns = [np.concatenate(v) for v in zip(carried, columns)]
        last = np.searchsorted(columns[0], columns[0][-1]) if len(columns[0]) else 0
        carried = [v[last:] for v in columns]
        if last:
            yield [v[:last] for v in columns]
    if carried is not None and len(carried[0]):
        yield carried


def _bounds(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal keys."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return starts, np.diff(np.append(starts, len(key)))


def _by_key(rows: DataFrame, *order: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key", *order)


def _dealt(rows: DataFrame, hot: int) -> DataFrame:
    """Rows of busy keys, dealt to pairs of blocks of about ``hot`` rows: the classes of a key are numbered in the order of their length, so a
    block covers a range of lengths and meets only blocks whose lengths can match. Each class counts once for a key."""
    others = [c for c in rows.columns if c not in ("key", "c1")]
    once = cut(rows.groupBy("key", "c1").agg(F.min(F.struct(*others)).alias("r")).select("key", "c1", "r.*"))
    n = F.shiftright("p", 32)
    per_length = once.groupBy("key", n.alias("_n")).agg(F.count("*").alias("_size"))
    before = Window.partitionBy("key").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    reach = math.ceil(-math.log(THRESHOLD) * 1e12) + 1_000
    alike = Window.partitionBy("key").orderBy((F.log(F.col("_n")) * 1e12).cast("long")).rangeBetween(-reach, reach)
    starts = per_length.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    low, high = F.min("_start").over(alike), F.max(F.col("_start") + F.col("_size") - 1).over(alike)
    starts = cut(starts.select("key", "_n", "_size", "_start", F.floor(low / hot).alias("_low"), F.floor(high / hot).alias("_high")))
    placed = once.withColumn("_n", n).join(starts, ["key", "_n"])
    block = F.floor((F.col("_start") + F.pmod(F.xxhash64("c1"), F.col("_size"))) / hot)
    dealt = placed.withColumn("_block", block).withColumn("_other", F.explode(F.sequence("_low", "_high")))
    cross, side = (x.cast("long") for x in (F.col("_block") != F.col("_other"), F.col("_block") > F.col("_other")))
    key = F.xxhash64("key", F.least("_block", "_other"), F.greatest("_block", "_other"))
    return dealt.select(key.alias("key"), "c1", *[(F.col(c) + 4 * cross + 2 * side if c == "p" else F.col(c)).alias(c) for c in others])


def candidates(all_rows: DataFrame, hot: int = HOT, connected: bool = False) -> DataFrame:
    """``(later, earlier)``: classes (by their first hash) that share a key and pass the filters, each pair once. ``all_rows`` is as from
    ``lines``. If ``connected``, edges ``(a, b)`` instead, in no order, which connect the same classes: about one for a class under a key. No task holds more of a key
    than two blocks of about ``hot`` classes."""
    places = [] if connected else ["doc", "line"]
    rows = all_rows.filter(F.size("keys") > 0).select("c1", *places, "n", F.col("digest").alias("d"), F.explode(F.arrays_zip("keys", "places", "busy")).alias("k"))
    # n and the key's place share one number, with two bits for the blocks: rows are many, so they are narrow
    packed = F.shiftleft(F.col("n").cast("long"), 32) + F.col("k.places") * 8
    keyed = rows.select(F.col("k.keys").alias("key"), "c1", packed.alias("p"), "d", *places, F.col("k.busy").alias("busy"))
    busy = keyed.filter("busy").drop("busy")
    keyed = keyed.filter("NOT busy").drop("busy")
    if not busy.isEmpty():
        keyed = keyed.unionByName(_dealt(busy, hot))
    names = ["a", "b"] if connected else ["later", "earlier"]

    def fits(p, d, x, y):
        return _pairs(p >> 32, (p & 0xFFFFFFFF) >> 3, d, x, y) & _other_block(p, x, y)

    def one_key(p, d, start, size):
        """Index pairs of a key of many classes, a block with a block."""
        root = np.arange(size)
        for a in range(0, size, BLOCK):
            for b in range(0, a + 1, BLOCK):
                if connected and root[a] == root[b] and (root[a:a + BLOCK] == root[a]).all() and (root[b:b + BLOCK] == root[a]).all():
                    continue
                x, y = (z.ravel() for z in np.meshgrid(np.arange(b, min(b + BLOCK, size)), np.arange(a, min(a + BLOCK, size))))
                before = x < y
                x, y = x[before], y[before]
                ok = fits(p, d, x + start, y + start)
                if connected:
                    root = _roots(size, root[x[ok]], root[y[ok]])[root]
                elif ok.any():
                    yield x[ok] + start, y[ok] + start
        other = np.flatnonzero(root != np.arange(size))
        if len(other):
            yield root[other] + start, other + start

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(x, y):
            return pa.RecordBatch.from_arrays([pa.array(y), pa.array(x)], names=names)

        for key, c, p, d, *_ in _whole_keys(batches):
            # a class counts once for a key, where it stands first
            order = np.lexsort((np.arange(len(key)), c, key))
            first = np.ones(len(key), bool)
            first[order[1:]] = (key[order[1:]] != key[order[:-1]]) | (c[order[1:]] != c[order[:-1]])
            key, c, p, d = key[first], c[first], p[first], _Digests(d[first])
            starts, sizes = _bounds(key)
            found = [(x[ok], y[ok]) for x, y in _near(starts, sizes, key) for ok in [fits(p, d, x, y)]]
            large = (pair for k in np.flatnonzero(sizes > FEW) for pair in one_key(p, d, starts[k], sizes[k]))
            if connected:
                found += large
                if found:
                    yield out(*_stars(*(c[np.concatenate(z)] for z in zip(*found))))
            else:
                for x, y in chain(found, large):
                    yield out(c[x], c[y])
        give_back()

    ordered = _by_key(keyed) if connected else _by_key(keyed, "doc", "line", "c1")
    return ordered.mapInArrow(compare, ", ".join(f"{n} long" for n in names)).distinct()


def groups_of(all_rows: DataFrame, hot: int = HOT) -> DataFrame:
    """``(c1, g)``: the classes that are candidates of any other, with the group that holds all of them, stored."""
    edges = cut(candidates(all_rows, hot, connected=True))
    free_finished(all_rows.sparkSession)
    found = cut(components(edges).select(F.col("id").alias("c1"), F.col("component").alias("g")))
    free_finished(all_rows.sparkSession)
    return found


class _Words:
    """The word sets of some lines, as numbers."""

    def __init__(self, texts: Iterator[str]):
        known: dict[bytes, int] = {}
        sets = [np.sort(np.fromiter((known.setdefault(w, len(known)) for w in set(t.encode("utf-8", "replace").lower().split())), np.int64)) for t in texts]
        self.n = np.array([len(x) for x in sets], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.n)[:-1]))
        self.ids = np.concatenate(sets)
        self.most = max(1, len(known))
        self.places = np.repeat(np.arange(len(sets)), self.n) * self.most + self.ids  # in order
        flat, width = _digests(self.ids.astype(np.uint64) * np.uint64(_BASE) >> np.uint64(40), self.n, self.starts)
        self.digests = _Digests(np.array([x.tobytes() for x in np.split(flat, np.cumsum(width)[:-1])], object))

    def _looked_up(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Shared words of index pairs."""
        out = []
        ends = np.cumsum(self.n[x])
        a = 0
        while a < len(x):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + LOOKUPS, side="right")))
            n = self.n[x[a:b]]
            begins = np.cumsum(n) - n
            at = np.arange(n.sum()) + np.repeat(self.starts[x[a:b]] - begins, n)
            wanted = np.repeat(y[a:b], n) * self.most + self.ids[at]
            place = np.minimum(np.searchsorted(self.places, wanted), len(self.places) - 1)
            out.append(np.add.reduceat((self.places[place] == wanted).astype(np.int64), begins))
            a = b
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _multiplied(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Shared words of index pairs of not many lines: products of matrices of lines and words."""
        (rows, i), (cols, j) = (np.unique(z, return_inverse=True) for z in (x, y))
        sides = []
        for lines_ in (rows, cols):
            n = self.n[lines_]
            sides.append((np.repeat(np.arange(len(lines_)), n), self.ids[np.arange(n.sum()) + np.repeat(self.starts[lines_] - np.cumsum(n) + n, n)]))
        common = np.intersect1d(sides[0][1], sides[1][1])
        shared = np.zeros((len(rows), len(cols)), np.float32)  # whole numbers, exact up to 16 million words
        for a in range(0, len(common), COLUMNS):
            words = common[a:a + COLUMNS]
            left, right = (np.zeros((len(z), len(words)), np.float32) for z in (rows, cols))
            for matrix, (line, ids) in zip((left, right), sides):
                place = np.minimum(np.searchsorted(words, ids), len(words) - 1)
                hit = words[place] == ids
                matrix[line[hit], place[hit]] = 1
            shared += left @ right.T
        return shared[i, j].astype(np.int64)

    def match(self, x: np.ndarray, y: np.ndarray, blocks: bool) -> np.ndarray:
        """Which index pairs match; pairs of two ``blocks`` share their lines, and many are multiplied."""
        ok = _pairs(self.n, np.zeros(len(self.n), np.int64), self.digests, x, y)
        x, y = x[ok], y[ok]
        shared = self._multiplied(x, y) if blocks and len(x) >= DENSE else self._looked_up(x, y)
        ok[ok] = shared >= THRESHOLD * (self.n[x] + self.n[y] - shared) - 1e-9
        return ok


def _matching(words: _Words, p: np.ndarray, key: np.ndarray, rounds: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that match, earlier line first, of rows in the order of group and line. With ``rounds``, a line of a group of more than FEW is done with when it matches any."""
    def good(x, y, blocks=False):
        ok = _other_block(p, x, y)
        x, y = x[ok], y[ok]
        ok = words.match(x, y, blocks)
        return x[ok], y[ok]

    starts, sizes = _bounds(key)
    for x, y in _near(starts, sizes, key):
        yield good(x, y)
    for k in np.flatnonzero(sizes > FEW):
        begin, end = starts[k], starts[k] + sizes[k]
        for a in range(begin, end, BLOCK):
            later = np.arange(a, min(a + BLOCK, end))
            b, turn = begin, 0
            while b <= later[-1] if len(later) else False:
                size = BLOCK if rounds is None or turn >= rounds else 16 * 4 ** turn
                x, y = (z.ravel() for z in np.meshgrid(np.arange(b, min(b + size, end)), later))
                before = x < y
                x, y = good(x[before], y[before], blocks=True)
                if len(x):
                    yield x, y
                    later = later if rounds is None else np.setdiff1d(later, y)
                b, turn = b + size, turn + 1


def _verified(groups: DataFrame, classes: DataFrame, docs: DataFrame, wanted: str = "counts", rounds: int = ROUNDS, hot: int = HOT) -> DataFrame:
    """What matches among the classes ``(c1, g)`` of each group, on the lines' texts. ``wanted`` is ``pairs``: ``(later, earlier)`` for every pair that matches;
    ``counts``: ``(c1, n_links, spot)``, the number of matches of each class that has any and the place of the earliest one, null if that is the class itself; or
    ``later``: the same where an earlier class matches, by as few comparisons as that takes, so that the numbers and places are not whole."""
    where = classes.select("c1", "doc", "version", "line", "n").join(groups, "c1")
    spots = cut(where.groupBy("doc", "version").agg(F.collect_list(F.struct("line", "c1", "n", "g")).alias("spots")))
    own = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("version"), "text")
    # few documents hold a wanted line; a bounded bit set keeps most others from being shuffled
    marked = bit_set(spots.select(F.col("version").alias("h")))
    own = own.filter(may_be_in(F.col("version"), marked)).hint("shuffle_merge")
    texts = own.join(spots, ["doc", "version"]).select("doc", F.split("text", "\n", -1).alias("lines"), "spots").select(
        "doc", F.explode(F.transform("spots", lambda s: F.struct(s["g"].alias("key"), s["c1"].alias("c1"), F.shiftleft(s["n"].cast("long"), 32).alias("p"),
                                                                  s["line"].alias("line"), F.get("lines", s["line"]).alias("text")))).alias("x"))
    rows = texts.select("x.key", "x.c1", "x.p", "doc", "x.line", "x.text")
    crowd = min(hot, CROWD)
    large = groups.groupBy(F.col("g").alias("key")).count().filter(F.col("count") > crowd).select("key")
    if not large.isEmpty():
        rows, large = cut(rows), cut(large)
        rows = rows.join(large, "key", "left_anti").unionByName(_dealt(rows.join(large, "key", "left_semi"), crowd))
    few_rounds = rounds if wanted == "later" else None

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, c, p, doc, line, text in _whole_keys(batches):
            order = np.lexsort((c, line, doc, key))
            key, c, p, doc, line, text = (v[order] for v in (key, c, p, doc, line, text))
            first = np.ones(len(key), bool)  # rows that repeat an id and a text repeat its lines
            first[1:] = (key[1:] != key[:-1]) | (c[1:] != c[:-1])
            key, c, p, doc, line, text = (v[first] for v in (key, c, p, doc, line, text))
            n_links, best = np.zeros(len(key), np.int64), np.full(len(key), len(key))
            for x, y in _matching(_Words(text), p, key, few_rounds):
                if wanted == "pairs":
                    yield pa.RecordBatch.from_arrays([pa.array(c[y]), pa.array(c[x])], names=["later", "earlier"])
                n_links += np.bincount(x, minlength=len(key)) + np.bincount(y, minlength=len(key))
                np.minimum.at(best, y, x)
            if wanted != "pairs":
                has = np.flatnonzero(n_links)
                none = best[has] == len(key)
                at = np.where(none, 0, best[has])
                yield pa.RecordBatch.from_arrays([pa.array(c[has]), pa.array(n_links[has]), pa.array(doc[at], mask=none), pa.array(line[at], pa.int32(), mask=none)],
                                                 names=["c1", "n_links", "doc", "line"])
        give_back()

    if wanted == "pairs":
        return _by_key(rows).mapInArrow(verify, "later long, earlier long")
    found = _by_key(rows).mapInArrow(verify, "c1 long, n_links long, doc long, line int")
    spot = F.when(F.col("doc").isNotNull(), F.struct("doc", "line"))
    found = found.groupBy("c1").agg(F.sum("n_links").alias("n_links"), F.min(spot).alias("spot"))
    return found.filter("spot IS NOT NULL") if wanted == "later" else found


def _first_lines(all_lines: DataFrame) -> DataFrame:
    """The classes ``(c1, c2, doc, line, version, n, n_rows)``, each where it stands first, stored."""
    place = F.struct("doc", "line", "version", "n")
    found = all_lines.groupBy("c1", "c2").agg(F.min(place).alias("p"), F.count("*").alias("n_rows"))
    return cut(found.select("c1", "c2", "p.doc", "p.line", "p.version", "p.n", "n_rows"))


def links(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``(later, earlier)``: every pair of different classes of ``docs(doc_id, text)`` that match, once, by the ``c1`` of ``matches``."""
    docs = docs.select("doc_id", "text")
    all_lines = cut(lines(docs, word_levels(docs), hot).drop("d1", "d2"))
    return _verified(groups_of(all_lines, hot), _first_lines(all_lines), docs, "pairs", hot=hot)


def matches(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``(doc, version, line, n, removed, match_doc, match_line, c1, c2, n_links)`` for every line with words of ``docs(doc_id, text)``, each
    text under an id once. The match is the place of the earliest similar class; of a class's own later lines it is the class's first
    line unless an earlier class is similar. ``(c1, c2)`` is the line's class and ``n_links`` the number of other classes that match it."""
    docs = docs.select("doc_id", "text")
    all_lines = cut(lines(docs, word_levels(docs), hot).drop("d1", "d2"))
    groups, classes = groups_of(all_lines, hot), _first_lines(all_lines)
    best = cut(_verified(groups, classes, docs, "counts", hot=hot))
    free_finished(docs.sparkSession)
    # a class of one line that matches no other has nothing to tell
    judged = cut(classes.join(best, "c1", "left").filter("n_rows > 1 OR n_links > 0").select("c1", "c2", F.struct("doc", "line").alias("own"), F.col("version").alias("first_version"), "spot", "n_links"))
    out = all_lines.select("doc", "version", "line", "n", "c1", "c2").join(judged, ["c1", "c2"], "left")
    is_first = (F.col("own.doc") == F.col("doc")) & (F.col("own.line") == F.col("line")) & (F.col("first_version") == F.col("version"))
    match = F.coalesce("spot", F.when(~is_first, F.col("own")))
    return out.select("doc", "version", "line", "n", match.isNotNull().alias("removed"), match["doc"].alias("match_doc"),
                      match["line"].alias("match_line"), "c1", "c2", F.coalesce("n_links", F.lit(0)).alias("n_links")).distinct()


def removals(docs: DataFrame, rounds: int = ROUNDS, hot: int = HOT) -> DataFrame:
    """``(doc, version, line, removed)`` for every line with words of ``docs(doc_id, text)``, each text under an id once; as ``matches``, without the links: a
    class of a large group is compared with ``rounds`` small blocks of its earliest classes first, so n variants cost about n verifications and not n squared."""
    docs = docs.select("doc_id", "text")
    all_lines = cut(lines(docs, word_levels(docs), hot).drop("d1", "d2"))
    groups, classes = groups_of(all_lines, hot), _first_lines(all_lines)
    again = cut(_verified(groups, classes, docs, "later", rounds, hot).select("c1", F.lit(True).alias("again")))
    free_finished(docs.sparkSession)
    judged = cut(classes.join(again, "c1", "left").filter("n_rows > 1 OR again").select("c1", "c2", F.struct("doc", "line", "version").alias("first"), F.coalesce("again", F.lit(False)).alias("again")))
    out = all_lines.select("doc", "version", "line", "c1", "c2").join(judged, ["c1", "c2"], "left")
    gone = F.col("first").isNotNull() & (F.col("again") | (F.col("first") != F.struct("doc", "line", "version")))
    return out.select("doc", "version", "line", gone.alias("removed")).distinct()


def remove_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that match earlier ones, and without documents that lost all lines with words."""
    found = removals(docs)
    gone = found.groupBy(F.col("doc").alias("_at_doc"), F.col("version").alias("_at_version")).agg(
        F.collect_list(F.when(F.col("removed"), F.col("line"))).alias("_gone"), F.count("*").alias("_n")).filter(F.size("_gone") > 0)
    keyed = docs.withColumns({"_doc": F.coalesce("doc_id", F.lit(LAST)), "_version": F.xxhash64("text")})
    joined = keyed.join(gone, (F.col("_doc") == F.col("_at_doc")) & (F.col("_version") == F.col("_at_version")), "left")
    parts = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    alive = F.col("_gone").isNull() | (F.size("_gone") < F.col("_n"))
    return joined.filter(alive).withColumn("text", text).select(*docs.columns)
