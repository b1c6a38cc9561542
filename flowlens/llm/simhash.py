"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a covering code of 64 bits: a product of perfect codes (two of 23 bits with radius 3,
one of 15 bits with radius 1, one of 3 bits with radius 1), 2**36 anchors in all. Every fingerprint is replicated to
every anchor in reach, and fingerprints are compared per anchor.

Reach: for two fingerprints that differ in at most ``t`` bits there is a word in the middle, at most ``ceil(t / 2)`` from either. The
anchor next to it is within the covering radius in each block, so it lies, for either fingerprint, within the radius
plus ``ceil(t / 2)``, where what exceeds the radius is added up over the blocks. Each fingerprint
goes to all anchors within that reach (about 165 for t = 4), so no pair is missed.

Equal fingerprints are one row from the start. A task compares within its anchors and passes on only
the links that joined something new, at most one per fingerprint and round of its memory, not pairs.
A crowded anchor is searched by bit blocks (t + 1 blocks, of which close fingerprints share one), so its cost does not grow
with the square of its size.

Defined results: null text or text without words: fingerprint zero, linked like any other. Fewer words than a shingle:
the whole sequence is one. For ``near_duplicates`` rows without doc_id have no component (null) and their fingerprints link nothing; ``keep_one`` treats
them as documents with the largest id. Repeated rows share one. An empty table gives an empty result. Columns of the input named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import python_tasks
from .links import components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Shingles whose bits are counted at a time.
CHUNK = 65_536
#: Generator polynomials of the perfect codes (fixed values): bits, generator, radius. The last is the repetition code.
CODES = ((23, 0b110001110101, 3), (23, 0b110001110101, 3), (15, 0b10011, 1), (3, 0b111, 1))
#: Fingerprints at an anchor from which it is searched by bit blocks.
CROWD = 512
#: Links a task remembers before it passes them on and starts anew.
MEMORY = 500_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only ASCII blanks split
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[:n - 1] + 1)).tolist()
    stops = ends[min(shingle, len(words)) - 1:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for a in range(0, n, CHUNK):
        h = np.array([digest(joined[x:y], SEED) for x, y in zip(starts[a:a + CHUNK], stops[a:a + CHUNK])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed long."""
    python_tasks(docs.sparkSession)

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).astype(np.int64))

    return docs.withColumn("fp", run(F.col(text)))


class _Block:
    """One block of the code. For each syndrome: what to add to a word to get to the nearest codeword, and from
    there to those at excess 1, 2, ... as padded tables with their counts."""

    def __init__(self, bits: int, generator: int, radius: int, shift: int, excess: int):
        degree = generator.bit_length() - 1

        def rest(x: int) -> int:
            while x.bit_length() > degree:
                x ^= generator << (x.bit_length() - 1 - degree)
            return x

        of_bit = [rest(1 << i) for i in range(bits)]
        lists: list[list[list[int]]] = [[[] for _ in range(1 << degree)] for _ in range(excess + 1)]
        for weight in range(radius + excess + 1):
            for places in combinations(range(bits), weight):
                s = e = 0
                for i in places:
                    s ^= of_bit[i]
                    e |= 1 << i
                lists[max(0, weight - radius)][s].append(e)
        self.nearest = np.array([x[0] for x in lists[0]], np.uint64) << np.uint64(shift)
        self.moves = []
        for level in lists[1:]:
            width = max(map(len, level))
            table = np.zeros((1 << degree, width), np.uint64)
            used = np.zeros((1 << degree, width), bool)
            for s, es in enumerate(level):
                table[s, :len(es)] = es
                used[s, :len(es)] = True
            self.moves.append(((table << np.uint64(shift)) ^ np.where(used, self.nearest[:, None], np.uint64(0)), used))
        self.shift, self.mask = np.uint64(shift), np.uint64((1 << bits) - 1)
        self.tables = []
        for low in range(0, bits, 8):
            t = np.zeros(256, np.int64)
            for v in range(256):
                for i in range(min(8, bits - low)):
                    if v >> i & 1:
                        t[v] ^= of_bit[low + i]
            self.tables.append((np.uint64(low), t))

    def syndrome(self, fps: np.ndarray) -> np.ndarray:
        x = (fps >> self.shift) & self.mask
        out = np.zeros(len(fps), np.int64)
        for low, t in self.tables:
            out ^= t[((x >> low) & np.uint64(255)).astype(np.int64)]
        return out


@cache
def code(excess: int) -> list[_Block]:
    shift, out = 0, []
    for bits, generator, radius in CODES:
        out.append(_Block(bits, generator, radius, shift, excess))
        shift += bits
    return out


def anchors(fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """``(anchor, index into fps)``: all anchors in reach of each fingerprint, each once."""
    excess = (max_bits + 1) // 2
    blocks = code(excess)
    at = fps.copy()
    syndromes = [b.syndrome(fps) for b in blocks]
    for b, s in zip(blocks, syndromes):
        at ^= b.nearest[s]
    values, owners = [], []
    # excess spent so far -> partial anchors, extended block by block
    parts = {0: (at, np.arange(len(fps)))}
    for b, s in zip(blocks, syndromes):
        grown: dict[int, list] = {k: [v] for k, v in parts.items()}
        for spent, (value, owner) in parts.items():
            for extra, (table, used) in enumerate(b.moves, 1):
                if spent + extra <= excess:
                    own = s[owner]
                    ok = used[own]
                    moved = (value[:, None] ^ table[own])[ok]
                    grown.setdefault(spent + extra, []).append((moved, np.repeat(owner, ok.sum(axis=1))))
        parts = {k: (np.concatenate([x for x, _ in v]), np.concatenate([o for _, o in v])) for k, v in grown.items()}
    for value, owner in parts.values():
        values.append(value)
        owners.append(owner)
    return np.concatenate(values), np.concatenate(owners)


def close_pairs(fps: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints that differ in at most ``max_bits`` bits, in batches."""
    n = len(fps)
    if n <= CROWD:
        i, j = np.triu_indices(n, 1)
        near = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
        yield i[near], j[near]
        return
    edges = np.linspace(0, 64, max_bits + 2).astype(int)
    for low, high in zip(edges, edges[1:]):
        part = (fps >> np.uint64(low)) & np.uint64((1 << int(high - low)) - 1)
        order = np.argsort(part, kind="stable")
        for step in range(1, n):  # neighbours at this distance in the sorted order, until no block is that wide
            a, b = order[:-step], order[step:]
            same = part[a] == part[b]
            if not same.any():
                break
            a, b = a[same], b[same]
            near = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
            yield a[near], b[near]


class _Forest:
    """Union-find over fingerprints; remembers the links that joined two parts."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    def join(self, a: int, b: int) -> None:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)
            self.links.append((a, b))


def links(fingerprints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(a, b)``: links between distinct ``fingerprints(fp)`` that connect what lies within ``max_bits`` bits."""
    spark = fingerprints.sparkSession
    python_tasks(spark)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(fps), 2_000):
                some = fps[k:k + 2_000]
                value, owner = anchors(some, max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(some[owner].view(np.int64))], names=["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, carried = _Forest(), None

        def out():
            a, b = zip(*forest.links) if forest.links else ((), ())
            forest.__init__()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        def group(fps: np.ndarray) -> None:
            for i, j in close_pairs(fps.view(np.uint64), max_bits):
                for a, b in zip(fps[i].tolist(), fps[j].tolist()):
                    forest.join(a, b)

        for batch in batches:
            anchor, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if carried is not None:
                anchor, fp = np.concatenate((carried[0], anchor)), np.concatenate((carried[1], fp))
            starts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(anchor) else np.array([], int)
            if len(starts):
                sizes = np.diff(np.append(starts, len(anchor)))
                # most anchors hold two or a few fingerprints: pairs at each distance, all anchors at once
                inner = sizes[:-1]
                group_of = np.repeat(np.arange(len(sizes)), sizes)
                few = (sizes <= 64)
                few[-1] = False
                for step in range(1, 64):
                    if not (inner > step).any():
                        break
                    same = (group_of[:-step] == group_of[step:]) & few[group_of[:-step]]
                    if not same.any():
                        break
                    x, y = fp[:-step][same], fp[step:][same]
                    near = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= max_bits
                    for a, b in zip(x[near].tolist(), y[near].tolist()):
                        forest.join(a, b)
                for k in np.flatnonzero(~few[:-1]):
                    group(fp[starts[k]:starts[k] + sizes[k]])
                carried = (anchor[starts[-1]:], fp[starts[-1]:])
            if len(forest.parent) > MEMORY:
                yield out()
        if carried is not None and len(carried[0]) > 1:
            group(carried[1])
        yield out()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = fingerprints.select("fp").mapInArrow(replicate, "anchor long, fp long").repartition(n, "anchor")
    return spread.sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long").distinct()


def prints_of(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, version, fp)`` of ``docs(doc_id, text)``, stored. ``version`` tells apart texts under one id."""
    named = with_fingerprints(docs.select("doc_id", "text", F.xxhash64("text").alias("version")), "text", shingle)
    return cut(named.select("doc_id", "version", "fp"))


def print_components(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(fp, component)`` for every distinct fingerprint: a fingerprint that names its component."""
    distinct = cut(prints.select("fp").distinct())  # copies collapse here
    joined = components(links(distinct, max_bits))
    return distinct.join(joined.withColumnRenamed("id", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, version, fp, component_id)`` for every row of ``docs(doc_id, text)``: its component's smallest doc_id."""
    prints = prints_of(docs, shingle)
    member = cut(print_components(prints.filter("doc_id IS NOT NULL"), max_bits))
    low = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))  # one row per fingerprint
    of_component = cut(member.join(low, "fp").groupBy("component").agg(F.min("low").alias("component_id")))
    named = cut(member.join(of_component, "component").select("fp", "component_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return prints.join(named, "fp", "left").select("doc_id", "version", "fp", own)


def keep_of_components(docs: DataFrame, prints: DataFrame, member: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, by ``prints(doc_id, version, fp)`` and ``member(fp, component)``."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")
    per_print = prints.groupBy("fp").agg(F.min(order).alias("k"))  # combines before the shuffle
    kept = per_print.join(member, "fp").groupBy("component").agg(F.min("k").alias("k"))
    kept = cut(kept.select(F.col("k.doc_id").alias("_id"), F.col("k.version").alias("_version")))
    chosen = docs.join(kept, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_version")), "left_semi")
    repeated = prints.groupBy("doc_id", "version").count().filter("count > 1")
    return chosen if repeated.isEmpty() else chosen.dropDuplicates(["doc_id", "text"])


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id (a null one is largest). Repeated rows count once."""
    prints = prints_of(docs.select("doc_id", "text"), shingle)
    return keep_of_components(docs, prints, print_components(prints, max_bits))


def as_hex(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
