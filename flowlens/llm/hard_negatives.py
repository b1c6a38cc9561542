"""Hard negatives for anchors: rows of another label whose score lies in a band below that of a positive.

Scores are inner products of whole-number vectors, so they are exact. All rows meet all anchors, block by block; a block pair is filtered by
one-bit codes before anything is scored:

1. Every vector is rotated by one orthogonal matrix and coded by the signs, x, with its alignment a = <x, v'> to the rotated unit vector v'.
2. A rotated anchor is held in ``PLANES`` bit planes, so <x, q> comes from population counts, with a known rounding error.
3. v' is a x + r with r at right angles to x and of length sqrt(1 - a^2), so by Cauchy-Schwarz <v', q> lies within
   sqrt(1 - a^2) * sqrt(|q|^2 - <x, q>^2) of a <x, q>. The interval always holds, it is not a probability.
4. A few rows with the best estimates are scored; the worst that still counts is a floor. Rows whose interval does not reach the floor, or lies
   beside the band, cannot count. All others are scored with whole numbers.

First the positives of each anchor are found in this way, then the negatives for their bands. Each block pair passes on its best rows only, and the
best of all pairs are the result, so no row is lost whatever the estimates are. Work is anchors times rows, and what is shuffled grows with anchors times
blocks of rows. A task reads a block of rows and then the blocks of anchors one after the other; no join makes or broadcasts pairs of them, since a row
that holds two blocks is large and Spark's joins keep all rows of a key that match one.

Defined results: rows with a null id, label or vector, or with a null or infinite component or none (NaN) take no part. Shorter vectors are filled up with zeros. A row
is no partner of rows with its own id; else rows that repeat an id are rows of their own (ties: label). Scores must fit a long. Empty tables give an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import constant_array, python_tasks

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Percent of a positive's score between which a negative's score lies.
LOW, HIGH = 30, 90
PLANES = 8
#: Most rows and anchors of a block, and most components of its rows; fewer rows make a block if there were fewer than ``SPREAD`` blocks, or four a core.
ROWS, ANCHORS, COMPONENTS, SPREAD = 32_768, 1_024, 1 << 22, 48
SEED = 20_240_607
_BLOCK = "block long, n int, ids binary, labels binary, vectors binary, codes binary, norms binary, aligned binary"
#: What is needed of a block of anchors.
_OWN = ["n", "ids", "labels", "vectors"]
_ANCHOR = ["anchor_block", "slot"]


@cache
def rotation(dim: int) -> np.ndarray:
    """An orthogonal matrix, the same for every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _top(x: np.ndarray) -> int:
    """The largest absolute value."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as hold them all."""
    return x.astype(next((k for k in ("<i2", "<i4") if _top(x) <= np.iinfo(k).max), "<i8")).tobytes()


def _wide(x: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(x, f"<i{len(x) // (n * dim)}").reshape(n, dim)


class Block:
    """Vectors with their one-bit codes."""

    def __init__(self, ids, labels, vectors, codes, norms, aligned):
        self.ids, self.labels, self.vectors, self.codes, self.norms, self.aligned = ids, labels, vectors, codes, norms, aligned
        self.words = [np.ascontiguousarray(codes[:, k]) for k in range(codes.shape[1])]
        self.ones = sum(np.bitwise_count(w).astype(float) for w in self.words)
        self.along, self.across = norms * aligned, norms * np.sqrt(np.maximum(0.0, 1.0 - aligned * aligned))
        self.top, self.parts, self.kinds = _top(vectors), {}, {}

    @classmethod
    def make(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> "Block":
        dim = vectors.shape[1]
        norms = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        turned = (vectors / np.maximum(norms, 1e-300)[:, None]) @ rotation(dim).T
        codes = np.packbits(turned >= 0, axis=1, bitorder="little").view("<u8")
        return cls(ids, labels, vectors, codes, norms, np.abs(turned).sum(axis=1) / np.sqrt(dim))

    @classmethod
    def read(cls, row: dict, dim: int) -> "Block":
        n = row["n"]
        ids, labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
        norms, aligned = (np.frombuffer(row[c], "<f8") for c in ("norms", "aligned"))
        return cls(ids, labels, _wide(row["vectors"], n, dim), np.frombuffer(row["codes"], "<u8").reshape(n, -1), norms, aligned)

    def packed(self, block: int) -> tuple:
        return (block, len(self.ids), self.ids.tobytes(), self.labels.tobytes(), _narrow(self.vectors), *[x.tobytes() for x in (self.codes, self.norms, self.aligned)])

    def alike(self, label: int) -> tuple[int, int]:
        """First and last place, exclusive, of a label in a block whose rows stand by label."""
        return tuple(int(np.searchsorted(self.labels, label, side)) for side in ("left", "right"))

    def part(self, label: int) -> "Block":
        """The rows of a label, of a block whose rows stand by label."""
        if label not in self.parts:
            at = slice(*self.alike(label))
            self.parts[label] = Block(*[x[at] for x in (self.ids, self.labels, self.vectors, self.codes, self.norms, self.aligned)])
        return self.parts[label]

    def scores(self, rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
        most = self.top * _top(vector) * len(vector)  # of a sum and of its parts
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64  # that holds these sums exactly
        if kind not in self.kinds:
            self.kinds[kind] = self.vectors.astype(kind)
        table, vector = self.kinds[kind], vector.astype(kind)
        if 4 * len(rows) > len(table):  # reading on is faster than picking
            return (table @ vector)[rows].astype(np.int64)
        return (table[rows] @ vector).astype(np.int64)

    def intervals(self, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Estimate, lower and upper bound of the score of every row with a vector."""
        dim = len(vector)
        q = rotation(dim) @ vector
        length, low, root = float(np.sqrt(q @ q)), float(q.min()), float(np.sqrt(dim))
        unit = (float(q.max()) - low) / ((1 << PLANES) - 1) or 1.0
        level = np.rint((q - low) / unit).astype(np.int64)
        error = float(np.abs(q - (low + unit * level)).sum()) / root
        counts = np.zeros(len(self.ids), np.uint16 if dim << PLANES <= 1 << 16 else np.uint32)
        for plane in reversed(range(PLANES)):
            counts += counts
            for word, bits in zip(self.words, np.packbits((level >> plane & 1).astype(bool), bitorder="little").view("<u8")):
                counts += np.bitwise_count(word & bits)
        along = counts * (2 * unit / root)
        along += self.ones * (2 * low / root)
        along -= (low * dim + unit * float(level.sum())) / root
        rest = np.maximum(np.abs(along) - error, 0.0)
        rest = np.sqrt(np.maximum(length * length - rest * rest, 0.0))
        spread = self.across * rest
        spread += self.along * error + self.norms * (1e-9 * length)
        spread += 1e-6
        estimate = self.along * along
        return estimate, estimate - spread, estimate + spread


def _best(block: Block, vector: np.ndarray, able: np.ndarray, k: int, bands: list[tuple[int, int]], bounds) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each band of scores the ``k`` best rows of a block and their scores, best first, among those ``able``."""
    estimate, low, high = bounds
    real = [(least, most) for least, most in bands if least <= most]
    if not real:
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(bands)
    floor, top = min(least for least, _ in real), max(most for _, most in real)
    rows = np.flatnonzero(able & (high >= floor) & (low <= top))
    if len(rows) > 4 * k:
        near = estimate[rows]
        near[near > min(most for _, most in real)] = -np.inf
        known = np.sort(block.scores(rows[np.argpartition(near, -2 * k)[-2 * k:]], vector))
        inside = [known[(known >= least) & (known <= most)] for least, most in real]
        floor = min(int(x[-k]) if len(x) >= k else least for x, (least, _) in zip(inside, real))  # each band has k rows that reach it, or is open
        rows = rows[high[rows] >= floor]
    score = block.scores(rows, vector)
    kept = np.flatnonzero((score >= floor) & (score <= top))
    rows, score = rows[kept], score[kept]
    ranked, out = np.sort(score), []
    for least, most in bands:
        n = int(np.searchsorted(ranked, most, "right"))
        inside = np.flatnonzero((score >= max(least, int(ranked[n - k]) if n >= k else least)) & (score <= most))
        order = inside[np.lexsort((block.labels[rows[inside]], block.ids[rows[inside]], -score[inside]))[:k]]
        out.append((rows[order], score[order]))
    return out


def whole_vectors(rows: DataFrame, vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, vector)`` of the rows that take part; each component becomes ``floor(scale * x)``."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.filter(F.col("vec_id").isNotNull() & F.col(label).isNotNull() & F.coalesce(finite, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long"), F.col(label).cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * scale)).alias("vector"))


def _blocks(vectors: DataFrame, dim: int, size: int, n_blocks: int) -> DataFrame:
    """The vectors in blocks of about ``size`` rows, each with a number of its own, stored."""
    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Block number, ids, labels and vectors of rows that stand together."""
        for batch in batches:
            block, ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            lengths = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            table = np.zeros((len(block), dim), np.int64)
            table[np.arange(dim) < lengths[:, None]] = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            ends = [*(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)] if len(block) else []
            for a, b in zip([0, *ends], ends):
                yield int(block[a]), ids[a:b], labels[a:b], table[a:b]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []

        def out() -> pa.RecordBatch:
            ids, labels, table = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            order = np.argsort(labels, kind="stable")
            row = Block.make(ids[order], labels[order], table[order]).packed(number << 20 | part)
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=[c.split()[0] for c in _BLOCK.split(", ")])

        number = part = n = 0
        for block, *some in tables(batches):
            if block != number:
                if waiting:
                    yield out()
                number, part, n = block, 0, 0
            while n + len(some[0]) >= 2 * size:
                waiting.append(tuple(x[:2 * size - n] for x in some))
                some, n = [x[2 * size - n:] for x in some], 0
                yield out()
                part += 1
            if len(some[0]):
                waiting.append(tuple(some))
                n += len(some[0])
        if waiting:
            yield out()

    numbered = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("block"), "vec_id", "label", "vector")
    return cut(numbered.repartition(n_blocks, "block").sortWithinPartitions("block").mapInArrow(pack, _BLOCK))


def _met(rows: DataFrame, anchors: DataFrame, numbers: list[int]) -> DataFrame:
    """Each block of rows, and after it each block of anchors, whose columns begin with ``a_``; anchors are the few, so they are repeated for every block of rows."""
    every = F.explode(constant_array(numbers, "bigint"))
    repeated = anchors.select(every.alias("block"), *[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    both = rows.unionByName(repeated, allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", F.asc_nulls_first("a_block"))


def _first(found: DataFrame, by: list[str], score: str, partner: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), partner, "label")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         block: int | None = None) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the anchors among ``vectors(vec_id, label, vector)``: for each of an
    anchor's first ``positives`` rows of its label the first ``negatives`` rows of other labels with ``low * positive_score <= 100 * negative_score <=
    high * positive_score``. Runs jobs."""
    spark = vectors.sparkSession
    python_tasks(spark)
    n, dim, n_anchors = vectors.agg(F.count("*"), F.max(F.size("vector")), F.count_if(is_anchor)).first()
    dim = max(64, -(-(dim or 0) // 64) * 64)
    block = block or min(max(4_096, -(-n // max(SPREAD, 4 * spark.sparkContext.defaultParallelism))), ROWS, max(1, COMPONENTS // dim))
    n_blocks = max(1, -(-n // block))
    rows = _blocks(vectors, dim, block, n_blocks)
    anchors = _blocks(vectors.filter(is_anchor), dim, ANCHORS, max(1, -(-n_anchors // ANCHORS))).select("block", *_OWN)
    numbers = [r["block"] for r in rows.select("block").collect()]  # one for thousands of rows

    any_score = [(-(1 << 63), (1 << 63) - 1)]

    def by_anchor(batches: Iterator[pa.RecordBatch], judge) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["a_block"] is None:
                    some = Block.read(row, dim)
                    continue
                ids, labels = (np.frombuffer(row[c], "<i8").tolist() for c in ("a_ids", "a_labels"))
                wanted: list[list] = [[] for _ in ids]
                for p in row.get("a_wanted") or []:
                    wanted[p["slot"]].append(p)
                vectors = _wide(row["a_vectors"], row["a_n"], dim).astype(np.int64)
                found = [(row["a_block"], k, ids[k], *r) for k in range(len(ids)) for r in judge(some, ids[k], labels[k], vectors[k], wanted[k])]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), judge.schema.types)], schema=judge.schema)

    def find_positives(some, own_id, label, vector, _):
        alike = some.part(label)
        (at, score), = _best(alike, vector, alike.ids != own_id, positives, any_score, alike.intervals(vector))
        return [(p, label, s) for p, s in zip(alike.ids[at].tolist(), score.tolist())]

    def find_negatives(some, _, label, vector, wanted):
        # 30 p <= 100 s <= 90 p in whole numbers
        bands = [(-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in wanted]
        if not any(a <= b for a, b in bands):
            return []
        able = np.ones(len(some.ids), bool)
        able[slice(*some.alike(label))] = False
        found = _best(some, vector, able, negatives, bands, some.intervals(vector))
        return [(p["rank"], p["positive_id"], p["positive_score"], i, l, s)
                for p, (at, score) in zip(wanted, found) for i, l, s in zip(some.ids[at].tolist(), some.labels[at].tolist(), score.tolist())]

    def search(anchors: DataFrame, judge, columns: list[str]) -> DataFrame:
        kinds = {c: pa.int32() if c in ("slot", "positive_rank") else pa.int64() for c in columns}
        judge.schema = pa.schema(kinds)
        schema = ", ".join(f"{c} {'int' if t == pa.int32() else 'long'}" for c, t in kinds.items())
        return _met(rows, anchors, numbers).mapInArrow(lambda batches: by_anchor(batches, judge), schema)

    near = search(anchors, find_positives, [*_ANCHOR, "anchor_id", "positive_id", "label", "positive_score"])
    near = cut(_first(near, _ANCHOR, "positive_score", "positive_id", positives))
    wanted = near.groupBy(F.col("anchor_block").alias("block")).agg(F.collect_list(F.struct("slot", "rank", "positive_id", "positive_score")).alias("wanted"))
    far = search(anchors.join(wanted.hint("merge"), "block"), find_negatives, [*_ANCHOR, "anchor_id", "positive_rank", "positive_id", "positive_score", "negative_id", "label", "negative_score"])
    far = _first(far, [*_ANCHOR, "positive_rank"], "negative_score", "negative_id", negatives)
    return far.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
