"""Periodic runs of words: every maximal stretch that repeats a shorter one, and the texts with each run cut to one period.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least ``max(MIN_LENGTH, MIN_POWER * q)`` long, that no
neighbouring word extends with period q kept.

1. Words of a batch of texts become numbers (exact, by a table per batch), texts stand one behind the other with a separator of their own.
2. Harmonic grid: a run of period q holds ``(MIN_POWER - 1) * q`` consecutive places i with equal words at i and i + q, so it holds a pair
   (i, i + q) with i a multiple of ``(MIN_POWER - 1) * q``. That makes about n ln n / 3 pairs for n words and all q.
3. The longest common extension of a pair to the right (and, in the reversed array, to the left) gives the stretch. Only suffixes at places
   whose remainder modulo 31 lies in a difference cover of six are sorted, by blocks of 31 words. Any pair of places meets two sorted suffixes
   within 31 words, which are compared one by one; from there a sparse table of range minima over the common prefixes answers.
4. A stretch that was found with several periods keeps the smallest; by the theorem of Fine and Wilf the others are multiples of it.

Texts are independent, so there is no shuffle, and a lost task is simply run again. A task holds one batch of ``WORDS`` words or one text, whichever is
larger. Pairs are made in portions of ``PAIRS``.

Defined results: null text or text without words: no run, empty collapsed text. Rows are independent: repeated rows and ids give
equal results, a null id matters not. An empty table gives an empty result. Columns of the input named like an output are replaced.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import python_tasks

MIN_LENGTH, MIN_POWER = 6, 4
#: A difference cover (fixed values): every remainder modulo ``SPAN`` is a difference of two of its members.
SPAN, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Words that are handled at a time, and pairs of the grid.
WORDS, PAIRS = 1 << 18, 1 << 19

RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))

_PLACE = np.full(SPAN, -1)
_PLACE[list(COVER)] = range(len(COVER))
#: For remainders r and s the least d so that r + d and s + d both lie in the cover.
_SHIFT = np.array([[min(d for d in range(SPAN) if (r + d) % SPAN in COVER and (s + d) % SPAN in COVER) for s in range(SPAN)] for r in range(SPAN)])


class Extensions:
    """Longest common extensions to the right of pairs of places in an array of numbers, in which equal stretches end at separators that occur once."""

    def __init__(self, x: np.ndarray):
        low = min(0, int(x.min(initial=0)))
        # past the end nothing is equal
        self.x = np.concatenate((x, low - 1 - np.arange(2 * SPAN)))
        self.n = len(x)
        self.ranks: np.ndarray | None = None

    def _blocks(self, at: np.ndarray) -> np.ndarray:
        """A number for each block of ``SPAN`` words at the sampled places, equal for equal blocks only."""
        for attempt in itertools.count(1):
            mixed = self.x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)
            mixed ^= mixed >> np.uint64(29)
            base = 0xBF58476D1CE4E5B9 + 2 * attempt
            size = np.zeros(len(at), np.uint64)
            for d in range(SPAN):
                size = size * np.uint64(base) + mixed[at + d]
            size ^= size >> np.uint64(32)
            order = np.argsort(size)
            same = np.flatnonzero(size[order[1:]] == size[order[:-1]])
            a, b = at[order[same]], at[order[same + 1]]
            if all((self.x[a + d] == self.x[b + d]).all() for d in range(SPAN)):
                names = np.zeros(len(at), np.int64)
                names[order[1:]] = np.cumsum(size[order[1:]] != size[order[:-1]])
                return names

    def _sort(self) -> None:
        """Rank the sampled suffixes, note the blocks that neighbours in the order share, and build the table of range minima."""
        c = len(COVER)
        m = -(-self.n // SPAN) * c
        at = np.arange(m) // c * SPAN + np.array(COVER)[np.arange(m) % c]
        levels = [self._blocks(at)]
        while True:
            names, step = levels[-1], c << (len(levels) - 1)
            if names.max(initial=0) == m - 1 or step >= m:
                break
            after = np.full(m, -1, np.int64)
            after[:m - step] = names[step:]
            key = names * (m + 1) + after + 1
            order = np.argsort(key)
            ranked = np.zeros(m, np.int64)
            ranked[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
            levels.append(ranked)
        order = np.argsort(levels[-1], kind="stable")
        a, b = order[:-1].copy(), order[1:].copy()
        shared = np.zeros(max(0, m - 1), np.int32)
        for k in range(len(levels) - 1, -1, -1):
            inside = (a < m) & (b < m)
            same = np.zeros(len(a), bool)
            same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
            shared[same] += 1 << k
            a[same] += c << k
            b[same] += c << k
        self.ranks = np.zeros(m, np.int64)
        self.ranks[order] = np.arange(m)
        self.minima = [shared]
        while (step := 1 << (len(self.minima) - 1)) * 2 <= len(shared):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-step], last[step:]))

    def _blocks_shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Blocks that the suffixes at two sampled places share: a range minimum between their ranks."""
        if self.ranks is None:
            self._sort()
        a, b = (self.ranks[p // SPAN * len(COVER) + _PLACE[p % SPAN]] for p in (i, j))
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.zeros(len(i), np.int64)
        for k in np.unique(level):
            at = level == k
            table = self.minima[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << int(k))])
        return out

    def _word_by_word(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Equal words from two places on, up to a limit of at most ``SPAN`` words."""
        out = limit.copy()
        left = np.arange(len(i))
        for d in range(SPAN):
            left = left[limit[left] > d]
            if not len(left):
                break
            same = self.x[i[left] + d] == self.x[j[left] + d]
            out[left[~same]] = d
            left = left[same]
        return out

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words at the places ``i``, ``j`` and after them; ``i < j`` throughout."""
        to_sample = _SHIFT[i % SPAN, j % SPAN]
        out = self._word_by_word(i, j, to_sample)
        go = np.flatnonzero(out == to_sample)
        if len(go):
            i, j = i[go] + out[go], j[go] + out[go]
            inside = j < self.n  # nothing past the end is equal
            go, i, j = go[inside], i[inside], j[inside]
        if len(go):
            blocks = self._blocks_shared(i, j) * SPAN
            out[go] += blocks + self._word_by_word(i + blocks, j + blocks, np.full(len(go), SPAN))
        return out


def _grid(starts: np.ndarray, sizes: np.ndarray, min_power: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(i, q)``, in portions: for each text and each period that fits, every ``(min_power - 1) * q``-th place with a partner."""
    periods = sizes // min_power
    text = np.repeat(np.arange(len(sizes)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = (min_power - 1) * q
    count = (sizes[text] - q - 1) // step + 1
    ends = np.cumsum(count)
    low = 0
    while low < len(text):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS)))
        n = count[low:high]
        which = np.repeat(np.arange(low, high), n)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        yield starts[text[which]] + nth * step[which], q[which]
        low = high


def find_runs(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, period)`` of all runs of the texts ``x[start:start + size]``, by start and period. Texts are divided by numbers that occur once."""
    right, left = Extensions(x), Extensions(x[::-1])
    found = []
    for i, q in _grid(starts, sizes, min_power):
        same = x[i] == x[i + q]
        i, q = i[same], q[same]
        after = right.extend(i, i + q)
        # places of the reversed array; the left neighbour of place 0 is none
        a, b = len(x) - i - q, len(x) - i
        before = np.zeros(len(i), np.int64)
        inner = i > 0
        before[inner] = left.extend(a[inner], b[inner])
        length = before + after + q
        long = length >= np.maximum(min_length, min_power * q)
        found.append(np.stack([(i - before)[long], length[long], q[long]]))
    runs = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
    first = np.ones(runs.shape[1], bool)
    first[1:] = (runs[0, 1:] != runs[0, :-1]) | (runs[1, 1:] != runs[1, :-1])  # the smallest period of a stretch
    runs = runs[:, first]
    return tuple(runs[:, np.lexsort((runs[2], runs[0]))])


def _judge(texts: list[bytes | None], min_length: int, min_power: int) -> tuple[list, list, list]:
    """Words, runs and collapsed text of each text."""
    words = [(t or b"").split() for t in texts]  # bytes: only ASCII blanks split
    number: dict[bytes, int] = defaultdict(itertools.count().__next__)
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    x = np.zeros(int(sizes.sum()) + len(words), np.int64)
    for k, (w, at) in enumerate(zip(words, starts.tolist())):
        x[at:at + len(w)] = [number[v] for v in w]
        x[at + len(w)] = -1 - k
    start, length, period = find_runs(x, starts, sizes, min_length, min_power)
    dropped = np.zeros(len(x) + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, start + length, -1)
    keep = np.cumsum(dropped)[:-1] == 0
    owner = np.searchsorted(starts, start, side="right") - 1
    bounds = np.searchsorted(owner, np.arange(len(words) + 1))
    rows = np.stack([start - starts[owner], length, period], axis=1) if len(start) else np.zeros((0, 3), np.int64)
    runs = [[dict(zip(("start", "length", "period"), r)) for r in rows[a:b].tolist()] for a, b in zip(bounds, bounds[1:])]
    left = [b" ".join(itertools.compress(w, keep[at:at + len(w)]) if r else w) for w, at, r in zip(words, starts.tolist(), runs)]
    return sizes.tolist(), runs, left


def runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> DataFrame:
    """``docs`` without ``text`` and with ``n_words`` (long), ``runs`` (by start, then period) and ``collapsed``, the words that are left, joined by a blank: a word
    is dropped if a run contains it after that run's first ``period`` words."""
    python_tasks(docs.sparkSession)
    others = [c for c in docs.columns if c not in (text, "n_words", "runs", "collapsed")]
    kinds = [pa.int64(), pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            low, size = 0, 0
            for k in range(batch.num_rows):
                size += len(texts[k].as_buffer() or b"") // 5
                if size >= WORDS or k == batch.num_rows - 1:
                    found = _judge(texts.slice(low, k + 1 - low).to_pylist(), min_length, min_power)
                    part = batch.slice(low, k + 1 - low)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(v, t) for v, t in zip(found, kinds)]],
                                                     names=[*others, "n_words", "runs", "collapsed"])
                    low, size = k + 1, 0

    schema = T.StructType([docs.schema[c] for c in others] + [T.StructField("n_words", T.LongType()), T.StructField("runs", RUN), T.StructField("collapsed", T.BinaryType())])
    numbered = docs.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(others)], F.col(text).cast("binary").alias("text"))  # names may clash with ours
    found = numbered.mapInArrow(run, schema)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
