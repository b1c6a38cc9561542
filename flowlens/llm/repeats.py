"""Repeated passages of bytes: every byte covered by a string of ``LENGTH`` bytes that also starts earlier is removed.

All texts are searched as one collection of UTF-8 bytes, in order of document id and place; matches never cross documents, overlaps count, and strings are
judged on the input. Equal windows of ``LENGTH`` bytes are found by merging Burrows-Wheeler transforms:

1. **Keys.** A window's key is the hash of its smallest gram of ``GRAM`` bytes (the last of equals). Equal windows have equal keys, so what has a key of its
   own is no repeat. Neighbouring windows that take their key from one gram are one string, of less than ``2 * LENGTH`` bytes. Keys are counted over all texts.
2. **Classes.** Equal strings under a key are one class from the start, and stand where the first of them stands; all windows of the others repeat. Only classes
   that share a key with another class are compared further.
3. **Shards.** Strings go to bins by key, a bin's strings to shards. A string is read as sequences of symbols of ``SYMBOL`` bytes, one for each
   phase. Each shard sorts its own suffixes and keeps its transform: before each suffix, the symbol that precedes it.
4. **Merge.** An interleave tells for each rank from which shard its suffix comes. A round deals it out by the preceding symbols, stably; after h rounds
   suffixes stand in order of their first h symbols. Where a block of equal suffixes falls apart in round h, neighbours share h - 1 symbols. Five rounds of 20 bytes
   tell all windows apart, and no suffix is sorted again. Intervals of ranks that share ``LENGTH`` bytes are the repeats: the first place stays, all others are marked.
   Neighbours are compared byte by byte at the end, so a hash of a symbol decides nothing. (Classes of a key are told apart by 64 bits and the length.)
5. **Hot keys.** A key with more than ``HOT`` classes (a common passage between texts that differ) is split to single windows, each of which is its own key.

Nothing grows with a group: equal strings combine before they are shuffled, a bin holds about ``BIN`` bytes and a key at most ``HOT`` classes.

Defined results: null text: empty. Documents with a null id come last; different texts under one id are ordered by their hash. Rows that repeat id and text are one
document, each row is returned. Texts under ``LENGTH`` bytes stay. An empty table gives an empty result. Columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .common import bit_set, python_tasks

LENGTH, GRAM, SYMBOL = 100, 32, 20
#: Bytes of text that are handled at a time, bytes of the strings of a bin, suffixes of a shard.
CHUNK, BIN, SHARD = 1 << 18, 1 << 18, 1 << 15
#: Classes under a key from which it is split to single windows, and strings under a key from which they are salted.
HOT, FREQUENT = 1_024, 1 << 16
LAST = (1 << 63) - 1

_U = np.uint64
_PLACE = _U(CHUNK - 1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9)  # odd, so each has an inverse modulo 2**64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(29)
    return h


@cache
def _tables(base: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, and a number for each byte."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(size, b, _U)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1], _mixed((np.arange(256).astype(_U) + _U(1)) * _U(base))


class Hashes:
    """A hash of any stretch of bytes, from running sums modulo 2**64."""

    def __init__(self, data: np.ndarray, base: int):
        size = 1 << max(18, len(data).bit_length())
        up, self.down, values = _tables(base, size)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(values[data] * up[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[stop] - self.sums[start]) * self.down[start])

    def grams(self, size: int) -> np.ndarray:
        n = max(0, len(self.sums) - size)
        return _mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n, span = len(x) - width + 1, 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span:width - span + n])


def keyed(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, length: int, gram: int, contents: bool = True):
    """``(start, windows, key, content)`` of each string of the texts ``data[start:stop]``, in order."""
    n = len(data) - length + 1
    if n <= 0 or not (stops - starts >= length).any():
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, _U),) * 2
    one = Hashes(data, _BASES[0])
    h = one.grams(gram)
    place = np.arange(len(h)).astype(_U)
    least = _least((h & ~_PLACE) | (_PLACE - place), length - gram + 1)
    at = _PLACE - (least & _PLACE)
    inside = np.zeros(n + 1, np.int8)
    full = stops - starts >= length
    inside[starts[full]] = 1
    np.subtract.at(inside, stops[full] - length + 1, 1)
    inside = np.cumsum(inside[:n], dtype=np.int8)
    edge = np.ones(n, bool)
    edge[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])
    low = np.flatnonzero(edge)
    size = np.diff(np.append(low, n))
    used = inside[low] > 0
    low, size = low[used], size[used]
    key = h[at[low].astype(np.int64)]
    return low, size, key, Hashes(data, _BASES[1]).of(low, low + size + length - 1) if contents else key


def _buffers(batches: Iterator[pa.RecordBatch], length: int):
    """Texts in buffers of up to ``CHUNK`` bytes: the bytes, and ``(doc, version, start, stop, place of the start in its text)`` of each piece. Longer texts
    come in pieces that overlap by ``length - 1`` bytes, so each window is in one."""
    pieces, waiting, size = [], [], 0

    def out():
        return np.frombuffer(b"".join(waiting), np.uint8), [np.array(c, np.int64) for c in zip(*pieces)]

    for batch in batches:
        for doc, version, text in zip(*(c.to_pylist() for c in batch.columns)):
            at = 0
            while len(text) - at >= length:
                part = text[at:at + CHUNK] if len(text) > CHUNK else text
                if waiting and size + len(part) > CHUNK:
                    yield out()
                    pieces, waiting, size = [], [], 0
                pieces.append((doc, version, size, size + len(part), at))
                waiting.append(part)
                size += len(part)
                if at + len(part) >= len(text):
                    break
                at += len(part) - length + 1
    if waiting:
        yield out()


def _texts(docs: DataFrame, others: tuple[str, ...] = ()) -> DataFrame:
    """``(doc, version, text)`` with the bytes of each text, after ``others``."""
    return docs.select(*others, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("version"),
                       F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def _arrays(columns, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.view(np.int64)) for c in columns], names=names)


_STRING = ["key", "content", "doc", "version", "low", "n", "salt"]


def _strings(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``_STRING`` rows of the strings whose key occurs more than once (and of a few others). Strings of very frequent keys are salted. Runs jobs."""
    spark = texts.sparkSession

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, (_, _, start, stop, _) in _buffers(batches, length):
            yield _arrays([keyed(data, start, stop, length, gram, contents=False)[2]], ["key"])

    again = cut(texts.mapInArrow(keys, "key long").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    total = again.agg(F.sum("n")).first()[0] or 0
    frequent = again.filter(F.col("n") > max(FREQUENT, total // 10_000)).select("key")  # so there are at most 10,000
    frequent = np.array(sorted(r.key for r in frequent.collect()), np.int64).view(_U)
    # a bounded bit set keeps most other strings from being shuffled
    shared = spark.sparkContext.broadcast((np.array(bit_set(again.select(F.col("key").alias("h"))), np.int64).view(_U), frequent))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, frequent = shared.value
        for data, (doc, version, start, stop, place) in _buffers(batches, length):
            low, n, key, content = keyed(data, start, stop, length, gram)
            may = np.flatnonzero(bits[((key >> _U(6)) & _U(len(bits) - 1)).astype(np.int64)] >> (key & _U(63)) & _U(1))
            low, key = low[may], key[may]
            piece = np.searchsorted(start, low, side="right") - 1
            salt = np.where(np.isin(key, frequent), 1 + (version[piece] & 63), 0)
            yield _arrays([key, content[may], doc[piece], version[piece], low - start[piece] + place[piece], n[may], salt], _STRING)

    return texts.mapInArrow(strings, ", ".join(f"{c} long" for c in _STRING))


_SPLIT = ["kind", "key", "doc", "version", "low", "n"]
LATER, CLASS, HOT_CLASS = 0, 1, 2


def _split(strings: DataFrame, hot: int) -> DataFrame:
    """Strings in order of key, content and place, split into ``_SPLIT`` rows, stored: the windows of all but the first string of each class (kind ``LATER``), and the
    first strings of classes that share their key with another class (``CLASS``, or ``HOT_CLASS`` if more than ``hot`` do or the key is salted). A task streams
    through its rows and keeps no more than the first strings of one key, up to ``hot``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the first row of the class that the last row belongs to
        waiting = None  # first rows of the classes of the last key, which may go on
        flooded = None  # the last key with more than ``hot`` classes

        def rows(kind: np.ndarray, of: dict[str, np.ndarray]) -> pa.RecordBatch:
            return _arrays([kind, *[of[c] for c in _SPLIT[1:]]], _SPLIT)

        for batch in batches:
            if not batch.num_rows:
                continue
            v = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _STRING}
            before = {c: np.concatenate((last[c] if last else v[c][:1] + 1, v[c][:-1])) for c in ("key", "content", "n")}
            new = (v["key"] != before["key"]) | (v["content"] != before["content"]) | (v["n"] != before["n"])
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            later = np.zeros(len(new), bool)
            for c in ("doc", "version", "low"):  # a row that is repeated in the input does not follow itself
                own = v[c][np.maximum(first, 0)]
                later |= v[c] != (np.where(first < 0, last[c], own) if last else own)
            yield rows(np.full(int(later.sum()), LATER), {c: v[c][later] for c in _SPLIT[1:]})
            if first[-1] >= 0:
                last = {c: v[c][first[-1]:first[-1] + 1] for c in _STRING}
            opens = {c: v[c][new] if waiting is None else np.concatenate((waiting[c], v[c][new])) for c in _STRING}
            waiting = None
            if not len(opens["key"]):
                continue
            edge = np.flatnonzero(np.concatenate(([True], opens["key"][1:] != opens["key"][:-1])))
            size = np.diff(np.append(edge, len(opens["key"])))
            crowded = (size > hot) | (opens["salt"][edge] > 0)
            if flooded is not None:
                crowded |= opens["key"][edge] == flooded
            kind = np.where(crowded, HOT_CLASS, np.where(size > 1, CLASS, LATER))
            if opens["key"][-1] == v["key"][-1]:
                if crowded[-1]:
                    flooded = opens["key"][-1]
                else:
                    waiting = {c: opens[c][edge[-1]:] for c in _STRING}
                    kind[-1] = LATER
            kind = np.repeat(kind, size)
            yield rows(kind[kind != LATER], {c: opens[c][kind != LATER] for c in _SPLIT[1:]})
        if waiting is not None and len(waiting["key"]) > 1:
            yield rows(np.full(len(waiting["key"]), CLASS), waiting)

    tasks = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = strings.repartition(tasks, "key", "salt").sortWithinPartitions("key", "content", "n", "doc", "version", "low")
    return cut(dealt.mapInArrow(run, ", ".join(f"{c} long" for c in _SPLIT)))


def _with_bytes(spots: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """``spots(doc, version, low, n, key)`` with ``bytes``, the string."""
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spots")
            values, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            low, n, key = (values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            texts = batch.column("text").to_pylist()
            found = [texts[o][a:a + m + length - 1] for o, a, m in zip(owner.tolist(), low.tolist(), n.tolist())]
            yield _arrays([batch.column("doc").take(pa.array(owner)), batch.column("version").take(pa.array(owner)), low, n, key,
                           pa.array(found, pa.binary())], ["doc", "version", "low", "n", "key", "bytes"])

    listed = spots.groupBy("doc", "version").agg(F.collect_list(F.struct("low", "n", "key")).alias("spots"))  # a text's own strings
    return texts.join(listed, ["doc", "version"]).mapInArrow(take, "doc long, version long, low long, n long, key long, bytes binary")


def _suffix_order(symbol: np.ndarray, after: np.ndarray, ends: int) -> np.ndarray:
    """Suffixes of one shard in order. The first ``ends`` are empty ones, each with an end of its own; ``after`` is the suffix without its first symbol."""
    rank = np.where(np.arange(len(symbol)) < ends, np.arange(len(symbol)), ends + symbol)
    while True:
        key = rank * (rank.max(initial=0) + 1) + rank[after]
        order = np.argsort(key)
        new = np.ones(len(key), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        if new.all():
            return order
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(new) - 1
        after = after[after]


def _dealt(symbol: np.ndarray) -> np.ndarray:
    """Order by symbol, equal ones as they stand: 16 bits at a time."""
    order = np.argsort(symbol.astype(np.uint16), kind="stable")
    if symbol.max(initial=0) >> 16:
        order = order[np.argsort((symbol >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def merge_shards(shards: list[tuple[np.ndarray, np.ndarray]], ends: list[int], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge the transforms of shards. A shard is ``(suffix at each rank, symbol before it)``, symbol 0 before a whole sequence, and its first ``ends``
    ranks are the empty suffixes. Result: suffixes in the order of their first ``rounds`` symbols, and how many symbols each shares with the one before it, up to ``rounds``."""
    suffix, before = (np.concatenate(c) for c in zip(*shards))
    source = np.repeat(np.arange(len(shards)), [len(s) for s, _ in shards]).astype(np.uint16)
    top = np.repeat(np.arange(len(shards)), ends).astype(np.uint16)
    # suffixes of one shard never change their order, so the interleave alone tells which suffix stands where
    row = np.arange(len(suffix))
    block, shared = np.zeros(len(suffix), np.int64), np.zeros(len(suffix), np.int64)
    for _ in range(rounds):
        symbol = before[row]
        order = _dealt(symbol)[len(top):]
        source = np.concatenate((top, source[order]))
        apart = np.ones(len(order), bool)
        apart[1:] = (symbol[order[1:]] != symbol[order[:-1]]) | (block[order[1:]] != block[order[:-1]])
        block = np.concatenate((np.arange(len(top)), len(top) - 1 + np.cumsum(apart)))
        shared[len(top):] += ~apart
        row = np.empty_like(row)
        row[np.argsort(source, kind="stable")] = np.arange(len(row))
    return suffix[row], shared


def later_windows(strings: list[bytes], rank: np.ndarray, length: int, symbol: int, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """``(string, window)`` of all windows of ``strings`` that equal a window of smaller ``rank + window``, by string and window."""
    rounds = length // symbol
    data = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings], np.int64)
    begin = np.cumsum(sizes) - sizes
    counts = sizes - symbol + 1  # suffixes with a symbol at least
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(strings)), counts)
    place = np.arange(len(owner)) - first[owner]
    at = begin[owner] + place
    for base in _BASES:
        names, number = np.unique(Hashes(data, base).grams(symbol)[at], return_inverse=True)
        shards, ends = [], []
        cuts = np.unique(np.append(np.searchsorted(np.cumsum(counts), np.arange(0, counts.sum(), shard)), len(strings)))
        for low, high in zip(cuts, cuts[1:]):
            a, n_ends = first[low], (high - low) * symbol
            b = first[high] if high < len(strings) else len(owner)
            p, o, own = place[a:b], owner[a:b] - low, number[a:b] + 1
            end = o * symbol + p % symbol
            inner = p + symbol < counts[low:high][o]
            after = np.where(inner, n_ends + np.arange(b - a) + symbol, end)
            before = np.zeros(n_ends + b - a, np.int64)
            before[n_ends:][p >= symbol] = own[np.flatnonzero(p >= symbol) - symbol]
            before[end[~inner]] = own[~inner]
            order = _suffix_order(np.concatenate((np.zeros(n_ends, np.int64), own)), np.concatenate((np.arange(n_ends), after)), n_ends)
            shards.append((np.where(order < n_ends, -1, a + order - n_ends), before[order]))
            ends.append(n_ends)
        suffix, shared = merge_shards(shards, ends, rounds)
        linked = np.flatnonzero(shared >= rounds)  # ranks that share a whole window with the rank before
        windows = np.lib.stride_tricks.sliding_window_view(data, length) if len(data) >= length else np.zeros((0, length), np.uint8)
        if all((windows[at[suffix[linked[k:k + 4096]]]] == windows[at[suffix[linked[k:k + 4096] - 1]]]).all() for k in range(0, len(linked), 4096)):
            break
    else:
        raise ArithmeticError("three hashes of symbols collide in one bin")
    member = np.unique(np.concatenate((linked, linked - 1)))
    opens = np.flatnonzero(shared[member] < rounds)
    node = suffix[member]
    when = rank[owner[node]] + place[node]
    earliest = np.minimum.reduceat(when, opens) if len(opens) else when
    later = when > np.repeat(earliest, np.diff(np.append(opens, len(member))))
    node = np.sort(node[later])
    return owner[node], place[node]


def _merged(strings: DataFrame, length: int, symbol: int, n_bins: int) -> DataFrame:
    """``(doc, version, start, stop)`` of the windows that equal an earlier one, of strings ``(doc, version, low, n, key, bytes)`` in bins."""
    names = ["doc", "version", "start", "stop"]

    def search(doc, version, low, texts) -> pa.RecordBatch:
        order = np.lexsort((low, version, doc))
        doc, version, low = doc[order], version[order], low[order]
        texts = [texts[k] for k in order.tolist()]
        new = np.zeros(len(doc), np.int64)
        new[1:] = (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])
        string, window = later_windows(texts, (np.cumsum(new) << 40) + low, length, symbol)
        opens = np.ones(len(string), bool)
        opens[1:] = (string[1:] != string[:-1]) | (window[1:] != window[:-1] + 1)
        opens = np.flatnonzero(opens)
        closes = np.append(opens[1:], len(string)) - 1 if len(opens) else opens
        own = string[opens]
        return _arrays([doc[own], version[own], low[own] + window[opens], low[own] + window[closes] + 1], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        last = None

        def out():
            return search(*[np.concatenate(c) for c in list(zip(*parts))[:3]], [t for p in parts for t in p[3]])

        for batch in batches:
            bins = batch.column("bin").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(bins, prepend=-1)).tolist() + [len(bins)]
            for a, b in zip(edges, edges[1:]):
                if parts and bins[a] != last:
                    yield out()
                    parts = []
                last = bins[a]
                some = batch.slice(a, b - a)
                parts.append((*[some.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "version", "low")], some.column("bytes").to_pylist()))
        if parts:
            yield out()

    tasks = max(int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_bins // 32)
    binned = strings.select("doc", "version", "low", "bytes", F.pmod(F.xxhash64("key"), F.lit(n_bins)).alias("bin"))
    return binned.repartition(tasks, "bin").sortWithinPartitions("bin").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _by_window(strings: DataFrame, length: int) -> DataFrame:
    """``(doc, version, start, stop)`` of the later windows of strings under hot keys, window by window."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "version", "low", "n")]
            data = np.frombuffer(b"".join(batch.column("bytes").to_pylist()), np.uint8)
            n = columns[3]
            owner = np.repeat(np.arange(len(n)), n)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            at = (np.cumsum(n + length - 1) - n - length + 1)[owner] + nth
            doc, version, low = (c[owner] for c in columns[:3])
            one, two = (Hashes(data, b).of(at, at + length) for b in _BASES[:2])
            yield _arrays([one, doc, version, low + nth, np.ones(len(owner), np.int64), two], [*_SPLIT[1:], "content"])

    spread = cut(strings.mapInArrow(windows, ", ".join(f"{c} long" for c in _SPLIT[1:] + ["content"])))
    place = F.struct("doc", "version", "low")
    first = cut(spread.groupBy("key", "content").agg(F.min(place).alias("first"), F.count("*").alias("size")).filter("size > 1").drop("size"))
    later = spread.join(first, ["key", "content"]).filter(F.col("first") != place)  # two stored sides, so hot windows are split
    return later.select("doc", "version", F.col("low").alias("start"), (F.col("low") + F.col("n")).alias("stop"))


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, symbol: int = SYMBOL, hot: int = HOT) -> DataFrame:
    """``(doc, version, start, stop)``: the starts, in ranges, of all windows of ``length`` bytes of ``docs(doc_id, text)`` that also start earlier. Ranges of a text may
    overlap. ``symbol`` divides ``length``, and ``gram`` is less than ``length``. Runs jobs."""
    if length % symbol or not 0 < gram < length or 3 * symbol > length:
        raise ValueError("symbol must divide length at least three times, gram must be shorter than length")
    python_tasks(docs.sparkSession)
    texts = _texts(docs)
    split = _split(_strings(texts, length, gram), hot)
    kind = F.col("kind")
    n_bytes, n_hot = split.agg(F.sum(F.when(kind == CLASS, F.col("n") + length - 1)), F.count_if(kind == HOT_CLASS)).first()
    found = [split.filter(kind == LATER).select("doc", "version", F.col("low").alias("start"), (F.col("low") + F.col("n")).alias("stop")),
             _merged(_with_bytes(split.filter(kind == CLASS), texts, length), length, symbol, max(1, (n_bytes or 0) // BIN))]
    if n_hot:
        found.append(_by_window(_with_bytes(split.filter(kind == HOT_CLASS), texts, length), length))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, symbol: int = SYMBOL, hot: int = HOT) -> DataFrame:
    """``docs`` without ``text`` and with ``n_bytes``, ``n_removed``, ``n_spans`` (long) and ``kept`` (binary): the bytes that no later string of ``length`` bytes covers.
    ``n_spans`` counts maximal removed stretches. Kept bytes need not be valid UTF-8, as strings start at any byte. Runs jobs."""
    outputs = ["n_bytes", "n_removed", "n_spans", "kept"]
    others = [c for c in docs.columns if c not in ("text", *outputs)]
    found = repeated_windows(docs.select("doc_id", "text"), length, gram, symbol, hot)
    spans = cut(found.groupBy("doc", "version").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))  # of one text
    numbers = tuple(f"_{k}" for k in range(len(others)))  # names of the input may clash with ours
    own = _texts(docs.select(*[F.col(c).alias(n) for n, c in zip(numbers, others)], "doc_id", "text"), numbers)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, parts, left = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                at, kept, gone, n = 0, [], 0, 0
                for start, stop in sorted((s["start"], s["stop"] + length - 1) for s in spans or []):
                    if start > at or not n:
                        kept.append(text[at:start])
                        n += 1
                        at = start
                    if stop > at:
                        gone += stop - at
                        at = stop
                kept.append(text[at:])
                removed.append(gone)
                parts.append(n)
                left.append(b"".join(kept))
            sizes = pa.array([len(t) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(others)], sizes, pa.array(removed, pa.int64()), pa.array(parts, pa.int64()), pa.array(left, pa.binary())],
                                             names=[*others, *outputs])

    schema = T.StructType([docs.schema[c] for c in others] + [T.StructField(c, T.LongType()) for c in outputs[:3]] + [T.StructField("kept", T.BinaryType())])
    return own.join(spans, ["doc", "version"], "left").select(*numbers, "text", "spans").mapInArrow(strip, schema)
