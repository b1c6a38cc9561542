"""Repeated bytes against a set of all windows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import repeats
from flowlens.llm.queries import QUERIES


def plain(rows, length=100):
    """``(n_bytes, n_removed, n_spans, kept)`` for each (doc_id, text), in order of id."""
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        covered = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p:p + length]
            if w in seen:
                covered[p:p + length] = b"\1" * length
            seen.add(w)
        spans = bytes(covered).replace(b"\0", b" ").split()
        out[doc_id, text] = (len(data), sum(covered), len(spans), bytes(b for b, c in zip(data, covered) if not c))
    return out


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()), key=repr)


def expected(rows, length=100):
    found = plain(rows, length)
    return sorted(((r[0], *found[r]) for r in rows), key=repr)


def test_op11(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, a, b, c, hashlib.sha256(k).hexdigest()) for i, a, b, c, k in expected(rows)]
    assert sorted(map(tuple, QUERIES["op11_repeats"](spark, tables).collect()), key=repr) == sorted(want, key=repr)
    assert any(w[2] for w in want)


def test_merged_shards_stand_in_order_with_their_common_prefixes():
    rng = random.Random(3)
    for _ in range(60):
        source = bytes(rng.choice(b"ab") for _ in range(300))
        sequences = [source[a:a + rng.randint(1, 40)] for a in (rng.randint(0, 250) for _ in range(rng.randint(2, 9)))]
        rounds, shards, ends, names = 6, [], [], []
        for part in (sequences[:len(sequences) // 2], sequences[len(sequences) // 2:]):
            rows = [(s[p:], len(names) + k, p) for k, s in enumerate(part) for p in range(len(s) + 1)]
            rows.sort(key=lambda r: (r[0], r[1]))
            rows.sort(key=lambda r: bool(r[0]))
            # an end of its own for each sequence: compare ends by number
            full = lambda r: [1000 + c for c in r[0]] + [r[1]]
            rows.sort(key=full)
            before = np.array([part[k - len(names)][p - 1] if p else 0 for _, k, p in rows])
            shards.append((np.array([1000 * k + p for _, k, p in rows]), before))
            ends.append(len(part))
            names += part
        order, shared = repeats.merge_shards(shards, ends, rounds)
        text = [names[s // 1000][s % 1000:] for s in order.tolist()]
        assert sorted(order.tolist()) == sorted(s for rows, _ in shards for s in rows.tolist())
        cut = [t[:rounds] for t in text]
        assert cut == sorted(cut)
        for a, b, n in zip(text, text[1:], shared[1:].tolist()):
            common = 0
            while common < min(len(a), len(b), rounds) and a[common] == b[common]:
                common += 1
            assert n == common


@pytest.mark.parametrize("shard", [1, 300, 1 << 20])
def test_later_windows(shard):
    rng = random.Random(shard)
    for _ in range(25):
        alphabet = rng.choice([b"a", b"ab", b"abcdefgh"])
        length, symbol = rng.choice([(100, 20), (12, 4), (9, 3)])
        source = bytes(rng.choice(alphabet) for _ in range(400))
        strings = [source[a:a + rng.randint(length, length + 30)] for a in (rng.randint(0, 400 - length - 30) for _ in range(rng.randint(1, 12)))]
        found = repeats.later_windows(strings, np.arange(len(strings)) << 40, length, symbol, shard)
        seen, want = set(), []
        for k, s in enumerate(strings):
            for p in range(len(s) - length + 1):
                want += [(k, p)] if s[p:p + length] in seen else []
                seen.add(s[p:p + length])
        assert list(zip(*(x.tolist() for x in found))) == want


def passages():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    common, doc = prose(60), prose(80)
    rows = [(k, prose(20) + " " + common + " " + prose(20)) for k in range(12)]
    rows += [(100, doc), (101, doc), (101, doc), (None, doc), (102, doc[:150]), (103, doc[:99]), (104, doc[:100]), (105, doc[30:400] + "é" + doc[400:])]
    rows += [(200, None), (201, ""), (202, "a" * 400), (203, "a" * 250), (204, "ab" * 200), (205, "é" * 300), (206, prose(3)), (207, prose(100) * 3)]
    rows += [(300, common[:130] + "Q" + common[131:]), (301, "Q" + common[1:])]
    return rows


@pytest.mark.parametrize("hot", [2, repeats.HOT])
@pytest.mark.parametrize("frequent", [3, repeats.FREQUENT])
@pytest.mark.parametrize("batch", [7, 10_000])
def test_passages_runs_and_copies(spark, monkeypatch, hot, frequent, batch):
    """Passages between other texts, copies, text that repeats itself; keys that are split to windows, keys that are salted, groups that go over many batches."""
    monkeypatch.setattr(repeats, "FREQUENT", frequent)
    rows = passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    name, old = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(name, batch)
    try:
        assert got(repeats.remove_repeats(docs, hot=hot)) == expected(rows)
    finally:
        spark.conf.set(name, old)


def test_other_lengths_and_texts_over_a_chunk(spark, monkeypatch):
    rows = passages() + [(400, "xy" * 600_000), (401, "z" + "xy" * 100)]  # one text above 1 MB
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {k: v for k, v in plain([r for r in rows if r[0] != 400], 60).items()}
    found = {r[0]: r[1:] for r in got(repeats.remove_repeats(docs, length=60, gram=20, symbol=15)) if r[0] not in (101, 401)}
    assert found.pop(400) == (1_200_000, 1_200_000 - 2, 1, b"xy")
    assert found == {k: v for (k, _), v in want.items() if k not in (101, 401)}
    with pytest.raises(ValueError):
        repeats.remove_repeats(docs, length=100, symbol=30)


def test_columns_of_the_input(spark):
    rows = [(1, "ab " * 60, 5, "x", "y"), (2, "ab " * 60, None, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc long, kept string, version string").withColumn("key", F.lit("k"))
    out = repeats.remove_repeats(docs)
    assert out.columns == ["doc_id", "doc", "version", "key", "n_bytes", "n_removed", "n_spans", "kept"]
    first, second = sorted(out.collect(), key=lambda r: r.doc_id)
    assert (first.doc, first.version, second.version, first.key, bytes(first.kept), bytes(second.kept)) == (5, "y", None, "k", b"ab ", b"")
