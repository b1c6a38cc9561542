"""Runs of words against a search of all periods and places."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from flowlens.llm import word_runs
from flowlens.llm.queries import QUERIES


def plain_runs(words, min_length=6, min_power=4):
    found = {}
    for q in range(1, len(words) // min_power + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(min_length, min_power * q):
                found.setdefault((start, i + q - start), q)  # periods come in order, so the smallest stays
            i = max(i, start + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return [w.decode("utf-8") for w in (text or "").encode().split()]


def test_op12(spark, tables):
    rows = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    expected = []
    for doc_id, text in rows:
        words = split(text)
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and words:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
        runs = plain_runs(words) if len(words) < 5_000 else None
        if runs is None:  # too long for the plain search: the one run it was written with
            runs = [(0, len(words), 4)] if len(set(words)) == 4 else pytest.fail("unexpected long text")
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
        expected.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(),
                         hashlib.sha256(collapsed(words, runs).encode()).hexdigest()))
    got = [tuple(r) for r in QUERIES["op12_word_runs"](spark, tables).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert any(e[1] for e in expected)


def test_runs_of_small_alphabets_equal_a_plain_search():
    rng = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 5)):
            words = [str(rng.randint(1, rng.choice([1, 2, 3, 40]))) for _ in range(rng.choice([0, 1, 5, 6, 7, 31, 62, 200]))]
            if rng.random() < .5 and len(words) > 20:
                p, a = rng.randint(1, len(words) // 4), rng.randint(0, len(words) // 3)
                words[a:] = [words[a + i % p] for i in range(len(words) - a)]
                words[rng.randrange(len(words))] = rng.choice([words[0], "x"])
            texts.append(words)
        sizes, runs, left = word_runs._judge([" ".join(w).encode() for w in texts], 6, 4)
        assert sizes == [len(w) for w in texts]
        for words, found, kept in zip(texts, runs, left):
            plain = plain_runs(words)
            assert sorted((r["start"], r["length"], r["period"]) for r in found) == plain
            assert kept.decode() == collapsed(words, plain)


def test_extensions_cross_many_blocks():
    """Equal stretches of thousands of words are measured by the sorted samples, not word by word."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, 5_000)
    x = np.concatenate((x, [-1], x[1_000:], [-2], x[:3_000], [-3]))
    ends = np.flatnonzero(x < 0)
    found = word_runs.Extensions(x)
    i, j = rng.integers(0, len(x), 4_000), rng.integers(0, len(x), 4_000)
    k = rng.integers(0, 3_000, 500)
    i, j = np.concatenate((i, k)), np.concatenate((j, k + 9_002))
    i, j = np.minimum(i, j), np.maximum(i, j)
    i, j = i[i < j], j[i < j]
    for a, b, n in zip(i.tolist(), j.tolist(), found.extend(i, j).tolist()):
        m = 0
        while b + m < len(x) and x[a + m] == x[b + m]:
            m += 1
        assert n == m
    assert len(ends) == 3 and found.extend(np.array([0]), np.array([9_002]))[0] == 3_000


def test_difference_cover():
    assert {(a - b) % word_runs.SPAN for a in word_runs.COVER for b in word_runs.COVER} == set(range(word_runs.SPAN))


def test_awkward_rows_and_clashing_names(spark):
    long = "a b " * 300_000  # more than 1 MB, one run
    rows = [(1, None, "x"), (1, None, "x"), (None, "", "y"), (2, long, None), (3, "w " * 7, "z"), (3, "w " * 7, "z"), (4, "İ " * 6 + "É", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumnRenamed("runs", "n_runs")
    docs = docs.selectExpr("doc_id", "text", "n_runs", "n_runs AS collapsed", "n_runs AS _text")
    got = word_runs.runs(docs)
    assert got.columns == ["doc_id", "n_runs", "_text", "n_words", "runs", "collapsed"]
    found = sorted(((r.doc_id, r.n_runs, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()), key=repr)
    assert found == sorted([(1, "x", 0, [], "")] * 2 + [(None, "y", 0, [], ""), (2, None, 600_000, [(0, 600_000, 2)], "a b")]
                           + [(3, "z", 7, [(0, 7, 1)], "w")] * 2 + [(4, "", 7, [(0, 6, 1)], "İ É")], key=repr)
