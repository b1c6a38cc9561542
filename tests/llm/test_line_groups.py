"""Groups of lines that may match: whole, small, and verified in rows that grow with the lines."""

import random

import numpy as np
from pyspark.sql import functions as F

from flowlens.llm import line_dedup
from tests.llm.test_pipeline import variants


def test_edges_and_words_grow_with_the_variants(spark, monkeypatch):
    """Variants of one line: about one edge for each under a key, its words once, and yet all links."""
    seen = []
    verified = line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda groups, *rest, **more: seen.append(groups.count()) or verified(groups, *rest, **more))
    texts = variants(400, random.Random(3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {k: frozenset(t.split()) for k, t in enumerate(texts)}
    first = {s: min(k for k in sets if sets[k] == s) for s in sets.values()}
    like = {(y, x) for s, x in first.items() for z, y in first.items() if x < y and 10 * len(s & z) >= 8 * len(s | z)}
    assert len(like) > 20 * len(first)
    for hot in (line_dedup.HOT, 50):  # whole, and as pairs of blocks
        found = line_dedup.matches(docs, hot).collect()
        assert {r.doc: r.n_links for r in found} == {k: sum(first[sets[k]] in p for p in like) for k in sets}
        earliest = {k: min((x for y, x in like if y == first[sets[k]]), default=first[sets[k]] if first[sets[k]] < k else None) for k in sets}
        assert {r.doc: r.match_doc for r in found} == earliest
    assert max(seen) <= len(first)
    rows = line_dedup.lines(docs, line_dedup.word_levels(docs))
    assert line_dedup.candidates(rows, connected=True).count() < 12 * len(first) < line_dedup.candidates(rows).count()


def test_long_lines_that_differ_are_no_candidates(spark):
    """The digest grows with the line: lines of hundreds of words with some rare ones in common are told apart, like ones are not lost."""
    rng = np.random.default_rng(2)
    for n in (70, 200, 400, 900):
        rare = [f"r{k}" for k in range(n // 10)]
        texts = [" ".join(rare + [f"w{v}" for v in rng.integers(0, 10**9, n)]) for _ in range(30)]
        texts += [" ".join(t.split()[:-n // 20]) for t in texts]
        texts += [" ".join(w for t in texts[:30] for w in t.split()[n // 2:])]  # so that all words occur more than once
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
        rows = line_dedup.lines(docs, line_dedup.word_levels(docs))
        assert rows.filter(F.size("keys") > 0).count() > 30
        ids = {r.c1: r.doc for r in rows.select("c1", "doc").collect()}
        assert {(ids[r.later], ids[r.earlier]) for r in line_dedup.candidates(rows).collect()} == {(30 + k, k) for k in range(30)}


def test_edges_connect_what_pairs_connect():
    rng = np.random.default_rng(1)
    for n, m in ((5, 3), (60, 40), (300, 500)):
        x, y = rng.integers(0, n, m), rng.integers(0, n, m)
        label = np.arange(n)
        for _ in range(n):
            for a, b in zip(x, y):
                label[[a, b]] = min(label[a], label[b])
        assert (line_dedup._roots(n, x, y) == label).all()
        a, b = line_dedup._stars(x, y)
        assert dict(zip(a.tolist(), b.tolist())) == {k: label[k] for k in set(x.tolist()) | set(y.tolist()) if label[k] != k}


def test_shared_words_by_products_and_by_lookups():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{v}" for v in rng.integers(0, 300, rng.integers(1, 90))) for _ in range(60)]
    words = line_dedup._Words(texts)
    x, y = np.triu_indices(60, 1)
    sets = [set(t.split()) for t in texts]
    expected = [len(sets[a] & sets[b]) for a, b in zip(x, y)]
    assert words._multiplied(x, y).tolist() == expected == words._looked_up(x, y).tolist()
