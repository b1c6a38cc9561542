"""Hard negatives against all pairs."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from flowlens.llm import hard_negatives
from flowlens.llm.queries import QUERIES


def plain(rows, positives=5, negatives=10):
    used = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        used.append((i, [math.floor(256 * float(x)) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, va, la in used:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, v, label in used if i != a)
        for p, pid, _ in [s for s in scored if s[2] == la][:positives]:
            band = [(-s, i) for s, i, label in scored if label != la and 30 * -p <= 100 * -s <= 90 * -p]
            out += [(a, pid, k, i, -p, s) for k, (s, i) in enumerate(band[:negatives], 1)]
    return out


def rows_of(spark, tables):
    return [tuple(r) for r in spark.read.parquet(f"{tables}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]


def test_op13(spark, tables):
    expected = plain(rows_of(spark, tables))
    assert Counter(map(tuple, QUERIES["op13_hard_negatives"](spark, tables).collect())) == Counter(expected)
    assert expected


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    """Several blocks of anchors and rows, anchors that share a task with others, repeated ids and wide numbers."""
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(0, 3) * rng.standard_normal(70) / 3 + 0.2).tolist(), int(rng.integers(0, 4))) for i in range(0, 2_000, 5)]
    rows += [rows[20], rows[21]] + [(2_001, [1e6] * 70, 1), (2_100, [1e6, -3.0], 1), (2_102, [5e5] * 3, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hard_negatives.whole_vectors(df.withColumn("label", label))
    got = hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, block=37).collect()
    want = plain(rows)
    # the repeated anchor (id 100) is two anchors
    assert Counter(map(tuple, got)) == Counter(want)


def test_intervals_hold_every_score():
    rng = np.random.default_rng(3)
    vectors = np.floor(256 * rng.standard_normal((500, 128)) * rng.choice([0, .01, 1, 50], (500, 1))).astype(np.int64)
    block = hard_negatives.Block.make(np.arange(500), np.zeros(500, np.int64), vectors)
    for k in range(0, 500, 25):
        estimate, low, high = block.intervals(vectors[k])
        score = vectors @ vectors[k]
        assert (low <= score).all() and (score <= high).all()
        assert (block.scores(np.arange(500), vectors[k]) == score).all()
    plain_vectors = np.floor(256 * rng.standard_normal((500, 128))).astype(np.int64)
    estimate = hard_negatives.Block.make(np.arange(500), np.zeros(500, np.int64), plain_vectors).intervals(plain_vectors[0])[0]
    assert np.corrcoef(estimate[1:], (plain_vectors @ plain_vectors[0])[1:])[0, 1] > 0.6  # the codes tell something


def test_only_rows_whose_interval_reaches_are_scored(monkeypatch):
    """Without the filter every able row would be scored."""
    rng = np.random.default_rng(4)
    near = np.floor(256 * (np.ones(64) + .1 * rng.standard_normal((50, 64)))).astype(np.int64)
    far = np.floor(256 * (-np.ones(64) + .1 * rng.standard_normal((950, 64)))).astype(np.int64)
    vectors = np.concatenate((near, far))
    block = hard_negatives.Block.make(np.arange(1_000), np.zeros(1_000, np.int64), vectors)
    scored = []
    monkeypatch.setattr(block, "scores", lambda rows, v: scored.append(len(rows)) or vectors[rows] @ v)
    (rows, score), = hard_negatives._best(block, vectors[0], np.arange(1_000) > 0, 5, [(-10**18, 10**18)], block.intervals(vectors[0]))
    assert sum(scored) < 100
    assert score.tolist() == sorted((vectors[1:] @ vectors[0]).tolist(), reverse=True)[:5]


def test_no_anchors_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(hard_negatives.whole_vectors(df), F.col("vec_id") == 0).count() == 0
    assert hard_negatives.mine(hard_negatives.whole_vectors(df.limit(0)), F.col("vec_id") == 0).count() == 0


def test_blocks_are_not_joined_or_broadcast(spark, monkeypatch):
    """Files of anchors are far below Spark's threshold, but every block of rows repeats them; a join would hold the block of rows beside each of them."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(64).tolist(), i % 3) for i in range(600)]
    vectors = hard_negatives.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    held, met = [], hard_negatives._met
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "_met", lambda *a: held.append(met(*a)) or held[-1])
    found = hard_negatives.mine(vectors, F.col("vec_id") % 10 == 0, block=100)
    assert len(held) == 2 and found.count()
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (*held, found)]
    assert "Join" not in plans[0] and not any("Broadcast" in x for x in plans)
    n = {c: held[0].filter(F.col(c).isNotNull()).select("block", "a_block").distinct().count() for c in ("n", "a_n")}
    assert n["n"] > 1 and n["a_n"] > n["n"] and sum(n.values()) == held[0].count()  # no row holds two blocks


def test_blocks_have_numbers_of_their_own(spark):
    """Also those of an id that fills several."""
    rows = [(5, [float(k % 5), 1.0], k % 2) for k in range(100)] + [(100, [2.0, 2.0], 1)]
    vectors = hard_negatives.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    blocks = hard_negatives._blocks(vectors, 64, 6, 2).collect()
    assert len({b["block"] for b in blocks}) == len(blocks) and max(b["n"] for b in blocks) == 12
    assert sum(b["n"] for b in blocks) == 101 and sum(b["n"] == 12 for b in blocks) == 8
    want = plain(rows)
    assert want and Counter(map(tuple, hard_negatives.mine(vectors, F.col("vec_id") == 100, block=6).collect())) == Counter(want)


def test_packed_blocks_are_narrow_and_whole():
    rng = np.random.default_rng(6)
    for scale, width in ((200, 2), (1 << 20, 4), (1 << 40, 8)):
        vectors = rng.integers(-scale, scale, (50, 128))
        labels = np.sort(rng.integers(0, 4, 50))
        block = hard_negatives.Block.make(np.arange(50), labels, vectors)
        row = dict(zip([c.split()[0] for c in hard_negatives._BLOCK.split(", ")], block.packed(3)))
        assert len(row["vectors"]) == 50 * 128 * width
        back = hard_negatives.Block.read(row, 128)
        assert (back.vectors == vectors).all() and (back.codes == block.codes).all()
        for label in range(5):
            assert (back.part(label).vectors == vectors[labels == label]).all()


def test_scores_and_intervals_at_any_width():
    """Sums that single or double precision holds, and others; more than 256 dimensions; few and many rows."""
    rng = np.random.default_rng(7)
    for scale in (100, 1 << 14, 1 << 24):
        vectors = rng.integers(-scale, scale, (300, 320))
        block = hard_negatives.Block.make(np.arange(300), np.zeros(300, np.int64), vectors)
        for rows in (np.array([5, 2]), np.arange(300)):
            assert (block.scores(rows, vectors[0]) == vectors[rows] @ vectors[0]).all()
        _, low, high = block.intervals(vectors[1])
        score = vectors @ vectors[1]
        assert (low <= score).all() and (score <= high).all()


def test_best_of_several_bands():
    """Bands that overlap, lie apart, hold nothing or are void; many equal scores."""
    rng = np.random.default_rng(8)
    vectors = np.floor(256 * rng.standard_normal((800, 64)) / 8).astype(np.int64)
    vectors[400:] = vectors[:400]
    ids, labels = rng.integers(0, 500, 800), rng.integers(0, 3, 800)
    block = hard_negatives.Block.make(ids, labels, vectors)
    able = rng.random(800) < .8
    for k in range(0, 800, 40):
        score = vectors @ vectors[k]
        bands = [(-(1 << 63), (1 << 63) - 1), (10_000, 30_000), (5_000, 12_000), (-40_000, -20_000), (9_000, 9_000), (3, 2), (1 << 40, 1 << 41)]
        found = hard_negatives._best(block, vectors[k], able, 10, bands, block.intervals(vectors[k]))
        for (least, most), (rows, got) in zip(bands, found):
            want = sorted((-s, i, l) for s, i, l, a in zip(score.tolist(), ids.tolist(), labels.tolist(), able) if a and least <= s <= most)[:10]
            assert [(-s, i, l) for s, i, l in zip(got.tolist(), ids[rows].tolist(), labels[rows].tolist())] == want
