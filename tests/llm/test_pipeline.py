"""The pipeline stage by stage against plain versions."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from flowlens.llm import line_dedup
from flowlens.session import cut
from tests.llm.test_contracts import LOWER, WORD, plain_components


def rows(df):
    return {(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()}


def plain_prints(text, k=4):
    import xxhash
    words = [w for w in re.split("[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_lines(docs):
    """Texts without lines that match an earlier one; documents that lose all lines with words go."""
    seen, out = [], set()
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        kept, had = [], False
        for line in (text or "").split("\n"):
            words = frozenset(w for w in re.split("[\x20\x09-\x0D]+", line.translate(LOWER)) if w)
            had |= bool(words)
            if not words or not any(10 * len(words & s) >= 8 * len(words | s) for s in seen):
                kept.append((line, bool(words)))
            if words:
                seen.append(words)
        if not had or any(w for _, w in kept):
            out.add((doc_id, text if text is None else "\n".join(x for x, _ in kept)))
    return out


def plain_contaminated(docs, items):
    windows = set()
    for text in items:
        words = WORD.findall((text or "").translate(LOWER))
        n = min(10, len(words))
        windows |= {tuple(words[i:i + n]) for i in range(len(words) - n + 1) if n}
    sizes = {len(w) for w in windows}
    out = set()
    for doc_id, text in docs:
        words = WORD.findall((text or "").translate(LOWER))
        if any(tuple(words[i:i + n]) in windows for n in sizes for i in range(len(words) - n + 1)):
            out.add((doc_id, text))
    return out


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    items = [r.text for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    results = [docs]
    for _, stage in corpus_pipeline.STAGES:
        results.append(cut(stage(spark, results[-1], tables)))
    assert all(r.columns == columns for r in results[:-1])
    raw, spoken, lined, single, clean = map(rows, results[:-1])
    assert {(i, t) for i, t in raw - spoken if t and len(re.findall(r"[^\W\d_]", t)) > 40} == set()
    assert all(t and re.search(r"[^\W\d_]", t) for _, t in spoken)
    assert lined == plain_lines(spoken)
    prints = {(float("inf") if i is None else i, t or ""): plain_prints(t) for i, t in lined}
    label = plain_components(prints)
    assert single == {(None if k[0] == float("inf") else k[0], k[1]) for k in prints if label[k] == k}
    assert clean == single - plain_contaminated(single, items)
    pieces = results[-1].collect()
    assert {p.doc_id for p in pieces} == {i for i, _ in clean}
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_repeated_rows_and_empty_tables(spark, awkward, empty):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    once = rows(corpus_pipeline.remove_near_duplicates(spark, docs, awkward))
    twice = corpus_pipeline.remove_near_duplicates(spark, docs.union(docs), awkward)
    assert rows(twice) == once and twice.count() == len(once)
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_columns_with_clashing_names(spark, awkward):
    """Columns that are named like what operators use inside change nothing and come through."""
    docs = spark.read.parquet(f"{awkward}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    extra = {c: F.lit(f"own {c}") for c in ("doc", "version", "line", "n", "fp", "component", "k", "w", "window", "found", "lang_pred", "score", "c1")}
    wide = docs.withColumns(extra)
    for name, stage in corpus_pipeline.STAGES:
        plain, full = stage(spark, docs, awkward), stage(spark, wide, awkward)
        if name == "packing":
            assert full.count() == plain.count()
            continue
        assert full.columns == wide.columns and rows(full) == rows(plain), name
        assert {tuple(r) for r in full.select(*extra).distinct().collect()} <= {tuple(f"own {c}" for c in extra)}


def test_near_duplicates_by_fingerprint(spark):
    """Groups are components of fingerprints of four-word shingles within four bits; of each the smallest id stays."""
    import random
    rng = random.Random(4)
    texts = []
    for k in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
        texts += [" ".join(words)] * (1 + k % 3)
        for edits in (1, 2, 40):
            changed = list(words)
            for at in rng.sample(range(600), edits):
                changed[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(changed))
    docs = list(enumerate(texts))
    label = plain_components({d: plain_prints(d[1]) for d in docs})
    expected = {d[0] for d in docs if label[d] == d}
    found = corpus_pipeline.remove_near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {r.doc_id for r in found.collect()} == expected
    assert 30 < len(expected) < len(docs) - 30


def variants(n, rng):
    """Lines of one form, so alike that many pairs are just above or just below the threshold."""
    base = [f"w{k}" for k in range(46)]
    out = []
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(46), rng.choice([0, 1, 2, 3, 4])):
            words[at] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_removal_by_rounds_equals_all_pairs(spark):
    """Every round decides what it can; with one round the rest is compared in full. Hot keys are split."""
    import random
    rng = random.Random(7)
    docs = [(k, "\n".join(variants(5, rng) + ["", "unlike any " + str(k)])) for k in range(40)] + [(None, "w1 w2 w3\nw1 w2 w3"), (3, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    expected = plain_lines(docs)
    assert rows(line_dedup.remove_lines(df)) == expected
    for rounds, hot in ((1, 1 << 15), (0, 1 << 15), (2, 16)):
        found = line_dedup.removals(df, rounds, hot).filter("removed").select("doc", "line").collect()
        plain = line_dedup.matches(df).filter("removed").select("doc", "line").collect()
        assert sorted(map(tuple, found)) == sorted(map(tuple, plain))


def test_removal_verifies_in_proportion_to_the_group(spark, monkeypatch):
    """Twice the variants of one line make about twice the pairs that are verified, not four times."""
    import random
    counts = []
    verified = line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, *rest: counts.append(pairs.count()) or verified(pairs, *rest))
    totals = []
    for n in (250, 500, 1_000):
        df = spark.createDataFrame(list(enumerate(variants(n, random.Random(n)))), "doc_id long, text string")
        counts.clear()
        line_dedup.removals(df).count()
        totals.append(sum(counts))
    assert totals[2] < 3 * totals[1] < 9 * totals[0] and totals[2] < 12 * 1_000
