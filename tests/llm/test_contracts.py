"""Each query against a plain brute-force version, over awkward rows and the supplied tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import decontaminate, quality, secret_scan, toxicity
from flowlens.llm.queries import QUERIES

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def same(rows, expected):
    assert Counter(map(tuple, rows)) == Counter(expected)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("op")))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_op4(spark, tables):
    assign = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    expected = []
    for doc_id, text in documents(spark, tables):
        text = text or ""
        found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        kinds = Counter(f[2] for f in found)
        expected.append((doc_id, kinds["assign"], kinds["access"], kinds["hex"],
                         sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found)))))
    same(QUERIES["op4_secret_scan"](spark, tables).drop("spans").collect(), expected)


def test_op5(spark, tables):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    rows = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels): r for r in QUERIES["op5_license_scan"](spark, tables).collect()}
    expected = set()
    for doc_id, text in documents(spark, tables):
        words = WORD.findall((text or "").translate(LOWER))
        places = sorted((i, label) for p, label in phrases.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split())
        labels = ",".join(sorted({x for _, x in places}))
        expected.add((doc_id, len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, labels))
    assert set(rows) == expected
    for r in rows.values():
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert not r.labels or r.labels.split(",") == sorted(set(r.labels.split(",")))


def test_op6(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = QUERIES["op6_packing"](spark, tables).collect()
    docs = documents(spark, tables)
    ids = {k: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for k, t in docs}
    covered = Counter()
    for p in pieces:
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own) and 0 < p.length
        assert p.ids_crc32 == zlib.crc32(own[p.start:p.start + p.length].tobytes())
        covered.update((p.doc_id, i) for i in range(p.start, p.start + p.length))
    assert covered == Counter((k, i) for k, v in ids.items() for i in range(len(v)))
    sequences = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert sequences.get(p.sequence_id, 0) == p.offset
        sequences[p.sequence_id] = p.offset + p.length
    total = sum(sequences.values())
    assert max(sequences.values()) <= 4096
    assert sum(4096 - n for n in sequences.values() if n & (n - 1)) <= 0.01 * total


def test_op9(spark, tables):
    expected = []
    for doc_id, text in documents(spark, tables):
        text = text or ""
        words = re.findall("[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
        covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
        expected.append((doc_id, len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)),
                         len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)))
    rows = QUERIES["op9_quality"](spark, tables).collect()
    same([r[:7] for r in rows], expected)
    assert not any(r.kept and r.base_failed for r in rows)


def test_op9_score(spark):
    """The score is the mean log ratio, computed by hand from hashed counts."""
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None)], "doc_id long, text string")
    weight = quality.weights(docs, docs.filter("doc_id = 1").select("doc_id"))
    hashed = docs.select("doc_id", quality.words(F.col("text")).alias("w")).select("doc_id", quality.word_hashes("w").alias("h"))
    grams = hashed.select("doc_id", F.explode(quality._grams("h")).alias("g"))
    by = {}
    for r in grams.collect():
        by.setdefault(r.doc_id, []).append(r.g)
    raw, target, size = Counter(by[1] + by[2]), Counter(by[1]), quality.BUCKETS
    for key, row in {r.doc_id: r for r in quality.judge(docs, weight).collect()}.items():
        g = by.get(key, [])
        plain = sum(np.log((target[x] + 1) / (len(by[1]) + size)) - np.log((raw[x] + 1) / (len(by[1] + by[2]) + size)) for x in g)
        assert row.score == pytest.approx(plain / len(g) if g else 0)


def test_op10(spark, tables):
    items = [(r.item_id, WORD.findall((r.text or "").translate(LOWER))) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    windows = {}
    for item, words in items:
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i:i + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    expected = []
    for doc_id, text in documents(spark, tables):
        words = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                w = tuple(words[i:i + n])
                if w in windows:
                    hit.update(range(i, i + n))
                    found |= windows[w]
        expected.append((doc_id, len(words), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    same(QUERIES["op10_decontamination"](spark, tables).collect(), expected)
    assert any(e[-1] for e in expected)


def test_ledger_scans_only_unseen_pairs(spark, tmp_path):
    from flowlens.llm import secret_scan
    ledger = str(tmp_path / "ledger")
    first = spark.createDataFrame([("a", "token=abcdefgh1"), ("b", "token=abcdefgh1"), ("c", "plain")], "path string, text string")
    assert len({r.path for r in secret_scan.findings(first, ledger, ["path"]).collect() if r.spans}) == 2
    assert spark.read.parquet(ledger).count() == 2
    more = first.union(spark.createDataFrame([("d", "AKIA" + "A" * 12)], first.schema))
    found = {r.path: [s.kind for s in r.spans] for r in secret_scan.findings(more, ledger, ["path"]).collect()}
    assert found == {"a": ["assign"], "b": ["assign"], "c": [], "d": ["access"]}
    assert spark.read.parquet(ledger).count() == 3
    secret_scan.findings(more, ledger, ["path"], rules_version="2")
    assert spark.read.parquet(ledger).groupBy("rules_version").count().count() == 2


def test_a_blob_that_was_scanned_twice_counts_once(spark, tmp_path):
    """Two writers at a time append the same blobs; paths are joined to one of them."""
    ledger = str(tmp_path / "ledger")
    versions = spark.createDataFrame([("a", "token=abcdefghij"), ("b", "token=abcdefghij"), ("c", None)], "path string, text string")
    secret_scan.update_ledger(versions.select("text"), ledger)
    spark.read.parquet(ledger).write.mode("append").parquet(ledger)
    assert sorted(r.path for r in secret_scan.findings(versions, ledger, ["path"]).collect()) == ["a", "b", "c"]


def test_windows_keep_the_run_that_documents_keep(spark):
    text = "a b c a b c a b c a b c d e"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "c a b c a b c a b c"), (2, "b c d e")], "item_id long, text string")
    places = {(r.n, r.start) for r in decontaminate.hits(docs, items).collect()}
    assert places == {(10, 2), (4, 10)}


def plain_fingerprint(text):
    import xxhash
    words = [w for w in re.split("[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest reachable id of each id, by spreading labels until nothing changes."""
    label = dict.fromkeys(prints, None) | {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            low = min(label[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 4)
            if low < label[a]:
                label[a], changed = low, True
    return label


def test_op8(spark, tables):
    docs = documents(spark, tables)
    prints = {k: plain_fingerprint(t) for k, t in docs if k is not None}
    label = plain_components(prints)
    rows = QUERIES["op8_simhash"](spark, tables).collect()
    same([(r.doc_id, r.fingerprint, r.component_id) for r in rows if r.doc_id is not None],
         [(k, f"{prints[k]:016x}", label[k]) for k in prints])
    assert len(rows) == len(docs)


def test_rows_without_id_link_nothing(spark):
    """Fingerprints 0 and 0xFF are eight bits apart; a row without id at 0x0F stands between them."""
    from flowlens.llm import simhash
    prints = spark.createDataFrame([(1, 0, 0), (2, 0, 0xFF), (None, 0, 0x0F)], "doc_id long, version long, fp long")
    real, simhash.prints_of = simhash.prints_of, lambda *_: prints
    try:
        found = {r.doc_id: r.component_id for r in simhash.near_duplicates(None).collect()}
    finally:
        simhash.prints_of = real
    assert found == {1: 1, 2: 2, None: None}


def test_anchors_cover_every_close_pair():
    from flowlens.llm import simhash
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    y = x.copy()
    for k in range(len(y)):
        for bit in rng.choice(64, size=int(rng.integers(0, 5)), replace=False):
            y[k] ^= np.uint64(1) << np.uint64(bit)
    ax, ox = simhash.anchors(x)
    ay, oy = simhash.anchors(y)
    for k in range(len(x)):
        assert set(ax[ox == k].tolist()) & set(ay[oy == k].tolist())
    assert len(ax) == len(set(zip(ax.tolist(), ox.tolist())))


def test_crowded_anchor_equals_all_pairs():
    from flowlens.llm import simhash
    rng = np.random.default_rng(6)
    fps = np.unique(rng.integers(0, 1 << 12, 900).astype(np.uint64) << np.uint64(20))
    got = {tuple(sorted(p)) for i, j in simhash.close_pairs(fps, 4) for p in zip(i.tolist(), j.tolist())}
    i, j = np.triu_indices(len(fps), 1)
    near = np.bitwise_count(fps[i] ^ fps[j]) <= 4
    assert len(fps) > simhash.CROWD and got == set(zip(i[near].tolist(), j[near].tolist()))


def test_components_of_chains_stars_and_loops(spark):
    from flowlens.llm.links import components
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (7, 3), (300, -5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 130)} | {300: -5, -5: -5}


def test_op2(spark, tables):
    docs = {(i, t) for i, t in documents(spark, tables)}
    rows = []
    for doc_id, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            words = frozenset(w for w in re.split("[\x20\x09-\x0D]+", line.translate(LOWER)) if w)
            if words:
                rows.append((float("inf") if doc_id is None else doc_id, k, doc_id, words))
    rows.sort(key=lambda r: r[:2])
    expected = []
    for j, (_, line, doc_id, words) in enumerate(rows):
        match = next((r for r in rows[:j] if 10 * len(words & r[3]) >= 8 * len(words | r[3])), None)
        expected.append((doc_id, line, len(words), match is not None, match[2] if match else None, match[1] if match else None))
    got = QUERIES["op2_line_dedup"](spark, tables).collect()
    same([(r.doc_id, r.line, r.n, r.removed, r.match_doc, r.match_line) for r in got], expected)
    assert any(e[3] for e in expected)


def test_line_variants(spark):
    """Many variants of one line, among them pairs just at the threshold and chains whose first proposal fails."""
    from flowlens.llm import line_dedup
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(400):
        words = list(rng.choice(vocabulary[:14] if k % 3 else vocabulary, size=int(rng.integers(1, 14)), replace=False))
        texts.append((k, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sets = [frozenset(t.split()) for _, t in texts]
    expected = {k for k in range(400) if any(10 * len(sets[k] & sets[j]) >= 8 * len(sets[k] | sets[j]) for j in range(k))}
    got = {r.doc for r in line_dedup.matches(docs).collect() if r.removed}
    assert got == expected and 20 < len(expected) < 380
    left = {r.doc_id for r in line_dedup.remove_lines(docs.withColumn("_extra", F.lit(1))).collect()}
    assert left == set(range(400)) - expected


def test_op3(spark, tables):
    import base64
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{tables}/pages.parquet").collect()]
    low = {}
    for k, payload in sorted(pages):
        low.setdefault(payload, k)
    expected = [(k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if low[p] == k else "revisit",
                 None if low[p] == k else low[p]) for k, p in pages]
    rows = QUERIES["op3_warc"](spark, tables).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    same(rows, expected)


def test_warc_selected_records_and_payloads(spark, tables, tmp_path):
    from flowlens.llm import warc
    pages = spark.read.parquet(f"{tables}/pages.parquet")
    index = warc.write(pages, str(tmp_path / "w"))
    chosen = index.filter("page_id % 2 = 0 AND record_type = 'response'")
    payloads = {r.page_id: r.html or "" for r in pages.collect()}
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read(chosen, str(tmp_path / "w")).collect()}
    assert got == {r.page_id: payloads[r.page_id] for r in chosen.collect()}
    import gzip
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w/archives").iterdir())
    assert data.startswith(b"WARC/1.1\r\n")


def test_ranges_are_read_together_only_when_close():
    from flowlens.llm import warc
    ranges = [(0, 10), (10, 5), (warc.NEAR, 5), (10 * warc.NEAR, 7), (10 * warc.NEAR + 7, warc.MOST_BYTES), (10 * warc.NEAR + 7 + warc.MOST_BYTES, 1)]
    groups = list(warc.coalesced(ranges))
    assert [x for g in groups for x in g] == ranges
    assert [len(g) for g in groups] == [3, 1, 1, 1]


def test_op7(spark, tables):
    docs = documents(spark, tables)
    rows = QUERIES["op7_toxicity"](spark, tables).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_every_clause_counts():
    g = toxicity.Grammar()
    scores = [g.evidence("you idiot. " * n) for n in (1, 3, 4, 30, 300)]
    assert scores == sorted(set(scores))
    assert scores[-1] < 3 * scores[1]


def test_grammar_reads_clauses():
    from flowlens.llm.toxicity import Grammar
    g = Grammar()
    aimed, plain = g.evidence("you are an idiot"), g.evidence("an idiot")
    assert aimed > plain > g.evidence("she is not an idiot, really") > 0
    assert plain > g.evidence('she said "idiot" once') > 0
    assert g.evidence("I will kill you") > 0 == g.evidence("to kill time we read")
    assert g.evidence(None) == g.evidence("") == g.evidence("a fine day") == 0
    assert g.score("you idiot. you moron, you scum") > 0.5 > g.score("")


def test_held_out_accuracy(spark):
    """On supplied tables: languages and toxic documents that were not trained on."""
    from pyspark.sql import functions as F
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    r = QUERIES["op1_language_id"](spark, folder).join(docs, "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert r[0] > 0.97
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    c = {(x.toxic, x.predicted): x["count"] for x in QUERIES["op7_toxicity"](spark, folder).join(labels, "doc_id").filter("held_out")
         .groupBy("toxic", "predicted").count().collect()}
    assert c.get((1, 1), 0) >= 0.6 * (c.get((1, 0), 0) + c.get((1, 1), 0)) and c.get((0, 1), 0) <= 0.05 * (c[(0, 0)] + c.get((0, 1), 0))


def test_packing_keeps_all_three_limits(spark):
    import public_tokenizers
    from flowlens.llm import packing
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(rng.choice(["red", "green", "blue"], size=int(rng.integers(0, 90)))), int(rng.integers(0, 40))) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, asked int").repartition(2)
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), max_tokens=128, max_segments=5, max_loss=90, prompt="asked").collect()
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
    for ps in by.values():
        assert sum(p.length for p in ps) <= 128 and len(ps) <= 5 and sum(p.loss_tokens for p in ps) <= 90
        assert sorted(p.offset for p in ps) == [sum(q.length for q in ps if q.offset < p.offset) for p in sorted(ps, key=lambda p: p.offset)]
    asked = {k: max(1, a) for k, _, a in rows}
    for p in pieces:
        bare = sum(1 for i in range(p.start, p.start + p.length) if i == p.start or i < min(asked[p.doc_id], p.doc_tokens))
        assert p.loss_tokens == p.length - bare
    assert sum(p.length for p in pieces) == sum(len(t.split()) + 1 for _, t, _ in rows)


def test_op2_all_links_and_hot_keys(spark):
    """Every link between different lines comes out once, also where the lines of one key are dealt over blocks."""
    from flowlens.llm import line_dedup
    rng = np.random.default_rng(5)
    texts = {0: "a b c d e f g h i", 1: "a b c d e f g h j k", 2: "a b c d e f g h i j"}
    for k in range(3, 240):
        texts[k] = " ".join(["form", "line", *rng.choice([f"w{i}" for i in range(13)], size=int(rng.integers(5, 12)), replace=False)])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {k: frozenset(t.split()) for k, t in texts.items()}
    classes = {s: min(k for k in sets if sets[k] == s) for s in sets.values()}
    like = {(y, x) for s, x in classes.items() for z, y in classes.items() if x < y and 10 * len(s & z) >= 8 * len(s | z)}
    assert {(2, 0), (2, 1)} <= like and (1, 0) not in like
    found = line_dedup.matches(docs).collect()
    by_class = {r.c1: min(x.doc for x in found if x.c1 == r.c1) for r in found}
    assert [r.n_links for r in sorted(found, key=lambda r: r.doc)] == [sum(classes[sets[k]] in p for p in like) for k in texts]
    pairs = [(by_class[r.later], by_class[r.earlier]) for r in line_dedup.links(docs).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == like
    levels = line_dedup.word_levels(docs)
    rows = line_dedup.lines(docs, levels, hot=8)
    assert rows.filter("exists(busy, x -> x)").count() > 100
    dealt = {(by_class[r.later], by_class[r.earlier]) for r in line_dedup.candidates(rows, hot=8).collect()}
    plain = {(by_class[r.later], by_class[r.earlier]) for r in line_dedup.candidates(line_dedup.lines(docs, levels)).collect()}
    assert dealt == plain and dealt >= like
    keyed = rows.selectExpr("c1", "doc", "line", "n", "d1", "d2", "explode(keys) AS key").selectExpr("key", "c1", "doc", "line", "shiftleft(cast(n AS bigint), 32) AS p", "d1", "d2")
    assert keyed.groupBy("key").count().agg(F.max("count")).first()[0] > 60
    assert line_dedup._dealt(keyed, 8).groupBy("key").count().agg(F.max("count")).first()[0] < 60
