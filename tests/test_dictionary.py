"""Dictionary joins, the vendor index and the newline index against the column functions."""

import random
import time

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens import dims
from flowlens.functions import identifiers as idf
from flowlens.functions import targets as tgt
from flowlens.functions import text as txt
from flowlens.operators import dictionary, lines, skew

NAMES = ["email", "userEmail", "customer_name", "name", "nameOfUser", "nameFirst", "shipping-address", "address", "addressLine", "creditCardNumber", "card_number", "IBAN",
         "x", "", "_", "HTTPEmail", "date.of.birth", "pass/word", "user_id_name", "Éclair", None, "ssnEmail", "emailSsn", "billing  address", "accessToken name first"]


def test_names_by_join_equal_the_expression(spark):
    df = spark.createDataFrame([(n,) for n in NAMES + NAMES[:5]], "id string")
    found = dictionary.classify_names(df, dims.dim_pii_token(spark), dims.dim_qualifier(spark)).collect()
    want = {r.id: r.c for r in df.select("id", idf.classify_identifier(F.col("id")).alias("c")).collect()}
    assert {r.id: r.category for r in found} == want and len(found) == len(want)
    assert sum(v is not None for v in want.values()) > 8


def test_snippets_by_join_equal_the_expression(spark):
    rng = random.Random(2)
    words = [n for n in NAMES if n] + ["total", "foo", "phone", "Phone"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for k in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "k int, s string")
    found = {r.k: r.categories for r in dictionary.categories_of(df, "k", "s", dims.dim_pii_token(spark), dims.dim_qualifier(spark)).collect()}
    want = {r.k: r.c or [] for r in df.select("k", idf.categories_in(F.col("s")).alias("c")).collect()}
    assert found == want


def test_places_of_names_are_neither_stored_nor_shuffled(spark, monkeypatch, capsys):
    rows = [(k, " ".join(f"w{(k * 31 + i) % 200}" for i in range(100)) + (" userEmail email cardNumber" if k % 2 else "")) for k in range(50)]
    df = spark.createDataFrame(rows, "k int, s string")
    stored, cut = [], skew.cut

    def counted(frame):
        stored.append(cut(frame))
        return stored[-1]

    monkeypatch.setattr(dictionary, "cut", counted)
    monkeypatch.setattr(skew, "cut", counted)
    found = dictionary.categories_of(df, "k", "s", dims.dim_pii_token(spark), dims.dim_qualifier(spark))
    assert max(f.count() for f in stored) == 203  # the distinct names; there are 5,075 places
    found.explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(id" not in plan and "BroadcastHashJoin [id" in plan
    assert {r.k: r.categories for r in found.collect()} == {k: ["email", "card"] if k % 2 else [] for k, _ in rows}


def test_a_million_tokens_stay_off_the_driver(spark, monkeypatch):
    tokens = spark.range(1_000_000).select(F.concat(F.lit("tok"), "id").alias("token"), F.concat(F.lit("c"), F.col("id") % 1000).alias("cat_id"))
    names = spark.createDataFrame([("tok77",), ("my_tok999999",), ("tok_1000",), ("tok1000000",), ("userName",)], "id string")
    for way in ("collect", "toPandas", "take", "first", "head"):
        monkeypatch.setattr(DataFrame, way, lambda *_: pytest.fail("rows came to the driver"))
    found = dictionary.classify_names(names, tokens, dims.dim_qualifier(spark))
    monkeypatch.undo()
    assert {r.id: r.category for r in found.collect()} == {"tok77": "c77", "my_tok999999": "c999", "tok_1000": "c0", "tok1000000": None, "userName": "name"}


def test_vendors_by_index_equal_the_expression(spark):
    rng = random.Random(3)
    tokens = sorted({"".join(rng.choice("abc") for _ in range(rng.choice([2, 3, 5]))) for _ in range(15)} | {"stripe", "a.b", "pay pal", "d"})
    d = dims.Dictionaries(vendors=[(t, t.upper()) for t in tokens])
    texts = ["".join(rng.choice("abcdx") for _ in range(rng.randint(0, 9))) for _ in range(80)] + ["use.stripe.create", "xxa.bxx", "to pay pal now", "é", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "id string")
    found = {r.id: r.vendor for r in dictionary.match_vendors(df, dims.dim_vendor(spark, d)).collect()}
    want = {r.id: r.v for r in df.select("id", tgt.match_vendor(F.col("id"), d).alias("v")).collect()}
    assert found == want and len({v for v in want.values() if v}) > 4


def test_twenty_thousand_vendors_cost_little_more_than_twenty(spark):
    texts = spark.range(4_000).select(F.concat(F.lit("client.vendor"), F.col("id") * 5, F.lit("q.call")).alias("id"))
    vendors = spark.range(20_000).select(F.concat(F.lit("vendor"), "id", F.lit("q")).alias("token"))
    seconds = []
    for limit in (20, 20, 20_000):  # the first turn only warms up
        start = time.perf_counter()
        found = dictionary.match_vendors(texts, vendors.filter(F.expr(f"cast(substring(token, 7, length(token) - 7) AS int) < {limit}")))
        hits = found.filter("vendor IS NOT NULL")
        assert hits.filter("id <> concat('client.', vendor, '.call')").count() == 0
        assert hits.count() == 4_000 * limit // 20_000
        seconds.append(time.perf_counter() - start)
    assert seconds[2] < 2 * seconds[1] + 2, seconds


def test_lines_of_offsets_equal_line_at(spark):
    texts = {1: "a\nbb\n\nccc", 2: "", 3: "\n", 4: "é\nü\n", 5: None, 6: "x" * 50, 7: "\n" * 30}
    offsets = [(k, o, "tag") for k in texts for o in (-3, 0, 1, 2, 3, 4, 5, 7, 9, 29, 30, 31, 99, None)] + [(8, 1, "no text"), (1, 2, "again"), (1, 2, "again")]
    t = spark.createDataFrame(list(texts.items()), "k int, text string")
    o = spark.createDataFrame(offsets, "k int, byte_offset int, line string").withColumnRenamed("line", "note")
    got = lines.lines_of(t, o, "k").collect()
    plain = o.join(t, "k", "left").select("k", "byte_offset", "note", F.when(F.col("byte_offset").isNotNull(), txt.line_at(F.col("text"), F.greatest("byte_offset", F.lit(0)))))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, plain.collect())))


def test_the_newline_index(spark):
    t = spark.createDataFrame([(1, "aé\n\nb"), (2, "")], "k int, text string")
    assert sorted(map(tuple, lines.line_starts(t, "k").collect())) == [(1, 1, 0), (1, 2, 4), (1, 3, 5), (2, 1, 0)]
