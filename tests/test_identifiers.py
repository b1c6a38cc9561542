import random

import pytest
from pyspark.sql import functions as F

from flowlens import dims
from flowlens.functions import identifiers as idf

# written by hand: names of some categories, then names that only come close
NAMED = {"contactEmail": "email", "EMAIL_ADDRESS": "email", "legalName": "name", "home_phone": "phone", "user_password": "password"}
NEAR_MISSES = ["nameless", "addressee", "fullness", "tablename", "hostName", "passwords2go", "phonebook", "x", "_", "snn", "first_shared_name"]


def one(spark, names, d=dims.BUILTIN):
    df = spark.createDataFrame([(n,) for n in names], "id string")
    return {r.id: r.c for r in df.select("id", idf.classify_identifier(F.col("id"), d).alias("c")).collect()}


def lists(spark, snippets, d=dims.BUILTIN):
    df = spark.createDataFrame([(s,) for s in snippets], "s string")
    return {r.s: r.c for r in df.select("s", idf.categories_in(F.col("s"), d).alias("c")).collect()}


def test_dictionary_size():
    assert len(dims.builtin_pii_tokens()) == 64
    assert len(dims.PII_CATEGORIES) == 16 and len(dims.VENDORS) == 20 and len(dims.INFRA_TOKENS) == 19


def test_every_dictionary_word_in_any_spelling(spark):
    """Whatever stands around a dictionary word, it is found; alone, in capitals, or as a part."""
    rng = random.Random(11)
    expected = {}
    for token, category, *_ in dims.builtin_pii_tokens():
        for spelled in (token, token.upper(), token.capitalize(), f"the_{token}", f"old{token.capitalize()}", f"{token}_q{rng.randint(0, 9)}"):
            expected[spelled] = category
    got = one(spark, expected)
    # a spelling may also be a longer entry of another category, or be preceded by one; both name a category
    same = sum(got[k] == v for k, v in expected.items())
    assert None not in got.values() and same > 0.97 * len(expected)


@pytest.mark.parametrize("word, qualifiers, category", [
    ("name", dims.NAME_QUALIFIERS, "name"), ("address", dims.ADDRESS_QUALIFIERS, "address")])
def test_a_qualifier_counts_next_to_the_word_only(spark, word, qualifiers, category):
    known = {t for t, *_ in dims.builtin_pii_tokens()}
    free = [q for q in qualifiers if q not in known and q + word not in known and word + q not in known]
    assert free
    beside = [x for q in free for x in (f"{q}_{word}_zz", f"zz_{word}_{q}", f"zz{q.capitalize()}{word.capitalize()}Zz")]
    apart = [x for q in free for x in (f"{q}_zz_{word}", f"{word}_zz_{q}")]
    got = one(spark, beside + apart)
    assert {got[x] for x in beside} == {category} and {got[x] for x in apart} == {None}


def test_by_hand(spark):
    assert one(spark, [*NAMED, *NEAR_MISSES]) == {**NAMED, **dict.fromkeys(NEAR_MISSES)}


def test_lists_are_in_the_order_of_the_text_and_distinct(spark):
    words = ["email", "ssn", "phone", "password"]
    rng = random.Random(12)
    cases = {}
    for _ in range(60):
        chosen = [rng.choice(words) for _ in range(rng.randint(0, 6))]
        text = "(" + ", ".join(f"zq{rng.randint(0, 99)}.{w}" for w in chosen) + ")"
        cases[text] = [dict((t, c) for t, c, *_ in dims.builtin_pii_tokens())[w] for w in dict.fromkeys(chosen)]
    assert lists(spark, cases) == cases


def test_a_snippet_is_the_sum_of_its_identifiers(spark):
    """Classifying a snippet at once gives what its identifiers give one by one."""
    rng = random.Random(13)
    parts = [t for t, *_ in dims.builtin_pii_tokens()] + ["name", "address", "first", "billing", "zz", "é", "K9"]
    snippets = sorted({"".join(rng.choice([w, w.title(), w.upper()]) + rng.choice(["", "_", " ", ".", "(", "7", "\n"])
                               for w in rng.choices(parts, k=rng.randint(1, 6))) for _ in range(800)})
    rows = spark.createDataFrame([(s,) for s in snippets], "s string").select("s", F.posexplode(idf.identifiers(F.col("s"))).alias("i", "id"))
    each = rows.withColumn("c", idf.classify_identifier(F.col("id"))).filter("c IS NOT NULL").collect()
    expected = {s: [] for s in snippets}
    for r in sorted(each, key=lambda r: r.i):
        if r.c not in expected[r.s]:
            expected[r.s].append(r.c)
    assert lists(spark, snippets) == expected and sum(map(bool, expected.values())) > 300


def test_own_dictionary(spark):
    tokens = spark.createDataFrame([("badge", "badge", "Badge", "special")], dims.dim_pii_token(spark).schema)
    d = dims.Dictionaries.from_frames(pii_tokens=tokens)
    assert lists(spark, ["(badgeId, email)", "(first_name)"], d) == {"(badgeId, email)": ["badge"], "(first_name)": ["name"]}


def test_dictionary_with_two_labels_is_refused():
    with pytest.raises(ValueError):
        dims.Dictionaries(pii_tokens=[("a", "x", "X", "pii"), ("b", "x", "Y", "pii")])


def test_twenty_thousand_tokens(spark):
    """A dictionary of any size is one constant, and finds what a small one finds."""
    d = dims.Dictionaries(pii_tokens=[(f"tok{i}", f"c{i % 7}", f"C{i % 7}", "pii") for i in range(20_000)],
                          vendors=[(f"vendor{i:05d}", f"V{i}") for i in range(6_000)])
    names = {"tok19999": "c0", "aTok123": "c4", "tok20000": None, "my_tok_77": "c0", "tok_1_x": None, "x_tok5_y": "c5"}
    assert one(spark, names, d) == {**names, "my_tok_77": None}
    from flowlens.functions.targets import match_vendor
    df = spark.createDataFrame([("call.vendor05999.vendor00042",), ("vendor99999",)], "c string")
    assert [r[0] for r in df.select(match_vendor(F.col("c"), d)).collect()] == ["vendor00042", None]
