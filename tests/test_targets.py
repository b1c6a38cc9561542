import pytest
from pyspark.sql import functions as F

from checks.inputs import VOCABULARY
from flowlens.functions import targets as tgt
from flowlens.operators.merge import keep_classified

VOCABULARY_TARGETS = [
    "store:db", "store:db", "store:cache", "store:object", "store:mongo", "store:dynamo", "store:cache", "ext:stripe",
    "ext:segment", "ext:comms", "ext:comms", "ext:stripe", "ext:api.partner-site.io", "ext:http", "ext:http",
    "ext:localhost", "sink:log", "sink:log", "sink:log", None, "store:db", "ext:sentry", "ext:http", None,
]
# callee, text, (id, label, kind)
CASES = [
    ("user_repo.insert", "", ("store:db", "Data store", "store")),
    ("db.save", "", ("store:db", "Database", "store")),
    ("notify", "", ("ext:comms", "Email / messaging", "external")),
    ("notifyAll", "", None),
    ("stripe.log", "", ("ext:stripe", "Stripe", "external")),          # vendor before log
    ("mailer.log", "", ("ext:comms", "Email / messaging", "external")),  # messaging before log
    ("api.get", "https://Api.Example.org/x", ("ext:Api.Example.org", "Api.Example.org", "external")),
    ("api.get", "HTTPS://up.io", ("ext:http", "External HTTP", "external")),
    ("api.get", "https://test.io", ("ext:http", "External HTTP", "external")),
    ("api.get", "http://my-HubSpot.io", ("ext:hubspot", "HubSpot", "external")),
    ("api.get", "https://first.io https://api.stripe.com", ("ext:first.io", "first.io", "external")),
    ("fetch", "", ("ext:http", "External HTTP", "external")),
    ("client.log", "", ("sink:log", "Logs", "sink")),
    ("x.error", "", ("sink:log", "Logs", "sink")),
    ("a->log", "", ("sink:log", "Logs", "sink")),
    ("logger.anything", "", ("sink:log", "Logs", "sink")),
    ("mylogger.anything", "", None),
    ("bucket.cache.put", "", ("store:object", "Object store", "store")),  # first word decides
    ("DB::Execute", "", ("store:db", "Database", "store")),
    ("list.add", "", None),
    ("  db.save  ", "", ("store:db", "Database", "store")),
    ("db.\nsave", "", None),
    ("étable.add", "", ("store:db", "Database", "store")),  # an accented letter is no word character
]


def calls(spark, rows):
    return spark.createDataFrame([(i, c, "(" + u + ")", c + "(" + u + ")") for i, (c, u) in enumerate(rows)],
                                 "n int, callee string, args_text string, full_text string")


def test_vocabulary(spark):
    rows = tgt.with_target(calls(spark, VOCABULARY)).orderBy("n").collect()
    assert [r.target_id for r in rows] == VOCABULARY_TARGETS


def test_cases(spark):
    rows = tgt.with_target(calls(spark, [(c, t) for c, t, _ in CASES])).orderBy("n").collect()
    for r, (callee, text, want) in zip(rows, CASES):
        got = (r.target_id, r.target_label, r.target_kind) if r.target_id else None
        assert got == want, (callee, text)


@pytest.mark.parametrize("callee, recv, method", [
    ("a.b.c", "a.b", "c"), ("a->b", "a-", "b"), ("a::b", "a:", "b"), ("f", "", "f"), (".f", "", "f"), ("a.", "a", ""),
    ("", "", ""), (" a.b\n", "a", "b")])
def test_split_callee(spark, callee, recv, method):
    df = spark.createDataFrame([(callee,)], "c string")
    assert tuple(df.select(tgt.receiver_of(F.col("c")), tgt.method_of(F.col("c"))).first()) == (recv, method)


def test_placeholder(spark):
    yes = ["example.com", "a test", "FOO", "john.doe", "johndoe", "xxx", "xxxx", "your-key", "your_", "étest", "my.sample.io"]
    no = ["examples.com", "testing", "food", "xx", "yours", "contest", "bar_x", ""]
    df = spark.createDataFrame([(v,) for v in yes + no], "v string")
    got = {r.v for r in df.filter(tgt.is_placeholder(F.col("v"))).collect()}
    assert got == set(yes)


def test_split_call(spark):
    df = spark.createDataFrame([(" a.b \n(x)", "(x)"), ("f(x)", "(y)")], "f string, a string")
    assert [r[0] for r in df.select(tgt.split_call(F.col("f"), F.col("a"))).collect()] == ["a.b", "f(x)"]


def test_many_vendors(spark):
    from flowlens.dims import Dictionaries
    d = Dictionaries(vendors=[(f"v{i:03d}x", f"V{i}") for i in range(100)])
    df = spark.createDataFrame([("v007x.v003x.send",), ("none",)], "c string")
    assert [r[0] for r in df.select(tgt.match_vendor(F.col("c"), d)).collect()] == ["v003x", None]


def test_keep_classified(spark):
    df = calls(spark, [("db.save", "email"), ("db.save", "x"), ("nothing", "email")])
    rows = keep_classified(df).collect()
    assert [(r.n, r.categories) for r in rows] == [(0, ["email"])]
