import random

from pyspark.sql import functions as F

from flowlens.functions import text as txt
from flowlens.model import FLOW_SCHEMA, NODE_SCHEMA, Graph
from flowlens.operators import merge, skew
from flowlens.plans.scan import graph_from_calls
from flowlens.sources.infra import store_relabels

FLOW_ROWS = "seq int, " + FLOW_SCHEMA
NODE_ROWS = "seq int, " + NODE_SCHEMA


def flows(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], FLOW_ROWS)


def rows_of(df, *sort):
    return [tuple(r) for r in df.orderBy(*sort).collect()]


def test_three_flows_become_two_and_two_nodes_stay_alone(spark):
    ids = ["web", "till", "ledger", "attic", "cellar"]
    nodes = spark.createDataFrame([(i, "service", i.upper(), "", "") for i in ids], NODE_SCHEMA)
    f = merge.merge_flows(flows(spark, [("web", "till", ["phone"], "", "w:9"), ("till", "ledger", ["iban", "dob"], "put", ""),
                                        ("web", "till", ["dob", "phone"], "call", "w:2")]))
    assert rows_of(f, "from") == [("till", "ledger", ["dob", "iban"], "put", ""), ("web", "till", ["dob", "phone"], "call", "w:9")]
    assert {r.id for r in merge.prune_orphans(nodes, f).collect()} == {"web", "till", "ledger"}


def test_merge_flows_rules(spark):
    got = merge.merge_flows(flows(spark, [
        ("a", "b", ["x", "c"], "", "e1"), ("a", "b", ["c", "a"], "v1", "e2"), ("a", "b", [], "v2", ""),
        ("a", "a", ["x"], "v", "e"), ("", "b", ["x"], "", ""), ("a", "", ["x"], "", ""), (None, "b", ["x"], "", ""),
        ("b", "a", None, None, None)]))
    assert rows_of(got, "from") == [("a", "b", ["a", "c", "x"], "v1", "e1"), ("b", "a", [], "", "")]


def test_merge_nodes_rules(spark):
    rows = [(1, "n", "source", "", "", "loc1"), (2, "n", "store", "Later", "sys", "loc2"), (0, "m", "sink", "M", None, "")]
    got = merge.merge_nodes(spark.createDataFrame(rows, NODE_ROWS))
    assert rows_of(got, "id") == [("m", "sink", "M", "", ""), ("n", "source", "n", "sys", "loc1")]


def test_merge_categories_rules(spark):
    rows = [(0, "c", "First", "pii"), (1, "c", "Second", "health"), (2, "c", "Third", "special"), (3, "d", "D", "odd"),
            (4, "d", "E", "")]
    got = merge.merge_categories(spark.createDataFrame(rows, "seq int, id string, label string, sensitivity string"))
    assert rows_of(got, "id") == [("c", "First", "health"), ("d", "D", "odd")]


def test_relabel(spark):
    nodes = spark.createDataFrame([("store:object", "store", "Object store", "", ""), ("store:cache", "store", "Old", "x", "y")], NODE_SCHEMA)
    new = spark.createDataFrame([("store:cache", "Memcached"), ("svc:none", "nobody")], "id string, label string")
    assert rows_of(merge.relabel_nodes(nodes, new), "id") == [
        ("store:cache", "store", "Memcached", "x", "y"), ("store:object", "store", "Object store", "", "")]


def test_last_infra_token_wins(spark):
    files = spark.createDataFrame([
        (0, ["b", "x.tf"], "mysql"), (0, ["a.tf"], "postgres Redis mariadb"), (0, ["b", "y", "z.tf"], "cockroach"),
        (1, ["a.tf"], "memcached unknown redis_x")], "root_idx int, walk_key array<string>, src string")
    assert rows_of(store_relabels(files), "id") == [("store:cache", "Memcached"), ("store:db", "CockroachDB")]


def test_has_node(spark):
    nodes = spark.createDataFrame([("a", "source", "", "", "")], NODE_SCHEMA)
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    assert rows_of(merge.has_node(nodes, ids), "id") == [("a", True), ("b", False)]


def test_union_categories(spark):
    df = spark.createDataFrame([(["b", "a"], ["c", "a"]), (None, []), (["x"], None)], "a array<string>, b array<string>")
    got = [r[0] for r in df.select(txt.union_categories(F.col("a"), F.col("b"))).collect()]
    assert got == [["a", "b", "c"], None, ["x"]]


def sample_calls(spark, n=400):
    rng = random.Random(3)
    callees = ["db.save", "user_repo.insert", "redis.set", "log.info", "fetch", "stripe.charge", "x.y", "mailer.send"]
    args = ["email", "first_name", "ssn", "total", "card_number", "address"]
    rows = []
    for i in range(n):
        callee, text = rng.choice(callees), f"({rng.choice(args)}, {rng.choice(args)})"
        rows.append((0, "app", f"d{rng.randint(0, 3)}/f{rng.randint(0, 5)}.py", i, i + 1, i + 1, callee, text, callee + text))
    return spark.createDataFrame(rows, "root_idx int, base string, rel string, start_byte bigint, end_byte bigint, "
                                       "line int, callee string, args_text string, full_text string")


def test_graph_does_not_depend_on_partitioning(spark):
    calls = sample_calls(spark)
    a = graph_from_calls(calls)
    b = graph_from_calls(calls.orderBy(F.rand(5)).repartition(7), store_edges=False)
    for name, key in (("categories", ["id"]), ("nodes", ["id"]), ("flows", ["from", "to"])):
        assert rows_of(getattr(a, name), *key) == rows_of(getattr(b, name), *key)


def test_graph_equals_generic_merge(spark):
    """The edge table shortcut gives what merging every single row would give."""
    calls = sample_calls(spark)
    kept = merge.keep_classified(calls).withColumn("seq", F.expr(merge.CALL_SEQ))
    svc = txt.service_id(F.col("base"), F.col("rel"))
    out = kept.select("seq", svc.alias("from"), F.col("target_id").alias("to"), "categories", F.col("callee").alias("via"),
                      txt.evidence(F.col("rel"), F.col("line")).alias("evidence"))
    inward = out.select("seq", F.lit("source:user").alias("from"), F.col("from").alias("to"), "categories",
                        F.lit("").alias("via"), F.lit("").alias("evidence"))
    want = merge.merge_flows(out.unionByName(inward))
    assert rows_of(graph_from_calls(calls).flows, "from", "to") == rows_of(want, "from", "to")


def test_graph_of_nothing(spark):
    g = graph_from_calls(sample_calls(spark).filter("false"))
    assert (g.nodes.count(), g.flows.count(), g.categories.count()) == (0, 0, 0)


def test_collapse(spark):
    nodes = spark.createDataFrame([("u", "source", "U", "", ""), ("s1", "service", "S1", "b", "b/s1"),
                                   ("s2", "service", "S2", "b", "b/s2"), ("t", "sink", "T", "Sinks", "")], NODE_SCHEMA)
    f = spark.createDataFrame([("u", "s1", ["a"], "v", "e"), ("u", "s2", ["b"], "v", "e"), ("s1", "s2", ["c"], "v", "e"),
                               ("s2", "t", ["a", "b"], "v", "e")], FLOW_SCHEMA)
    c = spark.createDataFrame([("a", "A", "pii")], "id string, label string, sensitivity string")
    g = merge.collapse(Graph(c, nodes, f))
    assert rows_of(g.flows, "from") == [("svc:app", "t", ["a", "b"], "", ""), ("u", "svc:app", ["a", "b"], "", "")]
    assert rows_of(g.nodes, "id") == [("svc:app", "service", "Application", "", ""), ("t", "sink", "T", "Sinks", ""),
                                      ("u", "source", "U", "", "")]


def test_lookup_join_of_every_kind(spark):
    df = spark.createDataFrame([("hub" if i % 3 == 0 else f"k{i % 20}", i) for i in range(300)] + [(None, 999)], "key string, n int")
    lookup = spark.createDataFrame([("hub", 1)] + [(f"k{i}", i) for i in range(0, 20, 2)], "key string, v int")
    known = {r.key: r.v for r in lookup.collect()}
    rows = [(r.key, r.n) for r in df.collect()]
    want = {"left": [(k, n, known.get(k)) for k, n in rows], "inner": [(k, n, known[k]) for k, n in rows if k in known],
            "left_semi": [(k, n) for k, n in rows if k in known], "left_anti": [(k, n) for k, n in rows if k not in known]}
    for how, expected in want.items():
        assert sorted(map(str, map(tuple, skew.lookup_join(df, lookup, "key", how).collect()))) == sorted(map(str, expected)), how


def test_lookup_sides_of_many_short_ids_are_not_broadcast(spark, capsys):
    """Files of 150,000 ids are far below Spark's threshold in bytes."""
    ids = spark.range(150_000).select(F.concat(F.lit("order:"), "id").alias("key"))
    df = spark.createDataFrame([("order:7", 1), ("order:149999", 2), ("order:150000", 3), (None, 4)], "key string, n int")
    for joined, want in ((skew.lookup_join(df, ids, "key", "left_semi"), [1, 2]), (skew.lookup_join(df, ids, "key", "left_anti"), [3, 4]),
                         (skew.null_safe_join(df, ids.unionByName(df.filter("key IS NULL").select("key")), "key"), [1, 2, 3, 4])):
        joined.explain()
        assert "Broadcast" not in capsys.readouterr().out
        assert sorted(r.n for r in joined.collect()) == want
    skew.lookup_join(df, ids.limit(20), "key").explain()
    assert "Broadcast" in capsys.readouterr().out


def test_save_and_load(spark, tmp_path):
    g = graph_from_calls(sample_calls(spark))
    g.save(str(tmp_path / "g"))
    back = Graph.load(spark, str(tmp_path / "g"))
    assert rows_of(back.flows, "from", "to") == rows_of(g.flows, "from", "to")
    assert rows_of(back.nodes, "id") == rows_of(g.nodes, "id")
