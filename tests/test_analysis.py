import random

import pytest
from pyspark.sql import functions as F

from flowlens.functions import text as txt
from flowlens.model import CATEGORY_SCHEMA, FLOW_SCHEMA, NODE_SCHEMA, Graph
from flowlens.operators import details, sensitivity, traversal, weights
from flowlens.plans import views


def rows_of(df, *sort):
    return [tuple(r) for r in df.orderBy(*sort).collect()]


def edges(spark, pairs, cats=("email",)):
    return spark.createDataFrame([(a, b, list(cats), "", "") for a, b in pairs], FLOW_SCHEMA)


def nodes(spark, ids, kind="service"):
    return spark.createDataFrame([(i, kind, i, "", "") for i in ids], NODE_SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    n = spark.createDataFrame([
        ("u", "source", "User", "", ""), ("s", "service", "", "", ""), ("d", "store", "DB", "", ""),
        ("l", "sink", "Logs", "Sinks", ""), ("x", "external", "X", "Third parties", "")], NODE_SCHEMA)
    f = spark.createDataFrame([
        ("u", "s", ["email", "health"], "", ""), ("s", "d", ["card", "email"], "db.save", "s:1"), ("s", "l", ["cred", "health"], "log", "s:2"),
        ("s", "x", ["open"], "fetch", "s:3"), ("d", "x", [], "", ""), ("d", "l", ["unknown"], "", ""),
        ("s", "gone", ["email"], "", "")], FLOW_SCHEMA)
    c = spark.createDataFrame([("email", "Email", "pii"), ("card", "Card", "financial"), ("health", "Health", "health"),
                               ("cred", "Credential", "credential"), ("open", "", "public"), ("blank", "Blank", "")],
                              CATEGORY_SCHEMA)
    return Graph(c, n, f)


def test_dominant_sensitivity(small):
    got = {(r["from"], r["to"]): r.sensitivity for r in sensitivity.dominant_sensitivity(small.flows, small.categories).collect()}
    assert got == {("u", "s"): "health", ("s", "d"): "financial", ("s", "l"): "credential", ("s", "x"): "public",
                   ("d", "x"): "", ("d", "l"): "", ("s", "gone"): "pii"}
    public = {r["to"]: r.sensitivity for r in sensitivity.flow_sensitivity_public(small.flows, small.categories)
              .filter("`from` = 'd'").collect()}
    assert public == {"x": "public", "l": "public"}


def test_filter_by_sensitivity(small):
    def seen(*active):
        return sorted((r["from"], r["to"]) for r in sensitivity.filter_by_sensitivity(small.flows, small.categories, active).collect())

    assert seen("public") == [("d", "l"), ("d", "x"), ("s", "x")]
    assert seen("financial") == [("s", "d")]
    assert seen("pii", "financial") == [("s", "d"), ("s", "gone"), ("u", "s")]
    assert seen() == []


def test_labels(small):
    edge = {(r["from"], r["to"]): r.labels for r in details.edge_labels(small.flows, small.categories).collect()}
    assert edge[("s", "d")] == "Card, Email" and edge[("s", "x")] == "" and edge[("d", "l")] == "" and edge[("d", "x")] == ""
    rows = {(r["from"], r["to"]): (r.from_label, r.to_label, r.labels, r.via) for r in details.flow_details(small).collect()}
    assert rows[("s", "x")] == ("s", "X", "open", "fetch")
    assert rows[("d", "l")] == ("DB", "Logs", "unknown", "")
    assert rows[("s", "gone")] == ("s", "gone", "Email", "")


def test_flows_that_repeat_ends_and_many_categories(spark):
    """Each flow is judged by its own list: repeated or missing ends, unknown, repeated and 600 categories change nothing."""
    rows = [("a", "b", ["email"], "", ""), ("a", "b", ["card"], "", ""), (None, "b", ["card", "zz"], "", ""), ("a", None, None, "", ""),
            ("a", "b", ["c599", "email"], "", ""), ("q", "r", [None, "email"], "", "")]
    f = spark.createDataFrame(rows, FLOW_SCHEMA)
    known = [("email", "Email", "pii"), ("card", "Card", "financial"), ("card", "", "pii")] + [(f"c{i:03d}", f"L{i}", "health") for i in range(600)]
    c = spark.createDataFrame(known, CATEGORY_SCHEMA)

    def by_list(df, column):
        return sorted((str(r["from"]), str(r["to"]), str(r.categories), r[column]) for r in df.collect())

    assert by_list(sensitivity.with_sensitivity(f, c), "sensitivity") == [
        ("None", "b", "['card', 'zz']", "financial"), ("a", "None", "None", ""), ("a", "b", "['c599', 'email']", "health"),
        ("a", "b", "['card']", "financial"), ("a", "b", "['email']", "pii"), ("q", "r", "[None, 'email']", "pii")]
    assert by_list(details.with_labels(f, c), "labels") == [
        ("None", "b", "['card', 'zz']", "Card"), ("a", "None", "None", ""), ("a", "b", "['c599', 'email']", "L599, Email"),
        ("a", "b", "['card']", "Card"), ("a", "b", "['email']", "Email"), ("q", "r", "[None, 'email']", "Email")]
    assert len(sensitivity.filter_by_sensitivity(f, c, ["financial"]).collect()) == 2
    assert len(sensitivity.filter_by_sensitivity(f, c, ["public"]).collect()) == 3


def test_no_categories_at_all(spark, small):
    none = small.categories.limit(0)
    assert {r.sensitivity for r in sensitivity.dominant_sensitivity(small.flows, none).collect()} == {""}
    assert sensitivity.filter_by_sensitivity(small.flows, none, ["public"]).count() == 7


def test_present_sensitivities(small):
    assert [r[0] for r in sensitivity.legend_sensitivities(small.categories).orderBy("first_id").collect()] == [
        "financial", "credential", "pii", "health", "public"]
    assert [r[0] for r in sensitivity.chip_sensitivities(small.categories).orderBy("position").collect()] == [
        "pii", "financial", "credential", "health", "public"]
    assert {r.label for r in sensitivity.sensitivity_labels(small.categories).collect()} >= {"PII", "Financial"}


def test_leaks_and_view(small):
    assert rows_of(details.sensitive_leaks(small), "from") == [("s", "l", "sink", "Logs", "credential")]
    v = views.view(small, ["pii"])
    assert rows_of(v.flows.select("from", "to", "sensitivity"), "from") == [("s", "d", "financial"), ("u", "s", "health")]
    assert [r.id for r in v.nodes.orderBy("id").collect()] == ["d", "s", "u"]


def test_search_and_details(small):
    got = {r.id: r.matched for r in details.search_nodes(small.nodes, "S").collect()}
    assert got == {"u": True, "s": True, "d": False, "l": True, "x": False}
    assert all(r.matched for r in details.search_nodes(small.nodes, "").collect())
    tips = {r.id: (r.title, r.line) for r in details.node_details(small.nodes).collect()}
    assert tips["s"] == ("s", "Service") and tips["l"] == ("Logs", "Sink · Sinks")


def test_adjacency(small):
    got = sorted((r.id, r.direction, r.neighbour or "") for r in details.adjacency(small.nodes, small.flows).collect()
                 if r.id in ("u", "x"))
    assert got == [("u", "in", ""), ("u", "out", "s"), ("x", "in", "d"), ("x", "in", "s"), ("x", "out", "")]


def test_adjacency_counts_ends_once_for_both_directions(spark, capsys):
    """No join sorts all ids; repeated and null ids, ends that are no nodes and null ends have the rows a left join gives."""
    nodes = spark.createDataFrame([(i, "sink", "", "", "") for i in ("a", "a", "b", "c", None, None)], NODE_SCHEMA)
    flows = spark.createDataFrame([(f, t, ["x"], "", "") for f, t in (("a", "b"), ("a", None), (None, "b"), ("x", "b"))], FLOW_SCHEMA)
    found = details.adjacency(nodes, flows)
    found.explain()
    assert "Join" not in capsys.readouterr().out
    pairs = [("a", "out", "b"), ("a", "out", None), (None, "out", "b"), ("x", "out", "b"), ("b", "in", "a"), (None, "in", "a"), ("b", "in", None), ("b", "in", "x")]
    alone = [("a", "in", None)] * 2 + [("b", "out", None), ("c", "in", None), ("c", "out", None)] + [(None, d, None) for d in ("in", "out") for _ in range(2)]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, pairs + alone))


def test_weights(small):
    t = {r.id: (r.in_weight, r.out_weight, r.throughput) for r in weights.node_throughput(small.nodes, small.flows).collect()}
    assert t == {"u": (0, 2, 2), "s": (2, 6, 6), "d": (2, 2, 2), "l": (3, 0, 3), "x": (2, 0, 2)}
    alone = weights.node_throughput(small.nodes.filter("id = 'u'"), small.flows.limit(0)).first()
    assert alone.throughput == 1
    assert {r.id: r.degree_weight for r in weights.node_degree_weight(small.nodes, small.flows).collect()}["s"] == 8
    totals = weights.kind_totals(weights.node_throughput(small.nodes, small.flows))
    assert rows_of(totals.select("kind", "nodes", "throughput"), "col_order")[:2] == [("source", 1, 2), ("service", 1, 6)]
    assert tuple(weights.kind_maxima(totals).first()) == (6, 1)
    assert tuple(weights.kind_maxima(totals.limit(0)).first()) == (1, 0)


def test_offsets_of_two_thousand_busy_nodes(spark):
    """Every source and every target goes on over several range pieces; running sums are cumulative sums of the sorted table."""
    import pandas as pd
    rng = random.Random(21)
    pairs = sorted({(f"s{rng.randint(0, 1500) if i % 3 else 0:04d}", f"t{rng.randint(0, 1500) if i % 4 else 0:04d}") for i in range(6000)})
    rows = [(a, b, ["x"] * rng.randint(0, 4), "", "") for a, b in pairs] + [("s0000", "nowhere", ["x"], "", "")]
    table = pd.DataFrame([(a, b, max(1, len(c))) for a, b, c, _, _ in rows[:-1]], columns=["from", "to", "weight"])
    for near, far, name in (("from", "to", "source_offset"), ("to", "from", "target_offset")):
        order = table.sort_values([near, far])
        table[name] = order.groupby(near).weight.cumsum() - order.weight
    n = nodes(spark, sorted({x for p in pairs for x in p}))
    got = weights.stacked_offsets(n, spark.createDataFrame(rows, FLOW_SCHEMA)).drop("categories")
    assert rows_of(got, "from", "to") == [tuple(r) for r in table.sort_values(["from", "to"]).itertuples(index=False)]


def test_flow_volume(small):
    v = views.flow_volume(small)
    assert v.ribbons.count() == 6 and v.nodes.count() == 5 and v.kinds.count() == 5


def longest_walks(ids, pairs):
    """Length of the longest walk into each node: the last power of the adjacency matrix with an entry in its column."""
    import numpy as np
    at = {x: k for k, x in enumerate(ids)}
    step = np.zeros((len(ids), len(ids)), bool)
    for a, b in pairs:
        step[at[a], at[b]] = True
    depth, power, k = dict.fromkeys(ids, 0), step, 1
    while power.any():
        depth |= {x: k for x in ids if power[:, at[x]].any()}
        power, k = (power.astype(int) @ step.astype(int)) > 0, k + 1
    return depth


def closed(start, pairs, barred=frozenset()):
    """The smallest set with ``start`` that holds the second of a pair with the first, unless it is barred."""
    found = {start}
    while more := {b for a, b in pairs if a in found and b not in found | barred}:
        found |= more
    return found


def both_ways(start, pairs):
    above = closed(start, [(b, a) for a, b in pairs])
    return above | closed(start, pairs, above - {start})


def test_depth(spark):
    rng = random.Random(2)
    ids = [f"n{i:02d}" for i in range(40)]
    pairs = sorted({tuple(sorted(rng.sample(ids, 2))) for _ in range(90)})
    got = {r.id: r.depth for r in traversal.node_depth(nodes(spark, ids), edges(spark, pairs)).collect()}
    assert got == longest_walks(ids, pairs)


def test_depth_counts_ends_that_are_no_nodes(spark):
    d = traversal.node_depth(nodes(spark, ["b", "c"]), edges(spark, [("a", "b"), ("b", "c"), ("c", "z")]))
    assert rows_of(d, "id") == [("b", 1), ("c", 2)]
    assert rows_of(traversal.layer_sizes(d), "depth") == [(1, 1), (2, 1)]
    assert tuple(traversal.layer_maxima(d).first()) == (2, 1)


def test_depth_of_a_cycle_is_refused(spark):
    with pytest.raises(traversal.CyclicGraphError, match="3 nodes on or behind a cycle, first b, c, d"):
        traversal.node_depth(nodes(spark, "abcd"), edges(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")])).collect()


def test_lineage_with_cycles(spark):
    rng = random.Random(4)
    ids = [f"n{i:02d}" for i in range(25)]
    pairs = sorted({tuple(rng.sample(ids, 2)) for _ in range(32)})
    starts = ids[:8]
    flows, asked = edges(spark, pairs), spark.createDataFrame([(i,) for i in starts], "id string")
    for source in (flows, traversal.ReachIndex.of(flows)):
        got = {}
        rows = traversal.lineage(source, asked).collect()
        for r in rows:
            got.setdefault(r.start_id, set()).add(r.id)
        assert got == {i: both_ways(i, pairs) for i in starts}
        assert len(rows) == sum(map(len, got.values()))


def test_a_long_chain_has_a_small_plan(spark):
    ids = [f"n{i:03d}" for i in range(30)]
    df = traversal.lineage(edges(spark, list(zip(ids, ids[1:]))), spark.createDataFrame([("n015",)], "id string"))
    assert {r.id for r in df.collect()} == set(ids)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_focus(spark, small):
    g = traversal.focus(small, "d")
    assert [r.id for r in g.nodes.orderBy("id").collect()] == ["d", "l", "s", "u", "x"]
    g = traversal.focus(small, "x")
    assert sorted((r["from"], r["to"]) for r in g.flows.collect()) == [("d", "x"), ("s", "d"), ("s", "x"), ("u", "s")]


@pytest.mark.parametrize("count, location, system, want", [
    (1, "app/a/b/c.py", "app", "service"), (2, "", "app", "service"), (2, "app/a/b/c.py", "app", "a/b"),
    (2, "app/x/a/b/c.py", "app", "…/a/b"), (2, "app/c.py", "app", "app"), (2, "whole", "app", "whole"),
    (2, "other/a/b/c.py", "app", "…/a/b"), (2, "/c.py", "", "service"), (3, "a/b/c/d/e", "", "…/c/d")])
def test_subtitle(spark, count, location, system, want):
    df = spark.createDataFrame([(count, location, system, "service")], "n int, l string, s string, k string")
    assert df.select(txt.node_subtitle(F.col("n"), F.col("l"), F.col("s"), F.col("k"))).first()[0] == want


def test_label_counts_with_a_shared_and_a_missing_label(spark):
    labels = ["same"] * 21 + [None] * 3 + ["alone"]
    n = spark.createDataFrame([(f"i{i}", "service", x, "", "") for i, x in enumerate(labels)], NODE_SCHEMA)
    assert sorted(r.label_count for r in details.with_label_count(n).collect()) == [1] + [3] * 3 + [21] * 21
