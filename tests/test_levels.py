"""Longest paths, bucketed edges, category bit sets and mergeable states."""

import random

import pytest
from pyspark.sql import functions as F

from flowlens.model import FLOW_SCHEMA, NODE_SCHEMA
from flowlens.operators import bitsets, levels, merge, traversal, upsert
from flowlens.operators.edges import EdgeTables


def edges(spark, pairs):
    return spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "`from` string, `to` string")


def peeled(pairs):
    """Depth by removing level after level."""
    before = {}
    for a, b in pairs:
        before.setdefault(str(b), set()).add(str(a))
        before.setdefault(str(a), set())
    depth, turn = {}, 0
    while ready := [x for x, p in before.items() if x not in depth and all(depth.get(q, turn) < turn for q in p)]:
        depth.update(dict.fromkeys(ready, turn))
        turn += 1
    return depth


def random_graph(seed):
    rng = random.Random(seed)
    n = rng.choice([8, 25])
    pairs = [tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.choice([n, 3 * n]))]
    return pairs + ([tuple(rng.sample(range(n), 2)) for _ in range(2)] if seed % 2 else [])  # odd ones may have cycles


@pytest.mark.parametrize("seed", range(4))
def test_longest_paths_equal_peeling(spark, seed):
    pairs = random_graph(seed)
    assert {r.id: r.depth for r in levels.longest_paths(edges(spark, pairs)).collect()} == peeled(pairs)


def test_ladders_diamonds_and_chains_behind_cycles(spark):
    pairs = [(f"a{i}", f"{s}{i + 1}") for i in range(4) for s in "ab"] + [(f"b{i}", f"{s}{i + 1}") for i in range(4) for s in "ab"]
    pairs += [("d0", "d1"), ("d0", "d2"), ("d1", "d3"), ("d2", "d3"), ("d0", "d3"), ("d3", "d4")]
    pairs += [("x", "y"), ("y", "x"), ("y", "z"), ("z", "w"), ("in", "x")]
    found = {r.id: r.depth for r in levels.longest_paths(edges(spark, pairs)).collect()}
    assert found == peeled(pairs) and found["d4"] == 3 and not {"x", "y", "z", "w"} & set(found)


def test_a_chain_of_ten_thousand_nodes_takes_few_rounds(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(levels, "cut", lambda df, real=levels.cut: steps.append(1) or real(df))
    chain = spark.range(9_999).select(F.format_string("n%05d", "id").alias("from"), F.format_string("n%05d", F.col("id") + 1).alias("to"))
    found = levels.longest_paths(chain)
    assert found.filter("id <> format_string('n%05d', depth)").count() == 0 and found.count() == 10_000
    assert len(steps) <= 30


def test_a_step_does_not_shuffle_the_edges(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = EdgeTables.of(edges(spark, [(i, i % 7) for i in range(500)]))
        frontier = spark.range(100).select(F.col("id").cast("string").alias("id"), F.lit("s").alias("start_id"))
        for near in ("from", "to"):
            step = tables.step(frontier, near)
            plan = step._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan, plan
            want = [(str(i), str(i % 7)) for i in range(500) if (i if near == "from" else i % 7) < 100]
            assert sorted((r["from"], r["to"]) for r in step.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    inside = tables.inside(spark.createDataFrame([("1",), ("8",), ("15",), ("3",)], "id string"))
    assert sorted((r["from"], r["to"]) for r in inside.collect()) == [("1", "1"), ("15", "1"), ("3", "3"), ("8", "1")]


def test_walks_read_each_pair_once(spark, monkeypatch):
    """Many starts on a hub: every pair is read in one step only, for output it is read once more."""
    pairs = [(f"l{i:03d}", "hub") for i in range(200)] + [("hub", f"r{i:03d}") for i in range(50)] + [(f"r{i:03d}", "end") for i in range(50)]
    index = traversal.ReachIndex.of(edges(spark, pairs))
    read = []
    monkeypatch.setattr(traversal, "_read", lambda s, folders, schema, real=traversal._read: read.append(folders) or real(s, folders, schema))
    starts = spark.createDataFrame([(f"l{i:03d}",) for i in range(200)], "id string")
    out = traversal.lineage(index, starts)
    assert out.count() == 200 * (1 + 1 + 50 + 1)
    steps, output = read[:-1], read[-1]
    folders = [f for step in steps for f in step]
    assert len(folders) == len(set(folders))
    assert len(output) == len(set(output))


def test_walks_compare_at_meeting_points_only(spark, monkeypatch):
    """The same hub without an index: what is compared with former pairs are rows at nodes where edges meet."""
    pairs = [(f"l{i:03d}", "hub") for i in range(50)] + [("hub", f"r{i:03d}") for i in range(40)] + [(f"r{i:03d}", "end") for i in range(40)] + [("end", "after")]
    edges_of = traversal._meeting(edges(spark, pairs))
    assert edges_of.by_from.filter("meets").select("to").distinct().count() == 2  # hub and end
    assert edges_of.by_to.filter("meets").select("from").distinct().count() == 1  # hub
    starts = spark.createDataFrame([(f"l{i:03d}",) for i in range(50)], "id string")
    out = traversal.lineage(edges(spark, pairs), starts)
    assert out.count() == out.distinct().count() == 50 * (1 + 1 + 40 + 1 + 1)


def test_cycle_members(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 5), (6, 7), (8, 1), (9, 9)]
    ids = spark.createDataFrame([(str(i),) for i in range(1, 10)], "id string")
    found = {r.id: r.comp for r in traversal.cycle_members(edges(spark, pairs), ids).collect()}
    assert found == {"1": "1", "2": "1", "3": "1", "5": "5", "6": "5", "9": "9"}


def test_category_sets_of_any_size(spark):
    ids = sorted(f"it's {i:03d}" for i in range(130))
    rng = random.Random(1)
    sets = [rng.sample(ids, k) for k in (0, 1, 5, 70, 130)] + [[ids[0], ids[0]], [ids[61], ids[62]], [None, ids[3]]]
    df = spark.createDataFrame([(k % 4, s) for k, s in enumerate(sets)] + [(9, None)], "k int, categories array<string>")
    assert bitsets.ids_of(df) == ids
    merged = df.withColumns(bitsets.encode("categories", ids)).groupBy("k").agg(*bitsets.united(ids)).select("k", bitsets.decode(ids).alias("c"))
    want = {k: sorted({c for j, s in enumerate(sets) if j % 4 == k for c in s if c}) for k in range(4)} | {9: []}
    assert {r.k: r.c for r in merged.collect()} == want
    assert bitsets.ids_of(df.filter("k = 9")) == []
    empty = df.withColumns(bitsets.encode("categories", [])).groupBy("k").agg(*bitsets.united([])).select(bitsets.decode([]).alias("c"))
    assert {tuple(r.c) for r in empty.collect()} == {()}


def test_calls_are_merged_in_hash_tables(spark):
    calls = spark.createDataFrame([(0, "a", "b.py", 0, 9, 1, "log.info", "(email, x)", "log.info(email, x)")],
                                  "root_idx int, base string, rel string, start_byte bigint, end_byte bigint, line int, callee string, args_text string, full_text string")
    plan = merge.call_edges(calls)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan
    first = plan.rfind("HashAggregate(keys=[service_id")  # the lowest one stands over the calls
    assert first > 0 and "bit_or" in plan[first:]
    assert "SortAggregate" not in plan[first:]


def raw(spark, seed):
    rng = random.Random(seed)
    n = 60
    cats = [(k, f"c{rng.randrange(9)}", rng.choice(["L1", "L2", None]), rng.choice(["pii", "", "health", "odd", "special"])) for k in range(n)]
    nodes = [(k, f"n{rng.randrange(9)}", rng.choice(["service", "sink"]), rng.choice(["", "A", None]), rng.choice(["", "s1", "s2"]), rng.choice(["", "l"])) for k in range(n)]
    flows = [(k, rng.choice(["a", "b", "", None]), rng.choice(["a", "c", "d"]), rng.sample(["x", "y", "z"], rng.randrange(4)), rng.choice(["", "v1", "v2"]),
              rng.choice(["", "e1", None])) for k in range(n)]
    return (spark.createDataFrame(cats, "seq int, id string, label string, sensitivity string"), spark.createDataFrame(nodes, "seq int, " + NODE_SCHEMA),
            spark.createDataFrame(flows, "seq int, " + FLOW_SCHEMA))


def tables(graph):
    return [sorted(map(repr, map(tuple, getattr(graph, t).select(*c).collect()))) for t, c in (
        ("categories", ["id", "label", "sensitivity"]), ("nodes", ["id", "kind", "label", "system", "location"]), ("flows", ["from", "to", "categories", "via", "evidence"]))]


def test_parts_merged_in_any_order_equal_one_build(spark, tmp_path):
    c, n, f = raw(spark, 3)
    whole = [sorted(map(repr, map(tuple, df.select(*cols).collect()))) for df, cols in (
        (merge.merge_categories(c), ["id", "label", "sensitivity"]), (merge.merge_nodes(n), ["id", "kind", "label", "system", "location"]),
        (merge.merge_flows(f), ["from", "to", "categories", "via", "evidence"]))]
    parts = [upsert.GraphState.of(*[df.filter(f"seq % 3 = {k}") for df in (c, n, f)]) for k in range(3)]
    assert tables(parts[2].merge(parts[0]).merge(parts[1]).graph()) == whole
    for order in ((0, 1, 2), (2, 1, 0)):
        path = str(tmp_path / f"g{order[0]}")
        for k in order:
            saved = parts[k].upsert(path)
        assert tables(saved.graph()) == whole
        assert tables(parts[1].upsert(path).graph()) == whole  # again: nothing changes
    with pytest.raises(FileNotFoundError):
        upsert.GraphState.load(spark, str(tmp_path / "none"))


def test_a_write_that_fails_leaves_the_old_state(spark, tmp_path):
    c, n, f = raw(spark, 4)
    state, path = upsert.GraphState.of(c, n, f), str(tmp_path / "g")
    before = tables(state.upsert(path).graph())
    broken = upsert.GraphState(state.categories, state.nodes, state.flows.withColumn("via", F.raise_error(F.lit("lost")).cast("struct<seq:int,value:string>")))
    with pytest.raises(Exception, match="lost"):
        broken.save(path)
    assert tables(upsert.GraphState.load(spark, path).graph()) == before
