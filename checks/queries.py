"""One query per operator, over the supplied tables: the Spark form and, where SQL can say it, the SQL form."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import dims
from flowlens.functions import identifiers as idf
from flowlens.functions import targets as tgt
from flowlens.functions import text as txt
from flowlens.model import Graph
from flowlens.operators import details, dictionary, merge, sensitivity, traversal, upsert, weights
from flowlens.operators import lines as line_index
from flowlens.plans import scan as scans
from flowlens.plans import views
from flowlens.session import cut
from flowlens.sinks import graph_json
from flowlens.sources import calls as call_source
from flowlens.sources import files as file_ops
from flowlens.sources import infra as infra_source
from flowlens.sources.tree import routed_files

from . import inputs
from .sql_parts import (CALL_CATS, CALLS, CATEGORY, COMMS, DICTIONARY, GRAPH, IDS, INFRA, KEPT, KEY_GRAPH, KIND, PATHS,
                        PLACEHOLDER, RANK, RULES, SPLIT, TARGETS, VENDOR, ask, classified, tokens_of, values)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def graph(spark: SparkSession, sf: str) -> Graph:
    return scans.graph_from_calls(inputs.calls(spark, sf), inputs.infra_files(spark, sf))


def flat(df: DataFrame, *arrays: str) -> DataFrame:
    """Arrays as comma-joined text."""
    return df.withColumns({a: F.array_join(a, ",") for a in arrays or ("categories",)})


# ---- sources ------------------------------------------------------------------

@query("src2_multi_root", ask(PATHS, """SELECT base, count(*) AS files, sum(length)::BIGINT AS bytes FROM (
  SELECT 'docs' AS base, length FROM named
  UNION ALL SELECT 'pages', octet_length(encode(html)) FROM pages
    WHERE octet_length(encode(html)) BETWEEN 1 AND 1048576) GROUP BY base"""))
def _(s, sf):
    pages = inputs.table(s, sf, "pages").select(
        F.lit(1).alias("root_idx"), F.lit("pages").alias("base"), F.concat("page_id", F.lit(".html")).alias("rel"),
        F.concat("page_id", F.lit(".html")).alias("name"), F.concat(F.lit("pages/"), "page_id").alias("path"),
        F.octet_length("html").cast("bigint").alias("length"))
    both = file_ops.prune_dirs(inputs.paths(s, sf).unionByName(pages))
    return (file_ops.filter_names(file_ops.filter_size(both)).groupBy("base")
            .agg(F.count("*").alias("files"), F.sum("length").alias("bytes")))


@query("src3_prune_dirs", ask(PATHS, "SELECT rel FROM pruned"))
def _(s, sf):
    return file_ops.prune_dirs(inputs.paths(s, sf)).select("rel")


@query("src4_filter_size", ask(PATHS, "SELECT rel, length FROM paths WHERE length BETWEEN 1 AND 1048576"))
def _(s, sf):
    return file_ops.filter_size(inputs.paths(s, sf)).select("rel", "length")


@query("src5_filter_names", ask(PATHS, "SELECT rel, length FROM named"))
def _(s, sf):
    p = file_ops.filter_size(file_ops.prune_dirs(inputs.paths(s, sf)))
    return file_ops.filter_names(p).select("rel", "length")


def _routed(s, sf):
    p = file_ops.filter_size(file_ops.prune_dirs(inputs.paths(s, sf)))
    return file_ops.route_infra(file_ops.detect_language(file_ops.filter_names(p)))


@query("src6_detect_language", ask(PATHS, "SELECT rel, language FROM spoken"))
def _(s, sf):
    return _routed(s, sf).select("rel", "language")


@query("src7_route_infra", ask(PATHS, "SELECT rel, is_infra FROM infra_routed"))
def _(s, sf):
    return _routed(s, sf).select("rel", "is_infra")


_STATS_SQL = ask(PATHS, """SELECT count(*) AS files,
  count(*) FILTER (WHERE NOT is_infra AND language IS NOT NULL) AS parsed, count(*) FILTER (WHERE is_infra) AS infra,
  (SELECT string_agg(language || '=' || n, ',' ORDER BY language) FROM (
     SELECT language, count(*) AS n FROM infra_routed WHERE NOT is_infra AND language IS NOT NULL GROUP BY language)
  ) AS languages FROM infra_routed""")


def _listed(stats):
    pairs = F.transform(F.array_sort(F.map_entries("languages")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return stats.withColumn("languages", F.array_join(pairs, ","))


@query("src8_scan_stats", _STATS_SQL)
def _(s, sf):
    return _listed(file_ops.scan_stats(_routed(s, sf)))


@query("src8_observed_stats", _STATS_SQL)
def _(s, sf):
    stats = file_ops.ObservedStats(_routed(s, sf))
    cut(stats.watched)  # the pass that a scan makes anyway
    return _listed(stats.frame())


# ---- calls --------------------------------------------------------------------

_SCRIPTS = """scripts AS (SELECT 'p' || page_id || '.' || (i - 1) || '.js' AS rel, js FROM (
  SELECT page_id, unnest(l) AS js, generate_subscripts(l, 1) AS i FROM (
    SELECT page_id, regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1) AS l FROM pages))),
cut AS (SELECT *, regexp_extract(js, 'track\\([^)]*\\)', 0) AS call FROM scripts)"""


@query("prj1_extract_calls", ask(_SCRIPTS, """SELECT rel,
  octet_length(encode(js[:position(call IN js) - 1]))::BIGINT AS start_byte,
  (octet_length(encode(js[:position(call IN js) - 1])) + octet_length(encode(call)))::BIGINT AS end_byte,
  (1 + len(js[:position(call IN js) - 1]) - len(replace(js[:position(call IN js) - 1], chr(10), '')))::INT AS line,
  'track' AS callee, substr(call, 6) AS args_text, call AS full_text FROM cut WHERE call <> ''"""))
def _(s, sf):
    return call_source.extract_calls(inputs.scripts(s, sf)).drop("root_idx", "base")


@query("prj2_split_call", ask(CALLS, "SELECT DISTINCT full_text, callee FROM calls"))
def _(s, sf):
    c = inputs.calls(s, sf)
    padded = F.concat(F.lit(" \n"), "callee", F.lit("\t "), "args_text")
    return c.select("full_text", tgt.split_call(padded, F.col("args_text")).alias("callee")).distinct()


@query("prj3_line_at", ask(CALLS, """SELECT 'b' || (start_byte // 50) || '.py' AS rel, (start_byte % 50 + 1)::INT AS line,
  full_text FROM calls"""))
def _(s, sf):
    f = inputs.source_files(s, sf).filter(F.col("rel").endswith(".py")).withColumn("language", F.lit("python"))
    return call_source.extract_calls(f).select("rel", "line", "full_text")


@query("prj3_line_at_offset", """SELECT doc_id, octet_length(encode(head))::BIGINT AS byte_offset,
    (1 + len(head) - len(replace(head, chr(10), '')))::INT AS line
  FROM (SELECT doc_id, left(text, (len(text) * (doc_id % 11)) // 11) AS head FROM documents)""")
def _(s, sf):
    head = F.expr("left(text, cast((length(text) * (doc_id % 11)) div 11 AS int))")
    at = inputs.table(s, sf, "documents").withColumn("byte_offset", F.octet_length(head).cast("bigint"))
    return at.select("doc_id", "byte_offset", txt.line_at(F.col("text"), F.col("byte_offset")).alias("line"))


@query("prj3_lines_of_offsets", """WITH lines AS (SELECT doc_id, i AS line, (sum(octet_length(encode(l)) + 1) OVER w - octet_length(encode(l)) - 1)::BIGINT AS start FROM (
    SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
asked AS (SELECT doc_id, unnest(generate_series(0, octet_length(encode(text)), 61))::BIGINT AS byte_offset FROM documents)
SELECT a.doc_id, byte_offset, line::INT AS line FROM asked a ASOF JOIN lines l ON a.doc_id = l.doc_id AND a.byte_offset >= l.start""")
def _(s, sf):
    docs = inputs.table(s, sf, "documents").select("doc_id", "text")
    every = F.sequence(F.lit(0).cast("long"), F.octet_length("text").cast("long"), F.lit(61).cast("long"))
    return line_index.lines_of(docs, docs.select("doc_id", F.explode(every).alias("byte_offset")), "doc_id")


@query("prj4_split_callee", ask(CALLS, SPLIT, "SELECT DISTINCT callee, recv AS receiver, method FROM split"))
def _(s, sf):
    low = F.lower("callee")
    return (inputs.calls(s, sf).select("callee").distinct()
            .select("callee", tgt.receiver_of(low).alias("receiver"), tgt.method_of(low).alias("method")))


@query("prj5_make_ids", ask(CALLS, """SELECT DISTINCT 'svc:' || base || '/' || rel AS id, split_part(rel, '/', -1) AS label,
  base || '/' || rel AS location FROM calls"""))
def _(s, sf):
    return inputs.calls(s, sf).select(
        txt.service_id(F.col("base"), F.col("rel")).alias("id"), txt.base_name(F.col("rel")).alias("label"),
        F.concat_ws("/", "base", "rel").alias("location")).distinct()


@query("prj6_target_system", ask(CALLS, TARGETS, "SELECT tid AS target_id, tsystem AS system, count(*) AS calls "
                                                 "FROM targets WHERE tid IS NOT NULL GROUP BY 1, 2"))
def _(s, sf):
    t = tgt.with_target(inputs.calls(s, sf)).filter("target_id IS NOT NULL")
    return (t.groupBy("target_id", tgt.target_system(F.col("target_kind")).alias("system"))
            .agg(F.count("*").alias("calls")))


@query("prj7_evidence", ask(CALLS, "SELECT start_byte, rel || ':' || line AS evidence FROM calls"))
def _(s, sf):
    return inputs.calls(s, sf).select("start_byte", txt.evidence(F.col("rel"), F.col("line")).alias("evidence"))


@query("prj8_flow_details", ask(GRAPH, """SELECT f AS "from", t AS "to", a.label AS from_label, b.label AS to_label,
  labels, via, evidence FROM flows JOIN nodes a ON a.id = f JOIN nodes b ON b.id = t
  JOIN (SELECT f, t, string_agg(c.label, ', ' ORDER BY cat) AS labels FROM flow_cat JOIN cat_dim c ON c.id = cat
        GROUP BY f, t) USING (f, t)"""))
def _(s, sf):
    return details.flow_details(graph(s, sf))


@query("prj8_node_details", ask(GRAPH, """SELECT id, coalesce(nullif(label, ''), id) AS title,
  upper(kind[1]) || kind[2:] || CASE WHEN system <> '' THEN ' · ' || system ELSE '' END AS line, location FROM nodes"""))
def _(s, sf):
    return details.node_details(graph(s, sf).nodes)


# ---- filters ------------------------------------------------------------------

_CATS_PER_CALL = """per_call AS (SELECT start_byte, string_agg(cat, ',' ORDER BY pos) AS categories
  FROM call_cats GROUP BY start_byte)"""


@query("flt1_keep_classified", ask(CALLS, CALL_CATS, TARGETS, _CATS_PER_CALL, """SELECT start_byte, tid AS target_id,
  categories FROM targets JOIN per_call USING (start_byte) WHERE tid IS NOT NULL"""))
def _(s, sf):
    return flat(merge.keep_classified(inputs.calls(s, sf))).select("start_byte", "target_id", "categories")


@query("flt2_is_vendor", ask(CALLS, TARGETS, "SELECT start_byte, callee, cv AS vendor FROM targets WHERE cv IS NOT NULL"))
def _(s, sf):
    v = tgt.match_vendor(F.lower("callee"))
    return inputs.calls(s, sf).select("start_byte", "callee", v.alias("vendor")).filter("vendor IS NOT NULL")


def _flagged(s, sf, test):
    c = inputs.calls(s, sf).withColumn("low", F.lower("callee"))
    c = c.withColumns({"recv": tgt.receiver_of(F.col("low")), "method": tgt.method_of(F.col("low"))})
    return c.filter(test(F.col("low"), F.col("recv"), F.col("method"))).select("start_byte", "callee")


@query("flt3_is_comms", ask(CALLS, f"SELECT start_byte, callee FROM calls WHERE regexp_matches(lower(callee), '{COMMS}')"))
def _(s, sf):
    return _flagged(s, sf, lambda low, r, m: tgt.is_comms(low))


@query("flt4_is_http", ask(CALLS, RULES, "SELECT start_byte, callee FROM flags WHERE is_http"))
def _(s, sf):
    return _flagged(s, sf, lambda low, r, m: tgt.is_http(r, m))


@query("flt5_is_log", ask(CALLS, RULES, "SELECT start_byte, callee FROM flags WHERE is_log"))
def _(s, sf):
    return _flagged(s, sf, lambda low, r, m: tgt.is_log(r, m))


@query("flt6_is_store", ask(CALLS, RULES, "SELECT start_byte, callee FROM flags WHERE is_store"))
def _(s, sf):
    return _flagged(s, sf, lambda low, r, m: tgt.is_store(r, m))


@query("flt7_is_placeholder", f"""SELECT 'document' AS source, doc_id AS id FROM documents
  WHERE regexp_matches(text, '{PLACEHOLDER}')
  UNION ALL SELECT 'page', page_id FROM pages WHERE regexp_matches(url, '{PLACEHOLDER}')
  UNION ALL SELECT 'turn', conv_id FROM conversations WHERE regexp_matches(text, '{PLACEHOLDER}')
  UNION ALL SELECT 'item', item_id FROM benchmark WHERE regexp_matches(text, '{PLACEHOLDER}')""")
def _(s, sf):
    parts = []
    for source, name, key, column in (("document", "documents", "doc_id", "text"), ("page", "pages", "page_id", "url"),
                                      ("turn", "conversations", "conv_id", "text"), ("item", "benchmark", "item_id", "text")):
        rows = inputs.spread(inputs.table(s, sf, name).select(key, column)).filter(tgt.is_placeholder(F.col(column)))
        parts.append(rows.select(F.lit(source).alias("source"), F.col(key).alias("id")))
    return reduce(DataFrame.unionByName, parts)


@query("flt8_filter_by_sensitivity", ask(GRAPH, """SELECT f AS "from", t AS "to", categories FROM flows
  WHERE EXISTS (SELECT 1 FROM flow_cat k JOIN cat_dim c ON c.id = k.cat
                WHERE k.f = flows.f AND k.t = flows.t AND c.sensitivity IN ('financial', 'health'))"""))
def _(s, sf):
    g = graph(s, sf)
    return flat(sensitivity.filter_by_sensitivity(g.flows, g.categories, ["financial", "health"])).select(
        "from", "to", "categories")


@query("flt9_search_nodes", ask(GRAPH, "SELECT id, label, contains(lower(label), 'h3') AS matched FROM nodes"))
def _(s, sf):
    return details.search_nodes(graph(s, sf).nodes, "H3").select("id", "label", "matched")


# raw flows with blank ends, self flows, blank via and evidence, and flows without categories
_RAW_FLOWS = values("cat_word", "k, w", [(0, "email"), (1, "name"), (2, "card"), (3, "ssn"), (4, "geo")]) + """,
raw_flows AS (SELECT event_id AS seq,
    CASE WHEN event_id % 41 = 0 THEN '' ELSE 'n' || (user_id % 60) END AS f,
    CASE WHEN event_id % 43 = 0 THEN '' ELSE 'n' || (event_id % 60) END AS t,
    CASE event_id % 3 WHEN 0 THEN [] WHEN 1 THEN [a.w] ELSE [a.w, b.w] END AS cats,
    CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS via,
    CASE WHEN event_id % 5 = 0 THEN 'e' || event_id ELSE '' END AS evidence
  FROM events JOIN cat_word a ON a.k = event_id % 5 JOIN cat_word b ON b.k = user_id % 5)"""


def _raw_flows(s, sf):
    word = F.lit(["email", "name", "card", "ssn", "geo"])
    a, b = F.get(word, F.expr("cast(event_id % 5 AS int)")), F.get(word, F.expr("cast(user_id % 5 AS int)"))
    e = inputs.table(s, sf, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.expr("if(event_id % 41 = 0, '', concat('n', user_id % 60))").alias("from"),
        F.expr("if(event_id % 43 = 0, '', concat('n', event_id % 60))").alias("to"),
        F.when(F.expr("event_id % 3 = 0"), F.array().cast("array<string>")).when(F.expr("event_id % 3 = 1"), F.array(a))
        .otherwise(F.array(a, b)).alias("categories"),
        F.expr("if(event_id % 2 = 0, event_type, '')").alias("via"),
        F.expr("if(event_id % 5 = 0, concat('e', event_id), '')").alias("evidence"))


@query("flt10_drop_invalid_flows", ask(_RAW_FLOWS, """SELECT seq, f AS "from", t AS "to" FROM raw_flows
  WHERE f <> '' AND t <> '' AND f <> t"""))
def _(s, sf):
    return merge.drop_invalid_flows(_raw_flows(s, sf)).select("seq", "from", "to")


# ---- joins --------------------------------------------------------------------

@query("jon1_lookup_token", ask(CALLS, IDS, tokens_of("ids"), """SELECT t AS token, d.cat AS cat_id, count(*) AS identifiers
  FROM (SELECT id, unnest(tk) AS t FROM toks) JOIN dict d ON d.token = t GROUP BY 1, 2"""))
def _(s, sf):
    ids = inputs.calls(s, sf).select(F.explode(idf.identifiers(F.col("args_text"))).alias("id")).distinct()
    toks = ids.select("id", F.explode(idf.identifier_tokens(F.col("id"))).alias("token"))
    return (toks.join(dims.dim_pii_token(s), "token").groupBy("token", "cat_id")
            .agg(F.count("*").alias("identifiers")))


@query("jon2_lookup_language", ask(PATHS, "SELECT coalesce(language, '?') AS language, count(*) AS files "
                                          "FROM spoken GROUP BY 1"))
def _(s, sf):
    return (_routed(s, sf).groupBy(F.coalesce("language", F.lit("?")).alias("language"))
            .agg(F.count("*").alias("files")))


@query("jon3_lookup_infra", ask(INFRA, """SELECT walk_key, pos::INT - 1 AS pos, w.token, d.id AS enrich_id, d.label
  FROM infra_words w JOIN infra_dim d ON d.token = w.token"""))
def _(s, sf):
    return infra_source.infra_tokens(inputs.infra_files(s, sf)).select("walk_key", "pos", "token", "enrich_id", "label")


@query("jon4_relabel_nodes", ask(GRAPH, "SELECT id, label FROM nodes"))
def _(s, sf):
    g = scans.graph_from_calls(inputs.calls(s, sf))
    return merge.relabel_nodes(g.nodes, infra_source.store_relabels(inputs.infra_files(s, sf))).select("id", "label")


@query("jon5_flow_categories", ask(GRAPH, """SELECT f AS "from", t AS "to", cat AS cat_id, c.label, c.sensitivity
  FROM flow_cat LEFT JOIN cat_dim c ON c.id = cat"""))
def _(s, sf):
    g = graph(s, sf)
    return sensitivity.flow_categories(g.flows, g.categories).select("from", "to", "cat_id", "label", "sensitivity")


@query("jon6_prune_orphans", ask(KEY_GRAPH, "SELECT id, kind FROM knodes WHERE id IN "
                                            "(SELECT f FROM kflows UNION SELECT t FROM kflows)"))
def _(s, sf):
    g = inputs.key_graph(s, sf)
    return merge.prune_orphans(g.nodes, g.flows).select("id", "kind")


@query("jon7_valid_edges", ask(KEY_GRAPH, """SELECT f AS "from", t AS "to" FROM kflows
  WHERE f IN (SELECT id FROM knodes WHERE kind <> 'service') AND t IN (SELECT id FROM knodes WHERE kind <> 'service')"""))
def _(s, sf):
    g = inputs.key_graph(s, sf)
    return merge.valid_edges(g.flows, g.nodes.filter("kind <> 'service'")).select("from", "to")


@query("jon8_adjacency", ask(KEY_GRAPH, """SELECT id, 'out' AS direction, t AS neighbour FROM knodes LEFT JOIN kflows ON f = id
  UNION ALL SELECT id, 'in', f FROM knodes LEFT JOIN kflows ON t = id"""))
def _(s, sf):
    g = inputs.key_graph(s, sf)
    return details.adjacency(g.nodes, g.flows)


@query("jon9_match_vendor", ask(CALLS, TARGETS, """SELECT callee, host, cv AS callee_vendor, hv AS host_vendor, count(*) AS calls
  FROM targets GROUP BY ALL"""))
def _(s, sf):
    host = tgt.url_host(F.col("full_text"))
    return (inputs.calls(s, sf).select("callee", host.alias("host"))
            .withColumns({"callee_vendor": tgt.match_vendor(F.lower("callee")),
                          "host_vendor": tgt.match_vendor(F.lower("host"))})
            .groupBy("callee", "host", "callee_vendor", "host_vendor").agg(F.count("*").alias("calls")))


@query("jon9_match_vendor_index", ask(CALLS, TARGETS, """SELECT callee, host, cv AS callee_vendor, hv AS host_vendor, count(*) AS calls
  FROM targets GROUP BY ALL"""))
def _(s, sf):
    calls = (inputs.calls(s, sf).select("callee", tgt.url_host(F.col("full_text")).alias("host"), F.lower("callee").alias("low"))
             .groupBy("callee", "host", "low").agg(F.count("*").alias("calls")))
    low_host = F.lower("host")
    found = dictionary.match_vendors(calls.select(F.col("low").alias("id")).unionByName(calls.select(low_host.alias("id"))), dims.dim_vendor(s))
    for column, value in (("callee_vendor", F.col("low")), ("host_vendor", low_host)):
        calls = calls.withColumn("id", value).join(found.withColumnRenamed("vendor", column), "id", "left")
    return calls.select("callee", "host", "callee_vendor", "host_vendor", "calls")


_LINEAGE = """starts AS (SELECT id FROM knodes WHERE kind IN ('service', 'source')),
up AS (SELECT id AS start_id, id FROM starts UNION SELECT u.start_id, k.f FROM up u JOIN kflows k ON k.t = u.id),
down AS (SELECT id AS start_id, id FROM starts UNION SELECT d.start_id, k.t FROM down d JOIN kflows k ON k.f = d.id),
lin AS (SELECT * FROM up UNION SELECT * FROM down)"""


def _lineage(s, sf):
    g = inputs.key_graph(s, sf)
    return traversal.lineage(g.flows, g.nodes.filter("kind IN ('service', 'source')").select("id"))


_LINEAGE_SQL = ask(KEY_GRAPH, _LINEAGE, "SELECT start_id, id FROM lin", recursive=True)
query("jon10_lineage_join", ask(KEY_GRAPH, _LINEAGE, "SELECT start_id, count(*) AS members FROM lin GROUP BY 1",
                                recursive=True))(
    lambda s, sf: _lineage(s, sf).groupBy("start_id").agg(F.count("*").alias("members")))
query("grf2_lineage", _LINEAGE_SQL)(_lineage)

_FOCUS_SQL = ask(KEY_GRAPH, _LINEAGE, "members AS (SELECT id FROM lin WHERE start_id = 'nation:3')",
                 """SELECT f AS "from", t AS "to" FROM kflows WHERE f IN (SELECT id FROM members)
  AND t IN (SELECT id FROM members)""", recursive=True)


@query("jon11_focus_subgraph", _FOCUS_SQL)
def _(s, sf):
    return traversal.focus(inputs.key_graph(s, sf), "nation:3").flows.select("from", "to")


@query("grf3_focus", ask(KEY_GRAPH, _LINEAGE, """SELECT n.id, kind FROM knodes n
  JOIN lin ON lin.id = n.id AND start_id = 'nation:3'""", recursive=True))
def _(s, sf):
    return traversal.focus(inputs.key_graph(s, sf), "nation:3").nodes.select("id", "kind")


@query("jon12_collapse_remap", ask(GRAPH, """SELECT CASE WHEN f LIKE 'svc:%' THEN 'svc:app' ELSE f END AS "from",
  CASE WHEN t LIKE 'svc:%' THEN 'svc:app' ELSE t END AS "to", count(*) AS flows FROM flows GROUP BY 1, 2"""))
def _(s, sf):
    g = graph(s, sf)
    return (merge.remap_ends(g.flows, g.nodes.filter("kind = 'service'").select("id"), "svc:app")
            .groupBy("from", "to").agg(F.count("*").alias("flows")))


# ---- aggregations ---------------------------------------------------------------

_SENS = ["pii", "", "financial", "public", "special", "credential", "odd", "health"]
_RAW_CATS = values("sens", "k, w", list(enumerate(_SENS))) + """,
raw AS (SELECT event_id AS seq, 'c' || (user_id % 37) AS id, 'L' || (event_id % 3) AS label, w AS sensitivity
  FROM events JOIN sens ON k = (event_id // 7) % (1 + user_id % 8))"""


_CATEGORIES_SQL = ask(RANK, _RAW_CATS, """SELECT id, arg_min(label, seq) AS label,
  arg_min(raw.sensitivity, {'r': -coalesce(rnk, 0), 's': seq}) AS sensitivity
  FROM raw LEFT JOIN ranks ON ranks.sensitivity = raw.sensitivity GROUP BY id""")


def _raw_categories(s, sf):
    e = inputs.table(s, sf, "events")
    return e.select(F.col("event_id").alias("seq"), F.expr("concat('c', user_id % 37)").alias("id"),
                    F.expr("concat('L', event_id % 3)").alias("label"),
                    inputs._pick(_SENS, "(event_id div 7) % (1 + user_id % 8)").alias("sensitivity"))


@query("agg1_merge_categories", _CATEGORIES_SQL)
def _(s, sf):
    return merge.merge_categories(_raw_categories(s, sf))


_RAW_NODES = """raw AS (SELECT event_id AS seq, 'n' || (user_id % 97) AS id, event_type AS kind,
  CASE WHEN event_id % 3 = 0 THEN 'L' || event_id ELSE '' END AS label,
  CASE WHEN event_id % 7 = 0 THEN 'S' || event_id ELSE '' END AS system,
  CASE WHEN event_id % 11 = 0 THEN 'P' || event_id ELSE '' END AS location FROM events)"""


_NODES_SQL = ask(_RAW_NODES, """SELECT id, arg_min(kind, seq) AS kind,
  arg_min(coalesce(nullif(label, ''), id), seq) AS label,
  coalesce(arg_min(system, seq) FILTER (WHERE system <> ''), '') AS system,
  coalesce(arg_min(location, seq) FILTER (WHERE location <> ''), '') AS location FROM raw GROUP BY id""")


def _raw_node_rows(s, sf):
    return inputs.table(s, sf, "events").selectExpr(
        "event_id AS seq", "concat('n', user_id % 97) AS id", "event_type AS kind",
        "if(event_id % 3 = 0, concat('L', event_id), '') AS label",
        "if(event_id % 7 = 0, concat('S', event_id), '') AS system",
        "if(event_id % 11 = 0, concat('P', event_id), '') AS location")


@query("agg2_merge_nodes", _NODES_SQL)
def _(s, sf):
    return merge.merge_nodes(_raw_node_rows(s, sf))


_MERGED_FLOWS = """ok AS (SELECT * FROM raw_flows WHERE f <> '' AND t <> '' AND f <> t),
merged AS (SELECT f, t, coalesce(arg_min(via, seq) FILTER (WHERE via <> ''), '') AS via,
  coalesce(arg_min(evidence, seq) FILTER (WHERE evidence <> ''), '') AS evidence FROM ok GROUP BY f, t),
merged_cats AS (SELECT f, t, string_agg(DISTINCT c, ',' ORDER BY c) AS categories
  FROM (SELECT f, t, unnest(cats) AS c FROM ok) GROUP BY f, t)"""
_MERGED_SQL = ask(_RAW_FLOWS, _MERGED_FLOWS, """SELECT f AS "from", t AS "to", coalesce(categories, '') AS categories,
  via, evidence FROM merged LEFT JOIN merged_cats USING (f, t)""")


@query("agg3_merge_flows", _MERGED_SQL)
def _(s, sf):
    return flat(merge.merge_flows(_raw_flows(s, sf)))


def _in_halves(state, rows):
    """The state of two halves of the rows, the later half first."""
    return upsert.merge_states(state(rows.filter("seq % 2 = 1")), state(rows.filter("seq % 2 = 0")))


@query("agg1_upsert_categories", _CATEGORIES_SQL)
def _(s, sf):
    return upsert.category_rows(_in_halves(upsert.category_state, _raw_categories(s, sf)))


@query("agg2_upsert_nodes", _NODES_SQL)
def _(s, sf):
    return upsert.node_rows(_in_halves(upsert.node_state, _raw_node_rows(s, sf)))


@query("agg3_upsert_flows", _MERGED_SQL)
def _(s, sf):
    return flat(upsert.flow_rows(_in_halves(upsert.flow_state, _raw_flows(s, sf))))


@query("agg4_calls_to_graph", ask(GRAPH, """SELECT 'flow' AS part, f AS a, t AS b, categories AS c, via AS d, evidence AS e
  FROM flows UNION ALL SELECT 'node', id, kind, label, system, location FROM plain_nodes
  UNION ALL SELECT 'category', id, label, sensitivity, '', '' FROM categories"""))
def _(s, sf):
    g = scans.graph_from_calls(inputs.calls(s, sf))

    def part(df, name):
        return df.toDF("a", "b", "c", "d", "e").select(F.lit(name).alias("part"), "*")

    return (part(flat(g.flows), "flow").unionByName(part(g.nodes, "node"))
            .unionByName(part(g.categories.select("*", F.lit("").alias("d"), F.lit("").alias("e")), "category")))


_DOMINANT = """loud AS (SELECT f, t, coalesce(arg_min(c.sensitivity, {'r': -coalesce(rnk, 0), 'c': cat})
    FILTER (WHERE rnk > 0), '') AS sensitivity
  FROM flow_cat LEFT JOIN categories c ON c.id = cat LEFT JOIN ranks ON ranks.sensitivity = c.sensitivity GROUP BY f, t)"""


@query("agg5_dominant_sensitivity", ask(GRAPH, RANK, _DOMINANT, 'SELECT f AS "from", t AS "to", sensitivity FROM loud'))
def _(s, sf):
    g = graph(s, sf)
    return sensitivity.dominant_sensitivity(g.flows, g.categories)


# card is known, geo unknown; the shortcut's email is the only category made public here
_KEY_LOUD = """SELECT f AS "from", t AS "to", CASE WHEN list_contains(cats, 'card') THEN 'financial'
  WHEN list_contains(cats, 'name') THEN 'pii' ELSE 'public' END AS sensitivity FROM kflows"""


@query("agg6_flow_sensitivity_public", ask(KEY_GRAPH, _KEY_LOUD))
def _(s, sf):
    g = inputs.key_graph(s, sf)
    known = (g.categories.filter("id <> 'geo'")
             .withColumn("sensitivity", F.when(F.col("id") == "email", "public").otherwise(F.col("sensitivity"))))
    return sensitivity.flow_sensitivity_public(g.flows, known)


@query("agg7_flow_weight", ask(_RAW_FLOWS, "SELECT seq, greatest(1, len(cats))::BIGINT AS weight FROM raw_flows"))
def _(s, sf):
    return _raw_flows(s, sf).select("seq", weights.flow_weight(F.col("categories")).alias("weight"))


_THROUGHPUT = """ends AS (SELECT f AS id, 0 AS i, n AS o FROM flows UNION ALL SELECT t, n, 0 FROM flows),
thr AS (SELECT nodes.id, kind, coalesce(sum(i), 0)::BIGINT AS in_weight, coalesce(sum(o), 0)::BIGINT AS out_weight,
  greatest(coalesce(sum(i), 0), coalesce(sum(o), 0), 1)::BIGINT AS throughput
  FROM nodes LEFT JOIN ends USING (id) GROUP BY nodes.id, kind)"""


@query("agg8_node_throughput", ask(GRAPH, _THROUGHPUT, "SELECT id, in_weight, out_weight, throughput FROM thr"))
def _(s, sf):
    g = graph(s, sf)
    return weights.node_throughput(g.nodes, g.flows).select("id", "in_weight", "out_weight", "throughput")


@query("agg9_node_degree_weight", ask(KEY_GRAPH, """SELECT id, greatest(1, coalesce(sum(w), 0))::BIGINT AS degree_weight
  FROM knodes LEFT JOIN (SELECT f AS id, len(cats) AS w FROM kflows UNION ALL SELECT t, len(cats) FROM kflows) USING (id)
  GROUP BY id"""))
def _(s, sf):
    g = inputs.key_graph(s, sf)
    return weights.node_degree_weight(g.nodes, g.flows).select("id", "degree_weight")


_KIND_TOTALS = """totals AS (SELECT kind, col_order, count(*) AS nodes, sum(throughput)::BIGINT AS throughput
  FROM thr JOIN kinds USING (kind) GROUP BY 1, 2)"""


@query("agg10_kind_totals", ask(GRAPH, _THROUGHPUT, KIND, _KIND_TOTALS,
                                """SELECT totals.*, (SELECT greatest(1, max(throughput)) FROM totals)::BIGINT AS max_throughput,
  (SELECT max(nodes) FROM totals) AS max_nodes FROM totals"""))
def _(s, sf):
    g = graph(s, sf)
    totals = weights.kind_totals(weights.node_throughput(g.nodes, g.flows))
    # five kinds at most; the key only pairs each row with the single row of maxima
    maxima = weights.kind_maxima(totals).withColumn("k", F.lit(1))
    return totals.withColumn("k", F.lit(1)).join(F.broadcast(maxima), "k").drop("k")


@query("agg11_label_dup_count", ask(GRAPH, "SELECT id, label, count(*) OVER (PARTITION BY label) AS label_count FROM nodes"))
def _(s, sf):
    return details.with_label_count(graph(s, sf).nodes).select("id", "label", "label_count")


@query("agg12_present_sensitivities", ask(GRAPH, """SELECT 'legend' AS place, sensitivity, min(id) AS position
  FROM categories WHERE sensitivity <> '' GROUP BY 1, 2
  UNION ALL SELECT DISTINCT 'chip', s, list_position(['pii', 'financial', 'credential', 'health', 'special', 'public'], s)::VARCHAR
  FROM (SELECT coalesce(nullif(sensitivity, ''), 'public') AS s FROM categories)"""))
def _(s, sf):
    c = graph(s, sf).categories
    legend = sensitivity.legend_sensitivities(c).select(F.lit("legend").alias("place"), "sensitivity",
                                                        F.col("first_id").alias("position"))
    chips = sensitivity.chip_sensitivities(c).select(F.lit("chip").alias("place"), "sensitivity",
                                                     F.col("position").cast("string"))
    return legend.unionByName(chips)


_DEPTH = """walk AS (SELECT id, 0 AS d FROM knodes WHERE id NOT IN (SELECT t FROM kflows)
  UNION SELECT k.t, w.d + 1 FROM walk w JOIN kflows k ON k.f = w.id),
depths AS (SELECT id, max(d)::INT AS depth FROM walk GROUP BY id)"""


def _depth(s, sf):
    g = inputs.key_graph(s, sf)
    return traversal.node_depth(g.nodes, g.flows)


query("grf1_node_depth", ask(KEY_GRAPH, _DEPTH, "SELECT id, depth FROM depths", recursive=True))(_depth)


@query("agg13_layer_sizes", ask(KEY_GRAPH, _DEPTH, """SELECT depth, count(*) AS nodes,
  max(depth) OVER () AS max_depth, max(count(*)) OVER () AS max_rows FROM depths GROUP BY depth""", recursive=True))
def _(s, sf):
    d = _depth(s, sf)
    most = traversal.layer_maxima(d).withColumn("k", F.lit(1))  # one row
    return traversal.layer_sizes(d).withColumn("k", F.lit(1)).join(F.broadcast(most), "k").drop("k")


_BOXED = """boxed AS (SELECT CASE WHEN f LIKE 'svc:%' THEN 'svc:app' ELSE f END AS f,
  CASE WHEN t LIKE 'svc:%' THEN 'svc:app' ELSE t END AS t, cat FROM flow_cat)"""
_BOXED_FLOWS = """SELECT f AS "from", t AS "to", string_agg(DISTINCT cat, ',' ORDER BY cat) AS categories,
  '' AS via, '' AS evidence FROM boxed WHERE f <> t GROUP BY f, t"""


@query("agg14_collapse", ask(GRAPH, _BOXED, _BOXED_FLOWS))
def _(s, sf):
    return flat(merge.collapse(graph(s, sf)).flows)


# ---- windows, order, sets -------------------------------------------------------

@query("win1_first_wins", ask(_RAW_FLOWS, """SELECT f AS "from", t AS "to",
  coalesce(first(via ORDER BY seq) FILTER (WHERE via <> ''), '') AS via,
  coalesce(first(evidence ORDER BY seq) FILTER (WHERE evidence <> ''), '') AS evidence
  FROM raw_flows WHERE f <> '' AND t <> '' AND f <> t GROUP BY f, t"""))
def _(s, sf):
    return merge.merge_flows(_raw_flows(s, sf)).select("from", "to", "via", "evidence")


@query("win2_last_relabel_wins", ask(INFRA, "SELECT id, label FROM relabels"))
def _(s, sf):
    return infra_source.store_relabels(inputs.infra_files(s, sf))


# identifiers of documents: words joined in pairs, so that "name" and "address" meet qualifiers
_PAIRS = values("left_word", "k, w", list(enumerate(
    ["first", "shipping", "soft", "contact", "home", "name", "email", "ip"]))) + ",\n" + values(
    "right_word", "k, w", list(enumerate(["name", "address", "Name", "Address", "legal", "street"]))) + """,
ids AS (SELECT l.w || CASE WHEN event_id % 2 = 0 THEN '_' ELSE '' END || r.w ||
    CASE WHEN event_id % 3 = 0 THEN '_' || event_type ELSE '' END AS id
  FROM events JOIN left_word l ON l.k = event_id % 8 JOIN right_word r ON r.k = user_id % 6)"""


def _pairs(s, sf):
    left = inputs._pick(["first", "shipping", "soft", "contact", "home", "name", "email", "ip"], "event_id % 8")
    right = inputs._pick(["name", "address", "Name", "Address", "legal", "street"], "user_id % 6")
    return inputs.table(s, sf, "events").select(F.concat(
        left, F.expr("if(event_id % 2 = 0, '_', '')"), right,
        F.expr("if(event_id % 3 = 0, concat('_', event_type), '')")).alias("id")).distinct()


@query("win3_neighbour_tokens", ask(_PAIRS, DICTIONARY,
    classified("ids"), "SELECT id, cat AS category FROM cls"))
def _(s, sf):
    return _pairs(s, sf).select("id", idf.classify_identifier(F.col("id")).alias("category"))


_OFFSETS = """SELECT f AS "from", t AS "to", n AS weight,
  coalesce(sum(n) OVER (PARTITION BY f ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
    AS source_offset,
  coalesce(sum(n) OVER (PARTITION BY t ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
    AS target_offset FROM flows"""


@query("win4_stacked_offsets", ask(GRAPH, _OFFSETS))
def _(s, sf):
    g = graph(s, sf)
    return weights.stacked_offsets(g.nodes, g.flows).drop("categories")


@query("win4_stacked_offsets_hub", ask(GRAPH, _OFFSETS + """ WHERE t = (SELECT t FROM flows GROUP BY t ORDER BY count(*) DESC, t LIMIT 1)"""))
def _(s, sf):
    g = graph(s, sf)
    hub = g.flows.groupBy("to").count().orderBy(F.desc("count"), "to").limit(1).select("to")
    return weights.stacked_offsets(g.nodes, g.flows.join(hub, "to", "left_semi")).drop("categories")


@query("srt1_finalize_order", ask(GRAPH, """SELECT id, kind, label, system, location FROM nodes
  WHERE id IN (SELECT f FROM flows UNION SELECT t FROM flows) ORDER BY id"""))
def _(s, sf):
    return merge.finalize(graph(s, sf)).nodes


@query("srt2_sorted_union", ask(_RAW_FLOWS, _MERGED_FLOWS, """SELECT f AS "from", t AS "to",
  coalesce(categories, '') AS categories FROM merged LEFT JOIN merged_cats USING (f, t)"""))
def _(s, sf):
    return flat(merge.merge_flows(_raw_flows(s, sf))).select("from", "to", "categories")


@query("srt3_vendor_order", ask(VENDOR, CALLS, """SELECT callee, min(token) AS vendor, count(DISTINCT token) AS vendors
  FROM (SELECT DISTINCT callee FROM calls) JOIN vendors ON contains(lower(callee), token) GROUP BY callee"""))
def _(s, sf):
    low = F.lower("callee")
    hits = sum((F.when(low.contains(t), 1).otherwise(0) for t, _ in dims.VENDORS), F.lit(0))
    return (inputs.calls(s, sf).select("callee").distinct()
            .select("callee", tgt.match_vendor(low).alias("vendor"), hits.cast("bigint").alias("vendors"))
            .filter("vendor IS NOT NULL"))


@query("srt4_kind_order", ask(KEY_GRAPH, KIND, """SELECT kind, col_order, count(*) AS nodes
  FROM knodes JOIN kinds USING (kind) GROUP BY 1, 2 ORDER BY col_order"""))
def _(s, sf):
    n = inputs.key_graph(s, sf).nodes
    return (n.groupBy("kind", txt.kind_order(F.col("kind")).alias("col_order"))
            .agg(F.count("*").alias("nodes")).orderBy("col_order"))


@query("set1_union_categories", ask(_RAW_FLOWS, """SELECT seq, nullif(array_to_string(list_sort(list_distinct(
  list_concat(cats, [event_type]))), ','), '') AS categories FROM raw_flows JOIN events ON event_id = seq"""))
def _(s, sf):
    e = inputs.table(s, sf, "events").select(F.col("event_id").alias("seq"), "event_type")
    both = _raw_flows(s, sf).join(e, "seq")
    return both.select("seq", F.array_join(txt.union_categories(F.col("categories"), F.array("event_type")), ",")
                       .alias("categories"))


@query("set2_union_endpoints", ask(KEY_GRAPH, "SELECT f AS id FROM kflows UNION SELECT t FROM kflows"))
def _(s, sf):
    return merge.endpoints(inputs.key_graph(s, sf).flows)


# ---- scalar functions -----------------------------------------------------------

@query("scl1_url_host", "SELECT page_id, regexp_extract(url, 'https?://([a-zA-Z0-9.\\-]+)', 1) AS host, "
                        "regexp_extract(html, 'https?://([a-zA-Z0-9.\\-]+)', 1) AS first_link_host FROM pages")
def _(s, sf):
    return inputs.table(s, sf, "pages").select("page_id", tgt.url_host(F.col("url")).alias("host"),
                                               tgt.url_host(F.col("html")).alias("first_link_host"))


_FAMILY = ask(CALLS, RULES, "SELECT DISTINCT callee, family FROM flags")


@query("scl2_store_family", _FAMILY)
def _(s, sf):
    recv = tgt.receiver_of(F.lower("callee"))
    return inputs.calls(s, sf).select("callee", tgt.store_family(recv).alias("family")).distinct()


@query("scl3_store_label", ask(CALLS, RULES, """SELECT DISTINCT callee, CASE family WHEN 'cache' THEN 'Redis / cache'
  WHEN 'object' THEN 'Object store' WHEN 'mongo' THEN 'MongoDB' WHEN 'dynamo' THEN 'DynamoDB' ELSE 'Database' END AS label
  FROM flags"""))
def _(s, sf):
    family = tgt.store_family(tgt.receiver_of(F.lower("callee")))
    return inputs.calls(s, sf).select("callee", tgt.store_label(family).alias("label")).distinct()


@query("scl4_classify_call", ask(CALLS, TARGETS, """SELECT start_byte, tid AS target_id, tlabel AS target_label,
  tkind AS target_kind, callee AS via FROM targets"""))
def _(s, sf):
    return tgt.with_target(inputs.calls(s, sf)).select("start_byte", "target_id", "target_label", "target_kind",
                                                       F.col("callee").alias("via"))


@query("scl5_identifiers", """SELECT id, count(*) AS occurrences FROM (
  SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS id FROM documents) GROUP BY id""")
def _(s, sf):
    return (inputs.spread(inputs.table(s, sf, "documents").select("text"))
            .select(F.explode(idf.identifiers(F.col("text"))).alias("id")).groupBy("id").agg(F.count("*").alias("occurrences")))


_DOC_IDS = """ids AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS id FROM documents
  UNION ALL SELECT unnest(regexp_extract_all(args_text, '[A-Za-z_][A-Za-z0-9_]*')) FROM calls
  UNION ALL SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) FROM conversations
  UNION ALL SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) FROM benchmark
  UNION ALL SELECT url FROM pages)"""


def _doc_ids(s, sf):
    texts = reduce(DataFrame.unionByName, [inputs.spread(inputs.table(s, sf, t).select("text")) for t in ("documents", "conversations", "benchmark")])
    args = inputs.calls(s, sf).select(F.col("args_text").alias("text"))
    ids = texts.unionByName(args).select(F.explode(idf.identifiers(F.col("text"))).alias("id"))
    return ids.unionByName(inputs.table(s, sf, "pages").select(F.col("url").alias("id"))).distinct()


@query("scl6_identifier_tokens", ask(CALLS, _DOC_IDS, tokens_of("ids"),
                                     "SELECT id, array_to_string(tk, ' ') AS tokens FROM toks"))
def _(s, sf):
    return _doc_ids(s, sf).select("id", F.array_join(idf.identifier_tokens(F.col("id")), " ").alias("tokens"))


@query("scl7_classify_identifier", ask(CALLS, _DOC_IDS, DICTIONARY,
    classified("ids"), "SELECT id, cat AS category FROM cls"))
def _(s, sf):
    return _doc_ids(s, sf).select("id", idf.classify_identifier(F.col("id")).alias("category"))


@query("jon1_dictionary_join", ask(CALLS, _DOC_IDS, DICTIONARY,
    classified("ids"), "SELECT id, cat AS category FROM cls"))
def _(s, sf):
    return dictionary.classify_names(_doc_ids(s, sf), dims.dim_pii_token(s), dims.dim_qualifier(s))


@query("scl8_categories_in", ask(CALLS, CALL_CATS, _CATS_PER_CALL, """SELECT start_byte, coalesce(categories, '') AS categories
  FROM calls LEFT JOIN per_call USING (start_byte)"""))
def _(s, sf):
    return inputs.calls(s, sf).select(
        "start_byte", F.array_join(idf.categories_in(F.col("args_text")), ",").alias("categories"))


_DOCUMENT_CATS = ask("""texts AS (SELECT doc_id, text FROM documents),
ids AS (SELECT doc_id, unnest(l) AS id, generate_subscripts(l, 1) AS pos FROM (
  SELECT doc_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*') AS l FROM texts))""",
    DICTIONARY,
    classified("ids"), """doc_cats AS (SELECT doc_id, cat, min(pos) AS pos FROM ids JOIN cls USING (id)
  WHERE cat IS NOT NULL GROUP BY doc_id, cat)""",
    """SELECT d.doc_id, coalesce(string_agg(cat, ',' ORDER BY pos), '') AS categories
  FROM documents d LEFT JOIN doc_cats USING (doc_id) GROUP BY d.doc_id""")


@query("scl8_categories_in_documents", _DOCUMENT_CATS)
def _(s, sf):
    return inputs.spread(inputs.table(s, sf, "documents").select("doc_id", "text")).select(
        "doc_id", F.array_join(idf.categories_in(F.col("text")), ",").alias("categories"))


@query("scl8_categories_by_dictionary_join", _DOCUMENT_CATS)
def _(s, sf):
    docs = inputs.spread(inputs.table(s, sf, "documents").select("doc_id", "text"))
    found = dictionary.categories_of(docs, "doc_id", "text", dims.dim_pii_token(s), dims.dim_qualifier(s))
    return found.select("doc_id", F.array_join("categories", ",").alias("categories"))


@query("scl9_sensitivity_rank", ask(RANK, _RAW_CATS, """SELECT seq, coalesce(rnk, 0)::INT AS rank FROM raw
  LEFT JOIN ranks ON ranks.sensitivity = raw.sensitivity"""))
def _(s, sf):
    sens = inputs._pick(_SENS, "(event_id div 7) % (1 + user_id % 8)")
    return inputs.table(s, sf, "events").select(F.col("event_id").alias("seq"), txt.sensitivity_rank(sens).alias("rank"))


@query("scl10_infra_words", ask(INFRA, "SELECT walk_key, pos::INT - 1 AS pos, token AS word FROM infra_words"))
def _(s, sf):
    return inputs.infra_files(s, sf).select(
        "walk_key", F.posexplode(infra_source.infra_words(F.col("src"))).alias("pos", "word"))


@query("scl11_edge_label", ask(KEY_GRAPH, """SELECT f AS "from", t AS "to", CASE WHEN list_contains(cats, 'card') THEN 'Card details'
  WHEN list_contains(cats, 'email') THEN 'Email' WHEN list_contains(cats, 'name') THEN 'Name' ELSE '' END AS labels
  FROM kflows"""))
def _(s, sf):
    g = inputs.key_graph(s, sf)
    return details.edge_labels(g.flows, g.categories.filter("id <> 'geo'"))


@query("scl12_node_subtitle", ask(GRAPH, """counted AS (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM nodes),
dirs AS (SELECT *, string_split(regexp_replace(location, '/[^/]*$', ''), '/') AS parts FROM counted)""",
    """SELECT id, CASE WHEN n > 1 AND location <> '' THEN CASE WHEN len(parts) > 3
    THEN '…/' || array_to_string(parts[-2:], '/') ELSE array_to_string(parts[2:], '/') END ELSE kind END AS subtitle
  FROM dirs"""))
def _(s, sf):
    return details.with_subtitle(graph(s, sf).nodes).select("id", "subtitle")


@query("scl12_path_subtitle", ask("""parts AS (SELECT page_id, string_split(url, '/')[4:] AS p, url FROM pages),
loc AS (SELECT page_id, array_to_string(string_split(url, '/')[3:], '/') AS location,
  string_split(url, '/')[3] AS system, p, string_split(url, '/')[3:] AS all_parts FROM parts)""",
    """SELECT page_id, CASE WHEN len(all_parts) <= 2 THEN array_to_string(all_parts[:1], '/')
    WHEN len(p) - 1 > 2 THEN '…/' || array_to_string(p[:-2][-2:], '/')
    ELSE array_to_string(p[:-2], '/') END AS subtitle FROM loc"""))
def _(s, sf):
    location = F.regexp_replace("url", "^https?://", "")
    system = F.element_at(F.split(location, "/"), 1)
    return inputs.table(s, sf, "pages").select(
        "page_id", txt.node_subtitle(F.lit(2), location, system, F.lit("service")).alias("subtitle"))


# ---- compositions ---------------------------------------------------------------

_FILE_CALLS = CALLS.replace("calls AS (", "event_calls AS (") + """,
calls AS (SELECT root_idx, 'events' AS base, 'b' || (start_byte // 50) || '.py' AS rel, start_byte, end_byte,
  start_byte % 50 + 1 AS line, callee, args_text, full_text FROM event_calls)"""
_FILE_GRAPH = ",\n".join([_FILE_CALLS, CALL_CATS, TARGETS, KEPT, CATEGORY, INFRA, GRAPH[GRAPH.index("raw_nodes AS"):]])


@query("scan_files_flows", ask(_FILE_GRAPH, 'SELECT f AS "from", t AS "to", categories, via, evidence FROM flows'))
def _(s, sf):
    return flat(scans.graph_from_files(routed_files(inputs.source_files(s, sf))).flows)


@query("scan_files_nodes", ask(_FILE_GRAPH, "SELECT id, kind, label, system, location FROM nodes"))
def _(s, sf):
    return scans.graph_from_files(routed_files(inputs.source_files(s, sf))).nodes


@query("graph_from_calls_flows", ask(GRAPH, 'SELECT f AS "from", t AS "to", categories, via, evidence FROM flows'))
def _(s, sf):
    return flat(graph(s, sf).flows)


@query("graph_from_calls_nodes", ask(GRAPH, "SELECT id, kind, label, system, location FROM nodes"))
def _(s, sf):
    return graph(s, sf).nodes


@query("graph_from_calls_categories", ask(GRAPH, "SELECT id, label, sensitivity FROM categories"))
def _(s, sf):
    return graph(s, sf).categories


@query("blackbox_nodes", ask(GRAPH, """SELECT id, kind, label, system, location FROM nodes WHERE kind <> 'service'
  UNION ALL SELECT 'svc:app', 'service', 'Application', '', '' WHERE EXISTS (SELECT 1 FROM flows)"""))
def _(s, sf):
    return views.blackbox(graph(s, sf)).nodes


@query("flow_volume_ribbons", ask(GRAPH, RANK, _DOMINANT, "o AS (" + _OFFSETS + ")",
                                  'SELECT o.*, sensitivity FROM o JOIN loud ON loud.f = o."from" AND loud.t = o."to"'))
def _(s, sf):
    return views.flow_volume(graph(s, sf)).ribbons.drop("categories")


@query("flow_volume_nodes", ask(GRAPH, _THROUGHPUT, "SELECT id, kind, throughput FROM thr"))
def _(s, sf):
    return views.flow_volume(graph(s, sf)).nodes.select("id", "kind", "throughput")


_VISIBLE = """seen AS (SELECT f, t, cats FROM kflows
  WHERE list_contains(cats, 'card') OR list_contains(cats, 'unseen'))"""


@query("view_flows", ask(KEY_GRAPH, _VISIBLE, """SELECT f AS "from", t AS "to", 'financial' AS sensitivity FROM seen"""))
def _(s, sf):
    return views.view(inputs.key_graph(s, sf), ["financial"]).flows.select("from", "to", "sensitivity")


@query("view_nodes", ask(KEY_GRAPH, _VISIBLE, """SELECT id, kind FROM knodes WHERE id IN (SELECT f FROM seen UNION SELECT t FROM seen)"""))
def _(s, sf):
    return views.view(inputs.key_graph(s, sf), ["financial"]).nodes.select("id", "kind")


@query("sensitive_leaks", ask(GRAPH, RANK, _DOMINANT, """SELECT f AS "from", t AS "to", n.kind AS to_kind, n.label AS to_label, sensitivity
  FROM loud JOIN nodes n ON n.id = t AND n.kind IN ('sink', 'external') WHERE sensitivity NOT IN ('', 'public')"""))
def _(s, sf):
    return details.sensitive_leaks(graph(s, sf))


_JSON_ROWS = """json_rows AS (
  SELECT 0 AS section, id AS key, '{"id":"' || id || '","label":"' || label || '","sensitivity":"' || sensitivity || '"}' AS body
  FROM categories
  UNION ALL SELECT 1, id, '{"id":"' || id || '","kind":"' || kind || '","label":"' || label || '"'
    || CASE WHEN system <> '' THEN ',"system":"' || system || '"' ELSE '' END
    || CASE WHEN location <> '' THEN ',"location":"' || location || '"' ELSE '' END || '}' FROM nodes
  UNION ALL SELECT 2, f || '|' || t, '{"from":"' || f || '","to":"' || t || '","categories":["' || replace(categories, ',', '","') || '"]'
    || CASE WHEN via <> '' THEN ',"via":"' || via || '"' ELSE '' END
    || CASE WHEN evidence <> '' THEN ',"evidence":"' || evidence || '"' ELSE '' END || '}' FROM flows),
json_ends(section, step, line) AS (VALUES (0, 0, '{' || chr(10) || '  "categories": ['), (0, 2, '  ],'), (1, 0, '  "nodes": ['),
  (1, 2, '  ],'), (2, 0, '  "flows": ['), (2, 2, '  ]' || chr(10) || '}'))"""


@query("snk1_graph_json", ask(GRAPH, _JSON_ROWS, """SELECT section, 1 AS step, key,
    CASE WHEN row_number() OVER (PARTITION BY section ORDER BY string_split(key, '|')) = 1 THEN '    ' ELSE '  , ' END || body AS line
  FROM json_rows UNION ALL SELECT section, step, '', line FROM json_ends"""))
def _(s, sf):
    return graph_json.json_lines(graph(s, sf)).withColumn("key", F.array_join("key", "|"))


@query("snk2_graph_summary", ask(GRAPH, """SELECT nodes, flows, nodes || ' nodes, ' || flows || ' flows' AS summary
  FROM (SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM flows) AS flows)"""))
def _(s, sf):
    return views.graph_summary(graph(s, sf))
