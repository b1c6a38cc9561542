"""WITH-clauses shared by the SQL forms of the queries (DuckDB dialect).

They restate the rules relationally: identifiers and tokens are rows, dictionaries are joined.
"""

from __future__ import annotations

from flowlens import dims
from flowlens.sources.languages import builtin_languages

from .inputs import IDENTIFIERS, INFRA_WORDS, VOCABULARY


def lit(value) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def words(ws) -> str:
    return ", ".join(lit(w) for w in ws)


def ask(*parts: str, recursive: bool = False) -> str:
    """The WITH-clauses of all but the last part, then the last part."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts[:-1]) + "\n" + parts[-1]


DICTIONARY = values("dict", "token, cat, label, sens", dims.builtin_pii_tokens())
CATEGORY = values("cat_dim", "id, label, sensitivity", dims.BUILTIN.categories())
VENDOR = values("vendors", "token, name", dims.VENDORS)
RANK = values("ranks", "sensitivity, rnk", [(s, r) for s, r, _ in dims.SENSITIVITIES])
KIND = values("kinds", "kind, col_order", [(k, o) for k, o, _ in dims.KINDS])
LANGUAGE = values("langs", "pattern, language", builtin_languages())

CALLS = ",\n".join([
    values("vocab", "k, callee, url", [(i, c, u) for i, (c, u) in enumerate(VOCABULARY)]),
    values("ident", "k, name", list(enumerate(IDENTIFIERS))),
    """calls AS (
  SELECT 0 AS root_idx, event_type AS base, 'svc' || (user_id % 40) || '/h' || (event_id % 5) || '.py' AS rel,
         event_id AS start_byte, event_id + 1 AS end_byte, event_id + 1 AS line, callee, args_text,
         callee || args_text AS full_text
  FROM (SELECT e.event_id, e.user_id, e.event_type, v.callee,
               '(' || CASE WHEN v.url <> '' THEN '"' || v.url || '", ' ELSE '' END || a.name || ', ' || b.name || ')'
                 AS args_text
        FROM events e JOIN vocab v ON v.k = e.event_id % 24
        JOIN ident a ON a.k = (e.event_id // 24) % 20 JOIN ident b ON b.k = (e.user_id * 7 + e.event_id) % 20))"""])


def tokens_of(source: str, name: str = "toks") -> str:
    """Token list of each distinct ``id`` of a table, joined form included."""
    return f"""{name} AS (
  SELECT id, tk, array_to_string(tk, '') AS joined FROM (
    SELECT id, list_filter(regexp_split_to_array(lower(regexp_replace(
      regexp_replace(id, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[-_./]', ' ', 'g')), '\\s+'),
      lambda t: t <> '') AS tk
    FROM (SELECT DISTINCT id FROM {source})))"""


def classified(source: str) -> str:
    """``cls(id, cat)``: the category of each distinct ``id`` of a table."""
    return tokens_of(source) + f""",
entries AS (SELECT map_from_entries(list({{'k': token, 'v': cat}})) AS known FROM dict),
cls AS (SELECT id, coalesce(known[joined], list_filter(list_transform(tk, lambda t, i: coalesce(known[t],
          CASE WHEN t = 'name' AND (tk[i - 1] IN ({words(dims.NAME_QUALIFIERS)})
                                    OR tk[i + 1] IN ({words(dims.NAME_QUALIFIERS)})) THEN 'name'
               WHEN t = 'address' AND (tk[i - 1] IN ({words(dims.ADDRESS_QUALIFIERS)})
                                       OR tk[i + 1] IN ({words(dims.ADDRESS_QUALIFIERS)})) THEN 'address' END)),
          lambda c: c IS NOT NULL)[1]) AS cat
        FROM toks, entries)"""


IDS = DICTIONARY + """,
ids AS (SELECT start_byte, unnest(l) AS id, generate_subscripts(l, 1) AS pos FROM (
  SELECT start_byte, regexp_extract_all(args_text, '[A-Za-z_][A-Za-z0-9_]*') AS l FROM calls))"""
CALL_CATS = IDS + ",\n" + classified("ids") + """,
call_cats AS (SELECT start_byte, cat, min(pos) AS pos FROM ids JOIN cls USING (id)
              WHERE cat IS NOT NULL GROUP BY start_byte, cat)"""

_W = "\\b({})\\b"
PLACEHOLDER = ("(?i)\\b(example\\.com|test|foo|bar|baz|john\\.?doe|jane\\.?doe|lorem|dummy|sample|placeholder|"
               "xxx+|changeme|your[-_]?)\\b")
COMMS = "(" + "|".join(dims.COMMS_WORDS) + "|\\bnotify\\b)"
STORE_WORD = _W.format("|".join(dims.STORE_RECEIVERS))
LOG_WORD = _W.format("|".join(dims.LOG_RECEIVERS))
HTTP_WORD = _W.format("|".join(dims.HTTP_RECEIVERS))

SPLIT = """split AS (SELECT *, lower(callee) AS low,
  CASE WHEN regexp_matches(callee, '[.:>]') THEN regexp_extract(lower(callee), '(?s)^(.*)[.:>][^.:>]*$', 1)
       ELSE '' END AS recv,
  regexp_extract(lower(callee), '[^.:>]*$', 0) AS method,
  regexp_extract(full_text, 'https?://([a-zA-Z0-9.\\-]+)', 1) AS host FROM calls)"""
RULES = SPLIT + f""",
flags AS (SELECT *, regexp_matches(low, '{COMMS}') AS is_comms,
  (regexp_matches(recv, '{HTTP_WORD}') AND method IN ({words(dims.HTTP_METHODS)})) OR method = 'fetch' AS is_http,
  regexp_matches(recv, '{LOG_WORD}') OR method IN ({words(dims.LOG_METHODS)}) AS is_log,
  method IN ({words(dims.STORE_METHODS)}) AND (regexp_matches(recv, '{STORE_WORD}')
    OR method IN ('insert', 'upsert', 'save')) AS is_store,
  CASE regexp_extract(recv, '{STORE_WORD}', 1) WHEN '' THEN ''
    WHEN 'redis' THEN 'cache' WHEN 'rdb' THEN 'cache' WHEN 'cache' THEN 'cache' WHEN 'kv' THEN 'cache'
    WHEN 's3' THEN 'object' WHEN 'gcs' THEN 'object' WHEN 'blob' THEN 'object' WHEN 'bucket' THEN 'object'
    WHEN 'mongo' THEN 'mongo' WHEN 'mongodb' THEN 'mongo'
    WHEN 'dynamo' THEN 'dynamo' WHEN 'dynamodb' THEN 'dynamo' ELSE 'db' END AS family FROM split)"""
TARGETS = VENDOR + ",\n" + RULES + f""",
vend AS (SELECT f.*, v.token AS cv, h.token AS hv FROM flags f
  LEFT JOIN (SELECT low, min(token) AS token FROM (SELECT DISTINCT low FROM flags), vendors
             WHERE contains(low, token) GROUP BY low) v USING (low)
  LEFT JOIN (SELECT host, min(token) AS token FROM (SELECT DISTINCT host FROM flags), vendors
             WHERE contains(lower(host), token) GROUP BY host) h USING (host)),
routed AS (SELECT *, CASE WHEN cv IS NOT NULL THEN 'ext:' || cv WHEN is_comms THEN 'ext:comms'
    WHEN is_http THEN CASE WHEN host = '' OR regexp_matches(host, '{PLACEHOLDER}') THEN 'ext:http'
                           WHEN hv IS NOT NULL THEN 'ext:' || hv ELSE 'ext:' || host END
    WHEN is_log THEN 'sink:log'
    WHEN is_store THEN 'store:' || CASE family WHEN '' THEN 'db' ELSE family END END AS tid FROM vend),
targets AS (SELECT r.*, split_part(tid, ':', 1) AS prefix,
    CASE WHEN tid IS NULL THEN NULL WHEN v.name IS NOT NULL AND tid LIKE 'ext:%' THEN v.name
         WHEN tid = 'ext:comms' THEN 'Email / messaging' WHEN tid = 'ext:http' THEN 'External HTTP'
         WHEN tid LIKE 'ext:%' THEN substr(tid, 5) WHEN tid = 'sink:log' THEN 'Logs'
         ELSE CASE family WHEN '' THEN 'Data store' WHEN 'cache' THEN 'Redis / cache' WHEN 'object' THEN 'Object store'
              WHEN 'mongo' THEN 'MongoDB' WHEN 'dynamo' THEN 'DynamoDB' ELSE 'Database' END END AS tlabel,
    CASE split_part(tid, ':', 1) WHEN 'ext' THEN 'external' ELSE split_part(tid, ':', 1) END AS tkind,
    CASE split_part(tid, ':', 1) WHEN 'ext' THEN 'Third parties' WHEN 'sink' THEN 'Sinks'
         WHEN 'store' THEN 'Data stores' END AS tsystem
  FROM routed r LEFT JOIN vendors v ON tid = 'ext:' || v.token)"""
# one row per kept call and category
KEPT = """kept AS (SELECT t.*, c.cat, c.pos, 'svc:' || base || '/' || rel AS svc, rel || ':' || line AS ev,
    {'r': rel, 's': start_byte} AS seq FROM targets t JOIN call_cats c USING (start_byte) WHERE tid IS NOT NULL)"""
INFRA = ",\n".join([
    values("infra_word", "k, w", list(enumerate(INFRA_WORDS))),
    values("infra_dim", "token, id, label", dims.INFRA_TOKENS),
    """infra_files AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS walk_key,
    'resource "' || w || '" "main" {}' AS src FROM part JOIN infra_word ON k = p_partkey % 20)""",
    """infra_words AS (SELECT walk_key, unnest(l) AS token, generate_subscripts(l, 1) AS pos FROM (
    SELECT walk_key, regexp_extract_all(lower(src), '[a-zA-Z0-9_]+') AS l FROM infra_files))""",
    """relabels AS (SELECT d.id, arg_max(d.label, {'w': walk_key, 'p': pos}) AS label
    FROM infra_words w JOIN infra_dim d ON d.token = w.token GROUP BY d.id)"""])
GRAPH_OF_KEPT = """raw_nodes AS (
    SELECT svc AS id, 'service' AS kind, split_part(rel, '/', -1) AS label, base AS system,
           base || '/' || rel AS location, seq FROM kept
    UNION ALL SELECT tid, tkind, tlabel, tsystem, '', seq FROM kept),
plain_nodes AS (SELECT id, arg_min(kind, seq) AS kind, arg_min(label, seq) AS label, arg_min(system, seq) AS system,
           arg_min(location, seq) AS location FROM raw_nodes GROUP BY id
    UNION ALL SELECT 'source:user', 'source', 'User', 'People', '' WHERE EXISTS (SELECT 1 FROM kept)),
nodes AS (SELECT n.id, n.kind, coalesce(r.label, n.label) AS label, n.system, n.location
    FROM plain_nodes n LEFT JOIN relabels r USING (id)),
flow_cat AS (SELECT DISTINCT svc AS f, tid AS t, cat FROM kept UNION SELECT 'source:user', svc, cat FROM kept),
flows AS (SELECT c.f, c.t, c.categories, coalesce(k.via, '') AS via, coalesce(k.ev, '') AS evidence, n
    FROM (SELECT f, t, string_agg(cat, ',' ORDER BY cat) AS categories, count(*) AS n FROM flow_cat GROUP BY f, t) c
    LEFT JOIN (SELECT svc, tid, arg_min(callee, start_byte) AS via, arg_min(ev, start_byte) AS ev
               FROM kept GROUP BY svc, tid) k ON k.svc = c.f AND k.tid = c.t),
categories AS (SELECT * FROM cat_dim WHERE id IN (SELECT cat FROM kept))"""
# the graph of the calls: kept, nodes, flow_cat, flows, categories
GRAPH = ",\n".join([CALLS, CALL_CATS, TARGETS, KEPT, CATEGORY, INFRA, GRAPH_OF_KEPT])

KEY_GRAPH = """knodes AS (
    SELECT 'region:' || r_regionkey AS id, 'source' AS kind, r_name AS label FROM region
    UNION ALL SELECT 'nation:' || n_nationkey, 'service', n_name FROM nation
    UNION ALL SELECT 'cust:' || c_custkey, 'store', '' FROM customer
    UNION ALL SELECT 'order:' || o_orderkey, 'external', '' FROM orders
    UNION ALL SELECT 'part:' || p_partkey, 'sink', p_name FROM part),
kflows AS (
    SELECT 'region:' || n_regionkey AS f, 'nation:' || n_nationkey AS t, ['geo'] AS cats FROM nation
    UNION ALL SELECT 'nation:' || c_nationkey, 'cust:' || c_custkey, ['geo', 'name'] FROM customer
    UNION ALL SELECT 'cust:' || o_custkey, 'order:' || o_orderkey, ['card'] FROM orders
    UNION ALL SELECT 'region:' || n_regionkey, 'cust:' || c_custkey, ['email']
      FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

PATHS = ",\n".join([
    values("dirs", "k, d", list(enumerate(
        ["src", "node_modules/x", ".git", "a/.hid", "k8s", "deploy", "app/build", "lib"]))),
    values("exts", "k, x", list(enumerate([".py", ".ts", ".go", ".tf", ".yaml", ".json", ".min.js", ".lock"]))),
    """paths AS (SELECT 'docs' AS base, d || '/f' || doc_id || x AS rel, 'f' || doc_id || x AS name,
    'docs/' || d || '/f' || doc_id || x AS path, n_chars AS length
  FROM documents JOIN dirs ON dirs.k = doc_id % 8 JOIN exts ON exts.k = (doc_id // 8) % 8)""",
    f"""pruned AS (SELECT * FROM paths WHERE len(list_filter(string_split(rel, '/')[:-2],
    lambda s: s IN ({words(dims.IGNORED_DIRS)}) OR s LIKE '.%')) = 0)""",
    f"""sized AS (SELECT * FROM pruned WHERE length > 0 AND length <= 1048576),
named AS (SELECT * FROM sized WHERE regexp_extract(lower(name), '\\.[^.]*$') NOT IN ({words(dims.SKIPPED_EXTENSIONS)})
    AND lower(name) NOT IN ({words(dims.LOCKFILES)}) AND NOT contains(lower(name), '.min.'))""",
    LANGUAGE,
    """spoken AS (SELECT n.*, l.language FROM named n LEFT JOIN langs l
    ON l.pattern = regexp_extract(lower(name), '\\.[^.]*$'))""",
    """infra_routed AS (SELECT *, coalesce(regexp_matches(lower(name), '\\.(tf|tfvars)$')
    OR lower(name) LIKE 'docker-compose%' OR lower(name) LIKE 'compose.%' OR lower(name) LIKE 'serverless.%'
    OR lower(name) IN ('chart.yaml', 'values.yaml') OR coalesce(language IN ('hcl', 'terraform'), false)
    OR (regexp_matches(lower(name), '\\.ya?ml$')
        AND regexp_matches(lower(path), 'k8s|kubernetes|manifest|/deploy|chart|helm')), false) AS is_infra
  FROM spoken)"""])
