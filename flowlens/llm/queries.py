"""One query per operator with production parameters over its whole tables, and SQL where SQL can express it."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, hard_negatives, language_id, licenses, line_dedup, packing, quality, repeats, secret_scan, simhash,
               toxicity, warc, word_runs)
from .common import bucket, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language_id.train(docs.filter(~held_out))
    return language_id.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.matches(table(spark, sf_dir, "documents"))
    return found.select(*[F.when(F.col(c) != line_dedup.LAST, F.col(c)).alias(n) for c, n in (("doc", "doc_id"), ("match_doc", "match_doc"))],
                        "version", "line", "n", "removed", "match_line", "c1", "c2", "n_links")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("payload")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    base = F.filter("spans", lambda s: s["kind_order"] < len(secret_scan.BASE))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind_order = {i})) AS bigint)").alias(f"n_{rule[0]}")
              for i, rule in enumerate(secret_scan.BASE)]
    return found.select("doc_id", *counts, F.sha2(secret_scan.as_text(base), 256).alias("base_sha256"),
                        secret_scan.as_text(F.col("spans")).alias("spans"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.detect(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"),
                        public_tokenizers.path("word_bpe_49k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    grammar = toxicity.train(toxicity.labelled(docs.filter(~held_out), labels.select("doc_id", "toxic")))
    return toxicity.judge(docs.select("doc_id", "text", held_out.alias("held_out")), grammar).drop("text")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality.judge(docs, quality.weights(docs, trusted)).drop("text")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` where texts of a tenth of the ids repeat their words with a period from a certain word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    split = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")
    docs = docs.withColumns({"_g": g, "_words": F.when(h % 10 == 0, split)})
    n = F.size("_words").cast("long")
    docs = docs.withColumn("_a", F.expr("_g % size(_words)")).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))
    changed = F.expr("array_join(transform(_words, (w, i) -> CASE WHEN i < _a THEN w ELSE get(_words, cast(_a + (i - _a) % _p AS int)) END), ' ')")
    return docs.withColumn("text", F.when(F.size("_words") > 0, changed).otherwise(F.col("text"))).drop("_g", "_words", "_a", "_p")


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs.runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.expr("""reduce(runs, cast(null AS struct<start: bigint, length: bigint, period: bigint>), (b, r) -> CASE
        WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)""")  # the first of equals, as runs are in order
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    found = found.withColumn("best", best)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hard_negatives.whole_vectors(table(spark, sf_dir, "embeddings").withColumn("label", label))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_line_dedup, op3_warc, op4_secret_scan, op5_license_scan, op6_packing,
                                  op7_toxicity, op8_simhash, op9_quality, op10_decontamination, op11_repeats, op12_word_runs,
                                  op13_hard_negatives, pipeline)}

def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_LOWERED = f"translate(coalesce(text, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}')"
_WORDS = f"regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OP10 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS k FROM i)),
places AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT * FROM places SEMI JOIN windows USING (n, win)),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits JOIN windows USING (n, win)) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN found USING (doc_id)"""


def _kind_sql(order: int, rule: tuple) -> str:
    kind, pattern, group, least, _ = rule
    p = _text(pattern)
    counted = f"len(regexp_extract(m, {p}, {group})) >= {least}" if group else "true"
    return f"""SELECT doc_id, {order} AS o, {_text(kind)} AS kind, stop - len(m) AS start, stop FROM (
  SELECT doc_id, m, (sum(len(g) + len(m)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS stop FROM (
    SELECT doc_id, i, ms[i] AS m, gs[i] AS g FROM (
      SELECT doc_id, ms, string_split_regex(t, {p}) AS gs, unnest(generate_series(1, len(ms))) AS i FROM (
        SELECT doc_id, t, regexp_extract_all(t, {p}) AS ms FROM texts)))) WHERE {counted}"""


_OP4 = "WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),\nspans AS (" + "\nUNION ALL ".join(
    _kind_sql(i, r) for i, r in enumerate(secret_scan.RULES)) + """),
per AS (SELECT doc_id, count_if(o = 0) AS n_assign, count_if(o = 1) AS n_access, count_if(o = 2) AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) FILTER (o < 3) AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN per USING (doc_id)"""

_OP13 = """WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, coalesce(list_dot_product(a.v, b.v), 0)::BIGINT AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10"""

#: Learned models, tokenizer ids, XXH64 fingerprints and hashed n-grams have no SQL form; tests hold those queries against brute force.
SQL: dict[str, str] = {"op4_secret_scan": _OP4, "op10_decontamination": _OP10, "op13_hard_negatives": _OP13}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
