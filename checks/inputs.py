"""Library inputs derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.dims import quoted
from flowlens.model import Graph
from flowlens.session import cut

# callee, url
VOCABULARY = [
    ("db.save", ""), ("user_repo.insert", ""), ("redis.set", ""), ("s3.putItem", ""), ("mongo.insertOne", ""),
    ("dynamodb.put_item", ""), ("cache.add", ""), ("stripe.Customer.create", ""),
    ("analytics.segment.track", ""), ("mailer.send", ""), ("queue.publish", ""),
    ("requests.post", "https://api.stripe.com/v1"), ("axios.get", "https://api.partner-site.io/x"),
    ("fetch", "https://api.example.com/x"), ("http.Post", ""), ("httpClient->send", "http://localhost:8080"),
    ("log.info", ""), ("console.error", ""), ("printf", ""), ("order.total", ""), ("session.query", ""),
    ("Slack::Sentry.notify", ""), ("repo.fetch", ""), ("text.format", ""),
]
IDENTIFIERS = ("email userEmail phone_number customerName first_name userName cardNumber my_card_number card ssn "
               "password apiKey diagnosis religion shippingAddress ipAddress latitude total HTTPEmail address").split()
INFRA_WORDS = [
    "aws_db_instance", "aws_rds_cluster", "google_sql_database_instance", "azurerm_postgresql_server",
    "digitalocean_database_cluster", "postgres", "postgresql", "mysql", "mariadb", "cockroach", "aws_s3_bucket",
    "google_storage_bucket", "azurerm_storage_account", "aws_elasticache_cluster", "redis", "memcached",
    "aws_dynamodb_table", "mongo", "mongodb", "unknown_thing",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """All cores on a supplied table: each is one file with one row group, so one task would read it."""
    return scan.repartition(scan.sparkSession.sparkContext.defaultParallelism)


def _pick(words: list[str], index: str):
    """words[index] without a join."""
    listed = ", ".join(quoted(w) for w in words)
    return F.expr(f"get(array({listed}), cast({index} AS int))")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call per event."""
    e = spread(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"))
    e = e.select(
        "*", _pick([c for c, _ in VOCABULARY], "event_id % 24").alias("callee"),
        _pick([u for _, u in VOCABULARY], "event_id % 24").alias("url"),
        _pick(IDENTIFIERS, "(event_id div 24) % 20").alias("arg1"),
        _pick(IDENTIFIERS, "(user_id * 7 + event_id) % 20").alias("arg2"),
        F.concat(F.lit("("), F.when(F.col("url") != "", F.concat(F.lit('"'), "url", F.lit('", '))).otherwise(""),
                 "arg1", F.lit(", "), "arg2", F.lit(")")).alias("args_text"))
    return e.selectExpr(
        "0 AS root_idx", "event_type AS base", "concat('svc', user_id % 40, '/h', event_id % 5, '.py') AS rel",
        "event_id AS start_byte", "event_id + 1 AS end_byte", "cast(event_id + 1 AS int) AS line",
        "callee", "args_text", "concat(callee, args_text) AS full_text")


def infra_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small infrastructure file per part."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.lit(0).alias("root_idx"), F.expr("lpad(cast(p_partkey AS string), 9, '0')").alias("walk_key"),
        F.concat(F.lit('resource "'), _pick(INFRA_WORDS, "p_partkey % 20"),
                 F.lit('" "main" {}')).alias("src"))


def key_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers and orders as a graph, with a shortcut from region to customer, and
    parts as orphans."""
    region, nation, customer, orders, part = (
        table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders", "part"))

    def node(df, kind, prefix, key, label):
        return df.selectExpr(f"concat('{prefix}:', {key}) AS id", f"'{kind}' AS kind", f"{label} AS label",
                             "'' AS system", "'' AS location")

    def flow(df, a, b, cats):
        arr = ", ".join(f"'{c}'" for c in cats)
        return df.selectExpr(f"concat({a}) AS `from`", f"concat({b}) AS `to`", f"array({arr}) AS categories",
                             "'' AS via", "'' AS evidence")

    nodes = (node(region, "source", "region", "r_regionkey", "r_name")
             .unionByName(node(nation, "service", "nation", "n_nationkey", "n_name"))
             .unionByName(node(customer, "store", "cust", "c_custkey", "''"))
             .unionByName(node(orders, "external", "order", "o_orderkey", "''"))
             .unionByName(node(part, "sink", "part", "p_partkey", "p_name")))
    shortcut = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    flows = (flow(nation, "'region:', n_regionkey", "'nation:', n_nationkey", ["geo"])
             .unionByName(flow(customer, "'nation:', c_nationkey", "'cust:', c_custkey", ["geo", "name"]))
             .unionByName(flow(orders, "'cust:', o_custkey", "'order:', o_orderkey", ["card"]))
             .unionByName(flow(shortcut, "'region:', n_regionkey", "'cust:', c_custkey", ["email"])))
    categories = spark.createDataFrame(
        [("card", "Card details", "financial"), ("email", "Email", "pii"), ("geo", "Location", "pii"),
         ("name", "Name", "pii")], "id string, label string, sensitivity string")
    return Graph(categories, nodes, flows)


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file path per document."""
    dirs = ["src", "node_modules/x", ".git", "a/.hid", "k8s", "deploy", "app/build", "lib"]
    exts = [".py", ".ts", ".go", ".tf", ".yaml", ".json", ".min.js", ".lock"]
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    d = d.withColumn("name", F.concat(F.lit("f"), "doc_id", _pick(exts, "(doc_id div 8) % 8")))
    d = d.withColumn("rel", F.concat(_pick(dirs, "doc_id % 8"), F.lit("/"), "name"))
    return d.select(F.lit(0).alias("root_idx"), F.lit("docs").alias("base"), "rel", "name",
                    F.concat(F.lit("docs/"), "rel").alias("path"), F.col("n_chars").alias("length"))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files of 50 calls each, one call per line, and the infrastructure files."""
    # the partitioning that groups the lines also spreads the files over the cores
    slots = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    c = calls(spark, sf_dir).withColumn("block", F.expr("start_byte div 50")).repartition(slots, "block")
    lines = F.sort_array(F.collect_list(F.struct("start_byte", "full_text")))  # at most 50 per block
    code = c.groupBy("block").agg(F.array_join(F.transform(lines, lambda x: x["full_text"]), "\n").alias("text"))
    code = code.select(
        F.lit(0).alias("root_idx"), F.lit("events").alias("base"), F.concat(F.lit("b"), "block", F.lit(".py")).alias("rel"),
        F.col("text").cast("binary").alias("content"))
    infra = infra_files(spark, sf_dir).select(
        "root_idx", F.lit("events").alias("base"), F.concat(F.lit("infra/"), "walk_key", F.lit(".tf")).alias("rel"),
        F.col("src").cast("binary").alias("content"))
    # a stored table, as a corpus would be: filters on its names must not run once per event
    files = cut(code.unionByName(infra))
    return files.select(
        "*", F.split("rel", "/").alias("segments"), F.element_at(F.split("rel", "/"), -1).alias("name"),
        F.concat(F.lit("events/"), "rel").alias("path"), F.length("content").cast("bigint").alias("length"))


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every script of each page as a source file."""
    bodies = F.regexp_extract_all("html", F.lit("(?s)<script>(.*?)</script>"), F.lit(1))
    each = table(spark, sf_dir, "pages").select("page_id", F.posexplode(bodies).alias("i", "body"))
    return each.select(
        F.lit(0).alias("root_idx"), F.lit("pages").alias("base"), F.concat(F.lit("p"), "page_id", F.lit("."), "i", F.lit(".js")).alias("rel"),
        F.col("body").cast("binary").alias("content"), F.lit("javascript").alias("language"))
