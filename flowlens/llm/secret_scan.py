"""Secret scanning with an incremental blob ledger, in DataFrame operations only.

Every version of a file is a row ``(path, text)``. Its text is addressed by its SHA-256, so a blob that occurs
in many paths or versions is one blob. The ledger, a Parquet folder, lists which blob was scanned
by which version of the rules; only unseen pairs are scanned. Findings are stored per blob and rule version and joined back to
every path that holds the blob.

A match's place follows from its neighbours: splitting a text at a pattern and extracting the
pattern walk the same leftmost, non-overlapping matches, so gaps and matches alternate and their lengths add up
to code-point offsets.

Defined results: null text is the empty blob, which has no findings. Repeated rows each get the findings of their blob. An
empty table gives an empty result. Only the columns named are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_folder

# Base rules as (kind, pattern, group that counts, its least length, keyword), in the order in which
# kinds are listed. A run that is long enough starts and ends where any run does, so for "access" and "hex" the
# least length stands in the pattern; a failing "assign" match hides what it covers, so there it must not.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8,
     r"(?i)passw|secret|token|api_?key"),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16, "AKIA"),
    ("hex", r"[0-9a-f]{32,}", 0, 32, "[0-9a-f]{32}"),
]
# Further kinds of tokens with a form of their own.
ADDED = [
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, "eyJ"),
    ("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 0, "PRIVATE KEY"),
    ("forge_token", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})", 0, 0, "gh[pousr]_|glpat-"),
    ("chat_token", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", 0, 0, "xox"),
    ("cloud_key", r"AIza[A-Za-z0-9_-]{35}", 0, 0, "AIza"),
    ("payment_key", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 0, "k_live_"),
]
RULES = BASE + ADDED
RULES_VERSION = "1"
SPAN = "struct<start: int, kind_order: int, kind: string, end: int>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _matches(text: Column, order: int, rule: tuple) -> Column:
    """Every match of a rule as ``(kind_order, gap, n, counts)``: the length of the gap before it, its own
    length, and whether it is long enough. Nothing where the keyword does not occur."""
    kind, pattern, group, least, keyword = rule
    made = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1),
        lambda m, gap: F.struct(F.lit(order).alias("kind_order"), F.lit(kind).alias("kind"), F.length(gap).alias("gap"), F.length(m).alias("n"),
                                (F.length(F.regexp_extract(m, pattern, group) if group else m) >= least).alias("counts")))
    return F.when(text.rlike(keyword), F.filter(made, lambda x: x["n"].isNotNull())).otherwise(F.slice(made, 1, 0))


def scan_blobs(blobs: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """``(blob, spans)`` for ``blobs(blob, text)``, one row per blob. All steps keep the partitioning by blob."""
    found = F.flatten(F.array(*[_matches(F.col("text"), i, r) for i, r in enumerate(rules)]))
    rows = blobs.select("blob", F.posexplode_outer(found).alias("i", "m")).select("blob", "i", "m.*")
    before = Window.partitionBy("blob", "kind_order").orderBy("i")
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(before).cast("int"))
    span = F.when(F.col("counts"), F.struct((F.col("end") - F.col("n")).alias("start"), "kind_order", "kind", "end"))
    return ends.groupBy("blob").agg(F.sort_array(F.collect_list(span)).cast(f"array<{SPAN}>").alias("spans"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def update_ledger(versions: DataFrame, ledger: str, rules: list[tuple] = RULES, rules_version: str = RULES_VERSION) -> DataFrame:
    """Scan the blobs of ``versions(text)`` that the ledger has not seen under this rule version and append them to it.
    One Parquet commit adds blobs and findings together, so a failed run leaves the ledger as it was. Returns the
    ledger's rows of this rule version: ``(blob, spans)``."""
    spark = versions.sparkSession
    blobs = versions.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    new = blobs.dropDuplicates(["blob"])
    if _exists(spark, ledger):
        seen = spark.read.parquet(ledger).filter(F.col("rules_version") == rules_version).select("blob")
        new = blobs.join(seen, "blob", "left_anti").dropDuplicates(["blob"])
    scan_blobs(new, rules).withColumn("rules_version", F.lit(rules_version)).write.mode("append").parquet(ledger)
    # two writers may have scanned a blob at a time; their findings are equal
    return spark.read.parquet(ledger).filter(F.col("rules_version") == rules_version).select("blob", "spans").dropDuplicates(["blob"])


def findings(versions: DataFrame, ledger: str, keys: list[str], rules: list[tuple] = RULES,
             rules_version: str = RULES_VERSION) -> DataFrame:
    """``(*keys, blob, spans)`` for every row of ``versions(*keys, text)``: each path with what its blob holds."""
    known = update_ledger(versions.select("text"), ledger, rules, rules_version)
    return versions.select(*keys, blob_id(F.col("text")).alias("blob")).join(known, "blob", "left").select(*keys, "blob", "spans")


def scan(versions: DataFrame, keys: list[str]) -> DataFrame:
    """One full scan with a ledger of its own in the shared folder."""
    return findings(versions, new_folder(versions.sparkSession) + "/ledger", keys)


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
