"""Quality rules: a hashed n-gram log-likelihood ratio between trusted text and the raw corpus, with DataFrame
operations only.

Words and word pairs are hashed into ``BUCKETS`` buckets. Counting all documents gives the raw multinomial, counting the
trusted ones the target multinomial, both with one added to every bucket. A document's score is the mean over its n-grams
of ``log p_target - log p_raw``, so length does not matter, and it is kept if that reaches ``THRESHOLD`` and no
base rule fails. Both count all their documents.

The weights are one array of ``BUCKETS`` numbers in the plan. Counts combine before the shuffle to at most one
row per bucket and task, so no word can be hot.

Defined results: null or empty text has no words, all counts 0, and fails a base rule; a document
without n-grams scores 0. Without trusted rows every score is 0. Repeated rows each get their result. Columns of the
input named like an output are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import constant_array

BUCKETS = 1 << 15
THRESHOLD = -0.06
MIN_WORDS = 50
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def word_hashes(w: str) -> Column:
    """A 64-bit hash of each word; everything else is made of these numbers, so a word is hashed once."""
    return F.transform(w, lambda x: F.xxhash64(x))


def _grams(h: str) -> Column:
    """The buckets of the words and of the pairs of words, from an array of word hashes."""
    one = F.transform(h, lambda x: x.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
    two = F.expr(f"CASE WHEN size({h}) > 1 THEN transform(sequence(0, size({h}) - 2), "
                 f"i -> hash({h}[i], {h}[i + 1]) & {BUCKETS - 1}) ELSE array() END")
    return F.concat(one, two)


def weights(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """The log ratio of each bucket, from all of ``docs(doc_id, text)`` and all ids ``trusted(doc_id)``, which are stored, so that Spark broadcasts them
    if their bytes allow it and shuffles the texts to them if not. Runs two jobs."""
    ids = cut(trusted.filter("doc_id IS NOT NULL").select("doc_id").distinct().withColumn("_trusted", F.lit(1)))
    flagged = docs.select("doc_id", "text").join(ids, "doc_id", "left").select("_trusted", words(F.col("text")).alias("w")).select("_trusted", word_hashes("w").alias("h"))
    counts = (flagged.select(F.explode(_grams("h")).alias("bucket"), "_trusted").groupBy("bucket")
              .agg(F.count("*").alias("raw"), F.count("_trusted").alias("target")).collect())  # at most BUCKETS rows
    raw, target = [1] * BUCKETS, [1] * BUCKETS
    for r in counts:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    if sum(target) == BUCKETS:
        return [0.0] * BUCKETS
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [math.log(t) - math.log(r) + shift for t, r in zip(target, raw)]


def _repeated_words(w: str) -> Column:
    """From an array of word hashes: words inside three-word windows that occur twice or more. Equal windows stand next to each other once the windows'
    hashes are sorted with their places; the places then give the words covered."""
    hashes = f"transform(sequence(0, size({w}) - 3), i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2]))"
    hashes = F.expr(f"CASE WHEN size({w}) > 3 THEN {hashes} ELSE cast(array() AS array<bigint>) END")

    def covered(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(F.transform(s, lambda x, i: F.when(
                (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"])), lambda x: x.isNotNull())
            return F.sort_array(twice)

        def total(p: Column) -> Column:
            return F.aggregate(p, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
                               lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n")),
                               lambda acc: acc["n"])

        # each one-element array gives its value a name, so it is computed once
        return F.get(F.transform(F.transform(F.array(order), places), total), 0)

    return F.get(F.transform(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long"))
                             .otherwise(covered(h))), 0)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def judge(docs: DataFrame, weight: list[float], threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``FIELDS``."""
    others = [c for c in docs.columns if c not in FIELDS]
    full = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(full, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bare = full
    for symbol in SYMBOLS:
        bare = F.replace(bare, F.lit(symbol), F.lit(""))
    table = constant_array(weight, "double")
    stage = docs.select(*others, words(F.col(text)).alias("_w"), (F.length(full) - F.length(bare)).cast("long").alias("n_symbols"), lines.alias("_lines"))
    stage = stage.select(*others, "n_symbols", "_lines", F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), word_hashes("_w").alias("_h"))
    sums = F.aggregate(_grams("_h"), F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    stage = stage.select(*others, F.size("_h").cast("long").alias("n_words"), "word_chars", "n_symbols",
                         (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                         _repeated_words("_h").alias("n_repeat_words"), sums.alias("_sum"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    score = F.when(F.col("n_words") > 0, F.col("_sum") / (2 * F.col("n_words") - 1)).otherwise(0.0)
    return (stage.withColumn("base_failed", failed).withColumn("score", score)
            .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).select(*others, *FIELDS))
