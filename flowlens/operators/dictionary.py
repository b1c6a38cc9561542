"""Classifying names and matching vendors against dictionary tables of any size.

The column functions of ``functions`` carry their dictionary in the plan, which suits a few hundred entries. Here dictionaries are DataFrames: distinct names are
classified once, by joins, and the answers are joined back to wherever the names stand. Nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import identifier_tokens, identifiers
from ..session import cut
from .skew import lookup_join

#: Length of the pieces by which vendor tokens are found.
GRAM = 3


def classify_names(names: DataFrame, tokens: DataFrame, qualifiers: DataFrame, column: str = "id") -> DataFrame:
    """``(id, category)`` for each distinct name in ``names``, stored; the rules of ``classify_identifier``. ``tokens(token, cat_id)`` and ``qualifiers(kind, token)`` are shaped
    like ``dim_pii_token`` and ``dim_qualifier``; of several categories of one token the smallest counts. Runs jobs."""
    distinct = cut(names.select(F.col(column).alias("id")).distinct())
    known = cut(tokens.groupBy("token").agg(F.min("cat_id").alias("category")))
    split = distinct.withColumn("tk", identifier_tokens(F.col("id")))
    whole = F.struct(F.lit(-1).alias("at"), F.array_join("tk", "").alias("token"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"))
    each = F.transform("tk", lambda t, i: F.struct(i.alias("at"), t.alias("token"), F.get("tk", i - 1).alias("before"), F.get("tk", i + 1).alias("after")))
    rows = split.select("id", F.explode(F.concat(F.array(whole), each)).alias("x")).select("id", "x.*")
    direct = lookup_join(rows, known, "token", "inner", stored=True).select("id", "at", F.lit(0).alias("way"), "category")
    beside = (rows.filter("at >= 0 AND token IN ('name', 'address')")
              .select("id", "at", F.col("token").alias("kind"), F.explode(F.array("before", "after")).alias("token"))
              .join(cut(qualifiers.select("kind", "token").distinct()), ["kind", "token"], "left_semi"))
    hits = direct.unionByName(beside.select("id", "at", F.lit(1).alias("way"), F.col("kind").alias("category")))
    best = hits.groupBy("id").agg(F.min(F.struct("at", "way", "category")).alias("best")).select("id", "best.category")
    return cut(distinct.join(best, "id", "left"))


def categories_of(rows: DataFrame, key: str, snippet: str, tokens: DataFrame, qualifiers: DataFrame) -> DataFrame:
    """``(key, categories)`` for each row of ``rows``, which has one row per ``key``: distinct category ids named by the identifiers of a snippet, in first-seen order, as
    ``categories_in`` gives them. Snippets are read twice: for their distinct names, which are classified, and for the places of names that stand for something. Only those names
    are joined to the places, so places are shuffled only if the names are too many for a broadcast. Runs jobs."""
    ids = identifiers(F.col(snippet))
    named = classify_names(rows.select(F.explode(ids).alias("id")), tokens, qualifiers).filter("category IS NOT NULL")
    places = rows.select(F.col(key).alias("key"), F.posexplode(ids).alias("at", "id"))
    # stored once more, without the names that stand for nothing: they are most of a text's, and their bytes count against a broadcast
    per_category = lookup_join(places, named, "id", "inner").groupBy("key", "category").agg(F.min("at").alias("at"))
    listed = per_category.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "category"))).alias("l"))  # as many as there are categories
    listed = listed.select(F.col("key").alias(key), F.col("l.category").alias("categories"))
    return rows.select(key).join(listed, key, "left").select(key, F.coalesce("categories", F.array().cast("array<string>")).alias("categories"))


def match_vendors(names: DataFrame, vendors: DataFrame, column: str = "id") -> DataFrame:
    """``(id, vendor)`` for each distinct text of ``names`` (lower case) and the alphabetically first ``token`` of ``vendors(token, ...)`` that it contains, or null.

    An inverted index: a token is filed under its rarest piece of ``GRAM`` characters (all of it, if it is shorter), a text looks up its own pieces, and only tokens found that
    way are searched for in the text. Work depends on the texts and the tokens they come close to, not on the number of vendors. Runs jobs."""
    distinct = cut(names.select(F.col(column).alias("id")).distinct())
    tokens = cut(vendors.select("token").filter("token <> ''").distinct())
    pieces = tokens.select("token", F.explode(F.expr(f"transform(sequence(1, greatest(1, length(token) - {GRAM - 1})), i -> substring(token, i, {GRAM}))")).alias("gram"))
    common = pieces.groupBy("gram").agg(F.count("*").alias("n"))
    filed = cut(pieces.join(common, "gram").groupBy("token").agg(F.min(F.struct("n", "gram")).alias("x")).select("token", "x.gram"))
    sizes = F.array(*[F.lit(k) for k in range(1, GRAM + 1)])
    grams = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.length("id")), lambda i: F.substring(F.col("id"), i, k))))
    looked_up = distinct.filter("id <> ''").select("id", F.explode(F.array_distinct(grams)).alias("gram"))
    found = looked_up.join(filed, "gram").filter(F.contains("id", "token")).groupBy("id").agg(F.min("token").alias("vendor"))
    return cut(distinct.join(found, "id", "left"))
