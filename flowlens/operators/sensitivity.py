"""How sensitive is a flow, and which flows are visible under a sensitivity filter?

The answer depends on a flow's category list alone. So the distinct lists are judged, once each, by a join of their
entries with the categories, and the verdicts are joined back to the flows by list. A list that many flows share
is a hot key of that last join only, where adaptive execution splits it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import SENSITIVITY_CHIPS, dim_sensitivity
from ..functions.text import non_blank, sensitivity_rank
from .skew import lookup_join, null_safe_join


def known_categories(categories: DataFrame) -> DataFrame:
    """One row per id. Of rows that repeat an id the highest sensitivity counts (the alphabetically first of equals), and the
    alphabetically first label that is not blank."""
    rank = sensitivity_rank(F.col("sensitivity"))
    return categories.filter("id IS NOT NULL").groupBy("id").agg(
        F.min(non_blank(F.col("label"))).alias("label"),
        F.min(F.struct((-rank).alias("r"), "sensitivity")).alias("s")).select("id", "label", F.col("s.sensitivity").alias("sensitivity"))


def flow_categories(flows: DataFrame, categories: DataFrame) -> DataFrame:
    """One row per flow and category with the category's ``label`` and ``sensitivity`` (null if it is
    unknown); a flow without categories keeps one row with a null ``cat_id``."""
    exploded = flows.select("from", "to", F.posexplode_outer("categories").alias("pos", "cat_id"))
    known = categories.select(F.col("id").alias("cat_id"), "label", "sensitivity")
    return lookup_join(exploded, known, "cat_id", "left")


def judged_lists(flows: DataFrame, categories: DataFrame) -> DataFrame:
    """One row per distinct ``categories`` list of the flows:

    - ``sensitivity``: the highest-ranked one, of the first category id among equals; null if none has a rank,
    - ``shown``: every sensitivity to which a filter reacts; nothing, unknown and blank count as ``public``,
    - ``labels``: labels in list order, unknown and blank ones left out; ``labels_or_ids``: with ids in their place.
    """
    lists = flows.select("categories").distinct()
    entries = lists.select("categories", F.posexplode_outer("categories").alias("pos", "cat_id"))
    known = known_categories(categories).withColumnRenamed("id", "cat_id")
    rank = sensitivity_rank(F.col("sensitivity"))
    loud = F.when(rank > 0, F.struct((-rank).alias("r"), "cat_id", "sensitivity"))
    name = F.coalesce("label", "cat_id")
    joined = lookup_join(entries, known, "cat_id", "left")
    # a list's entries are collected: no more than the list itself holds

    def listed(value: Column) -> Column:
        parts = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct("pos", value.alias("v")))))
        return F.array_join(F.transform(parts, lambda p: p["v"]), ", ")

    return joined.groupBy("categories").agg(
        F.min(loud)["sensitivity"].alias("sensitivity"),
        F.collect_set(F.coalesce(non_blank(F.col("sensitivity")), F.lit("public"))).alias("shown"),
        listed(F.col("label")).alias("labels"), listed(name).alias("labels_or_ids"))


def with_sensitivity(flows: DataFrame, categories: DataFrame, none: str = "") -> DataFrame:
    """Flows with their highest-ranked ``sensitivity``; the first category id wins among equals, and
    ``none`` stands where no category has a rank."""
    judged = judged_lists(flows, categories).select("categories", "sensitivity")
    kept = flows.drop("sensitivity")
    return null_safe_join(kept, judged, "categories").withColumn("sensitivity", F.coalesce("sensitivity", F.lit(none)))


def dominant_sensitivity(flows: DataFrame, categories: DataFrame) -> DataFrame:
    """``(from, to, sensitivity)``; empty for a flow with no known category."""
    return with_sensitivity(flows, categories).select("from", "to", "sensitivity")


def flow_sensitivity_public(flows: DataFrame, categories: DataFrame) -> DataFrame:
    """``(from, to, sensitivity)`` with ``public`` as the floor."""
    return with_sensitivity(flows, categories, "public").select("from", "to", "sensitivity")


def filter_by_sensitivity(flows: DataFrame, categories: DataFrame, active: Iterable[str]) -> DataFrame:
    """Flows with at least one category of an active sensitivity. No category, an unknown category and
    a blank sensitivity all count as ``public``."""
    wanted = F.array(*map(F.lit, active)).cast("array<string>")
    judged = judged_lists(flows, categories).select("categories", F.arrays_overlap("shown", wanted).alias("_seen"))
    return null_safe_join(flows, judged, "categories").filter("_seen").select(*flows.columns)


def legend_sensitivities(categories: DataFrame) -> DataFrame:
    """Sensitivities in use with the first category id having them, which gives their legend order."""
    return (categories.filter(non_blank(F.col("sensitivity")).isNotNull())
            .groupBy("sensitivity").agg(F.min("id").alias("first_id")))


def chip_sensitivities(categories: DataFrame) -> DataFrame:
    """Known sensitivities in use with their fixed position; a blank one counts as public."""
    used = categories.select(F.coalesce(non_blank(F.col("sensitivity")), F.lit("public")).alias("sensitivity"))
    order = F.array_position(F.lit(list(SENSITIVITY_CHIPS)), F.col("sensitivity")).cast("int")
    return used.distinct().withColumn("position", order).filter("position > 0")


def sensitivity_labels(categories: DataFrame) -> DataFrame:
    """Legend rows with their display label; the label table has one row per sensitivity."""
    labels = dim_sensitivity(categories.sparkSession).select("sensitivity", "label")
    return legend_sensitivities(categories).join(F.broadcast(labels), "sensitivity", "left")
