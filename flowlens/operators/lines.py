"""Line numbers of many byte offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def line_starts(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, line, start)``: the newline index of each text, one row per line, with the byte offset at which it starts. Lines count from 1; ``texts`` has one row per ``key``."""
    sizes = F.transform(F.split(text, "\n", -1), lambda x: F.octet_length(x).cast("long") + 1)
    each = texts.select(key, F.posexplode(sizes).alias("nth", "size"))
    before = Window.partitionBy(key).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(key, (F.col("nth") + 1).alias("line"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))


def lines_of(texts: DataFrame, offsets: DataFrame, key: str, offset: str = "byte_offset", text: str = "text") -> DataFrame:
    """``offsets`` with ``line``, the line of ``offset`` in the text under ``key``, as ``line_at`` tells it for a single one.

    Line starts and offsets are sorted together and each offset takes the last start before it, so the cost is that of sorting both, not of reading a text once
    for every offset. Null for a null offset or a key without a text."""
    starts = line_starts(texts.filter(F.col(text).isNotNull()), key, text)
    columns = [c for c in offsets.columns if c not in (key, "line")]
    # a text's first line begins before all offsets, negative ones too
    marks = starts.select(key, F.when(F.col("line") > 1, F.col("start")).alias("_at"), F.lit(0).alias("_kind"), F.col("line").alias("_line"), F.lit(None).alias("_row"))
    asked = offsets.select(key, F.col(offset).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_line"), F.struct(*columns).alias("_row"))
    both = marks.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType)).unionByName(asked)
    so_far = Window.partitionBy(key).orderBy(F.col("_at").asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.withColumn("line", F.last("_line", ignorenulls=True).over(so_far)).filter("_kind = 1")
    line = F.when(F.col("_at").isNotNull(), F.col("line")).alias("line")
    out = placed.select(key, *[F.col("_row").getField(c).alias(c) for c in columns], line)
    return out.select(*[c for c in offsets.columns if c != "line"], "line")
