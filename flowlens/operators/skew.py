"""Joining a large, possibly skewed side to a lookup side that has one row per key.

A hub node (a log sink, the user) can be one end of a third of all flows. Adaptive execution splits the
partitions of such keys when both sides of a join are bare exchanges, which an aggregated lookup side is not. So the
lookup side is stored first; then it is built once, whatever reads it, and Spark broadcasts it where its rows and bytes
allow that and splits hot keys, any number of them, where they do not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Lookup sides of more rows are never broadcast.
MOST_BROADCAST_ROWS = 100_000


def _by_rows(lookup: DataFrame) -> DataFrame:
    """A stored lookup side, hinted to be sorted and shuffled if it has many rows. Spark judges a stored side by the bytes of its files; ids compress to a byte or two,
    so files below its threshold may hold millions of rows, of which the driver would build a hash table. Runs a job, which reads no more than the files' footers."""
    return lookup.hint("merge") if lookup.count() > MOST_BROADCAST_ROWS else lookup


def lookup_join(df: DataFrame, lookup: DataFrame, key: str, how: str = "left", stored: bool = False) -> DataFrame:
    """Join ``df`` to ``lookup`` (one row per ``key``) whatever the skew of ``df``; ``how`` is ``left``, ``inner``,
    ``left_semi`` or ``left_anti``. Columns of ``df`` come first. Runs a job that stores the lookup side, unless it
    is ``stored`` already, and one that counts it. A null key meets nothing."""
    lookup = _by_rows(lookup if stored else cut(lookup))
    joined = df.join(lookup, key, how)
    return joined.select(*df.columns, *[c for c in joined.columns if c not in df.columns])


def null_safe_join(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Left join where a null key meets a null key."""
    right = _by_rows(cut(lookup)).withColumnRenamed(key, "_key")
    return df.join(right, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
