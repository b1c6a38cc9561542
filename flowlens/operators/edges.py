"""A graph's edges as stored tables, bucketed by either end.

Walks, semi joins and neighbour look-ups ask the same edges again and again. Stored once in buckets of ``from`` and once in buckets of ``to``, they
are never shuffled again: a step shuffles its frontier to the edges' buckets, or broadcasts it where it is small.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..session import new_folder


def bucketed(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """``df`` as a stored table in buckets of ``key``, sorted within them. As many buckets as the session has shuffle partitions, unless told otherwise: with fewer,
    Spark may shuffle the table after all. The files lie in the shared folder; the table's name lives as long as the session's catalog. Runs a job."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"flowlens_{uuid.uuid4().hex}"
    # the shuffle that deals rows to buckets is the last one these rows see; a task writes one bucket
    dealt = df.repartition(buckets, key)
    dealt.write.format("parquet").option("path", new_folder(spark)).option("compression", "zstd").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


@dataclass(frozen=True)
class EdgeTables:
    """The same edges twice."""
    by_from: DataFrame
    by_to: DataFrame

    @classmethod
    def of(cls, edges: DataFrame, buckets: int | None = None) -> "EdgeTables":
        """From ``edges`` with the columns ``from`` and ``to`` and any others. Runs two jobs."""
        return cls(bucketed(edges, "from", buckets), bucketed(edges, "to", buckets))

    def near(self, end: str) -> DataFrame:
        return {"from": self.by_from, "to": self.by_to}[end]

    def step(self, frontier: DataFrame, near: str) -> DataFrame:
        """``frontier(id, ...)`` with the edges that have ``id`` as their ``near`` end; the columns of the frontier but ``id`` come first."""
        edges = self.near(near)
        others = [c for c in frontier.columns if c != "id"]
        joined = frontier.withColumnRenamed("id", near).join(edges, near)
        return joined.select(*others, *edges.columns)

    def inside(self, ids: DataFrame) -> DataFrame:
        """The edges with both ends in ``ids(id)``, stored. The first end is met in its buckets, the second by what is left."""
        first = self.by_from.join(ids.withColumnRenamed("id", "from"), "from", "left_semi")
        return first.join(ids.withColumnRenamed("id", "to"), "to", "left_semi").select(*self.by_from.columns)
