"""Flow volume: weights, throughput, totals per kind, and offsets of stacked ribbons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import kind_order
from ..session import cut
from .merge import valid_edges


def flow_weight(categories: Column) -> Column:
    """Number of categories of a flow, at least 1."""
    return F.greatest(F.lit(1), F.coalesce(F.size(categories), F.lit(0))).cast("bigint")


def with_weight(flows: DataFrame) -> DataFrame:
    return flows.withColumn("weight", flow_weight(F.col("categories")))


def _end_weights(flows: DataFrame) -> DataFrame:
    """In and out weight per id: one aggregation over both ends of every flow."""
    w = F.col("weight")
    ends = F.array(F.struct(F.col("from").alias("id"), F.lit(0).alias("in_weight"), w.alias("out_weight")),
                   F.struct(F.col("to").alias("id"), w.alias("in_weight"), F.lit(0).alias("out_weight")))
    return (with_weight(flows).select(F.inline(ends)).groupBy("id")
            .agg(F.sum("in_weight").alias("in_weight"), F.sum("out_weight").alias("out_weight")))


def node_throughput(nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """Nodes with ``in_weight``, ``out_weight`` and ``throughput = max(in, out, 1)``."""
    zero = F.lit(0).cast("bigint")
    return (nodes.join(_end_weights(flows), "id", "left")
            .withColumns({"in_weight": F.coalesce("in_weight", zero), "out_weight": F.coalesce("out_weight", zero)})
            .withColumn("throughput", F.greatest("in_weight", "out_weight", F.lit(1).cast("bigint"))))


def node_degree_weight(nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """Nodes with ``degree_weight``: in plus out weight, at least 1."""
    total = F.coalesce(F.col("in_weight") + F.col("out_weight"), F.lit(0))
    return (nodes.join(_end_weights(flows), "id", "left")
            .withColumn("degree_weight", F.greatest(total, F.lit(1).cast("bigint")))
            .drop("in_weight", "out_weight"))


def kind_totals(throughput: DataFrame) -> DataFrame:
    """Per node kind that occurs: column order, node count, throughput sum."""
    return (throughput.withColumn("col_order", kind_order(F.col("kind"))).filter("col_order IS NOT NULL")
            .groupBy("kind", "col_order")
            .agg(F.count("*").alias("nodes"), F.sum("throughput").alias("throughput")))


def kind_maxima(totals: DataFrame) -> DataFrame:
    """One row: the largest throughput sum (at least 1) and the largest node count over the kinds."""
    return totals.agg(
        F.greatest(F.coalesce(F.max("throughput"), F.lit(1)), F.lit(1).cast("bigint")).alias("max_throughput"),
        F.coalesce(F.max("nodes"), F.lit(0)).cast("bigint").alias("max_nodes"))


def running_before(df: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same ``key`` (by ``order``, unique in a key), for keys of any size.

    The rows are range partitioned by key and order and stored; each piece is summed up by itself and
    starts from the sum of the key's earlier pieces. Only a key that goes on from one piece to the next needs such a start, so there are
    fewer starts than pieces, and they are broadcast.
    """
    zero = F.lit(0).cast("bigint")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the piece is stored with the rows: sampled range bounds may differ if computed again
    pieces = cut(df.repartitionByRange(parts, key, order).withColumn("_piece", F.spark_partition_id()))
    earlier = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (pieces.groupBy(key, "_piece").agg(F.sum(value).alias("_sum"))
              .select(key, "_piece", F.sum("_sum").over(earlier).alias("_start")).filter("_start IS NOT NULL"))
    inside = Window.partitionBy(key, "_piece").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (pieces.withColumn("_inner", F.coalesce(F.sum(value).over(inside), zero))
            .join(F.broadcast(starts), [key, "_piece"], "left")
            .withColumn(name, F.coalesce("_start", zero) + F.col("_inner")).select(*df.columns, name))


def stacked_offsets(nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """Flows between existing nodes with their weight and where their ribbon starts, in weight units:
    ``source_offset`` below the earlier flows of the source, ``target_offset`` below those of the target. Runs jobs."""
    edges = cut(with_weight(valid_edges(flows, nodes)).select("from", "to", "categories", "weight"))
    out = cut(running_before(edges, "from", "to", "weight", "source_offset"))
    return running_before(out, "to", "from", "weight", "target_offset")
