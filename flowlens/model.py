"""The graph: three DataFrames, keyed by category id, node id and (from, to)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .session import cut

CATEGORY_SCHEMA = "id string, label string, sensitivity string"
NODE_SCHEMA = "id string, kind string, label string, system string, location string"
FLOW_SCHEMA = "`from` string, `to` string, categories array<string>, via string, evidence string"
CALL_SCHEMA = ("root_idx int, base string, rel string, start_byte bigint, end_byte bigint, line int, "
               "callee string, args_text string, full_text string")
TABLES = ("categories", "nodes", "flows")


@dataclass(frozen=True)
class Graph:
    categories: DataFrame
    nodes: DataFrame
    flows: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.flows.sparkSession

    def stored(self) -> "Graph":
        """The same graph read back from the checkpoint directory, so that many questions can be
        asked without building it again."""
        return Graph(cut(self.categories), cut(self.nodes), cut(self.flows))

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """Write the three tables as Parquet below ``path``."""
        for name in TABLES:
            getattr(self, name).write.mode(mode).parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Graph":
        schemas = dict(zip(TABLES, (CATEGORY_SCHEMA, NODE_SCHEMA, FLOW_SCHEMA)))
        return cls(*[spark.read.schema(schemas[t]).parquet(f"{path}/{t}") for t in TABLES])
