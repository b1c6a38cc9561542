"""The graph document as a Spark data source with a commit step: ``df.write.format("graph_json")``.

Tasks write their lines to files that nobody looks at yet. Only when all have succeeded the driver names the files, in document order, in ``_manifest.json``, which replaces
the former one; a document is what the manifest names. A write that fails leaves the former document, or none, and removes its files. Attempts
that were lost or repeated leave files of their own that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..model import Graph
from ..session import ship_package
from .graph_json import json_lines

MANIFEST = "_manifest.json"
#: Lines that are written at a time.
LINES = 10_000


def _at(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def manifest(path: str) -> dict | None:
    """What makes up the document at ``path``: ``{"parts": [...], "lines": n}``, or None if there is none."""
    system, base = _at(path)
    if not system.get_file_info(f"{base}/{MANIFEST}").is_file:
        return None
    with system.open_input_file(f"{base}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class _Part(WriterCommitMessage):
    number: int
    name: str
    lines: int


class GraphJsonWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        if not overwrite and manifest(path) is not None:
            raise FileExistsError(f"{path} holds a document")
        self.path, self.folder = path, f"write-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> _Part:
        context = TaskContext.get()
        system, base = _at(self.path)
        system.create_dir(f"{base}/{self.folder}")
        name = f"{self.folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.json"
        n, waiting = 0, []
        with system.open_output_stream(f"{base}/{name}") as f:
            for row in iterator:
                waiting.append(row[0])
                n += 1
                if len(waiting) >= LINES:
                    f.write(("\n".join(waiting) + "\n").encode())
                    waiting = []
            if waiting:
                f.write(("\n".join(waiting) + "\n").encode())
        return _Part(context.partitionId(), name, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        system, base = _at(self.path)
        former = manifest(self.path)
        named = {"parts": [p.name for p in parts if p.lines], "lines": sum(p.lines for p in parts)}
        with system.open_output_stream(f"{base}/{self.folder}/{MANIFEST}") as f:
            f.write(json.dumps(named).encode())
        system.move(f"{base}/{self.folder}/{MANIFEST}", f"{base}/{MANIFEST}")
        for folder in {name.split("/")[0] for name in (former or {"parts": []})["parts"]}:
            system.delete_dir(f"{base}/{folder}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs
        system, base = _at(self.path)
        if system.get_file_info(f"{base}/{self.folder}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.folder}")


class GraphJsonSource(DataSource):
    """Writes rows of one string column, in the order of their partitions, as the lines of one document."""

    @classmethod
    def name(cls) -> str:
        return "graph_json"

    def writer(self, schema, overwrite: bool) -> GraphJsonWriter:
        return GraphJsonWriter(self.options["path"], overwrite)


def save_graph_document(graph: Graph, path: str, overwrite: bool = False) -> None:
    """Write the document of ``write_graph_json`` through the data source. ``path`` is on storage that driver and executors share."""
    spark = graph.spark
    ship_package(spark)
    spark.dataSource.register(GraphJsonSource)
    lines = json_lines(graph).orderBy("section", "step", "key").select("line")
    lines.write.format(GraphJsonSource.name()).mode("overwrite" if overwrite else "append").save(path)


def read_document(path: str) -> Iterator[str]:
    """The lines of the document at ``path``, in order, one part after the other."""
    named = manifest(path)
    if named is None:
        raise FileNotFoundError(f"no document at {path}")
    system, base = _at(path)
    for name in named["parts"]:
        with system.open_input_file(f"{base}/{name}") as f:
            yield from f.read().decode().splitlines()
