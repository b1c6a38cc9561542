"""Listing and reading directory trees with Spark tasks.

Spark's own file sources hide names that start with ``_`` or ``.``, which matter here, so paths are
listed by tasks: one directory is one row, one level of all trees is one job. The driver only sees
the roots. Contents are read later, and only for files that passed the filters.

Local and mounted paths go through ``os``; URIs (s3, gs, hdfs, file) through ``pyarrow.fs``.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, ship_package
from .files import detect_language, filter_names, filter_size, is_pruned_dir, route_infra

ENTRY = ("root_idx int, base string, root string, path string, segments array<string>, name string, length bigint, "
         "is_dir boolean, readable boolean")
_ROWS_PER_BATCH = 5_000
_BYTES_PER_BATCH = 16 << 20
_BYTES_PER_TASK = 64 << 20


#: What a file or directory may answer without hiding anything that could be read; any other error fails the task,
#: which Spark then tries again.
_GONE = (FileNotFoundError, NotADirectoryError, PermissionError)


def _store(root: str, cache: dict):
    """File system and inner path of a root given as a URI. Only roots are parsed: names below them are no URIs, they may hold any
    character. One client per root and task."""
    if root not in cache:
        from pyarrow import fs
        cache[root] = fs.FileSystem.from_uri(root)
    return cache[root]


def _entries(root: str, path: str, cache: dict) -> Iterator[tuple[str, bool, int, bool]]:
    """(name, is_dir, length, readable) of a directory, given by its root and inner path; a path that is a file yields
    itself with an empty name. Nothing for what does not exist or may not be read."""
    if "://" in root:
        from pyarrow import fs
        store, top = _store(root, cache)
        inner = posixpath.join(top, path) if path else top
        try:
            info = store.get_file_info(inner)
            if info.type == fs.FileType.File:
                yield "", False, info.size, True
            elif info.type == fs.FileType.Directory:
                for e in store.get_file_info(fs.FileSelector(inner)):
                    yield e.base_name, e.type == fs.FileType.Directory, e.size or 0, True
        except _GONE:
            return
        return
    full = os.path.join(root, path) if path else root
    try:
        if not os.path.isdir(full):
            yield "", False, os.lstat(full).st_size, os.access(full, os.R_OK)
            return
        with os.scandir(full) as found:
            for e in found:
                try:
                    # a link counts as a file, whatever it points to
                    is_dir = e.is_dir(follow_symlinks=False)
                    size = e.stat(follow_symlinks=False).st_size
                    yield e.name, is_dir, size, e.is_file() and os.access(e.path, os.R_OK)
                except _GONE:
                    continue
    except _GONE:
        return


def _list_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in ENTRY.split(", ")]
    rows: list[tuple] = []
    cache: dict = {}
    for pdf in batches:
        for d in pdf.itertuples(index=False):
            for name, is_dir, size, readable in _entries(d.root, "/".join(d.segments), cache):
                if name == "":
                    rows.append((d.root_idx, d.base, d.root, d.path, ["."], d.base, size, False, readable))
                else:
                    rows.append((d.root_idx, d.base, d.root, posixpath.join(d.path, name), [*d.segments, name], name,
                                 size, is_dir, readable))
                if len(rows) >= _ROWS_PER_BATCH:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def _root_row(index: int, root: str) -> tuple:
    if "://" not in root:
        root = os.path.normpath(root)
        return index, os.path.basename(root) or root, root, root, [], "", 0, True, True
    root = root.rstrip("/")
    return index, posixpath.basename(root), root, root, [], "", 0, True, True


def list_tree(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Every file below the roots, pruned directories left out: ``root_idx, base, root, rel, segments, path,
    name, length, readable``. ``segments`` sorts files in walk order. Runs a job for each level."""
    ship_package(spark)
    frontier = spark.createDataFrame([_root_row(i, r) for i, r in enumerate(roots)], ENTRY)
    most = 4 * spark.sparkContext.defaultParallelism
    waiting, levels = len(roots), []
    while waiting:
        level = cut(frontier.repartition(min(waiting, most), "path").mapInPandas(_list_level, ENTRY))
        levels.append(level.filter("NOT is_dir"))
        frontier = level.filter("is_dir").filter(~is_pruned_dir(F.col("name")))
        waiting = frontier.count()
    if not levels:
        raise ValueError("no roots given")
    files = reduce(DataFrame.unionByName, levels)
    return files.select("root_idx", "base", "root", F.array_join("segments", "/").alias("rel"), "segments", "path",
                        "name", "length", "readable")


def routed_files(listed: DataFrame) -> DataFrame:
    """Listed files that pass the size and name filters, with ``language`` and ``is_infra``."""
    return route_infra(detect_language(filter_names(filter_size(listed))))


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cache: dict = {}
    for pdf in batches:
        start = 0
        while start < len(pdf):
            contents, size = [], 0
            while start + len(contents) < len(pdf) and size < _BYTES_PER_BATCH:
                root, rel = (pdf[c].iloc[start + len(contents)] for c in ("root", "rel"))
                try:
                    if "://" in root:
                        store, top = _store(root, cache)
                        with store.open_input_stream(top if rel == "." else posixpath.join(top, rel), compression=None) as f:
                            data = f.read()
                    else:
                        with open(root if rel == "." else os.path.join(root, rel), "rb") as f:
                            data = f.read()
                except (*_GONE, IsADirectoryError):
                    data = None
                contents.append(data)
                size += len(data or b"")
            part = pdf.iloc[start:start + len(contents)].copy()
            part["content"] = contents
            yield part
            start += len(contents)


def read_content(files: DataFrame) -> DataFrame:
    """Add ``content``; files that are gone or may not be read are dropped, any other error fails the task. Tasks get
    about 64 MiB each; contents pass through a task 16 MiB at a time. Runs a job that sums the lengths."""
    ship_package(files.sparkSession)
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(files.sparkSession.sparkContext.defaultParallelism,
                -(-int(total) // _BYTES_PER_TASK))
    schema = ", ".join(f"`{n}` {t}" for n, t in files.dtypes) + ", content binary"
    return (files.repartition(tasks, "path").mapInPandas(_read_batches, schema)
            .filter(F.col("content").isNotNull()))


def read_corpus(spark: SparkSession, roots: list[str]) -> DataFrame:
    """The ``files`` table of some directory trees: listed, filtered, routed and read."""
    return read_content(routed_files(list_tree(spark, roots)))
