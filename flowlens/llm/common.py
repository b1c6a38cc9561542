"""Small helpers that several of the operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_tasks(spark: SparkSession) -> None:
    """Before an operator runs Python in tasks: the package goes to the workers, and unless the session says otherwise,
    Arrow batches hold a few MB of text instead of up to 64 MB."""
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, "4m")


def free_finished(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs deleted now. Spark deletes them when the driver collects its garbage, which
    may be long after a large step."""
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """At the end of a task's Python: memory that is free in the worker goes back to the system, since workers stay for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def bucket(key: Column, n: int) -> Column:
    """crc32 of a key as text, modulo ``n``: how rows are held out. A null key is never held out (null)."""
    return F.crc32(key.cast("string").cast("binary")) % n


def sample_share(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone; keys below a share make a repeatable sample."""
    return F.xxhash64(key).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def constant_array(values: list, kind: str) -> Column:
    """Many numbers as one constant: the optimizer parses the text once, where a literal for each would be slow to build."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


#: Most numbers of a bit set that goes to every task (64 bits each, 2 MB).
MOST_LONGS = 1 << 18


def bit_set(hashes: DataFrame, bits_each: int = 256) -> list[int]:
    """A bit set over ``hashes(h)`` (longs), as at most ``MOST_LONGS`` numbers. It tells what may be among the hashes; beyond its
    size more passes by chance, nothing is missed. Runs two jobs."""
    wanted = hashes.count() * bits_each // 64
    size = min(MOST_LONGS, max(64, 1 << wanted.bit_length()))
    bits = hashes.select(F.expr(f"cast(shiftright(h, 6) & {size - 1} AS int)").alias("at"),
                         F.expr("shiftleft(1L, cast(h & 63 AS int))").alias("bit")).groupBy("at").agg(F.expr("bit_or(bit)").alias("bits"))
    out = [0] * size
    for r in bits.collect():  # at most MOST_LONGS rows
        out[r["at"]] = r["bits"]
    return out


def may_be_in(h: Column, marked: list[int]) -> Column:
    """May a hash be among those of ``bit_set``? For operators that run Python in tasks: the bit set is broadcast, so it is no part of the plan's text."""
    bits = SparkSession.active().sparkContext.broadcast(np.array(marked, np.int64).view(np.uint64))

    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        x = hashes.to_numpy().view(np.uint64)
        at = (x >> np.uint64(6)) & np.uint64(len(bits.value) - 1)
        return pd.Series((bits.value[at.astype(np.int64)] >> (x & np.uint64(63)) & np.uint64(1)).astype(bool))

    return test(h)


def ascii_words_table() -> bytes:
    """For ``bytes.translate``: A-Z become a-z, digits, a-z and bytes from 0x80 stay, all else a blank."""
    return bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
