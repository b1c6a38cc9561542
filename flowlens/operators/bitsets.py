"""Sets of category ids as numbers, one bit for each id, so that their union is a ``bit_or``.

Unions of arrays need object buffers, which Spark's aggregation sorts once a task holds more than a few keys; numbers stay in its hash table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import quoted

#: Ids in one number.
BITS = 62


def ids_of(rows: DataFrame, column: str = "categories") -> list[str]:
    """All ids in a column of arrays, sorted: a dictionary of kinds of data, so a short list. Runs a job."""
    ids = rows.select(F.explode(column).alias("id")).distinct().filter("id IS NOT NULL")
    return sorted(r.id for r in ids.collect())


def encode(column: str, ids: list[str]) -> dict[str, Column]:
    """``_bits0, _bits1, ...``: the set in an array column, over sorted ``ids``. Null and unknown ids count as absent."""
    def one(some: list[str]) -> Column:
        return F.expr(" + ".join(f"if(array_contains(`{column}`, {quoted(c)}), {1 << i}L, 0L)" for i, c in enumerate(some)) or "0L")

    return {f"_bits{k}": one(ids[at:at + BITS]) for k, at in enumerate(range(0, max(1, len(ids)), BITS))}


def united(ids: list[str]) -> list[Column]:
    """The aggregates that unite encoded sets."""
    return [F.expr(f"bit_or({name})").alias(name) for name in encode("", ids)]


def decode(ids: list[str]) -> Column:
    """The sorted ids of an encoded set."""
    parts = []
    for k, at in enumerate(range(0, max(1, len(ids)), BITS)):
        listed = ", ".join(quoted(c) for c in ids[at:at + BITS])
        parts.append(F.expr(f"filter(cast(array({listed}) AS array<string>), (c, i) -> shiftright(_bits{k}, i) & 1 = 1)"))
    return F.concat(*parts) if len(parts) > 1 else parts[0]
