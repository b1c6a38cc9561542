"""Run every query in Spark and in DuckDB on the same tables and compare the rows."""

from __future__ import annotations

import sys
import time

import duckdb

from flowlens.session import local_session

from .queries import QUERIES, SQL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("" if r[i] is None else repr(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf: str) -> str:
    """Empty if Spark and SQL agree, else what differs."""
    df = QUERIES[name](spark, sf)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    if name not in SQL:
        return ""
    cur = con.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    want = normal(cur.fetchall(), columns)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    if got != want:
        extra, missing = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        return f"{len(got)} / {len(want)} rows; only Spark {extra}; only SQL {missing}"
    return ""


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def main(sf: str, names: list[str]) -> None:
    spark, con, bad = local_session(8), connect(sf), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in names or QUERIES:
        start = time.time()
        try:
            problem = compare(spark, con, name, sf)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(problem)
        print(f"{name} {time.time() - start:.1f}s {'' if name in SQL else '(rows only) '}{problem or 'ok'}", flush=True)
    print(f"{len(names or QUERIES)} queries, {bad} problems")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
