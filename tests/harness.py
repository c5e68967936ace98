"""Run registered queries against their SQL statement in DuckDB and report differences."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from tidemark.sources.tables import SCHEMAS

DATA = "/root/testdata"


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        if v == 0 and math.copysign(1, v) < 0:
            return "-0.0"
        return None if math.isnan(v) else v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, query):
    """Return (seconds, rows, problem or None)."""
    start = time.time()
    df = query(spark, folder)
    got = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if query.sql is None:
        return seconds, len(got), None
    cur = con.execute(query.sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return seconds, len(got), f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = _rows(got, df.columns), _rows(want, names)
    if len(a) != len(b):
        return seconds, len(got), f"rows {len(a)} != {len(b)}; {a[:2]} vs {b[:2]}"
    for x, y in zip(a, b):
        if x != y or [type(i) for i in x] != [type(i) for i in y]:
            bad = sum(p != q for p, q in zip(a, b))
            return seconds, len(got), f"{bad} rows differ; cols {sorted(names)}: {x} vs {y}"
    return seconds, len(got), None


if __name__ == "__main__":
    from tidemark.plans import QUERIES

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    folder = f"{DATA}/sf{sf}"
    spark, con = session(), duck(folder)
    failed = 0
    for name, q in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            s, n, problem = compare(spark, con, folder, q)
        except Exception as e:  # noqa: BLE001
            s, n, problem = 0, 0, f"{type(e).__name__}: {str(e)[:900]}"
        failed += problem is not None
        flag = "ok " if problem is None else "BAD"
        print(f"{flag} {name:36s} {s:6.2f}s {n:7d} rows {'' if q.sql else '(rows only)'} {problem or ''}",
              flush=True)
    print("failed:", failed)
