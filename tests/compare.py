"""Run a registered query in Spark and its check in DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from newsloom.plans.fixtures import BASE_TABLES


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict(recursive=True))
    return value


def rows_sorted(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(name, spark, folder, con, queries, checks):
    """Return (problem or None, row count, seconds in Spark)."""
    start = time.time()
    df = queries[name](spark, folder)
    got = df.collect()
    took = time.time() - start
    if name not in checks:
        return None, len(got), took
    rel = con.execute(checks[name])
    cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}", len(got), took
    a, b = rows_sorted(got, df.columns), rows_sorted(want, cols)
    if a == b:
        for f in df.schema.fields:
            if f.dataType.typeName() == "timestamp":
                return f"column {f.name} is a zoned timestamp", len(got), took
        return None, len(got), took
    only_a = [r for r in a if r not in set(b)][:3]
    only_b = [r for r in b if r not in set(a)][:3]
    return f"{len(a)} vs {len(b)} rows; spark only {str(only_a)[:700]}; duckdb only {str(only_b)[:700]}", len(got), took


if __name__ == "__main__":
    from newsloom.plans.catalog import all_checks, all_queries
    from newsloom.session import build_session

    folder = sys.argv[1]
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark = build_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, cs = duck(folder), all_queries(), all_checks()
    bad = 0
    for name in qs:
        if not name.startswith(prefixes):
            continue
        try:
            problem, n, took = compare(name, spark, folder, con, qs, cs)
        except Exception as exc:  # noqa: BLE001
            problem, n, took = f"{type(exc).__name__}: {str(exc)[:900]}", -1, 0.0
        bad += problem is not None
        print(f"{'FAIL' if problem else ('ok' if name in cs else 'rows')} {name} rows={n} {took:.2f}s {problem or ''}", flush=True)
    print("failures:", bad)
    spark.stop()
