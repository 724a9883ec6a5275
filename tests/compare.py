"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def rows_of(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, con, sf_dir: str, run, sql: str) -> list[str]:
    """Differences between the two engines; empty when every cell is equal."""
    frame = run(spark, sf_dir)
    left = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    right = rows_of(names, result.fetchall())
    types = dict(zip(names, [str(c[1]) for c in result.description]))
    problems = []
    if left[0] != right[0]:
        return [f"columns {left[0]} != {right[0]}"]
    wanted = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}
    for n, k in frame.dtypes:
        if wanted.get(k) != types[n]:
            problems.append(f"type of {n}: {k} against {types[n]}")
    if len(left[1]) != len(right[1]):
        return problems + [f"rows {len(left[1])} != {len(right[1])}"]
    bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    if bad:
        problems.append(f"{len(bad)} of {len(left[1])} rows differ, first: {str(bad[0][0])[:600]} | {str(bad[0][1])[:600]}")
    if not left[1]:
        problems.append("no rows")
    return problems


def main() -> int:
    import __spark_entry__ as e
    from tillworks.session import local_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark, con = local_session(os.environ.get("BENCH_CPUS", "8")), duck(sf_dir)
    queries, oracles = e.queries(), e.oracle_sql()
    failed = 0
    for name in args[1:] or queries:
        start = time.time()
        try:
            if name in oracles:
                problems = compare(spark, con, sf_dir, queries[name], oracles[name])
            else:
                problems = [] if queries[name](spark, sf_dir).count() else ["no rows"]
        except Exception as x:  # report and go on with the next query
            problems = [f"{type(x).__name__}: {str(x)[:700]}"]
        failed += bool(problems)
        kind = "sql" if name in oracles else "rows"
        print(f"{'FAIL' if problems else 'ok  '} {name} [{kind}] {time.time() - start:.1f}s", *problems, sep="\n      ", flush=True)
    print(f"{failed} failed of {len(args[1:] or queries)}; {len(oracles)} with SQL")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(), 1))
