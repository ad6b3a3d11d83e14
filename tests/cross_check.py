"""Compare registered queries with their SQL, value by value. Run as a script with query names to see differences."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(value)
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, plan, sql: str) -> tuple[str, int]:
    """('' or a description of the difference, row count)."""
    df = plan(spark, sf_dir)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    right = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}", len(left)
    if len(left) != len(right):
        return f"{len(left)} rows vs {len(right)}", len(left)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        a, b = bad[0]
        cells = [(n, x, y) for n, x, y in zip(sorted(names), a, b) if x != y]
        return f"{len(bad)} rows differ, first {a[:1]}: {cells[:3]}", len(left)
    return "", len(left)


def main() -> None:
    import __spark_entry__ as entry
    from accesslens.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark, con = local_session(), duck(sf_dir)
    plans, sqls = entry.queries(), entry.oracle_sql()
    failed, empty, started = [], [], time.time()
    for name in wanted or plans:
        t = time.time()
        try:
            problem, n = compare(spark, con, sf_dir, plans[name], sqls[name]) if name in sqls else ("", plans[name](spark, sf_dir).count())
        except Exception as error:  # noqa: BLE001
            problem, n = f"{type(error).__name__}: {str(error)[:400]}", -1
        if problem:
            failed.append(name)
            print(f"FAIL {name} ({time.time() - t:.1f}s): {problem}", flush=True)
        elif wanted:
            print(f"ok   {name} {n} rows ({time.time() - t:.1f}s)", flush=True)
        elif time.time() - t > 8:
            print(f"slow {name} {time.time() - t:.1f}s", flush=True)
        if n == 0:
            empty.append(name)
    print(f"{len(wanted or plans)} queries, {len(failed)} failed: {failed}; empty: {empty}; {time.time() - started:.0f}s")


if __name__ == "__main__":
    main()
