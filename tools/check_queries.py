"""Run every query next to its SQL counterpart and report differences.

    python tools/check_queries.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import duckdb  # noqa: E402

from corpuseval import catalog, get_spark  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return int(value) if value.is_integer() and abs(value) < 1e15 else value
    if hasattr(value, "is_finite"):
        return canonical(float(value))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(canonical(r[i]) for i in order) for r in rows]
    return sorted(made, key=lambda r: tuple((v is None, str(v)) for v in r))


def same_within_rounding(got, want):
    """Equal but for the last rounded digit: a mean that is an exact tie may round either way."""

    def loose(rows):
        def order(row):
            fixed = [str(v) for v in row if not isinstance(v, (int, float)) or isinstance(v, bool)]
            return fixed, [float(v) for v in row if isinstance(v, (int, float)) and not isinstance(v, bool)]

        return sorted(map(order, rows))

    def near(a, b):
        return a[0] == b[0] and len(a[1]) == len(b[1]) and all(abs(x - y) < 2.5e-6 for x, y in zip(a[1], b[1]))

    return len(got) == len(want) and all(map(near, loose(got), loose(want)))


def compare(spark, sf_dir, name, query, sql):
    start = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - start
    if sql is None:
        return f"rows only ({len(got)})", seconds
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(columns)}", seconds
    if got != want and same_within_rounding(got, want):
        return f"ok within rounding ({len(got)})", seconds
    if got != want:
        only_got = [r for r in got if r not in set(want)][:3]
        only_want = [r for r in want if r not in set(got)][:3]
        return f"DIFFERS rows {len(got)} vs {len(want)} spark-only {only_got} sql-only {only_want}", seconds
    return f"ok ({len(got)})", seconds


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = get_spark(
        "check", "local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="8g",
        spark__checkpoint__dir=scratch, spark__ui__showConsoleProgress="false", spark__local__dir=scratch,
    )
    spark.sparkContext.setLogLevel("ERROR")
    oracles, failures = catalog.oracle_sql(), 0
    for name, query in catalog.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            outcome, seconds = compare(spark, sf_dir, name, query, oracles.get(name))
        except Exception as exc:  # report and go on with the next query
            outcome, seconds = f"ERROR {type(exc).__name__}: {str(exc)[:700]}", 0.0
            if wanted:
                traceback.print_exc()
        failures += outcome[:2] not in ("ok", "ro")
        print(f"{name:24s} {seconds:6.2f}s {outcome}", flush=True)
    print("failures", failures)
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
