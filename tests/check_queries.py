"""Compare registered queries with their SQL twins (run as a script).

    python tests/check_queries.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

# Digits compared; the driver may compare all of them (see --exact).
DIGITS = 17 if "--exact" in sys.argv else 9
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    """One spelling per value across both engines."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.{DIGITS}g}") + 0.0
    if isinstance(value, dict):
        return tuple(sorted((k, normal(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if type(value).__name__ == "Decimal":
        return float(f"{float(value):.9g}")
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(con, df, sql: str | None) -> str:
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows {len(got)}"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(names)}"
    want = rows_of(names, cur.fetchall())
    if len(got) != len(want):
        return f"COUNT {len(got)} != {len(want)}"
    if got != want:
        extra, absent = Counter(got) - Counter(want), Counter(want) - Counter(got)
        return (f"VALUES {sum(extra.values())} of {len(got)} differ, columns {sorted(names)}: "
                f"{sorted(extra, key=str)[:2]} != {sorted(absent, key=str)[:2]}")
    return f"ok {len(got)}" if got else "EMPTY"


def main() -> None:
    from catalog import ORACLE_SQL, QUERIES
    from daygrain.session import build_session
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    if "--plain" in sys.argv:  # a session without the library's settings
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").getOrCreate()
    else:
        spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, fn in QUERIES.items():
        if args and not any(a in name for a in args):
            continue
        began = time.time()
        try:
            verdict = compare(con, fn(spark, sf_dir), ORACLE_SQL.get(name))
        except Exception as error:  # report and go on with the next query
            verdict = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        bad = not verdict.startswith(("ok", "rows"))
        failed += bad
        print(f"{'FAIL' if bad else 'pass'} {name:36s} {time.time() - began:6.1f}s {verdict}", flush=True)
    print(f"{failed} failed")
    sys.exit(1 if failed else 0)


if __name__ == "__main__":
    main()
