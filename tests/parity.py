"""Runs registered queries next to their SQL checks: python tests/parity.py [sf_dir] [name ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from tamarisk.catalog.base import TABLES
from tamarisk.session import build_session


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return "decimal " + str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str, got=None) -> str | None:
    """None when equal, else what differs."""
    got = [tuple(r) for r in df.collect()] if got is None else got
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    a, b = _rows(df.columns, got), _rows(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} of {len(a)} rows differ, first: {bad[0]}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if argv[1:] and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in argv[1:]):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            got = [tuple(r) for r in df.collect()]
            took = time.time() - start
            diff = compare(df, con, oracles[name], got) if name in oracles else None
            note = diff or f"{len(got)} rows" + ("" if name in oracles else " (no SQL check)")
        except Exception as e:  # a report over all queries must go on
            took = time.time() - start
            diff = note = f"{type(e).__name__}: {str(e)[:700]}"
        failed += diff is not None
        print(f"{'FAIL' if diff else 'pass'} {name} {took:.2f}s {note}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
