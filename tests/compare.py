"""Run registered queries against their SQL checks: python tests/compare.py [sf] [name-part ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def normal(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([columns[i] for i in order] and [normal(r[i]) for i in order] for r in rows), key=repr)


def compare(spark, folder, names=None):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    found, oracles = entry.queries(), entry.oracle_sql()
    for name, fn in found.items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            got = [tuple(r) for r in df.collect()]
        except Exception as error:  # noqa: BLE001
            yield name, "ERROR " + " ".join(str(error).split())[:600], 0.0
            continue
        took = time.time() - start
        if name not in oracles:
            yield name, f"rows-only {len(got)}", took
            continue
        start = time.time()
        try:
            res = con.execute(oracles[name])
            cols = [c[0] for c in res.description]
            want = rows_of(cols, res.fetchall())
        except Exception as error:  # noqa: BLE001
            yield name, "SQLERROR " + str(error)[:600], took
            continue
        sql_took = time.time() - start
        have = rows_of(df.columns, got)
        if sorted(cols) != sorted(df.columns):
            yield name, f"COLUMNS {sorted(df.columns)} vs {sorted(cols)}", took
        elif have != want:
            bad = [(a, b) for a, b in zip(have, want) if a != b][:2]
            yield name, f"DIFF rows {len(have)} vs {len(want)}: {bad}", took
        elif not got:
            yield name, "EMPTY", took
        else:
            yield name, f"ok {len(got)} rows (sql {sql_took:.1f}s)", took


if __name__ == "__main__":
    from tracewell.session import local_session

    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    good = bad = 0
    for name, verdict, took in compare(session, f"/root/testdata/sf{sf}", sys.argv[2:]):
        fine = verdict.startswith(("ok", "rows-only"))
        good, bad = good + fine, bad + (not fine)
        if not fine or took > 4 or len(sys.argv) > 2:
            print(f"{name:42s} {took:6.2f}s {verdict}", flush=True)
    print(f"passed {good} failed {bad}")
    session.stop()
