"""Runs registered queries beside their oracles: python tests/compare.py [sf_dir] [name …]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(con, df, sql: str) -> str | None:
    """None when equal, else what differs."""
    left = normalised(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right = normalised([d[0] for d in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows != {len(right[1])}"
    bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    return f"{len(bad)} of {len(left[1])} rows differ, first:\n    {bad[0][0]}\n    {bad[0][1]}" if bad else None


if __name__ == "__main__":
    import __spark_entry__ as e
    from parcelsight.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(e.queries())
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = oracle_connection(sf), e.oracle_sql(), 0
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                problem = compare(con, e.queries()[name](spark, sf), oracles[name])
                note = "ok" if problem is None else f"DIFFERS {problem}"
            else:
                note = f"rows only: {len(e.queries()[name](spark, sf).collect())}"
        except Exception as err:
            note = f"ERROR {type(err).__name__}: {str(err)[:1500]}"
        failed += note.startswith(("DIFFERS", "ERROR"))
        print(f"{name:28s} {time.time() - start:6.1f}s  {note}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
