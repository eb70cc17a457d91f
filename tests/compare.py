"""Run queries next to their SQL and compare rows. Usage: compare.py [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from reviewlens.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return str(v)


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """A description of the first difference, or None."""
    df = entry.queries()[name](spark, sf_dir)
    got = sorted_rows(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if got[1] else "no rows"
    cur = con.execute(sql)
    want = sorted_rows([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, expected {len(want[1])}"
    for g, w in zip(*(x[1] for x in (got, want)), strict=True):
        if g != w:
            return f"\n  got  {str(g)[-700:]}\n  want {str(w)[-700:]}"
    return None


if __name__ == "__main__":
    sf = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    session = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    db = connect(sf)
    bad = 0
    for q in sys.argv[2:] or entry.queries():
        begin = time.time()
        try:
            problem = compare(session, db, q, sf)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        kind = "sql " if q in entry.oracle_sql() else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {q} {time.time() - begin:.1f}s {problem or ''}", flush=True)
        bad += problem is not None
    sys.exit(bad)
