"""Run named queries next to their oracle SQL and report differences.

Usage: python tests/compare.py SF_DIR [name …]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        f = float(v)
        return (2, "nan" if math.isnan(f) else f"{f + 0.0:.9g}")
    return (3, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql) -> str:
    """Empty when both sides hold the same rows, else what differs."""
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = rows_of(names, res.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    if got == want:
        return ""
    a, b = set(got), set(want)
    return f"{len(got)} rows vs {len(want)}; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from tests.session import make_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark, con = make_session(), duck(sf)
    sql = e.oracle_sql()
    bad = 0
    for name, run in e.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            msg = difference(run(spark, sf), con, sql[name]) if name in sql else "no sql"
        except Exception:
            msg = "".join(traceback.format_exc().splitlines(True)[-6:])[:1500]
        bad += bool(msg)
        print(f"{'BAD' if msg else 'ok '} {name} {time.time() - t:.1f}s {msg}", flush=True)
    print("missing queries:", sorted(set(sql) - set(e.queries())), "bad:", bad)
