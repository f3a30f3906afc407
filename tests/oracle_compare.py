"""Run registered queries in Spark and their oracle SQL in DuckDB and compare.

    python tests/oracle_compare.py [sf_dir] [name ...]

Rows are compared as sorted multisets after rounding doubles to 6 places.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def norm_rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    import __spark_entry__ as E
    t0 = time.time()
    df = E.queries()[name](spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    t1 = time.time()
    sql = E.oracle_sql().get(name)
    if sql is None:
        return True, f"{name}: rows-only {len(srows)} rows ({t1 - t0:.1f}s)"
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = [tuple(r) for r in res.fetchall()]
    t2 = time.time()
    if sorted(scols) != sorted(dcols):
        return False, f"{name}: columns differ spark={scols} sql={dcols}"
    a, b = norm_rows(srows, scols), norm_rows(drows, dcols)
    if a == b:
        return True, f"{name}: OK {len(a)} rows (spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s)"
    sa, sb = set(a), set(b)
    return False, (f"{name}: MISMATCH spark={len(a)} sql={len(b)} "
                   f"only_spark={sorted(sa - sb)[:3]} only_sql={sorted(sb - sa)[:3]}")


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from basketry.session import build_session
    import __spark_entry__ as E
    spark = build_session()
    con = duck(sf_dir)
    names = names or sorted(E.queries())
    bad = 0
    for nm in names:
        try:
            ok, msg = compare(spark, con, nm, sf_dir)
        except Exception as e:  # report and go on
            ok, msg = False, f"{nm}: ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(msg, flush=True)
    print(f"{len(names) - bad}/{len(names)} passed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
