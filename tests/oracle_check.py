"""Compare a Spark query with its DuckDB oracle the way the round driver does.

Usage: ``python tests/oracle_check.py [sf_dir] [name ...]``; also imported by the
test-suite. Reports, per query: row counts, column names, an exact
order-insensitive value hash, and a tolerant comparison (1e-9 relative) that
explains hash differences.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return repr([_norm(x) for x in v])
    if isinstance(v, dict):
        return repr(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return repr(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, bool):
        return str(v)
    return str(v)


def _rows_hash(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(str(_norm(r[i])) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def _close(a, b):
    if a == b:
        return True
    try:
        fa, fb = float(a), float(b)
    except (TypeError, ValueError):
        return False
    if math.isnan(fa) and math.isnan(fb):
        return True
    return abs(fa - fb) <= 1e-9 * max(1.0, abs(fa), abs(fb))


def compare(spark, sf_dir, name, qfn, sql, con=None):
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = qfn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    res["oracle_rows"] = len(d_rows)
    res["cols_match"] = sorted(s_cols) == sorted(d_cols)
    if not res["cols_match"]:
        res["status"] = f"COLS spark={s_cols} oracle={d_cols}"
        return res
    hs, ls = _rows_hash(s_cols, s_rows)
    hd, ld = _rows_hash(d_cols, d_rows)
    res["hash_match"] = hs == hd
    if hs == hd:
        res["status"] = "ok"
        return res
    if len(s_rows) != len(d_rows):
        res["status"] = f"ROWS {len(s_rows)} vs {len(d_rows)}"
        res["sample_spark"] = [x for x in ls if x not in set(ld)][:3]
        res["sample_oracle"] = [x for x in ld if x not in set(ls)][:3]
        return res
    # tolerant row-by-row compare after sorting on the string form
    bad = 0
    examples = []
    for a, b in zip(ls, ld):
        fa, fb = a.split("|"), b.split("|")
        if len(fa) != len(fb) or not all(_close(x, y) for x, y in zip(fa, fb)):
            bad += 1
            if len(examples) < 3:
                examples.append((a, b))
    res["status"] = "close" if bad == 0 else f"DIFF {bad} rows"
    res["examples"] = examples
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from weekcast.session import get_spark

    spark = get_spark(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        try:
            r = compare(spark, sf_dir, name, qs[name], sqls.get(name), con)
        except Exception as e:  # report and continue
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(names or qs) - bad} ok / {bad} not ok")


if __name__ == "__main__":
    main(sys.argv)
