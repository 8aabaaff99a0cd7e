"""Run registered queries next to their SQL twins and compare the rows.

    python tests/oracle_check.py [folder] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, [tuple(plain(r[c]) for c in cols) for r in df.collect()]


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]


def compare(spark_side, duck_side):
    """None when equal, else a short text about the first differences."""
    (sc, sr), (dc, dr) = spark_side, duck_side
    if sc != dc:
        return f"columns differ: {sc} / {dc}"
    a, b = sorted(sr, key=repr), sorted(dr, key=repr)
    kinds = [
        c for i, c in enumerate(sc)
        if {type(r[i]) for r in a if r[i] is not None} != {type(r[i]) for r in b if r[i] is not None}
    ]
    if kinds and len(a) == len(b):
        return f"value types differ in {kinds}"
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3]
        only_b = [r for r in b if r not in set(a)][:3]
        return f"rows {len(a)} / {len(b)}; only spark {only_a}; only sql {only_b}"
    return None


def main(argv):
    import __spark_entry__ as entry
    from quarrylight.session import build_session

    folder = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.001"
    names = [a for a in argv if not a.startswith("/")]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "quarrylight.input.partitions": "8", "quarrylight.index.shard_docs": "256", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(queries):
        picked = [q for q in queries if q == name or (name.endswith("*") and q.startswith(name[:-1]))]
        for q in picked:
            t0 = time.time()
            try:
                left = spark_rows(queries[q](spark, folder))
                t1 = time.time()
                note = compare(left, duck_rows(con, oracles[q])) if q in oracles else None
                t2 = time.time()
                state = "ok  " if note is None else "FAIL"
                bad += note is not None
                tag = "" if q in oracles else " (rows only)"
                print(f"{state} {q}{tag} rows={len(left[1])} spark={t1 - t0:.1f}s sql={t2 - t1:.1f}s {(note or '')[:1500]}", flush=True)
            except Exception as exc:
                bad += 1
                print(f"ERR  {q} {type(exc).__name__}: {str(exc)[:1500]}", flush=True)
                if os.environ.get("TRACE"):
                    traceback.print_exc()
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
