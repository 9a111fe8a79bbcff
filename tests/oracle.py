"""Runs registered queries against their DuckDB SQL: ``python tests/oracle.py sf0.01 [name ...]``."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata"


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    return v


def canon(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """None when equal, else a short description of the difference."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = canon(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(want):
        in_got, in_want = set(map(repr, got)), set(map(repr, want))
        extra, missing = [g for g in in_got if g not in in_want][:2], [w for w in in_want if w not in in_got][:2]
        return f"{len(got)} rows vs {len(want)}; only spark {extra} only sql {missing}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(bad)} of {len(got)} rows differ: {sorted(df.columns)} spark={bad[0][0]} sql={bad[0][1]}"
    return None if got else "EMPTY"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from courtspark.session import local_session

    sf, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    import logging

    logging.disable(logging.CRITICAL)
    con, sql = connect(sf), entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t0 = time.time()
        try:
            if name in sql:
                diff = compare(query(spark, f"{DATA}/{sf}"), con, sql[name])
            else:
                n = query(spark, f"{DATA}/{sf}").count()
                diff = None if n else "EMPTY"
                name += f" (rows only: {n})"
        except Exception as e:  # report and go on with the next query
            diff = f"{type(e).__name__}: {str(e)[:400]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {time.time() - t0:.1f}s {diff or ''}", flush=True)
    print("failures:", bad)
