"""Requests for tests, as dicts with defaults, and the comparison of a query with its SQL."""

import duckdb
from pyspark.sql import functions as F

from weirlog.operators import pools

DATA = "/root/testdata/sf0.001"
BASE = 1776816000 * 10**9  # 2026-04-22 UTC
AGENT = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/120.0 Safari/537.36"
HOUR, DAY = 3600 * 10**9, 86400 * 10**9


def rows(spark, events, history=None, **thresholds):
    """events: (ip, uri, ts from BASE, and what differs from the defaults)."""
    out = []
    for i, (ip, uri, at, *more) in enumerate(events):
        e = {"seq": i, "ts": BASE + at, "status": 200, "method": "GET", "host": "example.com", "uri": uri, "ip": ip, "proto": "HTTP/2.0", "user_agent": AGENT, "referer": "", "duration_ns": 0, "size": 1, "bytes_read": 0}
        out.append(e | (more[0] if more else {}))
    df = spark.createDataFrame(out, "seq long, ts long, status int, method string, host string, uri string, ip string, proto string, user_agent string, referer string, duration_ns long, size long, bytes_read long")
    tags = spark.createDataFrame([(ip, tag, n) for n, (ip, tag) in enumerate(history)], "ip string, tag string, n long") if history else None
    return pools.assign(pools.label(df), tags, **thresholds)


def value(df, expression):
    return df.select(F.expr(expression)).first()[0]


def same(spark_df, sql, sf_dir):
    import glob
    import os

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(spark_df.columns)
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    theirs = sorted((tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()), key=str)
    ours = sorted((tuple(norm(r[c]) for c in sorted(names)) for r in spark_df.collect()), key=str)
    assert ours == theirs
    return len(ours)
