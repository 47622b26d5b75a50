"""The aggregations of the query kinds, and of the breakdown and the attackers' rules."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirlog.functions.labels import bucket
from weirlog.model import Filter

SECOND = 1_000_000_000
#: Widths of a timeline's buckets, of which the first that makes no more than 80 is taken.
WIDTHS = [s * SECOND for s in (1, 5, 15, 30, 60, 300, 900, 1800, 3600, 7200, 21_600, 43_200, 86_400, 604_800)]
MONTH, BARS = 30 * 86_400 * SECOND, 80


def _sums() -> list[Column]:
    return [F.count("*").alias("hits"), F.count_distinct("visitor_hash").alias("visitors"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes")]


def overview(rows: DataFrame) -> DataFrame:
    """One row, also of nothing: hits, visitors, bytes, first and last time."""
    return rows.agg(*_sums(), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def status_classes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status_class").agg(F.count("*").alias("hits")).orderBy("status_class")


def order_key(order_by: str) -> str:
    return {"bytes": "bytes", "visitors": "visitors", "max_dur": "max_ms", "max_ms": "max_ms", "slowest": "max_ms", "avg_dur": "avg_ms", "avg_ms": "avg_ms"}.get(order_by, "hits")


def groups(rows: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """key, hits, visitors, bytes, max_ms, avg_ms for each value; approximate counts visitors by a sketch (opt in)."""
    hits, exact, size = _sums()
    visitors = F.approx_count_distinct("visitor_hash", 0.01).alias("visitors") if approximate else exact
    ms = lambda c: (c / 1e6).cast("long")
    return rows.groupBy(F.col(column).cast("string").alias("key")).agg(hits, visitors, size, ms(F.max("duration_ns")).alias("max_ms"), ms(F.avg("duration_ns")).alias("avg_ms"), F.max("duration_ns").alias("_max"), F.avg("duration_ns").alias("_avg"))


def topn(rows: DataFrame, column: str, limit: int = 0, offset: int = 0, order_by: str = "", approximate: bool = False) -> DataFrame:
    """The first groups in falling order of the key, values in rising order among equals."""
    key = order_key(order_by)
    key = {"max_ms": "_max", "avg_ms": "_avg"}.get(key, key)
    out = groups(rows, column, approximate).orderBy(F.col(key).desc(), F.col("key").asc())
    return (out.offset(offset) if offset > 0 else out).limit(limit or 10).drop("_max", "_avg")


def auto_width(span: int) -> int:
    if span <= 0:
        return 60 * SECOND
    return next((w for w in WIDTHS if span // w <= BARS), MONTH)


def timeline(rows: DataFrame, flt: Filter | None = None, width: int = 0, now: int | None = None, pad: bool = True) -> DataFrame:
    """bucket_start, hits, visitors, bytes; rows are filtered already, flt gives the span. Empty buckets between are zeros.

    The span runs from the filter's start, else the first row, to the filter's end, else now. No span, no rows.
    """
    flt = flt or Filter()
    start, end = flt.time_from, flt.time_to
    if start is None or end is None:
        first, last = rows.agg(F.min("ts"), F.max("ts")).first()
        if first is None or (start is None and end is None and first == last):
            return timeline_of(rows, 60 * SECOND).limit(0)
        start = first if start is None else start
        end = (now if now is not None else time.time_ns()) if end is None else end
    if end <= start:
        return timeline_of(rows, 60 * SECOND).limit(0)
    width = width or auto_width(end - start)
    found = timeline_of(rows, width)
    if not pad:
        return found.orderBy("bucket_start")
    spark = rows.sparkSession
    all_starts = spark.range(start // width, end // width + 1).select((F.col("id") * width).alias("bucket_start"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("hits", "visitors", "bytes")]
    return all_starts.join(found, "bucket_start", "left").select("bucket_start", *zero).orderBy("bucket_start")


def timeline_of(rows: DataFrame, width: int) -> DataFrame:
    return rows.groupBy(bucket(F.col("ts"), width).alias("bucket_start")).agg(*_sums())


def overlay(main: DataFrame, pins: dict[str, DataFrame]) -> DataFrame:
    """A timeline with the hits of others beside it, bucket by bucket, zero where one has none."""
    for name, pin in pins.items():
        main = main.join(pin.select("bucket_start", F.col("hits").alias(f"hits_{name}")), "bucket_start", "left").withColumn(f"hits_{name}", F.coalesce(f"hits_{name}", F.lit(0)))
    return main


#: Timelines that may be laid over another one at a time.
PINS = 5


def pinned(rows: DataFrame, pins: dict[str, tuple[str, Filter]], flt: Filter, width: int) -> dict[str, DataFrame]:
    """Timelines of pins, each a view and a filter, over the time of the current filter; a pin's own times don't count."""
    from dataclasses import replace

    from weirlog.operators.filters import matches_view

    if len(pins) > PINS:
        raise ValueError(f"no more than {PINS} pins")
    within = {n: (v, replace(f, time_from=flt.time_from, time_to=flt.time_to)) for n, (v, f) in pins.items()}
    return {n: timeline_of(rows.where(matches_view(v, f)), width) for n, (v, f) in within.items()}


ROW_ORDERS = {f"{k}_{d}": (c, d) for k, c in (("ts", "ts"), ("duration", "duration_ns"), ("status", "status")) for d in ("asc", "desc")}
ROW_COLUMNS = ["ts", "status", "status_class", "method", "host", "uri", "ip", "proto", "user_agent", "referer", "country", "city", "browser", "os", "device", "duration_ns", "size", "is_bot", "is_local", "is_static", "malicious_reason"]


def latest(rows: DataFrame, limit: int = 0, offset: int = 0, order_by: str = "") -> DataFrame:
    """Raw rows, the newest first unless another order is asked for; arrival decides among equals."""
    column, way = ROW_ORDERS.get(order_by, ("ts", "desc"))
    key = F.col(column).desc() if way == "desc" else F.col(column).asc()
    out = rows.orderBy(key, F.col("seq").asc())
    return (out.offset(offset) if offset > 0 else out).limit(limit or 50).select("seq", *ROW_COLUMNS)


def breakdown(rows: DataFrame, time_from: int | None = None, time_to: int | None = None) -> DataFrame:
    """Hits and bytes of real, bot, local and malicious traffic, static and dynamic, and flagged addresses: one pass."""
    from weirlog.operators.filters import apply

    pool, local, bot, static = F.col("pool"), F.col("is_local") == 1, F.col("is_bot") == 1, F.col("is_static") == 1
    cells: dict[str, Column] = {}
    for name, test in (("real", ~local & ~bot), ("bot", ~local & bot), ("local", local)):
        cells |= {f"{name}_static": (pool == "static") & test, f"{name}_dynamic": (pool == "dynamic") & test}
    cells |= {"malicious_static": (pool == "malicious") & static, "malicious_dynamic": (pool == "malicious") & ~static}
    aggs = [a for n, test in cells.items() for a in (F.count_if(test).alias(n), F.coalesce(F.sum(F.when(test, F.col("size"))), F.lit(0)).cast("long").alias(f"{n}_bytes"))]
    return apply(rows, Filter(time_from=time_from, time_to=time_to)).agg(*aggs, F.count_distinct(F.when(pool == "malicious", F.col("ip"))).alias("flagged_ips"))


def shares(groups: DataFrame, column: str = "hits") -> DataFrame:
    """A top-n table with each row's share of the total and of the largest, in percent; it has a few rows."""
    everything = Window.partitionBy()
    return groups.withColumn("share", 100.0 * F.col(column) / F.sum(column).over(everything)).withColumn("bar", 100.0 * F.col(column) / F.max(column).over(everything))


def repeat_attackers(rows: DataFrame, least: int = 2) -> DataFrame:
    """(ip, reason): addresses with so many rows in the malicious pool, local ones aside."""
    found = rows.where((F.col("pool") == "malicious") & (F.col("is_local") == 0)).groupBy("ip").count().where(F.col("count") >= least)
    return found.select("ip", F.concat(F.lit("behavior:repeat_attack_uris="), F.col("count").cast("string")).alias("reason"))


def error_reason(hits: Column, errors: Column) -> Column:
    return F.concat(F.lit("behavior:err_rate="), F.bround(errors / hits * 100, 0).cast("long").cast("string"), F.lit("%/"), hits.cast("string"), F.lit("_hits"))


def erring_attackers(rows: DataFrame, least: int = 15, rate: float = 0.70) -> DataFrame:
    """(ip, reason): addresses of all pools, neither local nor bots, of whose many rows most failed with 4xx."""
    own = rows.where((F.col("is_local") == 0) & (F.col("is_bot") == 0)).groupBy("ip").agg(F.count("*").alias("hits"), F.count_if(F.col("status").between(400, 499)).alias("errors"))
    return own.where((F.col("hits") >= least) & (F.col("errors") / F.col("hits") >= rate)).select("ip", error_reason(F.col("hits"), F.col("errors")).alias("reason"))


def merged_attackers(rows: DataFrame, least: int = 15, rate: float = 0.70, repeats: int = 2) -> DataFrame:
    """Both rules; repeated attacks are the better reason."""
    a, b = repeat_attackers(rows, repeats), erring_attackers(rows, least, rate).withColumnRenamed("reason", "other")
    return a.join(b, "ip", "full_outer").select("ip", F.coalesce("reason", "other").alias("reason"))
