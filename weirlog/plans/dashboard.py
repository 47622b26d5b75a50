"""Dashboards: panels of a pool, run side by side or all in one pass."""

from __future__ import annotations

import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirlog.model import DIMENSIONS, Filter, Kind, Query, column_of
from weirlog.operators import aggregates, filters
from weirlog.plans.execute import execute, pool_of


@dataclass(frozen=True)
class Panel:
    name: str
    group_by: str
    extra: Filter = field(default_factory=Filter)
    order_by: str = ""


def _panels(names: str) -> list[Panel]:
    return [Panel(n, n) for n in names.split()]


PANELS = {
    "dynamic": [
        *_panels("ip uri country city referer browser os device host method status"), Panel("not_found", "uri", Filter(include={"status": ["404"]})),
        Panel("server_error", "uri", Filter(include={"status_class": ["5xx"]})), Panel("slow", "uri", order_by="max_dur"),
    ],
    "malicious": _panels("ip malicious_reason uri country city browser os host method status referer"),
    "static": _panels("uri ip referer host country"),
}
PAGE = 25


def panel(pool: str, name: str) -> Panel:
    found = next((p for p in PANELS[pool] if p.name == name), None)
    if found is None:
        raise ValueError(f"unknown panel {name!r}")
    return found


def panel_query(pool: str, name: str, flt: Filter | None = None, limit: int = 10, offset: int = 0) -> Query:
    spec = panel(pool, name)
    return Query(pool, Kind.TOPN, (flt or Filter()).merge(spec.extra), spec.group_by, limit, offset, order_by=spec.order_by)


def panel_page(rows: DataFrame, pool: str, name: str, flt: Filter | None = None, limit: int = PAGE, offset: int = 0) -> dict:
    found = execute(rows, panel_query(pool, name, flt, limit, offset)).collect()  # a page
    return {"panel": name, "rows": [r.asDict() for r in found], "offset": offset, "has_more": len(found) == limit}


def panels_in_one(found: DataFrame, pool: str, top: int = 10) -> DataFrame:
    """All panels of a filtered pool in one pass: each row is listed once per panel that it counts for, and counted by
    (panel, value). The first rows are taken within parts of a panel, then within panels, so no panel is one task."""
    specs = PANELS[pool]
    entries = []
    for p in specs:
        key = F.struct(F.lit(p.name).alias("panel"), F.col(column_of(p.group_by)).cast("string").alias("key"))
        test = filters.condition(p.extra)
        entries.append(key if test is None else F.when(test, key))
    listed = found.select("visitor_hash", "size", "duration_ns", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*", "visitor_hash", "size", "duration_ns")
    sums = listed.groupBy("panel", "key").agg(
        F.count("*").alias("hits"), F.count_distinct("visitor_hash").alias("visitors"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"),
        F.max("duration_ns").alias("_max"), F.avg("duration_ns").alias("_avg"),
    )
    order = F.when(F.col("panel") == "slow", F.col("_max")).otherwise(F.col("hits"))
    ranks = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(order.desc(), F.col("key").asc()))
    # Spark keeps no more than `top` rows of a part before it shuffles.
    parts = sums.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(64))).withColumn("_rank", ranks("panel", "_salt")).where(F.col("_rank") <= top)
    best = parts.withColumn("_rank", ranks("panel")).where(F.col("_rank") <= top)
    ms = lambda c: (F.col(c) / 1e6).cast("long")
    return best.select("panel", "key", "hits", "visitors", "bytes", ms("_max").alias("max_ms"), ms("_avg").alias("avg_ms"))


class Control:
    """Interrupts single panels of a dashboard, or all that still run, as a newer request does with an older one."""

    def __init__(self, spark: SparkSession):
        self.sc, self.prefix, self.gone = spark.sparkContext, f"dashboard-{uuid.uuid4().hex}", {}

    def tag(self, name: str) -> str:
        return f"{self.prefix}-{name}"

    def interrupt(self, name: str, why: str = "interrupted") -> None:
        """Its jobs end; the others go on."""
        self.gone.setdefault(name, why)
        self.sc.cancelJobsWithTag(self.tag(name))

    def interrupt_all(self, names: list[str]) -> None:
        for n in names:
            self.interrupt(n)


def dashboard(
    rows: DataFrame, pool: str = "dynamic", flt: Filter | None = None, top: int = 10, bucket: int = 0, now: int | None = None, workers: int = 8, deadline: float | None = None, control: Control | None = None,
) -> dict:
    """Overview, status classes, timeline and panels of a pool; a failed one leaves its error only.

    Each has jobs of its own under a tag, in a scheduler pool of its own (which counts where spark.scheduler.mode is FAIR), so
    a large panel doesn't keep the others waiting. One that takes longer than the deadline (seconds), or that the control
    interrupts, is cancelled, and the others answer.
    """
    began = time.time()
    flt = (flt or Filter()).with_defaults(pool)
    base = filters.apply(pool_of(rows, pool), flt).persist()
    sc, control = base.sparkSession.sparkContext, control or Control(base.sparkSession)
    jobs = {"overview": lambda: aggregates.overview(base), "status_class": lambda: aggregates.status_classes(base), "timeline": lambda: aggregates.timeline(base, flt, bucket, now)}
    for p in PANELS[pool]:
        # A panel's own include widens the user's, so it is applied to the pool rather than to the filtered rows.
        jobs[p.name] = lambda p=p: aggregates.topn(base, column_of(p.group_by), top, 0, p.order_by) if not p.extra.include else execute(rows, panel_query(pool, p.name, flt, top), now)
    out: dict = {"panels": {}, "errors": {}, "elapsed_ms": {}}

    def run(name: str) -> None:
        at, tag = time.time(), control.tag(name)
        watch = threading.Timer(deadline, control.interrupt, (name, f"took more than {deadline} s")) if deadline is not None else None
        sc.setLocalProperty("spark.scheduler.pool", f"panel-{name}")
        sc.addJobTag(tag)
        try:
            if watch:
                watch.start()
            found = [] if name in control.gone else [r.asDict() for r in jobs[name]().collect()]  # a few hundred rows at most
            if name in control.gone:
                raise TimeoutError
            if name in ("overview", "status_class", "timeline"):
                out[name] = found[0] if name == "overview" else found
            else:
                out["panels"][name] = found
        except Exception as e:  # noqa: BLE001
            out["errors"][name] = control.gone.get(name, str(e))
        finally:
            if watch:
                watch.cancel()
            sc.removeJobTag(tag)
            sc.setLocalProperty("spark.scheduler.pool", None)
        out["elapsed_ms"][name] = round(1000 * (time.time() - at))

    try:
        with ThreadPoolExecutor(workers) as pool_of_threads:
            list(pool_of_threads.map(run, jobs))
    finally:
        base.unpersist()
    out["elapsed_ms"]["all"] = round(1000 * (time.time() - began))
    return out


def dimensions() -> list[str]:
    return list(DIMENSIONS)
