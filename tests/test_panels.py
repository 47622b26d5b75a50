"""Panels that are cancelled, and pins that are stored."""

import threading
import time

import pytest
from helpers import DATA
from pyspark.sql import functions as F

from weirlog.model import Filter
from weirlog.operators import aggregates, filters
from weirlog.plans import catalog, dashboard, sample
from weirlog.plans.execute import pool_of
from weirlog.sources.pins import PinSet


@pytest.fixture
def slow_uri(monkeypatch):
    """Counting the panel `uri` takes minutes."""
    topn = aggregates.topn

    @F.udf("long")
    def wait(x):
        time.sleep(1)
        return x

    def slowed(rows, column, top, *rest):
        found = topn(rows, column, top, *rest)
        return found if column != "uri" else topn(rows.withColumn("size", wait("size")), column, top, *rest)

    monkeypatch.setattr(aggregates, "topn", slowed)


def running(spark, tag):
    return [j for j in spark.sparkContext._jsc.sc().statusTracker().getJobIdsForTag(tag) if spark.sparkContext.statusTracker().getJobInfo(j).status == "RUNNING"]


def test_deadline(spark, slow_uri):
    base, control = sample.requests(spark, DATA), dashboard.Control(spark)
    began = time.time()
    out = dashboard.dashboard(base, "static", now=catalog.NOW, deadline=15, control=control)
    assert time.time() - began < 60 and out["errors"] == {"uri": "took more than 15 s"}
    assert set(out["panels"]) == {p.name for p in dashboard.PANELS["static"]} - {"uri"} and out["overview"]["hits"]
    time.sleep(1)
    assert not running(spark, control.tag("uri"))


def test_interrupted_panel(spark, slow_uri):
    base, control = sample.requests(spark, DATA), dashboard.Control(spark)
    stop = threading.Timer(6, control.interrupt, ("uri",))
    stop.start()
    out = dashboard.dashboard(base, "static", now=catalog.NOW, control=control)
    assert out["errors"] == {"uri": "interrupted"} and len(out["panels"]) == len(dashboard.PANELS["static"]) - 1
    late = dashboard.Control(spark)
    late.interrupt_all(["uri", "timeline"])
    out = dashboard.dashboard(base, "static", now=catalog.NOW, control=late)
    assert set(out["errors"]) == {"uri", "timeline"}


def test_pins(spark, tmp_path):
    path, base = str(tmp_path / "pins.json"), sample.requests(spark, DATA)
    pins = PinSet(path)
    pins.put("bots", "bots", Filter(time_from=1))
    pins.put("a&b", "static", Filter(include={"status": ["200"]}))
    pins.save()
    again = PinSet(path)
    assert again.pins == {"bots": ("bots", Filter()), "a&b": ("static", Filter(include={"status": ["200"]}))}
    day = 86_400_000_000_000
    main = aggregates.timeline_of(filters.apply(pool_of(base, "dynamic"), Filter(time_to=catalog.DAY9)), day)
    rows = again.overlay(base, main, Filter(time_to=catalog.DAY9), day).collect()
    want = base.where(filters.matches_view("bots", Filter(time_to=catalog.DAY9))).count()
    assert sum(r["hits_bots"] for r in rows) <= want and {"hits_bots", "hits_a&b"} <= set(rows[0].asDict())
    assert again.delete("bots") and not again.delete("bots")
    with pytest.raises(ValueError):
        again.put("x", "nope", Filter())
    for k in range(4):
        again.put(str(k), "dynamic", Filter())
    with pytest.raises(ValueError):
        again.put("one more", "dynamic", Filter())
    again.put("3", "static", Filter())  # one that is there changes
