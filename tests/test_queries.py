import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from helpers import BASE, DATA, DAY, HOUR, rows, same

from weirlog.model import DIMENSIONS, Filter, Kind, Query, view
from weirlog.operators import aggregates, filters
from weirlog.plans import catalog, dashboard, sample
from weirlog.plans.execute import execute, pool_of
from weirlog.plans.report import render


@pytest.mark.parametrize("name", [n for n in catalog.SQL if n.startswith(("cls_", "filter_", "timeline", "class", "flag", "runner", "topn_uri", "rows_ts", "panels", "geo", "apply_tag_bot", "matches", "latest", "attack_rules", "bots_all", "local_v6", "json"))])
def test_against_sql(spark, name):
    same(catalog.QUERIES[name](spark, DATA), catalog.SQL[name], DATA)


@pytest.fixture(scope="module")
def many_users(spark, tmp_path_factory):
    """Events of users beyond the 65,536th, whose addresses have a part over 255."""
    at = str(tmp_path_factory.mktemp("many_users"))
    events = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/events.parquet")
    # Of users of 10.0.302 one polls and sends HEAD only, and one attacks.
    user = F.when(F.col("user_id") % 2 == 0, F.col("user_id") + 17 * 23 * 3 * 66).otherwise(F.col("user_id"))
    attacks = F.col("user_id") == 17 * 23 * 3 * 66 + 34
    events = events.withColumn("user_id", user).withColumns({"event_type": F.when(attacks, "error").otherwise(F.col("event_type")), "props": F.when(attacks, '{"k": 1}').otherwise(F.col("props"))})
    events.write.parquet(f"{at}/events.parquet")
    Path(at, "events.parquet").rename(Path(at, "all"))
    next(Path(at, "all").glob("part-*.parquet")).rename(Path(at, "events.parquet"))
    return at


@pytest.mark.parametrize("name", ["is_local_ip", *[n for n in catalog.SQL if n.startswith(("apply_tag_", "attackers_", "classification_", "cls_cadence", "cls_head_only", "compacted", "live_rows"))]])
def test_many_users_against_sql(spark, many_users, name):
    same(catalog.QUERIES[name](spark, many_users), catalog.SQL[name], many_users)


def test_many_events_against_sql(spark, tmp_path):
    """Events round the 2^16th, 2^32nd and 2^48th, whose numbers take one hexadecimal group more."""
    duckdb.sql(f"COPY (SELECT * REPLACE (event_id + [65000, 4294967000, 281474976710000][event_id % 3 + 1] AS event_id) FROM '{DATA}/events.parquet') TO '{tmp_path}/events.parquet'")
    assert same(catalog.QUERIES["geo_v6"](spark, str(tmp_path)), catalog.SQL["geo_v6"], str(tmp_path)) == 1000


def test_random_filters(spark):
    rnd, base = random.Random(5), sample.requests(spark, DATA).cache()
    values = {"host": ["www.example.com", "api.example.com"], "status": ["200", "404", "zz"], "is_bot": ["true", "0"], "method": ["GET", "HEAD"], "uri": ["/", "/ip"]}
    for _ in range(6):
        pick = lambda: {d: rnd.sample(v, rnd.randint(0, len(v))) for d, v in values.items() if rnd.random() < 0.5}
        inc, exc = pick(), pick()
        want = []
        for r in base.where("pool = 'dynamic'").collect():
            def of(d, v, r=r):
                return str(r[d]) == v if d not in ("is_bot",) else r[d] == (1 if v in ("true", "1") else 0)
            if all(not v or any(of(d, x) for x in v) for d, v in inc.items()) and not any(of(d, x) for d, v in exc.items() for x in v):
                want.append(r["seq"])
        got = filters.apply(pool_of(base, "dynamic"), Filter(inc, exc))
        assert sorted(r["seq"] for r in got.select("seq").collect()) == sorted(want)


def test_filter_rules():
    assert Filter().with_defaults("malicious") == Filter()
    assert Filter(include={"is_bot": ["true"]}).with_defaults("dynamic").exclude == {"is_local": ["true"]}
    assert Filter(exclude={"is_bot": ["false"]}).with_defaults("dynamic").exclude == {"is_bot": ["false"], "is_local": ["true"]}
    f = Filter({"host": ["a&b", "c"]}, {"status": ["404"]}, {"uri": ["x=y"]}, 5, 9)
    assert Filter.from_query(f.to_query()) == f and view("bots")[0] == "dynamic"
    with pytest.raises(ValueError):
        filters.condition(Filter(include={"nope": ["x"]}))
    assert len(DIMENSIONS) == 17


def test_timeline_edges(spark):
    df = rows(spark, [("1.1.1.1", "/a", 0), ("1.1.1.2", "/a", 3 * HOUR)])
    assert execute(rows(spark, [("1.1.1.1", "/a", 0)] * 2), Query(kind=Kind.TIMELINE)).count() == 0
    found = execute(df, Query(kind=Kind.TIMELINE, bucket=HOUR), now=BASE + 4 * HOUR).collect()
    assert [r["hits"] for r in found] == [1, 0, 0, 1, 0]  # up to now, the last bucket at the very end included
    assert aggregates.auto_width(0) == 60 * 10**9 and aggregates.auto_width(80 * 10**9) == 10**9 and aggregates.auto_width(900 * DAY * 10) == 30 * DAY
    assert execute(df.limit(0), Query(kind=Kind.TIMELINE)).count() == 0 and execute(df.limit(0), Query()).first()["hits"] == 0


def test_dashboard_and_report(spark):
    base = sample.requests(spark, DATA).cache()
    out = dashboard.dashboard(base, now=catalog.NOW)
    assert not out["errors"] and set(out["panels"]) == {p.name for p in dashboard.PANELS["dynamic"]}
    assert out["overview"]["hits"] == sum(r["hits"] for r in out["status_class"])
    page = dashboard.panel_page(base, "dynamic", "uri", limit=5)
    assert len(page["rows"]) == 5 and page["has_more"]
    with pytest.raises(ValueError):
        dashboard.panel("dynamic", "nope")
    text = render(base, ["<a.log>"], now=catalog.NOW)
    assert "&lt;a.log&gt;" in text and "Static" in text
