"""Stores that get rows after their load: whatever is appended, compacted or killed, rows() equals one load of everything."""

import random

import pytest
from helpers import AGENT, BASE
from test_sources import line

from weirlog.model import Filter, Kind, Query
from weirlog.operators import filters, pools
from weirlog.plans.execute import pool_of
from weirlog.sources import json_log
from weirlog.sources.store import LogStore
from weirlog.sources.tags import TagSet

SCHEMA = "seq long, ts long, status int, method string, host string, uri string, ip string, proto string, user_agent string, referer string, duration_ns long, size long, bytes_read long"


def history(seed, n=240):
    """Addresses that attack early, late or never, that err a lot at first or at last, local ones and bots."""
    rnd, out = random.Random(seed), []
    for i in range(n):
        ip = rnd.choice([f"7.7.7.{k}" for k in range(9)] + ["10.1.1.1", "8.8.8.8", "8.8.8.8", "8.8.8.8"])
        uri = rnd.choice(["/a", "/b.css", "/c"] + ["/wp-login.php"] * (rnd.random() < 0.12))
        bad = rnd.random() < (0.9 if (ip[-1] in "123") == (i < n // 2) else 0.1)
        agent = "Googlebot" if ip == "7.7.7.8" else AGENT
        out.append((i, BASE + i * 1200 * 10**9, 404 if bad else 200, "GET", "h", uri, ip, "HTTP/2.0", agent, "", 1000 * i, i, 1))
    return out


def want(spark, events):
    return facts(pools.assign(pools.label(spark.createDataFrame(events, SCHEMA), v6=False)))


def facts(rows):
    """In the order of arrival, whatever the numbers of it are."""
    return [(r["ip"], r["uri"], r["pool"], r["malicious_reason"], r["is_bot"], r["status"]) for r in sorted(rows.collect(), key=lambda r: r["seq"])]


def started(spark, tmp_path, events, **more):
    """A store that has loaded these events as lines of two files."""
    folder = tmp_path / "logs"
    folder.mkdir()
    half = len(events) // 2
    for name, part in (("a.log", events[:half]), ("b.log", events[half:])):
        (folder / name).write_text("".join(line(ip=e[6], uri=e[5], ts=e[1] / 1e9, status=e[2], headers={"User-Agent": [e[8]]}) + "\n" for e in part))
    return LogStore(spark, [f"{folder}/*.log"], str(tmp_path / "cache"), v6=False, **more)


def batch(spark, events):
    return spark.createDataFrame(events, SCHEMA)


def test_appended_and_compacted(spark, tmp_path):
    """After each of these steps the rows are those of one load: addresses become flagged, their rates and reasons change, and stop being flagged."""
    events = history(1)
    store, at = started(spark, tmp_path, events[:120]), 120
    assert facts(store.rows()) == want(spark, events[:120])
    for k, step in enumerate((20, 1, 50, 49)):
        assert store.ingest(batch(spark, [(e[0] * 3 - 1000, *e[1:]) for e in events[at : at + step]]), "s", k)  # from wherever seq counts
        at += step
        assert not store.ingest(batch(spark, events[:5]), "s", k)  # a stream's batch that comes again
        assert facts(store.rows()) == want(spark, events[:at])
        if k in (1, 3):
            assert store.compact() == 2 and not store.compact()
            assert facts(store.rows()) == want(spark, events[:at]) == facts(LogStore(spark, store.paths, str(tmp_path / "cache")).rows())
    assert store.ingest(batch(spark, []), "s", 9) and not store.ingest(batch(spark, []), "s", 9)
    store.clean(0)
    assert facts(store.rows()) == want(spark, events)
    assert store.query(Query("malicious", Kind.OVERVIEW)).first()["hits"] == sum(f[2] == "malicious" for f in want(spark, events))


def test_only_touched_folders_are_written(spark, tmp_path):
    events = history(2)
    store = started(spark, tmp_path, events[:200])
    before = store.manifest.latest()[1]["rows"]
    late = [(e[0], BASE + 40 * 86400 * 10**9, 200, "GET", "h", "/new", "1.1.1.9", *e[7:]) for e in events[200:]]
    store.ingest(batch(spark, late))
    store.compact()
    after = store.manifest.latest()[1]["rows"]
    assert {p: v for p, v in after.items() if p in before} == before and len(after) == len(before) + 1
    store.clean(0)
    assert facts(store.rows()) == want(spark, events[:200] + late)


def test_killed_and_overtaken(spark, tmp_path, monkeypatch):
    """A compaction or a load that dies leaves all as it was; rows that come during a compaction stay; of two compactions one counts."""
    events = history(3)
    store = started(spark, tmp_path, events[:100])
    store.ingest(batch(spark, events[100:150]), "s", 0)

    def dies(*_):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(store.manifest, "change", dies)
        with pytest.raises(OSError):
            store.compact()
        with pytest.raises(OSError):
            store.ingest(batch(spark, events[150:160]), "s", 1)
    assert facts(store.rows()) == want(spark, events[:150])
    put, other = store._put, LogStore(spark, store.paths, str(tmp_path / "cache"), v6=False)
    assert other.from_cache

    def slow(*a):
        put(*a)
        other.ingest(batch(spark, events[150:200]), "s", 1)

    monkeypatch.setattr(store, "_put", slow)
    assert store.compact() == 1 and len(store.manifest.latest()[1]["delta"]) == 1
    assert facts(store.rows()) == want(spark, events[:200])

    def overtaken(*a):
        put(*a)
        other.compact()

    monkeypatch.setattr(store, "_put", overtaken)
    assert store.compact() == 0
    store.clean(0)
    assert facts(store.rows()) == facts(other.rows()) == want(spark, events[:200])
    fresh = LogStore(spark, store.paths, str(tmp_path / "other"), v6=False)
    assert not fresh.manifest.begin({}) and facts(fresh.rows()) == want(spark, events[:100])


def test_many_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("weirlog.sources.store.RUNS", 2)
    events = history(4)
    store = started(spark, tmp_path, events[:60])
    for k in range(3):
        store.ingest(batch(spark, events[60 + 60 * k : 120 + 60 * k]))
        store.compact()
    assert len(store.manifest.latest()[1]["addresses"]) <= 2
    store.clean(0)
    assert facts(store.rows()) == want(spark, events)


def scans(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in x]


def test_tags_keep_the_filters(spark, tmp_path):
    """With tags set no query reads all of the store: scans keep their days, those of other addresses also their pool, those of tagged ones their addresses."""
    events = history(5)
    store = started(spark, tmp_path, events[:200], tags=TagSet())
    window = Filter(time_from=BASE, time_to=BASE + 28 * 3600 * 10**9)
    for tags, parts in (([], 1), ([("7.7.7.1", "malicious")], 1), ([("7.7.7.1", "malicious"), ("7.7.7.2", "real"), ("8.8.8.8", "bot")], 2)):
        for ip, tag in tags:
            store.tag(ip, tag)
        found = scans(filters.apply(pool_of(store.rows(), "dynamic"), window))
        assert len([x for x in found if "In(ip" not in x and "isnotnull(pool" in x and "day" in x]) == 1, found
        others = [x for x in found if "isnotnull(pool" not in x]
        assert len(found) <= 2 and all("PartitionFilters: [isnotnull(day" in x and "ip" in x.split("PushedFilters")[1] for x in others), (parts, found)
    assert not [x for x in scans(store.rows().where("pool = 'malicious' and day >= '2026-04-22'")) if "PartitionFilters: []" in x]
    expected = pools.assign(pools.label(batch(spark, events[:200]), v6=False), store.tags.history_frame(spark))
    assert facts(store.rows()) == facts(expected)


def test_deltas_shuffle_nothing(spark, tmp_path):
    """Verdicts are written once, and a few are broadcast: neither summaries nor the base's rows are shuffled by a query; filters on days reach all scans."""
    events = history(7)
    store = started(spark, tmp_path, events[:120])
    store.ingest(batch(spark, events[120:]))
    found = store.rows().where("pool = 'malicious' and day >= '2026-04-23'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "first#" not in plan
    assert sum("PartitionFilters: [isnotnull(day" in x or "PartitionFilters: [isnotnull(pool" in x for x in scans(found)) == 2, scans(found)  # the base's rows, as they lie and judged again
    assert found.count() == want_count(spark, events)


def want_count(spark, events):
    return pools.assign(pools.label(batch(spark, events), v6=False)).where("pool = 'malicious' and ts >= 1776902400000000000").count()


def test_load_parses_once(spark, tmp_path):
    """Lines are read and parsed by one scan; what follows reads columns of the table that this makes."""
    (tmp_path / "x.log").write_text("".join(line(uri=f"/{i}") + "\n" for i in range(50)))
    raw = json_log.lines(spark, [str(tmp_path / "x.log")])
    plan = pools.label(json_log.parsed(raw, [*json_log.PLACE, "_line"]), v6=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    seen = []
    store = LogStore(spark, [str(tmp_path / "x.log")], str(tmp_path / "c"), progress=lambda *a: seen.append(a))
    assert store.rows().count() == 50 and store.files.names(store.root) == ["addresses", "manifests", "rows"]
    assert seen[0] == ("load", 0, 1) and seen[-1] == ("load", 1, 1) and any(p == "load rows" and n >= 50 for p, n, _ in seen)


def test_without_cache(spark, tmp_path):
    (tmp_path / "x.log").write_text(line() + "\n")
    store = LogStore(spark, [str(tmp_path / "x.log")])
    assert store.rows().count() == 1 and store.files.exists(store.root)
    store.close()
    assert not store.files.exists(store.root)
    empty = LogStore(spark, [], str(tmp_path / "none"), v6=False)
    assert empty.rows().count() == 0 and empty.ingest(batch(spark, history(6)[:9])) and empty.rows().count() == 9
