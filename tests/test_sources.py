import gzip
import json
import os
import sqlite3
from contextlib import closing

import pytest

from weirlog.model import Filter
from weirlog.operators import filters
from weirlog.plans import rules
from weirlog.sources import files, json_log, store
from weirlog.sources.tags import TagSet
from weirlog.streaming import live


def line(ip="1.2.3.4", uri="/a", ts=1776816000.5, status=200, headers=None, **more):
    return json.dumps({"ts": ts, "msg": "handled request", "level": "info", "status": status, "size": 10, "duration": 0.002, "request": {"remote_ip": "9.9.9.9", "client_ip": ip, "proto": "HTTP/2.0", "method": "GET", "host": "h", "uri": uri, "headers": headers or {"User-Agent": ["Mozilla/5.0 (X11; Linux) Firefox/121.0"]}}} | more)


@pytest.fixture
def logs(tmp_path):
    (tmp_path / "b.log").write_text("\n".join([line(uri="/3"), "", "not json", '{"msg": "start"}', line(uri="/4", status="404")[:-1] + ', "x": 1}', line(ip="", uri="/5", headers={"user-agent": ["u"], "REFERRER": ["r"]})]) + "\n")
    with gzip.open(tmp_path / "a.log.gz", "wt") as f:
        f.write(line(uri="/1", ts=1776816100.0) + "\n" + line(uri="/2") + "\n")
    return tmp_path


def test_read(spark, logs):
    found = json_log.read(spark, [f"{logs}/*"]).orderBy("seq").collect()
    assert [r["uri"] for r in found] == ["/1", "/2", "/3", "/5"]  # the line with a status in quotes can't be read
    assert found[1]["ts"] == 1776816000500000000 and found[1]["duration_ns"] == 2_000_000 and found[1]["ip"] == "1.2.3.4"
    assert (found[3]["ip"], found[3]["user_agent"], found[3]["referer"]) == ("9.9.9.9", "u", "r")
    assert [r["seq"] for r in found] == sorted({r["seq"] for r in found})
    with pytest.raises(FileNotFoundError):
        json_log.expand([f"{logs}/none*"])


def test_store(spark, tmp_path, logs):
    cache, tags = str(tmp_path / "cache"), TagSet(str(tmp_path / "tags.json"))
    first = store.LogStore(spark, [f"{logs}/*.log*"], cache, tags)
    again = store.LogStore(spark, [f"{logs}/*.log*"], cache, tags)
    assert not first.from_cache and again.from_cache and again.rows().count() == first.rows().count() == 4
    window = filters.apply(again.rows(), Filter(time_from=1776816000000000000, time_to=1776816050000000000))
    assert window.count() == 3 and "PartitionFilters: [isnotnull(day" in window._jdf.queryExecution().toString()
    again.tag("1.2.3.4", "malicious")
    assert again.rows().where("pool = 'malicious'").count() == 3
    again.tag("1.2.3.4", "real")
    assert again.rows().where("pool = 'malicious'").count() == 0 and TagSet(str(tmp_path / "tags.json")).get("1.2.3.4").tag == "real"
    assert store.clear(cache, everything=True) and not store.clear(cache)
    with pytest.raises(ValueError):
        store.clear(cache, ["x"], True)


def test_runner(spark, tmp_path):
    class Fixed:
        name, ips = "fixed", []

        def run(self, rows, claimed=None):
            return spark.createDataFrame([(ip, "bot", "r") for ip in self.ips], "ip string, tag string, reason string")

    (tmp_path / "x.log").write_text("\n".join(line(ip=f"1.1.1.{i}") for i in range(1, 5)))
    s, rule = store.LogStore(spark, [str(tmp_path / "x.log")]), Fixed()
    rule.ips = ["1.1.1.1", "1.1.1.2"]
    assert s.run_rule(rule)["added"] == 2
    rule.ips = ["1.1.1.1", "1.1.1.3"]
    out = s.run_rule(rule)
    assert (out["added"], out["removed"], out["kept"]) == (1, 1, 1)
    at, known = s.tags.get("1.1.1.1").at, len(s.tags.history)
    assert s.run_rule(rule)["kept"] == 2 and s.tags.get("1.1.1.1").at == at and len(s.tags.history) == known  # nothing new, nothing written
    s.tag("1.1.1.3", "real")
    assert s.run_rule(rule)["skipped"] == 1 and s.tags.get("1.1.1.3").tag == "real"
    other = Fixed()
    other.name, other.ips = "other", ["1.1.1.1"]
    assert s.run_rule(other)["skipped"] == 1
    assert s.clear_rule(rule) == 1 and s.rows().where("is_bot = 1").count() == 0
    assert {r["name"] for r in s.run_rules()} == {r.name for r in rules.default_rules()}


def test_tags(tmp_path):
    path = str(tmp_path / "t.json")
    t = TagSet(path)
    t.put("1.1.1.1", "bot", at=1)
    t.put("2.2.2.2", "real", "rule", at=2)
    t.save()
    back = TagSet(path)
    assert [ip for ip, _ in back.newest()] == ["2.2.2.2", "1.1.1.1"] and [ip for ip, _ in back.newest("rule")] == ["2.2.2.2"]
    assert back.delete("1.1.1.1") and not back.delete("1.1.1.1") and len(back.history) == 2
    with pytest.raises(ValueError):
        back.put("1.1.1.1", "odd")
    (tmp_path / "old.json").write_text('{"3.3.3.3": {"tag": "bot", "at": 1}}')
    assert TagSet(str(tmp_path / "old.json")).get("3.3.3.3").source == "manual"
    assert Filter.from_query("#view=x") == Filter()


def test_tags_of_an_older_store(tmp_path):
    old = str(tmp_path / "old store.db")
    with closing(sqlite3.connect(old)) as db:
        db.execute("CREATE TABLE manual_tags (ip TEXT, tag TEXT, at INTEGER)")
        db.executemany("INSERT INTO manual_tags VALUES (?, ?, ?)", [("2.2.2.2", "real", 2 * 10**9), ("1.1.1.1", "bot", 10**9), ("3.3.3.3", "odd", 3)])
        db.commit()
    tags = TagSet(str(tmp_path / "t.json"))
    assert tags.adopt(old) == 2 and tags.adopt(old) == 0 and tags.adopt(str(tmp_path / "none.db")) == 0
    assert [(ip, t.tag, t.at, t.source) for ip, t in TagSet(str(tmp_path / "t.json")).newest()] == [("2.2.2.2", "real", 2.0, "manual"), ("1.1.1.1", "bot", 1.0, "manual")]
    with closing(sqlite3.connect(str(tmp_path / "empty.db"))) as db:
        db.execute("CREATE TABLE other (x)")
    assert TagSet().adopt(str(tmp_path / "empty.db")) == 0


def test_equal_names_in_folders(spark, tmp_path):
    for d in ("b", "a"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.log").write_text("".join(line(uri=f"/{d}{i}") + "\n" for i in range(3)))
    assert [r["uri"] for r in json_log.read(spark, [f"{tmp_path}/*/x.log"]).orderBy("seq").collect()] == ["/a0", "/a1", "/a2", "/b0", "/b1", "/b2"]


def test_remote_cache(spark, tmp_path, logs):
    """Paths with a scheme go through Spark's file system."""
    cache, seen = f"file://{tmp_path}/cache", []
    first = store.LogStore(spark, [f"file://{logs}/*.log*"], cache, progress=lambda *a: seen.append(a))
    again = store.LogStore(spark, [f"file://{logs}/*.log*"], cache)
    assert not first.from_cache and again.from_cache and again.rows().count() == 4 and seen[0][0] == "load"
    scanned = again.rows().where("pool = 'dynamic'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(pool" in scanned
    assert len(store.clear(cache, everything=True)) == 1 and not store.clear(cache, everything=True)


def test_once_and_sweep(spark, tmp_path):
    """Of several writers of a table one counts; what is old goes, other names and newer folders stay."""
    at, makes = f"{tmp_path}/requests-1", []

    def slow():
        makes.append(1)
        if len(makes) == 1:
            files.once(spark, at, slow, ["p"])  # another one is faster
        return spark.range(3).selectExpr("id", "id % 2 as p")

    where = files.once(spark, at, slow, ["p"])
    assert where == files.once(spark, at, slow, ["p"]) and len(makes) == 2 and spark.read.parquet(where).count() == 3
    assert sorted(x for x in os.listdir(at) if not x.startswith(".")) == sorted(["manifest.json", os.path.basename(where)])
    (tmp_path / "other-1").mkdir()
    assert files.sweep(spark, str(tmp_path), ("requests-",)) == [] and files.sweep(spark, str(tmp_path), ("requests-",), -1) == ["requests-1"]
    assert os.listdir(tmp_path) == ["other-1"]


def test_progress():
    out = []
    p = live.Progress(lambda *a: out.append(a), 1000)
    for i in range(1, 4):
        p("a", i, 3)
    p("b", 1, 9)
    assert out == [("a", 1, 3), ("a", 3, 3), ("b", 1, 9)]
