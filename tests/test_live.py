"""Following files: rotation, truncation, restarts and limits of batches; flags as state; subscribers."""

import json
import os
import random
import threading
import time

import pytest
from test_sources import line

from weirlog.operators import filters
from weirlog.model import Filter
from weirlog.progress import StreamProgress
from weirlog.sources.store import LogStore
from weirlog.sources.tail import TailReader, shares
from weirlog.streaming import live
from weirlog.streaming.hub import Hub


def reader(patterns, **options):
    return TailReader({"paths": json.dumps([str(p) for p in patterns])} | {k: str(v) for k, v in options.items()})


def batch(r, start):
    """The next batch of a reader: its lines in order, its bytes, and its offset."""
    end = json.loads(json.dumps(r.latestOffset()))
    found = sorted((arrival, text, path) for span in r.partitions(start, end) for text, path, _, arrival in r.read(span))
    return [(os.path.basename(p), t) for _, t, p in found], end["read"] - start["read"], end


def put(path, text, mode="a"):
    with open(path, mode) as f:
        f.write(text)


def test_rotation_truncation_and_partial_lines(tmp_path):
    path = tmp_path / "t.log"
    put(path, "one\ntwo\npart")
    r = reader([path])
    got, _, at = batch(r, r.initialOffset())
    assert [t for _, t in got] == ["one", "two"]
    put(path, "ial\nthree\n")
    got, _, at = batch(r, at)
    assert [t for _, t in got] == ["partial", "three"]
    put(path, "last of the old\nunended")
    os.replace(path, f"{path}.1")
    put(path, "new\n")
    got, _, at = batch(r, at)
    assert [t for _, t in got] == ["last of the old", "unended", "new"]  # the old file first, to its very end
    os.replace(path, f"{path}.2")
    got, _, at = batch(r, at)
    assert got == []
    put(f"{path}.2", "still written\n")  # before the writer opens the new one
    got, _, at = batch(r, at)
    assert [t for _, t in got] == ["still written"]
    put(path, "x\n", "w")
    got, _, at = batch(r, at)
    assert [t for _, t in got] == ["x"]
    put(path, "", "w")
    assert batch(r, at)[0] == []
    put(path, "y\n")
    assert [t for _, t in batch(r, r.now)[0]] == ["y"]
    assert next(iter(reader([path], fromstart="false").initialOffset()["files"].values()))[0][1] == 2
    assert next(iter(reader([path], startbytes=json.dumps({str(path): 1})).initialOffset()["files"].values()))[0][1] == 1


def test_twenty_files_within_limits(tmp_path):
    """Every line once and in the order of its file, no batch above the limit, no file waits for a large one; through rotations and restarts."""
    rnd, limit, names = random.Random(4), 2000, [tmp_path / f"f{k:02}.log" for k in range(20)]
    written, read = {n.name: [] for n in names}, {n.name: [] for n in names}
    r = reader([tmp_path / "*.log"], maxbytes=limit)
    at = r.initialOffset()
    for step in range(60):
        for k, n in enumerate(names[: 5 + step]):  # some come later
            if step < 30 and n.exists() and rnd.random() < 0.1:  # one that the reader has seen
                os.replace(n, f"{n}.{step}")
            if step < 30 and rnd.random() < (0.9 if k == 0 else 0.2):
                new = [f"{n.name} {len(written[n.name]) + i} " + "x" * rnd.randrange(30) for i in range(rnd.randrange(60 if k == 0 else 4))]
                put(n, "".join(f"{x}\n" for x in new))
                written[n.name] += new
        if step % 7 == 3:
            r = reader([tmp_path / "*.log"], maxbytes=limit, resume=json.dumps(at))
        got, size, at = batch(r, at)
        assert size <= limit
        for name, text in got:
            read[name].append(text)
    assert read == written and sum(map(len, read.values())) > 500
    assert shares([5, 100, 30, 0], 60) == [5, 28, 27, 0] and shares([1, 2], 100) == [1, 2] and shares([], 5) == []


def test_a_line_longer_than_the_limit(tmp_path):
    put(tmp_path / "a.log", "x" * 500 + "\nshort\n")
    r = reader([tmp_path / "a.log"], maxbytes=100)
    got, _, at = batch(r, r.initialOffset())
    assert [t for _, t in got] == ["x" * 500]
    assert [t for _, t in batch(r, at)[0]] == ["short"]


def test_removed_before_read(tmp_path):
    put(tmp_path / "a.log", "x\n")
    r = reader([tmp_path / "a.log"])
    start, end = r.initialOffset(), r.latestOffset()
    os.remove(tmp_path / "a.log")
    with pytest.raises(FileNotFoundError):
        r.partitions(start, end)


def started(spark, tmp_path, *lines):
    (tmp_path / "base.log").write_text("".join(x + "\n" for x in lines))
    return LogStore(spark, [str(tmp_path / "base.log")], str(tmp_path / "cache"), v6=False)


def follow(store, tmp_path, **options):
    return live.follow(store, [f"{tmp_path}/live*.log"], f"file://{tmp_path}/cp", from_start=True, once=True, **options)


def state_rows(spark, tmp_path):
    return spark.read.format("statestore").option("stateVarName", "flag").load(f"file://{tmp_path}/cp").selectExpr("key.ip as ip", "value.reason as reason").collect()


def test_follow_and_restart(spark, tmp_path):
    """Rows are in the store after each batch; flags known from the load or found in an earlier run hold; state has flagged addresses only."""
    store, seen = started(spark, tmp_path, line(ip="4.4.4.4", uri="/wp-login.php"), line(ip="5.5.5.5", uri="/early")), {}
    listen = StreamProgress(lambda *a: told.append(a))
    told: list = []
    spark.streams.addListener(listen)
    show = lambda df: seen.update({r["uri"]: (r["pool"], r["malicious_reason"]) for r in df.collect()})
    put(tmp_path / "live1.log", "\n".join([line(ip="5.5.5.5", uri="/x"), line(ip="5.5.5.5", uri="/wp-login.php"), line(ip="5.5.5.5", uri="/a.css"), line(ip="4.4.4.4", uri="/known")]) + "\n")
    put(tmp_path / "live2.log", "\n".join(line(ip=f"6.6.6.{k}", uri=f"/ok{k}") for k in range(20)) + "\n")
    follow(store, tmp_path, callback=show, max_bytes=3000)
    assert seen["/x"] == ("dynamic", "") and seen["/wp-login.php"] == ("malicious", "attack_uri:wordpress") and seen["/known"] == ("malicious", "ip_flag:attack_uri:wordpress") and "/a.css" not in seen
    assert store.rows().count() == 26 and len(store.manifest.latest()[1]["delta"]) > 1
    assert {(r["ip"], r["reason"]) for r in state_rows(spark, tmp_path)} == {("4.4.4.4", "attack_uri:wordpress"), ("5.5.5.5", "attack_uri:wordpress")}
    # The store moves the rows that came before the attack, also those of the base.
    assert {r["uri"]: r["malicious_reason"] for r in store.rows().where("ip = '5.5.5.5'").collect()} == {"/early": "attack_uri:wordpress", "/x": "attack_uri:wordpress", "/wp-login.php": "attack_uri:wordpress", "/a.css": "ip_flag:attack_uri:wordpress"}
    put(tmp_path / "live1.log", line(ip="5.5.5.5", uri="/later") + "\n" + line(ip="6.6.6.1", uri="/.env") + "\n")
    put(tmp_path / "live3.log", line(ip="5.5.5.5", uri="/third") + "\n")
    again = LogStore(spark, store.paths, str(tmp_path / "cache"), v6=False)
    follow(again, tmp_path, callback=show, max_bytes=500, compact_after=2)
    assert seen["/later"][1] == seen["/third"][1] == "ip_flag:attack_uri:wordpress" and again.rows().count() == 29 == len({r["seq"] for r in again.rows().collect()})
    assert len(state_rows(spark, tmp_path)) == 3 and len(again.manifest.latest()[1]["delta"]) < 2
    follow(again, tmp_path)
    assert again.rows().count() == 29
    deadline = time.time() + 20
    while sum(1 for a in told if a[2] >= 0) < 3 and time.time() < deadline:
        time.sleep(0.1)
    spark.streams.removeListener(listen)
    rising = [a[1] for a in told]
    assert rising == sorted(rising) and rising[-1] == 27


def test_batch_that_comes_again(spark, tmp_path, monkeypatch):
    """The query dies between the store and Spark's commit: the batch comes again, its rows don't."""
    store = started(spark, tmp_path, line(uri="/base"))
    put(tmp_path / "live.log", "".join(line(uri=f"/{k}") + "\n" for k in range(9)))

    def dies(_):
        raise OSError("killed")

    with pytest.raises(Exception, match="killed"):
        follow(store, tmp_path, callback=dies)
    assert store.rows().count() == 10
    put(tmp_path / "live.log", line(uri="/more") + "\n")
    follow(store, tmp_path)
    assert sorted(r["uri"] for r in store.rows().collect()) == sorted(["/base", "/more", *[f"/{k}" for k in range(9)]])


def test_slow_subscriber(spark):
    """A slow one loses rows, and is left when it takes too long; a fast one gets all, each in order; no more is held than the rings."""
    hub, fast, some, gate = Hub(), [], [], threading.Event()
    quick = hub.subscribe(fast.append, size=10_000)
    slow = hub.subscribe(lambda row: gate.wait(30), size=5, limit=0.5)
    hub.subscribe(lambda row: some.append(row["seq"]), filters.matches_view("dynamic", Filter(include={"host": ["a"]})), size=1000)
    broken = hub.subscribe(lambda row: 1 / 0)
    rows = spark.range(0, 300, 1, 7).selectExpr("id as seq", "if(id % 3 = 0, 'a', 'b') as host", "'dynamic' as pool", "0 as is_bot", "0 as is_local")
    hub.publish(rows)
    assert quick.drained() and [r["seq"] for r in fast] == list(range(300)) and quick.dropped == 0
    assert slow.dropped == 294 and len(slow.waiting) == 5 and some == list(range(0, 300, 3)) and isinstance(broken.error, ZeroDivisionError)
    time.sleep(0.6)
    hub.publish(rows)
    assert slow.closed and len(hub.subscribers) == 2 and quick.drained() and len(fast) == 600
    gate.set()
    hub.unsubscribe(quick)
    hub.publish(rows.limit(0))
    assert len(hub.subscribers) == 1


def test_command_and_places(spark, tmp_path, capsys):
    """The command line's follow, stopped and started again, after a load, with places from a database."""
    from test_geo import database

    from weirlog.__main__ import main

    database(tmp_path / "p.mmdb", [(4 << 24, 104, ("Four", "Fourton")), (4 << 24 | 4 << 16, 112, ("Deep", "Deeptown"))])
    log, cache = str(tmp_path / "a.log"), str(tmp_path / "c")
    put(f"{log}.old", line(ip="4.9.9.9", uri="/old") + "\n")
    say = ["follow", log, "--load", f"{log}.old", "--cache", cache, "--checkpoint", f"file://{tmp_path}/cp", "--geo", str(tmp_path / "p.mmdb"), "--once"]
    put(log, line(ip="4.9.9.9", uri="/first") + "\n")
    assert main(say) == 0
    put(log, line(ip="4.4.1.1", uri="/second") + "\n" + line(ip="5.5.5.5", uri="/third") + "\n")
    assert main(say) == 0
    found = LogStore(spark, [], cache, name="followed").rows().orderBy("seq").collect()
    assert [(r["uri"], r["country"], r["city"]) for r in found] == [("/old", "Four", "Fourton"), ("/first", "Four", "Fourton"), ("/second", "Deep", "Deeptown"), ("/third", "", "")]
    told = capsys.readouterr().out
    assert "/second" in told and told.count("/first") == 1
    assert main(["clear-cache", "--cache", cache, "--all"]) == 0
