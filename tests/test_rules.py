from helpers import DAY, HOUR, rows

from weirlog.plans import rules


def found(df):
    return {r["ip"]: r["tag"] for r in df.collect()}


def many(ip, uri, n, step=1, more=None):
    return [(ip, uri, i * step, *([more] if more else [])) for i in range(n)]


def test_root_only(spark):
    a, b, c, d, e, f, g, h = (f"203.0.113.{i}" for i in range(1, 9))
    events = [
        *many(a, "/", 7), *many(b, "/", 5), (b, "/theme.css", 9), *many(c, "/", 6), (c, "/contact", 9), *many(d, "/", 3),
        (e, "/", HOUR), (e, "/", 40 * HOUR), *many(f, "/", 5, DAY), (f, "/menu.mjs", 9), *many(g, "/", 2, 30 * HOUR), (g, "/robots.txt", 2), (g, "/favicon.ico", 3), (h, "/", 0), (h, "/", 2 * DAY), (h, "/robots.txt", 1), (h, "/logo.svg", 1),
    ]
    out = {r["ip"]: r["reason"] for r in rules.RootOnly().run(rows(spark, events)).collect()}
    assert set(out) == {a, e, g} and out[e] == "2 / hit(s) across 2 UTC day(s); no static" and out[a] == "7 / hit(s) in a single UTC day; no static"


def test_probe_only(spark):
    soft, hard = "/sitemap.xml", "/sftp-config.json"
    a, b, c, d, e, f = (f"198.51.100.{i}" for i in range(1, 7))
    events = [(a, soft, 0), (b, hard, 0), (b, hard, 4), (c, hard, 0), (c, soft, 1), (d, soft, 0), (d, "/shop", 1), (e, hard, 0), (e, "/theme.css", 1), (f, "/shop", 0)]
    got = found(rules.ProbeOnly().run(rows(spark, events)))
    assert got == {a: "bot", b: "malicious", c: "malicious"}
    # Once the tags are applied, only a run that claims them finds them again.
    tagged = rows(spark, events, [(ip, tag) for ip, tag in got.items()])
    assert found(rules.ProbeOnly().run(tagged)) == {}
    assert found(rules.ProbeOnly().run(tagged, spark.createDataFrame([(ip,) for ip in got], "ip string"))) == got
    globs = rules.ProbeOnly([("/cam/snap?.jpg", "malicious"), ("/fw/*.bin", "bot")])
    events = [(a, "/fw/v2.bin", 0), (b, "/fw/v2.bin", 0), (b, "/shop", 0), (c, "/cam/snap1.jpg", 0), (c, "/fw/v3.bin", 0), (d, "/fw/notes.txt", 0), (e, "/cam/snap12.jpg", 0)]
    assert found(globs.run(rows(spark, events))) == {a: "bot", c: "malicious"}


def test_other_rules(spark):
    six = [(f"/p{i}") for i in range(6)]
    events = [(ip, u, i) for ip in ("1.1.1.1", "2.2.2.2", "3.3.3.3") for i, u in enumerate(six)] + [("2.2.2.2", "/favicon.ico", 9), ("3.3.3.3", "/a.css", 9)] + many("4.4.4.4", "/x", 3)
    assert set(found(rules.NoStatic().run(rows(spark, events)))) == {"1.1.1.1", "2.2.2.2"}
    odd = [0, 30, 330, 420, 430, 2000, 2700, 5000, 9000, 14000]
    events = many("1.1.1.1", "/a", 10, 60 * 10**9) + [("2.2.2.2", "/a", s * 10**9) for s in odd] + many("3.3.3.3", "/a", 5, 60 * 10**9)
    out = rules.Cadence().run(rows(spark, events)).collect()
    assert [(r["ip"], r["reason"]) for r in out] == [("1.1.1.1", "10 hits, mean interval 60s, CV 0%")]
    head, old = {"method": "HEAD"}, {"proto": "HTTP/1.0"}
    events = many("1.1.1.1", "/a", 4, 1, head) + many("2.2.2.2", "/a", 3, 1, head) + [("2.2.2.2", "/favicon.ico", 9)] + many("3.3.3.3", "/a", 3, 1, head) + many("4.4.4.4", "/a", 4, 1, old) + many("5.5.5.5", "/a", 3, 1, old) + [("5.5.5.5", "/a", 9, {"proto": "HTTP/1.1"})]
    assert set(found(rules.HeadOnly().run(rows(spark, events)))) == {"1.1.1.1"}
    assert set(found(rules.Http10Only().run(rows(spark, events)))) == {"4.4.4.4"}


def test_flagging_by_arrival(spark):
    a, b, c = "9.9.9.1", "9.9.9.2", "10.0.0.9"
    events = [(a, "/x", HOUR), (a, "/wp-login.php", 0), (a, "/.env", 5), (a, "/a.css", 7), (c, "/wp-login.php", 0), (b, "/wp-login.php", 0)]
    got = {(r["ip"], r["uri"]): (r["pool"], r["malicious_reason"]) for r in rows(spark, events, [(b, "real")]).collect()}
    assert got[a, "/x"] == ("malicious", "attack_uri:wordpress") == got[a, "/wp-login.php"]
    assert got[a, "/.env"] == ("malicious", "ip_flag:attack_uri:wordpress") == got[a, "/a.css"]
    assert got[c, "/wp-login.php"] == ("dynamic", "") == got[b, "/wp-login.php"]
    errors = many("7.7.7.7", "/m", 15, 1, {"status": 404})
    assert rows(spark, errors).select("malicious_reason").distinct().first()[0] == "behavior:err_rate=100%/15_hits"
    assert rows(spark, errors[:14]).where("pool = 'malicious'").count() == 0


def test_override_history(spark):
    events = [("1.1.1.1", "/a", 0), ("1.1.1.1", "/a.css", 0)]
    flags = lambda h: sorted((r["pool"], r["is_bot"], r["is_local"]) for r in rows(spark, events, h).collect())
    assert flags([("1.1.1.1", "bot")]) == [("dynamic", 1, 0), ("static", 1, 0)]
    assert flags([("1.1.1.1", "bot"), ("1.1.1.1", "malicious")]) == [("malicious", 1, 0)] * 2  # the flags stay the bot's
    assert flags([("1.1.1.1", "malicious"), ("1.1.1.1", "local")]) == [("dynamic", 0, 1), ("static", 0, 1)]


def test_order_of_candidates(spark):
    head = {"method": "HEAD"}
    events = many("4.0.0.1", "/a", 5, 1, head) + many("4.0.0.2", "/a", 9, 1, head) + many("4.0.0.3", "/a", 5, 1, head)
    assert [r["ip"] for r in rules.HeadOnly().listed(rows(spark, events)).collect()] == ["4.0.0.2", "4.0.0.1", "4.0.0.3"]
    steady, loose = [i * 90 * 10**9 for i in range(12)], [0, 80, 190, 270, 380, 460, 570, 650, 760, 840]
    events = [("4.0.1.1", "/a", s * 10**9) for s in loose] + [("4.0.1.2", "/a", s) for s in steady]
    assert [r["ip"] for r in rules.Cadence().listed(rows(spark, events)).collect()] == ["4.0.1.2", "4.0.1.1"]
    events = many("4.0.2.1", "/", 6) + many("4.0.2.2", "/", 3, DAY) + many("4.0.2.3", "/", 8)
    assert [r["ip"] for r in rules.RootOnly().listed(rows(spark, events)).collect()] == ["4.0.2.2", "4.0.2.3", "4.0.2.1"]
