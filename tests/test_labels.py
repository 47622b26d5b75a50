import re

import pytest
from pyspark.sql import functions as F

from weirlog.functions.agents import parsed
from weirlog.plans.agent_sample import AGENTS
from weirlog.functions import labels, lists


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_bots(spark):
    cases = {
        "Mozilla/5.0 AppleWebKit/537.36 (compatible; bingbot/2.0)": True, "zgrab/0.x": True, "Wget/1.21.3": True, "okhttp/4.9": True, "my crawler": True, "Uptime-Kuma/1.23": True,
        "Mozilla/5.0 (X11; Fedora; Linux x86_64; rv:109.0) Gecko/20100101 Firefox/115.0": False, "Mozilla/5.0 (iPad; CPU OS 16_6) Version/16.6 Mobile/15E148 Safari/604.1": False, "": True,
    }
    assert column(spark, cases, labels.is_bot) == list(cases.values())
    words = ["bot", "b", "", "a.b", "abc", "x+"]
    texts = ["bot", "ab", "a.b", "axc", "xx+", "cc", ""]
    assert [bool(re.search(labels.any_word(words[2:]), t)) for t in texts] == [any(w in t for w in words[3:]) for t in texts]


def test_static(spark):
    cases = {"/main.scss": True, "/deep/er/app.mjs?h=2": True, "/pic.webp": True, "/xmlrpc.php": False, "/": False, "/v2/things": False, "/notes.rtf": False, "/b.css/": True, "/.js": False, "/y.": False, "/B.PNG#f": True, "": False}
    assert column(spark, cases, labels.is_static) == list(cases.values())


def test_local(spark):
    cases = {
        "127.8.9.1": True, "192.168.77.2": True, "10.200.3.4": True, "172.20.9.9": True, "172.15.255.255": False, "172.33.1.1": False, "9.9.9.9": False, "203.0.113.7": False, "100.127.0.9": True, "100.128.0.1": False, "::1": True,
        "fe80::abcd": True, "fd00:1::2": True, "2001:db8::5": False, "host.example": False, "": False, "fe80::2%wlan0": False, "::ffff:192.168.4.4": True, "::ffff:9.9.9.9": False, "10.1": False, "300.0.0.1": False,
    }
    assert column(spark, cases, labels.is_local) == list(cases.values())
    assert column(spark, ["10.0.300.1", "office-7", "9.9.9.9", "10.1.1.1", None], lambda c: labels.is_local(c, own=["10.0.", "office-"])) == [True, True, False, True, False]
    assert column(spark, ["10.0.300.1"], labels.is_local) == [False]


def test_attacks(spark):
    cases = {
        "/blog/WP-Config.bak": "wordpress", "/x/.git/HEAD": "git-dir", "/a.jsp/b": "script-extension", "/shop.PHTML?x": "script-extension", "/app/.environment": "env-file", "/home/.aws/credentials": "aws-creds", "/q?u=/PMA/": "phpmyadmin",
        "/goform/set?cmd=1": "router", "/mail/ews/exchange.asmx": "exchange", "/db.sql.gz": "backup", "/.npm_rc/config": "dotfile", "/static/%2E%2e%5Cx": None, "/static/%2e%2e%5cx": "traversal", "/downloads/list": None, "/downloader?x": "magento",
        "/about-us": None, "/phpinfos": "server-info", "/team.php.html": None, "/img/logo.svg?v=3": None, "/": None,
    }
    assert column(spark, cases, labels.attack_reason) == [v and f"attack_uri:{v}" for v in cases.values()]


def test_lists(tmp_path):
    rules = lists.attack_rules(["# c", "own=/X", "re:num=^/[0-9]+$", "/plain"], ["re:late=z$"])
    assert rules.substrings == (("own", "/x"), ("plain", "/plain")) and [r for r, _ in rules.regexes] == ["num", "late"]
    assert len(lists.attack_rules().regexes) == 4 and len(lists.attack_rules().substrings) == 69
    assert lists.crawlers_of("#x\nA Bot\t\tCrawlers\nFeed\tFeeds\nSpeedy\tSpider\tCrawlers") == ["A Bot", "Speedy Spider"]
    for bad in ("[]", '[{"uri": "", "tag": "bot"}]', '[{"uri": "/x", "tag": "odd"}]', "nope"):
        (tmp_path / "p.json").write_text(bad)
        with pytest.raises(ValueError):
            lists.probe_file(str(tmp_path / "p.json"))
    with pytest.raises(FileNotFoundError):
        lists.probe_file(str(tmp_path / "none.json"))


def test_device(spark):
    agents = ["Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Version/17.0 Mobile/15E148 Safari/604.1", "Mozilla/5.0 (Linux; Android 13; SM-X700) Chrome/120.0 Safari/537.36", "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Firefox/121.0", "Googlebot/2.1", "", "thing"]
    found = column(spark, agents, parsed)
    assert [f["device"] for f in found] == ["Mobile", "Tablet", "Desktop", "Bot", "", "Other"]
    assert [f["browser"] for f in found[:4]] == ["Safari", "Chrome", "Firefox", "Googlebot"] and [f["os"] for f in found[:3]] == ["iOS", "Android", "Linux"]


def test_agents_by_hand(spark):
    found = column(spark, [a for a, *_ in AGENTS], parsed)
    for (agent, *want), got in zip(AGENTS, found, strict=True):
        assert list(got) == want, agent


def test_small_functions(spark):
    df = spark.range(1)
    at = lambda c: df.select(c).first()[0]
    assert [at(labels.status_class(F.lit(s))) for s in (999, 500, 404, 301, 204, 101, 0)] == ["5xx", "5xx", "4xx", "3xx", "2xx", "1xx", "other"]
    assert at(labels.seconds_to_ns(F.lit(1776816000.25))) == 1776816000250000000
    assert [at(labels.human_duration(F.lit(float(s)))) for s in (72.5, 89, 90, 5400, 129600)] == ["72s", "89s", "2m", "2h", "2d"]
    assert labels.human_bytes(1536) == "1.5 KB" and labels.human_bytes(999, 1000) == "999 B"
    globs = {"/get/*.iso": {"/get/x.iso": True, "/get/x/y.iso": True, "/get/x.iso.sum": False}, "/p[a-c]?": {"/pax": True, "/pdx": False}}
    for g, cases in globs.items():
        assert column(spark, cases, lambda c, g=g: c.rlike(labels.glob_regex(g))) == list(cases.values())
    assert column(spark, ["/get/x/y.iso"], lambda c: c.rlike(labels.glob_regex("/get/*.iso", cross=False))) == [False]


def test_json_values(spark):
    assert column(spark, ['["a","b\\"c"]', "[]", "{}", "nope", None, "[1,null]"], labels.json_values) == [["a", 'b"c'], [], [], [], [], ["1"]]
