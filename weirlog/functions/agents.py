"""User agents: one pass over the tokens of a text, which keeps the best family, system and marks of a device seen so far.

A token is a word with its version ("Chrome/120.0"), a number that follows a word ("Android 13", "NT 10.0"), or rv: with one.
Each token is looked up in ordered tables; of several families the one of the least rank counts ("Chrome/120 Safari/537
Edg/120" is Edge). Words that end in bot, crawler or spider are families of their own and come before browsers. It is a
fold over an array in the JVM; rows of one agent needn't be brought together for it.

The rules are our own: compatible with common parsers, not identical to any. '' stands for what isn't known.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that name a browser or client, in the order of precedence; the first of two names what all its words are shown as.
FAMILIES = [
    ("Headless Chrome", "headlesschrome"), ("Facebook", "fban fbav fb_iab"), ("Instagram", "instagram"), ("DuckDuckGo", "duckduckgo ddg"), ("Brave", "brave"), ("Vivaldi", "vivaldi"),
    ("Yandex", "yabrowser"), ("UC Browser", "ucbrowser ubrowser"), ("Whale", "whale"), ("QQ Browser", "qqbrowser mqqbrowser"), ("MIUI Browser", "miuibrowser"), ("Samsung Browser", "samsungbrowser"),
    ("Silk", "silk"), ("Opera", "opr opios opx opera"), ("Edge", "edg edge edga edgios"), ("SeaMonkey", "seamonkey"), ("PaleMoon", "palemoon"), ("Firefox Focus", "focus klar"), ("Firefox", "firefox fxios"),
    ("Electron", "electron"), ("Chromium", "chromium"), ("Chrome", "chrome crios"), ("Internet Explorer", "msie trident"), ("Konqueror", "konqueror"), ("Epiphany", "epiphany"), ("Safari", "safari"),
    ("curl", "curl libcurl"), ("Wget", "wget"), ("Python Requests", "python-requests"), ("Python urllib", "python-urllib"), ("aiohttp", "aiohttp"), ("HTTPX", "python-httpx"), ("Scrapy", "scrapy"), ("Go HTTP client", "go-http-client"),
    ("okhttp", "okhttp"), ("Apache HttpClient", "apache-httpclient"), ("Java", "java"), ("Axios", "axios"), ("node-fetch", "node-fetch"), ("Postman", "postmanruntime"), ("libwww-perl", "libwww-perl"), ("HTTPie", "httpie"),
    ("Lynx", "lynx"), ("Dalvik", "dalvik"), ("CFNetwork", "cfnetwork"),
]
#: Words that name a system, in the order of precedence, and what they say of the device.
SYSTEMS = [
    ("Windows Phone", "iemobile", "mobile"), ("iOS", "iphone ipod", "mobile"), ("iOS", "ipad", "tablet"), ("HarmonyOS", "harmonyos openharmony", ""), ("Tizen", "tizen", ""), ("KaiOS", "kaios", "mobile"), ("Android", "android", "android"),
    ("ChromeOS", "cros", "desktop"), ("Windows", "windows win64 win32", "desktop"), ("macOS", "macintosh darwin", "desktop"), ("FreeBSD", "freebsd", "desktop"), ("OpenBSD", "openbsd", "desktop"), ("Linux", "linux ubuntu fedora", ""), ("Linux", "x11", "desktop"),
]
#: Words that only say what the device is.
DEVICES = [("mobile", "mobile mobi phone mini"), ("tablet", "tablet kindle playbook"), ("tv", "smart-tv smarttv appletv googletv hbbtv crkey bravia")]
#: Words behind which a number is the version of that system.
BEHIND = {"nt": "Windows", "android": "Android", "os": "iOS", "x": "macOS", "x86_64": "ChromeOS", "aarch64": "ChromeOS", "tizen": "Tizen", "phone": "Windows Phone", "harmonyos": "HarmonyOS"}
#: Windows by the version of its kernel.
WINDOWS = {"10.0": "10", "6.3": "8.1", "6.2": "8", "6.1": "7", "6.0": "Vista", "5.2": "XP", "5.1": "XP", "5.0": "2000"}

TOKEN = r"rv:[\d.]+|[A-Za-z][\w.!+-]*(?:/\d[\w.+-]*)?|\d[\w.]*"
BOT, NONE = -1, 999
_BITS = {"mobile": 1, "tablet": 2, "desktop": 4, "android": 8, "tv": 16, "": 0}


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _table(rows: list[tuple[str, str]]) -> Column:
    """A literal map from words to SQL values."""
    return F.expr(f"map({', '.join(f'{_text(word)}, {value}' for words, value in rows for word in words.split())})")


def parsed(agent: Column) -> Column:
    """(browser, version, os, os_version, device) of a user agent, device being Mobile, Tablet, Desktop, TV, Bot, Other, or '' for an empty one."""
    families = _table([(words, f"named_struct('rank', {k}, 'name', {_text(name)})") for k, (name, words) in enumerate(FAMILIES)])
    systems = _table([(words, f"named_struct('rank', {k}, 'name', {_text(name)}, 'bits', {_BITS[kind]})") for k, (name, words, kind) in enumerate(SYSTEMS)])
    devices = _table([(words, str(_BITS[kind])) for kind, words in DEVICES])
    behind = _table([(word, _text(name)) for word, name in BEHIND.items()])
    none = "named_struct('rank', 999, 'name', '', 'version', '', 'said', '', 'rv', '', 'os_rank', 999, 'os', '', 'os_version', '', 'bits', 0, 'before', '')"

    def step(acc: Column, token: Column) -> Column:
        low = F.lower(token)
        word = F.substring_index(low, "/", 1)
        version = F.when(token.contains("/"), F.substring_index(token, "/", -1)).otherwise("")
        bot = word.rlike(".(bot|crawler|spider)$")
        family = F.try_element_at(families, word)
        system = F.try_element_at(systems, F.when((word == "phone") & (acc["before"] == "windows"), "iemobile").otherwise(word))
        rank = F.when(bot, BOT).otherwise(F.coalesce(family["rank"], F.lit(NONE)))
        better = rank < acc["rank"]
        os_rank = F.coalesce(system["rank"], F.lit(NONE))
        os_better = os_rank < acc["os_rank"]
        number = token.rlike(r"^\d")
        its = number & (acc["os"] == F.coalesce(F.try_element_at(behind, acc["before"]), F.lit("?"))) & (acc["os_version"] == "")
        ie = number & (acc["before"] == "msie") & (acc["name"] == "Internet Explorer")
        return F.struct(
            F.when(better, rank).otherwise(acc["rank"]).alias("rank"), F.when(better, F.when(bot, F.substring_index(token, "/", 1)).otherwise(family["name"])).otherwise(acc["name"]).alias("name"),
            F.when(better | ((rank == acc["rank"]) & (acc["version"] == "") & (rank < NONE)), version).when(ie, token).otherwise(acc["version"]).alias("version"), F.when(word == "version", version).otherwise(acc["said"]).alias("said"),
            F.when(low.startswith("rv:"), F.substring(low, 4, 100)).otherwise(acc["rv"]).alias("rv"),
            F.when(os_better, os_rank).otherwise(acc["os_rank"]).alias("os_rank"), F.when(os_better, system["name"]).otherwise(acc["os"]).alias("os"),
            F.when(os_better, "").when(its, token).otherwise(acc["os_version"]).alias("os_version"),
            acc["bits"].bitwiseOR(F.coalesce(system["bits"], F.lit(0))).bitwiseOR(F.coalesce(F.try_element_at(devices, word), F.lit(0))).alias("bits"), word.alias("before"),
        )

    def told(acc: Column) -> Column:
        has = lambda kind: acc["bits"].bitwiseAND(_BITS[kind]) != 0
        stock = (acc["name"] == "Safari") & (acc["os"] == "Android")
        name = F.when(stock, "Android Browser").otherwise(acc["name"])
        said = (acc["said"] != "") & (name.isin("Safari", "Opera", "Android Browser"))
        version = F.when(said, acc["said"]).when((name == "Internet Explorer") & acc["version"].isin("7.0", "") & (acc["rv"] != ""), acc["rv"]).otherwise(acc["version"])
        windows = F.try_element_at(_table([(k, _text(v)) for k, v in WINDOWS.items()]), acc["os_version"])
        os_version = F.when(acc["os"] == "Windows", F.coalesce(windows, acc["os_version"])).otherwise(F.translate(acc["os_version"], "_", "."))
        tablet = (has("tablet") & (acc["os"] != "Windows")) | (has("android") & ~has("mobile") & ~has("tv"))
        kind = F.when(has("tv"), "TV").when(tablet, "Tablet").when(has("mobile"), "Mobile").when(has("desktop"), "Desktop").when(acc["rank"] == BOT, "Bot").otherwise("Other")
        return F.struct(name.alias("browser"), version.alias("version"), acc["os"].alias("os"), os_version.alias("os_version"), kind.alias("device"))

    found = F.aggregate(F.regexp_extract_all(agent, F.lit(TOKEN), F.lit(0)), F.expr(none), step, told)
    return F.when(agent == "", F.struct(*[F.lit("").alias(c) for c in ("browser", "version", "os", "os_version", "device")])).otherwise(found)
