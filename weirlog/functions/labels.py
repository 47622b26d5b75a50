"""Labels of a request as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weirlog.functions import addresses, lists

DAY_NS = 86_400_000_000_000


def java(pattern: str) -> str:
    """Escapes what a regular expression gives a meaning to."""
    return re.sub(r"([^\w\s/-])", r"\\\1", pattern)


def any_word(words: list[str]) -> str:
    """A regular expression that finds any of the words, common beginnings shared: a text's place tries a few letters, not all words."""
    root: dict = {}
    for word in filter(None, words):
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def text(node: dict) -> str:
        if "" in node:  # what is longer has this one in it
            return ""
        parts = [java(c) + text(below) for c, below in sorted(node.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return text(root)


def status_class(status: Column) -> Column:
    return F.when(status >= 500, "5xx").when(status >= 400, "4xx").when(status >= 300, "3xx").when(status >= 200, "2xx").when(status >= 100, "1xx").otherwise("other")


def visitor_hash(ip: Column, agent: Column, ts: Column) -> Column:
    """Only the count of distinct values is observed: a visitor is an address and a user agent on a UTC day."""
    return F.xxhash64(ip, agent, day(ts))


def bucket(ts: Column, width: int) -> Column:
    """Start of the bucket of an integer time, cut towards zero."""
    return ts - ts % F.lit(width)


def day(ts: Column) -> Column:
    return (bucket(ts, DAY_NS) / F.lit(DAY_NS)).cast("long")


def is_static(uri: Column) -> Column:
    """By the extension of the last part of the path; a trailing slash doesn't count, a name that begins with its dot has none."""
    path = F.regexp_replace(F.regexp_replace(uri, r"[?#].*", ""), r"/+$", "")
    return F.coalesce(path.rlike(rf"(?i)[^/]\.({'|'.join(lists.STATIC_EXTENSIONS)})$"), F.lit(False))


def is_bot(agent: Column, patterns: list[str] | None = None, generic: bool = True) -> Column:
    """No user agent is a bot's; else any pattern, and any word by which bots name themselves."""
    words = (lists.bot_patterns() if patterns is None else patterns) + (lists.BOT_TOKENS if generic else [])
    found = F.lower(agent).rlike(any_word(words)) if words else F.lit(False)
    return (F.coalesce(agent, F.lit("")) == "") | found


def is_local_v4(ip: Column) -> Column:
    """Dotted addresses of private, carrier, loopback, link-local and this-host networks."""
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    valid = ip.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$")
    a, b = (F.try_to_number(F.split_part(ip, F.lit("."), F.lit(i)), F.lit("999")).cast("int") for i in (1, 2))
    inside = a.isin(10, 127, 0) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254))
    return F.when(valid, inside).otherwise(False)


def is_local(ip: Column, v6: bool = True, own: list[str] | None = None) -> Column:
    """v6=False leaves the longer expression out where all addresses are dotted; what begins with a text of own is local besides."""
    dotted = is_local_v4(ip)
    found = F.when(ip.contains(":"), addresses.local_v6(ip)).otherwise(dotted) if v6 else dotted
    return any_of([found, *[F.coalesce(ip.startswith(x), F.lit(False)) for x in own or []]])


def attack_reason(uri: Column, rules: lists.AttackRules | None = None) -> Column:
    """The first substring of the list that the lower-cased URI has, else the first expression that finds something; or null.

    One expression over all substrings passes most URIs by; only for the others is the list, a literal, gone through.
    """
    rules = rules or lists.attack_rules()
    low = F.lower(uri)
    found = [F.when(uri.rlike(p), F.lit(f"attack_uri:{reason}")) for reason, p in rules.regexes]
    if rules.substrings:
        text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
        listed = F.expr(f"array({', '.join(f'named_struct({text("p")}, {text(p)}, {text("r")}, {text("attack_uri:" + r)})' for r, p in rules.substrings)})")
        first = F.get(F.filter(listed, lambda x: low.contains(x["p"])), F.lit(0))["r"]
        found = [F.when(low.rlike(any_word([p for _, p in rules.substrings])), first), *found]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def glob_regex(pattern: str, cross: bool = True) -> str:
    """A glob as a regular expression over the whole value; cross: whether * and ? pass over a slash."""
    out, i, anything = [], 0, "." if cross else "[^/]"
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(f"{anything}*")
        elif c == "?":
            out.append(anything)
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out.append("[" + ("^" if body[0] in "^!" else "") + (body[1:] if body[0] in "^!" else body).replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]")
            i = end
        else:
            out.append(java(c))
        i += 1
    return f"(?s)^{''.join(out)}$"


def is_glob(pattern: str) -> bool:
    return any(c in pattern for c in "*?[")


def matches_probe(uri: Column, probes: list[tuple[str, str]]) -> Column:
    exact = [u for u, _ in probes if not is_glob(u)]
    tests = ([uri.isin(exact)] if exact else []) + [uri.rlike(glob_regex(u)) for u, _ in probes if is_glob(u)]
    return any_of(tests)


def like_pattern(value: str) -> str:
    """A value for LIKE, in which nothing has a meaning of its own."""
    return "%" + value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def json_values(text: Column) -> Column:
    """The strings of a JSON array, an array of no strings for null and for what isn't one; explode() makes rows of it."""
    found = F.from_json(text, "array<string>")
    return F.coalesce(F.filter(found, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def seconds_to_ns(seconds: Column) -> Column:
    """Whole seconds and fraction apart, the fraction cut off below a nanosecond."""
    whole = seconds.cast("long")
    return whole * F.lit(1_000_000_000) + ((seconds - whole) * 1e9).cast("long")


def human_duration(seconds: Column) -> Column:
    def text(unit: float, sign: str) -> Column:
        return F.concat(F.bround(seconds / unit, 0).cast("long").cast("string"), F.lit(sign))

    return F.when(seconds < 90, text(1, "s")).when(seconds < 5400, text(60, "m")).when(seconds < 129_600, text(3600, "h")).otherwise(text(86_400, "d"))


def human_bytes(n: int, base: int = 1024) -> str:
    value, units = float(n), ["B", "KB", "MB", "GB", "TB", "PB"]
    while value >= base and len(units) > 1:
        value, units = value / base, units[1:]
    return f"{int(value)} {units[0]}" if units[0] == "B" else f"{value:.1f} {units[0]}"
