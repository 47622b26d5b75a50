"""The closed family of queries: filters, dimensions, query kinds, tags, and the stored row."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T

POOLS = ("dynamic", "static", "malicious")
TAGS = ("real", "local", "bot", "malicious")

#: Dimension name to column; the allow-list of what can be grouped and filtered by.
DIMENSIONS = {
    "ip": "ip", "uri": "uri", "host": "host", "method": "method", "status": "status", "status_class": "status_class", "proto": "proto",
    "user_agent": "user_agent", "referer": "referer", "country": "country", "city": "city", "browser": "browser", "os": "os", "device": "device",
    "is_bot": "is_bot", "is_local": "is_local", "malicious_reason": "malicious_reason",
}
BOOLEANS, NUMBERS = {"is_bot", "is_local"}, {"status"}

#: The stored row: strings and numbers are never null; seq is the order of arrival.
ROW = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("ts", T.LongType()), T.StructField("status", T.IntegerType()), T.StructField("status_class", T.StringType()),
    *[T.StructField(c, T.StringType()) for c in ("method", "host", "uri", "ip", "proto", "user_agent", "referer", "country", "city", "browser", "os", "device")],
    T.StructField("duration_ns", T.LongType()), T.StructField("size", T.LongType()), T.StructField("bytes_read", T.LongType()),
    *[T.StructField(c, T.IntegerType()) for c in ("is_bot", "is_local", "is_static")], T.StructField("malicious_reason", T.StringType()), T.StructField("visitor_hash", T.LongType()),
])


class Kind(str, Enum):
    OVERVIEW, STATUS_CLASS, TOPN, TIMELINE, ROWS = "overview", "status_class", "topn", "timeline", "rows"


def column_of(dimension: str) -> str:
    if dimension not in DIMENSIONS:
        raise ValueError(f"unknown dimension {dimension!r}")
    return DIMENSIONS[dimension]


@dataclass(frozen=True)
class Filter:
    """Values of one dimension are alternatives, dimensions are conjoined; time is half open, in ns, None is unset."""

    include: dict[str, list[str]] = field(default_factory=dict)
    exclude: dict[str, list[str]] = field(default_factory=dict)
    contains: dict[str, list[str]] = field(default_factory=dict)
    time_from: int | None = None
    time_to: int | None = None

    def merge(self, extra: Filter, strict: bool = False) -> Filter:
        """Lists are joined per dimension, so an include grows; strict keeps only what both include. Times intersect."""

        def joined(a: dict[str, list[str]], b: dict[str, list[str]], both: bool) -> dict[str, list[str]]:
            out = {k: list(v) for k, v in a.items()}
            for k, v in b.items():
                if both and out.get(k) and v:
                    out[k] = [x for x in out[k] if x in v] or ["\0"]
                else:
                    out[k] = out.get(k, []) + [x for x in v if x not in out.get(k, [])]
            return out

        least = [t for t in (self.time_from, extra.time_from) if t is not None]
        most = [t for t in (self.time_to, extra.time_to) if t is not None]
        return Filter(joined(self.include, extra.include, strict), joined(self.exclude, extra.exclude, False), joined(self.contains, extra.contains, False), max(least, default=None), min(most, default=None))

    def with_defaults(self, pool: str) -> Filter:
        """Hides bots and local traffic unless the filter already speaks of them; the malicious pool shows all."""
        if pool == "malicious":
            return self
        exclude = {k: list(v) for k, v in self.exclude.items()}
        for d in ("is_bot", "is_local"):
            if not exclude.get(d) and not any(truth(v) for v in self.include.get(d, [])):
                exclude[d] = ["true"]
        return Filter(self.include, exclude, self.contains, self.time_from, self.time_to)

    def to_query(self) -> str:
        """The part of a link behind '#': inc., exc. and con. by dimension, from and to."""
        from urllib.parse import urlencode

        pairs = [(f"{p}.{d}", v) for p, of in (("inc", self.include), ("exc", self.exclude), ("con", self.contains)) for d, vs in of.items() for v in vs]
        return urlencode(pairs + [(n, t) for n, t in (("from", self.time_from), ("to", self.time_to)) if t is not None])

    @staticmethod
    def from_query(text: str) -> Filter:
        from urllib.parse import parse_qsl

        parts: dict[str, dict[str, list[str]]] = {"inc": {}, "exc": {}, "con": {}}
        times: dict[str, int] = {}
        for name, value in parse_qsl(text.lstrip("#"), keep_blank_values=True):
            kind, _, dimension = name.partition(".")
            if kind in parts and dimension in DIMENSIONS:
                parts[kind].setdefault(dimension, []).append(value)
            elif name in ("from", "to"):
                times[name] = int(value)
        return Filter(parts["inc"], parts["exc"], parts["con"], times.get("from"), times.get("to"))


def truth(value: str) -> bool:
    return value in ("true", "1")


@dataclass(frozen=True)
class Query:
    """One query of the family over one pool."""

    pool: str = "dynamic"
    kind: Kind = Kind.OVERVIEW
    filter: Filter = field(default_factory=Filter)
    group_by: str = "uri"
    limit: int = 0
    offset: int = 0
    bucket: int = 0
    order_by: str = ""


def view(name: str) -> tuple[str, Filter]:
    """Pool and extra filter of a view; local traffic and bots are views of the dynamic pool."""
    views = {
        "dynamic": ("dynamic", Filter()), "static": ("static", Filter()), "malicious": ("malicious", Filter()),
        "local": ("dynamic", Filter(include={"is_local": ["true"]})), "bots": ("dynamic", Filter(include={"is_bot": ["true"]})),
    }
    if name not in views:
        raise ValueError(f"unknown view {name!r}")
    return views[name]
