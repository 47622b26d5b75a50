"""The six rules that tag addresses, each a plan from pools to (ip, tag, reason), in the order of their priority.

`claimed` are addresses that the rule has tagged before: their rows count although the tag has made them bots. It is a
small table of ips, joined rather than listed, so it may grow.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirlog.functions import labels, lists


#: Nanoseconds of the parts in which gaps of an address are found.
PERIOD = 300_000_000_000


class Rule(Protocol):
    name: str

    def run(self, rows: DataFrame, claimed: DataFrame | None = None) -> DataFrame: ...


class Found:
    """found() gives (ip, tag, reason, by); run() leaves `by` out, listed() puts the candidates in its order, then by address."""

    def run(self, rows: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
        return self.found(rows, claimed).drop("by")

    def listed(self, rows: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
        return self.found(rows, claimed).orderBy("by", "ip").drop("by")


def eligible(rows: DataFrame, claimed: DataFrame | None) -> DataFrame:
    """Rows with `own`, whether their address is claimed; real traffic and claimed addresses' only."""
    if claimed is None:
        return rows.withColumn("own", F.lit(False))
    known = claimed.select(F.col("ip").alias("_ip"), F.lit(True).alias("own")).distinct()
    return rows.join(known, F.col("ip") == F.col("_ip"), "left").drop("_ip").withColumn("own", F.coalesce("own", F.lit(False)))


def real(own: Column) -> Column:
    return (F.col("is_local") == 0) & ((F.col("is_bot") == 0) | own)


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _bots(found: DataFrame, reason: Column, *by: Column) -> DataFrame:
    return found.select("ip", F.lit("bot").alias("tag"), reason.alias("reason"), F.struct(*by).alias("by"))


@dataclass
class ProbeOnly(Found):
    """An address that fetched nothing but probes; a request counts once, whichever patterns it matches."""

    probes: list[tuple[str, str]] = field(default_factory=lambda: list(lists.PROBES))
    name: str = "probe-only-uri"

    def found(self, rows: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
        rows = eligible(rows, claimed)
        counts = F.when(F.col("pool") == "malicious", F.col("own")).otherwise(real(F.col("own")))
        severe = labels.any_of([F.col("uri").rlike(labels.glob_regex(u, cross=False)) if labels.is_glob(u) else F.col("uri") == u for u, tag in self.probes if tag == "malicious"])
        rows = rows.where(counts).withColumn("probe", labels.matches_probe(F.col("uri"), self.probes))
        # An address that fetched anything else is out; URIs of the others are distinct probes, as many as patterns match.
        found = rows.groupBy("ip", "uri").agg(F.count("*").alias("n"), F.first("probe").alias("probe"), F.first(severe).alias("severe"))
        out = found.groupBy("ip").agg(F.bool_and("probe").alias("all")).where("all").select("ip")
        found = found.join(out, "ip", "left_semi").groupBy("ip").agg(F.sum("n").alias("n"), F.max(F.col("severe").cast("int")).alias("severe"), F.sort_array(F.collect_set("uri")).alias("uris"))
        return found.select("ip", F.when(F.col("severe") == 1, "malicious").otherwise("bot").alias("tag"), _text(F.col("n"), " probe hit(s): ", F.array_join("uris", ", ")).alias("reason"), F.struct(-F.col("n")).alias("by"))


def _without_static(found: DataFrame, rows: DataFrame, ignored: list[str]) -> DataFrame:
    other = rows.where((F.col("pool") == "static") & (F.col("is_local") == 0) & ~F.col("uri").isin(ignored or [""]))
    return found.join(other.select("ip"), "ip", "left_anti")


@dataclass
class RootOnly(Found):
    daily: int = 4
    days: int = 2
    ignored: list[str] = field(default_factory=lambda: list(lists.IGNORED_STATIC))
    name: str = "root-only-burst"

    def found(self, rows: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
        rows = eligible(rows, claimed)
        dynamic = rows.where(F.col("pool") == "dynamic")
        by_day = dynamic.where((F.col("uri") == "/") & real(F.col("own"))).groupBy("ip", labels.day(F.col("ts")).alias("day")).agg(F.count("*").alias("hits"))
        found = by_day.groupBy("ip").agg(F.sum("hits").alias("total"), F.count("*").alias("days"), F.max("hits").alias("most")).where((F.col("most") >= self.daily) | (F.col("days") >= self.days))
        found = found.join(dynamic.where((F.col("is_local") == 0) & (F.col("uri") != "/")).select("ip"), "ip", "left_anti")
        found = _without_static(found, rows, self.ignored)
        reason = F.when(F.col("days") >= 2, _text(F.col("total"), " / hit(s) across ", F.col("days"), " UTC day(s); no static")).otherwise(_text(F.col("most"), " / hit(s) in a single UTC day; no static"))
        return _bots(found, reason, -F.col("days"), -F.col("most"))


@dataclass
class Cadence(Found):
    intervals: int = 7
    mean: float = 60.0
    variation: float = 0.25
    name: str = "cadence-polling"

    def found(self, rows: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
        own = eligible(rows, claimed).where((F.col("pool") == "dynamic") & real(F.col("own")))
        # Gaps within five minutes of an address, then those between: an address of many rows is many small groups.
        own = own.select("ip", "ts", labels.bucket(F.col("ts"), PERIOD).alias("period"))
        gap = lambda to, since: (to - since) / F.lit(1e9)
        within = own.withColumn("gap", gap(F.col("ts"), F.lag("ts").over(Window.partitionBy("ip", "period").orderBy("ts"))))
        square = lambda c: F.coalesce(F.sum(F.col(c) * F.col(c)), F.lit(0.0))
        parts = within.groupBy("ip", "period").agg(F.count("*").alias("hits"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("gap").alias("n"), F.coalesce(F.sum("gap"), F.lit(0.0)).alias("sum"), square("gap").alias("square"))
        parts = parts.withColumn("gap", gap(F.col("first"), F.lag("last").over(Window.partitionBy("ip").orderBy("period"))))
        found = parts.groupBy("ip").agg(F.sum("hits").alias("hits"), (F.sum("n") + F.count("gap")).alias("n"), (F.sum("sum") + F.coalesce(F.sum("gap"), F.lit(0.0))).alias("sum"), (F.sum("square") + square("gap")).alias("square"))
        found = found.where("n > 0").withColumns({"mean": F.col("sum") / F.col("n"), "square": F.col("square") / F.col("n")})
        found = found.withColumn("variance", F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean")))
        steady = F.col("variance") < F.lit(self.variation * self.variation) * F.col("mean") * F.col("mean")
        found = found.where((F.col("n") >= self.intervals) & (F.col("mean") >= self.mean) & steady)
        percent = F.bround(F.sqrt("variance") / F.col("mean") * 100, 0).cast("long")
        return _bots(found, _text(F.col("hits"), " hits, mean interval ", labels.human_duration(F.col("mean")), ", CV ", percent, "%"), F.col("variance") / (F.col("mean") * F.col("mean")))


def _all_of(rows: DataFrame, claimed: DataFrame | None, column: str, value: str, least: int) -> DataFrame:
    own = eligible(rows, claimed).where(F.col("pool").isin("dynamic", "static") & real(F.col("own")))
    return own.groupBy("ip").agg(F.count("*").alias("hits"), F.bool_and(F.col(column) == value).alias("all")).where(F.col("all") & (F.col("hits") >= least))


@dataclass
class HeadOnly(Found):
    least: int = 4
    name: str = "head-only"

    def found(self, rows: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
        return _bots(_all_of(rows, claimed, "method", "HEAD", self.least), _text(F.col("hits"), " HEAD requests; no other methods"), -F.col("hits"))


@dataclass
class Http10Only(Found):
    least: int = 4
    name: str = "http10-only"

    def found(self, rows: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
        return _bots(_all_of(rows, claimed, "proto", "HTTP/1.0", self.least), _text(F.col("hits"), " requests, all HTTP/1.0"), -F.col("hits"))


@dataclass
class NoStatic(Found):
    least: int = 6
    ignored: list[str] = field(default_factory=lambda: list(lists.IGNORED_STATIC))
    name: str = "no-static-ever"

    def found(self, rows: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
        rows = eligible(rows, claimed)
        found = rows.where((F.col("pool") == "dynamic") & real(F.col("own"))).groupBy("ip").agg(F.count("*").alias("hits")).where(F.col("hits") >= self.least)
        return _bots(_without_static(found, rows, self.ignored), _text(F.col("hits"), " dynamic hit(s); no static"), -F.col("hits"))


def default_rules() -> list[Rule]:
    return [ProbeOnly(), RootOnly(), Cadence(), HeadOnly(), Http10Only(), NoStatic()]


def difference(candidates: DataFrame, tags: DataFrame, rule: str) -> DataFrame:
    """(ip, tag, reason, action) of a run against tags(ip, tag, source): added, refreshed, reverted to real, or skipped.

    A tag of another source is never taken over; an address that the rule had tagged and no longer finds becomes real.
    """
    now = tags.select(F.col("ip").alias("_ip"), F.col("tag").alias("_tag"), "source")
    both = candidates.join(now, F.col("ip") == F.col("_ip"), "full_outer")
    mine = F.col("source") == rule
    action = F.when(F.col("ip").isNull(), F.when(mine, "removed")).when(F.col("_ip").isNull(), "added").when(mine, "kept").otherwise("skipped")
    out = both.select(F.coalesce("ip", "_ip").alias("ip"), F.when(F.col("ip").isNull(), "real").otherwise(F.col("tag")).alias("tag"), F.coalesce("reason", F.lit("")).alias("reason"), action.alias("action"))
    return out.where("action is not null")
