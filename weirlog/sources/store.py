"""The store: labelled rows as Parquet by pool and day, found again by a key of the input files, and rows that come later."""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog.model import Query
from weirlog.operators import pools
from weirlog.plans import rules as rule_plans
from weirlog.plans.execute import execute
from weirlog.progress import Progress, watched
from weirlog.sources import json_log
from weirlog.sources.files import Files, has_scheme, shared_dir
from weirlog.sources.manifest import Manifest
from weirlog.sources.tags import TagSet


def cache_key(paths: list[str], spark: SparkSession | None = None) -> str:
    """Of absolute paths, sizes and times of change; paths with a scheme are asked of Spark's file system."""
    there = Files(spark or SparkSession.builder.getOrCreate()) if any(map(has_scheme, paths)) else None
    facts = sorted(there.facts(p)[0] if has_scheme(p) else (os.path.abspath(p), os.stat(p).st_size, os.stat(p).st_mtime_ns) for p in paths)
    return hashlib.sha256("".join(f"{p}\0{s}\0{t}\n" for p, s, t in facts).encode()).hexdigest()[:24]


def clear(root: str, paths: list[str] | None = None, everything: bool = False) -> list[str]:
    """Removes the cache of some inputs or all; asking for both is an error, for neither does nothing."""
    if paths and everything:
        raise ValueError("give paths or everything, not both")
    if has_scheme(root):
        there = Files(SparkSession.builder.getOrCreate())
        names = there.names(root) if everything else [cache_key(json_log.expand(paths))] if paths else []
        gone = [n for n in names if there.exists(f"{root}/{n}")]
        for n in gone:
            there.remove(f"{root}/{n}")
        return gone
    names = os.listdir(root) if everything and os.path.isdir(root) else [cache_key(json_log.expand(paths))] if paths else []
    gone = [n for n in names if os.path.isdir(os.path.join(root, n))]
    for n in gone:
        shutil.rmtree(os.path.join(root, n))
    return gone


#: Runs of the summary by address that are read together before they are merged into one, and manifests that stay.
RUNS, KEPT = 8, 2
#: Seconds that a table nobody names stays at least.
OLD = 86_400.0
#: Verdicts up to which they are broadcast.
BROADCAST = 500_000
#: Tags up to which the tagged addresses are listed in the scan's filter.
LISTED = 1000
_ROW = (
    "seq long, ts long, status int, method string, host string, uri string, ip string, proto string, user_agent string, referer string, duration_ns long, size long, bytes_read long, status_class string, "
    "browser string, os string, device string, is_bot int, is_local int, is_static int, attack string, visitor_hash long, country string, city string, malicious_reason string, v string, pool string, day date"
)
_NEWS = "ip string, first_seq long, uri_reason string, reason string, changed boolean"
_SUMMARY = "ip string, first struct<seq: long, attack: string>, hits long, errors long, n long"


def with_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("day", F.timestamp_seconds(F.floor(F.col("ts") / 1_000_000_000)).cast("date"))


class LogStore:
    """Logs, tags and rules behind one object; rows() is always the log plus the tags as they are now.

    Rows lie in a base by pool and day with their pools, and a summary by address beside them. Rows that come later are
    appended as deltas, labelled but without pools, with a summary of their own. rows() judges deltas by the merged figures of
    their addresses, and judges again the base's rows of addresses on which the verdict has changed; so it equals one load of
    everything. compact() brings deltas into the base, writing the pools and days that change anew. A manifest says what
    counts (see manifest.py); a write that is killed changes nothing.

    In a cache it is found again by its name, or else by what its files are like; one that follows files as they grow needs a
    name. Without a cache the store lies in the shared folder until close().
    """

    def __init__(self, spark: SparkSession, patterns: list[str], cache: str | None = None, tags: TagSet | None = None, progress: Callable[[str, int, int], None] | None = None, name: str | None = None, **labels):
        self.spark, self.tags, self.files, self.labels = spark, tags or TagSet(), Files(spark), labels
        self.paths = json_log.expand(patterns, spark)
        self.progress = Progress(progress) if progress else lambda *_: None
        self.passing = cache is None
        self.root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}" if cache is None else f"{cache.rstrip('/')}/{name or cache_key(self.paths, spark)}"
        self.manifest = Manifest(self.files, self.root)
        self.from_cache = self.manifest.latest() is not None
        if not self.from_cache:
            with watched(spark, self.progress, "load"):
                self._load(json_log.lines(spark, self.paths) if self.paths else None)

    def _load(self, raw: DataFrame | None) -> None:
        """Lines are parsed and labelled once and written; summary, numbers and pools come from reading that table's columns."""
        version, staged = uuid.uuid4().hex, f"{self.root}/staged-{uuid.uuid4().hex}"
        empty = {"paths": self.paths, "complete": True, "next": 0, "rows": {}, "addresses": [], "delta": [], "news": None, "streams": {}}
        if raw is None:
            self.manifest.begin(empty)
            return
        pools.label(json_log.parsed(raw, [*json_log.PLACE, "_line"]), **self.labels).write.parquet(staged)
        found = self.spark.read.parquet(staged)
        rows = json_log.numbered(found, found.select(*json_log.PLACE, "_line"))
        pools.summary(rows).write.option("parquet.bloom.filter.enabled#ip", "true").parquet(f"{self.root}/addresses/{version}")
        # What is flagged is a small part of the addresses; Spark sees how small once it has read it.
        self._put(pools.judged(rows, pools.verdicts(self._summary([version]))), version)
        last = rows.agg(F.max("seq")).first()[0]
        began = self.manifest.begin(empty | {"next": 0 if last is None else last + 1, "rows": self._parts(version), "addresses": [version]})
        for gone in [staged] if began else [staged, f"{self.root}/rows/v={version}", f"{self.root}/addresses/{version}"]:
            self.files.remove(gone)  # another loader may have been faster

    def _put(self, judged: DataFrame, version: str) -> None:
        """Writes rows by pool and day; Spark deals a large day's rows to several tasks and small ones' to one, by what the shuffle shows."""
        rows = (judged if "day" in judged.columns else with_day(judged)).hint("rebalance", "pool", "day").sortWithinPartitions("pool", "day", "ts")
        rows.write.option("parquet.bloom.filter.enabled#ip", "true").partitionBy("pool", "day").parquet(f"{self.root}/rows/v={version}")

    def _parts(self, version: str) -> dict[str, str]:
        at = f"{self.root}/rows/v={version}"
        return {f"{p}/{d}": version for p in self.files.names(at) if "=" in p for d in self.files.names(f"{at}/{p}") if "=" in d}

    def _summary(self, runs: list[str]) -> DataFrame:
        found = self.spark.read.schema(_SUMMARY).parquet(*[f"{self.root}/addresses/{r}" for r in runs]) if runs else self.spark.createDataFrame([], _SUMMARY)
        return found if len(runs) == 1 else pools.merged(found)

    def _base(self, now: dict) -> DataFrame:
        """The base's rows; a query's filters on pool and day choose among its folders."""
        folders = [f"{self.root}/rows/v={v}/{part}" for part, v in now["rows"].items()]
        if not folders:
            return self.spark.createDataFrame([], _ROW).drop("v")
        return self.spark.read.schema(_ROW).option("basePath", f"{self.root}/rows").parquet(*folders).drop("v")

    def _news(self, now: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Deltas' rows with seq, verdicts on their addresses, and the verdicts (some null) on addresses of the base that have changed.

        Few verdicts are broadcast, so rows of the base aren't shuffled for them.
        """
        shift = F.element_at(F.create_map(*[x for d in now["delta"] for x in (F.lit(d["id"]), F.lit(d["shift"]).cast("long"))]), F.col("id"))
        folders = [f"{self.root}/delta/id={d['id']}" for d in now["delta"]]
        schema = _ROW.replace("malicious_reason string, v string, pool string, day date", "day date, id string")
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/delta").parquet(*folders).withColumn("seq", F.col("seq") + shift).drop("id")
        table = self.spark.read.schema(_NEWS).parquet(f"{self.root}/verdicts/{now['news']['id']}")
        side = F.broadcast if now["news"]["rows"] <= BROADCAST else lambda df: df
        return rows, side(table.where("reason is not null").drop("changed")), side(table.where("changed").drop("changed"))

    def _verdicts(self, now: dict) -> dict:
        """Writes the verdicts on the deltas' addresses once for all queries: those flagged, and those whose verdict in the base has changed."""
        fresh = self._summary([d["summary"] for d in now["delta"]])
        known = self._summary(now["addresses"]).join(fresh.select(F.col("ip").alias("_ip")), F.col("ip") == F.col("_ip"), "left_semi")
        found = pools.verdicts(pools.merged(known.unionByName(fresh)))
        was = pools.verdicts(known).select("ip", F.struct("first_seq", "uri_reason", "reason").alias("_was"))
        there = known.select("ip", F.lit(True).alias("_there"))
        both = there.join(was, "ip", "left").join(found, "ip", "full_outer")
        same = F.coalesce(F.struct("first_seq", "uri_reason", "reason").eqNullSafe(F.col("_was")), F.lit(False)) | (F.col("reason").isNull() & F.col("_was").isNull())
        news = both.select("ip", "first_seq", "uri_reason", "reason", (F.coalesce("_there", F.lit(False)) & ~same).alias("changed")).where("reason is not null or changed")
        name = uuid.uuid4().hex
        news.write.parquet(f"{self.root}/verdicts/{name}")
        return {"id": name, "rows": self.spark.read.schema(_NEWS).parquet(f"{self.root}/verdicts/{name}").count()}

    def _untagged(self, now: dict) -> DataFrame:
        base = self._base(now)
        if not now["delta"]:
            return base
        rows, found, changed = self._news(now)
        columns = base.columns
        moved = base.join(changed.select(F.col("ip").alias("_ip")), F.col("ip") == F.col("_ip"), "left_semi").drop("pool", "malicious_reason")
        rest = base.join(changed.select(F.col("ip").alias("_ip")), F.col("ip") == F.col("_ip"), "left_anti")
        return rest.unionByName(pools.judged(moved, changed).select(columns)).unionByName(pools.judged(rows, found).select(columns))

    def rows(self) -> DataFrame:
        return pools.override(self._untagged(self.manifest.latest()[1]), self.tags.history_frame(self.spark), self.tags.addresses() if len(self.tags.addresses()) <= LISTED else None)

    @property
    def stored(self) -> DataFrame:
        """The base as it lies, without deltas and tags."""
        return self._base(self.manifest.latest()[1])

    def flags(self) -> DataFrame:
        """(ip, reason) of all flagged addresses, by the summaries alone."""
        now = self.manifest.latest()[1]
        found = self._summary([*now["addresses"], *[d["summary"] for d in now["delta"]]])
        return pools.verdicts(found).select("ip", "reason")

    def query(self, query: Query, now: int | None = None) -> DataFrame:
        return execute(self.rows(), query, now)

    def ingest(self, events: DataFrame, stream: str = "", batch: int = 0) -> bool:
        """Appends normalised events, or rows that are labelled already, behind all that is there, in the order of their seq, whatever it counts from.

        A batch of a stream that is counted in already is passed over (and False returned), so a stream may repeat it.
        """
        done = lambda now: bool(stream) and now["streams"].get(stream, -1) >= batch
        if done(self.manifest.latest()[1]):
            return False
        name = uuid.uuid4().hex
        labelled = with_day(events if "visitor_hash" in events.columns else pools.label(events, **self.labels)).select(*[c.split(" ")[0] for c in _ROW.split(", ") if c.split(" ")[0] not in ("malicious_reason", "v", "pool")])
        labelled.write.parquet(f"{self.root}/delta/id={name}")
        rows = self.spark.read.parquet(f"{self.root}/delta/id={name}")
        least, last = rows.agg(F.min("seq"), F.max("seq")).first()
        made: dict[int, str] = {}

        def counted(now: dict) -> dict | None:
            if done(now):
                return None
            if least is None:
                return now | {"streams": now["streams"] | ({stream: batch} if stream else {})}
            shift = now["next"] - least
            if shift not in made:  # once, unless another writer comes between
                made[shift] = uuid.uuid4().hex
                pools.summary(rows.withColumn("seq", F.col("seq") + shift)).write.parquet(f"{self.root}/addresses/{made[shift]}")
            now = now | {"delta": [*now["delta"], {"id": name, "shift": shift, "summary": made[shift]}]}
            return now | {"news": self._verdicts(now), "next": last + shift + 1, "streams": now["streams"] | ({stream: batch} if stream else {})}

        return self.manifest.change(counted) is not None

    def compact(self) -> int:
        """Brings the deltas into the base, and returns how many. Only pools and days whose rows change are written anew."""
        began = self.manifest.latest()[1]
        if not began["delta"]:
            return 0
        rows, found, changed = self._news(began)
        base = self._base(began)
        moved = base.join(changed.select(F.col("ip").alias("_ip")), F.col("ip") == F.col("_ip"), "left_semi")
        again = pools.judged(moved.drop("pool", "malicious_reason"), changed)
        touched = moved.select("pool", "day").union(again.select("pool", "day")).union(pools.judged(rows, found).select("pool", "day")).distinct().collect()  # folders
        days: dict[str, list] = {}
        for r in touched:
            days.setdefault(r["pool"], []).append(r["day"])
        test = reduce(lambda a, b: a | b, [(F.col("pool") == p) & F.col("day").isin(d) for p, d in days.items()])
        version, runs = uuid.uuid4().hex, [*began["addresses"], *[d["summary"] for d in began["delta"]]]
        self._put(self._untagged(began).where(test), version)
        if len(runs) > RUNS:
            self._summary(runs).write.option("parquet.bloom.filter.enabled#ip", "true").parquet(f"{self.root}/addresses/{version}")
            runs = [version]
        gone, taken = {f"pool={r['pool']}/day={r['day']}" for r in touched}, {d["id"] for d in began["delta"]}
        parts = {p: v for p, v in began["rows"].items() if p not in gone} | self._parts(version)

        def counted(now: dict) -> dict | None:
            """Deltas that came meanwhile stay; after another compaction this one is void."""
            if now["rows"] != began["rows"] or now["addresses"] != began["addresses"]:
                return None
            now = now | {"rows": parts, "addresses": runs, "delta": [d for d in now["delta"] if d["id"] not in taken]}
            return now | {"news": self._verdicts(now) if now["delta"] else None}

        if self.manifest.change(counted) is None:
            self.files.remove(f"{self.root}/rows/v={version}")
            return 0
        self.clean()
        return len(taken)

    def clean(self, age: float = OLD) -> None:
        """Removes what the last manifests don't name. What is younger than `age` seconds stays, as a writer may yet count it in."""
        kept = self.manifest.trim(KEPT)
        parts = {f"v={v}/{p}" for m in kept for p, v in m["rows"].items()}
        deltas = {f"id={d['id']}" for m in kept for d in m["delta"]}
        runs = {r for m in kept for r in [*m["addresses"], *[d["summary"] for d in m["delta"]]]}

        news = {m["news"]["id"] for m in kept if m["news"]}

        def sweep(folder: str, named: set[str], below: int) -> None:
            for n in self.files.names(f"{self.root}/{folder}"):
                mine = {x for x in named if x == n or x.startswith(f"{n}/")}
                if mine and below and "=" in n:
                    sweep(f"{folder}/{n}", {x[len(n) + 1 :] for x in mine}, below - 1)
                elif not mine and n != "_SUCCESS" and self.files.age(f"{self.root}/{folder}/{n}") >= age:
                    self.files.remove(f"{self.root}/{folder}/{n}")

        for folder, named, below in (("rows", parts, 2), ("delta", deltas, 0), ("addresses", runs, 0), ("verdicts", news, 0)):
            sweep(folder, named, below)
        for n in self.files.names(self.root):
            if n.startswith("staged-") and self.files.age(f"{self.root}/{n}") >= age:
                self.files.remove(f"{self.root}/{n}")

    def close(self) -> None:
        """Ends the use of a store without a cache: its folder goes."""
        if self.passing:
            self.files.remove(self.root)

    def tag(self, ip: str, tag: str) -> None:
        self.tags.put(ip, tag)
        self.tags.save()

    def run_rule(self, rule: rule_plans.Rule) -> dict:
        """Runs a rule with its own tags as claims and applies the difference; tags of others stay."""
        now = self.tags.frame(self.spark)
        claimed = now.where(F.col("source") == rule.name)
        before = now.select(F.col("ip").alias("_ip"), F.struct("tag", "reason").alias("_before"))
        found = rule_plans.difference(rule.run(self.rows(), claimed), now, rule.name)
        found = found.join(before, F.col("ip") == F.col("_ip"), "left").persist(StorageLevel.DISK_ONLY)
        try:
            count = dict.fromkeys(("added", "kept", "removed", "skipped"), 0) | {r["action"]: r["count"] for r in found.groupBy("action").count().collect()}
            same = (F.col("action") == "kept") & F.col("_before").eqNullSafe(F.struct("tag", "reason"))
            changes = found.where(~same & (F.col("action") != "skipped")).select("ip", "tag", "reason", "action").collect()  # what the document doesn't say yet
        finally:
            found.unpersist()
        for r in changes:
            if r["action"] == "removed":
                self.tags.put(r["ip"], "real")
                self.tags.delete(r["ip"])
            else:
                self.tags.put(r["ip"], r["tag"], rule.name, r["reason"])
        self.tags.save()
        return {"name": rule.name, **count}

    def clear_rule(self, rule: rule_plans.Rule) -> int:
        """All that the rule had tagged becomes real."""
        mine = [ip for ip, _ in self.tags.newest(rule.name)]
        for ip in mine:
            self.tags.put(ip, "real")
            self.tags.delete(ip)
        self.tags.save()
        return len(mine)

    def run_rules(self, chosen: list[rule_plans.Rule] | None = None) -> list[dict]:
        """One after the other by priority; a rule that fails leaves its error and the rest run."""
        out, chosen = [], chosen or rule_plans.default_rules()
        for k, rule in enumerate(chosen):
            self.progress(rule.name, k, len(chosen))
            try:
                out.append(self.run_rule(rule))
            except Exception as e:  # noqa: BLE001
                out.append({"name": rule.name, "error": str(e)})
        self.progress("rules", len(chosen), len(chosen))
        return out
