"""The driver's events as log lines, most of them loaded by a store, the others appended to it in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog.plans import sample
from weirlog.sources import files, json_log
from weirlog.sources.store import LogStore
from weirlog.sources.tags import TagSet

#: Batches that are appended, and after how many the store is compacted.
BATCHES, COMPACTED = 3, 2


def line() -> Column:
    """An event as a line of JSON."""
    request = F.struct(
        F.lit("192.0.2.1").alias("remote_ip"), F.col("ip").alias("client_ip"), "proto", "method", "host", "uri",
        F.create_map(F.lit("User-Agent"), F.array("user_agent"), F.lit("Referer"), F.array("referer")).alias("headers"),
    )
    return F.to_json(F.struct((F.col("ts") / F.lit(1e9)).alias("ts"), F.lit("handled request").alias("msg"), "status", "size", "bytes_read", (F.col("duration_ns") / F.lit(1e9)).alias("duration"), request.alias("request")))


def store(spark: SparkSession, sf_dir: str, name: str, compact: bool = False, tags: TagSet | None = None) -> LogStore:
    """A store of three fifths of the events, read from files of lines, to which the others have been appended. Made once for an application."""
    there = files.Files(spark)
    key = files.fingerprint(there, [f"{sf_dir}/events.parquet"])
    at = f"{files.shared_dir(spark)}/{name}-{spark.sparkContext.applicationId}-{key}"
    rows = sample.events(spark, sf_dir)
    first = rows.agg(F.max("seq")).first()[0] * 3 // 5
    lines = rows.select("seq", line().alias("value"))
    if not there.exists(f"{at}/logs/_SUCCESS"):
        base = lines.where(F.col("seq") <= first)
        base.repartitionByRange(4, "seq").sortWithinPartitions("seq").select("value").write.mode("overwrite").text(f"{at}/logs")
    out = LogStore(spark, [f"{at}/logs/part-*"], f"{at}/cache", tags, v6=False, local=sample.LOCAL)
    for k in range(BATCHES):
        mine = lines.where((F.col("seq") > first) & (F.floor((F.col("seq") - first - 1) / F.lit(first // BATCHES + 1)) == k))
        if out.ingest(json_log.parsed(mine, ["seq"]), "sample", k) and compact and k + 1 == COMPACTED:
            out.compact()
    return out
