"""Addresses to places, by ranges of numbers or by networks, without a nested-loop join. Distinct addresses are looked up once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog.functions.addresses import ip_halves, ip_number

#: Addresses of a join bucket: a range is listed once per bucket that it touches.
WIDTH = 65_536


def masked(hi: Column, lo: Column, bits: Column) -> tuple[Column, Column]:
    """The first `bits` bits of an address, the others zero."""
    ones = lambda n: F.call_function("shiftleft", F.lit(-1).cast("long"), (64 - n).cast("int"))
    first = lambda x, n: F.when(n <= 0, F.lit(0).cast("long")).when(n >= 64, x).otherwise(x.bitwiseAND(ones(n)))
    return first(hi, bits), first(lo, bits - 64)


def networks(spark: SparkSession, path: str) -> DataFrame:
    """(hi, lo, bits, country, city) of a place database's file."""
    from weirlog.sources.mmdb import MmdbSource

    spark.dataSource.register(MmdbSource)
    return spark.read.format("mmdb").option("path", path).load().select("hi", "lo", "bits", "country", "city")


def locate(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Adds country and city, '' without one: of ranges(start, end, country, city) of dotted addresses the narrowest that
    holds the address, of networks(hi, lo, bits, country, city) the one with the longest prefix."""
    found = _by_prefix(rows, places) if "bits" in places.columns else _by_range(rows, places)
    out = rows.join(found, F.col("ip") == F.col("_ip"), "left")
    return out.withColumns({c: F.coalesce(F.col("_place")[c], F.lit("")) for c in ("country", "city")}).drop("_ip", "_place")


def _by_range(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """An equi-join on the bucket, then the bounds."""
    spread = ranges.select("start", "end", "country", "city", F.explode(F.sequence(F.floor(F.col("start") / WIDTH), F.floor(F.col("end") / WIDTH))).alias("_bucket"))
    ips = rows.select("ip").distinct().withColumn("_n", ip_number(F.col("ip"))).where("_n is not null")
    found = ips.join(spread, (F.floor(F.col("_n") / WIDTH) == F.col("_bucket")) & F.col("_n").between(F.col("start"), F.col("end")))
    return found.groupBy(F.col("ip").alias("_ip")).agg(F.min_by(F.struct("country", "city"), F.struct(F.col("end") - F.col("start"), "start")).alias("_place"))


def _by_prefix(rows: DataFrame, nets: DataFrame) -> DataFrame:
    """An equi-join on (length, prefix): an address is looked up once for each prefix length that there is, 129 at most; no network is expanded."""
    lengths = sorted(r["bits"] for r in nets.select("bits").distinct().collect())
    ips = rows.select("ip").distinct().select("ip", ip_halves(F.col("ip")).alias("a")).where("a is not null").select("ip", "a.hi", "a.lo")
    dotted = (F.col("hi") == 0) & (F.shiftrightunsigned("lo", 32) == 0)
    of = lambda least: F.array(*[F.lit(n) for n in lengths if n >= least]).cast("array<int>")
    asked = ips.withColumn("_bits", F.explode(F.when(dotted, of(96)).otherwise(of(0))))
    hi, lo = masked(F.col("hi"), F.col("lo"), F.col("_bits"))
    asked = asked.select(F.col("ip").alias("_ip"), "_bits", hi.alias("_hi"), lo.alias("_lo"))
    found = asked.join(nets, (F.col("_bits") == F.col("bits")) & (F.col("_hi") == F.col("hi")) & (F.col("_lo") == F.col("lo")))
    return found.groupBy("_ip").agg(F.max_by(F.struct("country", "city"), F.struct("bits", "country", "city")).alias("_place"))
