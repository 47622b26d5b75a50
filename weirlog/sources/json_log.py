"""Access logs as JSON lines, plain or gzip, to normalised events in the order of arrival.

Arrival is the order of files by name, then of lines. seq numbers lines in this order: each split's lines are numbered in
the scan, and the lines before a split are counted; nothing is sorted globally.
"""

from __future__ import annotations

import glob

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirlog.functions.labels import seconds_to_ns
from weirlog.sources.files import Files, has_scheme

_STRING = T.StringType()
REQUEST = T.StructType([
    *[T.StructField(c, _STRING) for c in ("remote_ip", "client_ip", "proto", "method", "host", "uri")],
    T.StructField("headers", T.MapType(_STRING, T.ArrayType(_STRING))), T.StructField("tls", T.StructType([T.StructField("server_name", _STRING)])),
])
SCHEMA = T.StructType([
    T.StructField("ts", T.DoubleType()), T.StructField("msg", _STRING), T.StructField("status", T.IntegerType()), T.StructField("size", T.LongType()), T.StructField("bytes_read", T.LongType()),
    T.StructField("duration", T.DoubleType()), T.StructField("request", REQUEST), T.StructField("_corrupt_record", _STRING),
])


def expand(patterns: list[str], spark: SparkSession | None = None) -> list[str]:
    """Files of paths and globs, each once, in their order; a pattern that finds nothing is an error. Those with a scheme are asked of Spark's file system."""
    found: dict[str, None] = {}
    for p in patterns:
        matches = Files(spark or SparkSession.builder.getOrCreate()).glob(p) if has_scheme(p) else sorted(glob.glob(p))
        if not matches:
            raise FileNotFoundError(f"no file matches {p!r}")
        found |= dict.fromkeys(matches)
    return list(found)


def header(name: str) -> Column:
    """First value of a header: by its exact name, else by the first that differs in case only."""
    headers = F.col("request.headers")
    exact = F.get(F.try_element_at(headers, F.lit(name)), F.lit(0))
    folded = F.map_values(F.map_filter(headers, lambda k, v: (F.lower(k) == name.lower()) & (F.size(v) > 0)))
    return F.coalesce(F.nullif(exact, F.lit("")), F.get(F.get(folded, F.lit(0)), F.lit(0)), F.lit(""))


def normalize(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Access lines that could be read, as events; missing values are '' and 0. Of other columns seq stays, or those to keep."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = lambda c, kind="long": F.coalesce(F.col(c), F.lit(0)).cast(kind)
    rows = raw.where(F.col("_corrupt_record").isNull() & (text("request.method") != ""))
    keep = ["seq"] if keep is None and "seq" in raw.columns else keep or []
    return rows.select(
        *keep, seconds_to_ns(F.coalesce("ts", F.lit(0.0))).alias("ts"), number("status", "int").alias("status"), text("request.method").alias("method"), text("request.host").alias("host"),
        text("request.uri").alias("uri"), F.coalesce(F.nullif(F.col("request.client_ip"), F.lit("")), F.col("request.remote_ip"), F.lit("")).alias("ip"), text("request.proto").alias("proto"),
        header("User-Agent").alias("user_agent"), F.coalesce(F.nullif(header("Referer"), F.lit("")), header("Referrer")).alias("referer"),
        (F.coalesce("duration", F.lit(0.0)) * 1e9).cast("long").alias("duration_ns"), number("size").alias("size"), number("bytes_read").alias("bytes_read"),
    )


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of any length as text, with the file and split they are in and a number that grows within the split."""
    raw = spark.read.text(paths).withColumn("_line", F.monotonically_increasing_id())
    return raw.withColumns({"_name": F.col("_metadata.file_name"), "_path": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")})


def parsed(raw: DataFrame, keep: list[str]) -> DataFrame:
    """The events of text lines `value`, and of the other columns those to keep."""
    record = F.from_json("value", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return normalize(raw.select(record.alias("r"), *keep).select("r.*", *keep), keep)


PLACE = ["_name", "_path", "_block"]


def numbered(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """rows of lines() with seq in place of what lines() adds, by what `splits`, rows of the same lines, say of each split.

    seq orders as (file, split, line) does: a split's first number is the count of lines before it, from one small row
    per split, which is all that is shuffled. Files are ordered by name, those of one name by path.
    """
    split = splits.groupBy(*PLACE).agg(F.min("_line").alias("first"), F.max("_line").alias("last")).withColumn("n", F.col("last") - F.col("first") + 1)
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = split.groupBy("_name", "_path").agg(F.sum("n").alias("n")).select(F.col("_path").alias("_file"), before(Window.orderBy("_name", "_path")).alias("of_files"))  # a row per file
    split = split.withColumn("of_file", before(Window.partitionBy("_path").orderBy("_block")))
    starts = split.join(files, F.col("_path") == F.col("_file")).select(F.col("_path").alias("_of_path"), F.col("_block").alias("_of_block"), (F.col("of_files") + F.col("of_file") - F.col("first")).alias("_start"))
    rows = rows.join(starts, (F.col("_path") == F.col("_of_path")) & (F.col("_block") == F.col("_of_block")))
    return rows.withColumn("seq", F.col("_start") + F.col("_line")).drop(*PLACE, "_line", "_of_path", "_of_block", "_start")


def read(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """Events of all files with seq, broken lines are passed over. Lines are counted as text, and parsed once."""
    raw = lines(spark, expand(patterns, spark))
    return numbered(parsed(raw, [*PLACE, "_line"]), raw)
