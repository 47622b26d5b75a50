"""What several operators share: table access, durable cuts of the lineage, and a distributed rank."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the text contracts: runs of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"

#: Rows up to which a counted side may be broadcast (callers count first and join by shuffle beyond it).
BROADCAST_ROWS = 500_000
#: Bytes of strings, arrays and the like up to which it may be.
BROADCAST_BYTES = 64 << 20


#: Bytes of texts that a Python worker is handed at once.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts; Arrow batches are bounded by bytes, as a few documents may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder. Only a local master, as in tests, gets one of its own."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            found = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a narrow result with a checkpoint in the shared folder; lost executors don't undo it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage of rows that carry texts: a compressed table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a (cut) side has at most so many rows and BROADCAST_BYTES, summed up by the tasks that hold it."""
    size = F.lit(0)
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind in ("array", "map", "struct", "variant"):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return n <= rows and total <= BROADCAST_BYTES


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a cut side for broadcast if its counted rows and bytes allow it; else it stays as it is and the join shuffles."""
    return F.broadcast(df) if fits(df, rows) else df


def n_words(text: Column) -> Column:
    """Count of words of a text, JVM-side; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))), F.lit(0)).cast("long")


#: What tells rows of one id apart: two hashes over all columns. Rows that share both are taken for the same row.
KEY = ["_key", "_key2"]


def row_keys(df: DataFrame) -> list[Column]:
    """KEY of a row; columns of types that can't be hashed count as JSON. They depend on the row only, so a task that runs twice deals alike."""
    odd = lambda f: any(t in f.dataType.simpleString() for t in ("map<", "variant"))
    parts = [F.to_json(F.struct(f"`{f.name}`")) if odd(f) else F.col(f"`{f.name}`") for f in df.schema.fields]
    return [F.xxhash64(*parts).alias(KEY[0]), F.hash(*parts).alias(KEY[1])]


def repeats(rows: DataFrame) -> bool:
    """Whether some of rows(doc_id, KEY) are the same."""
    return rows.groupBy("doc_id", *KEY).count().where("count > 1").limit(1).count() > 0


def rejoin(docs: DataFrame, found: DataFrame, key: str, repeated: bool) -> DataFrame:
    """The columns of docs for each row of the cut table found(doc_id, KEY, more), followed by more.

    Ranks and figures are found on narrow rows; here the wide ones come back, shuffled once at most. Where rows of docs are
    repeated, those that are the same are made one first, by an aggregation that begins in the tasks, so a third of all
    rows being the same is no hot group.
    """
    more = [c for c in found.columns if c not in ("doc_id", *KEY)]
    kept = [c for c in docs.columns if c not in more]
    hashes = [k.alias(f"_of{name}") for k, name in zip(row_keys(docs), KEY, strict=True)]
    wide = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), F.col(f"`{key}`").alias("_id"), *hashes)
    if repeated:
        wide = wide.dropDuplicates(["_id", *[f"_of{k}" for k in KEY]])
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    for k in KEY:
        same = same & (F.col(k) == F.col(f"_of{k}"))
    return wide.join(small_side(found), same).select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], *more)


def ranked(df: DataFrame, group: str, order: list, sums: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rank of each (narrow) row within its group without a task for a group.

    The rows are cut first, each with a number of its own, so rows that are equal in all else can be dealt apart. They are
    range-partitioned by (group, order, number), so a group of a third of all rows spreads over many tasks; the sorted
    rows are cut once, one small row per (group, partition) is counted, and the counts before a partition are added.
    Returns the rows with `_rank` (from 0), and the table of groups with `_n` and `_sum_<c>` for each c of sums.
    """
    df = cut(df.withColumn("_own", F.monotonically_increasing_id()))
    keys = [F.col(group).asc_nulls_last(), *order, F.col("_own").asc()]
    placed = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_own").withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    runs = cut(placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), *[F.sum(c).alias(f"_sum_{c}") for c in sums or []]))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(F.col(group).alias("_run_group"), F.col("_part").alias("_run_part"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = placed.join(starts, F.col(group).eqNullSafe(F.col("_run_group")) & (F.col("_part") == F.col("_run_part")))
    rows = rows.withColumn("_rank", F.col("_before") + F.col("_at") - F.col("_first")).drop("_run_group", "_run_part", "_first", "_before", "_at", "_part")
    groups = runs.groupBy(group).agg(F.sum("_n").alias("_n"), *[F.sum(f"_sum_{c}").alias(f"_sum_{c}") for c in sums or []])
    return rows, groups
