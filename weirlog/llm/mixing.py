"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source has the same number of expected copies, target / size of the source. Their prefix sum over
the source's documents (largest first), plus one random offset, crosses an integer once per copy that the mix takes.
As the order is by size, a source's taken words differ from its target by no more than its longest document.

Defined results: a null or empty text has size 0 and may be taken, adding no words; a null source is a source, the last
one; a source without words gets rate 0; repeated rows are rows of their own; an empty table gives no rows; input columns
that bear the name of a result column are replaced by it. Rank, and so the copies, depend on the rows only: reruns agree.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog.llm import common as C

WEIGHTS, SHARE_PERCENT, CAP, SEED = (5, 2, 1), 150, 2, 20


def offset(seed: int = SEED) -> float:
    """The one random offset of a mix."""
    return random.Random(seed).random()


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, cap: int = CAP) -> DataFrame:
    """sizes(source, source_size), a row per source; adds the target, filled by weight up to cap times the size.

    Each turn of the loop brings two sums to the driver; sources that are above their cap keep it, the others share the rest.
    """
    ordered, _ = C.ranked(sizes.withColumn("_all", F.lit(0)), "_all", [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    sources = C.cut(ordered.select("source", "source_size", weight.alias("weight")))
    total, all_weight = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    capped_size = capped_weight = 0
    while True:
        num, den = share_percent * total - 100 * cap * capped_size, 100 * (all_weight - capped_weight)
        level = (F.col("weight") * F.lit(num)).cast("double") / F.lit(float(max(den, 1)))
        above = level > F.col("source_size") * F.lit(cap)
        size, weight_of = sources.where(above).agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if weight_of <= capped_weight:
            break
        capped_size, capped_weight = size, weight_of
        if capped_weight == all_weight:
            break
    ceiling = (F.col("source_size") * F.lit(cap)).cast("double")
    return sources.select("source", "source_size", F.when(above, ceiling).otherwise(level).alias("target"))


def copies(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """A row per document with source, size, source_size, target, copies and taken, and KEY, the hashes of all its columns."""
    out = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(source).cast("string").alias("source"), C.n_words(F.col(text)).alias("size"), *C.row_keys(docs))
    rows, groups = C.ranked(out, "source", [F.col("size").desc(), F.col("doc_id").asc_nulls_first(), *[F.col(k).asc() for k in C.KEY]], ["size"])
    rate = targets(groups.select("source", F.col("_sum_size").alias("source_size")))
    rate = C.small_side(C.cut(rate.withColumnRenamed("source", "_source")))
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = lambda rank: F.floor(rank.cast("double") * F.col("_rate") + F.lit(offset(seed)))
    return (
        rows.join(rate, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_rate", r)
        .withColumn("copies", at(F.col("_rank") + 1) - at(F.col("_rank")))
        .withColumn("taken", F.col("copies") * F.col("size")).drop("_source", "_rate", "_rank")
    )


def mix(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The mixed documents themselves: each row as often as the mix takes it, with the columns of docs."""
    rows = C.cut(copies(docs, key=key, **options).select("doc_id", *C.KEY, "copies"))
    found = rows.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")  # CAP at most
    return C.rejoin(docs, found, key, C.repeats(rows)).drop("_copy")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return copies(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = rf"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM sized GROUP BY source),
weighed AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sums),
filled AS (
  SELECT *, sum(source_size) OVER w - source_size AS below_size, sum(weight) OVER w - weight AS below_weight,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight
  FROM weighed WINDOW w AS (ORDER BY source_size / CAST(weight AS DOUBLE), i ROWS UNBOUNDED PRECEDING)
),
levels AS (SELECT *, 150 * total - 200 * below_size AS num, 100 * (all_weight - below_weight) AS den FROM filled),
level AS (SELECT num, den FROM levels WHERE CAST(weight * num AS DOUBLE) / CAST(den AS DOUBLE) <= 2 * source_size ORDER BY below_weight LIMIT 1),
rates AS (
  SELECT source, source_size, CASE WHEN CAST(weight * num AS DOUBLE) / CAST(den AS DOUBLE) > 2 * source_size THEN CAST(2 * source_size AS DOUBLE)
         ELSE CAST(weight * num AS DOUBLE) / CAST(den AS DOUBLE) END AS target FROM weighed, level
),
placed AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0.0 END AS rate,
         CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id) - 1 AS DOUBLE) AS k
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
),
counted AS (SELECT *, CAST(floor((k + 1) * rate + {offset()!r}::DOUBLE) - floor(k * rate + {offset()!r}::DOUBLE) AS BIGINT) AS copies FROM placed)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM counted
"""
