"""Line dedup by overlapping windows of three lines, in DataFrame operations only.

Every run of three consecutive lines of a text is hashed (128 bits) unless all three are blank. A window that occurs
again, in any document or further down in the same one, is found by one aggregation that keeps its first place in the
order (doc_id, hash of the text, line). All later places are covered, covered lines are merged per document and removed.
So that no passage of whole lines is too short for a window, one or two lines are a window too if they have PASSAGE words or
are all of a text.

Defined results: null stays null; with passage=None a text of fewer than three lines stays whole; a text whose lines are
all covered becomes empty; rows that repeat both id and text are one document and share their result; a null id comes
first in the order; input columns named as a result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog.llm import common as C

SPAN = 3
#: Fewer lines than SPAN are a window from this number of words on.
PASSAGE = 50


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, span: int = SPAN, passage: int | None = PASSAGE) -> DataFrame:
    """(doc_id, _th, place, h1, h2): a row per window with a word; place is first line * span + lines - 1."""

    def words(x: Column) -> Column:
        return x.rlike(r"[^ \t\r\x0b\x0c]").cast("int") if passage is None else F.size(F.array_remove(F.split(x, r"[ \t\r\x0b\x0c]+"), ""))

    lined = docs.select("doc_id", "_th", lines_of(F.col("text")).alias("_l"))
    hashed = lined.select("doc_id", "_th", F.size("_l").alias("_n"), F.transform("_l", lambda x: F.xxhash64(x)).alias("_h"), F.transform("_l", words).alias("_w"))

    def at(h: Column, i: Column) -> Column:
        """Windows that begin with line i of hash h, null where there is none."""
        hashes, found = [h], []
        n = F.get("_w", i)
        for size in range(1, span + 1):
            if size > 1:
                hashes, n = [*hashes, F.get("_h", i + (size - 1))], n + F.get("_w", i + (size - 1))
            if size == span or passage is not None:
                ends = (i + size <= F.col("_n")) & (n > 0)
                if size < span:
                    ends = ends & ((F.col("_n") == size) | (n >= passage))
                found.append(F.when(ends, F.struct((i.cast("long") * span + (size - 1)).alias("place"), F.xxhash64(*hashes).alias("h1"), F.xxhash64(F.lit(size), *reversed(hashes)).alias("h2"))))
        return F.array(*found) if len(found) > 1 else found[0]

    runs = F.transform("_h", at)
    found = hashed.select("doc_id", "_th", F.explode(runs if passage is None else F.flatten(runs)).alias("w"))
    return found.where("w IS NOT NULL").select("doc_id", "_th", "w.place", "w.h1", "w.h2")


def later_places(docs: DataFrame, span: int = SPAN, passage: int | None = PASSAGE) -> DataFrame:
    """(doc_id, _th, starts): places of the windows that repeat an earlier one."""
    found = C.written(windows(docs, span, passage))  # texts are cut into lines once
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "_th", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = found.join(C.small_side(C.cut(first)), ["h1", "h2"]).where(~F.struct("doc_id", "_th", "place").eqNullSafe(F.col("first")))
    return again.groupBy("doc_id", "_th").agg(F.collect_set("place").alias("starts"))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, passage: int | None = PASSAGE) -> DataFrame:
    """All columns of docs, with the text freed of repeated windows, n_lines and n_removed.

    passage: words from which fewer than span lines are a window; None for windows of span lines only.
    """
    keyed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_th"))
    covered = later_places(keyed.select("doc_id", "text", "_th"), span, passage)
    lines = lambda p: F.sequence(F.floor(p / span).cast("int"), (F.floor(p / span) + p % span).cast("int"))
    covered = covered.select(F.col("doc_id").alias("_id"), F.col("_th").alias("_h"), F.array_distinct(F.flatten(F.transform("starts", lines))).alias("_covered"))
    joined = keyed.join(covered, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_h")), "left")
    joined = joined.withColumn("_lines", F.when(F.col("_covered").isNotNull(), lines_of(F.col("text"))))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_covered"))
    cleaned = F.when(F.col("_covered").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.element_at("_lines", i + 1)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)
    kept = [c for c in docs.columns if c not in (text, "n_lines", "n_removed")]
    return joined.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], cleaned.alias(text), n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("_covered"), F.lit(0)).cast("long").alias("n_removed"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(C.table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH lined AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
sized AS (SELECT doc_id, l, [len(regexp_extract_all(x, '[^ \t\r\x0B\f]+')) FOR x IN l] AS n FROM lined),
win AS (
  SELECT doc_id, pos, 3 AS size, l[pos + 1] || chr(10) || l[pos + 2] || chr(10) || l[pos + 3] AS w
  FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS pos FROM sized WHERE len(l) >= 3)
  UNION ALL
  SELECT doc_id, pos, 2, l[pos + 1] || chr(10) || l[pos + 2]
  FROM (SELECT doc_id, l, n, unnest(range(0, len(l) - 1)) AS pos FROM sized WHERE len(l) >= 2) WHERE len(l) = 2 OR n[pos + 1] + n[pos + 2] >= 50
  UNION ALL
  SELECT doc_id, pos, 1, l[pos + 1]
  FROM (SELECT doc_id, l, n, unnest(range(0, len(l))) AS pos FROM sized) WHERE len(l) = 1 OR n[pos + 1] >= 50
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY size, w ORDER BY doc_id, pos) AS k FROM win WHERE regexp_matches(w, '[^ \t\r\n\x0B\f]')),
covered AS (SELECT doc_id, list_distinct(flatten(list(range(pos, pos + size)))) AS c FROM numbered WHERE k > 1 GROUP BY doc_id)
SELECT d.doc_id,
  CASE WHEN c IS NULL THEN text ELSE coalesce(array_to_string([l[i + 1] FOR i IN range(0, len(l)) IF NOT list_contains(c, i)], chr(10)), '') END AS text,
  CASE WHEN text IS NULL THEN 0 ELSE len(l) END AS n_lines, coalesce(len(c), 0) AS n_removed
FROM lined d LEFT JOIN covered USING (doc_id)
"""
