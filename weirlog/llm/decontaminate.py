"""Benchmark decontamination by a prefix-filtered set join, verified over item-sized windows.

A window is 13 consecutive words of an item, or a shorter item as a whole. As a set of shingles it must be contained
wholly in a text that it occurs in, so one shingle of it is a sufficient prefix: the rarest one in the documents.

1. One pass over the texts counts words and keeps, with the words around it, each place of a shingle that some window has.
   (Where the windows have more distinct shingles than may be broadcast, a bitmap of fixed size by their hashes stands for
   them: some places more pass, and the joins do the rest.)
2. Places are counted per shingle; a window that lacks one of its shingles is dropped, the others get their rarest as prefix.
3. Prefix and places are joined; the shingle's offset gives the only start the window can have there. It must leave the
   whole window inside the text (position and length bounds), and the words there must be the window's words exactly.
4. Covered words are counted once by a running maximum of ends per document.

Defined results: a null or wordless text has no words, no hits and isn't contaminated; an item without words has no
windows; an item of fewer than 13 words matches as a whole; a null item_id counts as one item, whose id is empty; rows that repeat id and text share their result; an empty
benchmark contaminates nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirlog.llm import common as C
from weirlog.llm.words import WordHashes, shingles

WINDOW, SHINGLE = 13, 5
#: Distinct shingles of the benchmark up to which the pass over the texts is given their hashes (8 bytes each).
FILTER = 2_000_000
#: Bits of the bitmap beyond that (32 MB).
BITS = 28
#: Contaminated: at least one of so many words is hit.
SHARE = 20

_KEPT = bytes(b if b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" else 0x20 for b in range(256))


def item_words(text: bytes) -> list[bytes]:
    """Lower-case A-Z, then runs of digits, a-z and characters beyond ASCII."""
    return text.lower().translate(_KEPT).split()


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, words, n): the distinct windows of each item, as their words with a space between."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found, ns = [], [], []
            for i, text in enumerate(_bytes(b.column("text"))):
                words = item_words(text or b"")
                n = min(size, len(words))
                for w in {b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)} if n else ():
                    at.append(i)
                    found.append(w.decode())
                    ns.append(n)
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(at, pa.int64())), pa.array(found, pa.string()), pa.array(ns, pa.int32())], ["item_id", "words", "n"])

    return benchmark.select("item_id", "text").mapInArrow(run, f"item_id {kind}, words string, n int").distinct()


def window_shingles(found: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(words, n, k, offset, sh): the shingles of each window; k is their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            at, offset, sh, ks = [], [], [], []
            for i, words in enumerate(_bytes(b.column("words"))):
                own = hashes.of(words.split(b" "))
                k = min(size, len(own))
                for o, h in enumerate(shingles(own, k).view(np.int64).tolist()):
                    at.append(i)
                    offset.append(o)
                    sh.append(h)
                    ks.append(k)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("words").take(at), b.column("n").take(at), pa.array(ks, pa.int32()), pa.array(offset, pa.int32()), pa.array(sh, pa.int64())], ["words", "n", "k", "offset", "sh"])

    return found.select("words", "n").distinct().mapInArrow(run, "words string, n int, k int, offset int, sh long")


def places(docs: DataFrame, lengths: list[int], wanted: np.ndarray, window: int = WINDOW, size: int = SHINGLE) -> DataFrame:
    """A row (doc_id, key, n_words) per document, and rows with sh, pos and the words around it, from word `since` on."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    low = np.uint64((1 << 22) - 1)
    names = ["doc_id", "key", "n_words", "sh", "pos", "since", "around"]
    given, of_hashes = docs.sparkSession.sparkContext.broadcast(wanted), wanted.dtype == np.uint64  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        known = given.value
        if of_hashes:
            marks = np.zeros(1 << 22, bool)
            marks[known & low] = True
        for b in batches:
            at, total, sh, pos, since, around = [], [], [], [], [], []
            for i, text in enumerate(_bytes(b.column("text"))):
                words = item_words(text or b"")
                total.append(len(words))
                own = hashes.of(words)
                for k in lengths:
                    if len(own) < k:
                        continue
                    found = shingles(own, k)
                    if of_hashes:
                        where = np.flatnonzero(marks[found & low])
                        place = np.minimum(np.searchsorted(known, found[where]), len(known) - 1)
                        where = where[known[place] == found[where]]
                    else:
                        bit = (found & np.uint64((1 << BITS) - 1)).astype(np.int64)
                        where = np.flatnonzero((known[bit >> 6] >> (bit & 63)) & 1)
                    beyond = window - k if k == size else 0
                    for p, h in zip(where.tolist(), found[where].view(np.int64).tolist(), strict=True):
                        a = max(0, p - beyond)
                        at.append(i)
                        sh.append(h)
                        pos.append(p)
                        since.append(a)
                        around.append(b" ".join(words[a : p + k + beyond]).decode())
            n = pa.array(total, pa.int32())
            none = [pa.nulls(b.num_rows, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), n, *none], names)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("key").take(at), n.take(at), pa.array(sh, pa.int64()), pa.array(pos, pa.int32()), pa.array(since, pa.int32()), pa.array(around, pa.string())], names)

    return docs.mapInArrow(run, f"doc_id {kind}, key long, n_words int, sh long, pos int, since int, around string")


def shingle_filter(distinct: DataFrame) -> np.ndarray:
    """The sorted hashes (uint64) if there are FILTER at most, else a bitmap (int64 words of 64 bits) by the low BITS of them."""
    if C.fits(distinct, FILTER):
        return np.sort(distinct.toPandas()["sh"].to_numpy(np.int64).view(np.uint64))
    bit = F.col("sh").bitwiseAND(F.lit((1 << BITS) - 1))
    words = distinct.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toPandas()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, _key, n_words, n_hit, n_items, items_sha256, contaminated) per row of docs; _key is the hash of its text."""
    docs = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    items = C.cut(windows(benchmark.select(F.col(item).alias("item_id"), F.col(item_text).alias("text"))))
    parts = C.cut(window_shingles(items))
    lengths = sorted(r.k for r in parts.select("k").distinct().collect())  # 1 to SHINGLE
    wanted = shingle_filter(parts.select("sh").distinct())
    seen = C.cut(places(docs, lengths, wanted))
    hits = seen.where("sh is not null")

    frequency = hits.groupBy("sh").agg(F.count("*").alias("c"))
    order = F.struct("c", "offset", "sh")
    prefix = parts.join(frequency, "sh", "left").groupBy("words", "n").agg(F.min(F.coalesce("c", F.lit(0))).alias("least"), F.min(order).alias("p"))
    prefix = C.small_side(C.cut(prefix.where("least > 0").select("words", F.col("n").alias("n"), "p.sh", "p.offset")), 100_000)
    start = F.col("pos") - F.col("offset")
    found = hits.join(prefix, "sh").withColumn("start", start).where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words")) & (F.col("start") >= F.col("since")))
    found = found.where(F.concat_ws(" ", F.slice(F.split("around", " "), F.col("start") - F.col("since") + 1, F.col("n"))) == F.col("words"))
    found = C.cut(found.select("doc_id", "key", "start", "n", "words").distinct())

    before = Window.partitionBy("doc_id", "key").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))))
    n_hit = found.select("doc_id", "key", fresh.alias("fresh")).groupBy("doc_id", "key").agg(F.sum("fresh").alias("n_hit"))
    of = found.select("doc_id", "key", "words").distinct().join(C.small_side(items.select("words", "item_id")), "words").groupBy("doc_id", "key").agg(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("items"))
    result = n_hit.join(of, (n_hit["doc_id"].eqNullSafe(of["doc_id"])) & (n_hit["key"] == of["key"])).select(n_hit["doc_id"].alias("_id"), n_hit["key"].alias("_hit_key"), "n_hit", "items")
    result = C.small_side(C.cut(result), 100_000)

    rows = seen.where("sh is null").join(result, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_hit_key")), "left")
    n_hit, items_of = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id", F.col("key").alias("_key"), F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items_of), ","), 256).alias("items_sha256"), ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that aren't contaminated, with their columns."""
    bad = contamination(docs, benchmark, key, text, **options).where("contaminated").select(F.col("doc_id").alias("_id"), "_key").distinct()
    kept = docs.withColumn("_text_key", F.xxhash64(text)).join(C.small_side(C.cut(bad)), F.col(key).eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left_anti")
    return kept.drop("_text_key")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")).drop("_key")


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWERED}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k + 1 : k + n], ' ') AS words
  FROM (SELECT item_id, w, n, unnest(range(0, len(w) - n + 1)) AS k FROM (SELECT *, least(13, len(w)) AS n FROM b) WHERE n > 0)
),
dw AS (
  SELECT doc_id, n, k, array_to_string(w[k + 1 : k + n], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
),
hits AS (SELECT dw.doc_id, dw.k, dw.n, iw.item_id FROM dw JOIN iw USING (words, n)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS joined FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), '') AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
