"""Near-duplicate detection with SuperMinHash signatures, banding, verification on full sets, and union-find grouping.

A document is the set of its distinct 5-word shingles; two link when 100 * intersection >= percent * union.

1. Every element takes the places of a signature in an order of its own (a random permutation that is drawn step by step),
   and has at the j-th place of that order the rank j + r, r from [0, 1). A signature holds the least rank at each place. As an element's
   ranks differ by their whole parts, places are filled more evenly than by independent hashes, which lowers the variance
   of the estimate. Once all places are filled after step j, no later step can be less than what is there, so a text stops
   early: large texts take one or two steps. The steps are taken for many texts at once.
2. ROWS values are a band. Texts that share a band's values are in a bucket. With 32 bands of 5, texts of similarity 0.85
   share no bucket with a probability of 7e-9 (1 - 0.85^5, to the 32nd).
3. A bucket's leader is its text with the most company over all of its buckets, so the buckets of a group of near copies
   mostly have the same one. Texts and their leader go to blocks of bounded size, where links are confirmed on full sets by
   a search that compares only what isn't connected yet; so a large group is connected here, over as many blocks as it has.
4. In buckets where texts of several components are left, those that aren't of the largest one meet all others of the
   bucket: in one block if they fit, else part by part, so no bucket is capped. Buckets with the same texts count once.
5. The confirmed links' components follow by union-find within blocks and alternating stars between them.

Texts are known by the 64-bit hash of the text, so exact copies are one text throughout, and shingles by 64-bit hashes.
Defined results: a null text or one without words has an empty set, links with nothing and is kept; a text of fewer words
is one shingle; repeated rows and ids each get a row; a null id is passed over as a component's least id unless it's the only one; columns
other than id and text don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog.llm import common as C
from weirlog.llm.components import components
from weirlog.llm.jaccard import BLOCK, INDEX, QUERY, SIZE, WITHIN, searched
from weirlog.llm.words import WordHashes, lower_words, shingle_set

PERCENT, BANDS, ROWS = 85, 32, 5
#: Elements whose permutations are held at once; elements whose signatures are found at once.
ELEMENTS, CHUNK = 16_384, 1_000_000

_STEP, _A, _B, _LOW, _32 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xFFFFFFFF), np.uint64(32)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def draws(elements: np.ndarray, step: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each element at a step: which of the places from `step` on it swaps in, and its rank there (whole part above 32 bits)."""
    z = mixed(elements + np.uint64((int(_STEP) * (step + 1)) & (2**64 - 1)))
    return ((z & _LOW) * np.uint64(m - step) >> _32).astype(np.int64) + step, (z >> _32) | np.uint64(step << 32)


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """A row of m least ranks per set; a row of EMPTY for an empty one."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), m), EMPTY)
    flat, elements, owner = out.reshape(-1), np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), sizes)
    first, rank = draws(elements, 0, m)
    np.minimum.at(flat, owner * m + first, rank)
    unfilled = (out == EMPTY).any(axis=1) & (sizes > 0)
    left = np.flatnonzero(unfilled)
    edges, at = np.r_[0, np.cumsum(sizes)], 0
    while at < len(left):  # texts whose places aren't filled yet, some thousand elements at a time
        upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[left[at:]]), ELEMENTS, "right")) + at)
        mine = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in left[at:upto]])
        at = upto
        x, own, k = elements[mine], owner[mine], first[mine]
        rows = np.arange(len(x))
        order = np.tile(np.arange(m, dtype=np.int16), (len(x), 1))
        order[rows, k] = 0  # what the first step has swapped away
        for step in range(1, m):
            k, rank = draws(x, step, m)
            place = order[rows, k]
            order[rows, k] = order[:, step]
            np.minimum.at(flat, own * m + place, rank)
            open_ = (out[own] == EMPTY).any(axis=1) if step < 4 or step % 8 == 0 else None
            if open_ is not None and not open_.all():
                x, own, order = x[open_], own[open_], order[open_]
                rows = np.arange(len(x))
                if not len(x):
                    break
    return out


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash per row and band."""
    values = signature.reshape(len(signature), bands, rows)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, (len(signature), 1))
    for r in range(rows):
        out = mixed(out ^ values[:, :, r]) + _STEP
    return out.view(np.int64)


def profiles(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, n, bands) of every row of docs(doc_id, key, text); bands are null where a task has seen the text before."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), {}
        for b in batches:
            keys, new, sets, many = b.column("key").to_pylist(), {}, [], 0
            found = []

            def finish() -> None:
                found.append(bands_of(signatures(sets, bands * rows), bands, rows))  # noqa: B023
                sets.clear()  # noqa: B023

            if len(seen) >= 1_000_000:
                seen.clear()
            for i, (key, text) in enumerate(zip(keys, b.column("text").cast(pa.binary()).to_pylist(), strict=True)):
                if key not in seen:
                    s = shingle_set(hashes.of(lower_words(text or b"")), size)
                    seen[key] = len(s)
                    if len(s):
                        new[i] = len(new)
                        sets.append(s)
                        many += len(s)
                        if many >= CHUNK:
                            finish()
                            many = 0
            finish()
            lengths = np.r_[0, np.cumsum([bands if i in new else 0 for i in range(len(keys))])].astype(np.int32)
            mask = pa.array([i not in new for i in range(len(keys))])
            lists = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(found).reshape(-1)), mask=mask)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array([seen[k] for k in keys], pa.int32()), lists], ["doc_id", "key", "n", "bands"])

    return docs.mapInArrow(run, f"doc_id {id_type}, key long, n int, bands array<long>")


def fits(n: Column, other: Column, percent: int) -> Column:
    """Whether sets of these sizes can link at all."""
    return F.least(n, other) * 100 >= F.greatest(n, other) * percent


def led(members: DataFrame, percent: int) -> DataFrame:
    """Groups for searched(): each text of members(bucket, key, n) with the leaders of its buckets, in blocks."""
    counts = C.cut(members.groupBy("bucket").agg(F.count("*").alias("g")))
    company = members.join(C.small_side(counts), "bucket").groupBy("key").agg(F.sum("g").alias("company"))
    leaders = members.join(C.small_side(C.cut(company)), "key").groupBy("bucket").agg(F.max(F.struct("company", "key", "n")).alias("l"))
    leaders = C.cut(leaders.select("bucket", F.col("l.key").alias("leader"), F.col("l.n").alias("m")))
    pairs = members.join(C.small_side(leaders), "bucket").where((F.col("key") != F.col("leader")) & fits(F.col("n"), F.col("m"), percent))
    pairs = C.cut(pairs.select("key", "n", "leader").distinct())
    parts = C.cut(pairs.groupBy("leader").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("s")))
    texts = pairs.join(C.small_side(parts), "leader").select("key", F.col("leader").alias("target"), F.pmod(F.xxhash64("key"), "s").cast("int").alias("part"))
    heads = parts.select(F.col("leader").alias("key"), F.col("leader").alias("target"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("part"))
    return texts.unionByName(heads).select("key", "target", "part", F.lit(WITHIN).alias("role"), F.col("key").alias("root"))


def mixing(members: DataFrame, linked: DataFrame) -> DataFrame:
    """Groups for searched(): texts of members(bucket, key, n) whose bucket holds several components of linked(node, root)."""
    rooted = members.join(C.small_side(linked), F.col("key") == F.col("node"), "left").select("bucket", "key", "n", F.coalesce("root", "key").alias("root"))
    sides = rooted.groupBy("bucket", "root").agg(F.sum("n").alias("n"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("key")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("h2"))
    of = sides.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("total"), F.sum("c").alias("c"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.count("*").alias("sides")).where("sides > 1")
    of = of.groupBy("c", "h1", "h2").agg(F.min(F.struct("bucket", "most", "total")).alias("b")).select("b.*")  # once for the same texts
    of = C.cut(of.select("bucket", F.col("most.root").alias("most"), F.col("most.n").alias("held"), "total"))
    whole = F.col("total") <= BLOCK
    of = of.select("bucket", "most", whole.alias("whole"), F.ceil(F.col("held") / BLOCK).cast("int").alias("s"), F.ceil((F.col("total") - F.col("held")) / BLOCK).cast("int").alias("t"))
    rows = C.cut(rooted.join(C.small_side(C.cut(of)), "bucket"))
    put = lambda df, part, role: df.select("key", F.col("bucket").alias("target"), part.cast("int").alias("part"), F.lit(role).alias("role"), "root")
    out = put(rows.where("whole"), F.lit(0), WITHIN)
    # Else: t parts of what isn't of the largest component, each with itself, with those after it and with all s parts of the largest one.
    large = rows.where("not whole")
    own, others = large.where("root = most"), large.where("root <> most")
    mine = lambda n: F.pmod(F.xxhash64("key"), n)
    others = others.withColumn("i", mine(F.col("t")))
    number = lambda a, b: a * (F.col("t") + F.col("s")) + b
    each = lambda df, upto: df.withColumn("j", F.explode(F.sequence(F.lit(0), upto - 1)))
    out = out.unionByName(put(others, number(F.col("i"), F.col("i")), WITHIN))
    pairs = each(others, F.col("t"))
    out = out.unionByName(put(pairs.where("i < j"), number(F.col("i"), F.col("j")), QUERY)).unionByName(put(pairs.where("j < i"), number(F.col("j"), F.col("i")), INDEX))
    out = out.unionByName(put(each(others, F.col("s")), number(F.col("i"), F.col("t") + F.col("j")), QUERY))
    return out.unionByName(put(each(own, F.col("t")), number(F.col("j"), F.col("t") + mine(F.col("s"))), INDEX))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, _key, n_shingles, component_id, kept) of every row; _key is the hash of its text."""
    docs = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    seen = C.written(profiles(docs, size, bands, rows))
    texts = seen.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("_id"))  # each text is read again from one of its documents
    placed = seen.where("bands is not null").select("key", "n", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("bucket")
    members = C.cut(placed.join(C.small_side(C.cut(shared)), "bucket").distinct())

    links = searched(docs, texts, led(members, percent), size, percent)
    linked = C.cut(components(links))
    more = searched(docs, texts, mixing(members, linked), size, percent)
    roots = C.cut(components(links.unionByName(more)))

    found = seen.select("doc_id", "key", "n")
    rooted = found.where("n > 0").join(C.small_side(roots), F.col("key") == F.col("node"), "left").select("doc_id", "key", "n", F.coalesce("root", "key").alias("root"))
    least = rooted.groupBy("root").agg(F.count("*").alias("c"), F.min("doc_id").alias("least")).where("c > 1")
    rooted = rooted.join(C.small_side(C.cut(least.select(F.col("root").alias("_root"), "least"))), F.col("root") == F.col("_root"), "left")
    own = F.when(F.col("_root").isNotNull(), F.col("least")).otherwise(F.col("doc_id"))
    out = rooted.select("doc_id", F.col("key").alias("_key"), F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))
    out = out.unionByName(found.where("n = 0").select("doc_id", F.col("key").alias("_key"), F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that are kept: of each component those with its least id. Columns stay as they are."""
    gone = C.cut(near_duplicates(docs, key, text, **options).where("not kept").select(F.col("doc_id").alias("_id"), "_key").distinct())
    return docs.join(C.small_side(gone), F.col(key).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_key")), "left_anti")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
