"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `points` arcs of a ring; a document's place on the ring comes from its id. A shard takes no more than its
bound, the total split evenly to within one row, and the rows that a full shard can't take go on clockwise to the next
arc whose shard has room. Only the counts of arcs (shards x points of them) come to the driver; the walk over them yields
pieces (arc, ranks from, to, shard, first slot), and each row finds its piece from its rank within its arc.

Law: rows, so counts are at most one apart whatever the ids, also where one id holds a third of all rows. Defined results:
a null text has size 16 and the checksum of no bytes (0); a null id is an id; repeated rows are rows of their own; an empty
table gives no rows; the result's columns replace input columns of their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirlog.llm import common as C

SHARDS, POINTS = 40, 64
PIECES = T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]))


def ring(shards: int = SHARDS, points: int = POINTS) -> tuple[list[int], list[int]]:
    """Sorted ends of the arcs, in 0 .. 2^63, and the shard that owns each."""
    ends = sorted((int.from_bytes(hashlib.sha256(f"{s}/{p}".encode()).digest()[:8], "big") >> 1, s) for s in range(shards) for p in range(points))
    return [e for e, _ in ends], [s for _, s in ends]


def cells(spark: SparkSession, ends: list[int]) -> tuple[DataFrame, int]:
    """(_cell, _ends, _first): the ring in 2^bits equal cells with the ends in each and the arc of its beginning; and 63 - bits.

    A place's arc is its cell's first one plus the ends of the cell that lie before it, so an equi-join and a short
    array find it. The table has no more rows than twice the arcs and is broadcast.
    """
    shift = 63 - len(ends).bit_length()
    rows = []
    for cell in range(1 << (63 - shift)):
        first, last = bisect_left(ends, cell << shift), bisect_left(ends, (cell + 1) << shift)
        rows.append((cell, ends[first:last], first))
    return spark.createDataFrame(rows, "_cell long, _ends array<long>, _first int"), shift


def bounds(total: int, shards: int) -> list[int]:
    """Rows that each shard takes at most; they add up to the total."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def walk(counts: list[int], owners: list[int], shards: int) -> list[list[tuple[int, int, int, int]]]:
    """Pieces (from, to, shard, first slot) of each arc: own shards first, then what is over goes on clockwise."""
    room, filled = bounds(sum(counts), shards), [0] * shards
    pieces: list[list[tuple[int, int, int, int]]] = [[] for _ in counts]

    def put(arc: int, at: int, shard: int) -> int:
        take = min(counts[arc] - at, room[shard] - filled[shard])
        if take > 0:
            pieces[arc].append((at, at + take, shard, filled[shard]))
            filled[shard] += take
        return at + max(take, 0)

    placed = [put(arc, 0, owners[arc]) for arc in range(len(counts))]
    for arc, at in enumerate(placed):
        step = arc
        while at < counts[arc]:
            step = (step + 1) % len(counts)
            at = put(arc, at, owners[step])
    return pieces


def assign(docs: DataFrame, shards: int = SHARDS, points: int = POINTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document with size, text_crc32, law, shard, slot, grown_shard, and KEY, the hashes of all its columns."""
    ends, owners = ring(shards, points)
    table, shift = cells(docs.sparkSession, ends)
    rows = docs.select(
        F.col(f"`{key}`").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(F.col(f"`{key}`")).bitwiseAND(F.lit((1 << 63) - 1)).alias("_at_ring"), *C.row_keys(docs),
    )
    rows = rows.withColumn("_cell", F.shiftright("_at_ring", shift)).join(F.broadcast(table), "_cell")  # bounded by the ring
    arc = (F.col("_first") + F.size(F.filter("_ends", lambda e: e < F.col("_at_ring")))) % len(ends)
    rows = rows.withColumn("_arc", arc.cast("int")).drop("_cell", "_ends", "_first")
    rows, groups = C.ranked(rows, "_arc", [F.col(c).asc() for c in ("_at_ring", "doc_id", *C.KEY)])
    counts = [0] * len(owners)
    for arc, n in groups.select("_arc", "_n").collect():  # no more rows than the ring has arcs
        counts[arc] = n
    schema = T.StructType([T.StructField("_arc", T.IntegerType()), T.StructField("_pieces", PIECES)])
    pieces = docs.sparkSession.createDataFrame([(arc, p) for arc, p in enumerate(walk(counts, owners, shards)) if p], schema)
    rows = rows.join(F.broadcast(pieces), "_arc")  # bounded by shards x points
    rows = rows.withColumn("_piece", F.filter("_pieces", lambda p: (p["from"] <= F.col("_rank")) & (F.col("_rank") < p["to"]))[0])
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_piece.shard").alias("shard"),
        (F.col("_piece.slot") + F.col("_rank") - F.col("_piece.from")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *C.KEY,
    )


def shard(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents with their shard and slot, ready to be written by shard. Places are found on narrow rows."""
    found = C.cut(assign(docs, key=key, **options).select("doc_id", *C.KEY, "shard", "slot"))
    return C.rejoin(docs, found, key, C.repeats(found))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(C.table(spark, sf_dir, "documents").select("doc_id", "text")).drop(*C.KEY)
