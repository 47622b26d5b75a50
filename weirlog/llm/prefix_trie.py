"""A trie of conversation prefixes by prefix-doubling names.

Turns get dense names (equal role and text, equal name). Then blocks of 2, 4, 8, ... turns that begin at a multiple of their
length are named, a join round per length: a block's name stands for the pair of its halves' names. A prefix of d turns
consists of one block per binary digit of d; prefixes are composed of these, a join round per further digit. Prefixes of
one depth have one name if and only if they are equal, so grouping by (depth, name) gives the nodes of the trie.

A node is known by its least conversation and its depth. The nodes of which a conversation is the least are a run of
depths down to its end, a path; so whatever concerns a subtree is a sum over the members of its top of one figure per path,
less what lies above on the path of the top itself. No walk over levels of the tree is needed, and no group's rows meet in
one task: counts and sums are partial aggregates, running sums go over blocks of depths, and the members that end in a node
are packed in order by many tasks before one goes over the packs.

Defined results: rows without a conversation id belong to none and are left out; a null role or text is empty; a null turn
comes first; turns that tie are ordered by role and text, repeated rows are turns of their own; other columns don't matter;
an empty table has no nodes, not even a root. Turns are told apart by the SHA-256 of role and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirlog.llm import common as C

#: Depths of a path whose running sums are found in one go; bytes of ids in a pack.
BLOCK, PACK = 4096, 1 << 16


def ordered(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, sym, words) of each message, narrow: place from 0, digest of role and text, words of the text."""
    rows = messages.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    ties = C.cut(rows.groupBy("conv", "turn").count().where("count > 1").select(F.col("conv").alias("_tc"), F.col("turn").alias("_tt"), F.lit(True).alias("_tied")))
    rows = rows.join(C.small_side(ties), (F.col("conv") == F.col("_tc")) & F.col("turn").eqNullSafe(F.col("_tt")), "left")
    sym = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(" "), "role", "text"), 256))
    tie = F.when(F.col("_tied"), F.struct("role", "text"))  # only turns that tie carry their text
    placed, _ = C.ranked(rows.select("conv", "turn", tie.alias("tie"), sym.alias("sym"), C.n_words(F.col("text")).alias("words")), "conv", [F.col("turn").asc_nulls_first(), F.col("tie").asc_nulls_first()])
    return C.written(placed.select("conv", F.col("_rank").cast("long").alias("pos"), "sym", "words"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversation c as the first h turns of c - c % 20 and its own ones after its first h, h = crc32(c) % 4; and all c."""
    convs = C.cut(turns.select("conv").distinct())
    ahead = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 4
    bases = turns.where("conv % 20 = 0 and pos < 3")
    lengths = bases.groupBy("conv").agg(F.count("*").alias("n")).withColumnRenamed("conv", "_base")  # three at most
    family = convs.select("conv", ahead("conv").alias("h"), (F.col("conv") - F.col("conv") % 20).alias("_of"))
    family = C.cut(family.join(C.small_side(C.cut(lengths)), F.col("_of") == F.col("_base"), "left").select("conv", "h", "_of", F.least("h", F.coalesce("n", F.lit(0))).alias("taken")))
    heads = bases.withColumnRenamed("conv", "_base").join(family, (F.col("_of") == F.col("_base")) & (F.col("pos") < F.col("h"))).select("conv", "pos", "sym", "words")
    own = turns.join(C.small_side(family.withColumnRenamed("conv", "_conv")), F.col("conv") == F.col("_conv")).where(F.col("pos") >= F.col("h"))
    return heads.unionByName(own.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "sym", "words")), convs


def dense(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys with a name from 0 on without gaps: numbers within tasks, and one small row per task before them."""
    found = C.cut(rows.select(keys).distinct().withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted((r["p"], r["n"]) for r in found.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row per task
    starts, before = [], 0
    for p, n in sizes:
        starts.append((p, before - (p << 33)))
        before += n
    first = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part long, _first long"))
    return found.join(first, part == F.col("_part")).select(*[F.col(k).alias(f"_{k}") for k in keys], (F.col("_at") + F.col("_first")).alias("name"))


def named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the dense name of their keys in place of the keys."""
    names = dense(rows, keys)
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    return rows.join(C.small_side(C.cut(names)), same).select(*[c for c in rows.columns if c not in ("l", "r", "sym")], "name")


def blocks(turns: DataFrame) -> list[DataFrame]:
    """Per level k: (conv, start, words of the last turn, name) of the blocks of 2^k turns."""
    now = C.written(named(turns.withColumnRenamed("pos", "start"), ["sym"]))
    out, longest, k = [now], (now.agg(F.max("start")).first()[0] or 0) + 1, 1
    while longest >> k:
        odd = F.shiftright("start", k - 1) % 2 == 1
        pairs = now.groupBy("conv", F.shiftleft(F.shiftright("start", k), k).alias("start")).agg(F.max(F.when(odd, F.col("words"))).alias("words"), F.max(F.when(~odd, F.col("name"))).alias("l"), F.max(F.when(odd, F.col("name"))).alias("r"))
        now = C.written(named(C.cut(pairs.where("l is not null and r is not null")), ["l", "r"]))
        out.append(now)
        k += 1
    return out


def prefixes(levels: list[DataFrame]) -> DataFrame:
    """(conv, depth, words, name) of every prefix of one turn or more."""
    first, later = [], []
    for k, b in enumerate(levels):
        first.append(b.where("start = 0").select("conv", F.lit(1 << k).cast("long").alias("depth"), "words", "name"))
        # Blocks that may follow: their start has a binary digit of its own above their length.
        later.append(b.where((F.col("start") > 0) & (F.col("start") % (2 << k) == 0)).select("conv", F.col("start").alias("_start"), F.lit(1 << k).cast("long").alias("_size"), F.col("words").alias("_words"), F.col("name").alias("r")))
    union = lambda parts: parts[0] if len(parts) == 1 else union([a.unionByName(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) & ~1 :])
    now, later = union(first), C.written(union(later))
    out = [now]
    for _ in range(len(levels) - 1):
        step = now.withColumnRenamed("conv", "_conv").join(later, (F.col("_conv") == F.col("conv")) & (F.col("depth") == F.col("_start")))
        step = C.cut(step.select("conv", (F.col("depth") + F.col("_size")).alias("depth"), F.col("_words").alias("words"), F.col("name").alias("l"), "r"))
        now = C.written(named(step, ["depth", "l", "r"]).select("conv", "depth", "words", "name"))
        out.append(now)
    return union(out)


def digests(ends: DataFrame) -> DataFrame:
    """(depth, name, ends_sha256) of ends(depth, name, conv): the ids in order, joined by commas.

    Tasks pack ids of a node in order, then one goes over a node's packs and keeps nothing but the state of the hash.
    """
    keys = ["depth", "name"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size, done = None, [], 0, []
        schema = ["depth", "name", "first", "ids"]
        flat = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], schema)
        for b in batches:
            for depth, name, conv in zip(*(b.column(c).to_pylist() for c in (*keys, "conv")), strict=True):
                if held and ((depth, name) != at or size > PACK):
                    done.append((*at, held[0], ",".join(map(str, held))))
                    held, size = [], 0
                at = (depth, name)
                held.append(conv)
                size += 20
            if done:
                yield flat(done)
                done = []
        if held:
            yield flat([(*at, held[0], ",".join(map(str, held)))])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done = None, None, []
        flat = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], [*keys, "ends_sha256"])
        for b in batches:
            for depth, name, ids in zip(*(b.column(c).to_pylist() for c in (*keys, "ids")), strict=True):
                if (depth, name) != at:
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = (depth, name), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield flat(done)
                done = []
        if at is not None:
            yield flat([(*at, state.hexdigest())])

    packed = ends.repartitionByRange(*keys, "conv").sortWithinPartitions(*keys, "conv").select(*keys, "conv").mapInArrow(pack, "depth long, name long, first long, ids string")
    return packed.repartition(*keys).sortWithinPartitions(*keys, "first").select(*keys, "ids").mapInArrow(chain, "depth long, name long, ends_sha256 string")


def before(nodes: DataFrame) -> DataFrame:
    """nodes(conv, depth, gain, ...) with `above`, the gain of the nodes of the same path that are less deep."""
    nodes = nodes.withColumn("_block", F.floor(F.col("depth") / BLOCK))
    near = F.sum("gain").over(Window.partitionBy("conv", "_block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1))
    totals = nodes.groupBy("conv", "_block").agg(F.sum("gain").alias("_gain"))
    far = F.sum("_gain").over(Window.partitionBy("conv").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.withColumn("_far", far).where("_far is not null").select(F.col("conv").alias("_c"), F.col("_block").alias("_b"), "_far")
    out = nodes.withColumn("_near", near).join(totals, (F.col("conv") == F.col("_c")) & (F.col("_block") == F.col("_b")), "left")
    return out.withColumn("above", F.coalesce("_near", F.lit(0)) + F.coalesce("_far", F.lit(0))).drop("_block", "_near", "_far", "_c", "_b")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of turns(conv, pos, sym, words) of the cut ids convs(conv), which are integers; see prefix_trie()."""
    empty = hashlib.sha256(b"").hexdigest()
    all_ = prefixes(blocks(C.written(turns)))
    nodes = C.cut(all_.groupBy("depth", "name").agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.max("words").alias("words")))
    nodes = nodes.withColumn("gain", F.col("words") * (F.col("n") - 1))

    # Paths: a run of depths per least conversation; the first node of each hangs on a node of another path, or on the root.
    paths = C.cut(nodes.groupBy("conv").agg(F.min("depth").alias("top"), F.max("depth").alias("last"), F.sum("gain").alias("gain")))
    hung = paths.where("top > 1").select(F.col("conv").alias("path"), (F.col("top") - 1).alias("at"))
    hung = all_.select("conv", "depth", "name").join(hung, (F.col("conv") == F.col("path")) & (F.col("depth") == F.col("at"))).select("path", "depth", "name")
    hung = C.cut(hung.join(nodes.select("depth", "name", F.col("conv").alias("up")), ["depth", "name"]).select("path", "up", "depth"))
    more = C.cut(hung.groupBy(F.col("up").alias("_up"), F.col("depth").alias("_at")).agg(F.count("*").alias("branches")))
    ends = paths.join(more, (F.col("conv") == F.col("_up")) & (F.col("last") == F.col("_at")), "left_anti").select(F.col("conv").alias("_leaf"))
    sums = C.cut(paths.join(ends, F.col("conv") == F.col("_leaf"), "left").select(F.col("conv").alias("_path"), F.col("gain").alias("_gain"), F.col("_leaf").isNotNull().cast("long").alias("_leaves")).where("_gain > 0 or _leaves > 0"))
    below = all_.join(C.small_side(sums), F.col("conv") == F.col("_path")).groupBy(F.col("depth").alias("_d"), F.col("name").alias("_n")).agg(F.sum("_gain").alias("all_gain"), F.sum("_leaves").alias("n_leaves"))

    last = all_.groupBy("conv").agg(F.max(F.struct("depth", "name")).alias("end")).select("conv", "end.*")
    ended = C.cut(digests(last).withColumnsRenamed({"depth": "_ed", "name": "_en"}))
    # The root, and its figures as scalars: all that lies below it is counted already.
    least, members = convs.agg(F.min("conv"), F.count("*")).first()
    down, gain = paths.agg(F.count_if(F.col("top") == 1), F.coalesce(F.sum("gain"), F.lit(0))).first()
    bare = convs.join(last.select(F.col("conv").alias("_has")), F.col("conv") == F.col("_has"), "left_anti").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"), "conv")
    of_bare = digests(bare).first()  # one node's at most
    root = [(least, 0, None, members, down, max(ends.count(), 1), gain, of_bare["ends_sha256"] if of_bare else empty)] if members else []
    root = convs.sparkSession.createDataFrame(root, "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")

    out = before(nodes).join(paths.select(F.col("conv").alias("_pc"), "top", "last"), F.col("conv") == F.col("_pc"))
    out = out.join(hung.select(F.col("path").alias("_path"), "up"), (F.col("conv") == F.col("_path")) & (F.col("depth") == F.col("top")), "left")
    out = out.join(more, (F.col("conv") == F.col("_up")) & (F.col("depth") == F.col("_at")), "left")
    out = out.join(below, (F.col("depth") == F.col("_d")) & (F.col("name") == F.col("_n")), "left").join(ended, (F.col("depth") == F.col("_ed")) & (F.col("name") == F.col("_en")), "left")
    parent = F.when(F.col("depth") > F.col("top"), F.col("conv")).when(F.col("depth") > 1, F.col("up")).otherwise(F.lit(least))
    children = F.coalesce("branches", F.lit(0)) + (F.col("depth") < F.col("last")).cast("long")
    return root.unionByName(out.select(
        F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), children.alias("n_children"), F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"),
        (F.coalesce("all_gain", F.lit(0)) - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    ))


def prefix_trie(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the trie of
    all conversations; ids are integers. The node's turns are the first `depth` ones of conversation conv_id."""
    turns = ordered(messages, conv, turn, role, text)
    return trie(turns, C.cut(turns.select("conv").distinct()))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(ordered(C.table(spark, sf_dir, "conversations"))))


ORACLE = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([CAST(n AS UBIGINT)], CAST(range(8) AS UBIGINT[])), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
),
own AS (
  SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
ahead AS (
  SELECT c, l, CAST(xor(list_reduce(
    list_concat([CAST(4294967295 AS UBIGINT)], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS UBIGINT))), lambda a, b: xor(a >> 8, t[CAST(xor(a & 255, b) AS BIGINT) + 1])
  ), 4294967295) % 4 AS BIGINT) AS h FROM own, crc
),
built AS (SELECT a.c, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) AS l FROM ahead a LEFT JOIN own b ON b.c = a.c - a.c % 20),
prefixes AS (SELECT c, l, unnest(range(len(l) + 1)) AS depth FROM built),
nodes AS (SELECT l[1:depth] AS p, depth, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(l) = depth), '')) AS ends_sha256 FROM prefixes GROUP BY ALL),
children AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
figures AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.p[n.depth].text, '[^\x20\x09-\x0D]+')) END AS gain
  FROM nodes n LEFT JOIN children USING (p, depth)
),
under AS (SELECT p, depth, n_children, gain, unnest(range(depth + 1)) AS top FROM figures),
sums AS (SELECT p[1:top] AS p, top AS depth, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(gain) AS BIGINT) AS saved_tokens FROM under GROUP BY ALL)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM figures f JOIN sums s USING (p, depth) LEFT JOIN nodes u ON f.depth > 0 AND u.depth = f.depth - 1 AND u.p = f.p[1:f.depth - 1]
"""
