"""N-gram Jaccard join by T-occurrence search (DivideSkip), and the components of its links.

A document is the set of its distinct 5-word shingles. Linked texts share at least T = ceil(0.8 n) of the n shingles of
either one, so of a global order of all shingles they share at least l(n) among the first n - T + l(n).

1. A pass over the texts counts each set and the shingles that repeat within a task; the most frequent of those, a fixed
   number, come last in the global order, all others follow in the order of their hashes. (Any order gives the same links.)
2. Only those first shingles are shuffled, packed by documents. A shingle that one text alone has leaves here; a text with
   fewer than l(n) shingles left can't have a partner and leaves too. Postings of the frequent shingles are dealt by text
   instead of by shingle; any other shingle has no more postings than all shingles divided by that fixed number.
3. Texts that are left go to blocks: by the shingle of their longest list, split by size so that no block exceeds a fixed
   number of shingles. Texts whose first shingles meet no other's in their block drop out. Each block is searched by itself, together with one text of its shingle that all its blocks share,
   so that a large group of near copies is connected here, over as many blocks as it has.
4. Blocks whose texts are mostly connected with each other have nothing to compare. Only texts that aren't connected with
   most of their block go to the other blocks that share l(n) shingles with them, and between blocks that mostly hold
   different components those texts of one that share as many with the other. Such texts of a block come in parts of a fixed
   number of shingles, and each part meets the block.
5. In a search each text is a query: its inverted lists are divided into short ones, which are merged, and the long ones
   that a result may miss, which are probed by binary search until the overlap is reached or out of reach. (The k-way
   merge is numpy's run-merging sort of the concatenated lists rather than a Python heap.) Texts that links have already
   connected aren't compared again, and only links that connect leave: no pairs of a group are listed.
6. The links' components follow by alternating stars.

Texts are known by the 64-bit hash of the text, so exact copies are one text throughout, shingles by 64-bit hashes too. Defined results: a null text or
one without words has an empty set and is alone, its component is its own id; a text of fewer than five words is one
shingle; repeated rows and ids each get a row; a null id is passed over as a component's least id unless it's the only one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog.llm import common as C
from weirlog.llm.components import components
from weirlog.llm.words import WordHashes, lower_words, shingle_set

SIZE, PERCENT = 5, 80
#: Of the most frequent shingles so many are put last; a hint for the order, not a limit of the search.
FREQUENT = 1 << 18
#: Shingles that a task gathers before it passes them on, postings of one reduce group, shingles of a block of texts.
FLUSH, GROUP, BLOCK = 1_000_000, 500_000, 120_000
#: Occurrences that short lists must show, where the text is long enough.
SHORT = 4


def needed(n: int | np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of n with any set it links to."""
    return -(-n * percent // 100)


def surplus(n: int) -> int:
    return 1 + min(8, n // 20)


def surplus_of(n: Column) -> Column:
    return F.lit(1) + F.least(F.lit(8), F.floor(n / 20))


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def pack_bytes(values: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def unpack_bytes(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, key, n) of every row, and in rows of their own (tok, cnt) for shingles that repeat within a task."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, held, many = WordHashes(), {}, [], 0

        def repeated(ids: pa.DataType) -> pa.RecordBatch:
            toks, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            toks, counts = toks[counts > 1], counts[counts > 1]
            none = lambda t: pa.nulls(len(toks), t)
            return pa.RecordBatch.from_arrays([none(ids), none(pa.int64()), none(pa.int32()), pa.array(toks.view(np.int64)), pa.array(counts.astype(np.int32))], ["doc_id", "key", "n", "tok", "cnt"])

        ids = None
        for b in batches:
            ids, keys, ns = b.column("doc_id"), b.column("key"), []
            for key, text in zip(keys.to_pylist(), _texts(b), strict=True):
                if key not in seen:
                    s = shingle_set(hashes.of(lower_words(text or b"")), size)
                    if len(seen) >= 1_000_000:
                        seen.clear()
                    seen[key] = len(s)
                    held.append(s)
                    many += len(s)
                ns.append(seen[key])
            none = lambda t: pa.nulls(b.num_rows, t)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([ids, keys, pa.array(ns, pa.int32()), none(pa.int64()), none(pa.int32())], ["doc_id", "key", "n", "tok", "cnt"])
            if many >= FLUSH:
                yield repeated(ids.type)
                held, many = [], 0
        if ids is not None:
            yield repeated(ids.type)

    return docs.mapInArrow(run, f"doc_id {id_type}, key long, n int, tok long, cnt int")


#: Marks the number of a frequent shingle among these.
OFTEN = np.uint64(1 << 62)


def prefix_lists(docs: DataFrame, frequent: np.ndarray, times: np.ndarray, parts: int, size: int, percent: int) -> DataFrame:
    """(tok, key, n, m): first shingles of every text that at least one more text has among its first; about m texts have it.

    A shingle is known here by its group and 40 bits of its hash (shingles that share them only add texts to compare), a
    frequent one by its number. Groups from `parts` on hold frequent shingles, dealt by text.
    """
    marks = np.zeros(1 << 20, bool)
    marks[frequent & np.uint64((1 << 20) - 1)] = True
    low = np.uint64((1 << 20) - 1)
    shared = docs.sparkSession.sparkContext.broadcast((frequent, marks, times))  # FREQUENT hashes and counts at most

    def pack(keys: list[int], sets: list[np.ndarray], ns: list[int], late: bool) -> Iterator[pa.RecordBatch]:
        toks, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        keys_of, n_of, out = np.array(keys, np.int64), np.array(ns, np.int32), []
        part = (keys_of.view(np.uint64) % np.uint64(parts))[owner] if late else (toks >> np.uint64(40)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        toks, owner, edges = toks[order], owner[order], np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
        for p in range(parts):
            if (a := edges[p]) < (b := edges[p + 1]):
                own, counts = np.unique(owner[a:b], return_counts=True)
                out.append((p + parts * late, keys_of[own].tobytes(), n_of[own].tobytes(), counts.astype(np.int32).tobytes(), pack_bytes(toks[a:b], 5)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)], ["part", "keys", "ns", "counts", "toks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, held, many = WordHashes(), set(), ([], [], [], []), 0
        often, marked, _ = shared.value
        none = np.zeros(0, np.uint64)

        def passed() -> Iterator[pa.RecordBatch]:
            keys, early, late, ns = held
            if keys:
                yield from pack(keys, early, ns, False)
                yield from pack(keys, late, ns, True)
            for x in held:
                x.clear()

        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), _texts(b), strict=True):
                if key in seen or not (n := len(s := shingle_set(hashes.of(lower_words(text or b"")), size))):
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(key)
                first, late, number = n - int(needed(n, percent)) + surplus(n), marked[s & low], none
                if late.any():
                    at = np.minimum(np.searchsorted(often, s[late]), len(often) - 1)
                    same = often[at] == s[late]
                    late[late] = same
                    s, number = s[~late], at[same].astype(np.uint64)
                for x, v in zip(held, (key, s[:first], number[: max(0, first - len(s))], n), strict=True):
                    x.append(v)
                many += first
                if many >= FLUSH // 4:
                    yield from passed()
                    many = 0
        yield from passed()

    def lists(group: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), kind)
        counts, toks = join("counts", np.int32), unpack_bytes(b"".join(group.column("toks").to_pylist()), 5)
        part = group.column("part")[0].as_py()
        toks |= OFTEN if part >= parts else np.uint64(part) << np.uint64(40)
        key, n = np.repeat(join("keys", np.int64), counts), np.repeat(join("ns", np.int32), counts)
        order = np.argsort(toks, kind="stable")
        toks = toks[order]
        same = np.zeros(len(toks) + 1, bool)
        same[1:-1] = toks[1:] == toks[:-1]
        several = same[1:] | same[:-1] | (part >= parts)
        order, toks = order[several], toks[several]
        key, n = key[order], n[order]
        order = np.lexsort((key, toks))
        toks, key, n = toks[order], key[order], n[order]
        if len(toks):  # a text that several tasks saw counts once
            once = np.r_[True, (toks[1:] != toks[:-1]) | (key[1:] != key[:-1])]
            toks, key, n = toks[once], key[once], n[once]
        _, at, m = np.unique(toks, return_inverse=True, return_counts=True)
        m = m[at] if len(toks) else np.zeros(0, np.int64)
        if part >= parts and len(toks):
            m = shared.value[2][(toks ^ OFTEN).astype(np.int64)]
        keep = m > 1
        return pa.table([pa.array(toks[keep].view(np.int64)), pa.array(key[keep]), pa.array(n[keep]), pa.array(m[keep].astype(np.int32))], ["tok", "key", "n", "m"])

    packed = docs.select("key", "text").mapInArrow(run, "part int, keys binary, ns binary, counts binary, toks binary")
    return packed.groupBy("part").applyInArrow(lists, "tok long, key long, n int, m int")


#: What a text is in a search: one of those compared with each other, one that is looked up, one that looks up.
WITHIN, INDEX, QUERY = 0, 1, 2


def search(percent: int):
    """The T-occurrence search within a group of texts; returns links that connect components (root) which weren't connected."""

    def run(group: pa.Table) -> pa.Table:
        once = np.unique(group.column("key").to_numpy(), return_index=True)[1]  # a text that comes twice
        group = group.take(pa.array(once))
        keys, roots = group.column("key").to_numpy(), group.column("root").to_numpy()
        role = group.column("role").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group.column("toks").to_pylist()]
        within = bool((role == WITHIN).all())
        ns = np.array([len(s) for s in sets], np.int64)
        order = np.lexsort((keys, ns))
        keys, ns, role, roots, sets = keys[order], ns[order], role[order], roots[order], [sets[i] for i in order]
        index = np.arange(len(sets)) if within else np.flatnonzero(role == INDEX)
        queries = np.arange(len(sets)) if within else np.flatnonzero(role == QUERY)
        a, b = [], []
        if len(index) and len(queries) and len(sets) > 1:
            distinct, ids = np.unique(np.concatenate(sets), return_inverse=True)
            ids = np.split(ids.astype(np.int64), np.cumsum(ns)[:-1])
            span = np.int64(len(distinct))
            toks, owner = np.concatenate([ids[i] for i in index]), np.repeat(index, ns[index])
            by = np.argsort(toks, kind="stable")
            postings, start = owner[by], np.searchsorted(toks[by], np.arange(span + 1))
            table = np.sort(owner * span + toks)  # each text's shingles in order: what long lists are probed in
            label = np.unique(roots, return_inverse=True)[1]
            for x in queries:
                n, t = int(ns[x]), int(needed(int(ns[x]), percent))
                length = start[ids[x] + 1] - start[ids[x]]
                mine = ids[x][np.argsort(length, kind="stable")]
                must = min(SHORT, t)
                short, long = mine[: n - t + must], np.sort(mine[n - t + must :])
                merged = np.sort(np.concatenate([postings[start[i] : start[i + 1]] for i in short]), kind="stable")
                found, count = np.unique(merged, return_counts=True)
                other = ns[found]
                fit = (count >= must) & (label[found] != label[x]) & (100 * np.minimum(other, n) >= percent * np.maximum(other, n))
                if within:
                    fit &= found < x
                found, count = found[fit], count[fit]
                want = -(-percent * (n + ns[found]) // (100 + percent))
                for at in range(0, len(long), 64):
                    fit = count + len(long) - at >= want
                    found, count, want = found[fit], count[fit], want[fit]
                    if not len(found):
                        break
                    probe = found[:, None] * span + long[None, at : at + 64]
                    place = np.minimum(np.searchsorted(table, probe.ravel()), len(table) - 1).reshape(probe.shape)
                    count = count + (table[place] == probe).sum(axis=1)
                for y in found[count >= want]:
                    if label[y] != label[x]:
                        label[label == label[y]] = label[x]
                        a.append(keys[x])
                        b.append(keys[y])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def links(docs: DataFrame, seen: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(a, b): text hashes of links that connect all linked texts. docs(doc_id, key, text), seen: its cut profiles()."""
    spark = docs.sparkSession
    often = seen.where("tok is not null").groupBy("tok").agg(F.sum("cnt").alias("cnt"))
    sizes = often.groupBy("cnt").count().orderBy(F.desc("cnt")).limit(10_000).collect()
    taken, least = 0, 1 << 62
    for cnt, rows in sizes:
        if taken + rows > FREQUENT:
            break
        taken, least = taken + rows, cnt
    found = often.where(F.col("cnt") >= least).toPandas()  # FREQUENT at most
    frequent, times = found["tok"].to_numpy(np.int64).view(np.uint64), found["cnt"].to_numpy(np.int64)
    order = np.argsort(frequent)
    frequent, times = (frequent[order], times[order]) if len(found) else (np.zeros(1, np.uint64), np.ones(1, np.int64))
    texts = seen.where("n > 0")
    total = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-total * (105 - percent) // (100 * GROUP)))
    lists = C.written(prefix_lists(docs, frequent, times, parts, size, percent))

    active = lists.groupBy("key", "n").agg(F.count("*").alias("c"), F.max(F.struct("m", "tok")).alias("home"), F.collect_list("tok").alias("toks")).where(F.col("c") >= surplus_of(F.col("n")))
    active = C.cut(active.select("key", "n", F.col("home.tok").alias("home"), "toks"))
    homes = C.cut(active.groupBy("home").agg(F.ceil(F.sum("n") / BLOCK).alias("s"), F.min("key").alias("one")))
    block_of = lambda part: F.xxhash64("home", part.cast("long"))
    blocks = C.cut(active.join(C.small_side(homes), "home").select("key", "n", block_of(F.pmod(F.xxhash64("key"), "s")).alias("block")))
    first = active.select("key", "n", "toks")
    texts = texts.groupBy("key").agg(F.min("doc_id").alias("_id"))  # each text from one of its documents

    # Each block by itself, with the text that the blocks of its shingle share.
    shared = homes.where("s > 1").select(F.col("one").alias("key"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("_part"), "home").select("key", block_of(F.col("_part")).alias("block"))
    members = blocks.select("key", "block").union(shared).distinct()
    members = members.join(members.groupBy("block").count().where("count > 1").select("block"), "block")
    members = members.select("key", F.col("block").alias("target"), F.lit(0).alias("part"), F.lit(WITHIN).alias("role"), F.col("key").alias("root"))
    near = searched(docs, texts, meeting(first, members, percent), size, percent)
    linked = C.small_side(C.cut(components(near)))
    labelled = blocks.join(linked, F.col("key") == F.col("node"), "left").select("key", "n", "block", F.coalesce("root", "key").alias("root"))

    # Where texts of different components share shingles over blocks.
    count = labelled.groupBy("block", "root").agg(F.count("*").alias("c"))
    most = count.groupBy("block").agg(F.max(F.struct("c", "root"))["root"].alias("most"))
    wide = most.groupBy("most").agg(F.count("*").alias("width"))
    most = C.cut(most.join(wide, "most").select("block", "most", "width"))
    labelled = C.cut(labelled.join(C.small_side(most), "block"))
    labelled = labelled.withColumn("own", F.col("root") == F.col("most"))
    postings = C.cut(active.select("key", F.explode("toks").alias("tok")).join(C.small_side(labelled), "key"))
    places = postings.select("tok", F.col("block").alias("other"), F.col("most").alias("other_most"), F.col("width").alias("other_width"), F.col("own").alias("other_own")).distinct()
    several = places.groupBy("tok").agg(F.min("other").alias("a"), F.max("other").alias("b"), F.min("other_most").alias("c"), F.max("other_most").alias("d")).where("a < b").select("tok", (F.col("c") < F.col("d")).alias("mixed"))
    places, several = C.cut(places), C.cut(several)
    # Of two texts that are both outside, the one of the lesser block asks; of one outside and one that isn't, the former.
    outside = postings.where("not own").join(several.select("tok"), "tok").join(places, "tok").where("block < other or (block > other and other_own)")
    # Blocks of the component with fewer of them ask those of the other one; a shingle with one component only asks nothing.
    before = F.struct("width", "most") < F.struct(F.col("other_width").alias("width"), F.col("other_most").alias("most"))
    between = postings.where("own").join(several.where("mixed").select("tok"), "tok").join(places.where("other_own"), "tok").where((F.col("most") != F.col("other_most")) & before)
    columns = ["key", "n", "root", "other", "other_own"]
    asks = outside.select(columns).unionByName(between.select(columns)).groupBy(columns).agg(F.count("*").alias("c")).where(F.col("c") >= surplus_of(F.col("n")))
    asks = C.cut(asks.select("key", "n", "root", F.col("other").alias("target")).distinct())
    loads = C.small_side(C.cut(asks.groupBy("target").agg(F.ceil(F.sum("n") / BLOCK).alias("s"))))
    asking = asks.join(loads, "target").select("key", "target", F.pmod(F.xxhash64("key"), "s").cast("int").alias("part"), F.lit(QUERY).alias("role"), "root")
    # Of a block those texts are asked that share as many shingles with all that ask.
    wanted = postings.join(C.small_side(asks.select("key", "target")), "key").select(F.col("target").alias("block"), "tok").distinct()
    asked = postings.join(wanted, ["block", "tok"]).groupBy("key", "n", "root", "block").agg(F.count("*").alias("c")).where(F.col("c") >= surplus_of(F.col("n")))
    asked = asked.join(loads, F.col("block") == F.col("target")).select("key", "target", F.explode(F.sequence(F.lit(0), F.col("s").cast("int") - 1)).alias("part"), F.lit(INDEX).alias("role"), "root")
    return near.unionByName(searched(docs, texts, meeting(first, asking.unionByName(asked), percent), size, percent))


def candidates(percent: int):
    """Of a group of texts, those whose first shingles have as many in common with another one's as a link needs."""

    def run(group: pa.Table) -> pa.Table:
        keys, at = np.unique(group.column("key").to_numpy(), return_index=True)
        group = group.take(pa.array(at))
        ns, role = group.column("n").to_numpy().astype(np.int64), group.column("role").to_numpy()
        label = np.unique(group.column("root").to_numpy(), return_inverse=True)[1]
        sets = group.column("toks").combine_chunks()
        spare = 1 + np.minimum(8, ns // 20) - needed(ns, percent)  # of n + spare first shingles all but n - overlap are common
        own = np.diff(sets.offsets.to_numpy())
        toks, owner = sets.flatten().to_numpy(), np.repeat(np.arange(len(keys)), own)
        listed = (role != QUERY)[owner]
        order = np.argsort(toks[listed], kind="stable")
        sorted_toks, postings = toks[listed][order], owner[listed][order]
        start, end = np.searchsorted(sorted_toks, toks, "left"), np.searchsorted(sorted_toks, toks, "right")
        edges, keep = np.r_[0, np.cumsum(own)], np.zeros(len(keys), bool)
        for x in np.flatnonzero(role != INDEX):
            spans = range(edges[x], edges[x + 1])
            found, count = np.unique(np.concatenate([postings[start[i] : end[i]] for i in spans]), return_counts=True)
            n, other = ns[x], ns[found]
            overlap = -(-percent * (n + other) // (100 + percent))
            fit = found[(count >= overlap + np.minimum(spare[x], spare[found])) & (label[found] != label[x]) & (100 * np.minimum(other, n) >= percent * np.maximum(other, n))]
            if len(fit):
                keep[x] = True
                keep[fit] = True
        return group.filter(pa.array(keep)).select(["key", "target", "part", "role", "root"])

    return run


def meeting(first: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The members that may have a link in their group, told by first(key, n, toks) alone; whole sets are larger by far."""
    members = first.join(C.small_side(C.cut(members)), "key")
    return members.groupBy("target", "part").applyInArrow(candidates(percent), "key long, target long, part int, role int, root long")


def searched(docs: DataFrame, texts: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): links within the groups (target, part) of members(key, target, part, role, root)."""
    names = ["key", "target", "part", "role", "root"]
    members = C.small_side(C.cut(texts.join(members, "key").withColumnRenamed("key", "_key")))
    met = docs.join(members, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select(*names, "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            found = [shingle_set(hashes.of(lower_words(x)), size).tobytes() for x in _texts(b)]
            yield pa.RecordBatch.from_arrays([*map(b.column, names), pa.array(found, pa.binary())], [*names, "toks"])

    full = met.mapInArrow(sets, "key long, target long, part int, role int, root long, toks binary")
    return C.cut(full.groupBy("target", "part").applyInArrow(search(percent), "a long, b long"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, _key, n_shingles, component_id, _first) of every row; _key is the hash of its text, _first whether it is
    the (id, text) of its component that keep_first() keeps."""
    docs = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    seen = C.written(profiles(docs, size))
    roots = C.small_side(C.cut(components(links(docs, seen, size, percent))))
    rows = seen.where("n is not null").select("doc_id", "key", "n")
    rooted = rows.where("n > 0").join(roots, F.col("key") == F.col("node"), "left").select("doc_id", "key", "n", F.coalesce("root", "key").alias("root"))
    least = rooted.groupBy("root").agg(F.count("*").alias("c"), F.min("doc_id").alias("least_id"), F.min(F.struct(F.isnull("doc_id"), "doc_id", "key")).alias("least")).where("c > 1")
    # Both sides are plain rows here, so Spark may split the partition of a large component.
    rooted = rooted.join(C.small_side(C.cut(least.drop("c").withColumnRenamed("root", "_root"))), F.col("root") == F.col("_root"), "left")
    several = F.col("_root").isNotNull()
    first = ~several | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("key") == F.col("least.key")))
    out = rooted.select("doc_id", F.col("key").alias("_key"), F.col("n").cast("long").alias("n_shingles"), F.when(several, F.col("least_id")).otherwise(F.col("doc_id")).alias("component_id"), first.alias("_first"))
    alone = rows.where("n = 0").select("doc_id", F.col("key").alias("_key"), F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("_first"))
    return out.unionByName(alone)


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component stays, its least id; documents without words all stay. Columns stay as they are."""
    found = C.cut(jaccard_components(docs, key, text, **options).where("n_shingles > 0"))
    gone = C.small_side(C.cut(found.where("not _first").select(F.col("doc_id").alias("_id"), "_key").distinct()))
    kept = docs.withColumn("_text_key", F.xxhash64(text))
    kept = kept.join(gone, F.col(key).eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left_anti")
    again = found.where("_first").groupBy("doc_id", "_key").count().where("count > 1")
    if again.limit(1).count():  # rows that repeat both id and text: one of them stays
        empty = F.coalesce(~F.col(text).rlike(C.WORDS), F.lit(True))
        kept = kept.where(empty).unionByName(kept.where(~empty).dropDuplicates([key, "_text_key"]))
    return kept.drop("_text_key")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(C.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
