"""Alignment of the tokens of two tokenizers over one text, by a label per byte.

Each byte has a label: no token ends behind it, one of A does, one of B, or both. An expression scans the labels for spans
up to each label "both", and the count of the labels in a span says how many tokens of A and of B make up the group. The
last tokens of a group end together; these are the links, and a pair of ids counts as often as it is linked in all texts.

Before a space that follows a visible ASCII character, tokens of both always end: A cuts its words there, and no piece of B
has a space behind another character (checked when it is loaded). So a text is the sequence of its segments between such
places. A segment's groups are found once per task for all its occurrences, several segments by one call of either
tokenizer; what is held of them is bounded in bytes. Segments of more than LONG characters are looked at each time.

Links are written as packed numbers, and counts of pairs are summed, first within a task. The most frequent pairs, a fixed
number, are broadcast to look links up; links of other pairs, which are rare, come back by a join.

Defined results: a text that is null or empty, or that tokens of B don't spell out (one with U+2581 in it), has no tokens,
zeros and '' for groups; it adds nothing to counts. Every row, repeated or not, has a row and counts; a null id stays; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog.llm import common as C

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of a tokenizer's file; pairs that are broadcast; characters of a segment that is held; bytes of what is held.
FILE_BYTES, TOP, LONG, HELD = 16 << 20, 1 << 20, 200, 128 << 20
#: Bytes of links that are counted at once.
LINKS = 4 << 20
#: Characters that the tokenizers get at once, where a text has places to cut it at.
AT_ONCE = 8192

#: Bits of a count of a text's tokens.
BITS = 31

CUT = re.compile(r"(?s)(?<=[!-~]) (?=.)")
SPAN = re.compile(rb"[^\x03]*\x03")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on in their order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


#: How the words of a byte-level vocabulary are cut, and the characters whose classes all libraries agree on.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = re.compile("[\0-\u024f]*")


def quick_encoding(a: bytes, letters: dict[str, int]):
    """A's vocabulary in a library that merges whatever makes a token, the least id first, and is three times as fast."""
    import tiktoken

    ranks = {bytes(letters[c] for c in t): i for t, i in json.loads(a)["model"]["vocab"].items() if all(c in letters for c in t)}
    special = {x["content"] for x in json.loads(a)["added_tokens"]}
    return tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks={t: i for t, i in ranks.items() if t.decode("utf-8", "replace") not in special}, special_tokens={})


def quick_is_equal(a: bytes) -> bool:
    """Whether quick_encoding() encodes texts of PLAIN characters as A's own library does.

    It does if the merges are in the order of the tokens' ids and every token's bytes alone are merged to that token: where
    two neighbours x and y make a token t, the merges within t so far are those of t alone, whose next one is then the listed
    one of x and y. Characters are tried one by one in each surrounding, for the cut into words.
    """
    try:
        import tiktoken  # noqa: F401
    except ImportError:
        return False
    from tokenizers import Tokenizer

    found, own = json.loads(a), Tokenizer.from_str(a.decode())
    own.encode_special_tokens = True
    before = found.get("pre_tokenizer") or {}
    if found["model"]["type"] != "BPE" or found.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return False
    vocabulary, merges = found["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in found["model"]["merges"]]
    ids = [vocabulary[x + y] for x, y in merges]
    if ids != sorted(ids) or len(set(ids)) != len(ids) or len(ids) + 256 != len(vocabulary.keys() - {x["content"] for x in found["added_tokens"]}) or min(ids) < 256:
        return False
    if any([t.value for t in own.model.tokenize(x + y)] != [x + y] for x, y in merges):
        return False
    quick = quick_encoding(a, byte_letters())
    tried = [f"{x}{chr(c)}{y}" for c in range(0x250) for x in ("", "a", " ", "1", ".", "  ", "'") for y in ("", "b", " c", "2", "!", "  d")]
    return all(quick.encode_ordinary(t) == e.ids for t, e in zip(tried, own.encode_batch_fast(tried, add_special_tokens=False), strict=True))


class Aligner:
    """Both tokenizers, and what is known of segments: (counts, packed links, groups as text), None where B spells something else.

    A segment is what is between two cuts; each with a space in front makes up the text with a space in front. Counts are of
    tokens of A and, BITS bits above, of B.
    """

    def __init__(self, a: bytes, b: bytes, quick: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a.decode()), sentencepiece.SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.quick = quick_encoding(a, letters) if quick else None
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece with a space behind another character")
        if not set(letters) <= vocabulary.keys():
            raise ValueError("a byte without a token")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.array([len(x) for x in xs], np.int64) for xs in (self.a_bytes, self.b_bytes))
        self.width = len(pieces)
        self.kind = np.dtype(np.uint32 if len(self.a_bytes) * self.width <= 1 << 32 else np.uint64)
        self.a_text, self.b_text = [f"{i}|" for i in range(len(self.a_bytes))], list(map(str, range(self.width)))
        self.known: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}
        self.held = 0

    def found(self, parts: list[str]) -> list[tuple | None] | None:
        """Of segments that all end in a visible ASCII character, but perhaps the last one; None if B spells something else."""
        text = " ".join(parts)
        whole = " " + text
        raw = whole.encode()
        quick = self.quick is not None and PLAIN.fullmatch(text)
        ids_a = self.quick.encode_ordinary(whole) if quick else self.a.encode_batch_fast([whole], add_special_tokens=False)[0].ids
        ids_b = self.b.encode(text)
        ends_a, ends_b = np.cumsum(self.a_length[ids_a]), np.cumsum(self.b_length[ids_b])
        if ends_a[-1] != len(raw) or b"".join(map(self.b_bytes.__getitem__, ids_b)) != raw:  # A has a token for each byte
            return None
        label = np.zeros(len(raw), np.uint8)
        label[ends_a - 1] = 1
        label[ends_b - 1] += 2
        said = label[label > 0]  # bytes behind which no token ends count for nothing
        size = np.fromiter(map(len, SPAN.findall(said.tobytes())), np.int64)
        in_a, in_b = (np.add.reduceat(said != k, np.cumsum(size) - size, dtype=np.int64) for k in (2, 1))
        at_a, at_b = np.cumsum(in_a), np.cumsum(in_b)
        last_a, last_b = np.array(ids_a, np.int64)[at_a - 1], np.array(ids_b, np.int64)[at_b - 1]
        links = (last_a * self.width + last_b).astype(self.kind)
        groups = list(map(str.__add__, map(self.a_text.__getitem__, last_a.tolist()), map(self.b_text.__getitem__, last_b.tolist())))
        several = np.flatnonzero(size > 1)  # all other groups are of a token each
        for k, i, n, j, m in zip(several.tolist(), at_a[several].tolist(), in_a[several].tolist(), at_b[several].tolist(), in_b[several].tolist(), strict=True):
            groups[k] = f"{','.join(map(str, ids_a[i - n : i]))}|{','.join(map(str, ids_b[j - m : j]))}"
        # A segment ends with a group.
        ends = np.searchsorted(np.flatnonzero(label == 3) + 1, np.cumsum([len(p.encode()) + 1 for p in parts])) + 1
        counts = np.diff(at_a[ends - 1] + (at_b[ends - 1] << BITS), prepend=0).tolist()
        to, packed, size = ends.tolist(), links.tobytes(), self.kind.itemsize
        out = [(n, packed[size * i : size * j], groups[i] if j == i + 1 else ";".join(groups[i:j])) for n, i, j in zip(counts, [0, *to[:-1]], to, strict=True)]
        self.held += 300 * len(parts) + 2 * len(raw) + links.nbytes + 12 * len(groups)
        return out

    def learn(self, missing: list[str]) -> None:
        """Finds segments that aren't held, many of them at once."""
        now, size = [], 0

        def done() -> None:
            got = self.found(now)
            if got is None:
                got = [x if x is None else x[0] for x in (self.found([s]) for s in now)]
            self.known.update(zip(now, got, strict=True))
            now.clear()

        for s in sorted(missing, key=lambda s: PLAIN.fullmatch(s) is None) if self.quick else missing:
            if s in self.before:
                self.known[s] = self.before[s]
                self.held += 500
                continue
            if self.quick and len(now) and size > 0 and not PLAIN.fullmatch(s) and PLAIN.fullmatch(now[0]):
                done()
                size = 0
            now.append(s)
            size += len(s)
            if size > AT_ONCE or not "!" <= s[-1:] <= "~":  # what doesn't end visibly can't have another one behind it
                done()
                size = 0
        if now:
            done()

    def of(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, bytes, str] | None]:
        """(tokens of A, of B, groups, packed links, groups as text) of each text, None for those without tokens."""
        parts = [CUT.split(t) if t else [] for t in texts]
        if self.held > HELD // 2:  # what is in use moves on, the rest is forgotten the next time
            self.before, self.known, self.held = self.known, {}, 0
        self.learn([s for s in set().union(*parts) - self.known.keys() if len(s) <= LONG])
        for p in parts:
            try:
                found = list(map(self.known.__getitem__, p))
            except KeyError:  # a long segment
                found = [self.known[s] if len(s) <= LONG else (self.found([s]) or [None])[0] for s in p]
            if not found or None in found:
                yield None
                continue
            n, links, groups = zip(*found, strict=True)
            total, links = sum(n), b"".join(links)
            yield total & (1 << BITS) - 1, total >> BITS, len(links) // self.kind.itemsize, links, ";".join(groups)


def shared(spark: SparkSession, a_file: str, b_file: str):
    """The two files as a broadcast, FILE_BYTES each at most; a task makes the tokenizers of it."""
    data = []
    for path in (a_file, b_file):
        if os.path.getsize(path) > FILE_BYTES:
            raise ValueError(f"{path} has more than {FILE_BYTES} bytes")
        with open(path, "rb") as f:
            data.append(f.read())
    return spark.sparkContext.broadcast((*data, quick_is_equal(data[0])))


def token_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(key, groups) per row: an array of (bytes, a, b), the length of the span and the ids of either tokenizer; null without tokens."""
    files, kind = shared(docs.sparkSession, a_file, b_file), docs.schema[key].dataType.simpleString()
    group = pa.struct({"bytes": pa.int32(), "a": pa.list_(pa.int32()), "b": pa.list_(pa.int32())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Aligner(*files.value)
        for b in batches:
            for k in range(b.num_rows):
                found, out = next(tool.of(b.column("_text").slice(k, 1).to_pylist())), None
                if found:
                    sides = [[list(map(int, x.split(","))) for x in g.split("|")] for g in found[4].split(";")]
                    out = [{"bytes": int(tool.a_length[a].sum()), "a": a, "b": b} for a, b in sides]
                yield pa.RecordBatch.from_arrays([b.column(key).slice(k, 1), pa.array([out], pa.list_(group))], [key, "groups"])

    rows = docs.select(F.col(key).alias(key), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"`{key}` {kind}, groups array<struct<bytes:int,a:array<int>,b:array<int>>>")


def encoded(docs: DataFrame, files) -> DataFrame:
    """Of docs(row, doc_id, text) a row each (row, doc_id, n_a, n_b, n_groups, links, groups_sha256), and rows (pair, cnt) of what tasks counted."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "links", "groups_sha256", "pair", "cnt"]
    types = [pa.int64(), None, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, ids, many, links, sums = Aligner(*files.value), None, 0, [], []

        def add() -> None:
            """Sums up the links at hand, and sums with each other when there are some."""
            sums.append(np.unique(np.frombuffer(b"".join(links), tool.kind), return_counts=True))
            links.clear()
            if len(sums) > 16:
                pairs, where = np.unique(np.concatenate([p for p, _ in sums]), return_inverse=True)
                sums[:] = [(pairs, np.bincount(where, np.concatenate([n for _, n in sums]), len(pairs)).astype(np.int64))]

        def told() -> Iterator[pa.RecordBatch]:
            for pairs, counts in sums:
                none = [pa.nulls(len(pairs), t or ids) for t in types[:-2]]
                yield pa.RecordBatch.from_arrays([*none, pa.array(pairs.astype(np.int64)), pa.array(counts)], names)
            sums.clear()

        for b in batches:
            ids, out = b.column("doc_id").type, []
            for k in range(0, b.num_rows, 64):
                for found in tool.of(b.column("text").slice(k, 64).to_pylist()):
                    if found is None:
                        out.append((0, 0, 0, b"", ""))
                        continue
                    out.append((*found[:4], hashlib.sha256(found[4].encode()).hexdigest()))
                    links.append(found[3])
                    many += len(found[3])
                if many > LINKS:
                    many = add() or 0
                    if sum(len(p) for p, _ in sums) > 4 * TOP:
                        yield from told()
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types[2:7], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), *columns, pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.int64())], names)
        if links:
            add()
        yield from told()

    return docs.mapInArrow(run, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, links binary, groups_sha256 string, pair long, cnt long")


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """(pair, a, b, cnt, best) of encoded() rows: how often ids are linked, and whether no other id of A is linked to b more often."""
    pairs = C.cut(found.where("pair is not null").groupBy("pair").agg(F.sum("cnt").alias("cnt")))
    pairs = pairs.select("pair", F.expr(f"pair div {width}").alias("a"), (F.col("pair") % width).alias("b"), "cnt")
    most = C.cut(pairs.groupBy(F.col("b").alias("_b")).agg(F.max("cnt").alias("_most")))  # a row per id of B at most
    return C.cut(pairs.join(C.small_side(most), F.col("b") == F.col("_b")).select("pair", "a", "b", "cnt", (F.col("cnt") == F.col("_most")).alias("best")))


def looked_up(found: DataFrame, pairs: DataFrame, kind: np.dtype, top: int = TOP) -> DataFrame:
    """encoded() rows with n_links, n_best and count_sum in place of links. The `top` most frequent pairs are broadcast, others joined."""
    taken, least = 0, 1 << 62
    for cnt, n in pairs.groupBy("cnt").count().orderBy(F.desc("cnt")).limit(top).collect():
        if taken + n > top:
            break
        taken, least = taken + n, cnt
    often = pairs.where(F.col("cnt") >= least).select("pair", "cnt", "best").orderBy("pair").toPandas()  # `top` rows at most
    values = found.sparkSession.sparkContext.broadcast(tuple(often[c].to_numpy(t) for c, t in (("pair", kind), ("cnt", np.int64), ("best", np.int64))))
    same = ["row", "doc_id", "n_a", "n_b", "n_groups"]
    id_type = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cnt, best = values.value
        for b in batches:
            out = []
            for x in b.column("links").to_pylist():
                links = np.frombuffer(x, kind)
                at = np.minimum(np.searchsorted(known, links), max(len(known) - 1, 0)) if len(known) else np.zeros(0, np.int64)
                there = known[at] == links if len(known) else np.zeros(len(links), bool)
                at = at[there] if len(known) else at
                out.append((len(links), int(best[at].sum()), int(cnt[at].sum()), links[~there]))
            figures = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*map(b.column, same), *figures, b.column("groups_sha256"), pa.array([r[3] for r in out], pa.list_(pa.int64()))], [*same, "n_links", "n_best", "count_sum", "groups_sha256", "rare"])

    rows = found.where("pair is null").select(*same, "links", "groups_sha256")
    out = rows.mapInArrow(run, f"row long, doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rare array<long>")
    if not pairs.where(F.col("cnt") < least).limit(1).count():
        return out.drop("rare")
    out = C.written(out)  # no pair that is left has more than 1/top of all links
    rare = out.select("row", F.explode("rare").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("times"))
    rare = rare.join(pairs.where(F.col("cnt") < least).select("pair", "cnt", "best"), "pair")
    rare = rare.groupBy(F.col("row").alias("_row")).agg(F.sum(F.col("times") * F.col("cnt")).alias("_sum"), F.sum(F.col("times") * F.col("best").cast("long")).alias("_best"))
    out = out.drop("rare").join(rare, F.col("row") == F.col("_row"), "left")
    return out.withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}).drop("_row", "_sum", "_best")


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", a_file: str = A_FILE, b_file: str = B_FILE, top: int = TOP) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of docs; and pair_counts() of all of them."""
    files = shared(docs.sparkSession, a_file, b_file)
    tool = Aligner(*files.value)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found = C.written(encoded(rows, files))
    pairs = pair_counts(found, tool.width)
    return looked_up(found, pairs, tool.kind, top).drop("row"), pairs


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(C.table(spark, sf_dir, "documents"))[0]
