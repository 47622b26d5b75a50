"""Token counts under a unigram vocabulary, with dynamic programming shared in a trie.

Pre-tokens are the words between ASCII white space, each with the vocabulary's word mark in front. Within a task every
distinct pre-token is inserted in a trie. A node holds the forward score of its path, the best sum of piece scores over all
segmentations, and the tokens of that segmentation (the fewest among equal scores), computed once from the nodes above it
when it is made; all words that share a prefix share its nodes. A terminal's count is kept by its word, so a document's
count is a sum of lookups; pre-tokens of more than LONG characters are counted each time, and kept nowhere. A character that no piece covers costs one token per UTF-8 byte.

Nothing is shuffled: texts are large and counts small, so each task counts its own texts; trie and counts start anew when
they reach a fixed number of nodes or bytes of words. The vocabulary comes from a sentencepiece model file whose size is checked.
Defined results: a null or wordless text has no tokens; every row, repeated or not, has a row; input columns n_words and
n_tokens are replaced.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog.llm import common as C

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of a vocabulary file, nodes of a trie, characters of a pre-token that goes into it.
FILE_BYTES, NODES, LONG = 16 << 20, 800_000, 4096
#: Bytes of words whose counts are kept.
WORD_BYTES = 32 << 20
#: How much less than the least score of a piece each byte of an uncovered character scores.
PENALTY = 10.0


def vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces and their scores, without control and byte pieces."""
    import sentencepiece

    if os.path.getsize(path) > FILE_BYTES:
        raise ValueError(f"{path} has more than {FILE_BYTES} bytes")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return {model.id_to_piece(i): model.get_score(i) for i in ordinary}


class Trie(dict):
    """Counts by word, computed over trie nodes; a node's children are found by (node, character)."""

    def __init__(self, pieces: dict[str, float], nodes: int = NODES):
        super().__init__()
        self.pieces, self.nodes = pieces, nodes
        ends: dict[str, set[int]] = {}
        for piece in pieces:
            ends.setdefault(piece[-1], set()).add(len(piece))
        self.sizes = {last: sorted(sizes) for last, sizes in ends.items()}  # of the pieces that end in a character
        self.byte_score = min(pieces.values(), default=0.0) - PENALTY
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.count, self.held = [0.0], [0], 0

    def step(self, text: str, at: int, best: list[float], count: list[int]) -> tuple[float, int]:
        """Forward score and tokens of text[:at] from those of all shorter prefixes."""
        last, pieces = text[at - 1], self.pieces
        size = len(last.encode())
        top, few = best[at - 1] + self.byte_score * size, count[at - 1] + size
        for length in self.sizes.get(last, ()):
            if (start := at - length) < 0:
                break
            score = pieces.get(text[start:at])
            if score is not None:
                total, tokens = best[start] + score, count[start] + 1
                if total > top or (total == top and tokens < few):
                    top, few = total, tokens
        return top, few

    def __missing__(self, word: bytes) -> int:
        text = MARK + word.decode()
        if len(self.best) > self.nodes or len(self) > self.nodes or self.held > WORD_BYTES:
            self.restart()
        best, count, node, shared = [0.0], [0], 0, len(text) <= LONG
        for at in range(1, len(text) + 1):
            edge = (node, text[at - 1])
            known = self.child.get(edge) if shared else None
            if known is None:
                top, few = self.step(text, at, best, count)
                if shared:
                    known = self.child[edge] = len(self.best)
                    self.best.append(top)
                    self.count.append(few)
            else:
                top, few = self.best[known], self.count[known]
            best.append(top)
            count.append(few)
            node = known or 0
        if shared:
            self[word] = count[-1]
            self.held += len(word)
        return count[-1]


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, n_words, n_tokens), a row per row of docs."""
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(path))  # FILE_BYTES at most
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("_text"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Trie(pieces.value)
        for b in batches:
            words = (x.split() if x else [] for x in b.column("_text").cast(pa.binary()).to_pylist())
            found = [(len(w), sum(map(counts.__getitem__, w))) for w in words]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([n for n, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], [key, "n_words", "n_tokens"])

    return rows.mapInArrow(run, f"`{key}` {kind}, n_words long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(C.table(spark, sf_dir, "documents"))
