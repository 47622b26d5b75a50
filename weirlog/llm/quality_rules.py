"""Quality rules: gradient-boosted trees over document statistics, behind a plain base rule.

One pass over the whole texts yields the statistics; all figures of characters come from one histogram of the text's
bytes. The trees are fitted on the driver to a bounded sample of labelled documents (SAMPLE, those of the least hashes),
flattened into node arrays, and score all documents in batches. Their score may only fall with symbols, repeated lines,
repeated words and capitals, and may only rise with the share of common words.

Defined results: a null or wordless text has zeros and fails the base rule; without labels, or with one class only, the
base rule alone decides; several labels of one id count as the worst of them; rows that repeat id and text share their
verdict; result columns replace input columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog.llm import boosting
from weirlog.llm import common as C
from weirlog.llm.words import WordHashes, shingles

LEAST_WORDS, REPEAT_PERCENT = 50, 50
#: Labelled documents that the trees are fitted to, at most.
SAMPLE = 20_000
#: A document stays if its probability of good quality is at least this.
THRESHOLD = 0.5

#: Common words of the four languages.
COMMON = (
    "the of and to in is it that for was on are with as be by this have from or an at not which but they you we he she his her their has had were will would can all one there been if more when "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man "
    "le la les de des du un une et est en que qui dans pour pas au sur se ne ce il sont avec plus par ou son mais comme on nous vous leur cette aux "
    "el los las que y a se por con no una su para es al lo como más pero sus este ya entre cuando muy sin sobre también me hasta hay donde quien desde todo"
).split()

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_digits", "n_bars", "n_bangs", "n_stops", "n_common"]
#: Features of the trees and their constraints.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1,
    "digit_share": 0, "bar_share": -1, "bang_share": -1, "stop_share": 0, "common_share": 1, "words_per_line": 0,
}


def features(stats: pd.DataFrame) -> np.ndarray:
    s = {c: stats[c].to_numpy(np.float64) for c in BASE + MORE}
    words, chars, lines = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1), np.maximum(s["n_lines"], 1)
    return np.column_stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / chars, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_upper"] / chars,
        s["n_digits"] / chars, s["n_bars"] / words, s["n_bangs"] / words, s["n_stops"] / words, s["n_common"] / words, words / lines,
    ])


_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def common_marks(hashes: WordHashes) -> np.ndarray:
    """Marks of common words by the low 16 bits of their hashes: good enough for a feature."""
    marks = np.zeros(1 << 16, bool)
    marks[hashes.of([w.encode() for w in COMMON]) & np.uint64(0xFFFF)] = True
    return marks


def text_statistics(text: bytes, own: np.ndarray, common: np.ndarray) -> list[int]:
    """BASE + MORE of a text with words; own: the hashes of its words."""
    n, count = len(own), np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if n >= 3:
        _, at, times = np.unique(shingles(own, 3), return_inverse=True, return_counts=True)
        twice = times[at] > 1
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[k : n - 2 + k] |= twice
        repeated = int(hit.sum())
    chars = int(count.sum() - count[0x80:0xC0].sum() - count[9:14].sum() - count[32])
    return [
        n, chars, int(count[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated, len(lines), int(count[65:91].sum()), int(count[48:58].sum()),
        int(count[ord("|")]), int(count[ord("!")]), int(count[ord(".")]), int(common[own & np.uint64(0xFFFF)].sum()),
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """docs(doc_id, key, text) to (doc_id, key, BASE + MORE)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = BASE + MORE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        common = common_marks(hashes)
        for b in batches:
            out = []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                words = text.split() if text else []
                out.append(text_statistics(text, hashes.of(words), common) if words else [0] * len(names))
            table = np.array(out, np.int64).reshape(len(out), len(names))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), *[pa.array(table[:, i].copy()) for i in range(len(names))]], ["doc_id", "key", *names])

    return docs.mapInArrow(run, f"doc_id {kind}, key long, " + ", ".join(f"{c} long" for c in names))


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def train(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> boosting.Trees:
    """Fits the trees to at most `sample` labelled documents that pass the base rule; there are none if these are of one class."""
    labels = labels.where("quality is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("quality"))
    known = stats.where(~base_failed()).join(labels, F.col("doc_id") == F.col("_id")).orderBy(F.xxhash64("doc_id", "key"), "doc_id").limit(sample).toPandas()
    if known["quality"].nunique() < 2:
        known = known[:0]  # one class tells nothing of the other: a score of 0.5
    return boosting.fit(features(known), known["quality"].to_numpy(np.float64), np.array(list(FEATURES.values())))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, _key, statistics, score, base_failed, kept) per row of docs; _key is the hash of its text."""
    stats = C.cut(statistics(docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))))
    trees = train(stats, labels, sample)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(trees.score(features(part)))

    out = stats.withColumn("score", score(F.struct(*BASE, *MORE))).withColumn("base_failed", base_failed())
    passed = F.col("score") >= threshold if len(trees.roots) else F.lit(True)
    return out.withColumn("kept", ~F.col("base_failed") & passed).withColumnRenamed("key", "_key")


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that the rules keep, with their columns."""
    bad = judge(docs, labels, key, text, **options).where("not kept").select(F.col("doc_id").alias("_id"), "_key").distinct()
    same = F.col(key).eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key"))
    return docs.withColumn("_text_key", F.xxhash64(text)).join(C.small_side(C.cut(bad)), same, "left_anti").drop("_text_key")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
    return found.select("doc_id", *BASE, "base_failed", "kept", "score")
