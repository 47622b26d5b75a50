"""Quality classifier from weak labels: EM over overlapping heuristic labellers, then a hashed linear scorer.

Two questions are asked of each document, whether its quality is poor and whether it is toxic. For each, labellers vote
1, 0 or abstain (-1) on statistics of the whole text. The votes of all documents are counted by pattern (no more than
3^labellers rows), and expectation-maximisation over the counted patterns estimates the share of positives and each
labeller's accuracy on either class, as if labellers erred independently. What a labeller abstains from says nothing, but
where a labeller never votes one way, its abstention is that vote, as else its accuracy can't be told. Annotators, where
there are any, are one more labeller that abstains from most documents, whose accuracy is given (0.99) rather than estimated.

A document's posterior follows from its pattern. The posteriors of a bounded sample (for each question, SAMPLE documents that
some labeller answers it for, those of the least hashes) train a linear scorer over hashed words and word beginnings: features that differ significantly between
the classes, then a logistic regression on them. Documents from which all labellers of a question abstain have no label and
don't train it. The scorer then reads every whole text, also where no labeller knows the language; a document stays unless
its posterior or its score says yes to a question.

Defined results: a null or wordless text shows no sign of poor quality, and its score is the scorer's bias; several
annotations of one id count as the worst; repeated rows that share id and text share their verdict; an empty table gives
no rows; result columns replace input columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog.llm import common as C
from weirlog.llm.quality_rules import BASE, MORE, common_marks, text_statistics
from weirlog.llm.words import WordHashes, lower_words

SAMPLE, BITS, EM_STEPS = 12_000, 18, 200
#: Standard errors by which a feature's share must differ between the classes to be used, and features used at most.
SIGNIFICANT, FEATURES = 4.0, 2048
#: Steps and penalty (per document) of the logistic regression, and the most that a feature is scaled up.
STEPS, PENALTY, SCALE = 300, 1e-3, 200.0
#: Scores from which the scorer alone answers yes: set on held-out annotations, where lower ones find no more and flag more clean documents.
SURE = {"poor": 0.9, "toxic": 0.15}
#: Leading bytes of a word that make features besides the word.
HEADS = (4, 5, 6, 8)

#: Function words of English; the labellers of insults vote no only on texts that have some.
ENGLISH = "the of and to is it that for are with this have from not which they you we he she his her their were will would can all there been".split()
#: Insults of English, in two lists so that the labellers overlap but aren't the same.
INSULTS_A = "idiot idiots moron morons stupid trash worthless loser losers fool fools dumb pig".split()
INSULTS_B = "scum clown pathetic disgusting jerk ugly garbage imbecile vermin filthy bastard shut hate".split()


ANNOTATORS = "annotators"


def _share(count: str, of: str) -> Column:
    return F.col(count) / F.greatest(F.col(of), F.lit(1))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(-1)


def poor_votes() -> dict[str, Column]:
    """Votes that a document's quality is poor; what lies between a clear yes and a clear no is an abstention.

    Three labellers know a kind of junk each, two look at the words of any text: labellers that saw the same sign twice
    would outvote the others, as EM takes their errors for independent.
    """
    symbols, capitals, repeats, bars = _share("n_symbols", "word_chars"), _share("n_upper", "word_chars"), _share("n_repeat_words", "n_words"), _share("n_bars", "n_words")
    common, bangs, length = _share("n_common", "n_words"), _share("n_bangs", "n_words"), _share("word_chars", "n_words")
    few, again = F.col("n_words") < 20, repeats > 0.2  # texts whose words tell little
    return {
        "symbols": _vote((symbols > 0.03) | (bars > 0.2), (symbols < 0.01) & (bars < 0.05)),
        "shouts": _vote((bangs > 0.1) | ((capitals > 0.3) & ~few), (bangs < 0.03) & (capitals < 0.2)),
        "repeats": _vote(repeats > 0.5, repeats < 0.2),
        "common words": _vote((common < 0.08) & ~few, common.between(0.14, 0.4) & ~again),
        "word length": _vote(~length.between(4.0, 6.5) & ~few, length.between(4.5, 6.0) & ~again),
    }


def toxic_votes() -> dict[str, Column]:
    """Votes that a document is toxic."""
    a, b, hits = F.col("insults_a"), F.col("insults_b"), F.col("n_insults")
    english = _share("n_english", "n_words") > 0.05
    return {
        "insults a": _vote(a > 0, (a == 0) & english),
        "insults b": _vote(b > 0, (b == 0) & english),
        "density": _vote(_share("n_insults", "n_words") > 0.005, (hits == 0) & english),
    }


def em(votes: np.ndarray, counts: np.ndarray, steps: int = EM_STEPS, prior: float = 0.2, start: list[tuple[float, float]] | None = None, given: list[bool] | None = None) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior of each vote pattern, the share of positives, and each labeller's chance to vote right on (0, 1).

    votes: patterns x labellers in -1, 0, 1. Where a labeller has one vote only, its abstention is the other vote. A
    labeller starts out as better than chance (start, on either class), which fixes the classes' meaning; the accuracy of
    those in `given` stays.
    """
    votes, known = votes.copy(), np.array(given or [False] * votes.shape[1])
    for j in np.flatnonzero(~known):
        only = set(np.unique(votes[:, j])) - {-1}
        if len(only) == 1:
            votes[votes[:, j] == -1, j] = 1 - only.pop()
    right = np.array(start or [(0.8, 0.8)] * votes.shape[1], dtype=float).T
    begun = right.copy()
    share, weight, before = prior, counts.astype(float), None
    said1, said0 = votes == 1, votes == 0
    for _ in range(steps):
        log1 = np.log(share) + said1 @ np.log(right[1]) + said0 @ np.log(1 - right[1])
        log0 = np.log(1 - share) + said0 @ np.log(right[0]) + said1 @ np.log(1 - right[0])
        post = 1 / (1 + np.exp(np.clip(log0 - log1, -500, 500)))
        if before is not None and np.abs(post - before).max() < 1e-9:
            break
        before, p, q = post, weight * post, weight * (1 - post)
        share = float(np.clip(p.sum() / max(weight.sum(), 1e-9), 1e-4, 1 - 1e-4))
        smooth = lambda hit, miss: np.clip((hit + 4) / (hit + miss + 5), 0.001, 0.999)
        right = np.where(known, begun, np.stack([smooth(q @ said0, q @ said1), smooth(p @ said1, p @ said0)]))
    return post, share, right


def posterior(docs: DataFrame, votes: dict[str, Column], name: str) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """docs with the posterior of its vote pattern and whether any labeller voted, and the accuracies (on 0, on 1) of the labellers."""
    docs = docs.withColumn("_pattern", F.concat_ws(",", *[v.cast("string") for v in votes.values()]))
    counted = docs.groupBy("_pattern").count().collect()  # at most 3^labellers rows
    if not counted:
        return docs.withColumns({name: F.lit(0.0), f"{name}_said": F.lit(False)}).drop("_pattern"), {}
    table = np.array([[int(v) for v in r["_pattern"].split(",")] for r in counted])
    start = [(0.99, 0.99) if v == ANNOTATORS else (0.95, 0.6) for v in votes]  # heuristics miss more than they invent
    post, _, right = em(table, np.array([r["count"] for r in counted]), start=start, given=[v == ANNOTATORS for v in votes])
    said = (table >= 0).any(axis=1)
    known = docs.sparkSession.createDataFrame([(r["_pattern"], float(p), bool(v)) for r, p, v in zip(counted, post, said, strict=True)], f"_pattern string, `{name}` double, `{name}_said` boolean")
    return docs.join(F.broadcast(known), "_pattern").drop("_pattern"), {v: (float(right[0, i]), float(right[1, i])) for i, v in enumerate(votes)}


def evidence(docs: DataFrame) -> DataFrame:
    """docs(doc_id, key, text) to (doc_id, key, statistics, insults_a, insults_b, n_insults, n_english): counts of distinct
    insults of either list, of words that are insults, and of function words of English. Words are lowered here; quotes and marks around an insult are passed over."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [*BASE, *MORE, "insults_a", "insults_b", "n_insults", "n_english"]
    low = np.uint64((1 << 16) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        common, marks = common_marks(hashes), np.zeros(1 << 16, bool)
        spelled = {f"{a}{w}{b}": w for w in INSULTS_A + INSULTS_B for a in ("", "'", '"', "(") for b in ("", *".,;:!?'\")", "!!", "..", "...")}
        insult = {h: spelled[w] for w, h in zip(spelled, hashes.of([w.encode() for w in spelled]).tolist(), strict=True)}
        marks[np.array(list(insult), np.uint64) & low] = True
        lists, english = (set(INSULTS_A), set(INSULTS_B)), np.zeros(1 << 16, bool)
        english[hashes.of([w.encode() for w in ENGLISH]) & low] = True
        for b in batches:
            out = []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                words = lower_words(text) if text else []
                if not words:
                    out.append([0] * len(names))
                    continue
                own = hashes.of(words)
                said = [insult[h] for h in own[marks[own & low]].tolist() if h in insult]
                out.append([*text_statistics(text, own, common), *[len(x.intersection(said)) for x in lists], len(said), int(english[own & low].sum())])
            table = np.array(out, np.int64).reshape(len(out), len(names))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), *[pa.array(table[:, i].copy()) for i in range(len(names))]], ["doc_id", "key", *names])

    return docs.mapInArrow(run, f"doc_id {kind}, key long, " + ", ".join(f"{c} long" for c in names))


def slots(text: bytes | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text, its lowered words and their beginnings, and their values; the last one is the bias.

    A feature weighs the logarithm of its count, and a text's values have length one.
    """
    words = lower_words(text or b"")
    parts = [hashes.of(words), *[hashes.of([w[:k] for w in words if len(w) > k]) + np.uint64(k) for k in HEADS]]
    at, count = np.unique((np.concatenate(parts) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS), return_counts=True)
    value = 1 + np.log(count)
    value = value / np.sqrt((value**2).sum()) if len(value) else value
    return np.append(at, 1 << BITS).astype(np.int32), np.append(value, 1.0).astype(np.float32)


def logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights of `size` features and the bias, for soft labels y: gradient steps with momentum, bounded by the curvature."""
    n = max(float(weight.sum()), 1.0)
    scale = np.minimum(1 / np.maximum(np.sqrt(np.bincount(cols, values**2, size) / n), 1e-6), SCALE)
    x, penalty = values * scale[cols].astype(np.float32), PENALTY * n
    length = np.bincount(rows, np.abs(x), len(y)) + 1
    curve = np.append(0.25 * np.bincount(cols, np.abs(x) * (length * weight)[rows], size) + penalty, max(0.25 * float((length * weight).sum()), 1e-6))
    now = before = np.append(np.zeros(size), -1.0)
    for k in range(STEPS):
        ahead = now + k / (k + 3) * (now - before)
        miss = weight * (1 / (1 + np.exp(-np.clip(np.bincount(rows, x * ahead[cols], len(y)) + ahead[-1], -30, 30))) - y)
        slope = np.append(np.bincount(cols, x * miss[rows], size) + penalty * ahead[:-1], miss.sum())
        now, before = ahead - slope / curve, now
    return now[:-1] * scale, float(now[-1])


def train(sample: DataFrame, questions: list[str]) -> np.ndarray:
    """Weights (questions, 2^BITS + 1), the last being the bias; sample(slots, values, and per question a posterior and whether it counts).

    A pass counts how often each feature is in either class, as the posteriors weigh documents. The features that differ
    significantly, FEATURES at most, are what the documents are reduced to before 2 * SAMPLE rows of them come to the driver.
    """
    size = (1 << BITS) + 1
    counts = lambda q: F.col(f"{q}_said").cast("double")
    sums = [F.sum(c).alias(f"{q}_{k}") for q in questions for k, c in ((0, (1 - F.col(q)) * counts(q)), (1, F.col(q) * counts(q)))]
    weights = np.zeros((len(questions), size), np.float32)
    total = sample.agg(*sums).first()
    if total[0] is None:
        return weights
    total = np.array(total, dtype=float).reshape(len(questions), 2, 1)
    counted = sample.select(F.explode("slots").alias("slot"), *questions, *[f"{q}_said" for q in questions]).groupBy("slot").agg(*sums).toPandas()  # a row per slot at most
    held = np.zeros((len(questions), 2, size))
    held.reshape(-1, size)[:, counted["slot"].to_numpy()] = counted.drop(columns="slot").to_numpy(float).T
    share, pool = (held + 0.5) / (total + 1), (held.sum(axis=1) + 1) / (total.sum(axis=1) + 2)
    rare = np.sqrt(pool * (1 - pool) * (1 / np.maximum(total, 1)).sum(axis=1)) + 1e-12
    differs = np.abs(share[:, 1] - share[:, 0]) / rare
    differs[:, -1] = 0  # the bias
    best = [np.argsort(-d, kind="stable")[:FEATURES] for d in differs]
    best = [np.sort(b[d[b] > SIGNIFICANT]) for b, d in zip(best, differs, strict=True)]
    chosen = np.unique(np.concatenate(best)).astype(np.int32)
    shape = {"slots": "binary", "values": "binary", **{q: "double" for q in questions}, **{f"{q}_said": "boolean" for q in questions}}

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(size, bool)
        marks[chosen] = True
        for b in batches:
            slots, values = b.column("slots"), b.column("values").flatten().to_numpy()
            at, edges = slots.flatten().to_numpy(), np.r_[0, np.cumsum(slots.value_lengths().to_numpy())]
            keep = marks[at]
            edges = np.r_[0, np.cumsum(keep)][edges]
            parts = [[x[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)] for x in (at[keep], values[keep])]
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.binary()) for x in parts], *[b.column(c) for c in [*shape][2:]]], [*shape])

    known = sample.mapInArrow(reduced, ", ".join(f"`{c}` {t}" for c, t in shape.items())).toPandas()  # 2 * SAMPLE rows at most
    at, values = np.frombuffer(b"".join(known["slots"]), np.int32), np.frombuffer(b"".join(known["values"]), np.float32)
    rows = np.repeat(np.arange(len(known), dtype=np.int32), [len(x) // 4 for x in known["slots"]])
    known = known.drop(columns=["slots", "values"])
    for q, name in enumerate(questions):
        mine = np.isin(at, best[q])
        found, bias = logistic(rows[mine], np.searchsorted(best[q], at[mine]).astype(np.int32), values[mine], known[name].to_numpy(float), known[f"{name}_said"].to_numpy(float), len(best[q]))
        weights[q, best[q]], weights[q, -1] = found, bias
    return weights


QUESTIONS = ["poor", "toxic"]


def classify(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[DataFrame, dict]:
    """(doc_id, _key, poor, toxic: posteriors, poor_score, toxic_score, kept) per row of docs, and the labellers' accuracies.

    labels(doc_id, quality, toxic) are annotations of some documents; kept is false where either question is answered yes.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    seen = evidence(docs)
    if labels is None:
        seen = seen.withColumns({"_poor": F.lit(None).cast("int"), "_toxic": F.lit(None).cast("int")})
    else:
        said = labels.groupBy(F.col("doc_id").alias("_id")).agg((1 - F.min("quality")).alias("_poor"), F.max("toxic").alias("_toxic"))
        seen = seen.join(said, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    seen = C.cut(seen)
    annotated = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(-1))
    seen, right_poor = posterior(seen, {**poor_votes(), ANNOTATORS: annotated("_poor")}, "poor")
    seen, right_toxic = posterior(seen, {**toxic_votes(), ANNOTATORS: annotated("_toxic")}, "toxic")
    more = [f"{q}_said" for q in QUESTIONS]
    seen = C.cut(seen.select("doc_id", "key", *QUESTIONS, *more))

    picked = seen.groupBy("key").agg(*[F.avg(q).alias(q) for q in QUESTIONS], *[F.max(m).alias(m) for m in more], F.min("doc_id").alias("_id"))
    picked = C.cut(picked.where(" or ".join(more)))
    first = lambda m: picked.where(m).orderBy(F.xxhash64("key")).limit(sample).select("key")
    chosen = first(more[0]).union(first(more[1])).distinct()  # of each question those with the least hashes, as many as it may have
    picked = picked.join(F.broadcast(chosen), "key").select(F.col("key").alias("_key"), "_id", *QUESTIONS, *more)
    picked = F.broadcast(C.cut(picked))  # 2 * sample rows at most

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            found = [slots(x, hashes) for x in b.column("text").cast(pa.binary()).to_pylist()]
            packed = [pa.array([x[i] for x in found], pa.list_(t)) for i, t in enumerate((pa.int32(), pa.float32()))]
            yield pa.RecordBatch.from_arrays([b.column("key"), *packed, *[b.column(q) for q in [*QUESTIONS, *more]]], ["key", "slots", "values", *QUESTIONS, *more])

    chosen = docs.join(picked, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("key", "text", *QUESTIONS, *more)
    chosen = chosen.mapInArrow(features, "key long, slots array<int>, values array<float>, poor double, toxic double, poor_said boolean, toxic_said boolean")
    weights = train(C.written(chosen), QUESTIONS)
    given = docs.sparkSession.sparkContext.broadcast(weights)  # of fixed size
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, w = WordHashes(), given.value
        for b in batches:
            out = np.empty((b.num_rows, len(QUESTIONS)))
            for i, x in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                at, value = slots(x, hashes)
                out[i] = 1 / (1 + np.exp(-np.clip(w[:, at] @ value, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), *[pa.array(out[:, q].copy()) for q in range(len(QUESTIONS))]], ["doc_id", "key", "poor_score", "toxic_score"])

    scored = docs.mapInArrow(score, f"doc_id {kind}, key long, poor_score double, toxic_score double")
    known = seen.groupBy("doc_id", "key").agg(F.first("poor").alias("poor"), F.first("toxic").alias("toxic")).withColumnsRenamed({"doc_id": "_id", "key": "_k"})
    out = scored.join(known, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_k")))
    yes = lambda q: (F.col(q) >= 0.5) | (F.col(f"{q}_score") >= SURE[q])
    out = out.select("doc_id", F.col("key").alias("_key"), "poor", "toxic", "poor_score", "toxic_score", (~yes("poor") & ~yes("toxic")).alias("kept"))
    return out, {"poor": right_poor, "toxic": right_toxic}


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))[0].drop("_key")
