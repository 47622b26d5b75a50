"""SuperMinHash: signatures against one element after the other, classes against all pairs."""

import random

import brute
import numpy as np
import pytest

from weirlog.llm import minhash


def test_signatures():
    """Sets of all sizes at once give what a plain loop gives; an empty set has an empty signature."""
    rnd = np.random.default_rng(1)
    sets = [rnd.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 7, 40, 300, 0, 900, 3, 64)]
    got = minhash.signatures(sets, 32)

    def draws(e, step):
        k, rank = minhash.draws(np.array([e]), step, 32)
        return int(k[0]), int(rank[0])

    for s, row in zip(sets, got, strict=True):
        assert row.tolist() == [minhash.EMPTY if v is None else v for v in brute.super_minhash(s, 32, draws)]
    assert minhash.signatures([], 8).shape == (0, 8)


def test_estimates():
    """The share of equal places estimates the similarity, and varies less than with independent hashes for small sets."""
    rnd = np.random.default_rng(2)
    m, n, common, found = 64, 40, 30, []
    for _ in range(400):
        x = rnd.integers(0, 2**63, 2 * n - common).astype(np.uint64)
        a, b = minhash.signatures([x[:n], x[n - common :]], m)
        found.append((a == b).mean())
    j = common / (2 * n - common)
    assert np.mean(found) == pytest.approx(j, abs=0.01) and np.var(found) < 0.9 * j * (1 - j) / m


def near(rnd, words, times):
    """A text with so many words exchanged."""
    out = words.split()
    for _ in range(times):
        out[rnd.randrange(len(out))] = rnd.choice("abcdefgh") * 3
    return " ".join(out)


def corpus(seed):
    rnd = random.Random(seed)
    text = lambda n: " ".join(rnd.choice("a b c d e f g h i j k l m n o p q r s t u v w x y z".split()) + rnd.choice("123456789") for _ in range(n))
    base, shared = text(120), text(60)
    out = [base] * 5 + [near(rnd, base, rnd.randrange(5)) for _ in range(60)] + [f"{shared} {text(40)}" for _ in range(40)]
    for _ in range(12):
        own = text(rnd.randrange(1, 90))
        out += [own, near(rnd, own, rnd.randrange(3)), own.upper() + " "]
    return [(i, t) for i, t in enumerate([*out, None, "", " \n", "one", "ONE", "two words"])] + [(None, base), (3, base), (3, None), (None, "nothing like it at all, really")]


def classes(spark, docs, **options):
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in docs], "doc_id long, text string, key string, n int").repartition(3)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, **options).collect()), key=str)


def wanted(rows, percent):
    return sorted(((i, n, c, i == c) for (i, _), (n, c) in zip(rows, brute.components(rows, percent=percent), strict=True)), key=str)


def test_classes(spark):
    rows = corpus(5)
    assert classes(spark, rows) == wanted(rows, 85)


def test_blocks_in_parts(spark, monkeypatch):
    """Groups that are larger than a block lose no link; nor do buckets of several components that are."""
    monkeypatch.setattr(minhash, "BLOCK", 600)
    rows = corpus(6)
    assert classes(spark, rows, percent=60, bands=40, rows=3) == wanted(rows, 60)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.op11_minhash(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == wanted(rows, 85)
    assert sorted(r["doc_id"] for r in minhash.keep_first(docs).collect()) == sorted(r[0] for r in got if r[3])


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(none).count() == 0 and minhash.keep_first(none).columns == ["doc_id", "text"]
    alone = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(alone).drop("_key").collect()), key=str) == [(1, 0, 1, True), (None, 0, None, True)]
