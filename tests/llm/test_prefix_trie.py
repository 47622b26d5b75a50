"""The trie of conversation prefixes against a plain one."""

import random

import brute

from weirlog.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, name string, depth int"


def key(row):
    return tuple(-1 if v is None else v for v in row)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "other", 1) for r in rows], SCHEMA)
    got = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.ordered(df)))
    want = brute.trie(brute.rebuilt(rows))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_random_conversations(spark):
    """Nulls in any column, ties, repeated rows, empty texts, negative ids, families with and without their base."""
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 2, 3, 20, 21, 22, 40, 41, 45, None, 60, -3, -21]), rnd.choice([None, 0, 1, 2, 3, 4]), rnd.choice(["u", "a", None]), rnd.choice(["x", "y z", None, ""])) for _ in range(300)]
    check(spark, rows)


def test_long_and_equal_conversations(spark):
    """Copies of a conversation of 100 turns, some that leave it, one of a single turn, one without any after rebuilding."""
    rows = [(100 + i, k, "u", f"same {k}" if k < 37 or i % 3 else f"{i} {k * i}") for i in range(9) for k in range(100)]
    check(spark, [*rows, (500, 0, "u", "alone"), *[(c, 0, "u", "gone") for c in range(301, 309)]])


def test_small_blocks(spark, monkeypatch):
    """Running sums over several blocks of depths, and members in several packs."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "PACK", 50)
    check(spark, [(c, k, "u", f"w {k} " * (1 + c % 2 * (k > 5))) for c in range(40) for k in range(12)])


def test_empty_and_general(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.ordered(none))).collect() == []
    two = spark.createDataFrame([(7, 1, "a", "x y"), (7, 0, "b", "z"), (8, 0, "b", "z")], "c int, n int, r string, t string")
    found = {(r["conv_id"], r["depth"]): (r["n_convs"], r["saved_tokens"], r["n_leaves"]) for r in prefix_trie.prefix_trie(two, "c", "n", "r", "t").collect()}
    assert found == {(7, 0): (2, 1, 1), (7, 1): (2, 1, 1), (7, 2): (1, 0, 1)}
