"""Token groups of two tokenizers against whole texts encoded one by one."""

import json
import random

import brute
import pytest

from weirlog.llm import alignment

FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def texts(n, seed=1):
    """Blanks of all kinds and places, special tokens' names, byte pieces' names, letters of several scripts, a piece's space mark."""
    rnd = random.Random(seed)
    letters = [*"abcdeEF  \n\t.,'`!?-0123é漢ß😀 ▁|<>/\x00\x1c", "<|endoftext|>", "<s>", "<0x0A>", " the ", "'ll", " don't"]
    made = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(n)]
    return [*made, None, "", " ", "  first", "last  ", "\n\n a", "a  b   c ", "one more", "one more", "x" * 500 + " y" * 300, "a▁b", "日本語の文章" * 60]


def figures(rows):
    return sorted(((r["doc_id"], *[r[c] for c in FIGURES]) for r in rows), key=str)


def wanted(rows):
    return sorted(((i, *x) for (i, _), x in zip(rows, brute.alignments([t for _, t in rows]), strict=True)), key=str)


@pytest.mark.parametrize("top", [alignment.TOP, 40, 0])
def test_random_texts(spark, top):
    """Counts of all pairs, with those that aren't broadcast by a join."""
    rows = [(None if i % 50 == 7 else i // 2, t) for i, t in enumerate(texts(150))]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, links string").repartition(3)
    found, pairs = alignment.align(df, top=top)
    assert figures(found.collect()) == wanted(rows)
    links = [x for f in map(brute.alignment, [t for _, t in rows]) if f for x in f[2]]
    assert {(r["a"], r["b"]): r["cnt"] for r in pairs.collect()} == {x: links.count(x) for x in set(links)}


@pytest.mark.parametrize("quick", [False, True])
def test_segments_at_once(monkeypatch, quick):
    """Cutting, joining and forgetting segments changes nothing, nor does the quick encoder of A's vocabulary."""
    monkeypatch.setattr(alignment, "LONG", 12)
    monkeypatch.setattr(alignment, "AT_ONCE", 30)
    monkeypatch.setattr(alignment, "HELD", 40_000)
    with open(alignment.A_FILE, "rb") as a, open(alignment.B_FILE, "rb") as b:
        tool = alignment.Aligner(a.read(), b.read(), quick)
    rows = texts(400, 2)
    for k in range(0, len(rows), 50):
        for text, found in zip(rows[k : k + 50], tool.of(rows[k : k + 50]), strict=True):
            want = brute.alignment(text)
            assert (found and (*found[:3], found[4])) == (want and (want[0], want[1], len(want[2]), want[3]))


def test_when_the_quick_encoder_is_used():
    """Not for a vocabulary whose ids aren't in the order of its merges, or that cuts words otherwise."""
    with open(alignment.A_FILE, "rb") as f:
        data = f.read()
    assert alignment.quick_is_equal(data)
    for spoil in (lambda x: x["model"]["merges"].reverse(), lambda x: x["model"]["merges"].pop(500), lambda x: x["pre_tokenizer"].update(add_prefix_space=True), lambda x: x["pre_tokenizer"].update(use_regex=False)):
        other = json.loads(data)
        spoil(other)
        assert not alignment.quick_is_equal(json.dumps(other).encode())


def test_groups(spark):
    """The spans make up the text, in order; ids are those of the tokenizers."""
    rows = [(i, t) for i, t in enumerate(texts(30, 3))]
    for r in alignment.token_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = brute.alignment(rows[r["doc_id"]][1])
        if want is None:
            assert r["groups"] is None
            continue
        assert sum(g["bytes"] for g in r["groups"]) == len(rows[r["doc_id"]][1].encode()) + 1
        assert ";".join(f"{','.join(map(str, g['a']))}|{','.join(map(str, g['b']))}" for g in r["groups"]) == want[3]


def test_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert figures(alignment.op12_token_alignment(spark, "/root/testdata/sf0.001").collect()) == wanted(docs)


def test_empty(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0
    assert figures(alignment.align(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string"))[0].collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]
