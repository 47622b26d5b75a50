"""Dedup, similarity, contamination, counts: against brute force, with odd rows in every column."""

import hashlib
import random

import brute
import pytest
from pyspark.sql import functions as F

from weirlog.llm import decontaminate, jaccard, line_dedup, quality_rules, token_counts
from weirlog.llm.components import components

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, size string, key string, n_words string"  # some names clash


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "s", "x", "y", "z") for i, t in docs], SCHEMA)


def near(rnd, words, n):
    w = list(words)
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def odd():
    """Groups of near copies around the threshold, a passage in many texts, copies, short, empty and null texts, a long one."""
    rnd, docs = random.Random(3), []
    passage = " ".join(f"shared{i}" for i in range(60))
    for g in range(4):
        base = [f"w{g}x{rnd.randrange(400)}" for _ in range(rnd.choice([30, 80, 150]))]
        docs += [near(rnd, base, rnd.randrange(0, 5)) for _ in range(12)]
    docs += [f"{passage} " + " ".join(f"own{i}x{k}" for k in range(rnd.randrange(1, 90))) for i in range(25)]
    docs += ["a b c", "A b  c", "a b c d", "", None, " \n ", "one", "one", "Été a b", "x" * 5000, " ".join(f"t{k % 977}" for k in range(20_000))]
    docs = [(i, t) for i, t in enumerate(docs)]
    return docs + [(None, "null id text with five words"), (None, None), (3, docs[3][1]), (3, docs[3][1]), (7, "another text under seven")]


def test_jaccard(spark, odd):
    got = jaccard.jaccard_components(frame(spark, odd))
    assert sorted(map(str, [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()])) == sorted(map(str, [(d, n, c) for (d, _), (n, c) in zip(odd, brute.components(odd), strict=True)]))
    assert jaccard.jaccard_components(frame(spark, []).limit(0)).count() == 0


def test_first_shingles_of_linked_texts_meet():
    """k common shingles are among the first of both for k up to the lesser of two bounds: it is never below either surplus."""
    for n in range(1, 1500):
        for m in range(-(-n * 80 // 100), n + 1):
            overlap = -(-80 * (n + m) // 180)
            if overlap <= m:
                common = min(overlap - jaccard.needed(x, 80) + jaccard.surplus(x) for x in (n, m))
                assert common >= max(jaccard.surplus(n), jaccard.surplus(m)), (n, m)


def test_jaccard_in_small_blocks(spark, monkeypatch):
    """Groups of near copies over many blocks, some of whose texts only link across blocks, with frequent shingles and without."""
    rnd, texts = random.Random(11), []
    for g in range(3):
        base = [f"b{g}x{k}" for k in range(60)]
        texts += [near(rnd, base, rnd.randrange(0, 6)) for _ in range(40)]
        chain = list(base)
        for step in range(12):  # each links with the one before it only
            chain[5 * step % 60] = f"chain{g}s{step}"
            texts.append(" ".join(chain))
    texts += [" ".join([f"b{i % 3}x{k}" for k in range(25)] + [f"u{i}x{k}" for k in range(25)]) for i in range(30)]
    docs = [(i, t) for i, t in enumerate(texts)]
    want = sorted((d, *x) for (d, _), x in zip(docs, brute.components(docs), strict=True))
    for block, frequent in ((300, 50), (300, 1 << 18), (5000, 50)):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "FREQUENT", frequent)
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(frame(spark, docs)).collect())
        assert got == want, (block, frequent)


def test_keep_first(spark, odd):
    docs = frame(spark, odd)
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    with_words = [r for r in kept.collect() if r["text"] and r["text"].strip()]
    assert len(with_words) == brute.components(odd, roots=True)
    assert kept.where("text is null or trim(translate(text, '\n', '')) = ''").count() == sum(1 for _, t in odd if not t or not t.strip())


def test_jaccard_on_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.op9_jaccard_join(spark, DATA).collect()}
    assert got == {d: x for (d, _), x in zip(docs, brute.components(docs), strict=True)}


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(1, 20)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(70):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark, odd):
    words = [f"q{i}" for i in range(40)]
    items = [(1, " ".join(words[:20])), (2, " ".join(words[5:30])), (10, "Tiny item"), (11, ""), (12, None), (13, " ".join(words[:20])), (14, "one"), (None, " ".join(words[:13]))]
    docs = odd + [
        (900, " ".join(["pad"] * 30 + words + ["pad"] * 30)), (901, "x " + ", ".join(words[:13]).upper()), (902, " ".join(words[:12])), (903, "a tiny ITEM here"),
        (904, " ".join(words[:20] + words[5:30])), (905, " ".join(["pad"] * 500 + words[3:16])), (None, " ".join(words[:14])), (906, " ".join(words[:14])), (906, " ".join(words[:14])),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [(d, n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), c) for (d, _), (n, h, f, c) in zip(docs, brute.contamination(docs, items), strict=True)]
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for filtered in (2_000_000, 0):  # with the filter of shingles, and by the joins alone
        old, decontaminate.FILTER = decontaminate.FILTER, filtered
        try:
            got = decontaminate.contamination(frame(spark, docs), bench).collect()
        finally:
            decontaminate.FILTER = old
        assert sorted(map(str, (tuple(r[n] for n in names) for r in got))) == sorted(map(str, want))
    kept = decontaminate.clean(frame(spark, docs), bench)
    assert kept.count() == sum(not w[5] for w in want) and kept.columns == frame(spark, docs).columns
    assert decontaminate.contamination(frame(spark, docs), bench.limit(0)).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate.contamination(frame(spark, []).limit(0), bench).count() == 0


def test_line_dedup(spark):
    block = "l1\nl2\nl3\nl4"
    docs = [(1, f"top\n{block}\nend"), (2, f"{block}\nx"), (3, f"a\n{block}\nb\n{block}"), (4, "l1\nl2"), (5, ""), (6, None), (7, "\n\n\n\n\n\n"), (8, "r\nr\nr\nr\nr"), (9, "l2\nl3\nl4"), (10, "z\n" * 3000)]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(frame(spark, docs)).collect()}
    assert [got[d]["text"] for d, _ in docs] == brute.line_dedup(docs, 50)
    assert got[2]["n_removed"] == 4 and got[9]["text"] == "" and got[6]["n_lines"] == 0
    twice = line_dedup.line_dedup(frame(spark, [(1, block), (1, block), (None, block)])).collect()
    assert sorted(str(r["text"]) for r in twice) == ["", "", block]  # null comes first; rows alike share their result
    assert line_dedup.line_dedup(frame(spark, []).limit(0)).count() == 0


def test_line_dedup_of_fewer_lines(spark):
    long, half, other = " ".join(f"w{i}" for i in range(50)), " ".join(f"h{i}" for i in range(25)), "\t" + " ".join(f"o{i}" for i in range(25))
    docs = [
        (1, f"a\n{long}\nb"), (2, long), (3, f"c\nd\n{long}\ne\n{long}"), (4, "short text"), (5, "short text"), (6, "short text\nmore"), (7, "short text\nmore"), (8, "x\nshort text\nmore\ny"),
        (9, f"p\n{half}\n{other}\nq"), (10, f"r\n{half}\n{other}"), (11, f"{half}\nz"), (12, f"{half}\n{other}"), (13, " "), (14, " "), (15, None), (16, long[:-4] + "\nk"), (17, long[:-4] + "\nl"),
    ]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(frame(spark, docs)).collect()}
    assert got == dict(docs) | {2: "", 3: "c\nd\ne", 5: "", 7: "", 10: "r", 12: ""}
    assert [got[d] for d, _ in docs] == brute.line_dedup(docs, 50)
    assert [r["text"] for r in line_dedup.line_dedup(frame(spark, docs), passage=None).orderBy("doc_id").collect()] == brute.line_dedup(docs)


def test_line_dedup_of_whole_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    for passage in (None, 50):
        assert [r["text"] for r in line_dedup.line_dedup(docs, passage=passage).orderBy("doc_id").collect()] == brute.line_dedup(texts, passage)


def test_statistics(spark, odd):
    docs = odd + [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality_rules.judge(frame(spark, docs), labels).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = [(d, *s, s[0] < 50 or 100 * s[4] > 50 * s[0]) for d, s in ((d, brute.statistics(t)) for d, t in docs)]
    assert sorted(map(str, ((r["doc_id"], *(r[n] for n in names), r["base_failed"]) for r in got))) == sorted(map(str, want))
    assert not any(r["kept"] and r["base_failed"] for r in got)
    none = quality_rules.judge(frame(spark, docs), labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in none)
    assert quality_rules.keep_good(frame(spark, []).limit(0), labels).count() == 0


def test_quality_with_labels_of_one_class(spark, odd):
    docs = odd + [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    for quality in (0, 1):
        labels = spark.createDataFrame([(i, quality) for i in range(200)], "doc_id long, quality int")
        for threshold in (0.5, 0.9):
            got = quality_rules.judge(frame(spark, docs), labels, threshold=threshold).collect()
            assert all(r["kept"] != r["base_failed"] and r["score"] == 0.5 for r in got) and any(r["kept"] for r in got)
    assert quality_rules.keep_good(frame(spark, docs), labels.withColumn("quality", F.lit(0))).count() == sum(r["kept"] for r in got)


def test_tokens(spark, odd):
    pieces = token_counts.vocabulary()
    docs = odd + [(500, "café 中文字 \U0001f600x the the thereafter")]
    got = token_counts.token_counts(frame(spark, docs)).collect()
    counts = {}

    def of(text):
        return sum(counts.setdefault(w, brute.tokens(w, pieces)) if len(w) < 100 else token_counts.Trie(pieces)[w.encode()] for w in (x.decode() for x in (text or "").encode().split()))

    assert sorted(map(str, ((r["doc_id"], r["n_tokens"]) for r in got))) == sorted(map(str, ((d, of(t)) for d, t in docs)))
    long = "ab" * 3000  # beyond the trie's length; the table over all prefixes is too slow here
    assert token_counts.Trie(pieces)[long.encode()] == token_counts.Trie(pieces, nodes=10)[long.encode()] > 0
    trie = token_counts.Trie(pieces)
    assert trie[long.encode()] and not len(trie)  # long words aren't kept
    small = token_counts.Trie(pieces, nodes=5)  # begins anew all the time
    assert [small[w] for w in (b"the", b"then", b"these", b"the")] == [brute.tokens(w, pieces) for w in ("the", "then", "these", "the")]


def test_table_of_words_matches(spark):
    assert spark.range(1).select(F.size(F.regexp_extract_all(F.lit("a b c\x1cd"), F.lit(brute.WS), F.lit(0)))).first()[0] == 2
