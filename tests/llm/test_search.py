import math
import re
from collections import Counter

import numpy as np
import pytest

from samplemill.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counted:
            m = 50 + 50 * n * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in set(terms(text)) if t in c
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def made(spark, docs, items):
    docs = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, block string, term int, score int")
    return docs, spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, rank string")


def rows(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_terms_are_those_of_the_pattern():
    text = "".join(map(chr, range(1, 0x250))) + " ÀB—c　d\x85e Iİ"
    assert [t.decode() for t in search.terms(text)] == terms(text)


@pytest.mark.parametrize("block", [16, 8192])
def test_all_scores_against_brute_force(spark, monkeypatch, block):
    """Items of rare, frequent and unknown terms; ties, NULLs, repeated rows; several blocks, passes and owners."""
    monkeypatch.setattr(search, "BLOCK_DOCS", block)
    monkeypatch.setattr(search, "PASS_ITEMS", 7)
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    share = 1 / np.arange(1, 401)
    texts = [" ".join(rng.choice(words, int(n), p=share / share.sum())) for n in rng.integers(0, 120, 300)]
    docs = [(i // 2 if i % 50 == 0 else i, t) for i, t in enumerate(texts)]
    docs += [(900, texts[7]), (901, texts[7]), (None, texts[7]), (None, None), (902, None), (903, "!?"), (904, "W1 W1, w2"), (900, texts[7])]
    items = [(i, " ".join(rng.choice(words, 12))) for i in range(20)]
    items += [(50, "w1 w2 W3"), (51, "nowhere"), (52, None), (53, ""), (54, texts[7]), (54, texts[7]), (None, "w399 w1")]
    got = rows(search.search(*made(spark, docs, items), top=5))
    assert got == brute(docs, items, 5)


def test_copies_and_frequent_words(spark):
    """A third of the rows are the same text, and a term is in all of them; ids decide."""
    docs = [(1000 - i, "common passage of many pages") for i in range(400)] + [(2000 + i, f"common word{i}") for i in range(800)]
    items = [(1, "common"), (2, "passage common"), (3, "word5 common many")]
    assert rows(search.search(*made(spark, docs, items))) == brute(docs, items, 50)


def test_empty_tables(spark):
    docs, items = made(spark, [(1, "a b"), (2, None)], [(1, "a")])
    assert rows(search.search(docs.limit(0), items)) == [] and rows(search.search(docs, items.limit(0))) == []
    assert rows(search.search(docs, items)) == brute([(1, "a b")], [(1, "a")], 50)


def test_a_very_long_document(spark):
    docs = [(1, " ".join(["long", "text"] * 200_000)), (2, "long text"), (3, "x" * 300_000), (4, "other")]
    items = [(1, "long"), (2, "x" * 300_000), (3, "text other")]
    assert rows(search.search(*made(spark, docs, items))) == brute(docs, items, 50)
