"""Vocabulary training and encoding against one-by-one merging."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplemill.functions.tokens import SPECIALS
from samplemill.operators import tokenizer

CORPUS = (
    "the cat sat on the mat the cats sat at the mats aaaa aaa aa banana bananas cabana "
    "lower lowest newer newest wider widest low new wide abab ababab abcabc $a.b $a.b \\x \\x"
).split()


def sequential(words, size, max_length, prefix):
    """One merge per step; the most frequent pair, ties by text."""
    counts = Counter(words)
    parts = {w: [c if i == 0 else prefix + c for i, c in enumerate(w)] for w in counts}
    tokens = sorted({s for p in parts.values() for s in p})
    merges = []
    while len(tokens) < size:
        pairs = Counter()
        for w, p in parts.items():
            for a, b in zip(p, p[1:]):
                pairs[a, b] += counts[w]
        pairs = {(a, b): n for (a, b), n in pairs.items() if max_length is None or len(a) + len(b) - len(prefix) <= max_length}
        if not pairs:
            break
        a, b = min(pairs, key=lambda p: (-pairs[p], p))
        token = a + b.removeprefix(prefix)
        merges.append((a, b))
        if token not in tokens:
            tokens.append(token)
        for w, p in parts.items():
            out, i = [], 0
            while i < len(p):
                if p[i : i + 2] == [a, b]:
                    out.append(token)
                    i += 2
                else:
                    out.append(p[i])
                    i += 1
            parts[w] = out
    return tokens, merges, parts


@pytest.mark.parametrize("prefix, max_length", [("", None), ("", 3), ("##", None), ("##", 5)])
def test_training_equals_sequential_merging(spark, prefix, max_length):
    df = spark.createDataFrame([(CORPUS[:20],), (CORPUS[20:],)], "words array<string>")
    size = len({c for w in CORPUS for c in w}) + 22
    model = tokenizer.train_merges(tokenizer.word_counts(df, "words"), size, max_length, prefix)
    tokens, merges, parts = sequential(CORPUS, size, max_length, prefix)
    assert model.merges == merges
    assert model.tokens == [*SPECIALS, *tokens]
    encoded = tokenizer.encode_merges(df, "words", model).collect()
    names = {i: t for t, i in model.ids.items()}
    assert [names[i] for r in encoded for i in r.input_ids] == [s for w in CORPUS for s in parts[w]]


def test_independent_pairs_stop_at_shared_symbols():
    P = tokenizer.Pair
    listed = [P("t", "h", 9), P("e", "r", 8), P("h", "e", 8), P("x", "y", 7)]
    assert tokenizer._independent(listed, "", set(), 0) == [("t", "h")]
    listed[2] = P("h", "e", 7)
    assert tokenizer._independent(listed, "", set(), 0) == [("t", "h"), ("e", "r")]
    assert tokenizer._independent([P("a", "a", 5), P("x", "y", 4)], "", set(), 0) == [("a", "a")]
    assert tokenizer._independent([P("a", "b", 5), P("x", "y", 4)], "", {"ab"}, 0) == [("a", "b")]
    assert tokenizer._independent([P("a", "b", 5), P("x", "y", 4)], "", set(), 4) == [("a", "b")]


def test_five_hundred_merges(spark):
    rng = random.Random(7)
    # Words of twelve alphabets: merges in one of them have nothing to do with those in another.
    alphabets = ["abcdefgh", "\U0001F600éèßäöüñ", *("".join(chr(c + i) for i in range(8)) for c in range(0x400, 0x450, 8))]
    words = ["".join(rng.choices(alphabets[k % 12], weights=[9, 7, 5, 4, 3, 2, 2, 1], k=rng.randint(1, 14))) for k in range(2500)]
    counts = {w: rng.randrange(1, 10**6) for w in words}
    model = tokenizer.train_merges(spark.createDataFrame(list(counts.items()), "word string, n bigint"), merges=500)
    _, merges, parts = sequential(counts, 500 + len(set("".join(words))), None, "")
    assert len(merges) == 500 and model.merges == merges
    names = {i: t for t, i in model.ids.items()}
    df = spark.createDataFrame([(words,)], "words array<string>")
    encoded = tokenizer.encode_merges(df, "words", model).first().input_ids
    assert [names[i] for i in encoded] == [s for w in words for s in parts[w]]


def test_a_round_reads_the_postings_of_its_pairs(spark):
    words = spark.createDataFrame([(f"{a}{b}{c}", 1) for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyz0123"], "word string, n bigint")
    index = tokenizer._Index(words, "")
    found = index.words_with([("a", "k"), ("b", "k")])
    assert sorted(r.word for r in found.collect()) == sorted(f"{a}k{c}" for a in "ab" for c in "uvwxyz0123")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [g#" in plan and "In(gram, [ak,bk])" in plan
    # A word with both pairs comes once.
    both = tokenizer._Index(spark.createDataFrame([("akbk", 3)], "word string, n bigint"), "")
    assert [tuple(r) for r in both.words_with([("a", "k"), ("b", "k")]).collect()] == [("akbk", 3)]


def test_long_words_merge_in_little_time():
    rng = random.Random(1)
    word = "".join(rng.choices("ab", k=100_000))
    ranks = tokenizer._ranks([("a", "b"), ("ab", "a"), ("b", "b"), ("aba", "ab"), ("bb", "bb")])
    start = time.time()
    parts = tokenizer.merge_symbols(list(word), ranks)
    assert time.time() - start < 1 and "".join(parts) == word


@pytest.mark.parametrize("again", [True, False])
def test_merging_with_second_spellings(again):
    """Against rescanning: pairs of a lower rank may come up again, or every merge counts once."""
    rng = random.Random(5)
    merges = [("a", "b"), ("b", "c"), ("a", "bc"), ("abc", "d"), ("abc", "abc"), ("ab", "c"), ("c", "c"), ("abc", "d"), ("d", "abc")]
    ranks = tokenizer._ranks(merges)
    for _ in range(2000):
        word = "".join(rng.choices("abcd", k=rng.randint(0, 14)))
        parts, at = list(word), -1
        while True:
            known = [(r, p) for p in zip(parts, parts[1:]) for r in ranks.get(p, ()) if again or r > at]
            if not known:
                break
            at, (a, b) = min(known)
            out, i = [], 0
            while i < len(parts):
                step = 2 if parts[i : i + 2] == [a, b] else 1
                out.append("".join(parts[i : i + step]))
                i += step
            parts = out
        assert tokenizer.merge_symbols(list(word), ranks, "", again) == parts, word


@pytest.mark.parametrize("pool", [1, 3, 10])
def test_a_small_pool_is_filled_again(spark, monkeypatch, pool):
    monkeypatch.setattr(tokenizer, "POOL", pool)
    df = spark.createDataFrame([(CORPUS,)], "words array<string>")
    size = len({c for w in CORPUS for c in w}) + 12
    model = tokenizer.train_merges(tokenizer.word_counts(df, "words"), size)
    assert model.merges == sequential(CORPUS, size, None, "")[1]


def test_word_vocabulary_and_unknown_words(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c"],), ([],), (None,)], "words array<string>")
    vocabulary = tokenizer.word_vocabulary(tokenizer.word_counts(df, "words"), 2)
    ids = {r.token: r.token_id for r in vocabulary.collect()}
    assert {k: v for k, v in ids.items() if v > 6} == {"b": 7, "a": 8}
    got = [r.input_ids for r in tokenizer.encode_words(df, "words", vocabulary).collect()]
    assert got == [[7, 8, 7, 1], [], None]


def test_blocks_hold_every_id_but_the_tail(spark):
    from samplemill.operators.blocks import packed_blocks

    rows = [(i, "hot" if i % 4 else "cold", list(range(i * 100, i * 100 + i % 13))) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, g string, ids array<int>")
    got = packed_blocks(df, "id", "ids", "g", 16).collect()
    for g in ("hot", "cold"):
        flat = [x for _, gg, ids in rows if gg == g for x in ids]
        want = [flat[i : i + 16] for i in range(0, len(flat) - 15, 16)]
        assert [r.input_ids for r in sorted((r for r in got if r.g == g), key=lambda r: r.block)] == want


def test_length_sweep(spark):
    df = spark.createDataFrame([([1, 2], [1]), ([1, 2], [2, 3, 4])], "a array<int>, b array<int>")
    got = {(r.config, r.length): r.n for r in tokenizer.length_sweep(df, {"x": "a", "y": "b"}).collect()}
    assert got == {("x", 2): 2, ("y", 1): 1, ("y", 3): 1}
    assert F.col("a") is not None


@pytest.mark.parametrize("prefix", ["", "##", "#"])
def test_words_of_a_batch_are_merged_at_once(monkeypatch, prefix):
    """A batch as one text against word by word: letters that look like marks, second spellings, any number of merges."""
    rng = random.Random(3)
    words = ["".join(rng.choices("ab#\x00é\U0001F600", k=rng.randint(1, 12))) for _ in range(500)]
    n = np.arange(1, 501)
    alphabet = sorted({s for w in words for s in tokenizer._letters(w, prefix)})
    merges = []
    for _ in range(12):
        ranks = tokenizer._ranks(merges)
        parts = [tokenizer.merge_symbols(tokenizer._letters(w, prefix), ranks, prefix, False) for w in words]
        want = Counter()
        for p, k in zip(parts, n.tolist()):
            for pair in zip(p, p[1:]):
                want[pair] += k
        spelling = tokenizer._Spelling(alphabet, merges, prefix)
        for most in (400, 0):
            monkeypatch.setattr(tokenizer, "MERGES_AT_ONCE", most)
            keys, sums = tokenizer._summed(*spelling.pairs(spelling.text(words, merges), n))
            assert dict(zip(zip(*spelling.named(keys)), sums.tolist())) == want
        merges.append(rng.choice(sorted(want)))


def test_few_merges_write_no_postings(spark, monkeypatch):
    counts = spark.createDataFrame(list(Counter(CORPUS).items()), "word string, n bigint")
    made, init = [], tokenizer._Index.__init__
    monkeypatch.setattr(tokenizer._Index, "__init__", lambda self, *a: (made.append(1), init(self, *a))[1])
    merges = tokenizer.train_merges(counts, merges=12, prefix="##").merges
    assert not made
    monkeypatch.setattr(tokenizer, "SCANS", 2)
    assert tokenizer.train_merges(counts, merges=12, prefix="##").merges == merges and made == [1]
