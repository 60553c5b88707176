"""Tokenizers: equal to their libraries; token files; packing."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from samplemill.llm import packing, pieces, token_counts

SF = "/root/testdata/sf0.001"
ODD = [
    "It's 'S thé naïve ́x á ΑΣ ΣΑΣ İ ﬁ x\x1cy a b c\td\r\n\x85q\x0b\x0c", "<|endoftext|> hi <0x0A> </s>", "", " ", "a" * 5000,
    "日本語 テキスト 😀😀 'll don't", "e ́ ́e", "A\nB\ńC", "ẞ ß ÿ Ÿ Straße. é., x., .x ., µ", "▁" * 33, " ▁ ", "\n\n x", " " * 700, "the" * 500,
    "\x00", "ab" * 400,
]


def odd_texts(letters, n, size):
    random.seed(1)
    return ODD + ["".join(random.choices(letters, k=random.randint(0, size))) for _ in range(n)]


def test_pieces_equal_the_library(spark):
    coder = pieces.PieceCoder(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += odd_texts(" \n\t▁aeinorstThAB.,<0x>s/é日本한😀\x00\r​́　 ", 1500, 40) + odd_texts("aehrt", 30, 900)
    ids = coder.encode(texts)
    want = coder.model.encode(texts, add_bos=True, add_eos=True)
    assert [i.tolist() for i in ids] == want
    assert [coder.decode(i) for i in ids] == [coder.model.decode(w) for w in want]


def test_a_full_cache_changes_nothing(monkeypatch):
    coder = pieces.PieceCoder(public_tokenizers.path("piece_bpe_32k.model"))
    monkeypatch.setattr(pieces, "CACHE", 3)
    first = [i.tolist() for i in coder.encode(ODD)]
    assert [coder.encode([t])[0].tolist() for t in ODD] == first


def test_words_equal_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = packing.WordEncoder(path)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += odd_texts("abcABCéÉßñ.,'’sS 1\n日´́", 1500, 60) + ["a" * n for n in range(250, 262)]
    want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == [w.ids for w in want]


@pytest.mark.parametrize("targets", [None, {"src0": 0.5, "src3": 0.3, "none such": 0.1}])
def test_packing(spark, targets):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, targets=targets, window=2).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    of_doc, of_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        of_doc[r.doc_id].append(r)
        of_sequence[r.sequence_id].append(r)
    source = {}
    for d in docs.collect():
        ids = np.array(tokenizer.encode(d.text, add_special_tokens=False).ids + [1], "<u4")
        source[d.doc_id] = d.source
        at = 0
        for r in sorted(of_doc[d.doc_id], key=lambda r: r.start):
            body = ids[at : at + r.length].tobytes()
            assert (r.start, r.doc_tokens, r.ids, r.ids_crc32) == (at, len(ids), body, zlib.crc32(body))
            at += r.length
        assert at == len(ids)
    assert sorted(of_sequence) == list(range(len(of_sequence)))
    for s, parts in of_sequence.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or s == len(of_sequence) - 1
    # Halfway, every source has handed out half of its tokens, but for a document and a window.
    if targets is None:
        total, early, longest = collections.Counter(), collections.Counter(), collections.Counter()
        for r in rows:
            total[source[r.doc_id]] += r.length
            early[source[r.doc_id]] += r.length * (r.sequence_id < len(of_sequence) // 2)
            longest[source[r.doc_id]] = max(longest[source[r.doc_id]], r.doc_tokens)
        assert all(abs(early[s] - total[s] / 2) <= longest[s] + 2 * 2048 for s in total)


def test_queues_get_their_targets(spark):
    rows = [(i, "a" if i < 500 else "b", 10) for i in range(1000)]
    placed = packing.place(spark.createDataFrame(rows, "row long, source string, n long"), {"a": 0.8}, 100)
    at = {r.row: r["at"] for r in placed.collect()}
    assert sorted(at.values()) == list(range(0, 10_000, 10))
    early = sorted(at, key=at.get)[:500]
    assert 0.78 <= sum(r < 500 for r in early) / 500 <= 0.82


def test_token_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    codes = token_counts.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = {r.doc_id: len(codes.encode_ordinary(r.text)) for r in docs.collect()}
    for block in (7, 1 << 18):
        assert {r.doc_id: r.n_tokens for r in token_counts.document_counts(docs, block=block).collect()} == want


def test_flat_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "GROUP", 3)
    rng = np.random.default_rng(1)
    want = []
    for f, (n, p) in enumerate([(0, 0), (10, 0.5), (1000, 0.3), (1000, 0.005), (997, 0), (500, 1)]):
        ids = np.where(rng.random(n) < p, 7, rng.integers(8, 100, n)).astype("<u2")
        ids.tofile(tmp_path / f"{f}.bin")
        ends = [-1, *np.flatnonzero(ids == 7).tolist()]
        want += [(f, i, b - a - 1, True) for i, (a, b) in enumerate(zip(ends, ends[1:]))]
        if ends[-1] < n - 1:
            want.append((f, len(ends) - 1, n - 1 - ends[-1], False))
    for block in (16, 1, 10_000):
        found = token_counts.count_tokens(token_counts.read_tokens(spark, str(tmp_path), block), 7).collect()
        assert sorted((int(r.file.split("/")[-1][:-4]), r.ordinal, r.n_tokens, r.closed) for r in found) == sorted(want)
