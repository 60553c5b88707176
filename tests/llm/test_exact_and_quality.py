import numpy as np
import pytest
from conftest import prose
from oracle import compare, duck

from samplemill.llm import exact, quality
from samplemill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    _, problem = compare(spark, duck(SF), SF, QUERIES[name], ORACLES[name])
    assert problem is None


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 100_000])
def test_filter_has_all_keys_and_few_others(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**60, n, dtype=np.uint64))
    made = exact.FuseFilter.build(keys)
    assert made.maybe(keys).all() and len(made.slots) < 1.25 * n + 64 + 1.5 * (n < 5000) * n
    assert made.maybe(np.random.default_rng(n + 1).integers(0, 2**60, 100_000, dtype=np.uint64)).mean() < 0.006


def test_batches_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    results = [sorted(exact.dedup_exact(docs, batches=b, shard=s).collect()) for b, s in ((1, 1 << 18), (2, 20), (4, 1 << 18))]
    assert results[0] == results[1] == results[2]


def test_two_texts_under_one_digest_are_an_error(docs_of, monkeypatch):
    class Constant:
        def __init__(self, body):
            pass

        def digest(self):
            return b"0" * 32

    docs = docs_of([(1, "one text"), (2, "another text")])
    assert len(exact.dedup_exact(docs).collect()) == 2
    digests, bodies = exact.with_digests, exact._bodies
    same = lambda df: df.withColumn("sha", exact.F.lit(b"0"))
    monkeypatch.setattr(exact, "with_digests", lambda *a: same(digests(*a)))
    monkeypatch.setattr(exact, "_bodies", lambda *a: same(bodies(*a)))
    with pytest.raises(Exception, match="one SHA-256 digest"):
        exact.dedup_exact(docs).collect()


def test_repeated_windows():
    def plain(words):
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        return len({i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)})

    rng = np.random.default_rng(0)
    for n in (0, 7, 8, 9, 16, 17, 40, 60):
        for kinds in (1, 2, 4, 30):
            words = [b"%d" % x for x in rng.integers(0, kinds, n)]
            words = words + words[: n // 2]
            assert quality.repeated_words(words) == plain(words)


def test_a_failing_host_takes_its_documents_along(docs_of):
    rows = [(i, prose(30, i), "en", "good") for i in range(40)]
    rows += [(100 + i, "too short" if i else prose(30, 5), "en", "bad") for i in range(30)]
    rows += [(200, "too short", "en", "new"), (201, prose(30, 9), "en", "new"), (300, prose(30, 8), "en", None)]
    got = {r.doc_id: r for r in quality.judge(docs_of(rows)).collect()}
    assert all(got[i].kept for i in (*range(40), 201, 300))
    assert not got[100].kept and not got[100].base_failed and got[100].host_rate > 0.5
    # One failure of two is shrunk to below a half: the prior has seen other hosts.
    assert got[201].host_rate < 0.5 and not got[200].kept
