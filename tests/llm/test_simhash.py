import re

import numpy as np
import xxhash

from samplemill.llm import simhash
from samplemill.llm.graph import components, roots

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_pairs_within_the_radius():
    rng = np.random.default_rng(1)
    near = [np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64) for _ in range(2)]
    values = np.unique(np.concatenate([rng.integers(0, 2**64, 300, dtype=np.uint64), np.uint64(0x1234567890ABCDEF) ^ near[0] ^ near[1]]))
    rng.shuffle(values)
    starts = np.array([0, 3, 3, 200, len(values)])
    got = {p for a, b in simhash.sliced_pairs(values, starts, 2) for p in zip(a.tolist(), b.tolist())}
    want = {
        (i, j)
        for s, e in zip(starts, starts[1:])
        for i in range(s, e)
        for j in range(i + 1, e)
        if bin(int(values[i] ^ values[j])).count("1") <= 2
    }
    assert got == want and want


def test_wide_values():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 2**64, (150, 2), dtype=np.uint64)
    values[75:] = values[:75] ^ (np.uint64(1) << rng.integers(0, 64, (75, 2)).astype(np.uint64))
    distance = lambda i, j: sum(bin(int(x)).count("1") for x in values[i] ^ values[j])
    for radius in (0, 1, 2, 5, 60):
        got = {p for a, b in simhash.sliced_pairs(values, np.array([0, 150]), radius) for p in zip(a.tolist(), b.tolist())}
        assert got == {(i, j) for i in range(150) for j in range(i + 1, 150) if distance(i, j) <= radius}


def test_any_pair_meets_in_a_bucket(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**62))
    values = {base} | {base ^ 1 << int(a) ^ 1 << int(b) for a, b in rng.integers(0, 64, (150, 2))}
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    wanted = {frozenset((a, b)) for a in values for b in values if a < b and bin(a ^ b).count("1") <= 2}
    for limit in (4096, 8):
        buckets = [{x % (1 << 64) for x in r.fps} for r in simhash._buckets(fps, 2, limit).collect()]
        assert all(any(pair <= b for b in buckets) for pair in wanted)


def test_against_brute_force(spark, docs_of):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    words = rows[0][1].split()
    rows += [(1000 + i, " ".join([*words[:i], "changed", *words[i + 1 :]])) for i in range(0, 60, 3)] + [(2000, ""), (2001, " ")]
    fps = {i: plain_fingerprint(t) for i, t in rows}
    want = plain_components(fps)
    assert len(set(want.values())) < len(set(fps.values()))
    for bucket in (4096, 1):
        got = simhash.simhash_groups(docs_of(rows), bucket=bucket).collect()
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    nodes = sorted({x for l in links for x in l})
    place = {x: i for i, x in enumerate(nodes)}
    ends = np.array([[place[a], place[b]] for a, b in links]).T
    root = roots(len(nodes), *ends)
    want = {x: nodes[root[i]] for i, x in enumerate(nodes) if root[i] != i}
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
