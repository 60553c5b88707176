import collections
import itertools
import random

import numpy as np
import pytest
from conftest import prose

from samplemill.llm import passages, similar, templates
from samplemill.llm.shingles import mix

SF = "/root/testdata/sf0.01"


def test_windows_are_the_wide_nodes_of_the_cartesian_tree():
    rng = np.random.default_rng(3)
    for _ in range(40):
        sizes = rng.integers(7, 40, 5)
        shingles = rng.integers(0, 2**63, sizes.sum(), dtype=np.uint64)
        hashed = mix(shingles ^ np.uint64(2 * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        want, first = set(), 0
        for n in sizes:
            for i in range(first, first + n):
                a, b = i, i
                while a > first and hashed[a - 1] > hashed[i]:
                    a -= 1
                while b < first + n - 1 and hashed[b + 1] > hashed[i]:
                    b += 1
                if b - a + 1 >= 7:
                    want.add((i, a, b))
            first += n
        got = passages.compact_windows(shingles, sizes, 1, 7)
        assert set(zip(*(x.tolist() for x in got))) == want


def test_passages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = passages.duplicate_passages(docs).collect()
    words = {r.doc_id: r.text.encode().lower().split() for r in docs.collect()}
    holders = collections.defaultdict(set)
    for d, w in words.items():
        for i in range(len(w) - 50):
            holders[tuple(w[i : i + 51])].add(d)
    want = {d for s in holders.values() if len(s) > 1 for d in s}
    got = {r.doc_id for r in found}
    assert len(want) > 100 and want <= got

    def shingles(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    for r in found:
        assert r.words >= 50 and r.start + r.words <= len(words[r.doc_id])
        # The representative holds what the passage holds, so their shingles overlap at least as the row says.
        mine = shingles(words[r.doc_id][r.start : r.start + r.words])
        assert len(mine & shingles(words[r.rep_id])) >= 0.8 * len(mine)


def test_a_common_passage_gives_a_row_per_document(docs_of):
    passage = prose(60, 500)
    rows = [(i, f"{prose(70, 3 * i)} {passage} {prose(30, 1000 + 3 * i, 5)}") for i in range(40)] + [(100, prose(200, 900, 11))]
    got = passages.duplicate_passages(docs_of(rows)).collect()
    hits = [r for r in got if r.start <= 72 and r.start + r.words >= 128]
    assert {r.doc_id for r in hits} == set(range(40))
    assert len(got) < 40 * 12


@pytest.mark.parametrize("gap", [50, 150, 300])
def test_two_passages_of_the_same_two_documents(docs_of, gap):
    """Both are found in both documents, whatever lies between them."""
    rng, rows, at = random.Random(gap), [], {}

    def foreign(n):
        return [f"z{rng.randrange(10**9)}" for _ in range(n)]

    for k in range(100):
        first, second = foreign(60), foreign(70)
        for d in (2 * k, 2 * k + 1):
            head, middle = foreign(rng.randrange(20, 90)), foreign(gap)
            rows.append((d, " ".join([*head, *first, *middle, *second, *foreign(40)])))
            at[d] = [(len(head), 60), (len(head) + 60 + gap, 70)]
    got = collections.defaultdict(list)
    for r in passages.duplicate_passages(docs_of(rows)).collect():
        got[r.doc_id].append((r.start, r.words))
    found = [all(any(s <= a + 3 and s + n >= a + m - 3 for s, n in got[d]) for a, m in at[d]) for d in at]
    assert sum(found) == len(found)


def test_recall_of_edited_passages(docs_of):
    """Passages of 60 to 80 words with words exchanged, in documents of their own: nearly all above 0.8 are found."""
    rng, rows, want = random.Random(2), [], {}
    for k in range(300):
        size = rng.randrange(60, 81)
        passage = [f"p{k}w{i}" for i in range(size)]
        other = list(passage)
        for i in rng.sample(range(size), rng.randrange(1, 4)):
            other[i] += "x"
        a, b = ({tuple(w[i : i + 5]) for i in range(size - 4)} for w in (passage, other))
        for d, part in ((2 * k, passage), (2 * k + 1, other)):
            head, tail = ([f"z{rng.randrange(10**9)}" for _ in range(50)] for _ in range(2))
            rows.append((d, " ".join([*head, *part, *tail])))
        if len(a & b) >= 0.8 * len(a | b):
            want[2 * k] = want[2 * k + 1] = True
    got = {r.doc_id for r in passages.duplicate_passages(docs_of(rows)).collect()}
    assert len(want) > 200 and sum(d in got for d in want) >= 0.95 * len(want)


def foreign(rng, n):
    return [f"z{rng.randrange(10**9)}" for _ in range(n)]


def linked(rows, ids, words):
    """Whether the documents all have a passage of so many words, and the same representative for one."""
    reps = [{(r.rep_id, r.rep_start) for r in rows if r.doc_id == i and r.words >= words} for i in ids]
    return all(reps) and bool(set.intersection(*reps))


def test_passages_around_a_common_stretch(docs_of):
    """Pairs that share 64 words are linked, though 60 others have 40 of them and one of those is the smallest text."""
    rng = random.Random(7)
    stretch, rows = foreign(rng, 40), []
    for k in range(60):
        before, after = foreign(rng, 12), foreign(rng, 12)
        for d in (2 * k, 2 * k + 1):
            rows.append((d, " ".join([*foreign(rng, 50), *before, *stretch, *after, *foreign(rng, 50)])))
    rows += [(1000 + k, " ".join([*foreign(rng, 60), *stretch, *foreign(rng, 60)])) for k in range(60)]
    got = passages.duplicate_passages(docs_of(rows)).collect()
    assert [k for k in range(60) if not linked(got, (2 * k, 2 * k + 1), 62)] == []
    assert {r.doc_id for r in got} == set(range(120))


def test_passages_of_which_others_have_all_parts(docs_of):
    """Two parts in one piece link documents, though most have both parts with other words between."""
    rng = random.Random(8)
    first, second = foreign(rng, 30), foreign(rng, 30)
    rows = [(i, " ".join([*foreign(rng, 60), *first, *second, *foreign(rng, 60)])) for i in range(10)]
    rows += [(100 + i, " ".join([*foreign(rng, 60), *first, *foreign(rng, 25), *second, *foreign(rng, 60)])) for i in range(40)]
    got = passages.duplicate_passages(docs_of(rows)).collect()
    assert linked(got, range(10), 58) and {r.doc_id for r in got} == set(range(10))


def test_all_edited_passages_are_found(docs_of):
    """At the threshold too: passages of 50 to 80 words with words exchanged, put in or left out."""
    rng, rows, want = random.Random(9), [], []
    for k in range(400):
        size = rng.randrange(54, 81)
        passage = [f"p{k}w{i}" for i in range(size)]
        other = list(passage)
        for _ in range(rng.randrange(1, 3)):
            at = rng.randrange(1, len(other) - 1)
            other[at : at + rng.randrange(2)] = [f"x{rng.randrange(10**9)}"] * rng.randrange(2)
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (passage, other))
        for d, part in ((2 * k, passage), (2 * k + 1, other)):
            rows.append((d, " ".join([*foreign(rng, 50), *part, *foreign(rng, 50)])))
        if len(a & b) >= 0.8 * len(a | b):
            want += [2 * k, 2 * k + 1]
    got = {r.doc_id for r in passages.duplicate_passages(docs_of(rows)).collect()}
    assert len(want) > 400 and set(want) - got == set()


def test_texts_with_a_sure_piece_share_a_seed():
    size, every = passages.seed_sizes(0.8, 46)
    assert passages.sure_run(0.8, 46) == size + every - 1 == 20 and passages.sure_run(1.0, 46) == 46
    rng = np.random.default_rng(4)
    for _ in range(200):
        piece = rng.integers(0, 2**63, 20, dtype=np.uint64)
        sides = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in rng.integers(30, 60, 4)]
        a, b = (np.concatenate([sides[i], piece, sides[i + 1]]) for i in (0, 2))
        keys, _ = passages.seeds(np.concatenate([a, b]), np.array([len(a), len(b)]), size, every)
        assert len(set(keys.tolist())) < len(keys)


def test_documents_are_read_once_for_all_rounds(docs_of, monkeypatch):
    """Texts, seeds and shingles come from the documents, whatever the number of comparisons."""
    plans, cut = [], passages.cut

    def noted(df, name):
        plans.append((name, "_text" in df._jdf.queryExecution().optimizedPlan().toString()))
        return cut(df, name)

    monkeypatch.setattr(passages, "cut", noted)
    rng = random.Random(7)
    stretch, rows = foreign(rng, 40), []
    for k in range(20):
        before, after = foreign(rng, 12), foreign(rng, 12)
        rows += [(2 * k + i, " ".join([*foreign(rng, 50), *before, *stretch, *after, *foreign(rng, 50)])) for i in range(2)]
    passages.duplicate_passages(docs_of(rows))
    assert sum(name == "passages" for name, _ in plans) >= 2
    assert [name for name, reads in plans if reads] == ["texts", "seeds", "shingled"]


def test_shared_runs_against_all_runs():
    rng = np.random.default_rng(6)
    for _ in range(200):
        common = rng.random(rng.integers(12, 60)) < 0.85
        starts = rng.integers(0, len(common), 5)
        ends = np.minimum(starts + rng.integers(0, 4), len(common) - 1)
        has, low, high = passages.shared_runs(common, starts, ends, 0.8, 8)
        gain = np.concatenate([[0.0], np.cumsum(common - 0.8)])
        for k, (start, end) in enumerate(zip(starts.tolist(), ends.tolist())):
            runs = [
                (i, j)
                for i in range(max(0, start - 8), start + 1)
                for j in range(end + 1, min(len(common), end + 9) + 1)
                if common[i] and common[j - 1] and j - i >= 8 and gain[j] - gain[i] >= -1e-9
            ]
            assert has[k] == bool(runs)
            assert not runs or (low[k], high[k]) == (min(i for i, _ in runs), max(j for _, j in runs))


def test_places_of_a_pair_join_by_shift():
    pair, at, shift = (np.array(x) for x in zip((0, 5, 0), (0, 90, 500), (0, 9, 1), (0, 200, 2), (1, 9, 1)))
    order, starts, *bounds = passages.joined_spans(pair, at, shift, 12, 20)
    assert sorted(zip(pair[order][starts].tolist(), *(x.tolist() for x in bounds))) == [(0, 0, 40, 0, 41), (0, 70, 121, 570, 621), (0, 180, 231, 182, 233), (1, 0, 40, 1, 41)]
    assert [len(x) for x in passages.joined_spans(*(np.zeros(0, np.int64),) * 3, 12, 20)] == [0] * 6


def test_near_duplicates(docs_of):
    base = prose(200, 1).split()
    rows = [(1, " ".join(base))]
    rows += [(10 + k, " ".join(f"{w}changed" if i % (200 // k) == 5 else w for i, w in enumerate(base))) for k in (1, 2, 3)]
    rows += [(20, " ".join(f"{w}other" if i % 6 == 1 else w for i, w in enumerate(base))), (21, prose(200, 77)), (22, " ".join(base).upper())]
    got = {(r.doc_id, r.keep_id) for r in similar.near_duplicates(docs_of(rows)).collect()}
    assert got == {(11, 1), (12, 1), (13, 1), (22, 1)}
    kept = similar.drop_near_duplicates(docs_of(rows)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 20, 21]


def test_large_buckets_meet_in_their_leaders(docs_of, monkeypatch):
    base = prose(300, 4).split()
    rows = [(i, " ".join([*base[:i], f"edit{i}", *base[i + 1 :]])) for i in range(120)]
    monkeypatch.setattr(similar, "BUCKET", 10)
    got = similar.near_duplicates(docs_of(rows)).collect()
    assert {r.doc_id for r in got} == set(range(1, 120)) and {r.keep_id for r in got} == {0}


def test_near_copies_among_pages_with_the_same_boilerplate(docs_of):
    rng, base, rows = random.Random(5), prose(300, 4).split(), []
    for i in range(400):
        own = set(rng.sample(range(300), 5))
        rows.append((i, " ".join(f"own{i}x{k}" if k in own else w for k, w in enumerate(base))))
    for i in range(0, 400, 10):
        words = rows[i][1].split()
        rows.append((1000 + i, " ".join([*words[:150], f"edit{i}", *words[151:]])))

    def shingles(text):
        w = text.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets, root = {i: shingles(text) for i, text in rows}, {i: i for i, _ in rows}
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
            least, other = sorted((root[a], root[b]))
            root = {i: least if r == other else r for i, r in root.items()}
    got = {(r.doc_id, r.keep_id) for r in similar.near_duplicates(docs_of(rows)).collect()}
    # Pairs at the threshold itself may be missed; the planted ones are far above it.
    assert {i for i, _ in got} <= {i for i, r in root.items() if i != r}
    assert {i for i, _ in got} >= set(range(1000, 1400, 10))
    assert all(root[i] == root[keep] for i, keep in got)


def test_values_of_a_large_bucket_all_meet(spark):
    keyed = spark.createDataFrame([(node, bytearray(16), 7) for node in range(60)], "node long, fp binary, k long")
    met = [[v.node for v in r.vs] for r in similar._buckets(keyed, 10).collect()]
    assert {p for vs in met for p in itertools.combinations(sorted(vs), 2)} == set(itertools.combinations(range(60), 2))
    assert max(map(len, met)) < 30


def test_exploded_rows_are_not_broadcast(docs_of, monkeypatch):
    """Keys of all tables, members of groups and sets grow with the corpus, however small their files are."""
    plans, cut = {}, similar.cut

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return cut(df, name)

    monkeypatch.setattr(similar, "cut", noted)
    base = [f"w{i}" for i in range(5000)]
    rows = [(1, " ".join(base)), (2, " ".join(w + "x" if i % 51 == 7 else w for i, w in enumerate(base)))]
    assert [r.doc_id for r in similar.near_duplicates(docs_of(rows)).collect()] == [2]
    assert "SortMergeJoin" in plans["groups"] and "SortMergeJoin" in plans["links"]
    assert all("Broadcast" not in plans[name] for name in ("groups", "links"))
    pairs, sets = docs_of([(1, "")]).selectExpr("1L AS a", "2L AS b"), docs_of([(1, "")]).selectExpr("1L AS node", "array(1) AS s")
    assert "Broadcast" not in similar._verified(sets, pairs, 0.8)._jdf.queryExecution().executedPlan().toString()


def test_longer_keys_get_more_tables():
    want = similar.recall(0.8, similar.KEY_BITS, similar.TABLES)
    assert want > 0.9 and similar.recall(0.9, similar.KEY_BITS, similar.TABLES) > 0.99
    assert similar.tables_for(0.8, similar.KEY_BITS) == similar.TABLES
    for bits in (15, 17, 20, 24):
        tables = similar.tables_for(0.8, bits)
        assert similar.recall(0.8, bits, tables) >= want > similar.recall(0.8, bits, tables - 1)


def pairs_of(n, low, high, seed, size=120):
    """Pairs of texts with a similarity between the bounds, each pair with words of its own."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        base = [f"p{len(out)}w{rng.randrange(10**6)}" for _ in range(size)]
        other = list(base)
        for i in rng.sample(range(size), rng.randrange(1, max(2, size // 25))):
            other[i] += "x"
        a, b = ({tuple(w[k : k + 5]) for k in range(size - 4)} for w in (base, other))
        if low <= len(a & b) / len(a | b) < high:
            out.append((" ".join(base), " ".join(other)))
    return out


def test_recall_of_planted_pairs(docs_of):
    """Against the sets themselves: 0.9 of the pairs just above the threshold, 0.99 of those above 0.9, none below."""
    kinds = {"low": (0.8, 0.85, 150), "high": (0.9, 1.0, 300), "below": (0.6, 0.8, 150)}
    rows, of = [], {}
    for k, (name, (low, high, n)) in enumerate(kinds.items()):
        for a, b in pairs_of(n, low, high, k):
            of[len(rows) + 1] = name
            rows += [(len(rows), a), (len(rows) + 1, b)]
    found = {(r.doc_id, r.keep_id) for r in similar.near_duplicates(docs_of(rows)).collect()}
    share = {name: sum((i, i - 1) in found for i, x in of.items() if x == name) / kinds[name][2] for name in kinds}
    assert share["low"] >= 0.9 and share["high"] >= 0.99 and share["below"] == 0
    assert all(i in of and keep == i - 1 for i, keep in found)


def test_long_texts_are_decided_by_their_full_sets(docs_of):
    """Sets of several thousand shingles, on both sides of the threshold."""
    base = [f"w{i}" for i in range(5000)]
    edited = lambda step: " ".join(w + "x" if i % step == 7 else w for i, w in enumerate(base))
    # Every edit takes five shingles, so the similarity is (1 - 5 / step) / (1 + 5 / step): 0.82, 0.78.
    rows = [(1, " ".join(base)), (2, edited(51)), (3, " ".join(f"v{w}" for w in base)), (4, " ".join(f"v{w}" for w in edited(40).split()))]
    assert {(r.doc_id, r.keep_id) for r in similar.near_duplicates(docs_of(rows)).collect()} == {(2, 1)}


@pytest.mark.parametrize("n", [200, 800])
def test_links_do_not_grow_with_the_square_of_a_family(spark, n):
    """Members that are near in bits but not alike give no link at all, however many pairs are compared."""
    rng = np.random.default_rng(n)
    shared, fp = np.arange(300, dtype=np.int32), bytes(16)
    rows = []
    for i in range(n):
        own = rng.integers(1000, 1 << 30, 100).astype(np.int32)
        s = np.unique(np.concatenate([shared, own])).tolist()
        rows.append((7, i, bytearray(fp), len(s), s))
    # Four copies among them, but for two words.
    for i in range(4):
        s = sorted({*rows[0][4][:-2], 10**9 + i})
        rows.append((7, n + i, bytearray(fp), len(s), s))
    members = spark.createDataFrame(rows, "g long, node long, fp binary, size int, s array<int>")
    links = similar._links(members, similar.radius(0.8), 0.8).collect()
    assert len(links) == 4 and all(r.sure for r in links)
    assert {x for r in links for x in (r.a, r.b)} == {0, n, n + 1, n + 2, n + 3}


def test_equal_fingerprints_of_different_sets_are_verified(docs_of, monkeypatch):
    monkeypatch.setattr(similar, "wide_fingerprint", lambda hashes: np.zeros(2, np.uint64))
    rows = [(1, prose(200, 1)), (2, prose(200, 77)), (3, prose(200, 1) + " more")]
    assert {(r.doc_id, r.keep_id) for r in similar.near_duplicates(docs_of(rows)).collect()} == {(3, 1)}


HEADINGS = ["apple pie", "wooden boats", "paper planes", "better coffee", "small talk", "garden paths", "winter coats", "clay pots"]


def test_lines_that_only_begin_alike_stay(docs_of):
    rows = [(i, f"How to make {x}\nCopyright by the editor of this page\nunique {prose(8, i)}") for i, x in enumerate(HEADINGS)]
    got = templates.drop_recurring_lines(docs_of(rows)).collect()
    for r in got:
        assert r.text == rows[r.doc_id][1].replace("Copyright by the editor of this page\n", "")


def test_other_documents_change_nothing(docs_of):
    """Twenty times as many documents with other words: the same lines stay."""
    def corpus(tag, first):
        out = []
        for i in range(40):
            name = "".join(chr(97 + int(d)) for d in str(i))
            lines = [f"How to make some{tag}{name} thing{tag}{name}", f"written{tag} by{tag} the{tag} editor{tag} of{tag} number{tag}{i % 3}"]
            lines.append(f"only{tag} in{tag} this{tag} one{tag} {prose(5, i)}")
            out.append((first + i, "\n".join(lines)))
        return out

    own = corpus("", 0)
    alone = {r.doc_id: r.text for r in templates.drop_recurring_lines(docs_of(own)).collect()}
    many = [row for k in range(1, 21) for row in corpus(f"q{chr(96 + k)}", 1000 * k)]
    # Only their words differ, so `How to make` leads all of them to one leaf.
    among = {r.doc_id: r.text for r in templates.drop_recurring_lines(docs_of(own + many)).collect()}
    assert {i: among[i] for i in alone} == alone


def test_a_document_with_many_variants_counts_once(docs_of):
    rows = [(1, "\n".join(f"the same start word{chr(97 + i)} here" for i in range(9)))] + [(i, f"the same start other{chr(97 + i)} there") for i in range(2, 6)]
    assert all(r.n_dropped == 0 for r in templates.drop_recurring_lines(docs_of(rows)).collect())


def test_fields_vary_and_templates_go(docs_of):
    names = ["ada", "bob", "cyd", "dan", "eve", "fay", "gus", "hal"]
    rows = [(i, f"Page {i} of 40\nwritten today for {n} by the editor\nthis line is only in document {chr(97 + i)}\n") for i, n in enumerate(names)]
    rows.append((50, "Page one\nwritten today for nobody else in particular\nthe end"))
    got = {r.doc_id: r for r in templates.drop_recurring_lines(docs_of(rows)).collect()}
    for i in range(8):
        # `this line is only in document x` has one variable field, like the line with the name.
        assert got[i].text == f"Page {i} of 40\n" or got[i].n_dropped >= 2
    assert got[50].n_dropped == 0 and got[50].text == rows[-1][1]


def test_rare_and_short_lines_stay(docs_of):
    rows = [(i, f"hello world\nrare line number {'abcd'[i]} with some words") for i in range(4)]
    assert all(r.n_dropped == 0 for r in templates.drop_recurring_lines(docs_of(rows)).collect())
