"""Splits, quotas and balancing: worked examples, sequential models, properties."""

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from samplemill.operators import balance, dedup, splits, stats


def test_integer_sizes():
    assert splits.integer_sizes(100, (0.8, 0.1, 0.1)) == (80, 10, 10)
    assert splits.integer_sizes(101, (0.8, 0.1, 0.1)) == (80, 10, 11)
    assert splits.integer_sizes(101, (0.8, 0.2, 0.0)) == (80, 21, 0)
    assert splits.integer_sizes(7, (3, 2, 2)) == (3, 2, 2)
    with pytest.raises(TypeError):
        splits.integer_sizes(10, (0.5, 5, 0.0))
    with pytest.raises(ValueError):
        splits.integer_sizes(10, (0.55, 0.0, 0.0))


@pytest.mark.parametrize(
    "start, n, ratios, want",
    [
        ((3, 3, 3), 6, (1, 1, 1), (5, 5, 5)),
        ((2, 2, 3), 9, (0.6, 0.2, 0.2), (10, 3, 3)),
        ((1, 1, 1), 0, (0.6, 0.2, 0.2), (1, 1, 1)),
        ((3, 3, 3), 30, (0.6, 0.2, 0.2), (23, 8, 8)),
        ((3, 0, 3), 6, (1, 0, 1), (6, 0, 6)),
    ],
)
def test_apportion(spark, start, n, ratios, want):
    got = spark.range(1).select(splits.apportion(F.lit(n), ratios, start).alias("q")).first().q
    assert tuple(got) == want


def test_apportion_of_many_items_stays_proportional(spark):
    got = spark.range(1).select(splits.apportion(F.lit(10**9 + 7), (0.7, 0.2, 0.1)).alias("q")).first().q
    assert sum(got) == 10**9 + 7
    assert all(abs(g - p * (10**9 + 7)) <= 1 for g, p in zip(got, (0.7, 0.2, 0.1)))


@pytest.mark.parametrize("ratios", [(0.7, 0.2, 0.1), (0.2, 0.6, 0.2), (1 / 3, 1 / 3, 1 / 3), (0.125, 0.5, 0.375), (0, 1, 3)])
def test_apportion_equals_handing_out_one_by_one(spark, ratios):
    whole = sum(Fraction(r).limit_denominator(1000) for r in ratios)
    shares = [Fraction(r).limit_denominator(1000) / whole for r in ratios]
    have, want = [0, 0, 0], [(0, 0, 0)]
    for _ in range(150):
        now = sum(have)
        gaps = [s - (Fraction(h, now) if now else 0) for s, h in zip(shares, have)]
        have[gaps.index(max(gaps))] += 1
        want.append(tuple(have))
    rows = spark.range(151).select("id", splits.apportion(F.col("id"), ratios).alias("q")).orderBy("id").collect()
    assert [tuple(r.q) for r in rows] == want


def test_apportion_of_billions_into_thirds(spark):
    got = spark.range(1).select(splits.apportion(F.lit(3 * 10**9 + 1), (1 / 3, 1 / 3, 1 / 3)).alias("q")).first().q
    assert tuple(got) == (10**9 + 1, 10**9, 10**9)
    with pytest.raises(ValueError):
        splits.apportion(F.lit(5), (0.5, 0.2, 2**-0.5))


def plain_cap(rows, ratio):
    """The rounds of the label cap, one set of rows after the other."""
    key = lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i)
    cap = int(ratio * min(Counter(x for _, xs in rows for x in set(xs)).values()))
    rows = {i: set(xs) for i, xs in rows}
    while True:
        n = Counter(x for xs in rows.values() for x in xs)
        free = sorted((i for i, xs in rows.items() if all(n[x] > cap for x in xs)), key=key)
        if not free:
            return set(rows)
        rank, gone = Counter(), []
        for i in free:
            rank.update(rows[i])
            if all(rank[x] <= n[x] - cap for x in rows[i]):
                gone.append(i)
        for i in gone:
            del rows[i]


@pytest.mark.parametrize("partitions", [1, 7])
def test_label_cap_per_split(spark, partitions):
    rng = random.Random(9)
    rows = [(i, rng.sample("abcd", rng.choice([1, 1, 2])) if rng.random() < 0.9 else ["rare"], "tr" if i % 3 else "vl") for i in range(600)]
    df = spark.createDataFrame(rows, "id int, labels array<string>, split string").repartition(partitions)
    got = {r.id for r in balance.cap_label_imbalance(df, "id", "labels", 1.5, split="split").collect()}
    assert got == set().union(*(plain_cap([(i, xs) for i, xs, s in rows if s == part], 1.5) for part in ("tr", "vl")))
    assert len(got) < 600


def sequential_temporal(times, k):
    """Indices that train: sort, cut at k, move the tie group to the side that holds more of it."""
    times = sorted(times)
    t = times[k]
    if times[k - 1] != t:
        return k
    left, right = sum(x == t for x in times[:k]), sum(x == t for x in times[k + 1 :])
    if left < right:
        return times.index(t)
    return len(times) - times[::-1].index(t)


def test_temporal_tie_moves_as_a_whole(spark):
    up = list(range(100)) + [100] * 100 + list(range(101, 190))
    down = list(range(90)) + [100] * 100 + list(range(101, 201))
    for times in (up, down):
        half = len(times) // 2
        df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id int, ts int")
        out = splits.temporal_split(df, "ts", (half, len(times) - half, 0))
        assert out.where("split = 'tr'").count() == sequential_temporal(times, half)


def test_temporal_boundary_against_sequential_model(spark):
    rng = random.Random(3)
    for _ in range(8):
        times = [rng.randrange(12) for _ in range(rng.randrange(5, 60))]
        k = rng.randrange(1, len(times))
        df = spark.createDataFrame([(t,) for t in times], "ts int")
        boundary = splits.temporal_boundary(df, "ts", k)
        assert sum(t < boundary for t in times) == sequential_temporal(times, k)


def test_temporal_split_needs_every_class_on_both_sides(spark):
    df = spark.createDataFrame([(i, "old" if i < 5 else "new", i) for i in range(10)], "id int, label string, ts int")
    with pytest.raises(ValueError):
        splits.temporal_split(df, "ts", (0.5, 0.5, 0.0), "label")
    with pytest.raises(NotImplementedError):
        splits.temporal_split(df, "ts", (0.5, 0.3, 0.2))


def labelled(spark, classes, per=50):
    return spark.createDataFrame([(i, i % classes) for i in range(classes * per)], "id int, label int")


@pytest.mark.parametrize("classes, sizes", [(2, (0.8, 0.1, 0.1)), (3, (0.6, 0.2, 0.2)), (2, (0.9, 0.1, 0.0))])
def test_guaranteed_split(spark, classes, sizes):
    df = labelled(spark, classes)
    out = splits.guaranteed_split(df, "id", "label", sizes, 3).collect()
    assert sorted(r.id for r in out) == list(range(classes * 50))
    want = splits.integer_sizes(classes * 50, sizes)
    counts = Counter(r.split for r in out)
    assert tuple(counts[s] for s in splits.SPLITS) == want
    for s, n in zip(splits.SPLITS, want):
        if n:
            assert all(c >= 3 for c in Counter(r.label for r in out if r.split == s).values())


def test_guaranteed_split_rejects_what_cannot_be(spark):
    df = labelled(spark, 3, per=5)
    with pytest.raises(ValueError):
        splits.guaranteed_split(df, "id", "label", (0.6, 0.2, 0.2), 2)
    with pytest.raises(ValueError):
        splits.guaranteed_split(labelled(spark, 3), "id", "label", (148, 1, 1), 1)


def test_same_split_for_any_partitioning(spark):
    df = labelled(spark, 3)
    seen = set()
    for n in ("1", "3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = splits.random_split(df.repartition(int(n)), "id", (0.5, 0.3, 0.2)).collect()
        seen.add(tuple(sorted((r.id, r.split) for r in rows)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1


def test_bias_targets_grid():
    """Only one class shrinks and the share is met, over the grid of shares."""
    n = 65_536
    for p in range(5, 100, 5):
        n_min = n * p // 100
        for r in range(5, 100, 5):
            ratio = r / 100
            keep_min, keep_maj = balance.bias_targets(n_min, n - n_min, ratio)
            assert keep_min == n_min or keep_maj == n - n_min
            assert keep_min <= n_min and keep_maj <= n - n_min
            assert abs(keep_min / (keep_min + keep_maj) - ratio) < 0.01


def test_spatial_bias(spark):
    df = spark.createDataFrame([(i, "mal" if i % 4 == 0 else "ben") for i in range(2000)], "id int, label string")
    out = balance.spatial_bias(df, "id", "label", "mal", 0.4)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {"mal": 500, "ben": 750}
    assert out.subtract(df).count() == 0
    assert balance.spatial_bias(df, "id", "label", "mal", 0.25).count() == 2000
    for bad in (0.0, 1.0):
        with pytest.raises(ValueError):
            balance.spatial_bias(df, "id", "label", "mal", bad)
    with pytest.raises(ValueError):
        balance.spatial_bias(df, "id", "label", "other", 0.5)


def multi(spark, n=600):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        labels = {"a"} if rng.random() < 0.8 else set()
        labels |= {x for x, p in (("b", 0.5), ("c", 0.2), ("d", 0.05)) if rng.random() < p}
        rows.append((i, sorted(labels or {"d"})))
    return spark.createDataFrame(rows, "id int, labels array<string>"), dict(rows)


def test_label_cap_leaves_no_candidate(spark):
    df, rows = multi(spark)
    before = Counter(x for ls in rows.values() for x in ls)
    cap = int(2 * min(before.values()))
    kept = {r.id: r.labels for r in balance.cap_label_imbalance(df, "id", "labels", 2.0).collect()}
    after = Counter(x for ls in kept.values() for x in ls)
    assert not [i for i, ls in kept.items() if all(after[x] > cap for x in ls)]
    assert all(after[x] >= min(before[x], cap) for x in before)
    assert len(kept) < len(rows)


def test_labels_per_class_and_label_split(spark):
    df, rows = multi(spark)
    total = Counter(x for ls in rows.values() for x in ls)
    chosen = splits.labels_per_class(df, "id", "labels", 15).collect()
    have = Counter(x for r in chosen for x in r.labels)
    assert all(have[x] >= min(15, total[x]) for x in total)
    out = splits.guaranteed_label_split(df, "id", "labels", (0.6, 0.2, 0.2), 3).collect()
    assert sorted(r.id for r in out) == sorted(rows)
    assert Counter(r.split for r in out) == {"tr": 360, "vl": 120, "ts": 120}


def test_collapsed_dedup_equals_its_two_steps(spark):
    rng = random.Random(9)
    rows = [(i, f"d{rng.randrange(60)}", rng.randrange(2), rng.randrange(3), rng.randrange(50)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, digest string, side int, ds int, ts int")
    once = dedup.dedup_across_sides(df, "digest", "side", ["ds", "ts", "id"]).select("id").collect()
    pure = dedup.drop_leaks(df, "digest", "side")
    twice = dedup.keep_earliest(pure, "digest", ["ds", "ts", "id"], ["side"]).select("id").collect()
    assert sorted(once) == sorted(twice)


def test_temporal_checks(spark):
    df = spark.createDataFrame([(1, "tr"), (2, "tr"), (3, "vl"), (3, "ts")], "ts int, split string")
    assert splits.temporal_checks(df, "ts").first().ok is False
    assert splits.temporal_checks(df.where("split <> 'ts'"), "ts").first().ok is True


def test_summary_rounds_half_to_even(spark):
    df = spark.createDataFrame([("tr",)] * 1 + [("vl",)] * 199, "split string")
    got = stats.split_summary(df, F.lit(True)).first()
    assert (got.pct_tr, got.pct_vl, got.pct_ts) == (0.0, 100.0, 0.0) and math.isnan(got.pos_ts)


@pytest.mark.parametrize("ratios, n, want", [
    ((0.33333, 0.33333, 0.33334), 3_000_000_000, (999_990_000, 999_990_000, 1_000_020_000)),
    ((0.33333, 0.33333, 0.33334), 100_000, (33333, 33333, 33334)),
    ((1 / 3, 1 / 3, 1 / 3), 9_000_000_000_000_000_000, (3_000_000_000_000_000_000,) * 3),
    ((0.6, 0.2, 0.2), 10, (6, 2, 2)),
])
def test_quotas_of_any_ratio(spark, ratios, n, want):
    row = spark.range(1).select(splits.apportion(F.lit(n).cast("bigint"), ratios).alias("q")).first().q
    assert tuple(row) == want


def test_quotas_turn_by_turn_on_fine_ratios(spark):
    ratios, now, want = (0.61237, 0.28763, 0.1), [0, 0, 0], {}
    shares = [Fraction(str(r)) for r in ratios]
    for n in range(1, 700):
        behind = [s * (n - 1) - x for s, x in zip(shares, now)] if n > 1 else shares
        now[behind.index(max(behind))] += 1
        want[n] = tuple(now)
    got = spark.range(1, 700).select("id", splits.apportion(F.col("id"), ratios).alias("q")).collect()
    assert {r.id: tuple(r.q) for r in got} == want


def test_ratios_are_refused_not_rounded():
    for ratios in ((0.1234567, 0.5, 0.3765433), (2**0.5 / 2, 0.1, 0.1)):
        with pytest.raises(ValueError, match="common denominator"):
            splits.apportion(F.col("n"), ratios)


def test_no_chosen_sample_is_needless(spark):
    rng = random.Random(3)
    rows = [(i, sorted({rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))})) for i in range(400)] + [(i, ["a"]) for i in range(400, 900)]
    df = spark.createDataFrame(rows, "id int, labels array<string>")
    n = Counter(x for _, ls in rows for x in ls)
    for k in (1, 7, 60):
        chosen = splits.labels_per_class(df, "id", "labels", k).collect()
        have = Counter(x for r in chosen for x in r.labels)
        need = {x: min(k, n[x]) for x in n}
        assert all(have[x] >= need[x] for x in n)
        assert all(any(have[x] == need[x] for x in r.labels) for r in chosen)


def test_label_split_seeds(spark):
    rng = random.Random(8)
    rows = [(i, sorted({rng.choice("abcde") for _ in range(rng.randint(1, 3))})) for i in range(300)] + [(300, ["rare"]), (301, ["rare"])]
    df = spark.createDataFrame(rows, "id int, labels array<string>")
    got = splits.guaranteed_label_split(df, "id", "labels", (0.6, 0.2, 0.2), 3).collect()
    assert sorted(r.id for r in got) == list(range(302))
    sizes = Counter(r.split for r in got)
    assert (sizes["tr"], sizes["vl"], sizes["ts"]) == (181, 60, 61)
    for split in ("tr", "vl", "ts"):
        have = Counter(x for r in got if r.split == split for x in r.labels)
        assert all(have[x] >= 3 for x in "abcde")
    assert {r.split for r in got if "rare" in r.labels} == {"tr"}
