"""Ranks, cuts, running totals and quantiles against brute force, with one value holding most rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplemill.functions.ids import sample_hash
from samplemill.plans import ordered


def md5(i, seed=42):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def skewed(n=3000):
    rng = random.Random(1)
    return [(i, "big" if rng.random() < 0.7 else rng.choice("ab"), 50 if rng.random() < 0.4 else rng.randrange(100)) for i in range(n)]


@pytest.mark.parametrize("partitions", ["1", "4", "7"])
def test_ordered_rank_is_exact_under_skew(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rows = skewed()
    df = spark.createDataFrame(rows, "id int, g string, t int")
    got = {r.id: r["rank"] for r in ordered.ordered_rank(df, "t", "id", ["g"], buckets=16).collect()}
    want = {}
    for g in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], md5(r[0]), r[0]))
        want |= {r[0]: i + 1 for i, r in enumerate(mine)}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want


def test_hash_rank_and_cut_agree(spark):
    rows = skewed(1500)
    df = spark.createDataFrame(rows, "id int, g string, t int")
    order = sorted(range(1500), key=lambda i: (md5(i), i))
    got = {r.id: r["rank"] for r in ordered.hash_rank(df, "id").collect()}
    assert got == {i: k + 1 for k, i in enumerate(order)}
    parts = {r.id: r.part for r in ordered.hash_cut(df, "id", [700, 701, 1200]).collect()}
    assert parts == {i: sum(c < k + 1 for c in (700, 701, 1200)) for k, i in enumerate(order)}


def test_running_totals(spark):
    rows = [(g, k, k % 7 + 1) for g in "ab" for k in range(-200, 300)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = {(r.g, r.k): (r.before, r.whole) for r in ordered.running_totals(df, "k", {"v": "before"}, ["g"], 8, {"v": "whole"}).collect()}
    for g in "ab":
        values = [v for gg, _, v in rows if gg == g]
        for i, (_, k, _) in enumerate(r for r in rows if r[0] == g):
            assert got[g, k] == (sum(values[:i]), sum(values))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.integers(0, 1000, 801), np.full(400, 17)])
    df = spark.createDataFrame([(int(v),) for v in values], "v int")
    got = ordered.exact_quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.99}).first()
    assert [got.a, got.b, got.c] == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.99])))


@pytest.mark.parametrize("kind", ["bigint", "string", "timestamp", "date"])
def test_keys_are_compared_in_their_own_type(spark, kind):
    rng = np.random.default_rng(5)
    base = 2**60 + rng.integers(0, 3000, 2000)
    df = spark.createDataFrame([(int(i), int(b)) for i, b in enumerate(base)], "id bigint, b bigint")
    key = {"bigint": F.col("b"), "string": F.md5(F.col("b").cast("string")), "timestamp": F.timestamp_micros(F.col("b") - F.lit(2**60 - 10**15)), "date": F.expr("date_add(date'1970-01-01', cast(b % 5000 as int))")}[kind]
    df = df.withColumn("k", key)
    rows = df.withColumn("h", ordered.sample_hash("id")).collect()
    want = {r.id: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r.k, r.h, r.id)))}
    got = {r.id: r["rank"] for r in ordered.ordered_rank(df, "k", "id", buckets=16).collect()}
    assert got == want


def test_empty_input(spark):
    df = spark.createDataFrame([], "id int, t int")
    assert ordered.ordered_rank(df, "t", "id").count() == 0
    assert ordered.hash_cut(df, "id", [5]).count() == 0
    assert ordered.exact_quantiles(df.withColumn("g", F.lit(1)), "t", {"q": 0.5}, ["g"]).count() == 0


def test_text_buckets_on_a_common_prefix(spark):
    """200,000 ids that differ in their last ten characters only: no bucket has twice the mean."""
    ids = spark.range(200_000).select(F.concat(F.lit("a-prefix-of-20-chars"), F.lpad(F.col("id").cast("string"), 10, "0")).alias("name"))
    bounds = ordered.quantile_bounds(ids, "name", 64)
    sizes = [r["count"] for r in ordered.quantile_bucket(ids, "name", bounds).groupBy("_q").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 2 * 200_000 / 64
    assert ordered.name_rank(ids, "name").where(F.col("rank") != F.substring("name", 21, 10).cast("int") + 1).isEmpty()


def test_text_order_with_ties_and_odd_strings(spark):
    """Hot strings, strings beyond the longest bound, bytes, NULL, and characters of every length."""
    rng = random.Random(4)
    words = ["", "a", "ab", "é", "z\U0001F600", "\ue000", "hot", "hot", "x" * 1500 + "a", "x" * 1500 + "b", "x" * 1500, "q\"\\u\n", "\x01"]
    rows = [(i, rng.choice(words) if rng.random() < 0.7 else "hot") for i in range(600)] + [(600, None)]
    df = spark.createDataFrame(rows, "id int, t string")
    for key, frame in (("t", df), ("b", df.withColumn("b", F.col("t").cast("binary")))):
        for buckets in (2, 8, 64):
            got = {r.id: r["rank"] for r in ordered.ordered_rank(frame, key, "id", buckets=buckets).collect()}
            hashed = {r.id: r.h for r in df.select("id", sample_hash("id").alias("h")).collect()}
            order = sorted((i for i, t in rows if t is not None), key=lambda i: (rows[i][1].encode(), hashed[i], i))
            assert [got[i] for i in order] == list(range(1, 601)) and got[600] == 601
