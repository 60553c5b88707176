"""Leakage and agreement checks between splits and views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samplemill.functions.ids import SEED
from samplemill.plans.ordered import KEY_BUCKETS, in_key_order, join_null_safe
from samplemill.plans.session import cut


def ids_in_all(views: dict[str, DataFrame], key: str) -> DataFrame:
    """Ids that every view has."""
    tagged = reduce(
        DataFrame.unionByName,
        [df.select(key, F.lit(1 << i).alias("_v")) for i, df in enumerate(views.values())],
    )
    return tagged.groupBy(key).agg(F.bit_or("_v").alias("_v")).where(F.col("_v") == (1 << len(views)) - 1).select(key)


def synchronise(views: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """Purge from every view the ids that another view lacks."""
    common = ids_in_all(views, key)
    return {name: df.join(common, key, "left_semi") for name, df in views.items()}


def split_leakage(df: DataFrame, key: str, split: str = "split", a: str = "tr", b: str = "vl") -> DataFrame:
    """Values of ``key`` that occur in both splits. An aggregate, so that frequent values combine map-side."""
    both = df.where(F.col(split).isin(a, b)).groupBy(key).agg(F.min(split).alias("_lo"), F.max(split).alias("_hi"))
    return both.where("_lo <> _hi").select(key)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that only one side has, with the side that has them."""
    columns = a.columns
    both = a.select(*columns, F.lit(1).alias("_s")).unionByName(b.select(*columns, F.lit(2).alias("_s")))
    return (
        both.groupBy(*columns)
        .agg(F.bit_or("_s").alias("_s"))
        .where("_s < 3")
        .withColumn("side", F.when(F.col("_s") == 1, "first").otherwise("second"))
        .drop("_s")
    )


def ordered_mismatches(a: DataFrame, b: DataFrame, name: str, label: str, order: str, seed: int = SEED) -> DataFrame:
    """Compare two views position by position: differing names, differing labels, missing positions.

    Both views are cut into the same buckets of their common order. Where a bucket starts at the same position in
    both, and counts and order-free sums of hashes say that the same rows are in it, all of its positions agree. Rows
    are ranked and compared only in the other buckets.
    """
    view = [F.col("split"), F.col(order).alias("_key"), F.col(name).alias("_n"), F.col(label).alias("_l")]
    both = cut(a.select(*view, F.lit(0).alias("_v")).unionByName(b.select(*view, F.lit(1).alias("_v"))), "views")
    keyed = in_key_order(both, "_key", "_n", seed, None)

    buckets, at = ["split", *KEY_BUCKETS], Window.partitionBy("split").orderBy(*KEY_BUCKETS)
    sums = []
    for v in (0, 1):
        mine = F.col("_v") == v
        marks = [F.sum(F.when(mine, F.xxhash64(*order).cast("decimal(20,0)"))) for order in (("_key", "_n", "_l"), ("_l", "_n", "_key"))]
        sums += [F.count_if(mine).alias(f"_n{v}"), F.array(*marks).alias(f"_m{v}")]
    table = keyed.groupBy(*buckets).agg(*sums)
    for v in (0, 1):
        before = F.sum(f"_n{v}").over(at.rowsBetween(Window.unboundedPreceding, -1))
        table = table.withColumn(f"_lo{v}", F.coalesce(before, F.lit(0).cast("bigint")))
    same = (F.col("_n0") == F.col("_n1")) & (F.col("_lo0") == F.col("_lo1")) & (F.col("_m0") == F.col("_m1"))
    table = cut(table.withColumn("_same", same).drop("_m0", "_m1"), "fingerprints")

    open_ = join_null_safe(keyed, table.where("NOT _same").select(*buckets, "_lo0", "_lo1"), buckets)
    rank = F.row_number().over(Window.partitionBy(*buckets, "_v").orderBy("_key", "_h", "_n"))
    placed = open_.withColumn("_pos", F.when(F.col("_v") == 0, F.col("_lo0")).otherwise(F.col("_lo1")) + rank)
    # A position has one row of each view at most.
    pairs = placed.groupBy("split", "_pos").agg(
        *[F.max(F.when(F.col("_v") == v, F.struct("_n", "_l"))).alias(f"_{v}") for v in (0, 1)]
    )
    there = F.col("_0").isNotNull() & F.col("_1").isNotNull()
    found = pairs.select(
        "split",
        F.lit(1).alias("n"),
        (there & ~F.col("_0._n").eqNullSafe(F.col("_1._n"))).cast("bigint").alias("n_name"),
        (there & ~F.col("_0._l").eqNullSafe(F.col("_1._l"))).cast("bigint").alias("n_label"),
        (~there).cast("bigint").alias("n_lone"),
    )
    zero = F.lit(0).cast("bigint")
    alike = table.where("_same").select("split", F.col("_n0").alias("n"), *[zero.alias(c) for c in ("n_name", "n_label", "n_lone")])
    columns = ("n", "n_name", "n_label", "n_lone")
    return found.unionByName(alike).groupBy("split").agg(*[F.sum(c).alias(c) for c in columns])


def id_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct ids of ``a`` that ``b`` lacks."""
    both = a.select(key, F.lit(1).alias("_s")).unionByName(b.select(key, F.lit(2).alias("_s")))
    return both.groupBy(key).agg(F.bit_or("_s").alias("_s")).where("_s = 1").select(key)
