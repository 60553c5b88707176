"""Connected components of a link table, as joins and aggregates over tables in the shared folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplemill.plans.session import drop_path, work_path


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)`` that is not the smallest of its component.

    Alternating stars: every node hands its smallest neighbour to its larger neighbours, then to its smaller
    ones, until the links form one star per component around the smallest node. Nodes are long integers.
    Each round is a written table, and the one before it is deleted. Hubs only meet ``min`` aggregates, which
    combine before the shuffle, and joins that the adaptive planner may split. Loops, repeated links and links
    with a NULL end have no effect; an empty table gives an empty table.
    """
    spark = links.sparkSession
    links = links.where("a <> b")
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path, state = _written(edges)
    while state[0]:
        edges = spark.read.parquet(path)
        following, after = _written(_small_star(_large_star(edges)))
        drop_path(spark, path)
        path, before, state = following, state, after
        if state == before:
            break
    return spark.read.parquet(path).select(F.col("u").alias("node"), F.col("v").alias("root"))


def _written(edges: DataFrame) -> tuple[str, tuple]:
    spark = edges.sparkSession
    path = work_path(spark, "links")
    edges.write.parquet(path)
    # Two order-free sums over the links tell whether a round changed anything.
    a, b = (F.sum(F.xxhash64(F.lit(k), "u", "v").cast("decimal(38,0)")) for k in (0, 1))
    return path, tuple(spark.read.schema(edges.schema).parquet(path).agg(F.count(F.lit(1)), a, b).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``0 .. n - 1`` over the links ``a[i] - b[i]``."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up
    return root
