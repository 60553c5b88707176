"""Joins of sample tables by id, digest and view."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplemill.operators.filters import demanded, with_view_prefix


def with_labels(files: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Files that have a label."""
    return files.join(labels, key)


def with_lookup(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Attach a lookup; a missing entry is NULL. Spark broadcasts the lookup if it is small enough."""
    return df.join(lookup, key, "left")


def completed(runs: DataFrame, key: str, mode: str, modes: Sequence[str], all_modes: bool = True) -> DataFrame:
    """Ids that have output for all modes, or for any of them."""
    done = runs.where(F.col(mode).isin(*modes)).groupBy(key)
    needed = len(modes) if all_modes else 1
    bits = F.lit(0)
    for i, m in enumerate(modes):
        bits = F.when(F.col(mode) == m, F.lit(1 << i)).otherwise(bits)
    return done.agg(F.bit_or(bits).alias("_modes")).where(F.bit_count("_modes") >= needed).select(key)


def pending(ids: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Ids that are not done.

    Ids compress so well that the planner would put all of them into a few tasks, whose sorting and counting then takes
    their memory, by the size of the table. A given number of parts keeps it from that, on both sides of the join. The
    optimizer would move an anti join below the parts, so this is an outer one.
    """
    tasks = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = done.select(key, F.lit(True).alias("_done"))
    return ids.repartition(tasks, key).join(found, key, "left").where("_done IS NULL").select(*ids.columns)


def label_via_digest(files: DataFrame, digest_labels: DataFrame, digest: str) -> DataFrame:
    """Second hop of id -> digest -> label. The adaptive planner splits a digest that dominates."""
    return files.join(digest_labels, digest)


def override_union(maps: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """Union of id -> value tables in which the later table wins."""
    ranked = [m.select(key, value).withColumn("_ord", F.lit(i)) for i, m in enumerate(maps)]
    union = ranked[0]
    for m in ranked[1:]:
        union = union.unionByName(m)
    return union.groupBy(key).agg(F.max_by(F.struct(value), "_ord")[value].alias(value))


def merge_views(views: dict[str, DataFrame], name: str, label: str, check: bool = False) -> DataFrame:
    """Join the views of a sample side by side, columns prefixed by view, with one label.

    With ``check`` a name that a view lacks, or another label for it, is an error of the job.
    """
    out: DataFrame | None = None
    doubts = []
    for view, df in views.items():
        side = with_view_prefix(df if check or out is None else df.drop(label), view, keep=(name, label))
        if check:
            side = side.withColumn(f"_in_{view}", F.lit(True))
            doubts.append(F.col(f"_in_{view}").isNull())
            if out is not None:
                side = side.withColumnRenamed(label, f"_label_{view}")
                doubts.append(~F.col(label).eqNullSafe(F.col(f"_label_{view}")))
        out = side if out is None else out.join(side, name, "full" if check else "inner")
    if not check:
        return out
    error = F.raise_error(F.lit("the views disagree on names or labels"))
    sure = out.withColumn(label, F.when(reduce(or_, doubts), error).otherwise(F.col(label)))
    return sure.drop(*[f"_{kind}_{view}" for kind in ("in", "label") for view in views])


def view_mismatches(views: dict[str, DataFrame], name: str, label: str) -> DataFrame:
    """Per pair of views: names on one side only, and names whose labels differ."""
    names = list(views)
    parts = []
    for a, b in zip(names, names[1:]):
        left = views[a].select(name, F.col(label).alias("_a"), F.lit(True).alias("_ina"))
        right = views[b].select(name, F.col(label).alias("_b"), F.lit(True).alias("_inb"))
        joined = left.join(right, name, "full")
        lone = F.col("_ina").isNull() | F.col("_inb").isNull()
        parts.append(
            joined.agg(
                F.lit(f"{a}-{b}").alias("views"),
                F.count_if(lone).alias("n_lone"),
                F.count_if(~lone & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("n_label"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("n_mismatch", F.col("n_lone") + F.col("n_label"))


def with_features(split: DataFrame, features: DataFrame, key: str, check: bool = True) -> DataFrame:
    """Attach feature vectors; with ``check`` a sample without features is an error of the job."""
    if not check:
        return split.join(features, key)
    joined = split.join(features.withColumn("_found", F.lit(True)), key, "left")
    return demanded(joined, key, "_found", "a sample has no features")


def with_options(df: DataFrame, options: dict[str, Sequence]) -> DataFrame:
    """Every row once per combination of option values (the parameter grid), by ``explode``."""
    for name, values in options.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def with_size_options(df: DataFrame, lows: Sequence[int], highs: Sequence[int]) -> DataFrame:
    """Every row once per zipped pair of bounds."""
    pairs = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in zip(lows, highs, strict=True)])
    return df.withColumn("_p", F.explode(pairs)).select("*", "_p.lo", "_p.hi").drop("_p")
