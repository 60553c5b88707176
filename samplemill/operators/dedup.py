"""Exact de-duplication by digest.

Winners are found with ``min``/``min_by`` aggregates, which combine map-side, so a digest
shared by a third of all rows costs one partial row per task instead of one huge window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def keep_earliest(df: DataFrame, digest: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per digest (and ``by``): the first in ``order``. Pass narrow rows, join content later."""
    rest = [c for c in df.columns if c not in (*by, digest)]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*by, digest).agg(first.alias("_r")).select(*by, digest, *[F.col(f"_r.{c}") for c in rest])


def drop_leaks(df: DataFrame, digest: str, side: str) -> DataFrame:
    """Remove all rows whose digest occurs on more than one side."""
    clean = (
        df.groupBy(digest)
        .agg(F.min(side).alias("_lo"), F.max(side).alias("_hi"))
        .where("_lo = _hi")
        .select(digest)
    )
    return df.join(clean, digest)


def dedup_across_sides(df: DataFrame, digest: str, side: str, order: Sequence[str]) -> DataFrame:
    """``keep_earliest`` per side and ``drop_leaks`` in a single shuffle."""
    rest = [c for c in df.columns if c not in (digest, side)]
    return (
        df.groupBy(digest)
        .agg(
            F.min(side).alias(side),
            F.max(side).alias("_hi"),
            F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"),
        )
        .where(F.col(side) == F.col("_hi"))
        .select(digest, side, *[F.col(f"_r.{c}") for c in rest])
    )


def majority_label(df: DataFrame, digest: str, label: str) -> DataFrame:
    """Most common label per digest, ties by label."""
    counts = df.groupBy(digest, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(digest).agg(
        F.min_by(F.struct(label, "n"), F.struct(-F.col("n"), F.col(label))).alias("_m")
    ).select(digest, F.col(f"_m.{label}"), F.col("_m.n"))


def keep_majority(df: DataFrame, digest: str, label: str, id_col: str) -> DataFrame:
    """Per digest the first id among those that carry its majority label. No join: two aggregates."""
    counts = df.groupBy(digest, label).agg(F.count(F.lit(1)).alias("_n"), F.min(id_col).alias("_first"))
    return counts.groupBy(digest).agg(
        F.min_by(F.struct(label, "_first"), F.struct(-F.col("_n"), F.col(label))).alias("_m")
    ).select(F.col("_m._first").alias(id_col), digest, F.col(f"_m.{label}"))


def unique_by_id(df: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    return keep_earliest(df, id_col, order)


def redundancy(df: DataFrame, digest: str, by: str) -> DataFrame:
    """Samples, unique digests, digests with copies and share of unique, per ``by`` and in total."""
    def report(counts: DataFrame, key) -> DataFrame:
        n = F.col("_n")
        return counts.groupBy(key.alias(by)).agg(
            F.sum(n).cast("bigint").alias("n_total"),
            F.count(F.lit(1)).alias("n_unique"),
            F.count_if(n > 1).alias("n_copied"),
            F.round(F.count(F.lit(1)) * 100.0 / F.sum(n), 6).alias("pct_unique"),
        )

    inside = df.groupBy(by, digest).agg(F.count(F.lit(1)).alias("_n"))
    overall = inside.groupBy(digest).agg(F.sum("_n").alias("_n"))
    return report(inside, F.col(by).cast("string")).unionByName(report(overall, F.lit("all")))
