"""Label ids and probabilities over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_ids(df: DataFrame, label: str) -> DataFrame:
    """``(label, n, label_id)``: dense ids by count, most frequent first, ties by label.

    The window runs over one row per class.
    """
    rows = df.select(F.explode(label).alias(label)) if dict(df.dtypes)[label].startswith("array") else df
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy().orderBy(F.desc("n"), F.asc(label))
    return counts.withColumn("label_id", (F.row_number().over(order) - 1).cast("int"))


def with_label_ids(df: DataFrame, label: str, table: DataFrame) -> DataFrame:
    return df.join(table.select(label, "label_id"), label, "left")


def probabilities(df: DataFrame, value: str, digits: int | None = None) -> DataFrame:
    """Each value as a share of the column total, optionally rounded. For small tables such as class counts."""
    share: Column = F.col(value) / F.sum(value).over(Window.partitionBy())
    return df.withColumn("share", share if digits is None else F.round(share, digits))


def most_common(df: DataFrame, key: str) -> DataFrame:
    """All values of ``key`` that have the highest count."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max("n").alias("n"))
    return counts.join(top, "n").select(key, "n")
