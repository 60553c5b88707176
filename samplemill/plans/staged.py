"""Keeping expensive expressions from being repeated."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held(df: DataFrame, name: str) -> DataFrame:
    """Compute ``name`` once: later filters on it stay above this point.

    The optimizer moves a filter below a projection by copying the expression into it, which
    evaluates a long chain of array functions several times per row. It does not move a
    filter below ``explode``, and exploding a one-element array costs next to nothing.
    """
    return df.withColumn(name, F.explode_outer(F.array(name)))


def exploded(df: DataFrame, array: Column | str, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row ``(*keep, name)`` per element that is not NULL.

    A plain ``explode`` makes the optimizer test the array for emptiness first, and a computed
    array is then computed twice. The outer form has no such test.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def side_by_side(*frames: DataFrame) -> DataFrame:
    """Columns of several one-row tables in one row, by union and aggregation instead of a join without keys."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
