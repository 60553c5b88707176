"""Softmax, sigmoid, argmax and per-row ranking scores over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from samplemill.functions.ids import as_column, bound


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def softmax(logits: Column | str) -> Column:
    z = as_column(logits)
    e = bound(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top)))
    return bound(e, lambda v: bound(_sum(v), lambda total: F.transform(v, lambda x: x / total)))


def log_softmax_at(logits: Column | str, index: Column | str) -> Column:
    """Log probability of one class."""
    z = as_column(logits)

    def at(top: Column) -> Column:
        return F.get(z, as_column(index)) - top - F.ln(_sum(F.transform(z, lambda x: F.exp(x - top))))

    return bound(F.array_max(z), at)


def argmax(scores: Column | str) -> Column:
    """0-based position of the first maximum."""
    z = as_column(scores)
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def sigmoid(logits: Column | str) -> Column:
    return F.transform(as_column(logits), lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def _scores_where(truth: Column, scores: Column, value: int) -> Column:
    zipped = F.zip_with(truth, scores, lambda t, s: F.when(t == value, s))
    return F.filter(zipped, lambda s: s.isNotNull())


def coverage(truth: Column | str, scores: Column | str) -> Column:
    """Number of labels ranked at or above the lowest true label; 0 without true labels."""
    t, s = as_column(truth), as_column(scores)
    return bound(
        F.array_min(_scores_where(t, s, 1)),
        lambda least: F.when(least.isNull(), F.lit(0)).otherwise(F.size(F.filter(s, lambda x: x >= least))),
    )


def ranking_precision(truth: Column | str, scores: Column | str) -> Column:
    """Mean over true labels of (true labels at or above) / (labels at or above); 1 if none or all are true."""
    t, s = as_column(truth), as_column(scores)

    def score(true: Column) -> Column:
        ratio = F.transform(
            true, lambda x: F.size(F.filter(true, lambda y: y >= x)) / F.size(F.filter(s, lambda y: y >= x))
        )
        trivial = (F.size(true) == 0) | (F.size(true) == F.size(s))
        return F.when(trivial, F.lit(1.0)).otherwise(_sum(ratio) / F.size(true))

    return bound(_scores_where(t, s, 1), score)


def ranking_loss(truth: Column | str, scores: Column | str) -> Column:
    """Share of (true, false) label pairs in which the false one scores at least as high; 0 if none or all are true."""
    t, s = as_column(truth), as_column(scores)

    def loss(true: Column, false: Column) -> Column:
        wrong = _sum(F.transform(true, lambda x: F.size(F.filter(false, lambda y: y >= x)).cast("double")))
        trivial = (F.size(true) == 0) | (F.size(false) == 0)
        return F.when(trivial, F.lit(0.0)).otherwise(wrong / (F.size(true) * F.size(false)))

    return bound(_scores_where(t, s, 1), lambda true: bound(_scores_where(t, s, 0), lambda false: loss(true, false)))
