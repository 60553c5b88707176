"""Sample ids, paths and the deterministic hash that stands in for random numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where the body loops over an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sample_hash(id_col: Column | str, seed: int = SEED) -> Column:
    """md5 of ``seed:id``. Sorting by it is a shuffle that every run repeats."""
    return F.md5(F.concat(F.lit(f"{seed}:"), as_column(id_col).cast("string")).cast("binary"))


def id_from_path(path: Column | str) -> Column:
    """Base name up to its first dot."""
    return F.substring_index(F.substring_index(as_column(path), "/", -1), ".", 1)


def with_suffix(path: Column | str, suffix: str) -> Column:
    """Append ``suffix`` where it is missing."""
    p = as_column(path)
    return F.when(p.endswith(suffix), p).otherwise(F.concat(p, F.lit(suffix)))


def id_prefix(id_col: Column | str, length: int) -> Column:
    return F.substring(as_column(id_col).cast("string"), 1, length)


def shard_of(id_col: Column | str, shards: int, seed: int = SEED) -> Column:
    """Shard number from the leading hex digits of the hash: every id is in exactly one shard."""
    digits = F.conv(F.substring(sample_hash(id_col, seed), 1, 8), 16, 10).cast("bigint")
    return F.pmod(digits, F.lit(shards)).cast("int")
