"""Exact ranks, cuts, running totals and quantiles without a one-partition window.

All of them share one idea. A coarse bucket that is monotone in the sort order is counted
first (a small table, combined map-side), the counts are turned into offsets, and only the
rows of one bucket are ever sorted together. Buckets come from the leading digits of the
sample hash, from approximate quantiles of a numeric key, or from a sample of whole strings.
A key that equals a boundary may be held by very many rows, so such keys get a bucket per hash
prefix.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samplemill.functions.ids import SEED, sample_hash

HASH_DIGITS = 3
HOT_DIGITS = 2
KEY_BUCKETS = ["_q", "_side", "_s"]
#: Text keys: sampled keys per bucket (with 40, no bucket is likely to hold twice the mean), and the longest bound.
OVERSAMPLE = 40
BOUND_CHARS = 1024


def _offsets(keyed: DataFrame, by: Sequence[str], buckets: Sequence[str]) -> DataFrame:
    """Rows per bucket and the rows of the same group that lie in earlier buckets."""
    before = (
        Window.partitionBy(*by).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = keyed.groupBy(*by, *buckets).agg(F.count(F.lit(1)).alias("_n"))
    return counts.withColumn("_lo", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint")))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def _rank(keyed: DataFrame, by: Sequence[str], buckets: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    offsets = _offsets(keyed, by, buckets).drop("_n")
    w = Window.partitionBy(*by, *buckets).orderBy(*order)
    return (
        join_null_safe(keyed, offsets, [*by, *buckets])
        .withColumn(name, (F.col("_lo") + F.row_number().over(w)).cast("bigint"))
        .drop("_lo")
    )


def hash_rank(df: DataFrame, id_col: str, by: Sequence[str] = (), seed: int = SEED, name: str = "rank") -> DataFrame:
    """1-based rank by the sample hash, per group or over all rows."""
    keyed = df.withColumn("_h", sample_hash(id_col, seed)).withColumn("_b", F.substring("_h", 1, HASH_DIGITS))
    return _rank(keyed, by, ["_b"], ["_h", id_col], name).drop("_h", "_b")


def name_rank(df: DataFrame, id_col: str, by: Sequence[str] = (), name: str = "rank", buckets: int | None = None) -> DataFrame:
    """1-based rank by a text id, whatever prefix the ids have in common."""
    keyed = in_key_order(df, id_col, id_col, SEED, buckets)
    return _rank(keyed, by, KEY_BUCKETS, [id_col], name).drop(*KEY_BUCKETS, "_h")


def hash_cut(
    df: DataFrame,
    id_col: str,
    cuts: Sequence[int] | DataFrame,
    by: Sequence[str] = (),
    seed: int = SEED,
    name: str = "part",
) -> DataFrame:
    """Cut the hash order at given positions; ``name`` is the 0-based part of each row.

    ``cuts`` is a list of ascending positions, or one row per group with the array column
    ``cuts``. Rows of a bucket that lies inside one part need no rank at all; only the few
    buckets that a cut goes through are shuffled and sorted.
    """
    keyed = df.withColumn("_h", sample_hash(id_col, seed)).withColumn("_b", F.substring("_h", 1, HASH_DIGITS))
    return _cut(keyed, by, ["_b"], ["_h", id_col], cuts, name).drop("_h", "_b")


def ordered_cut(
    df: DataFrame,
    key: str,
    id_col: str,
    cuts: Sequence[int] | DataFrame,
    by: Sequence[str] = (),
    seed: int = SEED,
    name: str = "part",
    buckets: int | None = None,
) -> DataFrame:
    """Cut the order by ``(key, sample hash, id)`` at given positions, as ``hash_cut`` does with the hash order."""
    keyed = in_key_order(df, key, id_col, seed, buckets)
    return _cut(keyed, by, KEY_BUCKETS, [key, "_h", id_col], cuts, name).drop(*KEY_BUCKETS, "_h")


def _cut(
    keyed: DataFrame, by: Sequence[str], buckets: Sequence[str], order: Sequence[str], cuts: Sequence[int] | DataFrame, name: str
) -> DataFrame:
    table = _offsets(keyed, by, buckets)
    if isinstance(cuts, DataFrame):
        table = join_null_safe(table, cuts.select(*by, F.col("cuts").alias("_cuts")), by)
    else:
        table = table.withColumn("_cuts", F.array(*[F.lit(int(c)).cast("bigint") for c in cuts]))

    def part(rank: Column) -> Column:
        return F.size(F.filter("_cuts", lambda c: c < rank))

    table = table.withColumn("_first", part(F.col("_lo") + 1)).withColumn("_last", part(F.col("_lo") + F.col("_n")))
    table = table.drop("_n")
    if not by:
        # As many rows as there are buckets, however large the input is.
        table = F.broadcast(table)
    placed = join_null_safe(keyed, table, [*by, *buckets])
    whole = placed.where("_first = _last").withColumn(name, F.col("_first"))
    w = Window.partitionBy(*by, *buckets).orderBy(*order)
    divided = placed.where("_first <> _last").withColumn(name, part(F.col("_lo") + F.row_number().over(w)))
    return whole.unionByName(divided).drop("_lo", "_cuts", "_first", "_last")


def order_buckets(df: DataFrame) -> int:
    """A few buckets per shuffle partition: 64 on a laptop, up to 4096 on a large cluster."""
    return min(4096, max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def is_text(df: DataFrame, key: str) -> bool:
    return isinstance(df.schema[key].dataType, (T.StringType, T.BinaryType))


def order_key(df: DataFrame, key: str) -> Column:
    """A value in the order of ``key``: times in microseconds, bytes as hex text, text and numbers as they are."""
    kind = df.schema[key].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(key)
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{key}`)")
    if isinstance(kind, T.DateType):
        return F.unix_date(key)
    if isinstance(kind, T.BinaryType):
        return F.hex(key)
    return F.col(key)


def quantile_bounds(df: DataFrame, key: str, buckets: int | None = None) -> list:
    """At most ``buckets - 1`` distinct inner boundaries of the order key, in its own type (the only values sent to the driver)."""
    buckets = buckets or order_buckets(df)
    if is_text(df, key):
        return _text_bounds(df, key, buckets)
    shares = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(order_key(df, key), shares, 20 * buckets).alias("q")).first()
    return sorted(set(row.q)) if row and row.q else []


def _text_bounds(df: DataFrame, key: str, buckets: int) -> list[str]:
    """Quantiles of a sample of about ``OVERSAMPLE`` whole strings per bucket.

    What falls between two bounds is compared in full, so a common prefix does no harm up to ``BOUND_CHARS`` characters.
    """
    keys = df.select(order_key(df, key).alias("_k")).where("_k IS NOT NULL")
    n, wanted = keys.count(), OVERSAMPLE * buckets
    sampled = keys if n <= wanted else keys.sample(min(1.0, wanted / n), SEED)
    # Python orders strings by code point, which is the order of their UTF-8 bytes and so Spark's.
    found = sorted(r[0] for r in sampled.select(F.left("_k", F.lit(BOUND_CHARS))).collect())
    return sorted({found[i * len(found) // buckets] for i in range(1, buckets)}) if found else []


def quantile_bucket(df: DataFrame, key: str, bounds: Sequence) -> DataFrame:
    """Add ``_q``, the bucket of ``key``, and ``_side``: 0 below, 1 at and 2 above the bucket's bound.

    Buckets of numbers are looked up as doubles. That never puts a larger key into an earlier bucket, but keys beyond
    2 ** 53 near a bound may share its bucket on either side of it; ``_side`` compares them exactly, in their own
    type. Buckets of text are looked up by binary search in the sorted bounds. NULL is in the last bucket.
    """
    if is_text(df, key):
        return _text_bucket(df, key, bounds)
    exact = {float(b): b for b in reversed(list(bounds))} or {0.0: 0}
    doubles = sorted(exact)
    splits = [float("-inf"), *doubles, float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="_k", outputCol="_q", handleInvalid="keep").transform(
        df.withColumn("_o", order_key(df, key)).withColumn("_k", F.col("_o").cast("double"))
    )
    # The first bucket has no bound: everything in it is above.
    bound = F.element_at(F.array(F.lit(None), *[F.lit(exact[d]) for d in doubles]), F.least(F.col("_q").cast("int") + 1, F.lit(len(doubles) + 1)))
    side = F.when(F.col("_o") < bound, 0).when(F.col("_o") == bound, 1).otherwise(2)
    return bucketed.withColumn("_side", side).drop("_k", "_o")


def _text_bucket(df: DataFrame, key: str, bounds: Sequence[str]) -> DataFrame:
    # One literal however many bounds there are; it is parsed once, when the plan is made.
    table = F.from_json(F.lit(json.dumps(list(bounds))), "array<string>")
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    halved = F.aggregate(
        F.array(*[F.lit(x) for x in steps]) if steps else F.array().cast("array<int>"),
        F.lit(0),
        lambda at, step: F.when(F.get(table, at + step - 1) <= F.col("_o"), at + step).otherwise(at),
    )
    placed = df.withColumn("_o", order_key(df, key))
    placed = placed.withColumn("_q", F.when(F.col("_o").isNull(), len(bounds) + 1).otherwise(halved))
    return placed.withColumn("_side", F.when(F.get(table, F.col("_q") - 1) == F.col("_o"), 1).otherwise(2)).drop("_o")


def ordered_rank(
    df: DataFrame,
    key: str,
    id_col: str,
    by: Sequence[str] = (),
    seed: int = SEED,
    name: str = "rank",
    buckets: int | None = None,
) -> DataFrame:
    """1-based rank by ``(key, sample hash, id)``, exact also when one key holds most rows."""
    keyed = in_key_order(df, key, id_col, seed, buckets)
    return _rank(keyed, by, KEY_BUCKETS, [key, "_h", id_col], name).drop(*KEY_BUCKETS, "_h")


def in_key_order(df: DataFrame, key: str, id_col: str, seed: int, buckets: int | None) -> DataFrame:
    """Add ``KEY_BUCKETS``, which never fall where the key rises, and the sample hash ``_h``."""
    # Rows at a bound all have that key, so that hash prefixes may divide them further.
    return (
        quantile_bucket(df, key, quantile_bounds(df, key, buckets))
        .withColumn("_h", sample_hash(id_col, seed))
        .withColumn("_s", F.when(F.col("_side") == 1, F.substring("_h", 1, HOT_DIGITS)).otherwise(F.lit("")))
    )


def running_totals(
    df: DataFrame,
    key: str,
    sums: dict[str, str],
    by: Sequence[str] = (),
    buckets: int | None = None,
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Sums over all rows with a smaller key, for a table with one row per (group, key).

    ``sums`` maps a value column to the name of its exclusive running total, ``totals`` maps
    value columns to the name of the sum over the whole group.
    """
    totals = totals or {}
    keyed = quantile_bucket(df, key, quantile_bounds(df, key, buckets)).drop("_side")
    earlier = Window.partitionBy(*by).orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by, "_q").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    table = keyed.groupBy(*by, "_q").agg(*[F.sum(v).alias(f"_t_{v}") for v in sums])
    for v in sums:
        table = table.withColumn(f"_o_{v}", F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)))
    for v, total in totals.items():
        table = table.withColumn(total, F.sum(f"_t_{v}").over(Window.partitionBy(*by)))
    table = table.drop(*[f"_t_{v}" for v in sums])
    out = join_null_safe(keyed, table, [*by, "_q"])
    for v, total in sums.items():
        out = out.withColumn(total, F.col(f"_o_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0)))
    return out.drop("_q", *[f"_o_{v}" for v in sums])


def exact_quantiles(
    df: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = (), counted: str | None = None
) -> DataFrame:
    """Linearly interpolated quantiles from value counts, one row per group.

    Equal values are combined before the shuffle, so neither a frequent value nor a large
    group ends up in one task. ``counted`` names the count of a table that has one row per group and value already.
    """
    if counted is None:
        counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    else:
        counts = df.select(*by, value, F.col(counted).alias("_c"))
    placed = running_totals(counts, value, {"_c": "_before"}, by, totals={"_c": "_total"})
    after = F.col("_before") + F.col("_c")
    aggs = []
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("_total") - 1)
        lo, hi = F.floor(at), F.ceil(at)
        aggs += [
            F.max(F.when((F.col("_before") <= lo) & (lo < after), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when((F.col("_before") <= hi) & (hi < after), F.col(value))).alias(f"_hi_{name}"),
            F.max(at - lo).alias(f"_f_{name}"),
        ]
    out = placed.groupBy(*by).agg(*aggs)
    return out.select(
        *by,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in shares
        ],
    )
