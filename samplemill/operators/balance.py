"""Class ratios: down-sampling, over-sampling, weights and caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samplemill.functions.ids import SEED
from samplemill.plans.ordered import hash_cut, hash_rank, join_null_safe
from samplemill.plans.session import cut

TOLERANCE = 0.025


def bias_targets(n_minority: int, n_majority: int, ratio: float) -> tuple[int, int]:
    """Rows to keep of the minority and the majority class; at most one of them shrinks."""
    total = n_minority + n_majority
    if total <= 2:
        raise ValueError("more than two rows are needed")
    if not 0.0 < ratio < 1.0:
        raise ValueError("the ratio must lie strictly between 0 and 1")
    share = n_minority / total
    if share > ratio:
        return int(ratio * n_majority / (1 - ratio)), n_majority
    if share < ratio:
        return n_minority, int(n_minority * (1 - ratio) / ratio)
    return n_minority, n_majority


def spatial_bias(
    df: DataFrame, id_col: str, label: str, minority, ratio: float, seed: int = SEED, check: bool = True
) -> DataFrame:
    """Remove rows of one class until the minority class has the given share.

    Class counts decide how many rows stay; which ones is the hash order. Only the hash
    bucket that holds the cut is shuffled.
    """
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(3).collect()}
    if len(counts) != 2 or minority not in counts:
        raise ValueError(f"exactly two classes are needed, one of them {minority!r}: {counts}")
    majority = next(c for c in counts if c != minority)
    keep_min, keep_maj = bias_targets(counts[minority], counts[majority], ratio)
    if check:
        got = keep_min / max(1, keep_min + keep_maj)
        if abs(round(got, 4) - ratio) > TOLERANCE:
            raise ValueError(f"the reachable share {got:.4f} is too far from {ratio}")
    if keep_min < counts[minority]:
        shrink, keep = minority, keep_min
    elif keep_maj < counts[majority]:
        shrink, keep = majority, keep_maj
    else:
        return df
    stay = df.where(F.col(label) != F.lit(shrink))
    taken = hash_cut(df.where(F.col(label) == F.lit(shrink)), id_col, [keep], seed=seed, name="_part")
    return stay.unionByName(taken.where("_part = 0").drop("_part"))


def oversample(df: DataFrame, id_col: str, label: str, shares: dict, seed: int = SEED) -> DataFrame:
    """Repeat rows towards target class shares; column ``copy`` is 0 for the original.

    A class of n rows among N gets ``int((p * N - n) / (1 - p))`` extra rows, spread evenly:
    each row is repeated equally often, the first rows in hash order once more.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    p = F.lit(None).cast("double")
    for value, share in shares.items():
        p = F.when(F.col(label) == F.lit(value), F.lit(float(share))).otherwise(p)
    extra = F.greatest(F.lit(0.0), F.coalesce((p * total - F.col("_n")) / (1 - p), F.lit(0.0))).cast("bigint")
    every = F.floor(F.col("_extra") / F.col("_n"))
    table = counts.withColumn("_extra", extra).select(
        label, every.alias("_every"), F.array(F.col("_extra") - every * F.col("_n")).alias("cuts")
    )
    # Only the hash buckets with the cut between the rows repeated once more and the others are ranked.
    parts = join_null_safe(hash_cut(df, id_col, table, [label], seed, "_part"), table.drop("cuts"), [label])
    times = F.col("_every") + (F.col("_part") == 0).cast("bigint")
    return parts.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), times))).drop("_every", "_part")


def class_weights(df: DataFrame, label: str, beta: float = 0.999) -> DataFrame:
    """Inverse frequency and effective-number weights per class."""
    n = F.col("n")
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).select(
        label,
        "n",
        (F.lit(1.0) / n).alias("inverse"),
        (F.lit(1.0 - beta) / (F.lit(1.0) - F.pow(F.lit(beta), n))).alias("effective"),
    )


def cap_label_imbalance(
    df: DataFrame, id_col: str, labels: str, ratio: float, seed: int = SEED, split: str | None = None
) -> DataFrame:
    """Multi-label imbalance cap: no row is left whose labels are all over ``ratio`` times the rarest.

    With ``split``, every split has its own rarest label and its own cap. Rounds of bounded removal: in each, a label
    may lose at most its excess, and a row goes if, in hash order among the rows that may go, its rank in each of its
    labels is within what the label may lose. The first row in hash order always is, so the rounds end. Ranks are
    exact and found in hash buckets, so a label may hold any share of the rows.
    """
    part = F.lit("") if split is None else F.col(split).cast("string")
    flat = cut(df.select(id_col, part.alias("_split"), F.explode(F.array_distinct(labels)).alias("_label")), "flat")
    keys = ["_split", "_label"]
    caps = cut(_label_counts(flat).groupBy("_split").agg(F.floor(ratio * F.min("n")).alias("_cap")), "caps")
    while True:
        counts = join_null_safe(_label_counts(flat), caps, ["_split"])
        over = counts.select(*keys, F.greatest(F.lit(0), F.col("n") - F.col("_cap")).alias("_excess"))
        least = F.min("_excess").over(Window.partitionBy(id_col, "_split"))
        rows = join_null_safe(flat, over, keys).withColumn("_least", least).where("_least > 0").drop("_least")
        rows = cut(rows, "candidates")
        if rows.isEmpty():
            return df.join(flat.select(id_col).distinct(), id_col, "left_semi")
        ranked = hash_rank(rows, id_col, keys, seed, "_rank")
        gone = ranked.groupBy(id_col).agg(F.bool_and(F.col("_rank") <= F.col("_excess")).alias("_ok")).where("_ok")
        flat = cut(flat.join(gone.select(id_col), id_col, "left_anti"), "flat")


def _label_counts(flat: DataFrame) -> DataFrame:
    return flat.groupBy("_split", "_label").agg(F.count(F.lit(1)).alias("n"))
