"""Training, validation and test splits; every split is a pure function of ids, times and a seed."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samplemill.functions.ids import SEED, sample_hash
from samplemill.operators.filters import first_of
from samplemill.plans.ordered import (
    hash_cut,
    hash_rank,
    name_rank,
    ordered_cut,
    ordered_rank,
    running_totals,
)
from samplemill.plans.session import cut

SPLITS = ("tr", "vl", "ts")
#: Ratios are fractions with a common denominator up to this; others are refused.
DENOMINATOR = 1_000_000
#: Turns that are written into the query itself; longer lists go with the tasks.
INLINE_TURNS = 10_000


def integer_sizes(total: int, sizes: Sequence[int | float]) -> tuple[int, int, int]:
    """Split sizes as counts. Shares are floored; the last part that is not empty, test or validation, gets the rest."""
    if all(isinstance(s, int) for s in sizes):
        return tuple(sizes)
    if any(isinstance(s, int) for s in sizes):
        raise TypeError("sizes must be all int or all float")
    counts = [math.floor(total * s) for s in sizes]
    rest = total - sum(counts)
    last = max((i for i, n in enumerate(counts) if n), default=0)
    if rest < 0 or rest and last == 0:
        raise ValueError(f"the shares {tuple(sizes)} of {total} rows leave {rest} over")
    counts[last] += rest
    return tuple(counts)


def part_name(part: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SPLITS]), part + 1)


def random_split(df: DataFrame, id_col: str, sizes: Sequence[int | float], seed: int = SEED) -> DataFrame:
    """Random split with exact sizes. Rows beyond the three sizes are left out, as asked for.

    A training size of -1 takes all rows that validation and test leave.
    """
    if all(isinstance(s, int) for s in sizes) and sizes[0] >= 0:
        tr, vl, ts = sizes
    else:
        total = df.count()
        if sizes[0] == -1:
            vl, ts = sizes[1:]
            tr = total - vl - ts
        else:
            tr, vl, ts = integer_sizes(total, sizes)
    parts = hash_cut(df, id_col, [tr, tr + vl, tr + vl + ts], seed=seed, name="_part")
    return parts.where("_part < 3").withColumn("split", part_name(F.col("_part"))).drop("_part")


def guaranteed_split(
    df: DataFrame, id_col: str, label: str, sizes: Sequence[int | float], per_class: int, seed: int = SEED
) -> DataFrame:
    """Random split in which every class has at least ``per_class`` rows in every non-empty split.

    The first rows of each class in hash order seed the splits; the rest fills the sizes.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("total"), F.min("n").alias("least"), F.count(F.lit(1)).alias("classes")
    ).first()
    sizes = integer_sizes(counts.total, sizes)
    used = [i for i, s in enumerate(sizes) if s > 0]
    if counts.least < per_class * len(used):
        raise ValueError(f"a class has {counts.least} rows, {per_class * len(used)} are needed")
    if any(sizes[i] < counts.classes * per_class for i in used):
        raise ValueError("a split is too small to hold every class")

    w = Window.partitionBy(label).orderBy("_h", id_col)
    seeds = (
        df.select(id_col, label)
        .withColumn("_h", sample_hash(id_col, seed))
        .withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= per_class * len(used))
        .select(
            id_col,
            F.element_at(
                F.array(*[F.lit(SPLITS[i]) for i in used]), ((F.col("_rn") - 1) / per_class).cast("int") + 1
            ).alias("split"),
        )
    )
    seeded = df.join(seeds, id_col)
    open_sizes = [s - counts.classes * per_class if s > 0 else 0 for s in sizes]
    cuts = [open_sizes[0], sum(open_sizes[:2]), sum(open_sizes)]
    rest = hash_cut(df.join(seeds, id_col, "left_anti"), id_col, cuts, seed=seed, name="_part")
    rest = rest.where("_part < 3").withColumn("split", part_name(F.col("_part"))).drop("_part")
    return seeded.unionByName(rest)


def _shares(ratios: Sequence[float]) -> list[int]:
    """What each target gets of a period, whose length is the common denominator of the shares."""
    parts = [Fraction(r).limit_denominator(DENOMINATOR) for r in ratios]
    shares = [p / sum(parts) for p in parts]
    d = math.lcm(*(s.denominator for s in shares))
    if d > DENOMINATOR or any(float(p) != float(r) for p, r in zip(parts, ratios)):
        raise ValueError(f"the ratios {tuple(ratios)} are no fractions with a common denominator of at most {DENOMINATOR}")
    return [int(s * d) for s in shares]


def _turns(due: Sequence[int], start: Sequence[int]) -> np.ndarray:
    """Counts after 0, 1, 2, ... items, up to the end of the first period of the turns.

    Only differences between shares and counts decide whose turn it is, so once a period of items has changed none of
    them, the turns repeat for ever.
    """
    d, total = sum(due), sum(start)
    counts = np.zeros((3 * d + 100, len(due)), np.int64)
    counts[0] = now = list(start)
    for k in range(1, 10 * d + 10 * DENOMINATOR):
        # Before the first item nobody is behind, and the largest share begins.
        behind = [x * total - d * n for x, n in zip(due, now)] if total else due
        turn = behind.index(max(behind))
        now[turn] += 1
        total += 1
        if k == len(counts):
            counts = np.concatenate([counts, np.zeros_like(counts)])
        counts[k] = now
        if k > d and (counts[k] - counts[k - d] == due).all():
            return counts[: k + 1]
    raise ValueError(f"{tuple(start)} is too far from the ratios")


def apportion(n: Column, ratios: Sequence[float], start: Sequence[int] = (0, 0, 0)) -> Column:
    """Give ``n`` items one by one to the target furthest below its share, the first of equals; returns three counts.

    The turns of one period are worked out beforehand; any number of items is then whole periods and a place in one,
    in exact integers. Ratios are taken as they are or refused, never rounded.
    """
    due = _shares(ratios)
    counts = _turns(due, start)
    d, last = sum(due), len(counts) - 1
    n = n.cast("bigint")
    place = F.when(n <= last, n).otherwise(last - d + F.pmod(n - (last - d), F.lit(d).cast("bigint")))
    periods = F.floor((n - place) / F.lit(d).cast("decimal(20,0)")).cast("bigint")
    if len(counts) <= INLINE_TURNS:
        found = F.array(*[F.element_at(F.array(*[F.lit(int(c)).cast("bigint") for c in column]), place.cast("int") + 1) for column in counts.T])
    else:

        @F.pandas_udf("array<bigint>")
        def at(places: pd.Series) -> pd.Series:
            return pd.Series(list(counts[places.to_numpy()]))

        found = at(place)
    return F.struct(*[(F.get(found, F.lit(i)) + periods * x).alias(s) for i, (x, s) in enumerate(zip(due, SPLITS))])


def class_quotas(df: DataFrame, label: str, ratios: Sequence[float]) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("_q", apportion(F.col("n"), ratios)).select(label, "n", "_q.*")


def temporal_class_split(
    df: DataFrame, id_col: str, label: str, ts: str, ratios: Sequence[float], seed: int = SEED
) -> DataFrame:
    """Within each class the oldest rows train, the next validate, the newest test."""
    quotas = class_quotas(df, label, ratios)
    cuts = quotas.select(label, F.array("tr", F.col("tr") + F.col("vl")).alias("cuts"))
    parts = ordered_cut(df, ts, id_col, cuts, [label], seed, "_part")
    return parts.withColumn("split", part_name(F.col("_part"))).drop("_part")


def temporal_boundary(df: DataFrame, ts: str, tr_size: int) -> int | None:
    """First time of the validation set when the oldest ``tr_size`` rows train.

    Rows that share the time at the boundary stay together, on the side that holds more of
    them (training if equal). Computed from counts per time.
    """
    counts = df.groupBy(ts).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_totals(counts, ts, {"_n": "_lt"})
    k = F.lit(tr_size)
    at = placed.where((F.col("_lt") <= k) & (k < F.col("_lt") + F.col("_n"))).select(ts, "_lt", "_n").first()
    if at is None:
        return None
    below, above = tr_size - at["_lt"], at["_lt"] + at["_n"] - tr_size - 1
    if below == 0 or below < above:
        return at[ts]
    later = df.where(F.col(ts) > F.lit(at[ts])).agg(F.min(ts)).first()[0]
    return later if later is not None else at[ts] + 1


def temporal_split(
    df: DataFrame, ts: str, sizes: Sequence[int | float], label: str | None = None
) -> DataFrame:
    """Absolute temporal split into training and validation; there is no test part."""
    total = df.count()
    tr, vl, ts_size = integer_sizes(total, sizes)
    if ts_size != 0 or vl == 0:
        raise NotImplementedError("an absolute temporal split has a validation set and no test set")
    boundary = temporal_boundary(df, ts, tr)
    side = F.lit("tr") if boundary is None else F.when(F.col(ts) < F.lit(boundary), "tr").otherwise("vl")
    out = df.withColumn("split", side)
    if label is not None:
        lost = out.groupBy(label).agg(F.count_distinct("split").alias("n")).where("n < 2").count()
        if lost:
            raise ValueError(f"{lost} classes are missing from one side of the split")
    return out


def few_shot_split(
    df: DataFrame, id_col: str, label: str, order: str, tr_per_class: int, vl_max: int, vl_min: int = 1
) -> DataFrame:
    """First rows of each class train; the last rows, at most ``vl_max``, validate.

    Classes with fewer than ``tr_per_class + vl_min`` rows are left out.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= tr_per_class + vl_min)
    kept = df.join(counts, label)
    tr = first_of(kept, label, [order, id_col], tr_per_class).withColumn("split", F.lit("tr"))
    w = Window.partitionBy(label).orderBy(F.desc(order), F.desc(id_col))
    vl = (
        kept.withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= vl_max)
        .where(F.col("_rn") <= F.col("_n") - tr_per_class)
        .drop("_rn")
        .withColumn("split", F.lit("vl"))
    )
    return tr.unionByName(vl).drop("_n")


def _labelled(df: DataFrame, id_col: str, labels: str, seed: int) -> DataFrame:
    """``(id_col, _label, _h)``: the distinct labels of every sample."""
    flat = df.select(id_col, F.explode(F.array_distinct(labels)).alias("_label"))
    return cut(flat.withColumn("_h", sample_hash(id_col, seed)), "labels")


def without_needless(chosen: DataFrame, id_col: str, need: DataFrame) -> DataFrame:
    """Ids of the chosen samples ``(id_col, _label, _h)`` less those that no label needs ``(_label, _need)``.

    A round looks at all samples whose labels all have more samples than they need. Of these, a label lets as many go as
    it has too many, the last in hash order first, and a sample goes if all its labels let it go. So no label
    ever has too few, the last sample in hash order always goes, and in the end every sample is needed by a label.
    """
    while True:
        have = chosen.groupBy("_label").agg(F.count(F.lit(1)).alias("_have"))
        spare = have.join(need, "_label").select("_label", (F.col("_have") - F.col("_need")).alias("_spare"))
        free = chosen.join(spare, "_label").groupBy(id_col, "_h").agg(
            F.min("_spare").alias("_least"), F.collect_list(F.struct("_label", "_spare")).alias("_l")
        )
        free = free.where("_least > 0").select(id_col, "_h", F.explode("_l").alias("_l")).select(id_col, "_h", "_l.*")
        place = F.row_number().over(Window.partitionBy("_label").orderBy(F.desc("_h"), F.desc(id_col)))
        ranked = free.withColumn("_goes", place <= F.col("_spare"))
        gone = cut(ranked.groupBy(id_col).agg(F.bool_and("_goes").alias("_g")).where("_g").select(id_col), "needless")
        if gone.isEmpty():
            return chosen.select(id_col).distinct()
        chosen = cut(chosen.join(gone, id_col, "left_anti"), "chosen")


def labels_per_class(df: DataFrame, id_col: str, labels: str, k: int, seed: int = SEED) -> DataFrame:
    """Multi-label sample set in which every label has at least ``min(k, n)`` samples, and no sample is needless.

    Each round takes, for every label still short of ``k``, its next samples in hash order.
    A sample taken for one label counts for all its labels, so later rounds need less. Samples that
    turn out to be needed by no label are left out again.
    """
    flat = _labelled(df, id_col, labels, seed)
    need = cut(
        flat.groupBy("_label").agg(F.least(F.count(F.lit(1)), F.lit(k).cast("bigint")).alias("_need")), "need"
    )
    chosen = flat.select(id_col).limit(0)
    while True:
        have = flat.join(chosen, id_col, "left_semi").groupBy("_label").agg(F.count(F.lit(1)).alias("_have"))
        short = (
            need.join(have, "_label", "left")
            .withColumn("_short", F.col("_need") - F.coalesce(F.col("_have"), F.lit(0)))
            .where("_short > 0")
            .select("_label", "_short")
        )
        # Only part of each deficit at a time, so that samples shared by labels are not taken twice.
        open_rows = flat.join(chosen, id_col, "left_anti").join(short, "_label")
        w = Window.partitionBy("_label").orderBy("_h", id_col)
        picked = (
            open_rows.withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= k)
            .where(F.col("_rn") <= F.ceil(F.col("_short") * 0.75))
            .select(id_col)
            .distinct()
        )
        new = cut(chosen.unionByName(picked), "chosen")
        if new.count() == chosen.count():
            break
        chosen = new
    kept = without_needless(cut(flat.join(chosen, id_col, "left_semi"), "chosen"), id_col, need)
    return df.join(cut(kept, "kept"), id_col, "left_semi")


def guaranteed_label_split(
    df: DataFrame, id_col: str, labels: str, sizes: Sequence[int | float], per_label: int, seed: int = SEED
) -> DataFrame:
    """Multi-label split: each split first gets ``per_label`` samples of every label, then fills up.

    All rows are assigned. A label with too few samples seeds the earlier splits first. No seed is needless in its
    split. Where the seeds of a split exceed its size, the later splits get correspondingly fewer rows.
    """
    ids = cut(df.select(id_col, labels), "samples")
    total = ids.count()
    sizes = integer_sizes(total, sizes)
    flat = _labelled(ids, id_col, labels, seed)
    seeded = ids.select(id_col, F.lit("").alias("split")).limit(0)
    for name, size in zip(SPLITS, sizes):
        if size == 0:
            continue
        w = Window.partitionBy("_label").orderBy("_h", id_col)
        heads = flat.join(seeded, id_col, "left_anti").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_label)
        heads = cut(heads.drop("_rn"), "heads")
        need = heads.groupBy("_label").agg(F.count(F.lit(1)).alias("_need"))
        # Heads of one label have other labels, too, which then may have more than they need.
        chosen = cut(flat.join(heads.select(id_col).distinct(), id_col, "left_semi"), "chosen")
        picked = without_needless(chosen, id_col, cut(need, "need"))
        seeded = cut(seeded.unionByName(picked.withColumn("split", F.lit(name))), "seeds")
    have = {r["split"]: r["n"] for r in seeded.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    rest_size = total - sum(have.values())
    want = [max(0, s - have.get(n, 0)) for n, s in zip(SPLITS, sizes)]
    last = max(i for i, s in enumerate(sizes) if s > 0)
    tr = min(want[0], rest_size)
    vl = min(want[1], rest_size - tr)
    cuts = [tr if last > 0 else rest_size, tr + vl if last > 1 else rest_size, rest_size]
    rest = cut(ids.select(id_col).join(seeded, id_col, "left_anti"), "rest")
    rest = hash_cut(rest, id_col, cuts, seed=seed, name="_part").withColumn("split", part_name(F.col("_part")))
    return df.join(seeded.unionByName(rest.select(id_col, "split")), id_col)


def temporal_checks(df: DataFrame, ts: str, label: str | None = None) -> DataFrame:
    """First and last time per split and whether training < validation < test holds."""
    keys = [label] if label else []
    aggs = []
    for s in SPLITS:
        t = F.when(F.col("split") == s, F.col(ts))
        aggs += [F.min(t).alias(f"{s}_min"), F.max(t).alias(f"{s}_max")]
    latest = F.coalesce(F.col("vl_max"), F.col("tr_max"))
    ok = F.coalesce(F.col("tr_max") < F.col("vl_min"), F.lit(True)) & F.coalesce(
        latest < F.col("ts_min"), F.lit(True)
    )
    return df.groupBy(*keys).agg(*aggs).withColumn("ok", ok)


def shuffle_positions(df: DataFrame, id_col: str, seed: int = SEED) -> DataFrame:
    """The permutation itself: position of each row in hash order."""
    return hash_rank(df, id_col, seed=seed, name="position")


def thirds(df: DataFrame, id_col: str, key: str | None = None) -> DataFrame:
    """Three parts of ``floor(n / 3)`` rows; the remainder belongs to none.

    Rows are in the order of a numeric ``key``, or of a text id without one.
    """
    size = df.count() // 3
    ranked = name_rank(df, id_col, name="_rank") if key is None else ordered_rank(df, key, id_col, name="_rank")
    part = F.floor((F.col("_rank") - 1) / F.lit(max(size, 1))).cast("int")
    return ranked.withColumn("third", part).where("third < 3").drop("_rank")


def stratified_split(
    df: DataFrame, id_col: str, label: str, ratios: Sequence[float], seed: int = SEED
) -> DataFrame:
    """Random split that keeps class proportions; classes with a single row are removed first.

    Every split with a share gets at least one row of each class that has enough rows.
    """
    n = F.col("n")
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    first = F.greatest(F.lit(1), F.floor(n * F.lit(float(ratios[0]))))
    used = [r > 0 for r in ratios]
    first = F.least(first, n - (sum(used) - 1))
    second = F.floor(n * F.lit(float(ratios[0] + ratios[1])))
    second = F.least(F.greatest(second, first + int(used[1])), n - int(used[2]))
    cuts = counts.select(label, F.array(first.cast("bigint"), second.cast("bigint"), n).alias("cuts"))
    parts = hash_cut(df.join(counts.select(label), label, "left_semi"), id_col, cuts, [label], seed, "_part")
    return parts.withColumn("split", part_name(F.col("_part"))).drop("_part")
