"""Filters and projections on sample tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samplemill.functions.ids import SEED, as_column, id_prefix, shard_of
from samplemill.plans.ordered import ordered_cut
from samplemill.plans.session import cut

PROTOCOLS = ("any", "yes", "no", "unk")


def size_range(df: DataFrame, size: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Keep samples with ``lo <= size <= hi``; an open end is None."""
    if lo is not None:
        df = df.where(F.col(size) >= lo)
    if hi is not None:
        df = df.where(F.col(size) <= hi)
    return df


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def frequent_classes(df: DataFrame, label: str, top_k: int | None = None, min_freq: int = 0) -> DataFrame:
    """Classes among the ``top_k`` most frequent that have at least ``min_freq`` samples, with count ``n``."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    if top_k is not None:
        counts = counts.orderBy(F.desc("n"), F.asc(label)).limit(top_k)
    return counts.where(F.col("n") >= min_freq)


def keep_frequent(df: DataFrame, label: str, top_k: int | None = None, min_freq: int = 0) -> DataFrame:
    return df.join(frequent_classes(df, label, top_k, min_freq).select(label), label, "left_semi")


def keep_frequent_labels(
    df: DataFrame, id_col: str, labels: str, top_k: int | None = None, min_freq: int = 0
) -> DataFrame:
    """Multi-label form: drop rare labels from each array, then samples left without any.

    The kept labels come back in their order within the sample. The class table may be long,
    so it is joined, never collected into an array.
    """
    flat = df.select(id_col, F.posexplode(labels).alias("_pos", "_label"))
    kept = flat.join(frequent_classes(flat, "_label", top_k, min_freq).select("_label"), "_label", "left_semi")
    arrays = kept.groupBy(id_col).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_label"))), lambda s: s["_label"]).alias(labels)
    )
    return df.drop(labels).join(arrays, id_col)


def cap_imbalance(df: DataFrame, label: str, order: str, id_col: str, ratio: float, seed: int = SEED) -> DataFrame:
    """Keep the last ``floor(ratio * smallest class)`` rows of each class in ``order``.

    Of the classes above the cap, only rows in the order bucket that the cut goes through are ranked.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    least = counts.agg(F.min("_n")).first()[0] or 0
    cap = int(ratio * least)
    cuts = counts.select(label, F.array(F.greatest(F.lit(0).cast("bigint"), F.col("_n") - cap)).alias("cuts"))
    return ordered_cut(df, order, id_col, cuts, [label], seed, "_part").where("_part = 1").drop("_part")


def packing_state(df: DataFrame, packed: DataFrame, key: str) -> DataFrame:
    """Attach the tri-state flag ``is_packed``; NULL is unknown."""
    return df.join(packed.select(key, "is_packed"), key, "left")


def packed_filter(df: DataFrame, packed: DataFrame, key: str, protocol: str) -> DataFrame:
    """Keep samples by packing state: ``yes``, ``no``, ``unk`` or ``any``."""
    if protocol not in PROTOCOLS:
        raise ValueError(f"unknown protocol: {protocol}")
    state = packing_state(df, packed, key)
    rule = {
        "any": F.lit(True),
        "yes": F.coalesce(F.col("is_packed"), F.lit(False)),
        "no": ~F.coalesce(F.col("is_packed"), F.lit(True)),
        "unk": F.col("is_packed").isNull(),
    }[protocol]
    return state.where(rule).drop("is_packed")


def packing_counts(df: DataFrame, packed: DataFrame, key: str) -> DataFrame:
    flag = F.col("is_packed")
    return packing_state(df, packed, key).agg(
        F.count_if(flag).alias("n_packed"),
        F.count_if(~flag).alias("n_not_packed"),
        F.count_if(flag.isNull()).alias("n_unknown"),
    )


def _time_bounds(dataset: str, ranges: DataFrame, early: int | None, late: int | None) -> DataFrame:
    lo, hi = F.col("valid_lo"), F.col("valid_hi")
    return ranges.select(
        dataset,
        (lo if early is None else F.greatest(lo, F.lit(early))).alias("_lo"),
        (hi if late is None else F.least(hi, F.lit(late))).alias("_hi"),
    )


def time_window(
    df: DataFrame, ts: str, dataset: str, ranges: DataFrame, early: int | None = None, late: int | None = None
) -> DataFrame:
    """Drop samples without time or outside the valid range of their dataset.

    ``ranges`` has one row ``(dataset, valid_lo, valid_hi)`` per dataset.
    """
    joined = df.where(F.col(ts).isNotNull()).join(_time_bounds(dataset, ranges, early, late), dataset)
    return joined.where(F.col(ts).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def time_waterfall(
    df: DataFrame, ts: str, dataset: str, ranges: DataFrame, early: int | None = None, late: int | None = None
) -> DataFrame:
    """Per dataset: all samples, samples without time, too early, too late, kept."""
    t = F.col(ts)
    return (
        df.join(_time_bounds(dataset, ranges, early, late), dataset)
        .groupBy(dataset)
        .agg(
            F.count(F.lit(1)).alias("n_total"),
            F.count_if(t.isNull()).alias("n_missing"),
            F.count_if(t < F.col("_lo")).alias("n_early"),
            F.count_if(t > F.col("_hi")).alias("n_late"),
            F.count_if(t.between(F.col("_lo"), F.col("_hi"))).alias("n_kept"),
        )
    )


def exclusion_reasons(
    df: DataFrame,
    id_col: str,
    digest: str,
    empty: DataFrame,
    valid: DataFrame,
    finetune: DataFrame,
    finetune_digests: DataFrame,
    dedup: bool = True,
) -> DataFrame:
    """Add ``reason``, the first rule that excludes a sample, or NULL.

    Rules in order: empty, not valid, used for fine-tuning, digest used for fine-tuning,
    later copy of a kept sample. The id lists are one table of flags, joined once.
    """
    lists = [ids.select(id_col).withColumn("_flag", F.lit(1 << i)) for i, ids in enumerate((empty, valid, finetune))]
    flags = lists[0].unionByName(lists[1]).unionByName(lists[2]).groupBy(id_col).agg(F.bit_or("_flag").alias("_flags"))
    used = finetune_digests.select(digest).distinct().withColumn("_same", F.lit(True))
    flag = F.coalesce("_flags", F.lit(0))
    reason = (
        F.when(flag.bitwiseAND(1) > 0, "empty")
        .when(flag.bitwiseAND(2) == 0, "invalid")
        .when(flag.bitwiseAND(4) > 0, "finetune")
        .when(F.col("_same"), "finetune_digest")
    )
    listed = df.join(flags, id_col, "left").join(used, digest, "left").withColumn("reason", reason)
    listed = listed.select(*df.columns, "reason")
    if not dedup:
        return listed
    # The first sample that no rule excludes keeps its digest; an aggregate combines copies before the shuffle. The rows
    # are read twice for it, what they were made from only once.
    listed = cut(listed, "listed")
    first = (
        listed.where("reason is null").groupBy(digest).agg(F.min(id_col).alias(id_col)).select(id_col)
        .withColumn("_first", F.lit(True))
    )
    return (
        listed.join(first, id_col, "left")
        .withColumn(
            "reason",
            F.when(F.col("reason").isNull() & F.col("_first").isNull(), "duplicate").otherwise(F.col("reason")),
        )
        .drop("_first")
    )


def allow_classes(df: DataFrame, label: str, include: Sequence[str]) -> DataFrame:
    return df.where(F.col(label).isin(*include))


def allow_label_sets(df: DataFrame, labels: str, include: Sequence[str]) -> DataFrame:
    """Keep samples whose labels are all allowed."""
    allowed = F.array(*[F.lit(x) for x in include])
    return df.where(F.forall(labels, lambda x: F.array_contains(allowed, x)))


def head_by_id(df: DataFrame, id_col: str, n: int) -> DataFrame:
    return df.orderBy(id_col).limit(n)


def shard(df: DataFrame, id_col: str, shards: int, index: int, seed: int = SEED) -> DataFrame:
    return df.where(shard_of(id_col, shards, seed) == index)


def with_prefix(df: DataFrame, id_col: str, length: int, prefix: str) -> DataFrame:
    return df.where(id_prefix(id_col, length) == prefix)


def attach_archive(df: DataFrame, id_col: str, archives: DataFrame, length: int, check: bool = False) -> DataFrame:
    """Find the archive whose stem is the id prefix; with ``check`` a sample without one is an error of the job."""
    keyed = df.withColumn("_prefix", id_prefix(id_col, length))
    stems = archives.select("archive", F.regexp_replace(F.substring_index("archive", "/", -1), r"\.[^.]*$", "").alias("_prefix"))
    if not check:
        return keyed.join(stems, "_prefix").drop("_prefix")
    joined = keyed.join(stems, "_prefix", "left").drop("_prefix")
    return demanded(joined, id_col, "archive", "an id prefix has no archive", keep=True)


def demanded(joined: DataFrame, key: str, found: str, message: str, keep: bool = False) -> DataFrame:
    """Result of a left join in which every row must have a partner: a row without ``found`` ends the job."""
    sure = F.when(F.col(found).isNull(), F.raise_error(F.lit(message))).otherwise(F.col(key))
    return joined.withColumn(key, sure) if keep else joined.withColumn(key, sure).drop(found)


def sample_meta(content: Column | str, limit: int) -> list[Column]:
    """Truncated bytes, full size, truncated length."""
    c = as_column(content)
    size = F.octet_length(c).cast("bigint")
    return [
        F.substring(c.cast("binary"), 1, limit).alias("bytes"),
        size.alias("size"),
        F.least(size, F.lit(limit).cast("bigint")).alias("length"),
    ]


def with_view_prefix(df: DataFrame, view: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(f"{view}_{c}") for c in df.columns])


def tuning_table(df: DataFrame, objective: str, descending: bool = True) -> DataFrame:
    """Objective and ``config/`` columns without the prefix, best run first."""
    columns = [c for c in df.columns if c.startswith("config/")]
    out = df.select(
        F.col(f"`{objective}`").alias(objective), *[F.col(f"`{c}`").alias(c.removeprefix("config/")) for c in columns]
    )
    key = F.col(f"`{objective}`")
    return out.orderBy(key.desc() if descending else key.asc())


def first_of(df: DataFrame, group: str, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows per group; Spark cuts each partition to ``n`` per group before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
