"""Distributions, summaries and log roll-ups."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samplemill.operators.splits import SPLITS
from samplemill.plans.ordered import exact_quantiles, join_null_safe
from samplemill.plans.session import cut
from samplemill.plans.staged import exploded, side_by_side


def class_distribution(df: DataFrame, label: str, split: str | None = None) -> DataFrame:
    """Samples per class (and split). An array label counts once per element."""
    if dict(df.dtypes)[label].startswith("array"):
        keep = [split] if split else []
        df = df.select(*keep, F.explode(label).alias(label))
    return df.groupBy(label, *([split] if split else [])).agg(F.count(F.lit(1)).alias("n"))


def distribution_table(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """One row per class with a count per split and the total."""
    wide = class_distribution(df, label, split).groupBy(label).pivot(split, list(SPLITS)).agg(F.sum("n"))
    counts = [F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(f"n_{s}") for s in SPLITS]
    wide = wide.select(label, *counts)
    return wide.withColumn("n_all", sum((F.col(f"n_{s}") for s in SPLITS[1:]), F.col(f"n_{SPLITS[0]}")))


def imbalance(df: DataFrame, label: str, split: str | None = None) -> DataFrame:
    """Largest class count over smallest, overall or per split."""
    counts = class_distribution(df, label, split)
    return counts.groupBy(*([split] if split else [])).agg(
        F.max("n").alias("n_max"),
        F.min("n").alias("n_min"),
        F.round(F.max("n") / F.min("n"), 6).alias("imbalance"),
    )


def imbalances(df: DataFrame, label: str, split: str, overall: str = "all") -> DataFrame:
    """``imbalance`` per split and over all of them (the row ``overall``), from one count of the samples."""
    counts = class_distribution(df, label, split)
    scopes = F.explode(F.array(F.col(split), F.lit(overall))).alias("_scope")
    per_scope = counts.select(label, scopes, "n").groupBy("_scope", label).agg(F.sum("n").alias("n"))
    return per_scope.groupBy(F.col("_scope").alias(split)).agg(
        F.max("n").alias("n_max"),
        F.min("n").alias("n_min"),
        F.round(F.max("n") / F.min("n"), 6).alias("imbalance"),
    )


def split_summary(df: DataFrame, positive: Column, split: str = "split") -> DataFrame:
    """Counts per split, share of the total and share of the positive class, in percent (half-even; NaN of nothing)."""
    aggs = [F.count(F.lit(1)).alias("n_to"), F.count_if(positive).alias("p_to")]
    for s in SPLITS:
        here = F.col(split) == s
        aggs += [F.count_if(here).alias(f"n_{s}"), F.count_if(here & positive).alias(f"p_{s}")]
    out = df.agg(*aggs)

    def percent(x: Column, n: Column) -> Column:
        return F.when(n > 0, F.bround(F.lit(100.0) * x / n, 0)).otherwise(F.lit(float("nan")))

    return out.select(
        "n_to",
        *[f"n_{s}" for s in SPLITS],
        *[percent(F.col(f"n_{s}"), F.col("n_to")).alias(f"pct_{s}") for s in SPLITS],
        *[percent(F.col(f"p_{s}"), F.col(f"n_{s}")).alias(f"pos_{s}") for s in ("to", *SPLITS)],
    )


def size_summary(df: DataFrame, size: str, divisor: float = 1.0, by: Sequence[str] = (), overall: str | None = None) -> DataFrame:
    """n, exact median, mean, population deviation, min, max and sum, divided by ``divisor``.

    ``overall`` names one more row, over all groups of a text column. The samples are read once: their sizes are
    counted and written, and all numbers come from the counts.
    """
    counts = cut(df.where(F.col(size).isNotNull()).groupBy(*by, size).agg(F.count(F.lit(1)).alias("_w")), "sizes")
    if overall is not None:
        (group,) = by
        scopes = F.explode(F.array(F.col(group), F.lit(overall))).alias(group)
        counts = counts.select(scopes, size, "_w").groupBy(group, size).agg(F.sum("_w").alias("_w"))
    x, w = F.col(size).cast("double"), F.col("_w")
    plain = counts.groupBy(*by).agg(
        F.sum("_w").alias("n"),
        F.sum(x * w).alias("_s"),
        F.sum(x * x * w).alias("_q"),
        (F.min(size) / divisor).alias("min"),
        (F.max(size) / divisor).alias("max"),
        (F.sum(F.col(size) * w) / divisor).alias("sum"),
    )
    mean = F.col("_s") / F.col("n")
    plain = plain.withColumn("mean", mean / divisor).withColumn("std", F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("n") - mean * mean)) / divisor)
    plain = plain.select(*by, "n", "mean", "std", "min", "max", "sum")
    median = exact_quantiles(counts, size, {"median": 0.5}, by, "_w").withColumn("median", F.col("median") / divisor)
    if by:
        return join_null_safe(plain, median, by)
    return side_by_side(plain, median)


def length_counts(df: DataFrame, label: str, size: str) -> DataFrame:
    """All lengths per class as run lengths ``(label, size, n)``."""
    return df.groupBy(label, size).agg(F.count(F.lit(1)).alias("n"))


def counts_below(df: DataFrame, label: str, size: str, thresholds: Sequence[int]) -> DataFrame:
    """Samples per class with at most each threshold, in one pass."""
    wide = df.groupBy(label).agg(*[F.count_if(F.col(size) <= t).alias(f"_{t}") for t in thresholds])
    pairs = F.array(
        *[F.struct(F.lit(t).cast("bigint").alias("threshold"), F.col(f"_{t}").alias("n")) for t in thresholds]
    )
    return wide.select(label, F.explode(pairs).alias("_p")).select(label, "_p.threshold", "_p.n")


def unigram_probabilities(
    df: DataFrame, ids: str, vocabulary: DataFrame, specials: Sequence[int], id_col: str = "id", first: int | None = None
) -> DataFrame:
    """Probability of every vocabulary id; specials are left out, unseen ids get 0.

    ``first`` limits the count to the first samples by id: only ids are sorted, and the last of them
    is what their token arrays are compared with. The total is taken over the vocabulary-sized count table.
    """
    source = df
    if first is not None:
        last = df.select(id_col).orderBy(id_col).limit(first).agg(F.max(id_col)).first()[0]
        source = df.where(F.col(id_col) <= F.lit(last))
    tokens = exploded(source, ids, "token_id")
    counts = tokens.groupBy("token_id").agg(F.count(F.lit(1)).alias("n"))
    table = vocabulary.where(~F.col("token_id").isin(*specials)).join(counts, "token_id", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    return table.withColumn("n", n).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))


def length_quantiles(df: DataFrame, ids: str, shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    return exact_quantiles(df.select(*by, F.size(ids).cast("bigint").alias("_len")), "_len", shares, by)


def length_sketch(df: DataFrame, ids: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Approximate sequence-length quantiles from a mergeable sketch, for corpora counted repeatedly."""
    sketch = F.kll_sketch_agg_bigint(F.size(ids).cast("bigint"))
    return df.groupBy(*by).agg(sketch.alias("sketch")).select(
        *by, F.kll_sketch_get_quantile_bigint("sketch", F.array(*[F.lit(float(s)) for s in shares])).alias("quantiles")
    )


def token_length_histogram(vocabulary: DataFrame, token: str, special: Column) -> DataFrame:
    return vocabulary.where(~special).groupBy(F.length(token).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def confidence_interval(df: DataFrame, value: str, level: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """Mean and half width ``z * sigma / sqrt(n)`` with the population deviation."""
    z = NormalDist().inv_cdf((1 + level) / 2)
    return df.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        (F.lit(z) * F.stddev_pop(value) / F.sqrt(F.count(value))).alias("half_width"),
    )


def best_epochs(df: DataFrame, run: str, epoch: str, lower: Sequence[str] = (), higher: Sequence[str] = ()) -> DataFrame:
    """Per run and metric the best value and the first epoch that reaches it."""
    aggs = []
    for m in lower:
        aggs.append(F.min(F.struct(F.col(m).alias("v"), F.col(epoch).alias("e"))).alias(m))
    for m in higher:
        aggs.append(F.min(F.struct((-F.col(m)).alias("v"), F.col(epoch).alias("e"))).alias(m))
    wide = df.groupBy(run).agg(*aggs)
    rows = [
        F.struct(
            F.lit(m).alias("metric"),
            (F.col(f"{m}.v") if m in lower else -F.col(f"{m}.v")).cast("double").alias("best"),
            F.col(f"{m}.e").alias("epoch"),
        )
        for m in (*lower, *higher)
    ]
    return wide.select(run, F.explode(F.array(*rows)).alias("_r")).select(run, "_r.*")


def collapse_log(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """One row per key; each column takes its last value that is not NULL."""
    return df.groupBy(*keys).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    )


def sweep_outcome(runs: DataFrame, order: str, seconds: str, ok: Column) -> DataFrame:
    """Runs, successes and mean run time without the first run (which pays for warm-up)."""
    first = runs.agg(F.min(order)).first()[0]
    later = F.when(F.col(order) > F.lit(first), F.col(seconds))
    return runs.agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(ok).alias("n_ok"), F.avg(later).alias("mean_seconds")
    )


def log_outcomes(lines: DataFrame, text: str, phrases: dict[str, str], id_pattern: str) -> DataFrame:
    """Count log lines by the first phrase they contain, and the distinct ids they name."""
    outcome = F.lit("other")
    for name, phrase in reversed(list(phrases.items())):
        outcome = F.when(F.col(text).contains(phrase), name).otherwise(outcome)
    tagged = lines.select(outcome.alias("outcome"), F.regexp_extract(text, id_pattern, 1).alias("_id"))
    per_id = tagged.groupBy("outcome", "_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_id.groupBy("outcome").agg(
        F.sum("_n").cast("bigint").alias("n"), F.count_if(F.col("_id") != "").alias("n_ids")
    )


def label_popularity(df: DataFrame, platform: str, votes: dict[str, str]) -> DataFrame:
    """Reports per platform, extractor and label. ``votes`` maps an extractor to its vote array column."""
    def tagged(name: str, column: str) -> Column:
        votes = F.coalesce(F.col(column), F.array().cast("array<struct<value:string,count:bigint>>"))
        return F.transform(votes, lambda v: F.struct(F.lit(name).alias("extractor"), v["value"].alias("label")))

    listed = F.concat(*[tagged(name, column) for name, column in votes.items()])
    return (
        df.select(platform, F.explode(listed).alias("_l"))
        .groupBy(platform, "_l.extractor", "_l.label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def weighted_mean(df: DataFrame, value: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """Weighted mean over finite values; NaN if there is none."""
    v = F.col(value).cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    w = F.when(~bad, F.col(weight))
    return df.groupBy(*by).agg(
        F.coalesce(F.sum(w * F.when(~bad, v)) / F.sum(w), F.lit(float("nan"))).alias("mean")
    )


def paired_delta(base: DataFrame, tuned: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Tuned minus base per key."""
    left = tuned.select(*keys, F.col(value).alias("_t"))
    return left.join(base.select(*keys, F.col(value).alias("_b")), list(keys)).select(
        *keys, (F.col("_t") - F.col("_b")).alias("delta")
    )


def byte_distribution(histograms: DataFrame, histogram: str) -> DataFrame:
    """Corpus-wide count per byte value from per-sample histograms."""
    return (
        histograms.select(F.posexplode_outer(histogram).alias("byte", "_n"))
        .where("byte is not null")
        .groupBy("byte")
        .agg(F.sum("_n").alias("n"))
    )
