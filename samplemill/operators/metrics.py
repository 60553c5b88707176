"""Classification, ranking and language-model metrics as aggregates over a prediction table.

Count metrics come from the confusion table, which has one row per pair of classes however
many predictions there are. Rank metrics come from counts per distinct score with running
totals, so tied scores are handled exactly and no task sees more than one score bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplemill.functions.scores import argmax, coverage, ranking_loss, ranking_precision, sigmoid, softmax
from samplemill.plans.ordered import running_totals
from samplemill.plans.staged import side_by_side

IGNORED = -100


def predictions(df: DataFrame, logits: str = "logits") -> DataFrame:
    """Add ``probs`` (softmax) and ``pred`` (first maximum)."""
    return df.withColumn("probs", softmax(logits)).withColumn("pred", argmax("probs"))


def confusion(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, label, pred).agg(F.count(F.lit(1)).alias("n"))


def confusion_table(df: DataFrame, classes: Sequence, label: str = "label", pred: str = "pred") -> DataFrame:
    """Confusion counts with one column per predicted class."""
    wide = df.groupBy(label).pivot(pred, list(classes)).agg(F.count(F.lit(1)))
    return wide.select(label, *[F.coalesce(F.col(str(c)), F.lit(0)).alias(f"pred_{c}") for c in classes])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def class_scores(counts: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Per class, over the union of true and predicted classes: support, predicted, hits and scores."""
    n = F.col("n")
    hit = F.when(F.col(label) == F.col(pred), n).otherwise(F.lit(0))
    sides = F.explode(
        F.array(
            F.struct(F.col(label).alias("cls"), n.alias("t"), F.lit(0).cast("bigint").alias("p"), hit.alias("tp")),
            F.struct(F.col(pred).alias("cls"), F.lit(0).cast("bigint").alias("t"), n.alias("p"), F.lit(0).cast("bigint").alias("tp")),
        )
    )
    table = counts.select(sides.alias("_s")).groupBy("_s.cls").agg(
        F.sum("_s.t").alias("t"), F.sum("_s.p").alias("p"), F.sum("_s.tp").alias("tp")
    )
    return with_scores(table)


def with_scores(table: DataFrame) -> DataFrame:
    t, p, tp = F.col("t"), F.col("p"), F.col("tp")
    return (
        table.withColumn("precision", _ratio(tp, p))
        .withColumn("recall", _ratio(tp, t))
        .withColumn("f1", _ratio(F.lit(2.0) * tp, t + p))
        .withColumn("jaccard", _ratio(tp, t + p - tp))
    )


def _geometric(recall: Column) -> Column:
    return F.when(F.min(recall) > 0, F.exp(F.avg(F.ln(recall)))).otherwise(F.lit(0.0))


def single_label_report(df: DataFrame, label: str = "label", pred: str = "pred", positive=None) -> DataFrame:
    """acc, bac, mcc, ham, pre, rec, f_1, jac, gme. With ``positive`` pre, rec and f_1 are those of that class."""
    table = class_scores(confusion(df, label, pred), label, pred)
    t, p, tp = (F.col(c).cast("double") for c in ("t", "p", "tp"))

    def of(score: str) -> Column:
        if positive is None:
            return F.avg(score)
        return F.max(F.when(F.col("cls") == F.lit(positive), F.col(score)))

    s, c = F.sum(t), F.sum(tp)
    below = F.sqrt((s * s - F.sum(p * p)) * (s * s - F.sum(t * t)))
    return table.agg(
        (c / s).alias("acc"),
        F.avg(F.when(F.col("t") > 0, F.col("recall"))).alias("bac"),
        F.when(below != 0, (c * s - F.sum(p * t)) / below).otherwise(F.lit(0.0)).alias("mcc"),
        (F.lit(1.0) - c / s).alias("ham"),
        of("precision").alias("pre"),
        of("recall").alias("rec"),
        of("f1").alias("f_1"),
        F.avg("jaccard").alias("jac"),
        _geometric(F.col("recall")).alias("gme"),
    )


def ranking_scores(df: DataFrame, score: str, truth: Column, by: Sequence[str] = ()) -> DataFrame:
    """``roc`` (rank-sum area, NaN with one class only) and ``avp`` (step-wise average precision)."""
    counts = df.groupBy(*by, score).agg(F.count_if(truth).alias("_pos"), F.count_if(~truth).alias("_neg"))
    return ranking_of_counts(counts, score, by)


def ranking_of_counts(counts: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """The same from ``_pos`` and ``_neg``, the rows of each class per distinct score."""
    placed = running_totals(
        counts, score, {"_pos": "_pos_lt", "_neg": "_neg_lt"}, by, totals={"_pos": "_p", "_neg": "_n"}
    )
    pos, neg = F.col("_pos"), F.col("_neg")
    # Products of counts leave the range of long integers long before the counts do.
    wins = F.sum(pos.cast("double") * (F.col("_neg_lt") + neg / 2))
    p, n = F.max("_p").cast("double"), F.max("_n").cast("double")
    hits = F.col("_p") - F.col("_pos_lt")
    shown = hits + F.col("_n") - F.col("_neg_lt")
    return placed.groupBy(*by).agg(
        F.when((p > 0) & (n > 0), wins / (p * n)).otherwise(F.lit(float("nan"))).alias("roc"),
        F.sum(F.when(F.col("_p") > 0, pos / F.col("_p") * (hits / shown)).otherwise(F.lit(0.0))).alias("avp"),
    )


def one_vs_rest(df: DataFrame, label: str = "label", probs: str = "probs") -> DataFrame:
    """``roc`` and ``avp`` of every class against the others."""
    flat = df.select(label, F.posexplode_outer(probs).alias("cls", "score")).where("cls is not null")
    return ranking_scores(flat, "score", F.col(label) == F.col("cls"), ["cls"])


def macro_auc(df: DataFrame, label: str = "label", probs: str = "probs") -> DataFrame:
    return one_vs_rest(df, label, probs).agg(F.avg("roc").alias("roc"))


def multi_label(df: DataFrame, truth: str, logits: str, threshold: float = 0.5) -> DataFrame:
    """Add ``probs`` (sigmoid) and ``pred`` (0/1 per class)."""
    return df.withColumn("probs", sigmoid(logits)).withColumn(
        "pred", F.transform("probs", lambda x: (x > threshold).cast("int"))
    )


def multi_label_classes(df: DataFrame, truth: str, pred: str = "pred") -> DataFrame:
    both = F.arrays_zip(F.col(truth).alias("t"), F.col(pred).alias("p"))
    flat = df.select(F.posexplode_outer(both).alias("cls", "_z")).where("cls is not null")
    table = flat.groupBy("cls").agg(
        F.sum("_z.t").cast("bigint").alias("t"),
        F.sum("_z.p").cast("bigint").alias("p"),
        F.count_if((F.col("_z.t") == 1) & (F.col("_z.p") == 1)).alias("tp"),
    )
    return with_scores(table)


def multi_label_report(df: DataFrame, truth: str, logits: str, threshold: float = 0.5) -> DataFrame:
    """acc, ham, pre, rec, f_1, avp, roc, gme, coe, lra, lrl and jac for multi-hot labels."""
    scored = multi_label(df, truth, logits, threshold)
    wrong = F.aggregate(
        F.zip_with(truth, "pred", lambda a, b: (a != b).cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )
    rows = scored.agg(
        F.avg((F.col(truth).cast("array<int>") == F.col("pred")).cast("double")).alias("acc"),
        (F.sum(wrong) / F.sum(F.size("pred"))).alias("ham"),
        F.avg(coverage(truth, "probs")).alias("coe"),
        F.avg(ranking_precision(truth, "probs")).alias("lra"),
        F.avg(ranking_loss(truth, "probs")).alias("lrl"),
    )
    classes = multi_label_classes(scored, truth).agg(
        F.avg("precision").alias("pre"),
        F.avg("recall").alias("rec"),
        F.avg("f1").alias("f_1"),
        F.avg("jaccard").alias("jac"),
        _geometric(F.col("recall")).alias("gme"),
    )
    both = F.arrays_zip(F.col(truth).alias("t"), F.col("probs").alias("s"))
    flat = scored.select(F.posexplode_outer(both).alias("cls", "_z")).where("cls is not null").select("cls", F.col("_z.t").alias("t"), F.col("_z.s").alias("score"))
    ranks = ranking_scores(flat, "score", F.col("t") == 1, ["cls"]).agg(F.avg("roc").alias("roc"), F.avg("avp").alias("avp"))
    return side_by_side(rows, classes, ranks)


def perplexity(df: DataFrame, log_prob: str, label: str) -> DataFrame:
    """``exp(-mean log probability)`` over positions that are not ignored."""
    return df.where(F.col(label) != IGNORED).agg(F.exp(-F.avg(log_prob)).alias("ppl"))


def language_model_report(df: DataFrame, loss: str, label: str, unigrams: DataFrame, specials: Sequence[int] = (IGNORED,)) -> DataFrame:
    """Mean loss, perplexity, and perplexity scaled by the mean log unigram probability of the labels.

    The loss is averaged over all positions, the scale over labels that are no specials. The
    unigram table has one row per vocabulary entry; labels are counted before they meet it.
    """
    losses = df.agg(F.avg(loss).alias("ext_loss"))
    counts = df.where(~F.col(label).isin(*specials)).groupBy(F.col(label).alias("token_id")).agg(F.count(F.lit(1)).alias("_c"))
    log_p = F.ln(F.greatest(F.coalesce(F.col("p"), F.lit(0.0)), F.lit(1e-10)))
    scale = counts.join(unigrams.select("token_id", "p"), "token_id", "left").agg(
        (F.sum(F.col("_c") * log_p) / F.sum("_c")).alias("_scale")
    )
    return side_by_side(losses, scale).select(
        "ext_loss",
        F.exp("ext_loss").alias("ppl"),
        (F.exp("ext_loss") * F.exp("_scale")).alias("nppl"),
    )


def detection_metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    """Accuracy at 0.5 and area under the curve for a binary task."""
    truth = F.col(label) == 1
    acc = df.agg(F.avg((truth == (F.col(score) > 0.5)).cast("double")).alias("acc"))
    return side_by_side(acc, ranking_scores(df, score, truth).select("roc"))


def family_metrics(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return single_label_report(df, label, pred).select("mcc", "bac")


def behaviour_metrics(df: DataFrame, truth: str, logits: str) -> DataFrame:
    return multi_label_report(df, truth, logits).select("jac", "ham")
