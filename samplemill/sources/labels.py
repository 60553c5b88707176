"""Vote lines, family lines and threat reports to label tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplemill.functions.reports import threat_votes
from samplemill.functions.votes import (
    NAMESPACES,
    VOTE_RULES,
    choose_labels,
    is_labeled,
    line_flagged,
    line_id,
    merge_votes,
    parse_family,
    parse_votes,
    sort_votes,
    split_composites,
    top_labels,
    vote_labels,
)

from samplemill.plans.staged import held


def vote_items(lines: DataFrame, text: str = "value") -> DataFrame:
    """``(id, flagged, votes)`` per vote line."""
    items = lines.select(
        line_id(text).alias("id"), line_flagged(text).alias("flagged"), parse_votes(text).alias("votes")
    )
    return held(items, "votes")


def vote_table(items: DataFrame) -> DataFrame:
    """Long form ``(id, ns, value, count)`` with composites split and equal values added."""
    return (
        items.select("id", F.explode(split_composites("votes")).alias("v"))
        .groupBy("id", "v.ns", "v.value")
        .agg(F.sum("v.count").alias("count"))
    )


def resolved_labels(
    items: DataFrame, rules: dict[str, tuple[int | None, int | None]] | None = None, namespaces: Sequence[str] = NAMESPACES
) -> DataFrame:
    """``(id, label)`` with the chosen labels per namespace. Map-only; each step is its own column.

    Namespaces do not touch each other, so that votes of those that are not asked for go first.
    """
    rules = rules or VOTE_RULES
    votes = F.col("votes")
    if set(namespaces) != set(NAMESPACES):
        votes = F.filter(votes, lambda x: x["ns"].isin(*namespaces))
    ranked = (
        items.select("id", split_composites(votes).alias("_v"))
        .withColumn("_m", merge_votes("_v"))
        .withColumn("_r", sort_votes("_m"))
    )
    label = F.struct(*[choose_labels("_r", ns, *rules[ns]).alias(ns) for ns in namespaces])
    return held(ranked.select("id", label.alias("label")), "label")


def combined_labels(votes: DataFrame, classes: DataFrame, families: DataFrame, rules=None) -> DataFrame:
    """Labels of three tools: all namespaces from the first, the class of the second, the family of the third.

    Inputs are vote items, vote items and ``(id, family)``. A sample that the second tool
    knows takes its class from there even if that is NULL.
    """
    first = resolved_labels(votes, rules)
    second = resolved_labels(classes, rules, ["class"]).select("id", F.col("label.class").alias("_class"), F.lit(True).alias("_has"))
    third = families.select("id", F.col("family").alias("_fam"))
    joined = first.join(second, "id", "full").join(third, "id", "full")
    fields = {ns: F.col(f"label.{ns}") for ns in NAMESPACES}
    fields["class"] = F.when(F.col("_has"), F.col("_class")).otherwise(fields["class"])
    fields["fam"] = F.when(F.col("_fam").isNotNull(), F.array("_fam")).otherwise(fields["fam"])
    return joined.select("id", F.struct(*[c.alias(ns) for ns, c in fields.items()]).alias("label"))


def view(labels: DataFrame, ns: str) -> DataFrame:
    """One namespace of the labelled samples that have it."""
    return labels.where(is_labeled("label")).select("id", F.col(f"label.{ns}").alias("labels")).where("labels is not null")


def family_labels(lines: DataFrame, text: str = "value") -> DataFrame:
    return lines.select(line_id(text).alias("id"), parse_family(text).alias("family"))


def report_labels(reports: DataFrame, kind: str = "label", refine: str | None = "top", k: int | None = None) -> DataFrame:
    """``(id, labels)`` from threat reports ``(id, text)``; broken reports give NULL."""
    votes = threat_votes("text", kind)
    if refine in (None, "top"):
        labels = top_labels(votes, k)
    elif refine == "vote":
        labels = vote_labels(votes, k)
    else:
        raise ValueError(f"unknown refinement: {refine}")
    return reports.select("id", labels.alias("labels"))
