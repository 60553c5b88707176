"""Complete corpora: detection and family sample sets as one chain of operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplemill.operators.balance import cap_label_imbalance, spatial_bias
from samplemill.operators.dedup import dedup_across_sides, keep_earliest, keep_majority
from samplemill.operators.encoding import label_ids, with_label_ids
from samplemill.operators.filters import (
    allow_classes,
    cap_imbalance,
    drop_ids,
    keep_frequent,
    keep_frequent_labels,
    packed_filter,
    size_range,
    time_window,
)
from samplemill.operators.splits import guaranteed_label_split, guaranteed_split, temporal_checks, temporal_split
from samplemill.plans.session import cut


def detection_corpus(
    samples: DataFrame,
    ranges: DataFrame,
    empty: DataFrame | None = None,
    packed: DataFrame | None = None,
    packing: str = "any",
    sizes_from_to: tuple[int | None, int | None] = (None, None),
    top_k: int | None = None,
    min_freq: int = 0,
    cap: float | None = None,
    sizes=(0.8, 0.2, 0.0),
    ratio_before: float | None = None,
    ratio_after: float | None = None,
    minority: int = 1,
    ids: bool = False,
) -> DataFrame:
    """Time-filtered, de-duplicated, leak-free samples with an absolute temporal split.

    ``samples`` has ``doc_id, lang, digest, ds_ord, polarity, ts, n_chars``: metadata only, content is
    joined at the end by whoever needs it. Samples outside the time range of their data set, empty ones, those
    of another packing state and those outside the size range go first; then copies, rare classes, and what a class
    has over ``cap`` times the smallest. After the single digest shuffle the table is written once, because
    balancing and splitting read it several times. With ``ids`` the classes get dense ids. A training sample that
    is not older than every validation sample ends the job.
    """
    kept = time_window(samples, "ts", "ds_ord", ranges)
    if empty is not None:
        kept = drop_ids(kept, empty, "doc_id")
    if packed is not None:
        kept = packed_filter(kept, packed, "doc_id", packing)
    kept = size_range(kept, "n_chars", *sizes_from_to)
    unique = cut(dedup_across_sides(kept, "digest", "polarity", ["ds_ord", "ts", "doc_id"]), "unique")
    if ratio_before is not None:
        unique = spatial_bias(unique, "doc_id", "polarity", minority, ratio_before)
    if top_k is not None or min_freq:
        unique = keep_frequent(unique, "lang", top_k, min_freq)
    if cap is not None:
        unique = cut(cap_imbalance(unique, "lang", "ts", "doc_id", cap), "capped")
    split = temporal_split(unique, "ts", sizes)
    if ratio_after is not None:
        parts = [
            spatial_bias(split.where(F.col("split") == s), "doc_id", "polarity", minority, ratio_after)
            for s, size in zip(("tr", "vl", "ts"), sizes)
            if size
        ]
        split = reduce(DataFrame.unionByName, parts)
    bad = temporal_checks(split, "ts").where("NOT ok")
    if not bad.isEmpty():
        raise ValueError("the split is not temporal")
    return with_label_ids(split, "lang", label_ids(split, "lang")) if ids else split


def multi_label_corpus(
    files: DataFrame, top_k: int | None, min_freq: int, cap: float | None = None, sizes=(0.6, 0.2, 0.2), per_label: int = 1
) -> DataFrame:
    """One file per digest with its frequent labels, in a split that covers every label.

    ``files`` has ``doc_id, digest, labels``. The file with the smallest id stands for its copies; rare labels, and
    files without any other, go; ``cap`` bounds every label by the rarest before the split.
    """
    unique = keep_earliest(files, "digest", ["doc_id"])
    kept = cut(keep_frequent_labels(unique, "doc_id", "labels", top_k, min_freq), "labelled")
    if cap is not None:
        kept = cut(cap_label_imbalance(kept, "doc_id", "labels", cap), "capped")
    return guaranteed_label_split(kept, "doc_id", "labels", list(sizes), per_label)


def family_corpus(
    files: DataFrame, labels: DataFrame, include: list[str] | None, sizes=(0.8, 0.1, 0.1), per_class: int = 1
) -> DataFrame:
    """Labelled files, one per digest with its majority label, in a split that covers every class.

    ``files`` has ``doc_id, digest``; ``labels`` has ``doc_id, label``.
    """
    labelled = files.join(labels, "doc_id")
    if include is not None:
        labelled = allow_classes(labelled, "label", include)
    unique = cut(keep_majority(labelled, "digest", "label", "doc_id"), "unique")
    return guaranteed_split(unique, "doc_id", "label", list(sizes), per_class)
