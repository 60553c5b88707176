"""Label votes of scanners: parsing vote lines and choosing labels, all inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from samplemill.functions.ids import as_column

# The label namespaces and, per namespace, (labels to keep, votes needed).
NAMESPACES = ("class", "file", "fam", "beh", "unk", "pack", "vuln")
VOTE_RULES = {
    "class": (1, 5),
    "file": (1, 5),
    "fam": (1, 2),
    "beh": (1, 5),
    "unk": (1, 2),
    "pack": (1, 1),
    "vuln": (1, 1),
}

# One vote: namespace up to the first colon, value up to the first bar, then the count.
VOTE = r"^([^:]+):([^|]*)[|](\d+)$"


def line_id(line: Column | str) -> Column:
    return F.element_at(F.split(F.trim(as_column(line)), r"\s+"), 1)


def line_flagged(line: Column | str) -> Column:
    """Number of tools that flagged the sample; text that is no number counts as 0."""
    word = F.get(F.split(F.trim(as_column(line)), r"\s+"), F.lit(1))
    return F.when(word.rlike(r"^\d+$"), word.cast("int")).otherwise(F.lit(0))


def parse_votes(line: Column | str) -> Column:
    """Votes of a line as ``array<struct<ns, value, count>>``; NULL if it carries none."""
    words = F.split(F.trim(as_column(line)), r"\s+")
    info = F.when(F.size(words) == 3, F.get(words, F.lit(2))).otherwise(F.lit(""))
    empty = info.isin("", "[]") | info.contains("SINGLETON")
    votes = F.transform(
        F.split(info, ","),
        lambda v: F.struct(
            F.lower(F.regexp_extract(v, VOTE, 1)).alias("ns"),
            F.regexp_extract(v, VOTE, 2).alias("value"),
            F.regexp_extract(v, VOTE, 3).cast("bigint").alias("count"),
        ),
    )
    return F.when(~empty, votes)


def split_composites(votes: Column | str) -> Column:
    """Class votes such as ``a:b`` become one vote per part, placed after the plain ones."""
    v = as_column(votes)

    def composite(x: Column) -> Column:
        return (x["ns"] == "class") & x["value"].contains(":")

    parts = F.flatten(
        F.transform(
            F.filter(v, composite),
            lambda x: F.transform(
                F.split(x["value"], ":"),
                lambda p: F.struct(x["ns"].alias("ns"), p.alias("value"), x["count"].alias("count")),
            ),
        )
    )
    return F.concat(F.filter(v, lambda x: ~composite(x)), parts)


def merge_votes(votes: Column | str) -> Column:
    """Add the counts of equal (namespace, value) pairs, in order of first appearance."""
    v = as_column(votes)
    keys = F.array_distinct(F.transform(v, lambda x: F.struct(x["ns"].alias("ns"), x["value"].alias("value"))))
    return F.transform(
        keys,
        lambda key: F.struct(
            key["ns"].alias("ns"),
            key["value"].alias("value"),
            F.aggregate(
                F.filter(v, lambda x: (x["ns"] == key["ns"]) & (x["value"] == key["value"])),
                F.lit(0).cast("bigint"),
                lambda acc, x: acc + x["count"],
            ).alias("count"),
        ),
    )


def sort_votes(votes: Column | str) -> Column:
    """Votes by count, highest first; equal counts keep their order."""
    ranked = F.array_sort(
        F.transform(as_column(votes), lambda x, i: F.struct((-x["count"]).alias("c"), i.alias("i"), x.alias("x")))
    )
    return F.transform(ranked, lambda r: r["x"])


def top_labels(votes: Column | str, k: int | None = None) -> Column:
    """Values of the first ``k`` votes."""
    v = as_column(votes)
    kept = v if k is None else F.slice(v, 1, k)
    return F.transform(kept, lambda x: x["value"])


def vote_labels(votes: Column | str, k: int | None = None) -> Column:
    """Values with at least ``k`` votes."""
    v = as_column(votes)
    kept = v if k is None else F.filter(v, lambda x: x["count"] >= k)
    return F.transform(kept, lambda x: x["value"])


def choose_labels(ranked: Column | str, ns: str, top_k: int | None, vote_k: int | None) -> Column:
    """From votes in rank order: one namespace, at least ``vote_k`` votes, then ``top_k`` values; NULL if none is left."""
    mine = F.filter(as_column(ranked), lambda x: (x["ns"] == ns) & (x["count"] >= (vote_k or 0)))
    labels = top_labels(mine, top_k or None)
    return F.when(F.size(labels) > 0, labels)


def is_labeled(label: Column | str) -> Column:
    c = as_column(label)
    found = F.lit(False)
    for ns in NAMESPACES:
        found = found | F.coalesce(F.size(c[ns]) > 0, F.lit(False))
    return found


def parse_family(line: Column | str) -> Column:
    """Family of a line ``id family``; ``id - []`` and singletons have none. Other shapes raise."""
    words = F.split(F.trim(as_column(line)), r"\s+")
    second = F.get(words, F.lit(1))
    none = (F.size(words) == 3) & (second == "-") & (F.get(words, F.lit(2)) == "[]")
    return (
        F.when((F.size(words) == 2) & ~second.contains("SINGLETON"), second)
        .when((F.size(words) == 2) | none, F.lit(None).cast("string"))
        .otherwise(F.raise_error(F.concat(F.lit("unexpected line: "), as_column(line))))
    )
