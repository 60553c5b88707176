"""Scanner reports to packing flags: nested detections, consolidation, agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplemill.functions.reports import DEPTH, REPORT_TYPE, VALUES_TYPE, json_body
from samplemill.plans.session import cut

# Scanner modes, detection types that mean obfuscation, and packer names without information.
MODES = ("recursive", "deep", "heuristic")
OBFUSCATION_TYPES = (
    "Packer",
    "Protector",
    "Protection",
    "Crypter",
    "Cryptor",
    "patcher",
    "scrambler",
    "sfx",
    "Archive",
    "Joiner",
)
GENERIC_NAMES = ("Cryptor detected", "Packer detected")


def parsed_reports(reports: DataFrame, keys: Sequence[str], raw: str) -> DataFrame:
    """``(*keys, _ok, _found, _v)``: readable or not, detections found so far, JSON text of deeper ones.

    Written to the shared folder, so that reports are scanned and parsed once however often
    the few detections in them are used.
    """
    body = reports.select(*keys, json_body(raw).alias("_body"))
    parsed = body.select(
        *keys, F.try_parse_json("_body").isNotNull().alias("_ok"), F.from_json("_body", REPORT_TYPE).alias("_r")
    )
    none = F.array().cast(VALUES_TYPE)
    level = parsed.select(
        *keys, "_ok", F.flatten(F.transform("_r.detects", lambda d: F.coalesce(d["values"], none))).alias("_v")
    )
    return cut(_flattened(level, [*keys, "_ok"]), "reports")


def detections(reports: DataFrame, keys: Sequence[str], raw: str) -> DataFrame:
    """One row ``(*keys, type, name)`` per innermost detection of a scanner report.

    A report is parsed to a fixed depth at once. Anything nested deeper comes back as JSON
    text and goes through further rounds until nothing is left, so no depth is lost.
    """
    return _all_levels(parsed_reports(reports, keys, raw), keys)


def _all_levels(flat: DataFrame, keys: Sequence[str]) -> DataFrame:
    out = None
    while True:
        rows = flat.select(*keys, F.explode_outer("_found").alias("_f")).where("_f is not null")
        rows = rows.select(*keys, "_f.type", "_f.name")
        out = rows if out is None else out.unionByName(rows)
        rest = flat.select(*keys, F.explode_outer("_v").alias("_json")).where("_json is not null")
        if rest.isEmpty():
            return out
        level = rest.select(*keys, F.from_json("_json", VALUES_TYPE).alias("_v"))
        flat = cut(_flattened(level, keys), "deeper")


def _flattened(level: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Leaves of the nested values in ``_v`` as ``_found``; ``_v`` becomes the JSON text below the parsed depth."""
    for depth in range(DEPTH, 0, -1):
        inner = F.transform(F.filter("_v", lambda v: v["values"].isNotNull()), lambda v: v["values"])
        plain = F.filter("_v", lambda v: v["values"].isNull())
        found = F.transform(plain, lambda v: F.struct(v["type"].alias("type"), v["name"].alias("name")))
        level = level.withColumn(f"_f{depth}", found).withColumn("_v", F.flatten(inner) if depth > 1 else inner)
    return level.select(*keys, F.concat(*[f"_f{d}" for d in range(DEPTH, 0, -1)]).alias("_found"), "_v")


def consolidate(reports: DataFrame, id_col: str, mode: str, raw: str, types: Sequence[str] = OBFUSCATION_TYPES) -> DataFrame:
    """Per sample and mode: is anything obfuscated, and by which packers.

    A report that is missing or no JSON has NULL flags. The packer set is as small as the
    list of known packers.
    """
    flat = parsed_reports(reports, [id_col, mode], raw)
    found = _all_levels(flat, [id_col, mode]).where(F.col("type").isin(*types))
    name = F.when(F.col("name").isin(*GENERIC_NAMES), "Generic").otherwise(F.coalesce(F.col("name"), F.lit("")))
    marked = found.groupBy(id_col, mode).agg(F.collect_set(F.when(name != "", name)).alias("_packers"))
    joined = flat.select(id_col, mode, "_ok").join(marked, [id_col, mode], "left")
    return joined.select(
        id_col,
        mode,
        F.when(F.col("_ok"), F.col("_packers").isNotNull()).alias("is_obfuscated"),
        F.when(
            F.col("_ok"), F.sort_array(F.coalesce(F.col("_packers"), F.array().cast("array<string>")))
        ).alias("packers"),
    )


def packing_map(flags: DataFrame, id_col: str, mode: str, include: Sequence[str] = MODES, null_is_unknown: bool = True) -> DataFrame:
    """``is_packed`` per sample: any of the included modes says so."""
    packed = F.bool_or("is_obfuscated")
    if not null_is_unknown:
        packed = unknown_as_false(packed)
    return flags.where(F.col(mode).isin(*include)).groupBy(id_col).agg(packed.alias("is_packed"))


def unknown_as_false(flag: Column | str) -> Column:
    return F.coalesce(flag, F.lit(False))


def not_packed(packed: DataFrame, id_col: str) -> DataFrame:
    return packed.where(~F.col("is_packed")).select(id_col).orderBy(id_col)


def mode_agreement(flags: DataFrame, id_col: str, mode: str) -> DataFrame:
    """How many samples which scanner modes call packed, as counts and shares."""
    per_sample = flags.groupBy(id_col).agg(
        *[F.bool_or(F.when(F.col(mode) == m, F.col("is_obfuscated"))).alias(m) for m in MODES]
    )
    rec, deep, heu = (F.coalesce(F.col(m), F.lit(False)) for m in MODES)
    sig = rec | deep
    both = F.col("recursive").isNotNull() & F.col("deep").isNotNull()
    rules = {
        "none": ~(sig | heu),
        "all": rec & deep & heu,
        "any": sig | heu,
        "heuristic_only": ~sig & heu,
        "signature": sig,
        "signature_only": sig & ~heu,
        "agree": both & (rec == deep),
        "disagree": both & (rec != deep),
    }
    counted = per_sample.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(r).alias(k) for k, r in rules.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("outcome"), F.col(k).alias("n")) for k in rules]))
    return counted.select("_n", pairs.alias("_p")).select(
        "_p.outcome", "_p.n", F.round(F.col("_p.n") / F.col("_n"), 6).alias("share")
    )


def packer_counts(flags: DataFrame, id_col: str, mode: str, include: Sequence[str] = MODES) -> DataFrame:
    """Samples per packer; a packer that several modes report counts once per sample."""
    seen = flags.where(F.col(mode).isin(*include)).where("is_obfuscated").select(
        id_col, F.explode("packers").alias("packer")
    )
    return seen.distinct().groupBy("packer").agg(F.count(F.lit(1)).alias("n"))
