"""JSON reports: lenient extraction, threat labels, sighting times, nested detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from samplemill.functions.ids import as_column
from samplemill.functions.votes import sort_votes

THREAT = "$.data.attributes.popular_threat_classification"
SIGHTING_KEYS = ("creation_date", "last_modification_date", "last_submission_date")
MAX_VOTES = 2**63 - 1


def json_body(raw: Column | str) -> Column:
    """Text from the first ``{`` to the last ``}``, or to the end if there is no ``}`` at all."""
    c = as_column(raw)
    open_end = F.when(c.contains("{"), F.substring(c, F.instr(c, "{"), F.length(c)))
    return F.coalesce(F.when(c.contains("}"), F.regexp_extract(c, r"(?s)\{.*\}", 0)).otherwise(open_end), F.lit(""))


def body_state(raw: Column | str) -> Column:
    """``missing``, ``empty``, ``broken`` or ``ok``."""
    c = as_column(raw)
    return (
        F.when(c.isNull(), "missing")
        .when(F.octet_length(c) == 0, "empty")
        .when(F.try_parse_json(json_body(c)).isNull(), "broken")
        .otherwise("ok")
    )


def earliest_sighting(report: Column | str, keys: Sequence[str] = SIGHTING_KEYS) -> Column:
    """Value of the first key that the report has."""
    c = as_column(report)
    return F.coalesce(*[F.get_json_object(c, f"$.data.attributes.{k}").cast("bigint") for k in keys])


def threat_votes(report: Column | str, kind: str) -> Column:
    """Votes of a threat report by ``name``, ``category`` or ``label``; NULL if absent or not JSON."""
    c = as_column(report)
    if kind == "label":
        value = F.get_json_object(c, f"{THREAT}.suggested_threat_label")
        vote = F.struct(value.alias("value"), F.lit(MAX_VOTES).cast("bigint").alias("count"))
        return F.when(value.isNotNull(), F.array(vote))
    if kind not in ("name", "category"):
        raise ValueError(f"unknown kind: {kind}")
    listed = F.get_json_object(c, f"{THREAT}.popular_threat_{kind}")
    votes = F.from_json(listed, "array<struct<value:string,count:bigint>>")
    return F.when(votes.isNotNull(), sort_votes(votes))


def id_mismatch(report: Column | str, stem: Column | str, path: str = "$.data.attributes.sha256") -> Column:
    """True where the id inside a report differs from the file it came from."""
    return ~F.get_json_object(as_column(report), path).eqNullSafe(as_column(stem))


def _values_type(depth: int) -> str:
    deeper = "string" if depth == 1 else f"array<{_values_type(depth - 1)}>"
    return f"struct<type:string,name:string,values:{deeper}>"


#: Levels that are parsed at once.
DEPTH = 8
VALUES_TYPE = f"array<{_values_type(DEPTH)}>"
REPORT_TYPE = f"struct<detects:array<struct<values:{VALUES_TYPE}>>>"
