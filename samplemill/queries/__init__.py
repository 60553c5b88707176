"""The registered queries: every operator applied to the given tables, with its SQL counterpart."""

from samplemill.queries import (  # noqa: F401
    aggregates,
    features,
    filters,
    labels,
    metrics,
    sources,
    splits,
    streams,
    tokens,
)
from samplemill.queries.registry import ORACLES, QUERIES  # noqa: F401
