"""Building blocks shared by the operators: ranks, running totals, skew, lineage."""
