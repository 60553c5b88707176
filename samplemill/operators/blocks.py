"""Packing token sequences into blocks of equal length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplemill.plans.ordered import join_null_safe, running_totals


def packed_blocks(df: DataFrame, id_col: str, ids: str, group: str, block: int) -> DataFrame:
    """Concatenate the sequences of a group in id order and cut them to ``block`` ids; a short tail is dropped.

    The start of every sequence comes from running totals over its length, so a group that
    holds a third of the corpus is packed by many tasks. Sequences meet their starts in one
    shuffle, their pieces the rest of their block in another; a block never holds more than
    ``block`` ids. Ids are unique within a group and of any type that can be ordered.
    """
    lengths = df.select(group, id_col, F.size(ids).cast("bigint").alias("_len")).where("_len > 0")
    placed = running_totals(lengths, id_col, {"_len": "_start"}, [group], totals={"_len": "_total"})
    sized = join_null_safe(df, placed.select(group, id_col, "_start", "_len", "_total"), [group, id_col])
    size = F.lit(block).cast("bigint")
    first, last = F.floor(F.col("_start") / size), F.floor((F.col("_start") + F.col("_len") - 1) / size)
    pieces = sized.withColumn("block", F.explode(F.sequence(first, last))).where(
        (F.col("block") + 1) * size <= F.col("_total")
    )
    low = F.greatest(F.col("_start"), F.col("block") * size)
    high = F.least(F.col("_start") + F.col("_len"), (F.col("block") + 1) * size)
    piece = F.slice(F.col(ids), (low - F.col("_start") + 1).cast("int"), (high - low).cast("int"))
    return (
        pieces.select(group, "block", low.alias("_at"), piece.alias("_piece"))
        .groupBy(group, "block")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "_piece"))).alias("_p"))
        .select(group, "block", F.flatten(F.transform("_p", lambda p: p["_piece"])).alias("input_ids"))
    )
