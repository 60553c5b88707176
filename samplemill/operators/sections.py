"""Bounds of executable regions from section tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Bits of the outcome code.
SUCCESS = 1
COULD_NOT_PARSE = 2
NO_SECTIONS = 4
NO_NONEMPTY_SECTIONS = 8
NO_EXECUTABLE_SECTION = 16
OVER_FILE = 32
OVER_NEXT = 64
EMPTY = 128
INVERTED = 256


def clamped_sections(sections: DataFrame, file: str = "file") -> DataFrame:
    """Executable sections with bounds cut at the file end and at the next section, and their code bits.

    Columns: ``file, ord, offset, size, is_executable, file_length``. The neighbour is the
    next non-empty section in table order, executable or not. The file format allows at most
    65,535 sections per file, which bounds the window partitions.
    """
    following = F.lead("offset").over(Window.partitionBy(file).orderBy("ord"))
    placed = sections.where("size > 0").withColumn("_next", following).where("is_executable")
    end = F.col("offset") + F.col("size")
    in_file = F.least(end, F.col("file_length"))
    upper = F.least(in_file, F.coalesce(F.col("_next"), in_file))
    bit = lambda rule, code: F.when(rule, F.lit(code)).otherwise(F.lit(0))
    return placed.select(
        file,
        "ord",
        F.col("offset").alias("lower"),
        upper.alias("upper"),
        (
            bit(end > F.col("file_length"), OVER_FILE)
            .bitwiseOR(bit(in_file > F.col("_next"), OVER_NEXT))
            .bitwiseOR(bit(F.col("offset") == upper, EMPTY))
            .bitwiseOR(bit(F.col("offset") > upper, INVERTED))
        ).alias("code"),
    )


def section_bounds(sections: DataFrame, file: str = "file") -> DataFrame:
    """Per file the kept ``bounds`` in table order and the outcome ``code``."""
    clamped = clamped_sections(sections, file)
    usable = F.col("code").bitwiseAND(EMPTY | INVERTED) == 0
    found = clamped.groupBy(file).agg(
        F.bit_or("code").alias("_code"),
        F.transform(
            F.array_sort(F.collect_list(F.when(usable, F.struct("ord", "lower", "upper")))),
            lambda s: F.struct(s["lower"].alias("lo"), s["upper"].alias("hi")),
        ).alias("bounds"),
    )
    files = sections.groupBy(file).agg(
        F.bool_or(F.coalesce(F.col("size"), F.lit(0)) > 0).alias("_filled"),
        F.bool_or(F.col("is_executable") & (F.col("size") > 0)).alias("_exec"),
        F.count("ord").alias("_n"),
    )
    code = (
        F.when(F.col("_n") == 0, NO_SECTIONS)
        .when(~F.col("_filled"), NO_NONEMPTY_SECTIONS)
        .when(~F.coalesce(F.col("_exec"), F.lit(False)), NO_EXECUTABLE_SECTION)
        .when(F.col("_code") == 0, SUCCESS)
        .otherwise(F.col("_code"))
    )
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    return files.join(found, file, "left").select(
        file, F.coalesce(F.col("bounds").cast("array<struct<lo:bigint,hi:bigint>>"), none).alias("bounds"), code.alias("code")
    )


def section_content(df: DataFrame, content: str = "content", bounds: str = "bounds", out: str = "code_bytes") -> DataFrame:
    """Add the bytes within the kept bounds, one region after the other; NULL content gives NULL, no bounds no bytes."""

    parts = F.transform(
        bounds, lambda b: F.substring(F.col(content), b["lo"].cast("int") + 1, (b["hi"] - b["lo"]).cast("int"))
    )
    empty = F.substring(F.col(content), F.lit(1), F.lit(0))
    return df.withColumn(out, F.aggregate(parts, empty, lambda acc, p: F.concat(acc, p)))
