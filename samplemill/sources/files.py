"""Loose files, metadata tables, id lists and JSON maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from samplemill.functions.ids import id_from_path
from samplemill.plans.session import cut

# Columns of the metadata table; the last eleven are 0/1 flags.
META_FLAGS = (
    "adware",
    "flooder",
    "ransomware",
    "dropper",
    "spyware",
    "packed",
    "crypto_miner",
    "file_infector",
    "installer",
    "worm",
    "downloader",
)
META_SCHEMA = (
    "sha256 string, is_malware int, rl_fs_t double, rl_ls_const_positives int, "
    + ", ".join(f"{f} int" for f in META_FLAGS)
)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def binary_files(spark: SparkSession, path: str, pattern: str = "*", max_length: int | None = None, recursive: bool = True) -> DataFrame:
    """``(id, path, size, bytes)`` of loose files, optionally truncated."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
    )
    content = F.col("content") if max_length is None else F.substring("content", 1, max_length)
    return files.select(id_from_path("path").alias("id"), "path", F.col("length").alias("size"), content.alias("bytes"))


def file_listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Recursive listing without content (the column pruning of ``binaryFile`` skips it)."""
    return binary_files(spark, path, pattern).select("id", "path", "size")


def meta_columns(df: DataFrame) -> DataFrame:
    """0/1 integers to booleans."""
    return df.select(
        "sha256",
        F.col("is_malware").cast("boolean").alias("is_malware"),
        "rl_fs_t",
        "rl_ls_const_positives",
        *[F.col(f).cast("boolean").alias(f) for f in META_FLAGS],
    )


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return meta_columns(spark.read.schema(META_SCHEMA).csv(path, header=True))


def read_family_labels(spark: SparkSession, path: str) -> DataFrame:
    """``(id, ts, family)`` of a CSV file; rows without a known family are removed."""
    rows = spark.read.schema("id string, ts string, family string").csv(path, header=True)
    return rows.where(F.col("family").isNotNull() & ~F.lower(F.trim("family")).isin("", "unknown"))


def _line_entries(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    """``(id, value, _at)`` of a folder with a JSON object per line."""
    lines = spark.read.text(path).select(F.from_json("value", f"map<string,{value_type}>").alias("_m"))
    return lines.select(F.explode("_m").alias("id", "value"), F.lit(0).cast("bigint").alias("_at"))


def _object_entries(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    """``(id, value, _at)`` of files that are one JSON object each, however long; ``_at`` is an entry's place in its file.

    Text is read in pieces that end at a comma, so the blocks of a file go to different tasks. Whether a piece starts
    inside a string, and how many brackets are open there, is a running total: by block first, over one row per block
    next, then within blocks. A piece that starts outside strings with one bracket open starts an entry; an entry is
    the pieces up to the next such one. Values may hold commas, quotes and brackets.
    """
    raw = spark.read.text(path, lineSep=",").select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    # Escaped characters first, then strings: what is left outside of them has the brackets.
    bare = F.regexp_replace("value", r"\\.", "")
    quotes = F.regexp_count(bare, F.lit('"'))

    def depth(text: Column) -> Column:
        return F.regexp_count(text, F.lit(r"[\[{]")) - F.regexp_count(text, F.lit(r"[\]}]"))

    outside = depth(F.regexp_replace(bare, '"[^"]*("|$)', ""))
    inside = depth(F.regexp_replace(F.concat(F.lit('"'), bare), '"[^"]*("|$)', ""))
    pieces = raw.withColumn("q", quotes).withColumn("d0", outside).withColumn("d1", inside)
    pieces = cut(pieces.repartition("file", "block"), "pieces")

    def before(rows: DataFrame, value: str, by: list[str], order: str, name: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0).cast("bigint")))

    def running(rows: DataFrame, value: str, name: str) -> DataFrame:
        """The sum of ``value`` over all earlier pieces of the file."""
        blocks = before(rows.groupBy("file", "block").agg(F.sum(value).alias("_s")), "_s", ["file"], "block", "_b")
        inner = before(rows, value, ["file", "block"], "at", "_i")
        both = inner.join(blocks.drop("_s"), ["file", "block"])
        return both.withColumn(name, F.col("_b") + F.col("_i")).drop("_b", "_i")

    pieces = running(pieces, "q", "q_before")
    pieces = pieces.withColumn("in_string", F.col("q_before") % 2 == 1)
    pieces = cut(pieces.withColumn("d", F.when(F.col("in_string"), F.col("d1")).otherwise(F.col("d0"))), "pieces")
    pieces = running(pieces, "d", "open")
    first = F.col("open") == 0
    starts = ~F.col("in_string") & (F.col("open") == 1)
    pieces = cut(pieces.withColumn("starts", starts.cast("bigint")), "pieces")
    pieces = running(pieces, "starts", "earlier").withColumn("entry", F.col("earlier") + F.col("starts"))
    # The object's own brackets go: the first one of the file, and the one after which none is open.
    text = F.when(first, F.regexp_replace("value", r"^\s*\{", "")).otherwise(F.col("value"))
    text = F.when(F.col("open") + F.col("d") == 0, F.regexp_replace(text, r"\}\s*$", "")).otherwise(text)
    # What follows the object's end is no part of it.
    pieces = pieces.where(~(first & (F.trim("value") == ""))).withColumn("text", text)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "text"))), lambda p: p["text"]), ",")
    entries = pieces.groupBy("file", "entry").agg(joined.alias("text"))
    parsed = F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), f"map<string,{value_type}>")
    return entries.select(F.explode(parsed).alias("id", "value"), F.col("entry").alias("_at"))


def read_id_map(spark: SparkSession, paths: list[str], value_type: str = "bigint", layout: str = "lines") -> DataFrame:
    """``(id, value)`` from JSON objects; for an id in several paths the last path wins, in an object the last entry.

    ``layout`` is ``lines`` for folders with an object per line, or ``object`` for files that are one object.
    """
    read = {"lines": _line_entries, "object": _object_entries}[layout]
    parts = [read(spark, path, value_type).withColumn("_ord", F.lit(i)) for i, path in enumerate(paths)]
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("id").agg(F.max_by(F.struct("value"), F.struct("_ord", "_at"))["value"].alias("value"))


def read_texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(id, text)`` with one row per file."""
    files = (
        spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    )
    return files.select(stem(F.col("_metadata.file_path")).alias("id"), F.col("value").alias("text"))


def read_ids(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias(key)).where(F.col(key) != "").distinct()


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """One integer per line, over all files of a folder."""
    return spark.read.text(path).select(F.trim("value").cast("bigint").alias("length")).where("length is not null")


def read_keyed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of CSV files with one more column ``key``, the file stem."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").csv(path, header=True)
    return rows.select(stem(F.col("_metadata.file_path")).alias("key"), "*")
