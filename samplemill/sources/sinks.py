"""Writers: partitioned datasets, keyed results, id maps, filtered text."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplemill.functions.ids import id_prefix, sample_hash
from samplemill.plans.ordered import join_null_safe
from samplemill.plans.session import drop_path, shared_dir, work_path

#: Bytes that are copied at once where files are put together.
COPIED_BYTES = 4 << 20


def write_by_prefix(df: DataFrame, path: str, id_col: str, digits: int = 2, rows: int = 1_000_000) -> None:
    """One folder per id prefix, compressed with zstd.

    The ids of every prefix are counted first, and a prefix is dealt by hash to one task per ``rows`` rows. So a
    prefix that most ids share is written by as many tasks as its rows need, and a rare one by a single task.
    """
    keyed = df.withColumn("prefix", id_prefix(id_col, digits))
    parts = keyed.groupBy("prefix").agg(F.ceil(F.count(F.lit(1)) / rows).alias("_parts"))
    part = F.pmod(F.crc32(sample_hash(id_col).cast("binary")), F.col("_parts")).alias("_part")
    dealt = join_null_safe(keyed, parts, ["prefix"]).withColumn("_part", part).repartition("prefix", "_part")
    dealt.drop("_part", "_parts").write.partitionBy("prefix").option("compression", "zstd").parquet(path)


def volume(df: DataFrame, content: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(content)), F.lit(0)).cast("bigint").alias("n_bytes")
    )


def write_dataset(df: DataFrame, path: str, max_records: int = 1_000_000, mode: str = "errorifexists") -> None:
    """Parquet files of at most ``max_records`` rows. Appending another shard merges it."""
    df.write.mode(mode).option("maxRecordsPerFile", max_records).parquet(path)


def result_key(params: dict) -> str:
    """sha-256 of all parameters, sorted by name."""
    text = "--".join(f"{k}={params[k]}" for k in sorted(params))
    return hashlib.sha256(text.encode()).hexdigest()


def materialize(spark: SparkSession, name: str, params: dict, build: Callable[[], DataFrame], root: str | None = None) -> DataFrame:
    """Result of ``build`` for these parameters, written once and read afterwards."""
    path = f"{root or shared_dir(spark)}/{name}/{result_key(params)}"
    try:
        # A folder without its commit marker comes from a run that did not finish.
        spark.read.format("binaryFile").load(f"{path}/_SUCCESS").select("path").first()
    except AnalysisException:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_id_map(df: DataFrame, path: str, id_col: str, value: str) -> None:
    """One JSON object ``{id: value}`` per line, sorted by id over all files."""
    entry = F.to_json(F.map_from_arrays(F.array(F.col(id_col).cast("string")), F.array(value)))
    df.orderBy(id_col).select(entry.alias("value")).write.text(path)


def write_object_map(df: DataFrame, path: str, id_col: str, value: str) -> None:
    """One file with one JSON object ``{id: value, ...}`` on one line, sorted by id.

    Rows are sorted and written by all tasks, in parts whose names are in order; one task puts the parts together byte
    by byte, as a file has one writer.
    """
    entry = F.concat(F.to_json(F.array(F.col(id_col).cast("string"))), F.lit(":"), F.to_json(F.array(value)))
    # Both come as arrays of one element, whose brackets go.
    entry = F.regexp_replace(entry, r'^\["(.*)"\]:\[(.*)\]$', '"$1":$2')
    spark = df.sparkSession
    parts = work_path(spark, "entries")
    # A comma before every entry, and a blank, which is part of none, after it.
    df.orderBy(id_col).select(F.concat(F.lit(","), entry).alias("value")).write.text(parts, lineSep=" ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            source, folder = fs.FileSystem.from_uri(_uri(parts))
            target, root = fs.FileSystem.from_uri(_uri(path))
            target.create_dir(root, recursive=True)
            found = source.get_file_info(fs.FileSelector(folder))
            names = sorted(f.path for f in found if f.size and f.base_name.startswith("part-"))
            with target.open_output_stream(f"{root}/part-00000.txt") as out:
                out.write(b"{ ")
                for i, name in enumerate(names):
                    with source.open_input_stream(name) as part:
                        # No comma before the first entry of all.
                        part.read(1 if i == 0 else 0)
                        while piece := part.read(COPIED_BYTES):
                            out.write(piece)
                out.write(b"} ")
            yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64())], names=["n"])

    spark.range(1).coalesce(1).mapInArrow(run, "n bigint").agg(F.sum("n")).collect()
    drop_path(spark, parts)


def _uri(path: str) -> str:
    return path if ":" in path else f"file://{path}"


def write_files(df: DataFrame, path: str, name: str, content: str) -> None:
    """One file per row below ``path``, named by a column. A task that runs again writes the same files again."""
    fields = df.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        target, root = fs.FileSystem.from_uri(_uri(path))
        target.create_dir(root, recursive=True)
        for batch in batches:
            for file, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with target.open_output_stream(f"{root}/{file}") as out:
                    out.write(body or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    fields.mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def keep_lines(spark: SparkSession, source: str, target: str, ids: DataFrame, key: str = "id") -> None:
    """Copy the lines whose first word is a listed id."""
    lines = spark.read.text(source).withColumn(key, F.substring_index("value", " ", 1))
    lines.join(ids.select(key), key, "left_semi").select("value").write.text(target)
