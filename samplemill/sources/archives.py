"""ZIP archives as tables of members."""

from __future__ import annotations

import glob
import io
import os
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MEMBER_SCHEMA = "archive string, name string, size bigint, bytes binary"
MEMBER_TYPES = {"archive": pa.string(), "name": pa.string(), "size": pa.int64(), "bytes": pa.binary()}
BLOB_TYPES = {"path": pa.string(), "content": pa.binary()}
PARTITION_BYTES = 64 << 20
#: Bytes of contents that are passed on at once, and what a row counts for beside its content.
BATCH_BYTES, ROW_BYTES = 4 << 20, 200


def expand_archives(archives: DataFrame, names_only: bool = False, max_length: int | None = None) -> DataFrame:
    """Members of archives given as ``(path, content)``, for instance from the ``binaryFile`` format."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Archives are read where they lie in the batch, one after the other.
            rows, held = [], 0
            for path, content in zip(*batch.columns):
                path = path.as_py()
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as archive:
                    for info in sorted(archive.infolist(), key=lambda i: i.filename):
                        data = None
                        if not names_only:
                            with archive.open(info) as member:
                                data = member.read(max_length) if max_length is not None else member.read()
                        rows.append((path, info.filename, info.file_size, data))
                        held += len(data or b"") + ROW_BYTES
                        if held >= BATCH_BYTES:
                            yield _batch(rows, MEMBER_TYPES)
                            rows, held = [], 0
            if rows:
                yield _batch(rows, MEMBER_TYPES)

    return archives.select("path", "content").mapInArrow(members, MEMBER_SCHEMA)


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], names=list(types))


def read_archives(spark: SparkSession, path: str, names_only: bool = False, max_length: int | None = None) -> DataFrame:
    """Scan ZIP files on any file system Spark reads; each archive must fit in a task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return expand_archives(files, names_only, max_length)


class MemberRange(InputPartition):
    def __init__(self, archive: str, first: int, last: int) -> None:
        self.archive, self.first, self.last = archive, first, last


class ZipMembers(DataSource):
    """``zip_members``: archives on a mounted shared folder, large ones read by several tasks.

    Options: ``path`` (a folder or glob), ``namesonly``, ``maxlength``, ``partitionbytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return MEMBER_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ZipMembersReader(self.options)


class ZipMembersReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.names_only = options.get("namesonly", "false").lower() == "true"
        self.max_length = int(options["maxlength"]) if "maxlength" in options else -1
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[MemberRange]:
        pattern = os.path.join(self.path, "**", "*.zip") if os.path.isdir(self.path) else self.path
        out = []
        for path in sorted(glob.glob(pattern, recursive=True)):
            with zipfile.ZipFile(path) as archive:
                sizes = [i.file_size for i in sorted(archive.infolist(), key=lambda i: i.filename)]
            first, held = 0, 0
            for i, size in enumerate(sizes):
                held += size
                if held >= self.partition_bytes:
                    out.append(MemberRange(path, first, i + 1))
                    first, held = i + 1, 0
            if first < len(sizes):
                out.append(MemberRange(path, first, len(sizes)))
        return out

    def read(self, partition: MemberRange):
        with zipfile.ZipFile(partition.archive) as archive:
            infos = sorted(archive.infolist(), key=lambda i: i.filename)
            for info in infos[partition.first : partition.last]:
                data = None
                if not self.names_only:
                    with archive.open(info) as member:
                        data = member.read(self.max_length)
                yield (partition.archive, info.filename, info.file_size, data)


def scan_members(spark: SparkSession, path: str, names_only: bool = False, max_length: int | None = None, **options) -> DataFrame:
    spark.dataSource.register(ZipMembers)
    reader = spark.read.format("zip_members").option("path", path).option("namesonly", str(names_only).lower())
    if max_length is not None:
        reader = reader.option("maxlength", max_length)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def requested_members(members: DataFrame, requests: DataFrame) -> DataFrame:
    """Members asked for by ``(archive, name, …)``, clustered by archive and sorted by name."""
    joined = members.join(requests, ["archive", "name"])
    return joined.repartition("archive", F.substring(F.md5("name"), 1, 1)).sortWithinPartitions("archive", "name")


def zip_batches(df: DataFrame, archive: str, name: str, content: str, members: int = 64) -> DataFrame:
    """Pack rows to ZIP blobs ``(path, content)`` of at most ``members`` members, one prefix per blob.

    A prefix with many rows gives many blobs, numbered per task.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            places: dict[str, list[int]] = {}
            for at, stem in enumerate(batch.column(0)):
                if stem.is_valid:
                    places.setdefault(stem.as_py(), []).append(at)
            made, held = [], 0
            for stem in sorted(places):
                for low in range(0, len(places[stem]), members):
                    # Only the members of one blob become objects.
                    part = batch.take(pa.array(places[stem][low : low + members]))
                    blob = io.BytesIO()
                    with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as archive_file:
                        for n, c in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                            archive_file.writestr(n, c)
                    made.append((f"{stem}-{task}-{number}.zip", blob.getvalue()))
                    number += 1
                    held += len(made[-1][1]) + ROW_BYTES
                    if held >= BATCH_BYTES:
                        yield _batch(made, BLOB_TYPES)
                        made, held = [], 0
            if made:
                yield _batch(made, BLOB_TYPES)

    rows = df.select(F.col(archive).alias("archive"), F.col(name).alias("name"), F.col(content).cast("binary").alias("content"))
    return rows.mapInArrow(pack, "path string, content binary")
