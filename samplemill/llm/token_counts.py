"""Token counts of documents in flat token files, by a vectorised search for separators."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samplemill.plans.session import work_path

#: Tokens per block: what a task searches at once.
BLOCK = 1 << 18
#: Blocks whose sums are added up together, so that no task sees all blocks of a long file.
GROUP = 1024
#: The id that ends a document: the one after the last rank of the vocabulary, so that no text yields it.
END = 50256
DTYPE = "<u2"

_ENCODINGS: dict = {}


def encoding(path: str):
    """One per Python worker and file."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def write_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = END, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Tokens of whole texts as flat files, ``(file, block, ids)``, and the order of the documents, ``(file, ordinal, id)``.

    A file has the ids of one partition's documents one after the other, each followed by ``end``; blocks are cut
    after a fixed number of ids, wherever that falls. Nothing says where a document begins.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = named.schema["_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, file = encoding(path), TaskContext.get().partitionId()
        ordinal, number, waiting, size = 0, 0, [], 0
        last, step = np.array([end], DTYPE).tobytes(), block * np.dtype(DTYPE).itemsize

        def rows(n, ids, blocks, bodies, ordinals):
            columns = [pa.array([file] * n, pa.int64()), ids, pa.array(blocks, pa.int64()), pa.array(bodies, pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(ordinals, pa.int64())], names=["file", "_id", "block", "ids", "ordinal"])

        for batch in batches:
            n = batch.num_rows
            yield rows(n, batch.column(0), [None] * n, [None] * n, range(ordinal, ordinal + n))
            ordinal += n
            for text in batch.column(1):
                body = codes.encode_to_numpy(text.as_py() or "", disallowed_special=()).astype(DTYPE).tobytes()
                waiting += [body, last]
                size += len(body) + len(last)
                if size >= 4 * step:
                    whole = b"".join(waiting)
                    cuts = range(0, len(whole) - step + 1, step)
                    yield rows(len(cuts), pa.nulls(len(cuts), batch.column(0).type), range(number, number + len(cuts)), [whole[c : c + step] for c in cuts], [None] * len(cuts))
                    number += len(cuts)
                    waiting = [whole[len(cuts) * step :]]
                    size = len(waiting[0])
        whole = b"".join(waiting)
        cuts = range(0, len(whole), step)
        if cuts:
            empty = pa.nulls(len(cuts), batch.column(0).type)
            yield rows(len(cuts), empty, range(number, number + len(cuts)), [whole[c : c + step] for c in cuts], [None] * len(cuts))

    schema = T.StructType([T.StructField("file", T.LongType()), T.StructField("_id", kind)])
    schema = schema.add("block", "long").add("ids", "binary").add("ordinal", "long")
    at = work_path(docs.sparkSession, "tokens")
    named.mapInArrow(run, schema).write.option("compression", "zstd").parquet(at)
    table = docs.sparkSession.read.schema(schema).parquet(at)
    return table.where("block IS NOT NULL").select("file", "block", "ids"), table.where("ordinal IS NOT NULL").select("file", "ordinal", "_id")


def read_tokens(spark: SparkSession, path: str, block: int = BLOCK, dtype: str = DTYPE) -> DataFrame:
    """``(file, block, ids)`` of real flat files: the file's path, and blocks of a fixed number of ids.

    Files are read by Spark, so their store may be any; one file may have up to 2 GB. A remainder that is no whole
    id is dropped.
    """
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, body in zip(batch.column(0), batch.column(1)):
                view = memoryview(body.as_buffer())
                for k, c in enumerate(range(0, len(view) // width * width, block * width)):
                    part = bytes(view[c : min(c + block * width, len(view) // width * width)])
                    yield pa.RecordBatch.from_arrays([pa.array([file.as_py()]), pa.array([k]), pa.array([part], pa.binary())], names=["file", "block", "ids"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, block long, ids binary")


def find_separators(blocks: DataFrame, end: int = END, dtype: str = DTYPE) -> DataFrame:
    """``(file, block, n, ends)``: the number of ids of each block and the places of the separators in it."""
    schema = blocks.select("file", "block").schema.add("n", "long").add("ends", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [np.frombuffer(b.as_py() or b"", dtype) for b in batch.column(2)]
            ends = [np.flatnonzero(b == end).astype(np.int32) for b in bodies]
            arrays = [pa.array([len(b) for b in bodies], pa.int64()), pa.array(ends, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=schema.names)

    return blocks.select("file", "block", "ids").mapInArrow(run, schema)


def count_tokens(blocks: DataFrame, end: int = END, dtype: str = DTYPE) -> DataFrame:
    """``(file, ordinal, n_tokens, closed)``: the ids of each document of flat token files, without the separator.

    ``blocks`` has ``file``, ``block`` (consecutive from 0 per file) and ``ids``; other columns are not read. Every
    block is searched on its own. What crosses blocks comes from prefix scans over one small row per block: the ids
    and the separators of all earlier blocks, and the place of the last separator before this block. Blocks of a
    file are summed in groups first, so a file may have any number of them. Documents without ids count 0. Ids
    after the last separator of a file are one more document that is not ``closed``. A file without ids, or with
    NULL blocks only, has no documents; an empty table gives no rows.
    """
    found = find_separators(blocks.where("ids IS NOT NULL"), end, dtype).withColumn("g", F.floor(F.col("block") / GROUP))
    found = found.withColumn("seps", F.size("ends").cast("long")).withColumn("tail", F.element_at("ends", -1))
    none = F.lit(-1).cast("long")

    def before(table: DataFrame, by: list[str], order: str, value: str):
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(w), F.lit(0).cast("long"))

    # Within a group: places count from the group's first id.
    inner = found.withColumn("n0", before(found, ["file", "g"], "block", "n")).withColumn("s0", before(found, ["file", "g"], "block", "seps"))
    inner = inner.withColumn("place", F.when(F.col("seps") > 0, F.col("n0") + F.element_at("ends", -1)))
    w = Window.partitionBy("file", "g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = inner.withColumn("p0", F.max("place").over(w))
    groups = inner.groupBy("file", "g").agg(F.sum("n").alias("n"), F.sum("seps").alias("seps"), F.max("place").alias("place"))
    groups = groups.withColumn("gn", before(groups, ["file"], "g", "n")).withColumn("gs", before(groups, ["file"], "g", "seps"))
    whole = Window.partitionBy("file").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("gp", F.coalesce(F.max(F.col("gn") + F.col("place")).over(whole), none))
    of_group = groups.select(F.col("file").alias("f"), F.col("g").alias("h"), "gn", "gs", "gp")
    # A document begins after the separator before it, which may be blocks away.
    placed = inner.join(of_group, F.col("file").eqNullSafe(F.col("f")) & (F.col("g") == F.col("h")))
    start = F.coalesce(F.col("gn") + F.col("p0"), F.col("gp"))
    base = F.col("gn") + F.col("n0")
    counted = F.transform(
        "ends",
        lambda e, i: e + base - F.when(i == 0, start).otherwise(base + F.element_at("ends", F.greatest(i, F.lit(1)))) - 1,
    )
    closed = placed.select("file", (F.col("gs") + F.col("s0")).alias("s"), F.posexplode(counted).alias("i", "n_tokens"))
    closed = closed.select("file", (F.col("s") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    ends = groups.withColumn("last", F.coalesce(F.col("gn") + F.col("place"), F.col("gp")))
    files = ends.groupBy("file").agg(F.sum("n").alias("n"), F.sum("seps").alias("ordinal"), F.max("last").alias("last"))
    rest = files.select("file", "ordinal", (F.col("n") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest.where("n_tokens > 0"))


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, block: int = BLOCK) -> DataFrame:
    """``(id_col, n_tokens)``, one row per row of ``docs``, by way of flat token files.

    A NULL or empty text has 0 tokens. NULL ids and repeated rows stay as rows; other columns are not read.
    """
    blocks, order = write_tokens(docs, id_col, text_col, tokenizer, block=block)
    return order.join(count_tokens(blocks).where("closed"), ["file", "ordinal"]).select(F.col("_id").alias(id_col), "n_tokens")
