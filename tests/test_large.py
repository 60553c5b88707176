"""What must not grow with batches, groups and files: memory in Python workers, rows before a shuffle, tasks' memory."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from samplemill.functions.lists import lists_of
from samplemill.operators import features, tokenizer
from samplemill.queries import QUERIES
from samplemill.sources import archives, sinks
from samplemill.streaming import ingest


def peak(work):
    """Bytes of Python and numpy objects that a call has at most."""
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_streams_read_tables_of_several_files(spark, tmp_path):
    folder = str(tmp_path)
    turns = spark.createDataFrame([(i % 7, i, f"Some words {i % 3}") for i in range(50)], "conv_id int, turn int, text string")
    turns.repartition(3).write.parquet(f"{folder}/conversations.parquet")
    turns.repartition(3).write.parquet(f"{folder}/other.parquet")
    got = {r.word: r.n for r in QUERIES["st3_running_token_counts"](spark, folder).collect()}
    assert got == {"some": 50, "words": 50, "0": 17, "1": 17, "2": 16}


def test_streams_without_any_file_count_nothing(spark, tmp_path):
    stream = ingest.table_stream(spark, str(tmp_path), "*.parquet", "conv_id int, turn int, text string")
    assert ingest.running_counts(stream, "text", "none").collect() == []


def test_words_of_a_batch_do_not_become_objects():
    many = 2_000_000
    words = pa.DictionaryArray.from_arrays(np.arange(many, dtype=np.int32) % 1000, pa.array([f"word{i}" for i in range(1000)])).cast(pa.string())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, many + 1, 200, dtype=np.int32)), words)

    def coded(values):
        return np.array([int(w[4:]) for w in values.to_pylist()], np.int32), np.ones(len(values), np.int64)

    out, most = peak(lambda: tokenizer._encoded(lists, coded))
    assert out.flatten().to_numpy().tolist() == (np.arange(many) % 1000).tolist() and len(out) == many // 200
    # The ids themselves take 4 bytes a word, an object of a word over 50.
    assert most < 16 * many


def test_lists_keep_nulls():
    like = pa.array(["a", None, "b"])
    assert lists_of(np.arange(5), np.array([2, 1, 2]), like).to_pylist() == [[0, 1], None, [3, 4]]
    assert lists_of(np.zeros(0, np.int32), np.array([0, 0, 0]), like).to_pylist() == [[], None, []]


def test_blobs_hold_every_member_once(spark):
    rows = [(f"a{i % 3}" if i % 10 else None, f"{i}.txt", f"text {i} " * 50) for i in range(400)]
    df = spark.createDataFrame(rows, "archive string, name string, content string").coalesce(1)
    blobs = archives.zip_batches(df, "archive", "name", "content", members=20)
    got = {r.name: (r.archive.split("-")[0], r.size, bytes(r.bytes).decode()) for r in archives.expand_archives(blobs).collect()}
    assert got == {n: (a, len(c), c) for a, n, c in rows if a}
    names = [r.path for r in blobs.collect()]
    assert len(set(names)) == len(names) == 18


def test_only_places_that_are_not_zero_are_shuffled(spark):
    docs = spark.createDataFrame([(i, b"abc def ghi " * (i + 1)) for i in range(20)], "id int, content binary")
    block = features.content_block(docs, "id", "content")
    values = features.feature_values([block], "id")
    plan = values._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Filter .*NOT \(.{1,60} = 0\.0\)", plan[plan.index("Aggregate") :])
    got = {(r.id, r.place): r.value for r in values.collect()}
    kept = block.where("value <> 0").collect()
    assert got == {(r.id, r.place): r.value for r in kept} and len(kept) < 20 * 60


def test_object_maps_are_put_together_from_parts(spark, tmp_path):
    df = spark.range(1000).select("id", F.concat(F.lit("v"), "id").alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        (tmp_path / "none").mkdir()
        sinks.write_object_map(df.where("id < 0"), str(tmp_path / "none"), "id", "value")
        sinks.write_object_map(df, str(tmp_path / "map"), "id", "value")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (tmp_path / "none" / "part-00000.txt").read_text() == "{ } "
    text = (tmp_path / "map" / "part-00000.txt").read_text()
    assert text == "{ " + " ,".join(f'"{i}":"v{i}"' for i in range(1000)) + " } "
