"""Streams that receive files in several batches."""

import datetime as dt

from pyspark.sql import functions as F

from samplemill.streaming import ingest


def arrivals(spark, folder, rows):
    df = spark.createDataFrame(rows, "id int, digest string, ts timestamp_ntz")
    df.coalesce(1).write.mode("append").parquet(folder)
    return df.schema


def test_counts_and_dedup_over_arrivals(spark, tmp_path):
    folder, out, counts = (str(tmp_path / n) for n in ("in", "out", "counts"))
    t = dt.datetime(2024, 1, 1)
    schema = arrivals(spark, folder, [(i, f"d{i % 3}", t) for i in range(10)])

    def stream():
        return ingest.table_stream(spark, folder, "*.parquet", schema, files_per_trigger=1)

    def first():
        return ingest.drain(ingest.dedup_stream(stream(), "digest", "ts", "1 hour"), "first", path=out)

    assert first().count() == 3
    assert {r.digest: r.n for r in ingest.running_counts(stream(), "digest", "n", counts).collect()} == {"d0": 4, "d1": 3, "d2": 3}
    arrivals(spark, folder, [(i, f"d{i % 5}", t) for i in range(10, 20)])
    assert sorted(r.digest for r in first().collect()) == ["d0", "d1", "d2", "d3", "d4"]
    total = ingest.running_counts(stream(), "digest", "n", counts)
    assert total.agg(F.sum("n")).first()[0] == 20


def test_resume_skips_finished_ids(spark):
    worked = []
    todo = spark.createDataFrame([(i,) for i in range(5)], "id int")
    done = spark.createDataFrame([(1, "old"), (3, "old")], "id int, state string")

    def work(df):
        worked.extend(r.id for r in df.collect())
        return df.withColumn("state", F.lit("new"))

    out = {r.id: r.state for r in ingest.resume(todo, "id", done, work).collect()}
    assert sorted(worked) == [0, 2, 4]
    assert out == {0: "new", 1: "old", 2: "new", 3: "old", 4: "new"}
