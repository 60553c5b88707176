"""Steps that took time out of proportion: what they look at, and that results stay the same."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from samplemill.functions import reports
from samplemill.operators import features, packing
from samplemill.sources import labels


def test_dense_builds_the_map_of_an_id_once(spark):
    rows = [(1, 0, 2.0), (1, 3, -1.5), (2, 4, 7.0), (None, 1, 1.0)]
    out = features.dense(spark.createDataFrame(rows, "id int, bucket int, value double"), "id", 5)
    assert {r.id: r.vector for r in out.collect()} == {
        1: [2.0, 0.0, 0.0, -1.5, 0.0], 2: [0.0, 0.0, 0.0, 0.0, 7.0], None: [0.0, 1.0, 0.0, 0.0, 0.0]
    }
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" in plan and "try_element_at(map_from_entries" not in plan


def test_labels_of_one_namespace_are_those_of_all(spark):
    rng = random.Random(4)
    values = ["a", "b", "a:b", "b:c:a", ""]
    vote = lambda: f"{rng.choice(['CLASS', 'FAM', 'BEH'])}:{rng.choice(values)}|{rng.randint(1, 9)}"
    lines = [f"{i} {rng.randint(1, 5)} " + ",".join(vote() for _ in range(rng.randint(1, 9))) for i in range(300)]
    items = labels.vote_items(spark.createDataFrame([(x,) for x in [*lines, "900 1 []", "900 1 CLASS:z|9"]], "value string"))
    every = labels.resolved_labels(items).select("id", F.col("label.class").alias("c"))
    alone = labels.resolved_labels(items, namespaces=["class"])
    assert alone.schema["label"].dataType.names == ["class"]
    assert sorted(map(str, every.collect())) == sorted(map(str, alone.select("id", F.col("label.class").alias("c")).collect()))


def test_reports_of_usual_depth_are_parsed_in_one_round(spark):
    def nested(depth):
        return '{"values":[' * depth + '{"type":"Packer","name":"P%d"}' % depth + "]}" * depth

    raw = 'log {"detects":[{"values":[%s]}]} done'
    rows = [(1, "deep", raw % ",".join(nested(d) for d in range(8))), (2, "deep", raw % nested(20)), (3, "deep", None)]
    df = spark.createDataFrame(rows, "id int, mode string, raw string")
    flat = {r.id: r for r in packing.parsed_reports(df, ["id", "mode"], "raw").collect()}
    assert len(flat[1]["_found"]) == 8 and not flat[1]["_v"] and len(flat[2]["_v"]) == 1
    found = packing.detections(df, ["id", "mode"], "raw").select("id", "name").collect()
    assert sorted(map(tuple, found)) == sorted([*((1, f"P{d}") for d in range(8)), (2, "P20")])


def test_json_body(spark):
    rng = random.Random(3)
    texts = ["", "{", "}", "}{", "a{b", "{a}b}c", "}a{b}"] + ["".join(rng.choices("{}aé\n", k=rng.randint(0, 8))) for _ in range(500)]

    def body(t):
        start, end = t.find("{"), t.rfind("}") if "}" in t else len(t)
        return t[start : end + 1] if start >= 0 and end >= start else ""

    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    assert [r.b for r in df.select(reports.json_body("t").alias("b")).collect()] == [*map(body, texts), ""]


def test_pending_ids_stay_in_many_parts(spark):
    """The planner does not put all ids into one task; NULL and repeated ids are as in an anti join."""
    from samplemill.operators import joins

    ids = spark.createDataFrame([(i % 900 or None, i) for i in range(2000)], "id bigint, x int")
    done = spark.createDataFrame([(i,) for i in (*range(0, 900, 2), 2, 4, None)], "id bigint")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = joins.pending(ids, done, "id")
        assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
        assert got.columns == ids.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, ids.join(done, "id", "left_anti").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
