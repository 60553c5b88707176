"""Streaming forms over the files of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from samplemill.functions.text import digest
from samplemill.queries.inputs import table
from samplemill.queries.registry import query
from samplemill.queries.sources import META_SQL, meta_csv
from samplemill.streaming import ingest


def stream(spark, sf, name):
    return ingest.table_stream(spark, sf, f"{name}.parquet", table(spark, sf, name).schema)


@query(META_SQL)
def st1_meta_ingest(spark, sf):
    return ingest.drain(ingest.meta_stream(spark, meta_csv(spark, sf)), "meta")


@query("SELECT doc_id, lang, md5(text) AS digest FROM documents")
def st1_table_ingest(spark, sf):
    docs = stream(spark, sf, "documents").select("doc_id", "lang", digest("text").alias("digest"))
    return ingest.drain(docs, "documents")


@query("SELECT event_type, user_id, count(*) > 0 AS seen FROM events GROUP BY ALL")
def st2_dedup_stream(spark, sf):
    """First event per user and type within the watermark, over a table that arrives at once."""
    key = F.concat_ws(":", "event_type", "user_id")
    events = stream(spark, sf, "events").select("event_type", "user_id", "ts", key.alias("key"))
    first = ingest.drain(ingest.dedup_stream(events, "key", "ts", "400 days"), "first")
    return first.groupBy("event_type", "user_id").agg((F.count(F.lit(1)) == 1).alias("seen"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def st3_running_counts(spark, sf):
    return ingest.running_counts(stream(spark, sf, "events").select("event_type"), "event_type", "counts")


@query("""SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS word FROM conversations) GROUP BY word""")
def st3_running_token_counts(spark, sf):
    words = stream(spark, sf, "conversations").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word"))
    return ingest.running_counts(words, "word", "words")


@query("SELECT doc_id, n_chars, CASE WHEN l.doc_id IS NULL THEN 'new' ELSE 'done' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)".replace("SELECT doc_id", "SELECT d.doc_id"))
def st4_resume(spark, sf):
    """Documents with a label count as finished; the others are worked on."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    done = docs.join(table(spark, sf, "labels"), "doc_id", "left_semi").withColumn("state", F.lit("done"))
    return ingest.resume(docs, "doc_id", done, lambda todo: todo.withColumn("state", F.lit("new")))
