"""Inputs that several queries derive from the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns)


def epoch(ts: str) -> Column:
    """Seconds since 1970 of a time without zone, whatever the session zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} AS TIMESTAMP_NTZ))")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as samples: digest, dataset number, polarity, time of the event with the same number."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        F.md5("text").alias("digest"),
        F.expr("cast(substr(source, 4) AS int)").alias("ds_ord"),
        F.expr("cast(substr(source, 4) AS int) % 2").alias("polarity"),
    )
    times = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), epoch("ts").alias("ts"))
    return docs.join(times, "doc_id")


SAMPLES = """samples AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, md5(d.text) AS digest,
         CAST(substr(d.source, 4) AS INT) AS ds_ord, CAST(substr(d.source, 4) AS INT) % 2 AS polarity,
         epoch_us(e.ts) // 1000000 AS ts
  FROM documents d JOIN events e ON e.event_id = d.doc_id)"""


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid time range per dataset: its own first and last time, narrowed by one minute per dataset number."""
    return samples(spark, sf_dir).groupBy("ds_ord").agg(
        (F.min("ts") + 60 * F.col("ds_ord")).alias("valid_lo"), (F.max("ts") - 60 * F.col("ds_ord")).alias("valid_hi")
    )


RANGES = """ranges AS (
  SELECT ds_ord, min(ts) + 60 * ds_ord AS valid_lo, max(ts) - 60 * ds_ord AS valid_hi FROM samples GROUP BY ds_ord)"""


def order_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as samples with a class and a time in days that many orders share."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_orderpriority").alias("label"),
        F.expr("datediff(cast(o_orderdate AS date), DATE'1970-01-01')").cast("bigint").alias("ts"),
    )


ORDER_SAMPLES = """order_samples AS (
  SELECT o_orderkey, o_orderpriority AS label,
         CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS ts FROM orders)"""


def order_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-label samples: the distinct flag/status pairs of an order."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sort_array(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("labels"))
    )


ORDER_LABELS = """flat AS (SELECT DISTINCT l_orderkey, l_returnflag || l_linestatus AS label FROM lineitem)"""


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-label samples: language, size class and, where known, the toxicity mark of a document."""
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "medium").otherwise("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", size.alias("size"))
    marks = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("toxic"), "toxic").alias("mark"))
    both = docs.join(marks, "doc_id", "left")
    return both.select("doc_id", F.sort_array(F.array_compact(F.array("lang", "size", "mark"))).alias("labels"))


DOC_LABELS = """flat AS (
  SELECT doc_id, lang AS label FROM documents
  UNION ALL SELECT doc_id, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END FROM documents
  UNION ALL SELECT doc_id, 'toxic' || toxic FROM labels JOIN documents USING (doc_id))"""


def h(id_sql: str) -> str:
    """SQL of the sample hash."""
    return f"md5('42:' || CAST({id_sql} AS VARCHAR))"


def joined(column: str | Column) -> Column:
    """Arrays are compared as text."""
    return F.array_join(column, ",")


def tagged_union(parts: dict[str, DataFrame], tag: str = "part") -> DataFrame:
    out = None
    for name, df in parts.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out
