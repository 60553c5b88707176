"""Distributions, summaries, audits and log reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from samplemill.functions.votes import sort_votes
from samplemill.operators import audit, balance, dedup, encoding, features, splits, stats
from samplemill.queries.inputs import (
    DOC_LABELS,
    SAMPLES,
    doc_labels,
    h,
    samples,
    table,
    tagged_union,
    texts,
)
from samplemill.queries.registry import query
from samplemill.queries.splits import rank_sql


def random_docs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.md5("text").alias("digest"))
    return splits.random_split(docs, "doc_id", (0.7, 0.2, 0.1))


RANDOM_DOCS = f"""sp AS (SELECT doc_id, lang, md5(text) AS digest, CASE WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'tr'
    WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.2 AS DOUBLE)) THEN 'vl' ELSE 'ts' END AS split
    FROM (SELECT *, {rank_sql('doc_id', 'rn')}, count(*) OVER () AS n FROM documents))"""


@query(f"""WITH {RANDOM_DOCS}, {DOC_LABELS}
  SELECT 'single' AS kind, lang AS label, split, count(*) AS n FROM sp GROUP BY ALL
  UNION ALL SELECT 'multi', label, 'all', count(*) FROM flat GROUP BY ALL""")
def ag1_class_distribution(spark, sf):
    single = stats.class_distribution(random_docs(spark, sf), "lang", "split").withColumnRenamed("lang", "label")
    multi = stats.class_distribution(doc_labels(spark, sf), "labels").select(F.col("labels").alias("label"), F.lit("all").alias("split"), "n")
    return tagged_union({"single": single, "multi": multi}, "kind")


@query(f"""WITH {RANDOM_DOCS} SELECT lang, count(*) FILTER (split = 'tr') AS n_tr, count(*) FILTER (split = 'vl') AS n_vl,
  count(*) FILTER (split = 'ts') AS n_ts, count(*) AS n_all FROM sp GROUP BY lang""")
def ag1_distribution_table(spark, sf):
    return stats.distribution_table(random_docs(spark, sf), "lang")


@query(f"""WITH {RANDOM_DOCS}, c AS (SELECT split, lang, count(*) AS n FROM sp GROUP BY ALL UNION ALL SELECT 'all', lang, count(*) FROM sp GROUP BY ALL)
  SELECT split, max(n) AS n_max, min(n) AS n_min, round(max(n) / min(n), 6) AS imbalance FROM c GROUP BY split""")
def ag2_imbalance(spark, sf):
    return stats.imbalances(random_docs(spark, sf), "lang", "split")


@query(f"""WITH {RANDOM_DOCS}, c AS (SELECT count(*) AS n_to, count(*) FILTER (split = 'tr') AS n_tr, count(*) FILTER (split = 'vl') AS n_vl,
    count(*) FILTER (split = 'ts') AS n_ts, count(*) FILTER (lang = 'en') AS p_to, count(*) FILTER (split = 'tr' AND lang = 'en') AS p_tr,
    count(*) FILTER (split = 'vl' AND lang = 'en') AS p_vl, count(*) FILTER (split = 'ts' AND lang = 'en') AS p_ts FROM sp)
  SELECT n_to, n_tr, n_vl, n_ts, round_even(100.0::DOUBLE * n_tr / n_to, 0) AS pct_tr, round_even(100.0::DOUBLE * n_vl / n_to, 0) AS pct_vl,
    round_even(100.0::DOUBLE * n_ts / n_to, 0) AS pct_ts, round_even(100.0::DOUBLE * p_to / n_to, 0) AS pos_to, round_even(100.0::DOUBLE * p_tr / n_tr, 0) AS pos_tr,
    round_even(100.0::DOUBLE * p_vl / n_vl, 0) AS pos_vl, round_even(100.0::DOUBLE * p_ts / n_ts, 0) AS pos_ts FROM c""")
def ag3_split_summary(spark, sf):
    return stats.split_summary(random_docs(spark, sf), F.col("lang") == "en")


@query("""WITH i AS (SELECT source, md5(text) AS digest, count(*) AS n FROM documents GROUP BY ALL),
  o AS (SELECT digest, sum(n) AS n FROM i GROUP BY digest),
  a AS (SELECT source, n FROM i UNION ALL SELECT 'all', n FROM o)
  SELECT source, CAST(sum(n) AS BIGINT) AS n_total, count(*) AS n_unique, count(*) FILTER (n > 1) AS n_copied,
    round(count(*) * 100.0::DOUBLE / sum(n), 6) AS pct_unique FROM a GROUP BY source""")
def ag4_redundancy(spark, sf):
    return dedup.redundancy(table(spark, sf, "documents").select("source", F.md5("text").alias("digest")), "digest", "source")


@query("""SELECT digest, lang, n FROM (SELECT digest, lang, count(*) AS n, row_number() OVER (PARTITION BY digest ORDER BY count(*) DESC, lang) AS rn
  FROM (SELECT md5(text) AS digest, lang FROM documents) GROUP BY digest, lang) WHERE rn = 1""")
def ag5_majority_label(spark, sf):
    return dedup.majority_label(table(spark, sf, "documents").select(F.md5("text").alias("digest"), "lang"), "digest", "lang")


@query("""SELECT lang, count(*) AS n, round(median(n_chars) / 1000, 6) AS median, round(avg(n_chars) / 1000, 6) AS mean, round(stddev_pop(n_chars) / 1000, 6) AS std,
  min(n_chars) / 1000 AS min, max(n_chars) / 1000 AS max, sum(n_chars) / 1000 AS sum FROM documents GROUP BY lang
  UNION ALL SELECT 'all', count(*), round(median(n_chars) / 1000, 6), round(avg(n_chars) / 1000, 6), round(stddev_pop(n_chars) / 1000, 6),
  min(n_chars) / 1000, max(n_chars) / 1000, sum(n_chars) / 1000 FROM documents""")
def ag9_size_summary(spark, sf):
    out = stats.size_summary(table(spark, sf, "documents").select("lang", "n_chars"), "n_chars", 1000.0, ["lang"], "all")
    return out.select("lang", "n", "min", "max", "sum", *[F.round(c, 6).alias(c) for c in ("median", "mean", "std")])


@query("SELECT lang, n_chars, count(*) AS n FROM documents GROUP BY ALL")
def ag10_length_counts(spark, sf):
    return stats.length_counts(table(spark, sf, "documents"), "lang", "n_chars")


THRESHOLDS = [2**k for k in range(8, 17)]


@query(f"""SELECT lang, CAST(t AS BIGINT) AS threshold, count(*) FILTER (n_chars <= t) AS n
  FROM documents, (SELECT unnest({THRESHOLDS}) AS t) GROUP BY lang, t""")
def ag11_counts_below(spark, sf):
    return stats.counts_below(table(spark, sf, "documents"), "lang", "n_chars", THRESHOLDS)


@query("SELECT lang, round(quantile_cont(n, 0.25), 6) AS q25, round(quantile_cont(n, 0.5), 6) AS q50, round(quantile_cont(n, 0.95), 6) AS q95 FROM (SELECT lang, len(string_split_regex(text, '\\s+')) AS n FROM documents) GROUP BY lang")
def ag13_length_quantiles(spark, sf):
    docs = texts(spark, sf, "lang", "text").select("lang", F.split("text", r"\s+").alias("ids"))
    q = stats.length_quantiles(docs, "ids", {"q25": 0.25, "q50": 0.5, "q95": 0.95}, ["lang"])
    return q.select("lang", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q95")])


@query()
def ag13_length_sketch(spark, sf):
    docs = texts(spark, sf, "lang", "text").select("lang", F.split("text", r"\s+").alias("ids"))
    return stats.length_sketch(docs, "ids", [0.25, 0.5, 0.95], ["lang"])


@query("""SELECT lang, CAST(unnest([0.25, 0.5, 0.95]) AS DOUBLE) AS share, TRUE AS close FROM documents GROUP BY lang""")
def ag13_sketch_error(spark, sf):
    """Each sketched quantile has a rank within five hundredths of what was asked for."""
    shares = [0.25, 0.5, 0.95]
    docs = texts(spark, sf, "lang", "text").select("lang", F.split("text", r"\s+").alias("ids"))
    sketch = stats.length_sketch(docs, "ids", shares, ["lang"])
    asked = sketch.select("lang", F.posexplode("quantiles").alias("i", "value"))
    ranked = docs.select("lang", F.size("ids").alias("size")).join(asked, "lang").groupBy("lang", "i").agg(
        F.avg((F.col("size") < F.col("value")).cast("double")).alias("below"),
        F.avg((F.col("size") <= F.col("value")).cast("double")).alias("upto"),
    )
    share = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("i") + 1)
    close = (F.col("below") - 0.05 <= share) & (share <= F.col("upto") + 0.05)
    return ranked.select("lang", share.alias("share"), close.alias("close"))


@query("""SELECT l_returnflag, count(l_discount) AS n, round(avg(l_discount), 6) AS mean,
  round(1.959963984540054 * stddev_pop(l_discount) / sqrt(count(l_discount)), 8) AS half_width FROM lineitem GROUP BY l_returnflag""")
def ag15_confidence_interval(spark, sf):
    ci = stats.confidence_interval(table(spark, sf, "lineitem"), "l_discount", 0.95, ["l_returnflag"])
    return ci.select("l_returnflag", "n", F.round("mean", 6).alias("mean"), F.round("half_width", 8).alias("half_width"))


RUNS = """runs AS (SELECT l_suppkey AS run, l_linenumber AS epoch, round(avg(l_discount), 5) AS loss, round(avg(l_tax), 5) AS accuracy FROM lineitem GROUP BY ALL)"""


def runs(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("epoch")).agg(
        F.round(F.avg("l_discount"), 5).alias("loss"), F.round(F.avg("l_tax"), 5).alias("accuracy")
    )


@query(f"""WITH {RUNS}, r AS (SELECT run, 'loss' AS metric, loss AS best, epoch, row_number() OVER (PARTITION BY run ORDER BY loss, epoch) AS rn FROM runs
  UNION ALL SELECT run, 'accuracy', accuracy, epoch, row_number() OVER (PARTITION BY run ORDER BY accuracy DESC, epoch) FROM runs)
  SELECT run, metric, best, epoch FROM r WHERE rn = 1""")
def ag16_best_epochs(spark, sf):
    return stats.best_epochs(runs(spark, sf), "run", "epoch", lower=["loss"], higher=["accuracy"])


@query("""WITH e AS (SELECT user_id, event_id, event_type, value FROM events)
  SELECT user_id, arg_max(CASE WHEN event_type = 'click' THEN value END, event_id) FILTER (event_type = 'click') AS click,
    arg_max(CASE WHEN event_type = 'view' THEN value END, event_id) FILTER (event_type = 'view') AS view FROM e GROUP BY user_id""")
def ag17_collapse_log(spark, sf):
    events = table(spark, sf, "events").select(
        "user_id",
        "event_id",
        F.when(F.col("event_type") == "click", F.col("value")).alias("click"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("view"),
    )
    return stats.collapse_log(events, ["user_id"], "event_id", ["click", "view"])


@query("""SELECT count(*) AS n_runs, count(*) FILTER (event_type <> 'error') AS n_ok,
  round(avg(value) FILTER (event_id > (SELECT min(event_id) FROM events)), 6) AS mean_seconds FROM events""")
def ag18_sweep_outcome(spark, sf):
    out = stats.sweep_outcome(table(spark, sf, "events"), "event_id", "value", F.col("event_type") != "error")
    return out.withColumn("mean_seconds", F.round("mean_seconds", 6))


@query("""WITH l AS (SELECT 'job ' || user_id || ': ' || event_type || ' after ' || CAST(floor(value) AS BIGINT) AS line FROM events),
  t AS (SELECT CASE WHEN contains(line, 'error') THEN 'crash' WHEN contains(line, 'view') THEN 'timeout' WHEN contains(line, 'click') THEN 'success' ELSE 'other' END AS outcome,
    regexp_extract(line, 'job (\\d+):', 1) AS id FROM l)
  SELECT outcome, count(*) AS n, count(DISTINCT id) AS n_ids FROM t GROUP BY outcome""")
def ag19_log_outcomes(spark, sf):
    line = F.concat(F.lit("job "), "user_id", F.lit(": "), "event_type", F.lit(" after "), F.floor("value"))
    lines = table(spark, sf, "events").select(line.alias("line"))
    return stats.log_outcomes(lines, "line", {"crash": "error", "timeout": "view", "success": "click"}, r"job (\d+):")


@query("""SELECT lang, count(*) AS n, round(1.0::DOUBLE / count(*), 9) AS inverse,
  round((1 - 0.999::DOUBLE) / (1 - pow(0.999::DOUBLE, count(*))), 9) AS effective FROM documents GROUP BY lang""")
def ag20_class_weights(spark, sf):
    weights = balance.class_weights(table(spark, sf, "documents"), "lang")
    return weights.select("lang", "n", F.round("inverse", 9).alias("inverse"), F.round("effective", 9).alias("effective"))


@query("""WITH v AS (SELECT l_orderkey, l_returnflag AS flag, l_linestatus AS status FROM lineitem GROUP BY ALL)
  SELECT o_orderpriority, 'flag' AS extractor, flag AS label, count(DISTINCT l_orderkey) AS n FROM v JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL
  UNION ALL SELECT o_orderpriority, 'status', status, count(DISTINCT l_orderkey) FROM v JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""")
def ag21_label_popularity(spark, sf):
    def votes(column):
        counts = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
        return counts.groupBy("l_orderkey").agg(sort_votes(F.sort_array(F.collect_list(F.struct("value", "count")))).alias(column))

    both = votes("l_returnflag").join(votes("l_linestatus"), "l_orderkey")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return stats.label_popularity(both.join(orders, "l_orderkey"), "o_orderpriority", {"flag": "l_returnflag", "status": "l_linestatus"})


@query("""SELECT l_returnflag, round(sum(l_quantity * (l_tax / nullif(l_discount, 0))) FILTER (l_discount <> 0) / sum(l_quantity) FILTER (l_discount <> 0), 6) AS mean
  FROM lineitem GROUP BY l_returnflag""")
def ag22_weighted_mean(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn(
        "ratio", F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.try_divide("l_tax", "l_discount"))
    )
    mean = stats.weighted_mean(lines, "ratio", "l_quantity", ["l_returnflag"])
    return mean.withColumn("mean", F.round("mean", 6))


@query(f"""WITH {RUNS} SELECT a.epoch, b.run, round(a.loss - b.loss, 6) AS delta FROM runs a JOIN runs b ON a.epoch = b.epoch AND a.run = b.run + 1""")
def ag23_paired_delta(spark, sf):
    """Every run against the run before it, per epoch."""
    base = runs(spark, sf)
    tuned = base.withColumn("run", F.col("run") - 1)
    out = stats.paired_delta(base, tuned, ["run", "epoch"], "loss")
    return out.withColumn("delta", F.round("delta", 6))


@query("""WITH b AS (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents)
  SELECT CAST(('0x' || b)::BIGINT AS INT) AS byte, count(*) AS n FROM b GROUP BY b""")
def ag24_byte_distribution(spark, sf):
    docs = texts(spark, sf, "text").select(features.byte_histogram(F.col("text").cast("binary")).alias("h"))
    return stats.byte_distribution(docs, "h").where("n > 0")


@query("""SELECT user_id AS key FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'
  INTERSECT SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'error')""")
def so1_ids_in_all_views(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("key"), "event_type")
    return audit.ids_in_all({t: events.where(F.col("event_type") == t).select("key") for t in ("click", "view", "error")}, "key")


@query("""WITH o AS (SELECT o_orderkey FROM orders), r AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'),
  k AS (SELECT o_orderkey FROM o WHERE o_orderkey IN (SELECT l_orderkey FROM r))
  SELECT 'all' AS part, o_orderkey FROM k UNION ALL SELECT 'returned', o_orderkey FROM k""")
def so1_synchronise_views(spark, sf):
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    views = {"all": table(spark, sf, "orders").select("o_orderkey"), "returned": returned}
    return tagged_union(audit.synchronise(views, "o_orderkey"))


@query(f"WITH {RANDOM_DOCS} SELECT digest FROM sp WHERE split = 'tr' INTERSECT SELECT digest FROM sp WHERE split = 'vl'")
def so2_split_leakage(spark, sf):
    return audit.split_leakage(random_docs(spark, sf), "digest")


@query("""WITH a AS (SELECT DISTINCT doc_id, quality AS v FROM labels), b AS (SELECT DISTINCT doc_id, toxic AS v FROM labels)
  SELECT doc_id, v, 'first' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT doc_id, v, 'second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def so3_symmetric_difference(spark, sf):
    marks = table(spark, sf, "labels")
    return audit.symmetric_difference(marks.select("doc_id", F.col("quality").alias("v")), marks.select("doc_id", F.col("toxic").alias("v")))


@query(f"""WITH {RANDOM_DOCS}, {SAMPLES}, a AS (SELECT sp.split, sp.doc_id, sp.lang, row_number() OVER (PARTITION BY split ORDER BY ts, {h('sp.doc_id')}, sp.doc_id) AS pos FROM sp JOIN samples USING (doc_id)),
  b AS (SELECT sp.split, sp.doc_id, CASE WHEN sp.lang = 'es' THEN 'en' ELSE sp.lang END AS lang, row_number() OVER (PARTITION BY split ORDER BY samples.n_chars, {h('sp.doc_id')}, sp.doc_id) AS pos FROM sp JOIN samples USING (doc_id)
    WHERE ds_ord > 0),
  j AS (SELECT coalesce(a.split, b.split) AS split, a.doc_id AS na, b.doc_id AS nb, a.lang AS la, b.lang AS lb FROM a FULL JOIN b ON a.split = b.split AND a.pos = b.pos)
  SELECT split, count(*) AS n, count(*) FILTER (na <> nb) AS n_name, count(*) FILTER (la <> lb) AS n_label, count(*) FILTER (na IS NULL OR nb IS NULL) AS n_lone FROM j GROUP BY split""")
def so4_ordered_mismatches(spark, sf):
    split = random_docs(spark, sf).select("doc_id", "split")
    rows = samples(spark, sf).join(split, "doc_id")
    other = rows.where("ds_ord > 0").withColumn("lang", F.when(F.col("lang") == "es", "en").otherwise(F.col("lang")))
    a = rows.select("split", "doc_id", "lang", F.col("ts").alias("key"))
    b = other.select("split", "doc_id", "lang", F.col("n_chars").alias("key"))
    return audit.ordered_mismatches(a, b, "doc_id", "lang", "key")


@query("""SELECT id, value FROM (SELECT id, value, row_number() OVER (PARTITION BY id ORDER BY o DESC) AS rn FROM (
  SELECT doc_id AS id, lang AS value, 0 AS o FROM documents UNION ALL SELECT event_id, event_type, 1 FROM events)) WHERE rn = 1""")
def so5_union_with_override(spark, sf):
    from samplemill.operators.joins import override_union

    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("value"))
    events = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("value"))
    return override_union([docs, events], "id", "value")


@query("""SELECT DISTINCT md5(text) AS digest FROM documents EXCEPT SELECT md5(d.text) FROM documents d JOIN labels USING (doc_id)""")
def so6_id_difference(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"))
    return audit.id_difference(docs, docs.join(table(spark, sf, "labels"), "doc_id", "left_semi"), "digest")


@query("""WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) SELECT p_brand, n FROM c WHERE n = (SELECT max(n) FROM c)""")
def tk4_most_common(spark, sf):
    return encoding.most_common(table(spark, sf, "part"), "p_brand")


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, n, CAST(row_number() OVER (ORDER BY n DESC, source) - 1 AS INT) AS label_id,
  round(n / sum(n) OVER (), 4) AS share FROM c""")
def sc20_label_ids_and_shares(spark, sf):
    ids = encoding.label_ids(table(spark, sf, "documents").select("source"), "source")
    return encoding.probabilities(ids, "n", 4)
