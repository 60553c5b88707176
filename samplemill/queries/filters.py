"""Filters, projections and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from samplemill.functions.ids import id_from_path, with_suffix
from samplemill.operators import balance, filters, joins
from samplemill.operators.dedup import majority_label
from samplemill.plans.session import cut
from samplemill.plans.staged import side_by_side
from samplemill.queries.inputs import (
    DOC_LABELS,
    ORDER_LABELS,
    RANGES,
    SAMPLES,
    doc_labels,
    h,
    joined,
    order_labels,
    ranges,
    samples,
    table,
    tagged_union,
)
from samplemill.queries.registry import query


@query("""SELECT doc_id, n_chars FROM documents
          WHERE n_chars BETWEEN 500 AND 5000 AND doc_id IN (SELECT doc_id FROM labels)""")
def flt1_size_range(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return filters.keep_ids(filters.size_range(docs, "n_chars", 500, 5000), table(spark, sf, "labels"), "doc_id")


@query("""SELECT doc_id, lang FROM documents WHERE lang IN (
            SELECT lang FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 3)
            WHERE n >= 20)""")
def flt2_frequent_classes(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return filters.keep_frequent(docs, "lang", top_k=3, min_freq=20)


@query(f"""WITH {ORDER_LABELS},
  keep AS (SELECT label FROM (SELECT label, count(*) AS n FROM flat GROUP BY label ORDER BY n DESC, label LIMIT 3) WHERE n >= 10)
  SELECT l_orderkey, string_agg(label, ',' ORDER BY label) AS labels FROM flat
  WHERE label IN (SELECT label FROM keep) GROUP BY l_orderkey""")
def flt3_frequent_labels(spark, sf):
    kept = filters.keep_frequent_labels(order_labels(spark, sf), "l_orderkey", "labels", top_k=3, min_freq=10)
    return kept.select("l_orderkey", joined("labels").alias("labels"))


@query(f"""WITH {SAMPLES},
  c AS (SELECT lang, count(*) AS n FROM samples GROUP BY lang),
  r AS (SELECT s.doc_id, s.lang, c.n, row_number() OVER (PARTITION BY s.lang ORDER BY s.ts, {h('s.doc_id')}, s.doc_id) AS rn
        FROM samples s JOIN c USING (lang))
  SELECT doc_id, lang FROM r WHERE rn > n - floor(1.5 * (SELECT min(n) FROM c))""")
def flt4_cap_imbalance(spark, sf):
    kept = filters.cap_imbalance(samples(spark, sf).select("doc_id", "lang", "ts"), "lang", "ts", "doc_id", 1.5)
    return kept.select("doc_id", "lang")


@query()
def flt5_cap_label_imbalance(spark, sf):
    kept = balance.cap_label_imbalance(doc_labels(spark, sf), "doc_id", "labels", 1.5)
    return kept.select("doc_id", joined("labels").alias("labels"))


@query(f"""WITH {DOC_LABELS}, c AS (SELECT label, count(*) AS n FROM flat GROUP BY label),
  o AS (SELECT min(n) AS least FROM c)
  SELECT CAST((SELECT least FROM o) AS BIGINT) AS least, CAST(0 AS BIGINT) AS n_over_everywhere,
         CAST((SELECT count(*) FROM c WHERE n <= floor(1.5 * (SELECT least FROM o))) AS BIGINT) AS n_small,
         CAST(0 AS BIGINT) AS n_below_cap""")
def flt5_cap_invariants(spark, sf):
    """No sample is left whose labels are all over the cap, and no label fell below its cap."""
    before = doc_labels(spark, sf)
    after = balance.cap_label_imbalance(before, "doc_id", "labels", 1.5)
    counts = before.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    least = counts.agg(F.min("n")).first()[0]
    cap = int(1.5 * least)
    flat = after.select("doc_id", F.explode("labels").alias("label"))
    left = flat.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    over = flat.join(left, "label").groupBy("doc_id").agg(F.min("m").alias("m"))
    both = counts.join(left, "label", "left").agg(
        F.count_if(F.col("n") <= cap).alias("n_small"),
        F.count_if(F.coalesce("m", F.lit(0)) < F.least("n", F.lit(cap))).alias("n_below_cap"),
    )
    left_over = over.agg(F.count_if(F.col("m") > cap).alias("n_over_everywhere"), F.lit(least).cast("bigint").alias("least"))
    return side_by_side(left_over, both)


def packed_flags(spark, sf):
    return table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("is_packed"))


@query("""WITH s AS (SELECT d.doc_id, l.quality = 1 AS p FROM documents d LEFT JOIN labels l USING (doc_id))
  SELECT doc_id, 'any' AS protocol FROM s UNION ALL SELECT doc_id, 'yes' FROM s WHERE p
  UNION ALL SELECT doc_id, 'no' FROM s WHERE NOT p UNION ALL SELECT doc_id, 'unk' FROM s WHERE p IS NULL""")
def flt6_packing_protocol(spark, sf):
    docs, packed = table(spark, sf, "documents").select("doc_id"), packed_flags(spark, sf)
    return tagged_union({p: filters.packed_filter(docs, packed, "doc_id", p) for p in filters.PROTOCOLS}, "protocol")


@query("""SELECT count(*) FILTER (l.quality = 1) AS n_packed, count(*) FILTER (l.quality <> 1) AS n_not_packed,
  count(*) FILTER (l.quality IS NULL) AS n_unknown FROM documents d LEFT JOIN labels l USING (doc_id)""")
def flt6_packing_counts(spark, sf):
    return filters.packing_counts(table(spark, sf, "documents").select("doc_id"), packed_flags(spark, sf), "doc_id")


EARLY, LATE = 1704070000, 1709000000


@query(f"""WITH {SAMPLES}, {RANGES}
  SELECT s.doc_id, s.ts FROM samples s JOIN ranges r USING (ds_ord)
  WHERE s.ts BETWEEN greatest(r.valid_lo, {EARLY}) AND least(r.valid_hi, {LATE})""")
def flt7_time_window(spark, sf):
    return filters.time_window(samples(spark, sf), "ts", "ds_ord", ranges(spark, sf), EARLY, LATE).select("doc_id", "ts")


@query(f"""WITH {SAMPLES}, {RANGES}, b AS (SELECT s.ds_ord, s.ts, greatest(r.valid_lo, {EARLY}) AS lo, least(r.valid_hi, {LATE}) AS hi
    FROM samples s JOIN ranges r USING (ds_ord))
  SELECT ds_ord, count(*) AS n_total, count(*) FILTER (ts IS NULL) AS n_missing, count(*) FILTER (ts < lo) AS n_early,
         count(*) FILTER (ts > hi) AS n_late, count(*) FILTER (ts BETWEEN lo AND hi) AS n_kept FROM b GROUP BY ds_ord""")
def flt7_time_waterfall(spark, sf):
    return filters.time_waterfall(samples(spark, sf), "ts", "ds_ord", ranges(spark, sf), EARLY, LATE)


@query("""SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
  AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def flt8_keep_and_drop_ids(spark, sf):
    docs, marks = table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels")
    return filters.keep_ids(filters.drop_ids(docs, marks.where("toxic = 1"), "doc_id"), marks.where("quality = 1"), "doc_id")


@query("""WITH d AS (SELECT doc_id, md5(text) AS digest, n_chars, lang FROM documents),
  used AS (SELECT doc_id FROM labels WHERE toxic = 1),
  r AS (SELECT d.doc_id, d.digest, CASE
      WHEN n_chars < 60 THEN 'empty' WHEN lang NOT IN ('en', 'fr', 'de') THEN 'invalid'
      WHEN doc_id IN (SELECT doc_id FROM used) THEN 'finetune'
      WHEN digest IN (SELECT digest FROM d JOIN used USING (doc_id)) THEN 'finetune_digest' END AS reason FROM d),
  f AS (SELECT digest, min(doc_id) AS first FROM r WHERE reason IS NULL GROUP BY digest)
  SELECT r.doc_id, CASE WHEN reason IS NULL AND r.doc_id <> f.first THEN 'duplicate' ELSE reason END AS reason
  FROM r LEFT JOIN f USING (digest)""")
def flt9_exclusion_reasons(spark, sf):
    docs = cut(table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"), "n_chars", "lang"), "digests")
    used = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    narrow = docs.select("doc_id", "digest")
    return filters.exclusion_reasons(
        narrow,
        "doc_id",
        "digest",
        empty=docs.where("n_chars < 60"),
        valid=docs.where("lang in ('en', 'fr', 'de')"),
        finetune=used,
        finetune_digests=filters.keep_ids(narrow, used, "doc_id"),
    ).select("doc_id", "reason")


@query(f"""WITH {ORDER_LABELS}, g AS (SELECT l_orderkey, bool_and(label IN ('AF', 'RF', 'NO')) AS ok FROM flat GROUP BY l_orderkey)
  SELECT 'single' AS part, doc_id AS id FROM documents WHERE lang IN ('fr', 'es')
  UNION ALL SELECT 'multi', l_orderkey FROM g WHERE ok""")
def flt10_allow_classes(spark, sf):
    single = filters.allow_classes(table(spark, sf, "documents"), "lang", ["fr", "es"])
    multi = filters.allow_label_sets(order_labels(spark, sf), "labels", ["AF", "RF", "NO"])
    return tagged_union({"single": single.select(F.col("doc_id").alias("id")), "multi": multi.select(F.col("l_orderkey").alias("id"))})


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25")
def flt11_head_by_id(spark, sf):
    return filters.head_by_id(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 25)


@query(f"""SELECT doc_id, CAST(('0x' || substr({h('doc_id')}, 1, 8))::BIGINT % 4 AS INT) AS shard,
  substr(md5(text), 1, 1) AS prefix FROM documents""")
def flt11_shards(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"))
    parts = [
        filters.shard(docs, "doc_id", 4, i).withColumn("shard", F.lit(i)) for i in range(4)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("doc_id", "shard", F.substring("digest", 1, 1).alias("prefix"))


@query("SELECT doc_id, digest FROM (SELECT doc_id, md5(text) AS digest FROM documents) WHERE digest LIKE '7%'")
def flt11_prefix(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"))
    return filters.with_prefix(docs, "digest", 1, "7")


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def prj1_attach_labels(spark, sf):
    return joins.with_lookup(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@query("""SELECT page_id, CASE WHEN url LIKE '%.html' THEN url ELSE url || '.html' END AS path,
  string_split(string_split(url, '/')[-1], '.')[1] AS stem FROM pages""")
def prj2_suffix_and_stem(spark, sf):
    return table(spark, sf, "pages").select("page_id", with_suffix("url", ".html").alias("path"), id_from_path("url").alias("stem"))


@query("SELECT doc_id, 'store/' || substr(md5(text), 1, 2) || '.zip' AS archive FROM documents")
def prj3_attach_archive(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"))
    archives = docs.select(F.concat(F.lit("store/"), F.substring("digest", 1, 2), F.lit(".zip")).alias("archive")).distinct()
    return filters.attach_archive(docs, "digest", archives, 2, check=True).select("doc_id", "archive")


@query("SELECT doc_id, lang AS raw_lang, n_chars AS raw_n_chars FROM documents")
def prj4_view_prefix(spark, sf):
    return filters.with_view_prefix(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "raw", keep=["doc_id"])


@query("""SELECT doc_id, md5(unhex(substr(hex(encode(text)), 1, 2000))) AS head, CAST(strlen(text) AS BIGINT) AS size,
  CAST(least(strlen(text), 1000) AS BIGINT) AS length FROM documents""")
def prj5_sample_meta(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", *filters.sample_meta("text", 1000)).select("doc_id", F.md5("bytes").alias("head"), "size", "length")


@query("""SELECT round(avg(l_extendedprice), 4) AS objective, l_returnflag AS flag, l_linestatus AS status
  FROM lineitem GROUP BY ALL""")
def prj6_tuning_table(spark, sf):
    runs = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("config/flag"), F.col("l_linestatus").alias("config/status"))
        .agg(F.round(F.avg("l_extendedprice"), 4).alias("objective"), F.count(F.lit(1)).alias("iterations"))
    )
    return filters.tuning_table(runs, "objective")


@query("SELECT d.doc_id, d.lang, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def j1_inner_labels(spark, sf):
    docs, marks = table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id", "toxic")
    return joins.with_labels(docs, marks, "doc_id")


@query("""SELECT o.o_orderkey, c.c_mktsegment, e.event_type FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN events e ON e.event_id = o.o_orderkey""")
def j2_left_lookups(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    segments = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    kinds = table(spark, sf, "events").select(F.col("event_id").alias("o_orderkey"), "event_type")
    return joins.with_lookup(joins.with_lookup(orders, segments, "c_custkey"), kinds, "o_orderkey").drop("c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j3_semi_join(spark, sf):
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return filters.keep_ids(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), returned, "o_orderkey")


@query("""SELECT o_orderkey, 'all' AS part FROM orders WHERE o_orderkey NOT IN
    (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 3)
  UNION ALL SELECT o_orderkey, 'any' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def j4_pending_ids(spark, sf):
    ids = table(spark, sf, "orders").select("o_orderkey")
    runs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return tagged_union(
        {
            "all": joins.pending(ids, joins.completed(runs, "o_orderkey", "l_returnflag", "ANR"), "o_orderkey"),
            "any": joins.pending(ids, joins.completed(runs, "o_orderkey", "l_returnflag", "ANR", False), "o_orderkey"),
        }
    )


MAJORITY = """m AS (SELECT digest, lang FROM (SELECT digest, lang, row_number() OVER
    (PARTITION BY digest ORDER BY count(*) DESC, lang) AS rn FROM (SELECT md5(text) AS digest, lang FROM documents)
    GROUP BY digest, lang) WHERE rn = 1)"""


@query(f"WITH {MAJORITY} SELECT d.doc_id, m.lang AS label FROM documents d JOIN m ON m.digest = md5(d.text)")
def j5_label_via_digest(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"), "lang")
    table_ = majority_label(docs, "digest", "lang").select("digest", F.col("lang").alias("label"))
    return joins.label_via_digest(docs.select("doc_id", "digest"), table_, "digest").select("doc_id", "label")


@query("""SELECT doc_id, lang AS labels, md5(text) AS raw_digest, md5(upper(lang) || text) AS dis_digest,
  n_chars AS dec_size FROM documents""")
def j6_merge_views(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("lang", "labels")
    views = {
        "raw": docs.select("doc_id", "labels", F.md5("text").alias("digest")),
        "dis": docs.select("doc_id", "labels", F.md5(F.concat(F.upper("labels"), "text")).alias("digest")),
        "dec": docs.select("doc_id", "labels", F.col("n_chars").alias("size")),
    }
    return joins.merge_views(views, "doc_id", "labels", check=True)


@query("""SELECT 'raw-dis' AS views, count(*) FILTER (quality <> 1) AS n_lone, count(*) FILTER (quality = 1 AND toxic <> 1) AS n_label,
    count(*) FILTER (quality <> 1 OR toxic <> 1) AS n_mismatch FROM labels""")
def j6_view_mismatches(spark, sf):
    marks = table(spark, sf, "labels")
    views = {
        "raw": marks.select("doc_id", F.col("quality").alias("label")),
        "dis": marks.where("quality = 1").select("doc_id", F.col("toxic").alias("label")),
    }
    return joins.view_mismatches(views, "doc_id", "label")


@query("""SELECT s.doc_id, s.quality, d.n_chars, d.lang FROM labels s JOIN documents d USING (doc_id)""")
def j7_feature_join(spark, sf):
    split = table(spark, sf, "labels").select("doc_id", "quality")
    return joins.with_features(split, table(spark, sf, "documents").select("doc_id", "n_chars", "lang"), "doc_id")


@query("""SELECT doc_id, coalesce(l.toxic, l.quality, CAST(length(d.lang) AS INT)) AS value FROM documents d LEFT JOIN labels l USING (doc_id)""")
def j8_override_union(spark, sf):
    marks = table(spark, sf, "labels")
    maps = [
        table(spark, sf, "documents").select("doc_id", F.length("lang").alias("value")),
        marks.where("quality is not null").select("doc_id", F.col("quality").alias("value")),
        marks.where("toxic is not null").select("doc_id", F.col("toxic").alias("value")),
    ]
    return joins.override_union(maps, "doc_id", "value")


@query("""WITH g AS (SELECT * FROM (VALUES (0, 500), (500, 2000), (2000, 1000000)) p(lo, hi), (VALUES ('en'), ('fr')) l(wanted), (VALUES (0), (1)) q(side))
  SELECT g.lo, g.hi, g.wanted, g.side, count(d.doc_id) AS n FROM g LEFT JOIN documents d
    ON d.n_chars BETWEEN g.lo AND g.hi AND d.lang = g.wanted AND CAST(substr(d.source, 4) AS INT) % 2 = g.side GROUP BY ALL""")
def j9_parameter_grid(spark, sf):
    """Samples that each combination of options would keep; the table is reduced to counts first."""
    docs = table(spark, sf, "documents")
    counts = docs.groupBy("lang", "n_chars", F.expr("cast(substr(source, 4) AS int) % 2").alias("own")).agg(F.count(F.lit(1)).alias("_n"))
    grid = joins.with_options(joins.with_size_options(counts, [0, 500, 2000], [500, 2000, 1000000]), {"wanted": ["en", "fr"], "side": [0, 1]})
    hit = F.col("n_chars").between(F.col("lo"), F.col("hi")) & (F.col("lang") == F.col("wanted")) & (F.col("own") == F.col("side"))
    return grid.groupBy("lo", "hi", "wanted", "side").agg(F.sum(F.when(hit, F.col("_n")).otherwise(0)).cast("bigint").alias("n"))
