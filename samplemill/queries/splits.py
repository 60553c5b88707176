"""De-duplication, sampling, balancing and splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from samplemill.functions.tokens import chunk_index
from samplemill.operators import balance, dedup, splits, stats
from samplemill.operators.blocks import packed_blocks
from samplemill.operators.filters import first_of
from samplemill.operators.sections import clamped_sections, section_bounds, section_content
from samplemill.plans import recipes
from samplemill.plans.session import cut
from samplemill.plans.staged import side_by_side
from samplemill.queries.inputs import (
    DOC_LABELS,
    ORDER_SAMPLES,
    RANGES,
    SAMPLES,
    doc_labels,
    h,
    joined,
    order_samples,
    ranges,
    samples,
    table,
    texts,
)
from samplemill.queries.registry import query

UNIQUE = f"""{SAMPLES}, {RANGES},
  kept AS (SELECT s.* FROM samples s JOIN ranges r USING (ds_ord) WHERE s.ts BETWEEN r.valid_lo AND r.valid_hi),
  pure AS (SELECT digest FROM kept GROUP BY digest HAVING min(polarity) = max(polarity)),
  uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY ds_ord, ts, doc_id) AS rn
    FROM kept WHERE digest IN (SELECT digest FROM pure)) WHERE rn = 1)"""


def temporal_sql(source: str, ts: str, tr_share: float) -> str:
    """Boundary time of the absolute split over ``source``, as CTEs ending in ``cutoff(t)``."""
    return f"""sized AS (SELECT CAST(floor(count(*) * CAST({tr_share} AS DOUBLE)) AS BIGINT) AS k, count(*) AS n FROM {source}),
  byt AS (SELECT {ts} AS t, count(*) AS c FROM {source} GROUP BY 1),
  cum AS (SELECT t, c, sum(c) OVER (ORDER BY t) - c AS lt FROM byt),
  hit AS (SELECT t, lt, c, k FROM cum, sized WHERE lt <= k AND k < lt + c),
  cutoff AS (SELECT CASE WHEN k = lt OR k - lt < lt + c - k - 1 THEN t
    ELSE coalesce((SELECT min(t) FROM byt WHERE byt.t > hit.t), t + 1) END AS t FROM hit)"""


DETECTION_SQL = f"""WITH {UNIQUE},
  top AS (SELECT lang FROM (SELECT lang, count(*) AS n FROM uniq GROUP BY lang ORDER BY n DESC, lang LIMIT 3)),
  src AS (SELECT * FROM uniq WHERE lang IN (SELECT lang FROM top)), {temporal_sql('src', 'ts', 0.8)}
  SELECT lang, CASE WHEN ts < (SELECT t FROM cutoff) THEN 'tr' ELSE 'vl' END AS split, count(*) AS n FROM src GROUP BY ALL"""


@query(DETECTION_SQL)
def e1_detection_corpus(spark, sf):
    """The whole detection corpus, as class distribution per split."""
    corpus = recipes.detection_corpus(samples(spark, sf), ranges(spark, sf), top_k=3)
    return stats.class_distribution(corpus, "lang", "split")


BIASED = f"""targets AS (SELECT nmin, nmaj,
    CASE WHEN nmin / (nmin + nmaj) > 0.3 THEN CAST(trunc(CAST(0.3 AS DOUBLE) * nmaj / (1 - CAST(0.3 AS DOUBLE))) AS BIGINT) ELSE nmin END AS kmin,
    CASE WHEN nmin / (nmin + nmaj) < 0.3 THEN CAST(trunc(nmin * (1 - CAST(0.3 AS DOUBLE)) / CAST(0.3 AS DOUBLE)) AS BIGINT) ELSE nmaj END AS kmaj
    FROM (SELECT CAST(count(*) FILTER (polarity = 1) AS DOUBLE) AS nmin, CAST(count(*) FILTER (polarity = 0) AS DOUBLE) AS nmaj FROM base)),
  biased AS (SELECT doc_id, polarity FROM (SELECT doc_id, polarity, row_number() OVER (PARTITION BY polarity ORDER BY {h('doc_id')}, doc_id) AS rn
    FROM base) WHERE rn <= (SELECT CASE WHEN polarity = 1 THEN kmin ELSE kmaj END FROM targets))"""


@query(f"""WITH {UNIQUE}, base AS (SELECT * FROM uniq), {BIASED}, bs AS (SELECT u.* FROM uniq u JOIN biased USING (doc_id)),
  {temporal_sql('bs', 'ts', 0.75)}
  SELECT doc_id, polarity, CASE WHEN ts < (SELECT t FROM cutoff) THEN 'tr' ELSE 'vl' END AS split FROM bs""")
def e1_biased_corpus(spark, sf):
    corpus = recipes.detection_corpus(samples(spark, sf), ranges(spark, sf), sizes=(0.75, 0.25, 0.0), ratio_before=0.3)
    return corpus.select("doc_id", "polarity", "split")


UNIQUE_UNKNOWN = UNIQUE.replace(
    "JOIN ranges r USING (ds_ord) WHERE",
    "JOIN ranges r USING (ds_ord) LEFT JOIN labels l ON l.doc_id = s.doc_id WHERE l.quality IS NULL AND s.n_chars BETWEEN 200 AND 20000 AND",
)


def packed_flags(spark, sf):
    return table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("is_packed"))


@query(f"""WITH {UNIQUE_UNKNOWN},
  top AS (SELECT lang, count(*) AS n FROM uniq GROUP BY lang ORDER BY n DESC, lang LIMIT 3),
  frequent AS (SELECT * FROM uniq WHERE lang IN (SELECT lang FROM top WHERE n >= 4)),
  c AS (SELECT lang, count(*) AS n FROM frequent GROUP BY lang),
  r AS (SELECT f.doc_id, f.lang, f.ts, c.n, row_number() OVER (PARTITION BY f.lang ORDER BY f.ts, {h('f.doc_id')}, f.doc_id) AS place FROM frequent f JOIN c USING (lang)),
  src AS (SELECT doc_id, lang, ts FROM r WHERE place > n - floor(2.0 * (SELECT min(n) FROM c))), {temporal_sql('src', 'ts', 0.7)},
  ids AS (SELECT lang, CAST(row_number() OVER (ORDER BY count(*) DESC, lang) - 1 AS INT) AS label_id FROM src GROUP BY lang)
  SELECT doc_id, lang, label_id, CASE WHEN ts < (SELECT t FROM cutoff) THEN 'tr' ELSE 'vl' END AS split FROM src JOIN ids USING (lang)""")
def e1_full_corpus(spark, sf):
    """Time, packing state, size, copies, class frequency, class cap, temporal split, label ids."""
    corpus = recipes.detection_corpus(
        samples(spark, sf), ranges(spark, sf), packed=packed_flags(spark, sf), packing="unk", sizes_from_to=(200, 20000),
        top_k=3, min_freq=4, cap=2.0, sizes=(0.7, 0.3, 0.0), ids=True,
    )
    return corpus.select("doc_id", "lang", "label_id", "split")


def rebalanced(part: str) -> str:
    """``BIASED`` over one split."""
    return BIASED.replace("targets", f"targets_{part}").replace("biased", f"biased_{part}").replace("base", f"base_{part}")


@query(f"""WITH {UNIQUE}, src AS (SELECT * FROM uniq), {temporal_sql('src', 'ts', 0.75)},
  sp AS (SELECT doc_id, polarity, CASE WHEN ts < (SELECT t FROM cutoff) THEN 'tr' ELSE 'vl' END AS split FROM src),
  base_tr AS (SELECT * FROM sp WHERE split = 'tr'), {rebalanced('tr')}, base_vl AS (SELECT * FROM sp WHERE split = 'vl'), {rebalanced('vl')}
  SELECT doc_id, polarity, 'tr' AS split FROM biased_tr UNION ALL SELECT doc_id, polarity, 'vl' FROM biased_vl""")
def e1_rebalanced_corpus(spark, sf):
    """The class ratio is restored within every split."""
    corpus = recipes.detection_corpus(samples(spark, sf), ranges(spark, sf), sizes=(0.75, 0.25, 0.0), ratio_after=0.3)
    return corpus.select("doc_id", "polarity", "split")


GUARANTEED_TAIL = """classes AS (SELECT count(DISTINCT label) AS c FROM base),
  total AS (SELECT count(*) AS n FROM base),
  sz AS (SELECT floor(n * CAST({a} AS DOUBLE)) AS tr, floor(n * CAST({b} AS DOUBLE)) AS vl, n FROM total),
  ranked AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {h}, id) AS rn FROM base),
  rest AS (SELECT id, row_number() OVER (ORDER BY {h}, id) AS rr FROM ranked WHERE rn > {s} * 3)
  SELECT id AS {id}, label, CASE WHEN rn <= {s} THEN 'tr' WHEN rn <= {s} * 2 THEN 'vl' ELSE 'ts' END AS split FROM ranked WHERE rn <= {s} * 3
  UNION ALL SELECT r.id, k.label, CASE WHEN rr <= (SELECT tr - c * {s} FROM sz, classes) THEN 'tr'
    WHEN rr <= (SELECT tr + vl - 2 * c * {s} FROM sz, classes) THEN 'vl' ELSE 'ts' END FROM rest r JOIN ranked k USING (id)"""


@query(f"""WITH files AS (SELECT d.doc_id, md5(d.text) AS digest, 'q' || l.quality || 't' || l.toxic AS label FROM documents d JOIN labels l USING (doc_id)),
  cnt AS (SELECT digest, label, count(*) AS n, min(doc_id) AS first FROM files GROUP BY ALL),
  base AS (SELECT first AS id, label FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY n DESC, label) AS rn FROM cnt
    WHERE label IN ('q0t0', 'q1t0', 'q1t1')) WHERE rn = 1),
  {GUARANTEED_TAIL.format(a=0.8, b=0.1, s=1, h=h('id'), id='doc_id')}""")
def e2_family_corpus(spark, sf):
    marks = table(spark, sf, "labels")
    named = marks.select("doc_id", F.concat(F.lit("q"), "quality", F.lit("t"), "toxic").alias("label"))
    files = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"))
    return recipes.family_corpus(files, named, ["q0t0", "q1t0", "q1t1"]).select("doc_id", "label", "split")


@query(f"""WITH {SAMPLES} SELECT doc_id, polarity, digest FROM (SELECT *, row_number() OVER
  (PARTITION BY polarity, digest ORDER BY ds_ord, ts, doc_id) AS rn FROM samples) WHERE rn = 1""")
def w1_keep_earliest(spark, sf):
    narrow = samples(spark, sf).select("doc_id", "polarity", "digest", "ds_ord", "ts")
    return dedup.keep_earliest(narrow, "digest", ["ds_ord", "ts", "doc_id"], ["polarity"]).select("doc_id", "polarity", "digest")


@query(f"""WITH {SAMPLES} SELECT doc_id, polarity FROM samples WHERE digest IN
  (SELECT digest FROM samples GROUP BY digest HAVING min(polarity) = max(polarity))""")
def w2_drop_leaks(spark, sf):
    return dedup.drop_leaks(samples(spark, sf).select("doc_id", "polarity", "digest"), "digest", "polarity").select("doc_id", "polarity")


@query(f"WITH {UNIQUE} SELECT doc_id, digest, polarity FROM uniq")
def w2_dedup_across_sides(spark, sf):
    from samplemill.operators.filters import time_window

    kept = time_window(samples(spark, sf), "ts", "ds_ord", ranges(spark, sf))
    return dedup.dedup_across_sides(kept, "digest", "polarity", ["ds_ord", "ts", "doc_id"]).select("doc_id", "digest", "polarity")


@query("""WITH f AS (SELECT doc_id, md5(text) AS digest, lang AS label FROM documents),
  cnt AS (SELECT digest, label, count(*) AS n, min(doc_id) AS doc_id FROM f GROUP BY digest, label)
  SELECT doc_id, digest, label FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY n DESC, label) AS rn FROM cnt) WHERE rn = 1""")
def w3_keep_majority(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"), F.col("lang").alias("label"))
    return dedup.keep_majority(docs, "digest", "label", "doc_id")


@query("""WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000000 AS ts FROM events)
  SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM e) WHERE rn = 1""")
def w4_unique_by_id(spark, sf):
    from samplemill.queries.inputs import epoch

    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", epoch("ts").alias("ts"))
    return dedup.unique_by_id(events, "user_id", ["ts", "event_id"]).drop("ts")


@query(f"""WITH {SAMPLES} SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, doc_id) AS rn FROM samples)
  WHERE rn <= 5""")
def w5_first_per_class(spark, sf):
    return first_of(samples(spark, sf).select("doc_id", "source", "ts"), "source", ["ts", "doc_id"], 5).drop("ts")


@query(f"""WITH {SAMPLES}, r AS (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY ts, doc_id) AS a,
    row_number() OVER (PARTITION BY source ORDER BY ts DESC, doc_id DESC) AS z FROM samples)
  SELECT doc_id, source, CASE WHEN a <= 5 THEN 'tr' ELSE 'vl' END AS split FROM r
  WHERE n >= 6 AND (a <= 5 OR (z <= 10 AND z <= n - 5))""")
def w6_few_shot_split(spark, sf):
    narrow = samples(spark, sf).select("doc_id", "source", "ts")
    return splits.few_shot_split(narrow, "doc_id", "source", "ts", 5, 10).drop("ts")


@query()
def w7_labels_per_class(spark, sf):
    return splits.labels_per_class(doc_labels(spark, sf), "doc_id", "labels", 20).select("doc_id", joined("labels").alias("labels"))


@query(f"""WITH {DOC_LABELS}, n AS (SELECT label, least(count(*), 20) AS need FROM flat GROUP BY label)
  SELECT sum(need) AS most, TRUE AS few FROM n""")
def w7_per_class_bound(spark, sf):
    """No more samples are chosen than the labels need in all; a sample serves all its labels."""
    all_rows = doc_labels(spark, sf)
    need = stats.class_distribution(all_rows.select("labels"), "labels")
    most = need.agg(F.sum(F.least("n", F.lit(20).cast("bigint")))).first()[0]
    chosen = splits.labels_per_class(all_rows, "doc_id", "labels", 20)
    return chosen.agg(F.lit(most).alias("most"), (F.count(F.lit(1)) <= most).alias("few"))


@query(f"""WITH {DOC_LABELS} SELECT label, least(count(*), 20) AS need, TRUE AS enough FROM flat GROUP BY label""")
def w7_per_class_invariants(spark, sf):
    """Every label has at least ``min(k, n)`` of the chosen samples."""
    all_rows = doc_labels(spark, sf)
    chosen = splits.labels_per_class(all_rows, "doc_id", "labels", 20)
    need = stats.class_distribution(all_rows.select("labels"), "labels")
    have = stats.class_distribution(chosen.select("labels"), "labels").withColumnRenamed("n", "m")
    return need.join(have, "labels", "left").select(
        F.col("labels").alias("label"),
        F.least("n", F.lit(20).cast("bigint")).alias("need"),
        (F.coalesce("m", F.lit(0)) >= F.least("n", F.lit(20))).alias("enough"),
    )


@query(f"""WITH {DOC_LABELS} SELECT count(DISTINCT label) AS n_labels, TRUE AS all_needed FROM flat""")
def w7_per_class_minimal(spark, sf):
    """Without any one of the chosen samples, some label would have too few."""
    all_rows = doc_labels(spark, sf)
    chosen = cut(splits.labels_per_class(all_rows, "doc_id", "labels", 20), "chosen")
    need = stats.class_distribution(all_rows.select("labels"), "labels").select("labels", F.least("n", F.lit(20).cast("bigint")).alias("need"))
    have = stats.class_distribution(chosen.select("labels"), "labels").withColumnRenamed("n", "m")
    tight = need.join(have, "labels", "left").select("labels", (F.col("m") <= F.col("need")).alias("tight"))
    each = chosen.select("doc_id", F.explode("labels").alias("labels")).join(tight, "labels").groupBy("doc_id").agg(F.bool_or("tight").alias("needed"))
    return side_by_side(tight.agg(F.count(F.lit(1)).alias("n_labels")), each.agg(F.bool_and("needed").alias("all_needed")))


def rank_sql(id_sql: str, name: str) -> str:
    return f"row_number() OVER (ORDER BY {h(id_sql)}, {id_sql}) AS {name}"


@query(f"""WITH r AS (SELECT doc_id, {rank_sql('doc_id', 'rn')}, count(*) OVER () AS n FROM documents),
  z AS (SELECT *, floor(n * CAST(0.7 AS DOUBLE)) AS tr, floor(n * CAST(0.2 AS DOUBLE)) AS vl FROM r)
  SELECT doc_id, CASE WHEN rn <= tr THEN 'tr' WHEN rn <= tr + vl THEN 'vl' ELSE 'ts' END AS split FROM z""")
def w9_random_split(spark, sf):
    return splits.random_split(table(spark, sf, "documents").select("doc_id"), "doc_id", (0.7, 0.2, 0.1))


@query(f"""WITH r AS (SELECT o_orderkey, {rank_sql('o_orderkey', 'rn')}, count(*) OVER () AS n FROM orders)
  SELECT o_orderkey, CASE WHEN rn <= n - 1000 THEN 'tr' ELSE 'vl' END AS split FROM r""")
def w9_pretraining_split(spark, sf):
    return splits.random_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", (-1, 1000, 0))


@query(f"""WITH base AS (SELECT doc_id AS id, lang AS label FROM documents),
  {GUARANTEED_TAIL.format(a=0.8, b=0.1, s=4, h=h('id'), id='doc_id')}""")
def w10_guaranteed_split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label"))
    return splits.guaranteed_split(docs, "doc_id", "label", (0.8, 0.1, 0.1), 4)


def quota_sql(source: str, label: str, ratios: tuple[int, int, int]) -> str:
    """One by one apportionment in whole numbers as a recursive CTE ``quota(label, n, tr, vl, ts)``."""

    def behind(i: int, x: str) -> str:
        return f"(CASE WHEN tr + vl + ts = 0 THEN {ratios[i]} ELSE {ratios[i]} * (tr + vl + ts) - {sum(ratios)} * {x} END)"

    a, b, c = behind(0, "tr"), behind(1, "vl"), behind(2, "ts")
    first, second = f"({a} >= {b} AND {a} >= {c})", f"({b} >= {a} AND {b} >= {c})"
    return f"""fold AS (
    SELECT {label} AS label, CAST(count(*) AS BIGINT) AS n, 0::BIGINT AS tr, 0::BIGINT AS vl, 0::BIGINT AS ts FROM {source} GROUP BY 1
    UNION ALL SELECT label, n, CASE WHEN {first} THEN tr + 1 ELSE tr END,
      CASE WHEN NOT {first} AND {second} THEN vl + 1 ELSE vl END,
      CASE WHEN NOT {first} AND NOT {second} THEN ts + 1 ELSE ts END FROM fold WHERE tr + vl + ts < n),
  quota AS (SELECT label, n, tr, vl, ts FROM fold WHERE tr + vl + ts = n)"""


@query(f"""WITH RECURSIVE {quota_sql('documents', 'lang', (6, 2, 2))} SELECT * FROM quota""")
def w11_class_quotas(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("lang").alias("label"))
    return splits.class_quotas(docs, "label", (0.6, 0.2, 0.2))


@query(f"""WITH RECURSIVE {ORDER_SAMPLES}, {SAMPLES}, {quota_sql('samples', 'lang', (7, 2, 1))},
  r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY ts, {h('doc_id')}, doc_id) AS rn FROM samples)
  SELECT doc_id, lang, CASE WHEN rn <= tr THEN 'tr' WHEN rn <= tr + vl THEN 'vl' ELSE 'ts' END AS split
  FROM r JOIN quota ON label = lang""")
def w12_temporal_class_split(spark, sf):
    narrow = samples(spark, sf).select("doc_id", "lang", "ts")
    return splits.temporal_class_split(narrow, "doc_id", "lang", "ts", (0.7, 0.2, 0.1)).drop("ts")


@query(f"""WITH {ORDER_SAMPLES}, {temporal_sql('order_samples', 'ts', 0.85)}
  SELECT o_orderkey, CASE WHEN ts < (SELECT t FROM cutoff) THEN 'tr' ELSE 'vl' END AS split FROM order_samples""")
def w13_temporal_split(spark, sf):
    return splits.temporal_split(order_samples(spark, sf), "ts", (0.85, 0.15, 0.0), "label").select("o_orderkey", "split")


@query()
def w14_guaranteed_label_split(spark, sf):
    split = splits.guaranteed_label_split(doc_labels(spark, sf), "doc_id", "labels", (0.6, 0.2, 0.2), 4)
    return split.select("doc_id", joined("labels").alias("labels"), "split")


@query(f"""WITH {DOC_LABELS} SELECT label, CAST(count(*) AS BIGINT) AS n, TRUE AS in_all FROM flat GROUP BY label""")
def w14_label_split_invariants(spark, sf):
    """All rows are assigned, and every split has four samples of each label.

    Nine labels may claim four rows each for each of three splits, so the second rule is certain
    for labels with at least 108 samples.
    """
    split = splits.guaranteed_label_split(doc_labels(spark, sf), "doc_id", "labels", (0.6, 0.2, 0.2), 4)
    wide = stats.distribution_table(split.select("split", F.explode("labels").alias("label")), "label")
    return wide.select("label", F.col("n_all").alias("n"), ((F.col("n_all") < 108) | (F.least("n_tr", "n_vl", "n_ts") >= 4)).alias("in_all"))


@query(f"""WITH {ORDER_SAMPLES}, {temporal_sql('order_samples', 'ts', 0.85)},
  s AS (SELECT label, ts, CASE WHEN ts < (SELECT t FROM cutoff) THEN 'tr' ELSE 'vl' END AS split FROM order_samples),
  b AS (SELECT label, min(ts) FILTER (split = 'tr') AS tr_min, max(ts) FILTER (split = 'tr') AS tr_max, min(ts) FILTER (split = 'vl') AS vl_min,
    max(ts) FILTER (split = 'vl') AS vl_max, CAST(NULL AS BIGINT) AS ts_min, CAST(NULL AS BIGINT) AS ts_max FROM s GROUP BY label)
  SELECT *, coalesce(tr_max < vl_min, TRUE) AS ok FROM b""")
def w15_temporal_checks(spark, sf):
    split = splits.temporal_split(order_samples(spark, sf), "ts", (0.85, 0.15, 0.0))
    return splits.temporal_checks(split, "ts", "label")


@query(f"WITH {SAMPLES}, base AS (SELECT * FROM samples), {BIASED} SELECT doc_id, polarity FROM biased")
def w16_spatial_bias(spark, sf):
    return balance.spatial_bias(samples(spark, sf).select("doc_id", "polarity"), "doc_id", "polarity", 1, 0.3)


@query(f"""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT count(*) AS total FROM documents),
  x AS (SELECT lang, n, CAST(trunc(greatest(0, (p * total - n) / (1 - p))) AS BIGINT) AS extra FROM
    (SELECT lang, n, total, CASE lang WHEN 'es' THEN CAST(0.3 AS DOUBLE) WHEN 'de' THEN CAST(0.25 AS DOUBLE) END AS p FROM c, t) WHERE p IS NOT NULL
    UNION ALL SELECT lang, n, 0 FROM c WHERE lang NOT IN ('es', 'de')),
  r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {h('doc_id')}, doc_id) AS rn FROM documents)
  SELECT doc_id, lang, unnest(range(0, extra // n + CASE WHEN rn <= extra % n THEN 1 ELSE 0 END + 1)) AS copy FROM r JOIN x USING (lang)""")
def w17_oversample(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return balance.oversample(docs, "doc_id", "lang", {"es": 0.3, "de": 0.25})


@query(f"SELECT o_orderkey, {rank_sql('o_orderkey', 'position')} FROM orders")
def w18_shuffle(spark, sf):
    return splits.shuffle_positions(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () // 3 AS size FROM orders)
  SELECT o_orderkey, CAST(rn // size AS INT) AS third FROM r WHERE rn // size < 3""")
def w19_thirds(spark, sf):
    return splits.thirds(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", "o_orderkey")


@query("""WITH r AS (SELECT md5(CAST(o_orderkey AS VARCHAR)) AS name, count(*) OVER () // 3 AS size FROM orders),
  n AS (SELECT name, size, row_number() OVER (ORDER BY name) - 1 AS rn FROM r)
  SELECT name, CAST(rn // size AS INT) AS third FROM n WHERE rn // size < 3""")
def w19_thirds_by_name(spark, sf):
    return splits.thirds(table(spark, sf, "orders").select(F.md5(F.col("o_orderkey").cast("string")).alias("name")), "name")


PREFIXED = "concat('corpus-sample-number-', lpad(CAST({0} AS VARCHAR), 12, '0'))"


def prefixed(key: str):
    """Text ids whose first 21 characters are the same."""
    return F.concat(F.lit("corpus-sample-number-"), F.lpad(F.col(key).cast("string"), 12, "0"))


@query(f"""WITH r AS (SELECT {PREFIXED.format('o_orderkey')} AS name, count(*) OVER () // 3 AS size FROM orders),
  n AS (SELECT name, size, row_number() OVER (ORDER BY name) - 1 AS rn FROM r)
  SELECT name, CAST(rn // size AS INT) AS third FROM n WHERE rn // size < 3""")
def w19_thirds_by_prefixed_name(spark, sf):
    return splits.thirds(table(spark, sf, "orders").select(prefixed("o_orderkey").alias("name")), "name")


@query("""WITH w AS (SELECT doc_id, lang, unnest(string_split_regex(lower(text), '\\s+')) AS word, generate_subscripts(string_split_regex(lower(text), '\\s+'), 1) AS pos FROM documents),
  t AS (SELECT lang, length(word) AS tok, row_number() OVER (PARTITION BY lang ORDER BY doc_id, pos) - 1 AS off, count(*) OVER (PARTITION BY lang) AS n FROM w)
  SELECT lang, off // 128 AS block, CAST(count(*) AS BIGINT) AS n, string_agg(tok, ',' ORDER BY off) AS ids FROM t
  WHERE (off // 128 + 1) * 128 <= n GROUP BY lang, off // 128""")
def w20_packed_blocks(spark, sf):
    """Word lengths stand in for token ids; sequences of a language are packed to blocks of 128."""
    docs = texts(spark, sf, "doc_id", "lang", "text").select(
        "doc_id", "lang", F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w)).alias("ids")
    )
    blocks = packed_blocks(docs, "doc_id", "ids", "lang", 128)
    return blocks.select("lang", "block", F.size("input_ids").cast("bigint").alias("n"), joined(F.col("input_ids").cast("array<string>")).alias("ids"))


@query("""WITH w AS (SELECT doc_id, len(string_split_regex(lower(text), '\\s+')) AS n FROM documents)
  SELECT n // 64 AS last_chunk, count(*) AS n_docs FROM (SELECT n - 1 AS n FROM w) GROUP BY 1""")
def w20_chunk_index(spark, sf):
    words = F.split(F.lower("text"), r"\s+")
    docs = texts(spark, sf, "text").select(F.array_max(chunk_index(words, 64)).alias("last_chunk"))
    return docs.groupBy("last_chunk").agg(F.count(F.lit(1)).alias("n_docs"))


def section_table(spark, sf):
    """Line numbers of an order as sections of a file; lines with one number form one section."""
    size = F.when(F.col("l_tax") == 0, F.lit(0)).otherwise(600 + F.col("l_quantity").cast("int") * 20)
    sections = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("ord"))
        .agg(F.max(size).cast("bigint").alias("size"), F.bool_or(F.col("l_linestatus") == "F").alias("is_executable"))
        .withColumn("offset", (1000 * (F.col("ord") - 1)).cast("bigint"))
    )
    length = sections.groupBy("file").agg((1000 * F.max("ord")).cast("bigint").alias("file_length"))
    return sections.join(length, "file")


SECTIONS = """lines AS (SELECT l_orderkey AS file, l_linenumber AS ord, max(CASE WHEN l_tax = 0 THEN 0 ELSE 600 + CAST(trunc(l_quantity) AS INT) * 20 END) AS size,
    bool_or(l_linestatus = 'F') AS ex FROM lineitem GROUP BY ALL),
  sections AS (SELECT file, ord, 1000 * (ord - 1) AS off, size, ex, 1000 * max(ord) OVER (PARTITION BY file) AS flen FROM lines),
  nonempty AS (SELECT *, lead(off) OVER (PARTITION BY file ORDER BY ord) AS nxt FROM sections WHERE size > 0),
  cl AS (SELECT file, ord, off AS lower, least(off + size, flen, coalesce(nxt, flen)) AS upper,
    CASE WHEN off + size > flen THEN 32 ELSE 0 END | CASE WHEN least(off + size, flen) > nxt THEN 64 ELSE 0 END AS code0 FROM nonempty WHERE ex),
  clamped AS (SELECT file, ord, lower, upper, code0 | CASE WHEN lower = upper THEN 128 ELSE 0 END | CASE WHEN lower > upper THEN 256 ELSE 0 END AS code FROM cl)"""


@query(f"""WITH {SECTIONS} SELECT file, ord, CAST(lower AS BIGINT) AS lower, CAST(upper AS BIGINT) AS upper, CAST(code AS INT) AS code FROM clamped""")
def w21_clamped_sections(spark, sf):
    return clamped_sections(section_table(spark, sf))


@query(f"""WITH {SECTIONS}, g AS (SELECT file, bit_or(code) AS code,
    string_agg(lower || '-' || upper, ',' ORDER BY ord) FILTER (lower < upper) AS bounds FROM clamped GROUP BY file),
  f AS (SELECT file, bool_or(size > 0) AS filled, bool_or(ex AND size > 0) AS ex FROM sections GROUP BY file)
  SELECT f.file, coalesce(g.bounds, '') AS bounds,
    CAST(CASE WHEN NOT filled THEN 8 WHEN NOT ex THEN 16 WHEN g.code = 0 THEN 1 ELSE g.code END AS INT) AS code FROM f LEFT JOIN g USING (file)""")
def w21_section_bounds(spark, sf):
    bounds = section_bounds(section_table(spark, sf))
    text = F.transform("bounds", lambda b: F.concat(b["lo"].cast("string"), F.lit("-"), b["hi"].cast("string")))
    return bounds.select("file", joined(text).alias("bounds"), "code")


@query("""WITH w AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n, unnest(range(1, 4)) AS ord FROM documents),
  b AS (SELECT doc_id, h, ord, n * (ord - 1) // 3 AS lo, n * (ord - 1) // 3 + least(n * ord // 3 - n * (ord - 1) // 3, 200 * ord) AS hi FROM w WHERE ord <> 2)
  SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_bytes, md5(string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY ord)) AS digest FROM b GROUP BY doc_id""")
def w21_section_content(spark, sf):
    """The first and the last third of a document as executable regions, cut out of its bytes."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    n = F.octet_length("content").cast("bigint")

    def region(ord_: int) -> Column:
        low, high = F.floor(n * (ord_ - 1) / 3), F.floor(n * ord_ / 3)
        return F.struct(low.cast("bigint").alias("lo"), (low + F.least(high - low, F.lit(200 * ord_))).cast("bigint").alias("hi"))

    cut_out = section_content(docs.withColumn("bounds", F.array(region(1), region(3))))
    return cut_out.select("doc_id", F.octet_length("code_bytes").cast("bigint").alias("n_bytes"), F.md5(F.hex("code_bytes")).alias("digest"))


@query(f"""WITH {DOC_LABELS}, d AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text)),
  f AS (SELECT flat.* FROM flat JOIN d USING (doc_id)),
  top AS (SELECT label, count(*) AS n FROM f GROUP BY label ORDER BY n DESC, label LIMIT 6),
  k AS (SELECT f.* FROM f JOIN top USING (label) WHERE top.n >= 5)
  SELECT label, CAST(count(*) AS BIGINT) AS n, TRUE AS in_all FROM k GROUP BY label""")
def e2_multi_label_corpus(spark, sf):
    """Files without copies and rare labels, and whether every label is in every split as often as it can be sure to be."""
    digests = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"))
    corpus = recipes.multi_label_corpus(digests.join(doc_labels(spark, sf), "doc_id"), 6, 5, per_label=2)
    wide = stats.distribution_table(corpus.select("split", F.explode("labels").alias("label")), "label")
    # Six labels may claim two rows each for each of three splits.
    sure = (F.col("n_all") < 36) | (F.least("n_tr", "n_vl", "n_ts") >= 2)
    return wide.select("label", F.col("n_all").alias("n"), sure.alias("in_all"))


@query(f"""WITH c AS (SELECT source AS label, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1),
  q AS (SELECT label, n, least(greatest(1, floor(n * CAST(0.8 AS DOUBLE))), n - 1) AS a FROM c),
  r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {h('doc_id')}, doc_id) AS rn FROM documents)
  SELECT doc_id, source, CASE WHEN rn <= a THEN 'tr' ELSE 'vl' END AS split FROM r JOIN q ON label = source""")
def w22_stratified_split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return splits.stratified_split(docs, "doc_id", "source", (0.8, 0.2, 0.0))


@query(f"""WITH c AS (SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang HAVING count(*) > 1),
  q AS (SELECT label, n, least(greatest(1, floor(n * CAST(0.7 AS DOUBLE))), n - 2) AS a FROM c),
  q2 AS (SELECT label, a, least(greatest(floor(n * CAST({0.7 + 0.15} AS DOUBLE)), a + 1), n - 1) AS b FROM q),
  r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {h('doc_id')}, doc_id) AS rn FROM documents)
  SELECT doc_id, lang, CASE WHEN rn <= a THEN 'tr' WHEN rn <= b THEN 'vl' ELSE 'ts' END AS split FROM r JOIN q2 ON label = lang""")
def w22_three_way_stratified(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return splits.stratified_split(docs, "doc_id", "lang", (0.7, 0.15, 0.15))


@query(f"""WITH {ORDER_SAMPLES} SELECT o_orderkey, ts, row_number() OVER (ORDER BY ts, {h('o_orderkey')}, o_orderkey) AS rank FROM order_samples""")
def tk6_time_order(spark, sf):
    """Position of every sample in time order, with many samples per time."""
    from samplemill.plans.ordered import ordered_rank

    return ordered_rank(order_samples(spark, sf).select("o_orderkey", "ts"), "ts", "o_orderkey")


@query(f"""SELECT l_orderkey, l_linenumber, name, row_number() OVER (ORDER BY name, md5('42:' || CAST(1000 * l_orderkey + l_linenumber AS VARCHAR)), 1000 * l_orderkey + l_linenumber) AS rank
  FROM (SELECT *, {PREFIXED.format('l_partkey')} AS name FROM lineitem)""")
def tk6_text_order(spark, sf):
    """Position of every line in the order of a text that many lines share."""
    from samplemill.plans.ordered import ordered_rank

    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", prefixed("l_partkey").alias("name"))
    lines = lines.withColumn("id", 1000 * F.col("l_orderkey") + F.col("l_linenumber"))
    return ordered_rank(lines, "name", "id").drop("id")
