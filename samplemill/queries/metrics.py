"""Evaluation metrics over prediction tables derived from the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from samplemill.functions import scores
from samplemill.operators import metrics
from samplemill.queries.inputs import table
from samplemill.queries.registry import query

CLASSES = 10


def single(spark, sf):
    """Ten-class predictions: the first ten entries of a vector are the logits."""
    logits = F.transform(F.slice("embedding", 1, CLASSES), lambda x: x.cast("double"))
    return metrics.predictions(table(spark, sf, "embeddings").select("vec_id", "label", logits.alias("logits")))


def binary(spark, sf):
    """Binary predictions: two logits, truth is the parity of the label, score is the second probability."""
    logits = F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double"))
    rows = table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 2).alias("label"), logits.alias("logits"))
    return metrics.predictions(rows).withColumn("score", F.get("probs", F.lit(1)))


def multi(spark, sf):
    """Multi-label predictions: entries 1-10 are logits, a positive entry 11-20 is a true label."""
    logits = F.transform(F.slice("embedding", 1, CLASSES), lambda x: x.cast("double"))
    truth = F.transform(F.slice("embedding", CLASSES + 1, CLASSES), lambda x: (x > 0).cast("int"))
    return table(spark, sf, "embeddings").select("vec_id", truth.alias("truth"), logits.alias("logits"))


def rounded(df, *keep):
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in df.columns if c not in keep])


FLAT = f"""z AS (SELECT vec_id, label, unnest(range(0, {CLASSES})) AS cls, CAST(unnest(embedding[1:{CLASSES}]) AS DOUBLE) AS z FROM embeddings),
  e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z),
  p AS (SELECT vec_id, label, cls, z, e / sum(e) OVER (PARTITION BY vec_id) AS prob FROM e),
  s AS (SELECT vec_id, any_value(label) AS label, CAST(arg_max(cls, (z, -cls)) AS INT) AS pred FROM p GROUP BY vec_id)"""

BINARY = """s AS (SELECT vec_id, label % 2 AS label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
  q AS (SELECT vec_id, label, CASE WHEN b > a THEN 1 ELSE 0 END AS pred, exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS score FROM s)"""

CLASS_TABLE = """cl AS (SELECT cls, sum(t) AS t, sum(p) AS p, sum(tp) AS tp FROM (
    SELECT label AS cls, 1 AS t, 0 AS p, CASE WHEN label = pred THEN 1 ELSE 0 END AS tp FROM {0} UNION ALL SELECT pred, 0, 1, 0 FROM {0}) GROUP BY cls),
  sc AS (SELECT cls, CAST(t AS DOUBLE) AS t, CAST(p AS DOUBLE) AS p, CAST(tp AS DOUBLE) AS tp, CASE WHEN p > 0 THEN tp / p ELSE 0 END AS pre, CASE WHEN t > 0 THEN tp / t ELSE 0 END AS rec,
    CASE WHEN t + p > 0 THEN 2.0::DOUBLE * tp / (t + p) ELSE 0 END AS f1, CASE WHEN t + p - tp > 0 THEN tp / (t + p - tp) ELSE 0 END AS jac FROM cl)"""

COMMON = """round(sum(tp) / sum(t), 6) AS acc, round(avg(rec) FILTER (t > 0), 6) AS bac,
  round((sum(tp) * sum(t) - sum(p * t)) / sqrt((sum(t) * sum(t) - sum(p * p)) * (sum(t) * sum(t) - sum(t * t))), 6) AS mcc,
  round(1 - sum(tp) / sum(t), 6) AS ham, round(avg(jac), 6) AS jac, round(CASE WHEN min(rec) > 0 THEN exp(avg(ln(CASE WHEN rec > 0 THEN rec ELSE 1 END))) ELSE 0 END, 6) AS gme"""


@query(f"WITH {FLAT} SELECT p.vec_id, p.cls, round(prob, 6) AS prob, s.pred, round(1 / (1 + exp(-z)), 6) AS sig FROM p JOIN s USING (vec_id)")
def ev1_probabilities(spark, sf):
    rows = single(spark, sf).withColumn("sig", scores.sigmoid("logits"))
    flat = rows.select("vec_id", "pred", F.posexplode(F.arrays_zip("probs", "sig")).alias("cls", "_z"))
    return flat.select("vec_id", "pred", F.col("cls").cast("bigint").alias("cls"), F.round("_z.probs", 6).alias("prob"), F.round("_z.sig", 6).alias("sig"))


@query(f"WITH {FLAT} SELECT label, pred, count(*) AS n FROM s GROUP BY ALL")
def ev2_confusion(spark, sf):
    return metrics.confusion(single(spark, sf))


@query(f"WITH {FLAT} SELECT label, " + ", ".join(f"count(*) FILTER (pred = {c}) AS pred_{c}" for c in range(CLASSES)) + " FROM s GROUP BY label")
def ev2_confusion_table(spark, sf):
    return metrics.confusion_table(single(spark, sf), range(CLASSES))


@query(f"WITH {FLAT}, {CLASS_TABLE.format('s')} SELECT {COMMON}, round(avg(pre), 6) AS pre, round(avg(rec), 6) AS rec, round(avg(f1), 6) AS f_1 FROM sc")
def ev3_to_ev8_multiclass(spark, sf):
    """Accuracy, balanced accuracy, correlation, Hamming loss, precision, recall, F1, Jaccard, geometric mean."""
    return rounded(metrics.single_label_report(single(spark, sf)))


@query(f"""WITH {BINARY}, {CLASS_TABLE.format('q')} SELECT {COMMON}, round(max(pre) FILTER (cls = 1), 6) AS pre, round(max(rec) FILTER (cls = 1), 6) AS rec,
  round(max(f1) FILTER (cls = 1), 6) AS f_1 FROM sc""")
def ev3_to_ev8_binary(spark, sf):
    return rounded(metrics.single_label_report(binary(spark, sf), positive=1))


RANKS = """r AS (SELECT *, rank() OVER (PARTITION BY cls ORDER BY score) + (count(*) OVER (PARTITION BY cls, score) - 1) / 2 AS rk FROM sco),
  auc AS (SELECT cls, (sum(rk) FILTER (t = 1) - count(*) FILTER (t = 1) * (count(*) FILTER (t = 1) + 1) / 2)
    / (CAST(count(*) FILTER (t = 1) AS DOUBLE) * count(*) FILTER (t = 0)) AS roc FROM r GROUP BY cls),
  th AS (SELECT cls, score, CAST(sum(t) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n FROM sco GROUP BY cls, score),
  cu AS (SELECT cls, pos, sum(pos) OVER w AS hits, sum(n) OVER w AS shown, sum(pos) OVER (PARTITION BY cls) AS total FROM th
    WINDOW w AS (PARTITION BY cls ORDER BY score DESC)),
  ap AS (SELECT cls, sum(pos / total * (hits / shown)) AS avp FROM cu GROUP BY cls)"""


@query(f"WITH {BINARY}, sco AS (SELECT 0 AS cls, score, label AS t FROM q), {RANKS} SELECT round(roc, 6) AS roc, round(avp, 6) AS avp FROM auc JOIN ap USING (cls)")
def ev9_ev10_binary(spark, sf):
    return rounded(metrics.ranking_scores(binary(spark, sf), "score", F.col("label") == 1))


@query(f"""WITH {FLAT}, sco AS (SELECT cls, prob AS score, CASE WHEN label = cls THEN 1 ELSE 0 END AS t FROM p), {RANKS}
  SELECT CAST(cls AS INT) AS cls, round(roc, 6) AS roc, round(avp, 6) AS avp FROM auc JOIN ap USING (cls)""")
def ev9_one_vs_rest(spark, sf):
    return rounded(metrics.one_vs_rest(single(spark, sf)), "cls")


@query(f"WITH {FLAT}, sco AS (SELECT cls, prob AS score, CASE WHEN label = cls THEN 1 ELSE 0 END AS t FROM p), {RANKS} SELECT round(avg(roc), 6) AS roc FROM auc")
def ev9_macro_auc(spark, sf):
    return rounded(metrics.macro_auc(single(spark, sf)))


@query("""WITH b AS (SELECT event_type, CAST(floor(value / 5) AS INT) AS score, user_id % 2 AS t FROM events),
  sco AS (SELECT event_type AS cls, score, t FROM b), """ + RANKS + """
  SELECT cls AS event_type, round(roc, 6) AS roc, round(avp, 6) AS avp FROM auc JOIN ap USING (cls)""")
def ev9_ev10_ties(spark, sf):
    """Coarse scores: nearly every score is shared by many rows."""
    rows = table(spark, sf, "events").select("event_type", F.floor(F.col("value") / 5).cast("int").alias("score"), (F.col("user_id") % 2 == 1).alias("t"))
    return rounded(metrics.ranking_scores(rows, "score", F.col("t"), ["event_type"]), "event_type")


MULTI = f"""m AS (SELECT vec_id, unnest(range(0, {CLASSES})) AS cls, 1 / (1 + exp(-CAST(unnest(embedding[1:{CLASSES}]) AS DOUBLE))) AS score,
    CASE WHEN unnest(embedding[{CLASSES + 1}:{2 * CLASSES}]) > 0 THEN 1 ELSE 0 END AS t FROM embeddings),
  pr AS (SELECT *, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS pred FROM m),
  rows_ AS (SELECT vec_id, bool_and(t = pred) AS same, sum(CASE WHEN t <> pred THEN 1 ELSE 0 END) AS wrong, sum(t) AS nt, count(*) AS nc, min(score) FILTER (t = 1) AS least FROM pr GROUP BY vec_id),
  pairs AS (SELECT a.vec_id, a.t, a.cls, count(*) FILTER (b.score >= a.score) AS above, count(*) FILTER (b.score >= a.score AND b.t = 1) AS above_true,
    count(*) FILTER (b.score >= a.score AND b.t = 0) AS above_false FROM m a JOIN m b USING (vec_id) GROUP BY a.vec_id, a.t, a.cls),
  per AS (SELECT r.vec_id, same, wrong, nc, CASE WHEN nt = 0 THEN 0 ELSE (SELECT count(*) FROM m WHERE m.vec_id = r.vec_id AND score >= least) END AS coe,
    CASE WHEN nt IN (0, nc) THEN 1 ELSE (SELECT avg(above_true / above) FROM pairs WHERE pairs.vec_id = r.vec_id AND t = 1) END AS lra,
    CASE WHEN nt IN (0, nc) THEN 0 ELSE (SELECT sum(above_false) / (r.nt * (r.nc - r.nt)) FROM pairs WHERE pairs.vec_id = r.vec_id AND t = 1) END AS lrl FROM rows_ r),
  ct AS (SELECT cls, CAST(sum(t) AS DOUBLE) AS t, CAST(sum(pred) AS DOUBLE) AS p, CAST(sum(t * pred) AS DOUBLE) AS tp FROM pr GROUP BY cls),
  cs AS (SELECT CASE WHEN p > 0 THEN tp / p ELSE 0 END AS pre, CASE WHEN t > 0 THEN tp / t ELSE 0 END AS rec, CASE WHEN t + p > 0 THEN 2 * tp / (t + p) ELSE 0 END AS f1,
    CASE WHEN t + p - tp > 0 THEN tp / (t + p - tp) ELSE 0 END AS jac FROM ct),
  sco AS (SELECT cls, score, t FROM m), {RANKS}"""


@query(f"""WITH {MULTI} SELECT round(avg(CASE WHEN same THEN 1 ELSE 0 END), 6) AS acc, round(sum(wrong) / sum(nc), 6) AS ham, round(avg(coe), 6) AS coe, round(avg(lra), 6) AS lra, round(avg(lrl), 6) AS lrl,
  (SELECT round(avg(pre), 6) FROM cs) AS pre, (SELECT round(avg(rec), 6) FROM cs) AS rec, (SELECT round(avg(f1), 6) FROM cs) AS f_1, (SELECT round(avg(jac), 6) FROM cs) AS jac,
  (SELECT round(CASE WHEN min(rec) > 0 THEN exp(avg(ln(CASE WHEN rec > 0 THEN rec ELSE 1 END))) ELSE 0 END, 6) FROM cs) AS gme, (SELECT round(avg(roc), 6) FROM auc) AS roc, (SELECT round(avg(avp), 6) FROM ap) AS avp FROM per""")
def ev11_to_ev14_multi_label(spark, sf):
    """All multi-label metrics, the ranking ones included."""
    return rounded(metrics.multi_label_report(multi(spark, sf), "truth", "logits"))


def language(spark, sf):
    """Token predictions: label 0 stands for an ignored position, the log probability is that of the label."""
    rows = single(spark, sf).withColumn("log_p", scores.log_softmax_at("logits", "label"))
    return rows.select("vec_id", F.when(F.col("label") == 0, F.lit(metrics.IGNORED)).otherwise(F.col("label")).alias("label"), "log_p")


LANGUAGE = f"""{FLAT}, t AS (SELECT vec_id, CASE WHEN label = 0 THEN -100 ELSE label END AS label, ln(prob) AS log_p FROM p WHERE cls = label)"""


@query(f"WITH {LANGUAGE} SELECT round(exp(-avg(log_p)), 6) AS ppl FROM t WHERE label <> -100")
def ev15_perplexity(spark, sf):
    return rounded(metrics.perplexity(language(spark, sf), "log_p", "label"))


@query(f"""WITH {LANGUAGE}, u AS (SELECT label, count(*) / (SELECT count(*) FROM t WHERE label <> -100) AS p FROM t WHERE label <> -100 GROUP BY label),
  s AS (SELECT avg(ln(greatest(p, 1e-10))) AS scale FROM t JOIN u USING (label)), l AS (SELECT avg(-log_p) AS loss FROM t)
  SELECT round(loss, 6) AS ext_loss, round(exp(loss), 6) AS ppl, round(exp(loss) * exp(scale), 6) AS nppl FROM l, s""".replace("), s AS (SELECT avg", "), sca AS (SELECT avg").replace("  s AS (SELECT avg", "  sca AS (SELECT avg").replace("FROM l, s", "FROM l, sca"))
def ev16_language_model_report(spark, sf):
    rows = language(spark, sf).withColumn("loss", -F.col("log_p"))
    known = rows.where(F.col("label") != metrics.IGNORED)
    counts = known.groupBy(F.col("label").alias("token_id")).agg(F.count(F.lit(1)).alias("n"))
    from samplemill.operators.encoding import probabilities

    unigrams = probabilities(counts, "n").withColumnRenamed("share", "p")
    return rounded(metrics.language_model_report(rows, "loss", "label", unigrams))


@query(f"""WITH {BINARY}, sco AS (SELECT 0 AS cls, score, label AS t FROM q), {RANKS}
  SELECT (SELECT round(avg(CASE WHEN (label = 1) = (score > 0.5) THEN 1 ELSE 0 END), 6) FROM q) AS acc, (SELECT round(roc, 6) FROM auc) AS roc""")
def ev17_detection(spark, sf):
    return rounded(metrics.detection_metrics(binary(spark, sf), "label", "score"))


@query(f"""WITH {FLAT}, {CLASS_TABLE.format('s')}, a AS (SELECT {COMMON} FROM sc) SELECT mcc, bac FROM a""")
def ev17_family(spark, sf):
    return rounded(metrics.family_metrics(single(spark, sf)))


@query(f"WITH {MULTI} SELECT (SELECT round(avg(jac), 6) FROM cs) AS jac, (SELECT round(sum(wrong) / sum(nc), 6) FROM rows_) AS ham")
def ev17_behaviour(spark, sf):
    return rounded(metrics.behaviour_metrics(multi(spark, sf), "truth", "logits"))
