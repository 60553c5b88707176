"""The operators of this package over the given tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplemill.llm import conversations, exact, html_text, language, packing, passages, pieces, quality
from samplemill.llm import search, secrets, simhash, templates, token_counts

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query()
def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir))


@query(
    r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
n AS (SELECT doc_id, r, length(t) AS size, regexp_replace(t, '[\x20\x09-\x0D]', '', 'g') AS body FROM d)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
FROM n WINDOW w AS (PARTITION BY body ORDER BY size DESC, doc_id, r)"""
)
def op6_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup_exact(documents(spark, sf_dir)).drop("text_key")


@query(
    r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i+7], ' ') AS g
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY r),
c AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             coalesce(n, 0) AS n_repeat_words
      FROM w LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS bad FROM f WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT avg(bad / n) AS mean, var_pop(bad / n) AS spread FROM h),
p AS (SELECT mean, CASE WHEN coalesce(spread, 0) = 0 THEN 1e6
                        ELSE least(1e6, greatest(1.0, mean * (1 - mean) / spread - 1)) END AS weight FROM m),
rates AS (SELECT source, (bad + weight * mean) / (n + weight) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(rate <= 0.5, true) AS kept, round(rate, 6) AS host_rate
FROM f LEFT JOIN rates USING (source)"""
)
def op5_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


@query()
def op10_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


@query()
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(documents(spark, sf_dir))


@query()
def op9_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir)).drop("ids")


@query()
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


@query()
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_counts(documents(spark, sf_dir))


@query(
    r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls, row_number() OVER () AS r FROM documents),
x AS (SELECT r, pos, regexp_replace(ls[pos], '[\x20\x09\x0B-\x0D]+', ' ', 'g') AS l
      FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS pos FROM d)),
m AS (SELECT r, pos, regexp_replace(trim(l, ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS line FROM x),
k AS (SELECT *, string_split(line, ' ') AS ts FROM m WHERE line <> ''),
leaf AS (SELECT len(ts) AS n, ts[1:3] AS head, count(DISTINCT r) AS all_docs FROM k GROUP BY ALL HAVING count(DISTINCT r) >= 5),
c AS (SELECT k.*, all_docs FROM k JOIN leaf ON n = len(ts) AND head = ts[1:3]),
tok AS (SELECT r, line, ts, all_docs, unnest(range(1, len(ts) + 1)) AS place FROM (SELECT DISTINCT r, line, ts, all_docs FROM c)),
con AS (SELECT len(ts) AS n, ts[1:3] AS head, place, ts[place] AS token FROM tok
        WHERE ts[place] <> '<*>' GROUP BY ALL HAVING count(DISTINCT r) >= greatest(5, ceil(any_value(all_docs) * 10 / 100))),
one AS (SELECT DISTINCT line, ts, all_docs, place FROM tok),
f AS (SELECT line, len(ts) AS n, all_docs, list({'place': place, 'token': ts[place]} ORDER BY place) AS constants
      FROM one JOIN con USING (place) WHERE con.n = len(ts) AND con.head = ts[1:3] AND con.token = ts[place]
      GROUP BY line, ts, all_docs HAVING count(*) >= 3 AND 100 * count(*) >= 50 * len(ts)
         AND 100 * count(*) FILTER (place > 3) >= 50 * len(list_filter(ts[4:], lambda x: x <> '<*>'))),
tem AS (SELECT n, constants FROM c JOIN f USING (line) GROUP BY ALL HAVING count(DISTINCT r) >= greatest(5, ceil(any_value(f.all_docs) * 10 / 100))),
bad AS (SELECT line FROM f JOIN tem USING (n, constants)),
gone AS (SELECT r, list(pos) AS ps FROM c WHERE line IN (SELECT line FROM bad) GROUP BY r)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_dropped,
       sha256(CASE WHEN ps IS NULL THEN text
              ELSE array_to_string([ls[i] FOR i IN range(1, len(ls) + 1) IF NOT list_contains(ps, i)], chr(10)) END) AS text_sha256
FROM d LEFT JOIN gone USING (r)"""
)
def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = templates.drop_recurring_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


@query()
def op4_duplicate_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.duplicate_passages(documents(spark, sf_dir))


@query(
    r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
d AS (SELECT * FROM t WHERE len(ts) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS terms FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, c),
m AS (SELECT r, doc_id, 50 + (50 * len(ts) * docs) // terms AS m FROM d, c),
q AS (SELECT row_number() OVER () AS i, item_id, text FROM benchmark),
i AS (SELECT DISTINCT i, item_id, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM q),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM i JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50"""
)
def op11_term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query(
    r"""
WITH RECURSIVE n AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
h AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], [ascii(x) FOR x IN string_split(name, '')]),
             lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)),
                                      lambda v, _: xor(v >> 1, 3988292384 * (v & 1))))) % 20 AS rule FROM n),
d AS (SELECT conv_id, turn, CASE rule WHEN 4 THEN 'user' ELSE role END AS role,
             CASE rule WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE rule WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE rule <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM d),
k AS (SELECT conv_id, turn, pos, role, text, left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM o),
r AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen THEN 'duplicate'
                     WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM k),
ins AS (SELECT * FROM (VALUES (0, '', 0, []::VARCHAR[]), (1, '', 1, []), (2, '', 2, []), (3, '', 3, []),
          (0, 'I', 2, ['user:']), (1, 'I', 2, ['user:']), (2, 'I', 3, ['assistant:']), (3, 'I', 2, ['user:']),
          (0, 'II', 3, ['user:', 'assistant:']), (1, 'II', 3, ['user:', 'assistant:'])) AS v(p, letters, q, lines)),
act AS (SELECT * FROM (VALUES ('D', 0, 0, 3, ''), ('D', 1, 1, 3, ''), ('D', 2, 2, 3, ''), ('D', 3, 3, 3, ''),
          ('K', 0, 1, 0, 's'), ('K', 0, 2, 0, 'u'), ('K', 1, 2, 0, 'u'), ('K', 3, 2, 0, 'u'), ('K', 2, 3, 0, 'a'),
          ('R', 0, 2, 2, 'user'), ('R', 1, 2, 2, 'user'), ('R', 3, 2, 2, 'user'), ('R', 2, 3, 2, 'assistant')) AS v(letter, q, t, price, who)),
step AS (SELECT conv_id, pos, p, t, letters || letter AS letters,
                2 * len(letters) + price + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS price,
                list_concat(lines, CASE letter WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [who || ':' || text] END) AS lines
         FROM r, ins JOIN act USING (q)
         WHERE (letter = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (letter <> 'K' OR who = initial)),
ids AS (SELECT DISTINCT conv_id FROM n),
best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS st, {'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': []::VARCHAR[]} AS b FROM ids
  UNION ALL
  SELECT s.conv_id, s.pos, s.t, min({'cost': CAST(b.cost + s.price AS BIGINT), 'audit': b.audit || s.letters, 'lines': list_concat(b.lines, s.lines)})
  FROM best JOIN step AS s ON s.conv_id IS NOT DISTINCT FROM best.conv_id AND s.pos = best.pos + 1 AND s.p = best.st
  GROUP BY s.conv_id, s.pos, s.t),
size AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                count(*) FILTER (WHERE fault = 'truncated') AS truncated,
                count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
done AS (SELECT best.conv_id, min({'cost': b.cost + CASE st WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END,
                 'audit': b.audit || CASE st WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
                 'lines': list_concat(b.lines, CASE st WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END)}) AS b
         FROM best LEFT JOIN size ON size.conv_id IS NOT DISTINCT FROM best.conv_id WHERE best.pos = coalesce(n, 0) GROUP BY best.conv_id)
SELECT done.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(b.cost AS BIGINT) AS cost, b.audit AS audit,
       sha256(array_to_string(b.lines, chr(10))) AS repaired_sha256
FROM done LEFT JOIN size ON size.conv_id IS NOT DISTINCT FROM done.conv_id"""
)
def op12_repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    out = conversations.repair(damaged, there="there")
    return out.withColumn("repaired_sha256", F.sha2("repaired", 256)).drop("repaired")


@query()
def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
