"""Decomposition, vocabularies and encoding of the given texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from samplemill.functions import tokens as tk
from samplemill.operators import stats, tokenizer
from samplemill.plans.session import cut
from samplemill.queries.inputs import doc_labels, joined, table, texts
from samplemill.queries.registry import query

MERGES = 40


def words(spark, sf):
    split = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    return texts(spark, sf, "doc_id", "lang", "text").select("doc_id", "lang", split.alias("words"))


WORDS = """w AS (SELECT doc_id, lang, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS words FROM documents),
  f AS (SELECT doc_id, lang, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
  c AS (SELECT word, count(*) AS n FROM f GROUP BY word)"""

VOCAB = """v AS (SELECT word AS token, CAST(row_number() OVER (ORDER BY n DESC, word) + 6 AS INT) AS token_id, n FROM (SELECT * FROM c ORDER BY n DESC, word LIMIT 500)
    UNION ALL SELECT unnest(['<pad>', '<unk>', '<msk>', '<bos>', '<eos>', '<cls>', '<sep>']), unnest([0, 1, 2, 3, 4, 5, 6]), 0)"""


@query("""WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
  w AS (SELECT unnest(regexp_extract_all(h, '.{1,32}')) AS word FROM h)
  SELECT word, count(*) AS n FROM w GROUP BY word""")
def tok1_byte_words(spark, sf):
    """Distinct 16-byte chunks with their counts."""
    docs = texts(spark, sf, "text").select(tk.byte_words("text").alias("words"))
    return tokenizer.word_counts(docs, "words").select(F.hex("word").alias("word"), "n")


@query("""WITH w AS (SELECT unnest(string_split(text, chr(10))) AS word FROM conversations) SELECT word, count(*) AS n FROM w GROUP BY word""")
def tok1_line_words(spark, sf):
    return tokenizer.word_counts(table(spark, sf, "conversations").select(tk.line_words("text").alias("words")), "words")


@query(f"WITH {WORDS} SELECT (SELECT count(*) FROM documents) AS n_documents, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS n_characters FROM f")
def tok2_decomposition_summary(spark, sf):
    return tokenizer.decomposition_summary(words(spark, sf), "words")


@query("""WITH t AS (SELECT unnest(regexp_extract_all(html, '0x|[0-9A-F]|[a-zG-Z_]+|[^a-zA-Z0-9_\\s\\v]')) AS token FROM pages) SELECT token, count(*) AS n FROM t GROUP BY token""")
def tok3_listing_tokens(spark, sf):
    pages = table(spark, sf, "pages").select("html").select(tk.listing_tokens("html").alias("tokens"))
    return tokenizer.word_counts(pages, "tokens").withColumnRenamed("word", "token")


@query(f"WITH {WORDS}, {VOCAB} SELECT * FROM v")
def tok4_word_vocabulary(spark, sf):
    return tokenizer.word_vocabulary(tokenizer.word_counts(words(spark, sf), "words"), 500)


def encoded(spark, sf):
    docs = words(spark, sf)
    vocabulary = cut(tokenizer.word_vocabulary(tokenizer.word_counts(docs, "words"), 500), "vocabulary")
    return tokenizer.encode_words(docs, "words", vocabulary), vocabulary


ENCODED = f"""{WORDS}, {VOCAB}, i AS (SELECT doc_id, lang, pos, coalesce(v.token_id, 1) AS token_id FROM f LEFT JOIN v ON v.token = f.word AND v.token_id > 6)"""


@query(f"WITH {ENCODED} SELECT doc_id, string_agg(token_id, ',' ORDER BY pos) AS ids FROM i GROUP BY doc_id")
def tok5_encode_words(spark, sf):
    return encoded(spark, sf)[0].select("doc_id", joined(F.col("input_ids").cast("array<string>")).alias("ids"))


def alphabet_counts(spark, sf):
    return tokenizer.word_counts(words(spark, sf), "words")


def trained(spark, sf, prefix: str = ""):
    """A vocabulary of the whole alphabet and ``MERGES`` merges."""
    return tokenizer.train_merges(alphabet_counts(spark, sf), max_length=8, prefix=prefix, merges=MERGES)


def merge_table(spark, model):
    rows = [(i, a, b) for i, (a, b) in enumerate(model.merges)]
    return spark.createDataFrame(rows, "rank int, first string, second string")


def merged_sql(prefix: str = "") -> str:
    """Tables of one merge after the other over all distinct words; symbols stand between chr(1) and chr(2)."""
    return f"""{WORDS},
  st AS (SELECT 0 AS rank, word, n, '' AS a, '' AS b, array_to_string(list_transform(regexp_extract_all(word, '(?s).'),
      lambda x, i: chr(1) || CASE WHEN i = 1 THEN '' ELSE '{prefix}' END || x || chr(2)), '') AS s FROM c WHERE word <> ''
    UNION ALL
    SELECT rank + 1, word, n, p.a, p.b, replace(s, chr(1) || p.a || chr(2) || chr(1) || p.b || chr(2), chr(1) || p.a || substr(p.b, {len(prefix) + 1}) || chr(2))
    FROM st, (SELECT a, b FROM (SELECT n, unnest(x[:-2]) AS a, unnest(x[2:]) AS b FROM (SELECT n, string_split(substr(s, 2, length(s) - 2), chr(2) || chr(1)) AS x FROM st))
      WHERE length(a) + length(b) <= {8 + len(prefix)} GROUP BY a, b ORDER BY sum(n) DESC, a, b LIMIT 1) AS p
    WHERE rank < {MERGES}),
  m AS (SELECT DISTINCT rank - 1 AS rank, a AS first, b AS second FROM st WHERE rank > 0)"""


MERGE_IDS = f"""{merged_sql()},
  alphabet AS (SELECT DISTINCT unnest(regexp_extract_all(word, '(?s).')) AS token FROM c),
  ids AS (SELECT token, row_number() OVER (ORDER BY rank, token) + 6 AS token_id
    FROM (SELECT token, -1 AS rank FROM alphabet UNION ALL SELECT first || second, rank FROM m)),
  parts AS (SELECT word, k, token_id FROM (SELECT word, unnest(x) AS token, generate_subscripts(x, 1) AS k
      FROM (SELECT word, string_split(substr(s, 2, length(s) - 2), chr(2) || chr(1)) AS x FROM st WHERE rank = {MERGES})) JOIN ids USING (token)),
  coded AS (SELECT doc_id, count(*) AS n_ids, md5(string_agg(token_id, ',' ORDER BY pos, k)) AS digest FROM f JOIN parts USING (word) GROUP BY doc_id)"""


@query(f"WITH RECURSIVE {merged_sql()} SELECT CAST(rank AS INT) AS rank, first, second FROM m")
def tok6_train_merges(spark, sf):
    return merge_table(spark, trained(spark, sf))


@query(f"""WITH RECURSIVE {MERGE_IDS}
  SELECT doc_id, CAST(coalesce(n_ids, 0) AS INT) AS n_ids, coalesce(digest, md5('')) AS digest FROM w LEFT JOIN coded USING (doc_id)""")
def tok7_apply_merges(spark, sf):
    docs = tokenizer.encode_merges(words(spark, sf), "words", trained(spark, sf))
    return docs.select("doc_id", F.size("input_ids").alias("n_ids"), F.md5(joined(F.col("input_ids").cast("array<string>"))).alias("digest"))


@query(f"WITH RECURSIVE {merged_sql('##')} SELECT CAST(rank AS INT) AS rank, first, second FROM m")
def tok8_continuation_merges(spark, sf):
    return merge_table(spark, trained(spark, sf, "##"))


@query(f"""WITH RECURSIVE {MERGE_IDS}, sizes AS (
    SELECT 'words' AS config, len(words) AS length FROM w
    UNION ALL SELECT 'merges', coalesce(n_ids, 0) FROM w LEFT JOIN coded USING (doc_id)
    UNION ALL SELECT 'bytes', octet_length(encode(text)) FROM documents)
  SELECT config, CAST(length AS INT) AS length, count(*) AS n FROM sizes GROUP BY ALL""")
def tok9_length_sweep(spark, sf):
    """Sequence lengths of the documents under three tokenisers."""
    vocabulary = cut(tokenizer.word_vocabulary(alphabet_counts(spark, sf), 500), "vocabulary")
    split = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    docs = texts(spark, sf, "text").withColumn("words", split)
    docs = tokenizer.encode_words(docs, "words", vocabulary, "word_ids")
    docs = tokenizer.encode_merges(docs, "words", trained(spark, sf), "merge_ids")
    docs = docs.withColumn("byte_ids", tk.byte_ids("text"))
    return tokenizer.length_sweep(docs, {"words": "word_ids", "merges": "merge_ids", "bytes": "byte_ids"})


@query(f"""WITH {ENCODED}, n AS (SELECT doc_id, count(*) AS n FROM i GROUP BY doc_id),
  wins AS (SELECT doc_id, CAST(unnest(range(0, greatest(0, CAST(ceil((n - 64) / 48) AS BIGINT)) + 1)) AS INT) AS win FROM n)
  SELECT wins.doc_id, win, CAST(count(*) AS INT) AS length, CAST(sum(token_id) AS BIGINT) AS total, CAST(sum(token_id * (pos - 48 * win)) AS BIGINT) AS weighted
  FROM wins JOIN i ON i.doc_id = wins.doc_id AND i.pos > 48 * win AND i.pos <= 48 * win + 64 GROUP BY wins.doc_id, win""")
def tok7_overflow_windows(spark, sf):
    """Windows, compared by number, sum and position-weighted sum of their ids."""
    docs, _ = encoded(spark, sf)
    wins = docs.select("doc_id", F.posexplode(tk.windows("input_ids", 64, 16)).alias("win", "_w"))
    zero = F.lit(0).cast("bigint")
    weighted = F.transform("_w", lambda x, i: x.cast("bigint") * (i + 1))
    add = lambda acc, x: acc + x
    return wins.select(
        "doc_id", "win", F.size("_w").alias("length"),
        F.aggregate("_w", zero, add).alias("total"), F.aggregate(weighted, zero, add).alias("weighted"),
    )


@query(f"""WITH {ENCODED}, n AS (SELECT token_id, count(*) AS n FROM i WHERE token_id > 6 GROUP BY token_id)
  SELECT v.token_id, coalesce(n.n, 0) AS n, round(coalesce(n.n, 0) / (SELECT sum(n) FROM n), 9) AS p FROM v LEFT JOIN n USING (token_id) WHERE v.token_id > 6""")
def ag12_unigram_probabilities(spark, sf):
    docs, vocabulary = encoded(spark, sf)
    probs = stats.unigram_probabilities(docs, "input_ids", vocabulary.select("token_id"), list(range(len(tk.SPECIALS))))
    return probs.select("token_id", "n", F.round("p", 9).alias("p"))


@query(f"""WITH {ENCODED}, few AS (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50),
  n AS (SELECT token_id, count(*) AS n FROM i WHERE token_id > 6 AND doc_id IN (SELECT doc_id FROM few) GROUP BY token_id)
  SELECT v.token_id, coalesce(n.n, 0) AS n, round(coalesce(n.n, 0) / (SELECT sum(n) FROM n), 9) AS p FROM v LEFT JOIN n USING (token_id) WHERE v.token_id > 6""")
def ag12_first_samples(spark, sf):
    """The same from the first 50 samples by id."""
    docs, vocabulary = encoded(spark, sf)
    special = list(range(len(tk.SPECIALS)))
    probs = stats.unigram_probabilities(docs, "input_ids", vocabulary.select("token_id"), special, "doc_id", 50)
    return probs.select("token_id", "n", F.round("p", 9).alias("p"))


@query(f"WITH {WORDS}, {VOCAB} SELECT CAST(length(token) AS INT) AS length, count(*) AS n FROM v WHERE token_id > 6 GROUP BY 1")
def ag14_token_lengths(spark, sf):
    vocabulary = tokenizer.word_vocabulary(alphabet_counts(spark, sf), 500)
    return stats.token_length_histogram(vocabulary, "token", F.col("token_id") < len(tk.SPECIALS))


HEXIDS = """b AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents),
  x AS (SELECT doc_id, list_transform(h, lambda v: CAST(('0x' || v)::BIGINT AS INT)) AS ids FROM b)"""


@query(f"""WITH {HEXIDS}, y AS (SELECT doc_id, ids, list_concat(ids, [0, 0, 0]) AS z, len(ids) AS n FROM x),
  v AS (SELECT doc_id, unnest([8, 16, 12]) AS bits, unnest([ids,
    list_transform(range(0, (n + 1) // 2), lambda i: CAST(z[2 * i + 1] + 256 * z[2 * i + 2] AS INT)),
    flatten(list_transform(range(0, (n + 2) // 3), lambda i: [CAST(z[3 * i + 1] * 16 + z[3 * i + 2] // 16 AS INT), CAST(z[3 * i + 2] % 16 * 256 + z[3 * i + 3] AS INT)]))]) AS ids FROM y)
  SELECT doc_id, bits, CAST(len(ids) AS INT) AS n, CAST(list_sum(ids) AS BIGINT) AS total,
    CAST(list_sum(list_transform(ids, lambda x, i: CAST(x AS BIGINT) * i)) AS BIGINT) AS weighted FROM v""")
def sc11_byte_ids(spark, sf):
    """Integers of three widths, compared by number, sum and position-weighted sum."""
    zero = F.lit(0).cast("bigint")
    found = tk.with_byte_ids(texts(spark, sf, "doc_id", "text"), "text")

    def summary(bits: int):
        ids = F.col(f"ids_{bits}")
        total = F.aggregate(ids, zero, lambda acc, x: acc + x)
        weighted = F.aggregate(F.transform(ids, lambda x, i: x.cast("bigint") * (i + 1)), zero, lambda acc, x: acc + x)
        return F.struct(F.lit(bits).alias("bits"), F.size(ids).alias("n"), total.alias("total"), weighted.alias("weighted"))

    return found.select("doc_id", F.explode(F.array(*[summary(w) for w in (8, 16, 12)])).alias("s")).select("doc_id", "s.*")


@query(f"""WITH {HEXIDS} SELECT doc_id, array_to_string(list_concat(list_concat([3], list_transform(ids, lambda v: v + 7))[1:31], [4]), ',') AS ids FROM x""")
def sc12_input_ids(spark, sf):
    """Byte ids past the specials, begin and end marks, 32 ids at most."""
    ids = tk.input_ids(tk.byte_ids("text"), shift=len(tk.SPECIALS), max_length=32, bos=tk.BOS, eos=tk.EOS)
    return texts(spark, sf, "doc_id", "text").select("doc_id", joined(ids.cast("array<string>")).alias("ids"))


@query("""WITH w AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x: CAST(length(x) AS INT)) AS ids FROM conversations)
  SELECT conv_id, turn, array_to_string(list_resize(ids[1:24], 24, 0), ',') AS fixed,
    array_to_string(list_resize(ids, CAST(ceil(len(ids) / 8) * 8 AS BIGINT), 0), ',') AS multiple FROM w""")
def sc13_padding(spark, sf):
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", ids.alias("ids"))
    return rows.select(
        "conv_id", "turn", joined(tk.padded("ids", 24).cast("array<string>")).alias("fixed"),
        joined(tk.padded_to_multiple("ids", 8).cast("array<string>")).alias("multiple"),
    )


@query("""WITH f AS (SELECT doc_id, lang AS label FROM documents
    UNION ALL SELECT doc_id, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END FROM documents
    UNION ALL SELECT doc_id, 'toxic' || toxic FROM labels JOIN documents USING (doc_id)),
  i AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS label_id FROM f GROUP BY label),
  g AS (SELECT doc_id, list(label_id) AS ids FROM f JOIN i USING (label) GROUP BY doc_id)
  SELECT doc_id, array_to_string(list_transform(range(0, 9), lambda c: CASE WHEN list_contains(ids, c) THEN 1 ELSE 0 END), '') AS hot FROM g""")
def sc14_multi_hot(spark, sf):
    """Label ids by frequency, then one 0/1 vector per sample."""
    from samplemill.operators import encoding

    rows = doc_labels(spark, sf)
    ids = encoding.label_ids(rows, "labels")
    flat = encoding.with_label_ids(rows.select("doc_id", F.explode("labels").alias("labels")), "labels", ids)
    grouped = flat.groupBy("doc_id").agg(F.collect_list("label_id").alias("ids"))
    hot = F.transform(tk.multi_hot("ids", 9), lambda x: x.cast("int").cast("string"))
    return grouped.select("doc_id", F.array_join(hot, "").alias("hot"))


@query("""WITH w AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x: CAST(length(x) AS INT)) AS ids FROM conversations)
  SELECT a.conv_id, a.turn, array_to_string(list_concat(list_concat([3], a.ids), [4]), ',') AS single,
    array_to_string(list_concat(list_concat(list_concat([3], a.ids), [4, 6, 3]), list_concat(b.ids, [4])), ',') AS pair
  FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def sc21_template(spark, sf):
    """Special tokens around a turn, and around a turn and its answer."""
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", ids.alias("a"))
    answers = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    both = rows.join(answers, ["conv_id", "turn"])
    return both.select(
        "conv_id", "turn", joined(tk.with_template("a").cast("array<string>")).alias("single"),
        joined(tk.with_template("a", "b").cast("array<string>")).alias("pair"),
    )
