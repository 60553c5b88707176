"""Numeric features of documents and of tables derived from order lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from samplemill.operators import features
from samplemill.operators.filters import first_of, keep_ids
from samplemill.queries.inputs import joined, table, texts
from samplemill.queries.registry import query


def content(spark, sf):
    return texts(spark, sf, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("content"))


@query("""WITH b AS (SELECT doc_id, strlen(text) AS size, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents)
  SELECT doc_id, CAST(('0x' || b)::BIGINT AS INT) AS byte, count(*) AS n, round(count(*) / any_value(size), 9) AS share FROM b GROUP BY doc_id, b""")
def fe1_byte_histogram(spark, sf):
    rows = content(spark, sf).select("doc_id", features.byte_histogram("content").alias("h"))
    rows = rows.withColumn("s", features.shares("h"))
    flat = rows.select("doc_id", F.posexplode_outer(F.arrays_zip("h", "s")).alias("byte", "z"))
    return flat.select("doc_id", "byte", F.col("z.h").alias("n"), F.round("z.s", 9).alias("share")).where("n > 0")


@query("""WITH b AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS len FROM documents),
  s AS (SELECT doc_id, h, unnest(range(0, greatest(len - 2048, 0) + 1, 1024)) AS st FROM b),
  w AS (SELECT doc_id, st, unnest(regexp_extract_all(substr(h, 2 * st + 1, 4096), '..')) AS x FROM s),
  n AS (SELECT doc_id, st, substr(x, 1, 1) AS nibble, count(*) AS c FROM w GROUP BY ALL),
  e AS (SELECT doc_id, st, least(15, CAST(floor(-4 * sum(c / 2048 * log2(c / 2048))) AS BIGINT)) AS entropy_bin FROM n GROUP BY ALL)
  SELECT doc_id, entropy_bin, CAST(('0x' || nibble)::BIGINT AS INT) AS nibble, CAST(sum(c) AS BIGINT) AS n FROM n JOIN e USING (doc_id, st) GROUP BY ALL""")
def fe2_byte_entropy_histogram(spark, sf):
    rows = content(spark, sf).select("doc_id", features.byte_entropy_histogram("content").alias("h"))
    flat = rows.select("doc_id", F.posexplode_outer("h").alias("cell", "n")).where("n > 0")
    return flat.select("doc_id", F.floor(F.col("cell") / 16).alias("entropy_bin"), (F.col("cell") % 16).alias("nibble"), "n")


@query("""WITH w AS (SELECT doc_id, strlen(text) AS len, CASE WHEN strlen(text) < 2048 THEN 1 ELSE (strlen(text) - 2048) // 1024 + 1 END AS n_windows FROM documents)
  SELECT doc_id, CAST(sum(least(len, 2048) * n_windows) AS BIGINT) AS n_bytes FROM w GROUP BY doc_id""")
def fe2_window_totals(spark, sf):
    """Bytes counted by the windows of a document: every window has full length, a short document is one window."""
    rows = content(spark, sf).select("doc_id", features.byte_entropy_histogram("content").alias("h"))
    return rows.select("doc_id", F.aggregate("h", F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("n_bytes"))


@query("""WITH r AS (SELECT doc_id, text, regexp_extract_all(text, '[\\x20-\\x7f]{5,}') AS runs FROM documents),
  j AS (SELECT doc_id, text, len(runs) AS n, array_to_string(runs, '') AS all_ FROM r),
  c AS (SELECT doc_id, ch, count(*) AS k FROM (SELECT doc_id, unnest(string_split(all_, '')) AS ch FROM j WHERE length(all_) > 0) GROUP BY doc_id, ch),
  e AS (SELECT doc_id, -sum(k / t * log2(k / t)) AS entropy FROM (SELECT *, sum(k) OVER (PARTITION BY doc_id) AS t FROM c) GROUP BY doc_id),
  d AS (SELECT doc_id, sum(k / t * (ascii(ch) - 32)) AS centre, sum(k / t * k / t) AS peak FROM (SELECT *, sum(k) OVER (PARTITION BY doc_id) AS t FROM c) GROUP BY doc_id)
  SELECT j.doc_id, round(coalesce(d.centre, 0), 6) AS centre, round(coalesce(d.peak, 0), 6) AS peak, n AS numstrings, length(all_) AS printables, round(CASE WHEN n > 0 THEN length(all_) / n ELSE 0 END, 6) AS avlength, round(coalesce(e.entropy, 0), 6) AS entropy,
    len(regexp_extract_all(text, '(?i)c:\\\\')) AS paths, len(regexp_extract_all(text, '(?i)https?://')) AS urls,
    len(regexp_extract_all(text, 'HKEY_')) AS registry, len(regexp_extract_all(text, 'MZ')) AS mz FROM j LEFT JOIN e USING (doc_id) LEFT JOIN d USING (doc_id)""")
def fe3_fe4_string_features(spark, sf):
    """The distribution over the 96 printable characters is compared by its mean and its sum of squares."""
    rows = features.string_features(content(spark, sf), "content")
    place = F.transform("printabledist", lambda x, i: x * i)
    square = F.transform("printabledist", lambda x: x * x)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x), 6)
    return rows.select(
        "doc_id", total(place).alias("centre"), total(square).alias("peak"), "numstrings", "printables", F.round("avlength", 6).alias("avlength"), F.round("entropy", 6).alias("entropy"),
        "paths", "urls", "registry", "mz",
    )


BUCKET = "CAST(('0x' || substr(md5({0}), 1, 8))::BIGINT % {1} AS INT)"
SIGN = "CASE WHEN CAST(('0x' || substr(md5({0}), 9, 1))::BIGINT AS INT) < 8 THEN 1 ELSE -1 END"


@query(f"""WITH t AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS t FROM documents),
  b AS (SELECT doc_id, {BUCKET.format('t', 256)} AS bucket, CAST(sum({SIGN.format('t')}) AS DOUBLE) AS value FROM t GROUP BY ALL)
  SELECT * FROM b WHERE value <> 0""")
def fe5_hashed_strings(spark, sf):
    docs = texts(spark, sf, "doc_id", "text").select("doc_id", F.split(F.lower("text"), " ").alias("tokens"))
    return features.hashed(docs, "doc_id", "tokens", 256)


@query(f"""WITH t AS (SELECT l_orderkey, 'supp' || l_suppkey AS t, l_quantity AS v FROM lineitem),
  b AS (SELECT l_orderkey, {BUCKET.format('t', 50)} AS bucket, sum({SIGN.format('t')} * v) AS value FROM t GROUP BY ALL),
  d AS (SELECT l_orderkey, unnest(range(0, 50)) AS bucket FROM (SELECT DISTINCT l_orderkey FROM b WHERE value <> 0))
  SELECT d.l_orderkey, string_agg(CAST(CAST(coalesce(b.value, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY d.bucket) AS vector
  FROM d LEFT JOIN b ON b.l_orderkey = d.l_orderkey AND b.bucket = d.bucket GROUP BY d.l_orderkey""")
def fe5_hashed_pairs(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.concat(F.lit("supp"), "l_suppkey").alias("t"), "l_quantity")
    sparse = features.hashed(lines, "l_orderkey", "t", 50, F.col("l_quantity"))
    # Most places are zero, and rounding goes through decimals.
    vector = F.transform("vector", lambda x: F.when(x == 0, "0").otherwise(F.round(x, 0).cast("bigint").cast("string")))
    return features.dense(sparse, "l_orderkey", 50).select("l_orderkey", joined(vector).alias("vector"))


@query("""SELECT l_orderkey, count(*) AS n_sections, count(*) FILTER (l_tax = 0) AS n_zero, count(*) FILTER (l_quantity < 5) AS n_unnamed,
  count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS n_rx, count(*) FILTER (l_returnflag = 'R') AS n_w FROM lineitem GROUP BY l_orderkey""")
def fe6_section_counts(spark, sf):
    flag = F.col("l_returnflag")
    props = F.array_compact(
        F.array(
            F.when(flag == "A", "MEM_READ"), F.when(F.col("l_linestatus") == "F", "MEM_EXECUTE"), F.when(flag == "R", "MEM_WRITE")
        )
    )
    name = F.when(F.col("l_quantity") < 5, "").otherwise(F.concat(F.lit("sec"), "l_linenumber"))
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", F.when(F.col("l_tax") == 0, 0).otherwise(1).alias("size"), name.alias("name"), props.alias("props")
    )
    return features.section_counts(lines, "l_orderkey")


@query("""WITH i AS (SELECT l_orderkey, lower('LIB' || (l_suppkey % 5)) AS lib, 'Fn' || (l_partkey % 50) AS f FROM lineitem)
  SELECT l_orderkey, 'library' AS kind, lib AS token, CAST(1 AS BIGINT) AS n FROM (SELECT DISTINCT l_orderkey, lib FROM i)
  UNION ALL SELECT l_orderkey, 'function', lib || ':' || f, count(*) FROM i GROUP BY ALL""")
def fe6_import_tokens(spark, sf):
    imports = table(spark, sf, "lineitem").select(
        "l_orderkey", F.concat(F.lit("LIB"), F.col("l_suppkey") % 5).alias("library"), F.concat(F.lit("Fn"), F.col("l_partkey") % 50).alias("function")
    )
    return features.import_tokens(imports, "l_orderkey")


def hashed_sql(table: str, token: str, first: int, width: int, value: str = "1") -> str:
    return f"SELECT doc_id, {first} + {BUCKET.format(token, width)}, {SIGN.format(token)} * CAST({value} AS DOUBLE) FROM {table}"


FEATURES_SQL = f"""WITH b AS (SELECT doc_id, strlen(text) AS size, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents),
  h AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS len FROM documents),
  st AS (SELECT doc_id, h, unnest(range(0, greatest(len - 2048, 0) + 1, 1024)) AS st FROM h),
  w AS (SELECT doc_id, st, unnest(regexp_extract_all(substr(h, 2 * st + 1, 4096), '..')) AS x FROM st),
  n AS (SELECT doc_id, st, substr(x, 1, 1) AS nibble, count(*) AS c FROM w GROUP BY ALL),
  e AS (SELECT doc_id, st, least(15, CAST(floor(-4 * sum(c / 2048 * log2(c / 2048))) AS BIGINT)) AS bin FROM n GROUP BY ALL),
  eh AS (SELECT doc_id, 256 + 16 * bin + CAST(('0x' || nibble)::BIGINT AS INT) AS place, sum(c) AS c FROM n JOIN e USING (doc_id, st) GROUP BY ALL),
  r AS (SELECT doc_id, text, regexp_extract_all(text, '[\\x20-\\x7f]{{5,}}') AS runs FROM documents),
  j AS (SELECT doc_id, text, len(runs) AS n, array_to_string(runs, '') AS all_ FROM r),
  ch AS (SELECT doc_id, ch, count(*) AS k FROM (SELECT doc_id, unnest(string_split(all_, '')) AS ch FROM j WHERE length(all_) > 0) GROUP BY doc_id, ch),
  cs AS (SELECT *, sum(k) OVER (PARTITION BY doc_id) AS t FROM ch),
  hd AS (SELECT doc_id, o.* FROM documents JOIN orders AS o ON o_orderkey = doc_id),
  li AS (SELECT doc_id, l.*, row_number() OVER (PARTITION BY doc_id ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS nth FROM documents JOIN lineitem AS l ON l_orderkey = doc_id),
  im AS (SELECT doc_id, lower('LIB' || (l_suppkey % 5)) AS lib, 'Fn' || (l_partkey % 50) AS f FROM li),
  libs AS (SELECT DISTINCT doc_id, lib FROM im), fns AS (SELECT doc_id, lib || ':' || f AS f FROM im), ex AS (SELECT doc_id, 'Exp' || (l_suppkey % 20) AS x FROM li),
  names AS (SELECT *, CASE WHEN l_quantity < 5 THEN '' ELSE 'sec' || l_linenumber END AS name FROM li),
  entry AS (SELECT DISTINCT doc_id, name FROM names WHERE l_linenumber = 1),
  props AS (SELECT doc_id, unnest(list_filter([CASE WHEN l_returnflag = 'A' THEN 'MEM_READ' END, CASE WHEN l_linestatus = 'F' THEN 'MEM_EXECUTE' END,
    CASE WHEN l_returnflag = 'R' THEN 'MEM_WRITE' END], lambda x: x IS NOT NULL)) AS p FROM names WHERE l_linenumber = 1),
  kinds AS (SELECT doc_id, unnest([o_orderstatus, o_orderpriority]) AS k FROM hd),
  v(doc_id, place, value) AS (
    SELECT doc_id, CAST(('0x' || b)::BIGINT AS INT), count(*) / any_value(size) FROM b GROUP BY doc_id, b
    UNION ALL SELECT doc_id, place, c / sum(c) OVER (PARTITION BY doc_id) FROM eh
    UNION ALL SELECT doc_id, unnest([512, 513, 514, 612, 613, 614, 615, 616]), unnest([n, CASE WHEN n > 0 THEN length(all_) / n ELSE 0 END, length(all_),
      len(regexp_extract_all(text, '(?i)c:\\\\')), len(regexp_extract_all(text, '(?i)https?://')), len(regexp_extract_all(text, 'HKEY_')), len(regexp_extract_all(text, 'MZ')), strlen(text)]) FROM j
    UNION ALL SELECT doc_id, 515 + ascii(ch) - 32, k / t FROM cs
    UNION ALL SELECT doc_id, 611, -sum(k / t * log2(k / t)) FROM cs GROUP BY doc_id
    UNION ALL SELECT doc_id, unnest([617, 618, 625, 626, 678, 685]), unnest([o_custkey, o_orderkey % 2, o_custkey % 7, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)), o_custkey % 11, o_custkey * 512]) FROM hd
    UNION ALL {hashed_sql('hd', 'o_orderpriority', 627, 10)}
    UNION ALL {hashed_sql('kinds', 'k', 637, 10)}
    UNION ALL {hashed_sql('hd', 'o_orderstatus', 647, 10)}
    UNION ALL SELECT doc_id, unnest([688, 689, 690, 691, 692]), unnest([1, CAST(l_tax = 0 OR l_partkey = 0 AS INT), CAST(name = '' AS INT), CAST(l_returnflag = 'A' AND l_linestatus = 'F' AS INT), CAST(l_returnflag = 'R' AS INT)]) FROM names
    UNION ALL {hashed_sql('names', 'name', 693, 50, 'CASE WHEN l_tax = 0 THEN 0 ELSE l_partkey END')}
    UNION ALL {hashed_sql('names', 'name', 743, 50, 'round(100 * l_discount)')}
    UNION ALL {hashed_sql('names', 'name', 793, 50, 'l_suppkey')}
    UNION ALL {hashed_sql('entry', 'name', 843, 50)}
    UNION ALL {hashed_sql('props', 'p', 893, 50)}
    UNION ALL {hashed_sql('libs', 'lib', 943, 256)}
    UNION ALL {hashed_sql('fns', 'f', 1199, 1024)}
    UNION ALL SELECT doc_id, 620, 1 FROM fns
    UNION ALL {hashed_sql('ex', 'x', 2223, 128)}
    UNION ALL SELECT doc_id, 619, 1 FROM ex
    UNION ALL SELECT doc_id, CAST(2351 + 2 * nth AS INT), l_partkey FROM li WHERE nth < 15
    UNION ALL SELECT doc_id, CAST(2352 + 2 * nth AS INT), l_suppkey FROM li WHERE nth < 15),
  s AS (SELECT doc_id, place, sum(CAST(value AS DOUBLE)) AS value FROM v GROUP BY ALL)
  SELECT doc_id, CAST(place AS INT) AS place, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 6) AS value FROM s WHERE value <> 0"""


@query(FEATURES_SQL)
def fe7_feature_table(spark, sf):
    """Vectors of nine blocks for all documents; their orders and lines stand in for headers and parsed tables."""
    docs = content(spark, sf)
    ids = docs.select("doc_id")
    orders = keep_ids(table(spark, sf, "orders").withColumnRenamed("o_orderkey", "doc_id"), ids, "doc_id")
    headers = orders.select(
        "doc_id", F.col("o_custkey").alias("vsize"), (F.col("doc_id") % 2).alias("has_debug"), (F.col("o_custkey") % 7).alias("symbols"),
        F.expr("datediff(cast(o_orderdate AS date), DATE'1970-01-01')").alias("timestamp"), F.col("o_orderpriority").alias("machine"),
        F.array("o_orderstatus", "o_orderpriority").alias("characteristics"), F.col("o_orderstatus").alias("subsystem"),
        (F.col("o_custkey") % 11).alias("minor_image_version"), (F.col("o_custkey") * 512).alias("sizeof_code"),
    )
    lines = keep_ids(table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "doc_id"), ids, "doc_id")
    flag = F.col("l_returnflag")
    sections = lines.select(
        "doc_id", F.when(F.col("l_quantity") < 5, "").otherwise(F.concat(F.lit("sec"), "l_linenumber")).alias("name"),
        F.when(F.col("l_tax") == 0, 0).otherwise(F.col("l_partkey")).alias("size"), F.col("l_suppkey").alias("vsize"),
        F.round(100 * F.col("l_discount")).alias("entropy"), (F.col("l_linenumber") == 1).alias("is_entry"),
        F.array_compact(F.array(F.when(flag == "A", "MEM_READ"), F.when(F.col("l_linestatus") == "F", "MEM_EXECUTE"), F.when(flag == "R", "MEM_WRITE"))).alias("props"),
    )
    imports = lines.select("doc_id", F.concat(F.lit("LIB"), F.col("l_suppkey") % 5).alias("library"), F.concat(F.lit("Fn"), F.col("l_partkey") % 50).alias("function"))
    exports = lines.select("doc_id", F.concat(F.lit("Exp"), F.col("l_suppkey") % 20).alias("name"))
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1
    directories = lines.select("doc_id", place.alias("at"), F.col("l_partkey").alias("size"), F.col("l_suppkey").alias("address"))
    blocks = [
        features.content_block(docs, "doc_id", "content"), features.header_block(headers, "doc_id"), features.section_block(sections, "doc_id"),
        features.import_block(imports, "doc_id"), features.export_block(exports, "doc_id"), features.directories_block(directories, "doc_id"),
    ]
    vectors = features.feature_vectors(blocks, "doc_id")
    flat = vectors.select("doc_id", F.posexplode("features").alias("place", "value")).where("value <> 0")
    return flat.select("doc_id", "place", F.round(F.col("value").cast("double"), 6).alias("value"))


@query("""WITH e AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, l_partkey, l_suppkey FROM lineitem),
  f AS (SELECT l_orderkey, 2 * i AS k, l_partkey AS v FROM e WHERE i < 15 UNION ALL SELECT l_orderkey, 2 * i + 1, l_suppkey FROM e WHERE i < 15),
  g AS (SELECT o.l_orderkey, k, v FROM (SELECT l_orderkey, unnest(range(0, 30)) AS k FROM (SELECT DISTINCT l_orderkey FROM lineitem)) o LEFT JOIN f USING (l_orderkey, k))
  SELECT l_orderkey, string_agg(coalesce(v, 0), ',' ORDER BY k) AS block FROM g GROUP BY l_orderkey""")
def fe8_directory_block(spark, sf):
    entries = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    heads = first_of(table(spark, sf, "lineitem").select("l_orderkey", *order), "l_orderkey", order, features.DIRECTORIES)
    rows = heads.groupBy("l_orderkey").agg(entries.alias("e"))
    rows = rows.withColumn("e", F.transform("e", lambda x: F.struct(x["l_partkey"].alias("size"), x["l_suppkey"].alias("address"))))
    block = F.transform(features.directory_block("e"), lambda x: x.cast("bigint").cast("string"))
    return rows.select("l_orderkey", joined(block).alias("block"))
