"""Sources and sinks: tables are written in a foreign form to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from samplemill.functions.reports import id_mismatch
from samplemill.operators.filters import keep_ids
from samplemill.plans.session import work_path
from samplemill.plans.staged import side_by_side
from samplemill.queries.inputs import joined, table, tagged_union, texts
from samplemill.queries.labels import threat_reports, vote_lines
from samplemill.queries.registry import query
from samplemill.sources import archives, files, logs, payloads, sinks
from samplemill.sources import labels as lb


def blobs(spark, sf):
    """ZIP archives of all documents, named by digest prefix."""
    docs = texts(spark, sf, "doc_id", "text").select(
        F.concat(F.lit("a"), F.substring(F.md5("text"), 1, 1)).alias("archive"),
        F.concat("doc_id", F.lit(".txt")).alias("name"),
        F.col("text").cast("binary").alias("content"),
    )
    return archives.zip_batches(docs, "archive", "name", "content")


@query("SELECT doc_id || '.txt' AS name, substr(md5(text), 1, 1) AS prefix, CAST(strlen(text) AS BIGINT) AS size, md5(text) AS digest FROM documents")
def src1_archive_members(spark, sf):
    members = archives.expand_archives(blobs(spark, sf))
    return members.select("name", F.substring("archive", 2, 1).alias("prefix"), "size", F.md5("bytes").alias("digest"))


@query("SELECT doc_id || '.txt' AS name, CAST(strlen(text) AS BIGINT) AS size, TRUE AS pruned FROM documents")
def src1_archive_names(spark, sf):
    members = archives.expand_archives(blobs(spark, sf), names_only=True)
    return members.select("name", "size", F.col("bytes").isNull().alias("pruned"))


@query("""SELECT doc_id || '.txt' AS name, CAST(least(strlen(text), 300) AS INT) AS n, l.toxic FROM documents JOIN labels l USING (doc_id)""")
def src2_requested_members(spark, sf):
    """Members that have a label, cut to 300 bytes."""
    members = archives.expand_archives(blobs(spark, sf), max_length=300).withColumn("archive", F.substring("archive", 1, 2))
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("a"), F.substring(F.md5("text"), 1, 1)).alias("archive"))
    wanted = docs.join(table(spark, sf, "labels"), "doc_id").select("archive", F.concat("doc_id", F.lit(".txt")).alias("name"), "toxic")
    return archives.requested_members(members, wanted).select("name", F.octet_length("bytes").alias("n"), "toxic")


@query("SELECT CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes, TRUE AS listed FROM (SELECT regexp_replace(text, '[\\r\\n]', ' ', 'g') AS text FROM documents)")
def src3_src4_binary_files(spark, sf):
    """Documents written as text files, then scanned as loose binary files and listed without content."""
    path = work_path(spark, "loose")
    table(spark, sf, "documents").select(F.regexp_replace("text", r"[\r\n]", " ").alias("value")).write.text(path)
    scanned = files.binary_files(spark, path, "*.txt").agg(F.sum(F.octet_length("bytes")).alias("n_bytes"), F.sum("size").alias("_size"))
    listing = files.file_listing(spark, path, "*.txt").agg(F.sum("size").alias("_listed"))
    both = side_by_side(scanned, listing)
    return both.select("n_bytes", ((F.col("_size") == F.col("n_bytes")) & (F.col("_listed") == F.col("n_bytes"))).alias("listed"))


def meta_csv(spark, sf) -> str:
    path = work_path(spark, "meta")
    lines = table(spark, sf, "lineitem")
    flags = [F.when(F.col("l_suppkey") % (i + 2) == 0, 1).otherwise(0).alias(f) for i, f in enumerate(files.META_FLAGS)]
    rows = lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("sha256"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("is_malware"),
        F.col("l_extendedprice").alias("rl_fs_t"),
        F.col("l_quantity").cast("int").alias("rl_ls_const_positives"),
        *flags,
    )
    rows.write.option("header", "true").csv(path)
    return path


META_SQL = "SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS sha256, l_returnflag = 'R' AS is_malware, l_extendedprice AS rl_fs_t, CAST(trunc(l_quantity) AS INT) AS rl_ls_const_positives, " + ", ".join(
    f"l_suppkey % {i + 2} = 0 AS {f}" for i, f in enumerate(files.META_FLAGS)
) + " FROM lineitem"


@query(META_SQL)
def src5_meta_csv(spark, sf):
    return files.read_meta(spark, meta_csv(spark, sf))


@query("SELECT 's' || c_custkey AS id, c_mktsegment AS family FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_nationkey <> 3")
def src6_family_csv(spark, sf):
    """Label file with unknown and empty families."""
    path = work_path(spark, "families")
    family = F.when(F.col("c_mktsegment") == "BUILDING", "Unknown").when(F.col("c_nationkey") != 3, F.col("c_mktsegment"))
    table(spark, sf, "customer").select(
        F.concat(F.lit("s"), "c_custkey").alias("sha"), F.lit("2024-01-01").alias("ts"), family.alias("family")
    ).write.option("header", "true").csv(path)
    return files.read_family_labels(spark, path).select("id", "family")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(CASE WHEN o_orderstatus = 'F' THEN NULL WHEN l.k IS NOT NULL THEN l.n ELSE o_custkey END AS BIGINT) AS value
  FROM orders LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) l ON l.k = o_orderkey""")
def src7_snk4_id_maps(spark, sf):
    """Three JSON maps written sorted by id; the later ones override, also with null."""
    orders = table(spark, sf, "orders")
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("value"))
    maps = [
        orders.select("o_orderkey", F.col("o_custkey").alias("value")),
        keep_ids(counts, orders, "o_orderkey"),
        orders.where("o_orderstatus = 'F'").select("o_orderkey", F.lit(None).cast("bigint").alias("value")),
    ]
    paths = []
    for part in maps:
        paths.append(work_path(spark, "idmap"))
        sinks.write_id_map(part, paths[-1], "o_orderkey", "value")
    return files.read_id_map(spark, paths)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus = 'F' THEN 'a "quoted", {open' || chr(92) || ' value' ELSE o_orderpriority || ',[' || o_custkey || '],' END AS value FROM orders""")
def src7_object_map(spark, sf):
    """All orders in one JSON object on one line; values have commas, quotes, brackets and backslashes."""
    path = work_path(spark, "objectmap")
    odd = F.concat(F.lit('a "quoted", {open\\ value'))
    plain = F.concat("o_orderpriority", F.lit(",["), "o_custkey", F.lit("],"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", odd).otherwise(plain).alias("value"))
    sinks.write_object_map(orders, path, "o_orderkey", "value")
    return files.read_id_map(spark, [path], "string", layout="object")


@query("SELECT count(*) AS n, TRUE AS in_order FROM orders")
def snk4_sorted_lines(spark, sf):
    """Lines of an id map in the order in which they stand in its files: sorted within each, and from file to file."""
    path = work_path(spark, "idmap")
    sinks.write_id_map(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), path, "o_orderkey", "o_custkey")
    lines = spark.read.text(path).select(
        F.get(F.map_keys(F.from_json("value", "map<string,bigint>")), F.lit(0)).cast("bigint").alias("id"),
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
    )
    inside = Window.partitionBy("file", "block").orderBy("at")
    lines = lines.withColumn("ok", F.coalesce(F.lag("id").over(inside) < F.col("id"), F.lit(True)))
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.bool_and("ok").alias("ok"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    after = F.coalesce(F.lag("hi").over(Window.partitionBy().orderBy("file", "block")) < F.col("lo"), F.lit(True))
    return blocks.withColumn("ok", F.col("ok") & after).agg(F.sum("n").alias("n"), F.bool_and("ok").alias("in_order"))


@query("""WITH v AS (SELECT l_orderkey AS id, l_returnflag || l_linestatus AS value, count(*) AS n FROM lineitem GROUP BY ALL),
  g AS (SELECT id, string_agg(value, ',' ORDER BY n DESC, value) AS names FROM v GROUP BY id)
  SELECT CASE WHEN substr(o_orderpriority, 1, 1) NOT IN ('1', '5') THEN names END AS labels, count(*) AS n FROM g JOIN orders ON o_orderkey = id GROUP BY 1""")
def src8_report_lines(spark, sf):
    """Threat reports written as JSON lines and read back with broken and incomplete ones among them."""
    path = work_path(spark, "reports")
    threat_reports(spark, sf).select(F.col("text").alias("value")).write.text(path)
    reports = spark.read.text(path).select(F.lit("").alias("id"), F.col("value").alias("text"))
    labels = lb.report_labels(reports, "name").select(joined("labels").alias("labels"))
    return labels.groupBy("labels").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT l_suppkey AS id, l_returnflag || l_linestatus AS value, count(*) AS n FROM lineitem GROUP BY ALL),
  g AS (SELECT id, string_agg(value, ',' ORDER BY n DESC, value) AS names FROM v GROUP BY id)
  SELECT 'supplier' || id AS id, CASE WHEN id % 5 > 1 THEN names END AS labels, id % 5 IN (0, 2) AS misnamed FROM g""")
def src8_report_files(spark, sf):
    """One report per file, its id from the file's name: some are cut off, some lack their votes, some name another id."""
    path = work_path(spark, "reports")
    votes = table(spark, sf, "lineitem").groupBy("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    listed = votes.groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.struct("value", "count"))).alias("names"))
    name, kind = F.concat(F.lit("supplier"), "l_suppkey"), F.col("l_suppkey") % 5
    attributes = F.struct(
        F.when(kind != 1, F.struct(F.col("names").alias("popular_threat_name"))).alias("popular_threat_classification"),
        F.when(kind == 2, "another").otherwise(name).alias("sha256"),
    )
    body = F.to_json(F.struct(F.struct(attributes.alias("attributes")).alias("data")))
    body = F.when(kind == 0, F.substring(body, F.lit(1), F.length(body) - 5)).otherwise(body)
    sinks.write_files(listed.select(F.concat(name, F.lit(".json")).alias("file"), body.alias("body")), path, "file", "body")
    reports = files.read_texts(spark, path, "*.json")
    labels = lb.report_labels(reports, "name").select("id", joined("labels").alias("labels"))
    wrong = reports.select(F.col("id").alias("i"), id_mismatch("text", "id").alias("misnamed"))
    return labels.join(wrong, F.col("id") == F.col("i")).select("id", "labels", "misnamed")


@query("""WITH n AS (SELECT l_orderkey AS id, CAST(count(DISTINCT (l_returnflag, CASE WHEN l_linestatus = 'F' THEN 's' || (l_suppkey % 3) ELSE 's' || (l_suppkey % 3) || ':p' || (l_partkey % 2) END)) AS INT) AS n FROM lineitem GROUP BY 1)
  SELECT CAST(id AS VARCHAR) AS id, n AS flagged, n AS n_votes FROM n""")
def src9_vote_file(spark, sf):
    path = work_path(spark, "votes")
    vote_lines(spark, sf).write.text(path)
    return lb.vote_items(spark.read.text(path)).select("id", "flagged", F.size("votes").alias("n_votes"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def src10_id_list(spark, sf):
    path = work_path(spark, "ids")
    table(spark, sf, "labels").where("toxic = 0").select(F.col("doc_id").cast("string").alias("value")).write.text(path)
    ids = files.read_ids(spark, path, "doc_id").select(F.col("doc_id").cast("bigint").alias("doc_id"))
    return keep_ids(table(spark, sf, "documents").select("doc_id", "lang"), ids, "doc_id")


@query("""SELECT event_id, 'error' AS kind, 'failed: ' || user_id AS text FROM events WHERE event_type = 'error'
  UNION ALL SELECT event_id, 'row', event_type || ':' || user_id FROM events WHERE event_type <> 'error'""")
def src11_sweep_log(spark, sf):
    path = work_path(spark, "sweep")
    events = table(spark, sf, "events")
    kwds = F.struct("event_id", F.col("event_type").alias("split"))
    good = F.to_json(F.struct(kwds.alias("kwds"), F.struct(F.col("user_id").alias("n_to")).alias("results")))
    bad = F.to_json(F.struct(kwds.alias("kwds"), F.concat(F.lit("failed: "), "user_id").alias("results")))
    events.select(F.when(F.col("event_type") == "error", bad).otherwise(good).alias("value")).write.text(path)
    rows = logs.sweep_rows(spark.read.text(path))
    errors = logs.sweep_errors(rows).select(F.get_json_object("kwds", "$.event_id").cast("bigint").alias("event_id"), F.col("error").alias("text"))
    done = logs.sweep_table(rows, {"event_id": "bigint", "split": "string"}, {"n_to": "bigint"})
    done = done.select("event_id", F.concat("split", F.lit(":"), "n_to").alias("text"))
    return tagged_union({"error": errors, "row": done}, "kind")


@query("""WITH r AS (SELECT l_returnflag || l_linestatus AS run, l_suppkey AS epoch, round(avg(l_discount), 5) AS v FROM lineitem GROUP BY ALL)
  SELECT 'run=' || run AS run, CAST(epoch AS DOUBLE) AS epoch, 'loss' AS kind, v FROM r
  UNION ALL SELECT 'run=' || run, CAST(epoch AS DOUBLE), 'eval_loss', v + 1 FROM r""")
def src12_training_logs(spark, sf):
    """One training state per flag and status, with a training and an evaluation entry per supplier."""
    path = work_path(spark, "states")
    entries = (
        table(spark, sf, "lineitem")
        .groupBy(F.concat("l_returnflag", "l_linestatus").alias("run"), F.col("l_suppkey").cast("double").alias("epoch"))
        .agg(F.round(F.avg("l_discount"), 5).alias("v"))
    )
    both = entries.select(
        "run",
        F.explode(
            F.array(
                F.create_map(F.lit("epoch"), "epoch", F.lit("loss"), "v"),
                F.create_map(F.lit("epoch"), "epoch", F.lit("eval_loss"), F.col("v") + 1),
            )
        ).alias("e"),
    )
    states = both.groupBy("run").agg(F.to_json(F.struct(F.collect_list("e").alias("log_history"))).alias("value"))
    states.write.partitionBy("run").text(path)
    log = logs.read_training_log(spark, path)
    parts = {
        "loss": logs.training_rows(log).select("run", F.col("entry")["epoch"].alias("epoch"), F.col("entry")["loss"].alias("v")),
        "eval_loss": logs.evaluation_rows(log).select("run", F.col("entry")["epoch"].alias("epoch"), F.col("entry")["eval_loss"].alias("v")),
    }
    return tagged_union(parts, "kind")


@query("SELECT n_chars AS length, count(*) AS n FROM documents GROUP BY n_chars")
def src13_length_files(spark, sf):
    path = work_path(spark, "lengths")
    table(spark, sf, "documents").select(F.col("n_chars").cast("string").alias("value")).write.text(path)
    return files.read_lengths(spark, path).groupBy("length").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY ALL")
def src14_keyed_csv(spark, sf):
    """CSV files in one folder per flag; the key column tells the files apart."""
    path = work_path(spark, "csvs")
    table(spark, sf, "lineitem").select("l_returnflag", "l_returnflag", "l_linestatus", "l_linenumber").toDF("part", "flag", "status", "number").write.partitionBy(
        "part"
    ).option("header", "true").csv(path)
    rows = files.read_keyed_csv(spark, path, "flag string, status string, number int").where("key is not null")
    return rows.groupBy("flag", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("number").alias("total"))


@query("SELECT count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, count(DISTINCT substr(md5(text), 1, 1)) AS n_prefixes FROM documents")
def snk1_prefix_archives(spark, sf):
    path = work_path(spark, "prefixes")
    docs = table(spark, sf, "documents").select(F.md5("text").alias("digest"), "doc_id", "text")
    sinks.write_by_prefix(docs, path, "digest", digits=1)
    stored = spark.read.parquet(path)
    return side_by_side(sinks.volume(stored, "text"), stored.agg(F.count_distinct("prefix").alias("n_prefixes")))


@query("SELECT lang, count(*) AS n, TRUE AS fits FROM documents GROUP BY lang")
def snk2_sharded_dataset(spark, sf):
    """Two shards of at most 200 rows a file, merged by appending; ``fits`` is false if a file with the language is larger."""
    path = work_path(spark, "shards")
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    sinks.write_dataset(docs.where("lang = 'en'"), path, max_records=200)
    sinks.write_dataset(docs.where("lang <> 'en'"), path, max_records=200, mode="append")
    stored = spark.read.parquet(path).select("lang", F.col("_metadata.file_path").alias("file"))
    sizes = stored.groupBy("file").agg((F.count(F.lit(1)) <= 200).alias("fits"))
    return stored.join(sizes, "file").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.bool_and("fits").alias("fits"))


@query("SELECT lang, count(*) AS n FROM documents WHERE n_chars >= 500 GROUP BY lang")
def snk3_materialized_result(spark, sf):
    """The same parameters twice: the second call reads what the first wrote."""
    root = work_path(spark, "results")

    def build():
        return table(spark, sf, "documents").where("n_chars >= 500").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))

    params = {"min_size": 500, "table": "documents"}
    sinks.materialize(spark, "sizes", params, build, root)
    return sinks.materialize(spark, "sizes", params, lambda: build().limit(0), root)


@query("SELECT o_orderkey || ' ' || o_orderstatus || ' ' || o_orderpriority AS value FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def snk5_filtered_lines(spark, sf):
    source, target = work_path(spark, "lines"), work_path(spark, "kept")
    table(spark, sf, "orders").select(F.concat_ws(" ", "o_orderkey", "o_orderstatus", "o_orderpriority").alias("value")).write.text(source)
    ids = table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").cast("string").alias("id"))
    sinks.keep_lines(spark, source, target, ids)
    return spark.read.text(target)


def compressed(batches):
    import bz2
    import gzip
    import lzma
    import zlib

    codecs = {"gzip": lambda b: gzip.compress(b, mtime=0), "bz2": bz2.compress, "xz": lzma.compress, "zlib": zlib.compress, "none": bytes}
    for batch in batches:
        yield batch.assign(content=[codecs[a](bytes(b)) for a, b in zip(batch["alg"], batch["content"])])


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, CASE doc_id % 5 WHEN 0 THEN 'gzip' WHEN 1 THEN 'bz2' WHEN 2 THEN 'xz' WHEN 3 THEN 'zlib' ELSE 'none' END AS alg,
  md5(text) AS digest, CAST(NULL AS VARCHAR) AS error FROM documents""")
def sc19_decoded_payloads(spark, sf):
    """Documents compressed by turns with every codec, then decoded by signature."""
    number = F.col("doc_id") % 5
    alg = F.when(number == 0, "gzip").when(number == 1, "bz2").when(number == 2, "xz").when(number == 3, "zlib").otherwise("none")
    docs = texts(spark, sf, "doc_id", "text").select("doc_id", alg.alias("alg"), F.col("text").cast("binary").alias("content"))
    packed = docs.mapInPandas(compressed, "doc_id bigint, alg string, content binary")
    return payloads.decoded(packed, "doc_id", "content").select("id", "alg", F.md5("bytes").alias("digest"), "error")
