"""Vote lines, threat reports, scanner reports, text normalisation and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from samplemill.functions import reports as rp
from samplemill.functions import text as tx
from samplemill.functions import votes as vt
from samplemill.operators import packing
from samplemill.plans.session import cut
from samplemill.queries.inputs import joined, table, tagged_union, texts
from samplemill.queries.registry import query
from samplemill.sources import labels as lb

VOTES = """raw AS (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'A' THEN 'class' WHEN 'N' THEN 'fam' ELSE 'beh' END AS ns,
    CASE WHEN l_linestatus = 'F' THEN 's' || (l_suppkey % 3) ELSE 's' || (l_suppkey % 3) || ':p' || (l_partkey % 2) END AS value,
    CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS count FROM lineitem GROUP BY ALL),
  placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY upper(ns) || ':' || value || '|' || count) AS pos FROM raw),
  parts AS (SELECT id, ns, count, pos, 0 AS late, 0 AS sub, value FROM placed WHERE NOT (ns = 'class' AND contains(value, ':'))
    UNION ALL SELECT id, ns, count, pos, 1, i, string_split(value, ':')[i] FROM placed, (SELECT unnest([1, 2]) AS i) WHERE ns = 'class' AND contains(value, ':')),
  merged AS (SELECT id, ns, value, CAST(sum(count) AS BIGINT) AS count, min((late, pos, sub)) AS first FROM parts GROUP BY id, ns, value)"""


def vote_lines(spark, sf):
    """One vote line per order, as a label tool writes it."""
    lines = table(spark, sf, "lineitem")
    ns = F.when(F.col("l_returnflag") == "A", "CLASS").when(F.col("l_returnflag") == "N", "FAM").otherwise("BEH")
    plain = F.concat(F.lit("s"), F.col("l_suppkey") % 3)
    value = F.when(F.col("l_linestatus") == "F", plain).otherwise(F.concat(plain, F.lit(":p"), F.col("l_partkey") % 2))
    counts = lines.groupBy("l_orderkey", ns.alias("ns"), value.alias("value")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("n")
    )
    vote = F.concat("ns", F.lit(":"), "value", F.lit("|"), "n")
    return counts.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(vote)).alias("v")).select(
        F.concat_ws(" ", "l_orderkey", F.size("v"), F.array_join("v", ",")).alias("value")
    )


@query(f"WITH {VOTES} SELECT CAST(id AS VARCHAR) AS id, CAST(count(*) OVER (PARTITION BY id) AS INT) AS flagged, ns, value, count FROM raw")
def sc1_parse_votes(spark, sf):
    items = lb.vote_items(vote_lines(spark, sf))
    return items.select("id", "flagged", F.explode("votes").alias("v")).select("id", "flagged", "v.*")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderpriority LIKE '1%' THEN NULL
  ELSE 'fam' || o_custkey END AS family FROM orders""")
def sc2_parse_families(spark, sf):
    fam = F.when(F.col("o_orderstatus") == "O", "- []").when(F.col("o_orderpriority").startswith("1"), F.concat(F.lit("SINGLETON:"), "o_custkey")).otherwise(
        F.concat(F.lit("fam"), "o_custkey")
    )
    lines = table(spark, sf, "orders").select(F.concat_ws(" ", "o_orderkey", fam).alias("value"))
    return lb.family_labels(lines)


@query(f"WITH {VOTES} SELECT CAST(id AS VARCHAR) AS id, ns, value, count FROM merged")
def ag6_merge_votes(spark, sf):
    return lb.vote_table(lb.vote_items(vote_lines(spark, sf)))


@query(f"""WITH {VOTES}, r AS (SELECT *, row_number() OVER (PARTITION BY id, ns ORDER BY count DESC, first) AS rn FROM merged WHERE count >= 20)
  SELECT CAST(id AS VARCHAR) AS id, ns, string_agg(value, ',' ORDER BY rn) AS labels FROM r WHERE rn <= 2 GROUP BY id, ns""")
def tk1_choose_labels(spark, sf):
    items = lb.vote_items(vote_lines(spark, sf))
    rules = {ns: (2, 20) for ns in vt.NAMESPACES}
    label = lb.resolved_labels(items, rules)
    named = F.array(*[F.struct(F.lit(ns).alias("ns"), joined(f"label.{ns}").alias("labels")) for ns in vt.NAMESPACES])
    return label.select("id", F.explode_outer(named).alias("l")).select("id", "l.*").where("labels is not null")


@query(f"""WITH {VOTES}, r AS (SELECT id, ns, value, row_number() OVER (PARTITION BY id, ns ORDER BY count DESC, first) AS rn FROM merged
    WHERE count >= CASE WHEN ns = 'fam' THEN 2 ELSE 5 END)
  SELECT CAST(id AS VARCHAR) AS id, value AS labels FROM r WHERE ns = 'fam' AND rn = 1""")
def prj7_label_view(spark, sf):
    labels = lb.view(lb.resolved_labels(lb.vote_items(vote_lines(spark, sf))), "fam")
    return labels.select("id", joined("labels").alias("labels"))


@query(f"""WITH {VOTES}, r AS (SELECT id, ns, value, count, row_number() OVER (PARTITION BY id, ns ORDER BY count DESC, first) AS rn FROM merged),
  c AS (SELECT id, max(value) FILTER (ns = 'class' AND count >= 5) AS cls, max(value) FILTER (ns = 'beh' AND count >= 5) AS beh,
    max(value) FILTER (ns = 'fam' AND count >= 2) AS fam FROM r WHERE rn = 1 GROUP BY id)
  SELECT CAST(c.id AS VARCHAR) AS id, CASE WHEN o.o_orderstatus = 'F' THEN NULL ELSE cls END AS cls, beh,
    CASE WHEN o.o_orderstatus = 'P' THEN 'known' ELSE fam END AS fam FROM c JOIN orders o ON o.o_orderkey = c.id""")
def e2_combined_labels(spark, sf):
    """Three tools: votes, a second opinion on the class (none for finished orders), a family for pending ones."""
    items = cut(lb.vote_items(vote_lines(spark, sf)), "votes")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderstatus")
    known = items.join(orders, "id")
    second = known.select("id", "flagged", F.when(F.col("o_orderstatus") != "F", F.col("votes")).alias("votes"))
    families = known.where("o_orderstatus = 'P'").select("id", F.lit("known").alias("family"))
    merged = lb.combined_labels(items, second, families)
    return merged.join(orders, "id", "left_semi").select(
        "id", joined("label.class").alias("cls"), joined("label.beh").alias("beh"), joined("label.fam").alias("fam")
    )


REPORT_VOTES = """v AS (SELECT l_orderkey AS id, l_returnflag || l_linestatus AS value, count(*) AS n FROM lineitem GROUP BY ALL)"""


def threat_reports(spark, sf):
    """One JSON report per order; orders of the lowest priority have none of the classification, urgent ones are cut off."""
    counts = table(spark, sf, "lineitem").groupBy("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    listed = counts.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("value", "count"))).alias("names"))
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", F.expr("datediff(cast(o_orderdate AS date), DATE'1970-01-01')").cast("bigint").alias("day")
    )
    both = listed.join(orders, "l_orderkey")
    cls = F.when(
        ~F.col("o_orderpriority").startswith("5"),
        F.struct(
            F.col("names").alias("popular_threat_name"),
            F.concat(F.lit("trojan."), F.element_at("names", 1)["value"]).alias("suggested_threat_label"),
        ),
    )
    body = F.to_json(
        F.struct(
            F.struct(
                F.struct(
                    cls.alias("popular_threat_classification"),
                    F.when(F.col("o_orderpriority").startswith("2"), F.col("day")).alias("creation_date"),
                    (F.col("day") + 7).alias("last_submission_date"),
                    F.sha2(F.col("l_orderkey").cast("string"), 256).alias("sha256"),
                ).alias("attributes")
            ).alias("data")
        )
    )
    broken = F.col("o_orderpriority").startswith("1")
    return both.select(
        F.col("l_orderkey").cast("string").alias("id"),
        F.when(broken, F.substring(body, 1, 40)).otherwise(body).alias("text"),
    )


PRIORITY = "substr(o_orderpriority, 1, 1)"


@query(f"""WITH {REPORT_VOTES}, g AS (SELECT id, string_agg(value, ',' ORDER BY n DESC, value) AS names FROM v GROUP BY id)
  SELECT CAST(id AS VARCHAR) AS id, CASE WHEN {PRIORITY} NOT IN ('1', '5') THEN names END AS labels FROM g JOIN orders ON o_orderkey = id""")
def sc16_threat_names(spark, sf):
    votes = rp.threat_votes("text", "name")
    return threat_reports(spark, sf).select("id", joined(vt.top_labels(votes)).alias("labels"))


@query(f"""WITH {REPORT_VOTES}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, value) AS rn FROM v),
  g AS (SELECT id, string_agg(value, ',' ORDER BY rn) FILTER (rn <= 1) AS top, coalesce(string_agg(value, ',' ORDER BY rn) FILTER (n >= 2), '') AS vote, min(value) AS first FROM r GROUP BY id)
  SELECT CAST(id AS VARCHAR) AS id, unnest(['top', 'vote', 'label']) AS refine,
    CASE WHEN {PRIORITY} NOT IN ('1', '5') THEN unnest([top, vote, 'trojan.' || first]) END AS labels FROM g JOIN orders ON o_orderkey = id""")
def tk2_report_labels(spark, sf):
    reports = threat_reports(spark, sf)
    parts = {
        "top": lb.report_labels(reports, "name", "top", 1),
        "vote": lb.report_labels(reports, "name", "vote", 2),
        "label": lb.report_labels(reports, "label"),
    }
    return tagged_union({k: d.select("id", joined("labels").alias("labels")) for k, d in parts.items()}, "refine")


@query(f"""WITH {REPORT_VOTES} SELECT CAST(id AS VARCHAR) AS id, string_agg(value || '=' || n, ',' ORDER BY n DESC, value) AS votes FROM v GROUP BY id""")
def tk3_sort_votes(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    listed = counts.groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.sort_array(F.collect_list(F.struct("value", "count"))).alias("v"))
    text = F.transform(vt.sort_votes("v"), lambda x: F.concat(x["value"], F.lit("="), x["count"].cast("string")))
    return listed.select("id", joined(text).alias("votes"))


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN {PRIORITY} = '1' THEN NULL
  ELSE date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + CASE WHEN {PRIORITY} = '2' THEN 0 ELSE 7 END END AS seen
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def sc15_earliest_sighting(spark, sf):
    return threat_reports(spark, sf).select("id", rp.earliest_sighting("text").alias("seen"))


@query(f"""SELECT count(*) AS n, count(*) FILTER ({PRIORITY} = '1') AS n_differs FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def sc3_report_id_check(spark, sf):
    reports = threat_reports(spark, sf).select(rp.id_mismatch("text", F.sha2("id", 256)).alias("differs"))
    return reports.agg(F.count(F.lit(1)).alias("n"), F.count_if("differs").alias("n_differs"))


SCANS = """det AS (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'A' THEN 'recursive' WHEN 'N' THEN 'deep' ELSE 'heuristic' END AS mode,
    CASE l_linenumber WHEN 1 THEN 'Packer' WHEN 2 THEN 'Compiler' WHEN 3 THEN 'Protector' WHEN 4 THEN 'Cryptor' ELSE 'Library' END AS type,
    CASE WHEN l_quantity < 10 THEN '' WHEN l_quantity < 20 THEN 'Packer detected' ELSE 'P' || (l_suppkey % 7) END AS name, l_tax AS tax FROM lineitem),
  scans AS (SELECT id, mode, CASE WHEN min(tax) >= 0.07 THEN 'missing' WHEN min(tax) >= 0.06 THEN 'empty' WHEN min(tax) >= 0.05 THEN 'broken' ELSE 'ok' END AS state FROM det GROUP BY ALL),
  found AS (SELECT det.id, det.mode, type, name FROM det JOIN scans ON det.id = scans.id AND det.mode = scans.mode WHERE state = 'ok'),
  flags AS (SELECT s.id, s.mode, s.state, CASE WHEN s.state = 'ok' THEN coalesce(bool_or(f.type IN ('Packer', 'Protector', 'Cryptor')), FALSE) END AS obf,
    string_agg(DISTINCT CASE WHEN f.name = 'Packer detected' THEN 'Generic' ELSE f.name END, ',' ORDER BY CASE WHEN f.name = 'Packer detected' THEN 'Generic' ELSE f.name END)
      FILTER (f.type IN ('Packer', 'Protector', 'Cryptor') AND f.name <> '') AS packers
    FROM scans s LEFT JOIN found f ON s.id = f.id AND s.mode = f.mode GROUP BY s.id, s.mode, s.state)"""


def scanner_reports(spark, sf):
    """Scanner output per order and mode: log text around JSON, detections nested up to six levels, some reports unusable."""
    lines = table(spark, sf, "lineitem")
    mode = F.when(F.col("l_returnflag") == "A", "recursive").when(F.col("l_returnflag") == "N", "deep").otherwise("heuristic")
    number = F.col("l_linenumber")
    kind = F.when(number == 1, "Packer").when(number == 2, "Compiler").when(number == 3, "Protector").when(number == 4, "Cryptor").otherwise("Library")
    quantity = F.col("l_quantity")
    name = F.when(quantity < 10, "").when(quantity < 20, "Packer detected").otherwise(F.concat(F.lit("P"), F.col("l_suppkey") % 7))
    leaf = F.concat(F.lit('{"type":"'), kind, F.lit('","name":"'), name, F.lit('"}'))
    depth = F.when(number == 3, 1).when(number == 4, 6).otherwise(0)
    nested = F.concat(F.repeat(F.lit('{"values":['), depth), leaf, F.repeat(F.lit("]}"), depth))
    grouped = lines.groupBy(F.col("l_orderkey").alias("id"), mode.alias("mode")).agg(
        F.array_join(F.collect_list(nested), ",").alias("values"), F.min("l_tax").alias("tax")
    )
    body = F.concat(F.lit('scan started\n{"detects":[{"values":['), "values", F.lit("]}]}\ndone"))
    tax = F.col("tax")
    raw = F.when(tax >= 0.07, F.lit(None)).when(tax >= 0.06, "").when(tax >= 0.05, F.concat(F.lit('{"detects":['), "values", F.lit("}"))).otherwise(body)
    return grouped.select("id", "mode", raw.alias("raw"))


@query(f"WITH {SCANS} SELECT state, count(*) AS n FROM scans GROUP BY state")
def sc18_report_states(spark, sf):
    return scanner_reports(spark, sf).groupBy(rp.body_state("raw").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SCANS} SELECT id, mode, type, name FROM found")
def sc17_nested_detections(spark, sf):
    return packing.detections(scanner_reports(spark, sf), ["id", "mode"], "raw")


@query(f"WITH {SCANS} SELECT id, mode, obf AS is_obfuscated, CASE WHEN state = 'ok' THEN coalesce(packers, '') END AS packers FROM flags")
def ag7_consolidate(spark, sf):
    flags = packing.consolidate(scanner_reports(spark, sf), "id", "mode", "raw")
    return flags.select("id", "mode", "is_obfuscated", joined("packers").alias("packers"))


@query(f"""WITH {SCANS} SELECT id, bool_or(obf) AS is_packed, coalesce(bool_or(obf), FALSE) AS is_packed_or_false FROM flags GROUP BY id""")
def ag7_packing_map(spark, sf):
    flags = packing.consolidate(scanner_reports(spark, sf), "id", "mode", "raw")
    strict = packing.packing_map(flags, "id", "mode")
    return strict.withColumn("is_packed_or_false", packing.unknown_as_false("is_packed"))


@query(f"WITH {SCANS}, m AS (SELECT id, bool_or(obf) AS p FROM flags GROUP BY id) SELECT id FROM m WHERE NOT p")
def ag7_not_packed(spark, sf):
    flags = packing.consolidate(scanner_reports(spark, sf), "id", "mode", "raw")
    return packing.not_packed(packing.packing_map(flags, "id", "mode"), "id")


@query(f"""WITH {SCANS}, p AS (SELECT id, bool_or(obf) FILTER (mode = 'recursive') AS r, bool_or(obf) FILTER (mode = 'deep') AS d, bool_or(obf) FILTER (mode = 'heuristic') AS h FROM flags GROUP BY id),
  q AS (SELECT coalesce(r, FALSE) AS a, coalesce(d, FALSE) AS b, coalesce(h, FALSE) AS c, r IS NOT NULL AND d IS NOT NULL AS t FROM p),
  c AS (SELECT count(*) AS n, count(*) FILTER (NOT (a OR b OR c)) AS x0, count(*) FILTER (a AND b AND c) AS x1, count(*) FILTER (a OR b OR c) AS x2, count(*) FILTER (NOT (a OR b) AND c) AS x3,
    count(*) FILTER (a OR b) AS x4, count(*) FILTER ((a OR b) AND NOT c) AS x5, count(*) FILTER (t AND a = b) AS x6, count(*) FILTER (t AND a <> b) AS x7 FROM q),
  u AS (SELECT n AS total, unnest(['none', 'all', 'any', 'heuristic_only', 'signature', 'signature_only', 'agree', 'disagree']) AS outcome, unnest([x0, x1, x2, x3, x4, x5, x6, x7]) AS n FROM c)
  SELECT outcome, n, round(n / total, 6) AS share FROM u""")
def ag8_mode_agreement(spark, sf):
    return packing.mode_agreement(packing.consolidate(scanner_reports(spark, sf), "id", "mode", "raw"), "id", "mode")


@query(f"""WITH {SCANS} SELECT packer, count(DISTINCT id) AS n FROM (SELECT id, unnest(string_split(packers, ',')) AS packer FROM flags WHERE packers IS NOT NULL) GROUP BY packer""")
def ag8_packer_counts(spark, sf):
    return packing.packer_counts(packing.consolidate(scanner_reports(spark, sf), "id", "mode", "raw"), "id", "mode")


@query("SELECT doc_id, md5(text) AS digest, sha256(text) AS sha, sha256(text) <> sha256(lower(text)) AS differs FROM documents")
def sc3_digests(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", tx.digest("text").alias("digest"), tx.sha256("text").alias("sha"),
        tx.content_differs(F.lower("text"), tx.sha256("text")).alias("differs"),
    )


@query("""SELECT page_id, md5(regexp_replace(replace(replace(html, '<', '/*'), '>', '*/'), '/\\*.*?\\*/', '', 'gs')) AS digest FROM pages""")
def sc4_without_comments(spark, sf):
    """Markup rewritten to block comments, then removed."""
    commented = F.replace(F.replace("html", F.lit("<"), F.lit("/*")), F.lit(">"), F.lit("*/"))
    return table(spark, sf, "pages").select("page_id", F.md5(tx.without_block_comments(commented)).alias("digest"))


@query("""WITH t AS (SELECT doc_id, string_split(replace(text, ', ', chr(9)), chr(10)) AS lines FROM documents)
  SELECT doc_id, md5(array_to_string(list_transform(list_filter(lines, lambda x: contains(x, chr(9))), lambda x: trim(string_split(x, chr(9))[-1])), chr(10))) AS digest FROM t""")
def sc5_instructions(spark, sf):
    listing = F.replace("text", F.lit(", "), F.lit("\t"))
    return texts(spark, sf, "doc_id", "text").select("doc_id", F.md5(tx.instructions(listing)).alias("digest"))


@query("""SELECT doc_id, md5(regexp_replace(strip_accents(replace(text, 'ß', 'ss')), '[^\\x00-\\x7F]', '', 'g')) AS digest FROM documents""")
def sc6_to_ascii(spark, sf):
    return texts(spark, sf, "doc_id", "text").select("doc_id", F.md5(tx.to_ascii("text")).alias("digest"))


@query("""WITH b AS (SELECT doc_id, string_split(replace(text, '. ', '.' || chr(10)), chr(10) || chr(10)) AS blocks FROM documents)
  SELECT doc_id, md5(array_to_string(list_transform(blocks, lambda b: CASE WHEN contains(b, chr(10)) THEN substr(b, strpos(b, chr(10)) + 1) ELSE '' END), chr(10) || chr(10))) AS digest FROM b""")
def sc7_without_signatures(spark, sf):
    listing = F.replace("text", F.lit(". "), F.lit(".\n"))
    return texts(spark, sf, "doc_id", "text").select("doc_id", F.md5(tx.without_signatures(listing)).alias("digest"))


@query("""WITH t AS (SELECT doc_id, replace(replace('0x' || md5(text) || ' ' || lower(text), 'fun_', chr(2)), '0x', chr(3)) AS x FROM documents),
  p AS (SELECT doc_id, unnest(a) AS p, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, regexp_extract_all(x, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]') AS a FROM t)),
  m AS (SELECT *, CASE WHEN p = chr(3) THEN 'x' WHEN p = chr(2) THEN 'f' WHEN NOT regexp_matches(p, '[\\p{L}\\p{N}]') THEN 'o' END AS kind FROM p),
  s AS (SELECT *, coalesce(last_value(CASE kind WHEN 'x' THEN TRUE WHEN 'o' THEN FALSE END IGNORE NULLS) OVER w, FALSE) AS in_hex FROM m
    WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  u AS (SELECT *, in_hex OR coalesce(last_value(CASE WHEN kind = 'f' THEN TRUE WHEN p = '(' AND NOT in_hex THEN FALSE END IGNORE NULLS) OVER w, FALSE) AS up FROM s
    WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT doc_id, string_agg(CASE kind WHEN 'x' THEN '0x' WHEN 'f' THEN CASE WHEN up THEN 'FUN_' ELSE 'fun_' END WHEN 'o' THEN p ELSE CASE WHEN up THEN upper(p) ELSE p END END, '' ORDER BY i) AS listing
  FROM u GROUP BY doc_id""")
def sc8_capitalize_hex(spark, sf):
    listing = F.concat(F.lit("0x"), F.md5("text"), F.lit(" "), F.lower("text"))
    return texts(spark, sf, "doc_id", "text").select("doc_id", tx.capitalize_hex(listing).alias("listing"))


@query("""WITH c AS (SELECT doc_id, string_split(text, '') AS c FROM documents)
  SELECT doc_id, md5(array_to_string(list_filter(c, lambda x, i: i = 1 OR x <> c[i - 1]), '')) AS digest FROM c""")
def sc9_collapse_runs(spark, sf):
    return texts(spark, sf, "doc_id", "text").select("doc_id", F.md5(tx.collapse_runs("text", 2)).alias("digest"))


@query("""WITH b AS (SELECT doc_id, text, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents)
  SELECT doc_id, CAST(len(h) AS INT) AS n_latin1, md5(array_to_string(list_transform(h, lambda v: chr(CAST(10752 + ('0x' || v)::BIGINT AS INT))), '')) AS shown, TRUE AS same FROM b""")
def sc10_byte_text(spark, sf):
    """Bytes as Latin-1 text and as printable characters; both have one character per byte."""
    raw = F.col("text").cast("binary")
    shown = tx.printable_bytes(raw)
    same = F.encode(tx.latin1(raw), "ISO-8859-1") == raw
    return texts(spark, sf, "doc_id", "text").select(
        "doc_id", F.length(tx.latin1(raw)).alias("n_latin1"), F.md5(shown).alias("shown"), same.alias("same")
    )
