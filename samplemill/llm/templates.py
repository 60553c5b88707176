"""Dropping recurring lines by a log-template tree, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplemill.plans.session import cut

#: Leading tokens that lead to a leaf, after the token count.
DEPTH = 3
#: Documents in which a leaf, a constant field and a template must occur.
MIN_DOCS = 5
#: The share of a leaf's documents, in percent, that must have a constant field, and a template.
MIN_DOCS_PERCENT = 10
#: Constant fields that a template needs, and their share in percent: of all fields, and of the words that did not lead to the leaf.
MIN_CONSTANT, MIN_CONSTANT_PERCENT = 3, 50
FIELD = "<*>"


def masked_lines(text: Column) -> Column:
    """The lines with single blanks between their tokens, and a variable field for every token with a digit."""
    lines = F.split(text, "\n")
    # Most texts have neither odd white space nor digits, and their lines need no second look.
    single = F.when(
        text.rlike(r"[\t\x0B\f\r]| [ \n]|\n |^ | $"),
        F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[\x20\t\x0B\f\r]+", " "))),
    ).otherwise(lines)

    def fields(line: Column) -> Column:
        return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(line)

    return F.when(text.rlike("[0-9]"), F.transform(single, fields)).otherwise(single)


def _count(text: Column, mark: str) -> Column:
    """How often a one-byte character occurs."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))


def _leaf(line: Column, depth: int) -> Column:
    """The path to the leaf: the number of tokens, then the first of them."""
    return F.concat((_count(line, " ") + 1).cast("string"), F.lit(" "), F.substring_index(line, " ", depth))


def recurring_lines(docs: DataFrame, text_col: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(digest, positions)``: which lines of the text with that MD5 digest belong to recurring templates."""
    text = F.col(text_col)

    # 1. Leaves of the tree by documents: a small table of counts and leading tokens, numbered as it is written.
    # Leaves are plain text there, which is made distinct by hashing. An outer explode does not make the array twice.
    paths = F.array_distinct(F.transform(masked_lines(text), lambda x: _leaf(x, depth)))
    found = docs.select(F.explode_outer(paths).alias("path")).where("path <> '1 '").groupBy("path")
    found = found.agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs)
    # What a field or a template of the leaf must be found in: so many documents, and that share of the leaf's.
    least = F.greatest(F.lit(min_docs), F.ceil(F.col("docs") * MIN_DOCS_PERCENT / 100)).cast("long")
    leaves = cut(found.select("path", least.alias("least"), F.monotonically_increasing_id().alias("leaf")), "leaves")

    # 2. Lines in recurring leaves. Copies of a text are one row, so `copies` is the documents that have it.
    lines = docs.select(F.md5(text).alias("digest"), F.posexplode_outer(masked_lines(text)).alias("pos", "line"))
    lines = lines.where("line <> ''").withColumn("path", _leaf(F.col("line"), depth)).join(leaves.drop("least"), "path")
    lines = lines.groupBy("digest", "pos", "line", "leaf").agg(F.count(F.lit(1)).alias("copies"))
    lines = cut(lines, "lines")
    texts = cut(lines.groupBy("line", "leaf", "digest").agg(F.max("copies").alias("copies")), "texts-by-line")
    distinct = texts.groupBy("line", "leaf").agg(F.sum("copies").alias("docs"))
    # Counted here, per line: next to an explode this would be done again for every token.
    words = F.split("line", " ")
    rest = F.size(F.array_remove(F.slice(words, depth + 1, F.greatest(F.size(words) - depth, F.lit(0))), FIELD))
    distinct = distinct.select("*", F.size(words).alias("n"), rest.alias("rest"), F.monotonically_increasing_id().alias("id"))
    distinct = cut(distinct, "distinct-lines")

    # 3. Fields: in its leaf, a token stays at its place if enough documents have it there. A document with several
    # lines in a leaf counts once, so what it has too often is taken off again; few documents have such lines.
    place = F.posexplode_outer(words).alias("at", "token")
    tokens = distinct.select("id", "leaf", "docs", "n", "rest", place)
    tokens = tokens.where(F.col("token") != FIELD)
    several = texts.groupBy("leaf", "digest").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").drop("lines")
    repeated = texts.join(several, ["leaf", "digest"]).select("leaf", "digest", "copies", place)
    repeated = repeated.groupBy("leaf", "at", "token", "digest").agg(F.count(F.lit(1)).alias("m"), F.max("copies").alias("copies"))
    repeated = repeated.where("m > 1").select("leaf", "at", "token", (F.col("copies") * (1 - F.col("m"))).alias("docs"))
    constant = tokens.select("leaf", "at", "token", "docs").unionByName(repeated).groupBy("leaf", "at", "token").agg(F.sum("docs").alias("docs"))
    constant = constant.where(F.col("docs") >= min_docs).join(leaves.select("leaf", "least"), "leaf").where("docs >= least")
    fields = tokens.join(constant.drop("docs", "least"), ["leaf", "at", "token"]).groupBy("id", "leaf", "n", "rest")
    fields = fields.agg(
        F.sort_array(F.collect_list(F.struct("at", "token"))).alias("constants"), F.count_if(F.col("at") >= depth).alias("after")
    )
    size, share = F.size("constants"), F.lit(MIN_CONSTANT_PERCENT)
    enough = (size >= MIN_CONSTANT) & (100 * size >= share * F.col("n")) & (100 * F.col("after") >= share * F.col("rest"))
    fields = fields.where(enough)
    # The leaf and the constants make the template.
    fields = cut(fields.select("id", "leaf", F.md5(F.concat_ws("\n", "leaf", F.to_json("constants"))).alias("template")), "fields")

    # 4. Templates that enough documents have, and the lines under them.
    named = texts.join(distinct.select("line", "id"), "line").join(fields.drop("leaf"), "id")
    known = named.groupBy("template", "leaf", "digest").agg(F.max("copies").alias("copies"))
    templates = known.groupBy("template", "leaf").agg(F.sum("copies").alias("docs")).where(F.col("docs") >= min_docs)
    templates = templates.join(leaves.select("leaf", "least"), "leaf").where("docs >= least").select("template")
    recurring = fields.join(templates, "template", "left_semi").join(distinct, "id").select("line")
    dropped = lines.join(cut(recurring, "recurring"), "line", "left_semi")
    return cut(dropped.groupBy("digest").agg(F.collect_set("pos").alias("positions")), "dropped")


def drop_recurring_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS
) -> DataFrame:
    """``(id_col, text_col, n_lines, n_dropped)``, one row per row of ``docs``: the texts without recurring lines.

    Lines end at a line feed; tokens are separated by other ASCII white space. A tree of fixed depth parses every
    line: the number of tokens, then the first ``depth`` tokens, lead to a leaf; tokens with a digit are variable
    fields. In a leaf that at least ``min_docs`` documents reach, a token is a constant of its place if that many
    documents, and a tenth of the leaf's, have a line with it there, and a variable field otherwise. Lines with the
    same token count and the same constants are one template. All lines of a template are dropped, everywhere, if
    at least ``min_docs`` documents and a tenth of the leaf's have one, at least three fields and half of all fields
    are constants, and so are half of the words after those that lead to the leaf: these are constant in any leaf, and
    lines that only begin alike are no template.

    A NULL text stays NULL with 0 lines; an empty text has one empty line. Lines without a token are kept. Each
    row counts as a document, repeated rows and rows with a NULL id too. Other columns are not read. An empty
    table gives no rows.
    """
    dropped = recurring_lines(docs, text_col, depth, min_docs).withColumnRenamed("digest", "_key")
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.md5(F.col(text_col)).alias("_digest"))
    out = named.join(dropped, F.col("_digest") == F.col("_key"), "left")
    lines = F.split("_text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("positions"))
    text = F.when(F.col("positions").isNull(), F.col("_text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n")
    )
    return out.select(
        F.col("_id").alias(id_col),
        text.alias(text_col),
        F.coalesce(_count(F.col("_text"), "\n") + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("positions"), F.lit(0)).cast("long").alias("n_dropped"),
    )
