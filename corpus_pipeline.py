"""The corpus pipeline: from documents to packed training sequences, stage by stage.

Every stage takes all that the one before it kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplemill.llm import exact, language, packing, secrets, similar
from samplemill.llm.workers import free_names
from samplemill.plans.session import cut

#: A document is rejected if no language has so large a share of its letters.
MIN_LANGUAGE_SHARE = 0.5
#: Bytes of encoded words that a Python worker keeps while packing: workers here have other stages behind them.
CACHE = 40 << 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or without a main language; ``lang`` becomes the language found.

    NULL and empty texts go. Repeated rows, NULL ids and other columns stay as they are; where nothing is labelled, and
    from an empty table, no row stays.
    """
    found, share, spans = free_names(docs.columns, "_language", "_language_share", "_language_spans")
    labelled = language.with_language(docs, language.train(docs), names=(found, share, spans))
    kept = labelled.where((F.col(found) != language.UNKNOWN) & (F.col(share) >= MIN_LANGUAGE_SHARE))
    return kept.withColumn("lang", F.col(found)).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest stays, then the one with the smallest id.

    A NULL text counts as empty, an id goes before NULL, and of repeated rows one stays. An empty table stays empty.
    """
    return exact.drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with a similarity of 0.8 or more over five-word shingles, the one with the smallest id stays.

    Texts without a word (NULL too) all stay, and equal rows stay or go together. An empty table stays empty.
    """
    return similar.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are masked, and ``n_chars`` is that of the masked text.

    NULL and empty texts and repeated rows stay as they are. An empty table stays empty.
    """
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids with the sources in proportion; one row per piece.

    A NULL text is packed as its end id alone, repeated rows like all others. An empty table gives no rows.
    """
    return packing.pack(docs, cache=CACHE)


STAGES = [
    ("language id", language_id),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("secret scan", secret_scan),
    ("packing", pack),
]
#: The stages learn models and use tokenizers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
