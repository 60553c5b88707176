"""Training logs and sweep logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sweep_rows(lines: DataFrame, text: str = "value") -> DataFrame:
    """Lines ``{kwds, results}`` as variants, with ``is_error`` true where the result is a string."""
    parsed = lines.select(F.try_parse_json(text).alias("v")).where("v is not null")
    results = F.variant_get("v", "$.results", "variant")
    return parsed.select(
        F.variant_get("v", "$.kwds", "variant").alias("kwds"),
        results.alias("results"),
        (F.schema_of_variant(results) == "STRING").alias("is_error"),
    )


def sweep_errors(rows: DataFrame) -> DataFrame:
    return rows.where("is_error").select(F.to_json("kwds").alias("kwds"), F.variant_get("results", "$", "string").alias("error"))


def sweep_table(rows: DataFrame, options: dict[str, str], results: dict[str, str]) -> DataFrame:
    """Successful runs with the named options and result fields as columns (name -> type)."""
    return rows.where("not is_error").select(
        *[F.variant_get("kwds", f"$.{k}", t).alias(k) for k, t in options.items()],
        *[F.variant_get("results", f"$.{k}", t).alias(k) for k, t in results.items()],
    )


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """``(run, ord, entry)`` with one row per log entry; ``entry`` maps metric names to numbers.

    A state file is named by the folder it lies in, as checkpoints are.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    state = F.from_json("value", "struct<log_history:array<map<string,double>>>")
    run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return files.select(run.alias("run"), state.alias("s")).select("run", F.posexplode("s.log_history").alias("ord", "entry"))


def training_rows(log: DataFrame) -> DataFrame:
    return log.where(F.map_contains_key("entry", "loss"))


def evaluation_rows(log: DataFrame) -> DataFrame:
    return log.where(F.map_contains_key("entry", "eval_loss"))
