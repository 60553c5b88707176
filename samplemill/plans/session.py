"""Session settings and the shared working folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(name: str = "samplemill", cores: str = "*", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    It is the one that the cluster names in ``spark.checkpoint.dir``; where that is unset, a folder in the
    warehouse, which executors share as well. A cluster whose warehouse is a folder of the machine must name one.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_samplemill"
    if not spark.sparkContext.master.startswith("local") and _scheme(spark, path) == "file":
        raise RuntimeError(f"{path} is a folder of one machine: set {CHECKPOINT_KEY} to a folder that all executors share")
    return path


def _scheme(spark: SparkSession, path: str) -> str:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _hadoop_path(spark, path, lambda fs, p: fs.deleteOnExit(p))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    _hadoop_path(spark, path, lambda fs, p: fs.delete(p, True))


def _hadoop_path(spark: SparkSession, path: str, do: Callable) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    do(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Iterative operators call this each round: the lineage stays short, the rows outlive a
    lost executor, and the plan of the next round starts from a plain Parquet scan.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
