"""Session settings the engine expects: UTC, adaptive execution, ANSI arithmetic."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Applies SETTINGS to a running session and returns it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def read(spark: SparkSession, sf_dir: str, name: str):
    """The Parquet table `name` of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df):
    """A table of fewer files than there are cores, dealt over all cores before costly work on its rows; others as they are.

    Where Spark reads it in more parts than cores (of 128 MB by default), a task takes a quarter of a part, so that tasks don't grow with the table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    parts = df.rdd.getNumPartitions()
    return df.repartition(cores if parts <= cores else 4 * parts)
