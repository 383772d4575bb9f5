"""Folders that driver and executors share, and tables written there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which is set here only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", root)
    out = f"{root.rstrip('/')}/engine-{uuid.uuid4().hex}"
    atexit.register(_removed, spark, out)
    return out


def _removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder when the driver ends, if the session still runs."""
    context = spark.sparkContext
    if context._jsc is not None and not context._jsc.sc().isStopped():
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def materialised(df: DataFrame) -> DataFrame:
    """df as a table of the shared folder: what reads it more than once doesn't compute it again, also after executors are lost."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
