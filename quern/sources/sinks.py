"""Sinks: submissions as JSON, resumable batches, trees by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def submission(ranked: DataFrame, most: int = 5) -> DataFrame:
    """qid, answer, json of ranked (qid, id, rank): a query's ids in rank order, at most `most`."""
    kept = ranked.where(F.col("rank") <= most).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id")))), lambda s: s["id"]).alias("answer"))
    return kept.withColumn("json", F.to_json(F.struct("answer")))


def append_pending(todo: DataFrame, done_path: str, key: str, compute) -> None:
    """Computes and appends what isn't in the Parquet folder yet; run again after a failure it goes on where it was."""
    spark = todo.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(done_path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        todo = todo.join(spark.read.parquet(done_path).select(key).distinct(), key, "left_anti")
    compute(todo).write.mode("append").parquet(done_path)


def save_tree(nodes: DataFrame, path: str) -> None:
    """Nodes by tree and layer, so that one tree or layer is read by itself."""
    nodes.write.mode("overwrite").partitionBy("tree_id", "layer").parquet(path)


def load_tree(spark, path: str, tree_id: str | None = None, layer: int | None = None) -> DataFrame:
    """A tree, or all of a forest; tree and layer are partitions, so others' files aren't read."""
    rows = spark.read.parquet(path)
    if tree_id is not None:
        rows = rows.where(F.col("tree_id") == tree_id)
    return rows if layer is None else rows.where(F.col("layer") == layer)


def list_trees(spark, path: str) -> DataFrame:
    """tree_id, nodes, layers of a forest."""
    return spark.read.parquet(path).groupBy("tree_id").agg(F.count(F.lit(1)).alias("nodes"), F.max("layer").alias("layers"))


def typed_nodes(nodes: DataFrame, boost: float = 0.1) -> DataFrame:
    """Nodes (tree_id, node_id, text, layer) with knowledge type, content hash and the importance that their layer gives."""
    from pyspark.sql import Window

    from quern.functions import text

    deepest = F.max("layer").over(Window.partitionBy("tree_id"))
    up = F.when(deepest > 0, boost * F.col("layer") / deepest).otherwise(0.0)
    return nodes.select("*", text.knowledge_type(F.col("text"), F.col("layer")).alias("kind"), text.content_hash(F.col("text")).alias("content_hash"), (0.5 + up).alias("importance"))
