"""A vector index of inverted lists: k-means centroids, and vectors partitioned by their nearest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.vectors import dot, nearest

#: Vectors from which lists are made, lists at most, lists that a query reads.
LISTS_FROM, LISTS, PROBES = 1000, 100, 16


@dataclass
class Index:
    """centroids (list, v), or None for a flat index, and vectors (list, node_id, v), normalised."""

    centroids: DataFrame | None
    vectors: DataFrame


def build(nodes: DataFrame, lists: int | None = None, seed: int = 42) -> Index:
    """The index of nodes (node_id, v): flat up to LISTS_FROM vectors, else min(100, n / 10) lists."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from quern.functions.vectors import normalised

    unit = nodes.where("v is not null").select("node_id", normalised(F.col("v")).alias("v"))
    n = unit.count()
    if lists is None:
        lists = min(LISTS, n // 10) if n > LISTS_FROM else 0
    if lists < 2:
        return Index(None, unit.select(F.lit(0).alias("list"), "node_id", "v"))
    x = unit.withColumn("features", array_to_vector("v"))
    model = KMeans(k=lists, seed=seed, predictionCol="list").fit(x)
    centers = nodes.sparkSession.createDataFrame([(k, [float(y) for y in c]) for k, c in enumerate(model.clusterCenters())], "list int, v array<double>")
    return Index(centers, model.transform(x).select("list", "node_id", "v"))


def search(index: Index, queries: DataFrame, k: int, probes: int = PROBES) -> DataFrame:
    """query_id, node_id, score (cosine), rank: the k best of the lists that a query reads, itself left out.

    A query meets its lists by an equi join, so lists that no query reads aren't sent anywhere.
    """
    from quern.functions.vectors import normalised

    asked = queries.select("query_id", normalised(F.col("v")).alias("q"))
    if index.centroids is None:
        return nearest(index.vectors, queries, k, exclude_same=True)
    lists = nearest(index.centroids.select(F.col("list").alias("node_id"), "v"), queries, probes).select("query_id", F.col("node_id").cast("int").alias("list"))
    met = lists.join(asked, "query_id").join(index.vectors, "list").where(F.col("query_id") != F.col("node_id"))
    scored = met.select("query_id", "node_id", F.round(dot(F.col("q"), F.col("v")), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
