"""Connected components by alternating large and small stars, each round a written table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link to another; root is the component's least node.

    Links with a null end and links of a node to itself say nothing and are left out; repeated links count once. No
    node's neighbours are gathered: minima are taken by partial aggregation and joined back, and a round's table is
    written, so lost executors repeat one round at most.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    now = written(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v")).distinct(), "links")
    was = None
    while (state := _state(now)) != was:
        was = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "minima")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("m < u").select("u", F.col("m").alias("v"))).where("u > v").distinct()
        small_least = written(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(small_least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
