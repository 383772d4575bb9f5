"""Rank fusion, diversity, budgets and other operators over ranked candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the lists, for a single query and for a batch, and the rank constants.
LEGAL_K, HYBRID_K = 30, 60
LEGAL_WEIGHTS = {"single": {"bm25": 1.0, "dense": 1.5, "graph": 1.0}, "batch": {"bm25": 1.0, "dense": 1.8, "graph": 0.7}}
HYBRID_WEIGHTS = {"bm25": 0.4, "dense": 0.6}


def ranked(df: DataFrame, by: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """Adds 1-based ranks within each combination of `by`."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def reciprocal_rank(lists: dict[str, DataFrame], weights: dict[str, float], k: int) -> DataFrame:
    """query_id, node_id, score: the sum over lists (query_id, node_id, rank) of weight / (k + rank), to 6 places.

    A union and one aggregation: a node that a list lacks adds nothing, so no outer join is needed.
    """
    parts = [d.select("query_id", "node_id", (F.lit(weights[name]) / (F.lit(k) + F.col("rank"))).alias("s")) for name, d in lists.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "node_id").agg(F.round(F.sum("s"), 6).alias("score"))


def rank_votes(lists: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """query_id, node_id, score: each list votes (1 - (rank - 1) / size) * weight; the sum is divided by the number of lists."""
    parts = []
    for name, d in lists.items():
        size = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
        parts.append(d.select("query_id", "node_id", ((1 - (F.col("rank") - 1) / size) * F.lit(weights[name])).alias("s")))
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "node_id").agg(F.round(F.sum("s") / len(lists), 6).alias("score"))


def best_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return ranked(df, keys, order, "_first").where("_first = 1").drop("_first")


def diverse(df: DataFrame, source: str = "source", most: int = 3, k: int | None = None, by: str = "query_id") -> DataFrame:
    """Rows (with rank) of which each source has at most `most` per query, ranked anew; the k first."""
    kept = ranked(df, [by, source], [F.col("rank")], "_n").where(F.col("_n") <= most).drop("_n")
    out = ranked(kept.withColumnRenamed("rank", "_was"), [by], [F.col("_was")]).drop("_was")
    return out if k is None else out.where(F.col("rank") <= k)


def within_budget(df: DataFrame, tokens: str = "tokens", most: int = 3500, by: str = "query_id", overshoot: bool = False) -> DataFrame:
    """Rows in rank order while their tokens fit; with `overshoot` also the one that goes beyond. Adds `cum`."""
    w = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = df.withColumn("cum", F.sum(tokens).over(w))
    return total.where(F.col("cum") - F.col(tokens) <= most) if overshoot else total.where(F.col("cum") <= most)


def union_max(lists: list[DataFrame], keys: list[str], score: str = "score") -> DataFrame:
    """The union of candidates with the largest score of each key, and `strategy` of the row that has it (first by name)."""
    whole = reduce(DataFrame.unionByName, lists)
    return whole.groupBy(*keys).agg(F.max(score).alias(score), F.min_by("strategy", F.struct(-F.col(score), "strategy")).alias("strategy"))


def union_first(lists: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of candidates; of a key the row of the first list, and there the best."""
    whole = reduce(DataFrame.unionByName, (d.withColumn("_list", F.lit(k)) for k, d in enumerate(lists)))
    return best_per(whole, keys, [F.col("_list"), F.desc("score")]).drop("_list")
