"""Retrieval quality: recall and precision, and the macro average over labelled queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(qrels: DataFrame, predictions: DataFrame, most: int = 5) -> DataFrame:
    """qid, n_gt, n_pred, hits, recall, precision, violated of qrels (qid, answer) and predictions (qid, answer), arrays of ids.

    Every labelled query comes back. More than `most` predictions are a violation, count 0 and come before the other
    rules; no predictions count 0; a query without labels is skipped (null).
    """
    got = predictions.select("qid", F.col("answer").alias("pred"))
    met = qrels.select("qid", F.array_distinct(F.coalesce("answer", F.array().cast("array<string>"))).alias("gt")).join(got, "qid", "left")
    n_pred = F.coalesce(F.size(F.coalesce("pred", F.array().cast("array<string>"))), F.lit(0))
    sized = met.select("qid", F.size("gt").alias("n_gt"), n_pred.alias("n_pred"), F.size(F.array_intersect("gt", F.coalesce("pred", F.array().cast("array<string>")))).alias("hits"))
    over = F.col("n_pred") > most
    recall = F.when(over, 0.0).when(F.col("n_gt") == 0, None).when(F.col("n_pred") == 0, 0.0).otherwise(F.col("hits") / F.col("n_gt"))
    precision = F.when(over, 0.0).when(F.col("n_gt") == 0, None).when(F.col("n_pred") == 0, 0.0).otherwise(F.col("hits") / F.col("n_pred"))
    return sized.select("*", recall.alias("recall"), precision.alias("precision"), over.alias("violated"))


def macro(per_query_: DataFrame) -> DataFrame:
    """One row: recall, precision, n, violated."""
    return per_query_.agg(F.round(F.coalesce(F.avg("recall"), F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(F.avg("precision"), F.lit(0.0)), 6).alias("precision"), F.count("recall").alias("n"), F.count_if("violated").alias("violated"))


def at_k(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """qid, recall, precision at k of ranked (qid, id, rank) against relevant (qid, id): hits over labels, and over min(k, rows)."""
    top = ranked.where(F.col("rank") <= k)
    n_gt = relevant.distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("n_gt"))
    n_top = top.groupBy("qid").agg(F.count(F.lit(1)).alias("n_top"))
    hits = top.select("qid", "id").distinct().join(relevant.distinct(), ["qid", "id"]).groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    met = n_gt.join(n_top, "qid", "left").join(hits, "qid", "left").fillna(0, ["n_top", "hits"])
    return met.select("qid", F.round(F.col("hits") / F.col("n_gt"), 6).alias("recall"), F.round(F.coalesce(F.try_divide(F.col("hits").cast("double"), F.least(F.lit(k), F.col("n_top"))), F.lit(0.0)), 6).alias("precision"))
