"""Ingestion as one plan: chunks are analysed, gated, held against what is stored, decided on and applied; entities are registered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import extract, predicates, text
from quern.operators import ingest, joins

#: Least importance of a chunk that is stored, and least similarity that is a conflict.
GATE, CONFLICT = 0.2, 0.75


def analysed(body: Column) -> Column:
    """The default analysis of a text: type, urgency, keywords, entities, relationships and importance, without a model."""
    meta, kind = extract.metadata(body), text.knowledge_type(body, F.lit(0))
    critical = F.when(meta["urgency"] == "critical", 1.0).when(meta["urgency"] == "high", 0.7).otherwise(0.3)
    actionable = F.when(kind == "procedural", 0.9).otherwise(0.4)
    score = predicates.analysed_importance(critical, actionable, F.lit(0.5), F.lit(0.5), F.lit(1.0))
    return F.struct(kind.alias("kind"), meta["urgency"].alias("urgency"), text.frequency_keywords(body).alias("keywords"), extract.entities(body).alias("entities"), extract.relationships(body).alias("relationships"), F.round(score, 6).alias("importance"))


@dataclass
class Result:
    """The stored rows after the run, the decisions, the registered entities and relationships, and counts of the run."""

    stored: DataFrame
    decisions: DataFrame
    entities: DataFrame
    relationships: DataFrame
    stats: DataFrame


def chunk_id(doc_id: Column, pos: Column, body: Column) -> Column:
    """A number from the hash of a chunk's place and text."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, pos, body), 1)


def run(docs: DataFrame, stored: DataFrame, chunker: Callable[[Column], Column], analyse: Callable[[Column], Column] = analysed, gate: float = GATE, least: float = CONFLICT) -> Result:
    """docs (doc_id, text) into stored (node_id, text, version).

    All chunks are held against what was stored before the run, so the result doesn't depend on their order. A chunk
    that is similar to a stored one is decided on by its highest similarity; others are added.
    """
    from quern.store import materialised

    chunks = ingest.process(docs, chunker)
    found = materialised(chunks.select(chunk_id(F.col("doc_id"), F.col("pos"), F.col("text")).alias("node_id"), "doc_id", "text", "quality", analyse(F.col("text")).alias("a")).where(F.col("a.importance") >= gate))
    new = found.select("node_id", "text")
    both = new.select(F.struct(F.lit(1).alias("new"), "node_id").alias("id"), text.words(F.col("text")).alias("items")).union(stored.select(F.struct(F.lit(0).alias("new"), "node_id").alias("id"), text.words(F.col("text")).alias("items")))
    pairs = joins.set_similarity(both, least, top=None).where((F.col("id.new") == 1) & (F.col("other.new") == 0))
    decisions = materialised(ingest.decide(ingest.conflicts(pairs.select(F.col("id.node_id").alias("new_id"), F.col("other.node_id").alias("existing_id"), "similarity"), least)))
    entities = found.select("node_id", F.explode("a.entities").alias("e")).groupBy(F.concat("e.type", F.lit(":"), "e.name").alias("id")).agg(F.min("e.type").alias("type"), F.min("e.name").alias("name"), F.sort_array(F.collect_set("node_id")).alias("node_ids"))
    related = found.select(F.explode("a.relationships").alias("r")).select("r.source", "r.relation", "r.target").distinct()
    edges = related.select(F.substring(F.md5(F.concat_ws("|", "source", "relation", "target")), 1, 12).alias("id"), F.col("source").alias("src"), "relation", F.col("target").alias("dst"))
    stats = chunks.agg(F.count(F.lit(1)).alias("chunks")).join(F.broadcast(found.agg(F.count(F.lit(1)).alias("stored_or_merged"))))  # one row each
    return Result(ingest.apply_decisions(stored, new, decisions), decisions, entities, edges, stats)


def observed(retrieved: DataFrame, at: Column, least: float = 0.5) -> DataFrame:
    """One row a query to append to a log of retrievals (query_id, score): how many, the best score, and whether it is a success."""
    return retrieved.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best")).select("query_id", "n", "best", (F.col("best") > least).alias("success"), at.alias("at"))
