"""Scores as Column expressions: importance, freshness, boosts, reranking, types and their lifetimes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the importance signals, by profile.
WEIGHTS = {
    "default": {"explicit": 0.25, "frequency": 0.15, "recency": 0.10, "authority": 0.15, "criticality": 0.15, "uniqueness": 0.05, "rating": 0.10, "outcome": 0.05},
    "incident": {"explicit": 0.20, "frequency": 0.10, "recency": 0.20, "authority": 0.10, "criticality": 0.25, "uniqueness": 0.05, "rating": 0.05, "outcome": 0.05},
    "onboarding": {"explicit": 0.30, "frequency": 0.20, "recency": 0.05, "authority": 0.20, "criticality": 0.05, "uniqueness": 0.05, "rating": 0.10, "outcome": 0.05},
}
#: Lifetime in days and volatility of a knowledge type.
TTL_DAYS = {"procedural": 90, "factual": 60, "relational": 30, "temporal": 365, "social": 30, "contextual": 1, "policy": 180, "meta": 7}
VOLATILITY = {"procedural": "low", "factual": "medium", "relational": "medium", "temporal": "high", "social": "medium", "contextual": "very_high", "policy": "low", "meta": "continuous"}
#: Synonyms of knowledge types.
SYNONYMS = {
    "procedural": "procedural runbook sop playbook how-to",
    "factual": "factual documentation docs api spec",
    "relational": "relational dependency architecture",
    "temporal": "temporal incident postmortem changelog",
    "social": "social team people contact",
    "contextual": "contextual live current",
    "policy": "policy compliance security sla",
    "meta": "meta",
}


def lookup(values: dict, key: Column, otherwise) -> Column:
    """The value of a key in a literal map."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key], F.lit(otherwise))


def parsed_type(name: Column) -> Column:
    """A knowledge type by name or synonym; factual if unknown."""
    return lookup({s: kind for kind, all_ in SYNONYMS.items() for s in all_.split()}, F.lower(F.trim(name)), "factual")


def whole_days(since: Column, as_of: Column) -> Column:
    """Whole days between two timestamps, rounded down."""
    return F.floor((F.unix_seconds(as_of) - F.unix_seconds(since)) / 86400)


def ratio(good: Column, bad: Column) -> Column:
    """good / (good + bad); 0.5 without any."""
    return F.coalesce(F.try_divide(good.cast("double"), good + bad), F.lit(0.5))


def importance(as_of: Column, profile: str = "default", most: int = 1000, content_ttl: int = 90, source_ttl: int = 30, **c: Column) -> Column:
    """The importance of a node, 0 to 1.

    c: explicit, authority, criticality, uniqueness (doubles), access_count, last_accessed, positive, negative, success,
    failure, updated_at, checked_at, boost (sum of contextual boosts). Null timestamps mean never.
    """
    signals = {
        "explicit": c["explicit"],
        "frequency": F.least(F.lit(1.0), c["access_count"] / most),
        "recency": F.when(c["last_accessed"].isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - whole_days(c["last_accessed"], as_of) / 30)),
        "authority": c["authority"],
        "criticality": c["criticality"],
        "uniqueness": c["uniqueness"],
        "rating": ratio(c["positive"], c["negative"]),
        "outcome": ratio(c["success"], c["failure"]),
    }
    w = WEIGHTS[profile]
    base = sum((signals[k] * F.lit(w[k]) for k in w), F.lit(0.0)) / F.lit(sum(w.values()))
    content = F.greatest(F.lit(0.0), 1 - whole_days(c["updated_at"], as_of) / content_ttl)
    source = F.when(c["checked_at"].isNull(), 0.3).otherwise(F.greatest(F.lit(0.0), 1 - whole_days(c["checked_at"], as_of) / source_ttl))
    decayed = base * (0.5 + 0.5 * (content + source) / 2)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), decayed * (1 + F.least(c["boost"], F.lit(0.5)))))


def freshness(age_days: Column) -> Column:
    """1 up to 7 days, 0.9 up to 30, then falling from 0.8 to 0.3 at 90, 0.3 beyond; 0.5 if unknown."""
    return F.when(age_days.isNull(), 0.5).when(age_days <= 7, 1.0).when(age_days <= 30, 0.9).when(age_days <= 90, 0.8 - (age_days - 30) / 60 * 0.5).otherwise(0.3)


def recency_boost(hours: Column, most: float = 0.2, window: float = 24.0) -> Column:
    """`most` for what is new, falling to 0 at the end of the window."""
    return F.when((hours >= 0) & (hours <= window), most * (1 - hours / window)).otherwise(0.0)


def context_boost(words: Column, context: Column) -> Column:
    """0.3 times what a context's shared words add, each 0.05 up to 0.2."""
    return 0.3 * F.least(F.lit(0.2), 0.05 * F.size(F.array_intersect(words, context)))


def rerank_score(similarity: Column, importance_: Column, fresh: Column) -> Column:
    return 0.4 * similarity + 0.3 * importance_ + 0.15 * fresh


def combined_score(score: Column, importance_: Column) -> Column:
    return 0.7 * score + 0.3 * importance_


def cross_encoder_blend(ce: Column, score: Column) -> Column:
    return 0.7 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), ce)) + 0.3 * score


def bm25_clamped(score: Column) -> Column:
    """A BM25 score as similarity: a tenth of it, at most 1."""
    return F.least(F.lit(1.0), score / 10)


def similarity_of_distance(squared: Column) -> Column:
    return 1 / (1 + squared)


def boosted(best: Column, hits: Column) -> Column:
    """A node's best score, a fifth more for each further hit, at most 1."""
    return F.least(F.lit(1.0), best * (1 + 0.2 * (hits - 1)))
