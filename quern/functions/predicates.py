"""Predicates and small lookups over nodes, entities and relationships, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scoring import TTL_DAYS, lookup, whole_days


def active(status: Column, expires_at: Column, as_of: Column) -> Column:
    """Neither archived nor deprecated nor expired."""
    return ~F.coalesce(status.isin("archived", "deprecated"), F.lit(False)) & (expires_at.isNull() | (expires_at > as_of))


def stale(since: Column, kind: Column, as_of: Column) -> Column:
    """Older than its type's lifetime, in whole days; unknown is stale."""
    return F.coalesce(whole_days(since, as_of) > lookup(TTL_DAYS, kind, 60), F.lit(True))


def valid(valid_from: Column, valid_until: Column, as_of: Column) -> Column:
    return (valid_from.isNull() | (valid_from <= as_of)) & (valid_until.isNull() | (as_of <= valid_until))


def matches_keywords(own: Column, wanted: Column, match_all: bool = False) -> Column:
    """Whether keywords overlap, or hold all that are wanted, whatever their case."""
    a, b = F.transform(own, lambda x: F.lower(x)), F.transform(wanted, lambda x: F.lower(x))
    return F.size(F.array_except(b, a)) == 0 if match_all else F.arrays_overlap(a, b)


def matches_name(wanted: Column, name: Column, display: Column, aliases: Column) -> Column:
    """Whether a name is part of an entity's name, display name or an alias, whatever their case."""
    w = F.lower(wanted)
    return F.coalesce(F.contains(F.lower(name), w), F.lit(False)) | F.coalesce(F.contains(F.lower(display), w), F.lit(False)) | F.coalesce(F.exists(aliases, lambda x: F.contains(F.lower(x), w)), F.lit(False))


def find_entities(entities: DataFrame, kind: str | None = None, name: str | None = None, exact: bool = False, tags: list[str] | None = None) -> DataFrame:
    """Rows of entities (type, name, display, aliases, tags) by type, name and tags, all of which must be there."""
    out = entities
    if kind is not None:
        out = out.where(F.col("type") == kind)
    if name is not None:
        out = out.where((F.lower("name") == name.lower()) if exact else matches_name(F.lit(name), F.col("name"), F.col("display"), F.col("aliases")))
    if tags:
        out = out.where(F.size(F.array_except(F.array(*map(F.lit, tags)), F.coalesce("tags", F.array().cast("array<string>")))) == 0)
    return out


def symptom_ratio(symptoms: Column, text: Column) -> Column:
    """The share of symptoms that a text names; 0 without symptoms."""
    t = F.lower(text)
    return F.coalesce(F.try_divide(F.size(F.filter(symptoms, lambda s: F.contains(t, F.lower(s)))).cast("double"), F.size(symptoms)), F.lit(0.0))


def expert_in(expertise: Column, topic: Column) -> Column:
    """Whether a topic is part of some expertise, whatever its case."""
    return F.coalesce(F.exists(expertise, lambda x: F.contains(F.lower(x), F.lower(topic))), F.lit(False))


def critical(tier: Column) -> Column:
    """Whether a service is of the highest tier."""
    return F.coalesce(F.upper(F.trim(tier)) == "P1", F.lit(False))


def by_importance(nodes: DataFrame, importance: str, least: float = 0.0, limit: int | None = None) -> DataFrame:
    """Nodes from an importance on, the most important first, ties by node_id."""
    out = nodes.where(F.col(importance) >= least).orderBy(F.desc(importance), "node_id")
    return out if limit is None else out.limit(limit)


def sampled(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by the md5 of seed and key: the same rows for the same table, in any order."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def built_importance(layer: Column, deepest: Column, text: Column, n_keywords: Column, boost: float = 0.1) -> Column:
    """(explicit, authority, keyword_boost) that a tree's build gives a node by its layer, length and keywords."""
    up = F.when(deepest > 0, boost * layer / deepest).otherwise(0.0)
    return F.struct((0.5 + up).alias("explicit"), (0.5 + up + 0.1 * F.least(F.lit(1.0), F.length(text) / 500)).alias("authority"), F.least(F.lit(0.2), 0.02 * n_keywords).alias("keyword_boost"))


def analysed_importance(criticality: Column, actionability: Column, authority: Column, uniqueness: Column, freshness: Column) -> Column:
    return 0.30 * criticality + 0.25 * actionability + 0.20 * authority + 0.15 * uniqueness + 0.10 * freshness
