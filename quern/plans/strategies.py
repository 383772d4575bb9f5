"""Retrieval strategies over whole tables of queries: each is a plan from queries (query_id, text) to candidates (query_id, node_id, score).

A strategy takes `search`, a function from queries to candidates; it runs once on all variants of all queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import scoring, text
from quern.operators import fusion
from quern.store import materialised

Search = Callable[[DataFrame], DataFrame]
#: What a query is reworded with, by intent; strategies by intent; share of graph and tree.
REWORDED = {"procedural": "steps procedure guide ", "troubleshooting": "error fix solution ", "relational": "owner team responsible "}
ROUTES = {"procedural": ["hyde", "hybrid", "adaptive_depth", "bm25_hybrid"], "relational": ["hyde", "hybrid", "query_decomposition", "bm25_hybrid"], "troubleshooting": ["hyde", "incident", "bm25_hybrid"]}
OTHER_ROUTE = ["hyde", "multi_query", "hybrid", "query_decomposition", "bm25_hybrid"]
MODES = {"fast": ["adaptive_depth"], "incident": ["incident"], "thorough": ["multi_query", "hyde", "hybrid", "query_decomposition"]}
GRAPH, GRAPH_SCORE, TREE = 0.4, 0.8, 0.6
#: What a document that answers a query of an intent may look like, around the query's keywords.
HYPOTHESES = {
    "procedural": """## Procedure: {keywords}

### Prerequisites
- Access to the relevant system
- Required permissions configured

### Steps
1. First, verify the current state of {keywords}
2. Make the necessary configuration changes
3. Apply and validate the changes
4. Monitor for any issues

### Troubleshooting
If issues occur, check the logs and rollback if necessary.""",
    "troubleshooting": """## Troubleshooting: {keywords}

### Symptoms
- Service degradation or errors related to {keywords}
- Alert triggered from monitoring

### Root Causes
1. Configuration drift or misconfiguration
2. Resource exhaustion (CPU, memory, disk)
3. Network connectivity issues
4. Dependency service failures

### Resolution Steps
1. Check service logs: `kubectl logs` or CloudWatch
2. Verify configuration matches expected state
3. Check resource utilization metrics
4. Restart affected components if needed

### Prevention
Set up monitoring and alerting for early detection.""",
    "other": """## {keywords}

### Overview
This documentation covers {keywords} and related concepts.

### Key Information
- Primary purpose and functionality
- Integration points with other systems
- Configuration options and best practices

### Related Topics
- Dependencies and requirements
- Monitoring and observability
- Common operations and maintenance tasks""",
}
#: Places of a score: more than products of rounded scores and shares have, so that none is rounded at a half.
PLACES = 10


def variants(query: Column) -> Column:
    """A query, its keywords, and these with its intent's words; without repeats."""
    keys = F.array_join(text.query_keywords(query), " ")
    reworded = F.lit(None).cast("string")
    for name, lead in REWORDED.items():
        reworded = F.when(text.intent(query) == name, F.concat(F.lit(lead), keys)).otherwise(reworded)
    return F.array_distinct(F.filter(F.array(query, F.when(keys != "", keys), reworded), lambda x: x.isNotNull()))


def _searched(queries: DataFrame, texts: Column, search: Search) -> DataFrame:
    """Candidates of all texts of each query, with the number of the text (v)."""
    each = queries.select("query_id", F.posexplode(texts).alias("v", "text")).select((F.struct("query_id", "v")).alias("key"), "text")
    numbered = each.select(F.xxhash64("key.query_id", "key.v").alias("query_id"), "text", F.col("key.query_id").alias("q"), F.col("key.v").alias("v"))
    found = search(numbered.select("query_id", "text"))
    return found.join(numbered.select("query_id", "q", "v"), "query_id").select(F.col("q").alias("query_id"), "v", "node_id", "score")


def multi_query(queries: DataFrame, search: Search) -> DataFrame:
    """The best score of each node over a query's variants."""
    return _searched(queries, variants(F.col("text")), search).groupBy("query_id", "node_id").agg(F.max("score").alias("score"))


def hyde(queries: DataFrame, search: Search, hypotheses: Column) -> DataFrame:
    """Nodes by hypothetical answers: 0.9 of the first hit's score and 0.1 more for each further one, at most 1; the query itself fills gaps."""
    hits = _searched(queries, hypotheses, search).groupBy("query_id", "node_id").agg(F.min_by("score", "v").alias("first"), F.count(F.lit(1)).alias("n"))
    by = hits.select("query_id", "node_id", F.least(F.lit(1.0), 0.9 * F.col("first") + 0.1 * (F.col("n") - 1)).alias("score"))
    own = search(queries.select("query_id", "text")).select("query_id", "node_id", "score")
    return fusion.union_first([by, own], ["query_id", "node_id"])


def decomposition(queries: DataFrame, search: Search, parts: Column) -> DataFrame:
    """Nodes by sub-queries: the best score, a fifth more for each further hit, at most 1."""
    hits = _searched(queries, parts, search).groupBy("query_id", "node_id").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n"))
    return hits.select("query_id", "node_id", scoring.boosted(F.col("best"), F.col("n")).alias("score"))


def hypotheses(query: Column) -> Column:
    """The text that HYDE searches by where no model writes one: its intent's template around the query's keywords, or the query if it has none."""
    keys = F.array_join(text.query_keywords(query), " ")
    template = F.lit(HYPOTHESES["other"])
    for name in ("troubleshooting", "procedural"):
        template = F.when(text.intent(query) == name, F.lit(HYPOTHESES[name])).otherwise(template)
    return F.array(F.replace(template, F.lit("{keywords}"), F.when(keys != "", keys).otherwise(query)))


def with_sub_queries(query: Column) -> Column:
    """A query and its clauses, each once."""
    return F.array_distinct(F.concat(F.array(query), sub_queries(query)))


def sub_queries(query: Column) -> Column:
    """A query's clauses between `and`, `or`, commas and question marks; the query itself if it has one."""
    return F.filter(F.transform(F.split(query, r"(?i)\s+(?:and|or)\s+|[,;?]\s*"), lambda x: F.trim(x)), lambda x: x != "")


def hybrid(graph_nodes: DataFrame, tree_hits: DataFrame) -> DataFrame:
    """Nodes linked in the graph (query_id, node_id) and tree candidates: their scores by share, summed."""
    a = graph_nodes.select("query_id", "node_id").distinct().withColumn("score", F.lit(GRAPH * GRAPH_SCORE))
    b = tree_hits.select("query_id", "node_id", (TREE * F.col("score")).alias("score"))
    return a.unionByName(b).groupBy("query_id", "node_id").agg(F.round(F.sum("score"), PLACES).alias("score"))


def adaptive_depth(queries: DataFrame, search_layer: Callable[[DataFrame, int], DataFrame], deepest: int, k: int) -> DataFrame:
    """query_id, node_id, score, layer: from a start by intent, queries stop where the mean score is 0.7, go up below 0.3, else down.

    Each round searches the queries that stand at each layer; a layer is visited once, so at most `deepest` + 1 rounds run.
    What middling layers found is kept. A round's queries and what they found are written, as each is read several times
    and plans would else hold all earlier rounds as often.
    """
    intent = text.intent(F.col("text"))
    start = F.when(intent.isin("factual", "troubleshooting"), 0).when(intent == "exploratory", 2).otherwise(1)
    at = queries.select("query_id", "text", F.least(start, F.lit(deepest)).alias("layer")).withColumn("seen", F.array("layer"))
    kept = None
    for _ in range(deepest + 1):
        at = materialised(at)
        if kept is not None and at.isEmpty():
            break
        found = None
        for layer in range(deepest + 1):
            part = search_layer(at.where(F.col("layer") == layer).select("query_id", "text"), layer).withColumn("layer", F.lit(layer))
            found = part if found is None else found.unionByName(part)
        found = materialised(found)
        means = found.groupBy("query_id").agg(F.avg("score").alias("mean"))
        met = at.join(means, "query_id", "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))
        good = met.where("mean >= 0.3").select("query_id")
        got = found.join(good, "query_id", "left_semi")
        kept = got if kept is None else kept.unionByName(got)
        to = F.when(F.col("mean") < 0.3, F.col("layer") + 1).otherwise(F.col("layer") - 1)
        at = met.where("mean < 0.7").withColumn("layer", to).where((F.col("layer") >= 0) & (F.col("layer") <= deepest) & ~F.array_contains("seen", F.col("layer"))).select("query_id", "text", "layer", F.array_append("seen", F.col("layer")).alias("seen"))
    best = fusion.best_per(kept, ["query_id", "node_id"], [F.desc("score"), F.col("layer")])
    return fusion.ranked(best, ["query_id"], [F.desc("score"), F.col("node_id")]).where(F.col("rank") <= k).select("query_id", "node_id", "score", "layer")


def routed(queries: DataFrame, mode: str = "standard") -> DataFrame:
    """query_id, text, strategy: one row for each strategy that a query takes by mode, intent and urgency."""
    q = F.col("text")
    if mode in MODES:
        list_ = F.array(*map(F.lit, MODES[mode]))
    else:
        list_ = F.array(*map(F.lit, OTHER_ROUTE))
        for name, route in ROUTES.items():
            list_ = F.when(text.intent(q) == name, F.array(*map(F.lit, route))).otherwise(list_)
        list_ = F.when((text.intent(q) == "troubleshooting") & (text.urgency(q) > 0.7), F.array(F.lit("incident"))).otherwise(list_)
    return queries.select("query_id", "text", F.explode(list_).alias("strategy"))


def retrieve(queries: DataFrame, strategies: dict[str, Search], nodes: DataFrame, k: int = 10, mode: str = "standard", least: float | None = None, source: str | None = None, most_layer: int | None = None) -> DataFrame:
    """query_id, node_id, score, strategy, rank: every strategy on the queries routed to it, merged, filtered and reranked.

    Strategies give up to three times k candidates by their score; a node keeps its best. nodes (node_id, importance,
    source, layer) add the importance that the final score blends in. Filters come after the merge.
    """
    k = min(k, 50)
    todo = routed(queries, mode)
    lists = []
    for name, strategy in strategies.items():
        got = strategy(todo.where(F.col("strategy") == name).select("query_id", "text")).select("query_id", "node_id", F.col("score").cast("double").alias("score"))
        top = fusion.ranked(got, ["query_id"], [F.desc("score"), F.col("node_id")]).where(F.col("rank") <= 3 * k)
        lists.append(top.select("query_id", "node_id", "score", F.lit(name).alias("strategy")))
    met = fusion.union_max(lists, ["query_id", "node_id"]).join(nodes, "node_id")
    if least is not None:
        met = met.where(F.col("score") >= least)
    if source is not None:
        met = met.where(F.col("source") == source)
    if most_layer is not None:
        met = met.where(F.col("layer") <= most_layer)
    scored = met.withColumn("score", F.round(scoring.combined_score(F.col("score"), F.col("importance")), PLACES))
    return fusion.ranked(scored, ["query_id"], [F.desc("score"), F.col("node_id")]).where(F.col("rank") <= k).select("query_id", "node_id", "score", "strategy", "rank")


def cited_context(ranked: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, context, citations of ranked (query_id, node_id, rank) and nodes (node_id, text, source): each source numbered as it is first met."""
    from pyspark.sql import Window

    from quern.operators.joins import looked_up

    met = looked_up(ranked, nodes).withColumn("first", F.min("rank").over(Window.partitionBy("query_id", "source")))
    numbered = met.withColumn("n", F.when(F.col("source").isNotNull(), F.dense_rank().over(Window.partitionBy("query_id", F.col("source").isNull()).orderBy("first"))))
    short = F.when(F.length("source") > 80, F.concat(F.substring("source", 1, 77), F.lit("..."))).otherwise(F.col("source"))
    flat = F.regexp_replace("text", r"[\r\n]+", " ")
    part = F.when(F.col("n").isNull(), flat).otherwise(F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), short, F.lit("\n"), flat))
    rows = numbered.select("query_id", F.struct("rank", part.alias("p"), "n", "source").alias("r"))
    whole = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    cites = F.array_sort(F.array_distinct(F.transform(F.filter("r", lambda x: x["n"].isNotNull()), lambda x: F.struct(x["n"].alias("n"), x["source"].alias("source")))))
    return whole.select("query_id", F.array_join(F.transform("r", lambda x: x["p"]), "\n\n").alias("context"), cites.alias("citations"))


#: Least similarity of runbooks and incidents, scores of services and of what they depend on, and how many of these.
RUNBOOK, INCIDENT, SERVICE, DEPENDENCY, DEPENDENCIES = 0.4, 0.5, 0.7, 0.5, 3


def incident_aware(queries: DataFrame, runbooks: DataFrame, incidents: DataFrame, services: DataFrame, dependencies: DataFrame, tree: DataFrame, fallback: DataFrame) -> DataFrame:
    """query_id, node_id, score, strategy for queries (query_id, text).

    Troubleshooting queries take runbooks and resolved incidents (query_id, node_id, score) that are similar enough,
    the services they name (query_id, node_id), three of what those depend on (node_id, depends_on), and tree
    candidates, the first branch winning; other queries take `fallback` candidates.
    """
    trouble = queries.where(text.intent(F.col("text")) == "troubleshooting").select("query_id")
    named = services.select("query_id", "node_id").distinct()
    deps = named.join(dependencies, "node_id").select("query_id", F.col("depends_on").alias("node_id")).distinct()
    few = fusion.ranked(deps, ["query_id"], [F.col("node_id")]).where(F.col("rank") <= DEPENDENCIES)
    branches = [
        runbooks.where(F.col("score") > RUNBOOK).select("query_id", "node_id", "score", F.lit("runbook").alias("strategy")),
        incidents.where(F.col("score") > INCIDENT).select("query_id", "node_id", "score", F.lit("incident").alias("strategy")),
        named.select("query_id", "node_id", F.lit(SERVICE).alias("score"), F.lit("service").alias("strategy")),
        few.select("query_id", "node_id", F.lit(DEPENDENCY).alias("score"), F.lit("dependency").alias("strategy")),
        tree.select("query_id", "node_id", "score", F.lit("tree").alias("strategy")),
    ]
    met = fusion.union_first([b.join(trouble, "query_id", "left_semi") for b in branches], ["query_id", "node_id"])
    rest = fallback.join(trouble, "query_id", "left_anti").select("query_id", "node_id", "score", F.lit("hybrid").alias("strategy"))
    return met.select("query_id", "node_id", "score", "strategy").unionByName(rest)


#: What a matching symptom and a shared word add where no vectors are there, and least shared words of an incident.
SYMPTOM_HIT, WORD_HIT, LEAST_WORDS = 0.3, 0.2, 2


def runbooks_by_symptoms(queries: DataFrame, runbooks: DataFrame) -> DataFrame:
    """query_id, node_id, score of runbooks (node_id, symptoms) where there are no vectors: 0.3 for each symptom of which a query holds a word, at most 1.

    The symptoms' different words meet the queries as substrings; what they belong to is joined after.
    """
    from quern.operators.joins import substring_matches

    each = runbooks.select("node_id", F.posexplode("symptoms").alias("symptom", "t")).select("node_id", "symptom", F.explode(F.array_distinct(text.words(F.col("t")))).alias("key"))
    asked = queries.select("query_id", F.lower("text").alias("low"))
    met = substring_matches(each.select("key").distinct(), asked, F.col("key"), F.col("low")).select("query_id", "key").distinct()
    hits = met.join(each, "key").select("query_id", "node_id", "symptom").distinct().groupBy("query_id", "node_id").agg(F.count(F.lit(1)).alias("n"))
    return hits.select("query_id", "node_id", F.least(F.lit(1.0), F.round(F.col("n") * SYMPTOM_HIT, PLACES)).alias("score"))


def incidents_by_words(queries: DataFrame, incidents: DataFrame) -> DataFrame:
    """query_id, node_id, score of resolved incidents (node_id, name, description, status) without vectors: 0.2 for each different word shared with the query, from two on, at most 1."""
    said = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit("")))
    have = incidents.where("status = 'resolved'").select("node_id", F.explode(F.array_distinct(text.words(said))).alias("word"))
    asked = queries.select("query_id", F.explode(F.array_distinct(text.words(F.col("text")))).alias("word"))
    shared = asked.join(have, "word").groupBy("query_id", "node_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_WORDS)
    return shared.select("query_id", "node_id", F.least(F.lit(1.0), F.round(F.col("n") * WORD_HIT, PLACES)).alias("score"))
