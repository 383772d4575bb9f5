"""Extraction, predicates, keywords, strategies, trees and ingestion on small inputs with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from quern.functions import extract, predicates
from quern.operators import ingest, keywords, tree, vector_index
from quern.plans import ports, strategies

from test_engine import one


def test_legal_entities(spark):
    t = "ĐIỀU 3. Bộ Tài Chính theo Luật Đất; khoản 2: điểm a) hợp đồng"
    got = [(e["type"], e["value"]) for e in one(spark, extract.legal_entities(F.col("t")), t=t)]
    assert got == [("ARTICLE", "ĐIỀU 3."), ("CLAUSE", "khoản 2:"), ("AGENCY", "Bộ Tài Chính"), ("LEGAL_TERM", "hợp đồng"), ("LEGAL_TERM", "luật")]
    assert one(spark, extract.legal_relations(F.col("t")), t="Sửa  đổi theo quy định tại") == ["REFERS_TO", "AMENDS", "REGULATES"]


def test_entities_and_relationships(spark):
    t = "Jane Doe of the platform team: auth-service calls user-db, POST /v1/x on AWS, api_errors. auth-service calls user-db"
    got = {(e["type"], e["name"]) for e in one(spark, extract.entities(F.col("t")), t=t)}
    assert got == {("person", "jane doe"), ("team", "platform team"), ("service", "auth-service"), ("service", "user-db"), ("endpoint", "/v1/x"), ("technology", "aws"), ("metric", "api_errors")}
    rel = [tuple(r)[:3] for r in one(spark, extract.relationships(F.col("t")), t="A depends on B. X is owned by Y")]
    assert ("a", "depends_on", "b.") in rel and ("y", "owns", "x") in rel
    assert one(spark, extract.inverse(F.lit("owns"))) == "member_of" and one(spark, extract.inverse(F.lit("leads"))) == "related_to"
    m = one(spark, extract.metadata(F.col("t")), t="Runbook: step 1 on 2024-01-02 and March 3, 2024. Urgent. TODO steps")
    assert (m["document_type"], m["dates"], m["urgency"]) == ("runbook", ["2024-01-02", "March 3, 2024"], "critical") and m["completeness"] == pytest.approx(0.7 / 3)


def test_predicates(spark):
    assert one(spark, predicates.matches_keywords(F.array(F.lit("A"), F.lit("b")), F.array(F.lit("a"), F.lit("B")), True))
    assert not one(spark, predicates.matches_keywords(F.array(F.lit("A")), F.array(F.lit("c"))))
    now = F.lit("2024-01-31").cast("timestamp")
    assert one(spark, predicates.stale(F.lit(None).cast("timestamp"), F.lit("policy"), now))
    assert not one(spark, predicates.stale(F.lit("2024-01-01").cast("timestamp"), F.lit("relational"), now))
    assert one(spark, predicates.symptom_ratio(F.array(F.lit("Down"), F.lit("slow")), F.lit("it is down"))) == 0.5
    rows = spark.createDataFrame([("svc", "auth", "Auth Service", ["login"], ["p1"]), ("svc", "pay", None, None, None)], "type string, name string, display string, aliases array<string>, tags array<string>")
    assert [r["name"] for r in predicates.find_entities(rows, "svc", "LOG").collect()] == ["auth"]
    assert predicates.find_entities(rows, name="pay", exact=True).count() == 1 and predicates.find_entities(rows, tags=["p1", "x"]).count() == 0


def test_keywords(spark):
    assert one(spark, keywords.ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, keywords.ngrams(F.array().cast("array<string>"))) == []
    docs = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["b"])], "node_id long, terms array<string>")
    got = keywords.tfidf(docs).where("node_id = 1 and rank = 1").first()
    assert got["term"] == "a"
    own = spark.createDataFrame([("l1", "x"), ("l2", "x"), ("l2", "y")], "node_id string, keyword string")
    edges = spark.createDataFrame([("p", "l1"), ("p", "l2")], "parent string, child string")
    assert {(r["keyword"], r["n"]) for r in keywords.propagated(own, edges, 1, 1).where("node_id = 'p'").collect()} == {("x", 2)}


def search_of(spark, hits):
    """A search that finds fixed nodes by a query's text."""
    table = spark.createDataFrame(hits, "text string, node_id long, score double")
    return lambda q: q.join(table, "text").select("query_id", "node_id", "score")


def test_strategies(spark):
    q = spark.createDataFrame([(1, "who owns billing and search")], "query_id long, text string")
    assert one(spark, strategies.variants(F.col("t")), t="who owns billing") == ["who owns billing", "owner team responsible who owns billing"]
    search = search_of(spark, [("who owns billing", 1, 0.6), ("search", 1, 0.5), ("search", 2, 0.9)])
    got = {r["node_id"]: r["score"] for r in strategies.decomposition(q, search, strategies.sub_queries(F.col("text"))).collect()}
    assert got == {1: pytest.approx(0.72), 2: 0.9}
    h = search_of(spark, [("h1", 1, 0.8), ("h2", 1, 0.7), ("who owns billing and search", 3, 0.4), ("who owns billing and search", 1, 0.1)])
    got = {r["node_id"]: r["score"] for r in strategies.hyde(q, h, F.array(F.lit("h1"), F.lit("h2"))).collect()}
    assert got == {1: pytest.approx(0.82), 3: 0.4}
    routes = spark.createDataFrame([(1, "critical error now"), (2, "how to x"), (3, "plain")], "query_id long, text string")
    by = {}
    for r in strategies.routed(routes).collect():
        by.setdefault(r["query_id"], []).append(r["strategy"])
    assert by == {1: ["incident"], 2: strategies.ROUTES["procedural"], 3: strategies.OTHER_ROUTE}
    assert {r["strategy"] for r in strategies.routed(routes, "fast").collect()} == {"adaptive_depth"}


def test_adaptive_depth_ends(spark):
    q = spark.createDataFrame([(1, "plain text"), (2, "nothing here"), (3, "middling")], "query_id long, text string")
    scores = {0: [("plain text", 1, 0.9), ("nothing here", 1, 0.1), ("middling", 1, 0.5)], 1: [("nothing here", 7, 0.5)], 2: []}

    def layer(queries, k):
        return search_of(spark, scores[k] or [("-", 0, 0.0)])(queries)

    got = {(r["query_id"], r["node_id"], r["layer"]) for r in strategies.adaptive_depth(q, layer, 2, 5).collect()}
    assert got == {(1, 1, 0), (2, 7, 1), (3, 1, 0)}


def test_adaptive_depth_plan(spark):
    """A round more adds its own joins to the plan, not those of all rounds before as often as it reads them."""
    q = spark.createDataFrame([(1, "plain text")], "query_id long, text string")
    joins = []
    for deepest in (0, 1, 2):

        def layer(queries, k, deepest=deepest):
            return search_of(spark, [("plain text", k, 0.5 if k == deepest else 0.1)])(queries)

        got = strategies.adaptive_depth(q, layer, deepest, 5)
        assert [(r["query_id"], r["node_id"], r["score"], r["layer"]) for r in got.collect()] == [(1, deepest, 0.5, deepest)]
        joins.append(got._jdf.queryExecution().optimizedPlan().toString().count("Join"))
    assert joins[2] - joins[1] == joins[1] - joins[0]


def test_orchestrated(spark):
    q = spark.createDataFrame([(1, "plain")], "query_id long, text string")
    nodes = spark.createDataFrame([(1, 1.0, "a", 0), (2, 0.0, "a", 0), (3, 1.0, "b", 2)], "node_id long, importance double, source string, layer int")
    search = search_of(spark, [("plain", 1, 0.5), ("plain", 2, 0.9), ("plain", 3, 0.9)])
    got = [(r["node_id"], r["score"]) for r in strategies.retrieve(q, {"hyde": search, "multi_query": search}, nodes, k=2).collect()]
    assert got == [(3, 0.93), (1, 0.65)]
    assert [r["node_id"] for r in strategies.retrieve(q, {"hyde": search}, nodes, source="a", most_layer=1).collect()] == [1, 2]


def test_cited_context(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (1, 13, 4)], "query_id long, node_id long, rank int")
    nodes = spark.createDataFrame([(10, "a\nb", "s2"), (11, "c", "s1"), (12, "d", "s2"), (13, "e", None)], "node_id long, text string, source string")
    r = strategies.cited_context(ranked, nodes).first()
    assert r["context"] == "[1] s2\na b\n\n[2] s1\nc\n\n[1] s2\nd\n\ne"
    assert [tuple(c) for c in r["citations"]] == [(1, "s2"), (2, "s1")]


def test_ports(spark):
    v = one(spark, ports.hashed_embedding(F.col("t")), t="a b c")
    assert sum(x * x for x in v) == pytest.approx(1) and one(spark, ports.hashed_embedding(F.col("t")), t="") == [0.0] * ports.DIM
    assert one(spark, ports.best_sentence(F.lit("red car"), F.lit("Blue sky. The red car stops. End."))) == "The red car stops."
    assert one(spark, ports.leading_summary(F.lit("a b c"), 2)) == "a b" and one(spark, ports.shared_words(F.lit("a b"), F.lit("b"))) == 0.5


def test_tree_mutation(spark):
    parents = spark.createDataFrame([(5, [1.0, 0.0])], "parent long, v array<double>")
    new = spark.createDataFrame([(1, [2.0, 0.1]), (2, [-1.0, 0.0]), (3, [0.0, -1.0])], "node_id long, v array<double>")
    got = {r["node_id"]: (r["parent"], r["is_new"]) for r in tree.insert(new, parents).collect()}
    assert got[1] == (5, False) and {got[2][0], got[3][0]} == {6, 7} and got[2][1] and got[3][1]
    merged = tree.merge(spark.createDataFrame([("a", 4), ("a", 9), ("b", 0)], "tree_id string, index long"))
    assert {(r["tree_id"], r["old_index"]): r["new_index"] for r in merged.collect()} == {("a", 4): 0, ("a", 9): 1, ("b", 0): 2}
    leaves = spark.createDataFrame([(k, f"text {k}", [float(k % 3), float(k)]) for k in range(30)], "node_id long, text string, v array<double>")
    model = ports.Ports()
    nodes, edges = tree.build(leaves, model.summarise, lambda t: F.array(F.length(t).cast("double"), F.lit(1.0)), target=4)
    assert nodes.where("layer = 0").count() == 30 and edges.where("parent like 'L1%'").select("child").distinct().count() == 30
    kept, rest = tree.without_layers_above(nodes, edges, 0)
    assert kept.count() == 30 and rest.count() == 0
    assert tree.sliced_children(edges, 3).agg(F.max("slice")).first()[0] >= 1


def test_inverted_lists(spark):
    nodes = spark.createDataFrame([(k, [float(k % 10), float(k % 7), 1.0]) for k in range(200)], "node_id long, v array<double>")
    asked = nodes.where("node_id < 3").selectExpr("node_id as query_id", "v")
    exact = {(r["query_id"], r["rank"]): r["score"] for r in vector_index.search(vector_index.build(nodes, 0), asked, 3).collect()}
    lists = {(r["query_id"], r["rank"]): r["score"] for r in vector_index.search(vector_index.build(nodes, 8), asked, 3, probes=8).collect()}
    assert exact == lists and len(exact) == 9


def test_ingestion_plan(spark):
    from quern.operators import chunks

    good = " ".join(f"word{k}" for k in range(30))
    docs = spark.createDataFrame([(1, f"{good}\n\n{good} x\n\nbad 1 2 3"), (2, good), (3, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["pos"]) for r in ingest.process(docs, chunks.paragraphs, least=0.75).collect()}
    assert got == {(1, 0), (1, 1)}
    nodes = spark.createDataFrame([(1, "draft"), (2, "draft"), (3, "draft")], "node_id long, status string")
    events = spark.createDataFrame([(1, "stale", 0.0, 1), (1, "validate", 0.9, 2), (2, "validate", 0.5, 1)], "node_id long, event string, confidence double, at int")
    assert {r["node_id"]: r["status"] for r in ingest.lifecycle(nodes, events).collect()} == {1: "validated", 2: "pending", 3: "draft"}


def pages(start, limit):
    return [(str(k), f"t{k}", "x", "2024-01-01") for k in range(start, min(start + limit, 23))]


def test_paged_source(spark):
    from quern.sources.paged import PagedSource

    reader = PagedSource({"fetch": "test_more:pages", "limit": "5", "pages": "9", "run": "2"}).reader(None)
    got = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[0] for r in got] == [str(k) for k in range(23)]


def test_trees_on_disk(spark, tmp_path):
    from quern.sources import sinks

    nodes = spark.createDataFrame([("a", 1, "must do", 0), ("a", 2, "steps", 1), ("b", 1, "x", 0)], "tree_id string, node_id long, text string, layer int")
    sinks.save_tree(nodes, str(tmp_path))
    assert sinks.load_tree(spark, str(tmp_path), "a", 1).count() == 1
    assert {tuple(r) for r in sinks.list_trees(spark, str(tmp_path)).collect()} == {("a", 2, 1), ("b", 1, 0)}
    got = {(r["tree_id"], r["node_id"]): (r["kind"], r["importance"]) for r in sinks.typed_nodes(nodes).collect()}
    assert got == {("a", 1): ("policy", 0.5), ("a", 2): ("procedural", 0.6), ("b", 1): ("factual", 0.5)}


def test_legal_graph(spark):
    from quern.operators import graph

    chunks = spark.createDataFrame([(1, "Điều 1. sửa đổi Điều 2."), (2, "Điều 1. sửa đổi Điều 2."), (3, "none")], "node_id long, text string")
    nodes, edges = graph.legal(chunks)
    assert nodes.count() == 5
    got = {(r["a"], r["b"], r["relation"]): r["weight"] for r in edges.collect()}
    assert got["entity_Điều 1._ARTICLE", "entity_Điều 2._ARTICLE", "AMENDS"] == 1.5 and sum(k[2] == "contains" for k in got) == 4 and not any(k[2] == "co_occurs" for k in got)


def test_incident_aware(spark):
    q = spark.createDataFrame([(1, "error in auth"), (2, "plain")], "query_id long, text string")
    hit = lambda *rows: spark.createDataFrame(list(rows), "query_id long, node_id long, score double")
    got = strategies.incident_aware(q, hit((1, 10, 0.5), (1, 11, 0.3)), hit((1, 10, 0.9)), hit((1, 20, 1.0)), spark.createDataFrame([(20, 30 + k) for k in range(5)], "node_id long, depends_on long"), hit((1, 11, 0.2)), hit((1, 99, 0.9), (2, 98, 0.8)))
    assert {(r["query_id"], r["node_id"]): (r["score"], r["strategy"]) for r in got.collect()} == {(1, 10): (0.5, "runbook"), (1, 20): (0.7, "service"), (1, 30): (0.5, "dependency"), (1, 31): (0.5, "dependency"), (1, 32): (0.5, "dependency"), (1, 11): (0.2, "tree"), (2, 98): (0.8, "hybrid")}


def test_keyword_candidates(spark):
    rows = spark.createDataFrame([(1, "Auth API", "tfidf", 5, True), (1, "auth api", "entity", 1, False), (1, "thing", "tfidf", 1, False)], "node_id long, keyword string, origin string, tf int, in_title boolean")
    best = keywords.scored_candidates(rows).where("rank = 1").first()
    assert best["keyword"] == "Auth API" and best["score"] == pytest.approx(0.3 * 2 / 3 + 0.25 + 0.15 + 0.2 + 0.1, abs=1e-6)


def test_ingestion_run(spark):
    from quern.operators import chunks
    from quern.plans import ingestion

    words = [f"word{k}" for k in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:38], "other", "more"])), (3, "auth-service calls user-db for " + " ".join(f"new{k}" for k in range(30))), (4, None)], "doc_id long, text string")
    stored = spark.createDataFrame([(7, " ".join(words), 1), (8, "unrelated text", 1)], "node_id long, text string, version int")
    got = ingestion.run(docs, stored, chunks.paragraphs)
    assert sorted(r["decision"] for r in got.decisions.collect()) == ["REPLACE", "SKIP"]
    rows = {r["node_id"]: (r["text"], r["version"]) for r in got.stored.collect()}
    assert len(rows) == 3 and rows[7][1] == 2 and rows[7][0].endswith("other more") and rows[8] == ("unrelated text", 1)
    assert {r["id"] for r in got.entities.collect()} == {"service:auth-service", "service:user-db"}
    assert {(r["src"], r["relation"], r["dst"]) for r in got.relationships.collect()} == {("auth-service", "calls", "user-db")}
    log = ingestion.observed(spark.createDataFrame([(1, 0.6), (1, 0.2), (2, 0.1)], "query_id long, score double"), F.lit("2024-01-01").cast("timestamp"))
    assert {r["query_id"]: r["success"] for r in log.collect()} == {1: True, 2: False}


def test_stream_of_many_files_keeps_old_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    from quern.plans.queries import QUERIES

    rows = spark.range(210).selectExpr("id AS event_id", "'view' AS event_type", "timestamp'2024-12-01' - make_interval(0, 0, 0, cast(id AS int)) AS ts", "1.0D AS value")
    rows.repartitionByRange(105, F.desc("ts")).write.parquet(f"{tmp_path}/events.parquet")
    assert len(list((tmp_path / "events.parquet").glob("part-*"))) > 100
    assert QUERIES["stream_without_repeats"](spark, str(tmp_path)).count() == 210
