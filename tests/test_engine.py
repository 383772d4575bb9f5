"""Operators of the retrieval engine on small inputs with results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from quern.functions import scoring, text, vectors
from quern.operators import bm25, chunks, evaluate, fusion, graph, ingest, joins, tree
from quern.sources import readers, sinks


def one(spark, column, **values):
    """The column's value on a row of literals."""
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_articles_drop_the_preface(spark):
    got = one(spark, chunks.articles(F.col("t")), t="Lời mở đầu. Điều 1: A… Điều 2a. B…")
    assert [(p["num"], p["body"]) for p in got] == [("1", "A…"), ("2a", "B…")]


def test_legal_chunks(spark):
    clause = "x" * 30
    docs = spark.createDataFrame([("doc_001", "Luật Mẫu 1", f"Điều 1. Quy định chung. Khoản 1: Phạm vi {clause}"), ("d2", "T", f"Điều 3. {'y' * 1000}"), ("d3", "T", "Điều 1. ngắn"), ("d4", "T", f"{'a' * 30}\n\n{'b' * 30}\n\nshort"), ("d5", "T", None), ("d6", "T", f"Điều 1. {'p' * 30} Điều 1. {'q' * 30}")], "doc_id string, title string, text string")
    got = {r["chunk_id"]: r["text"] for r in chunks.legal(docs).collect()}
    assert got["doc_001_a1_c1"].startswith("[Luật Mẫu 1] Điều 1, Khoản 1: Phạm vi")
    assert [k for k in got if k.startswith("d2")] == ["d2_a3_s0", "d2_a3_s462", "d2_a3_s924"]
    assert not any(k.startswith(("d3", "d5")) for k in got)
    assert {k for k in got if k.startswith("d4")} == {"d4_chunk_0", "d4_chunk_1"}
    assert {k for k in got if k.startswith("d6")} == {"d6_a1", "d6_a1~2"}


def test_packing_flushes_before_an_oversize_unit(spark):
    parts = ["a " * 100, "b " * 600, "c " * 100]
    got = one(spark, chunks.packed(F.split(F.col("t"), r"\|")), t="|".join(parts))
    assert [c[0] for c in got] == ["a", "b", "c"]
    assert one(spark, chunks.packed(F.split(F.col("t"), r"\|")), t="x y|z") == ["x y\n\nz"]
    got = one(spark, chunks.packed_with_overlap(F.split(F.col("t"), r"\|"), 3, 2, " "), t="a b c|d e f")
    assert got == ["a b c", "b c d e f"]


def test_markdown_sections(spark):
    md = "intro\n# One\nbody\n```\n# not a heading\n```\n## Two\n\nmore"
    got = one(spark, chunks.markdown_sections(F.col("t")), t=md)
    assert [(s["header"], s["body"].split("\n")[0]) for s in got] == [(None, "intro"), ("One", "# One"), ("Two", "## Two")]
    assert one(spark, chunks.markdown_sections(F.col("t")), t="# H\nx")[0]["header"] == "H"
    assert one(spark, chunks.markdown_sections(F.col("t")), t="") == []


def test_windows_of_words_and_characters(spark):
    words = " ".join(f"w{k}" for k in range(1001))
    got = one(spark, chunks.word_windows(text.words(F.col("t"))), t=words)
    assert [len(c.split()) for c in got] == [500, 500, 101]
    assert one(spark, chunks.word_windows(text.words(F.col("t"))), t="") == [""]
    assert [w["start"] for w in one(spark, chunks.windows(F.col("t")), t="x" * 512)] == [0]


def test_text_functions(spark):
    assert one(spark, text.legal_tokens(F.col("t")), t="Theo Điều 5 và khoản 2 của Luật A") == ["điều_5", "khoản_2", "luật"]
    assert one(spark, text.frequency_keywords(F.col("t"), 3), t="beta alpha the beta gamma alpha delta cafés") == ["beta", "alpha", "gamma"]
    assert one(spark, text.frequency_keywords(F.col("t")), t="") == []
    assert one(spark, text.quality(F.col("t")), t="a b c") == pytest.approx(0.7)
    assert one(spark, text.intent(F.col("t")), t="How to fix it") == "procedural"
    assert one(spark, text.urgency(F.col("t")), t="is production slow") == 0.7
    assert one(spark, text.vote(F.col("t"), text.DOMAINS), t="redis and docker on aws") == "infrastructure"
    assert one(spark, text.vote(F.col("t"), text.DOMAINS), t="nothing") is None
    assert one(spark, text.completeness(F.col("t"), F.lit("runbook")), t="todo: steps") == pytest.approx(0.7 / 3)
    assert one(spark, text.normalised_keywords(F.split(F.col("t"), ","), 3), t=" a ,A,b,,c,d") == ["a", "b", "c"]
    assert one(spark, text.ngram_overlap(F.col("t"), F.col("u")), t="a b c d e f", u="x a b c d e") == pytest.approx(0.5)
    assert one(spark, text.content_type(F.col("t")), t="http://h/x.HTML?y=1") == "html"
    assert one(spark, text.words(F.col("t")), t=" A b\t ") == ["a", "b"]


def test_scores(spark):
    now = F.lit("2024-03-01 12:00:00").cast("timestamp")
    none = F.lit(None).cast("timestamp")
    c = {k: F.lit(0.0) for k in ("authority", "criticality", "uniqueness")} | {k: F.lit(0) for k in ("access_count", "positive", "negative", "success", "failure")}
    got = one(spark, scoring.importance(now, explicit=F.lit(1.2), last_accessed=none, updated_at=now, checked_at=none, boost=F.lit(0.0), **c))
    assert got == pytest.approx((0.25 * 1.2 + 0.05 + 0.025) * (0.5 + 0.5 * 0.65))
    ages = [7, 30, 60, 90, 91, None]
    assert [one(spark, scoring.freshness(F.lit(a).cast("int"))) for a in ages] == pytest.approx([1.0, 0.9, 0.55, 0.3, 0.3, 0.5])
    assert one(spark, scoring.boosted(F.lit(0.6), F.lit(3))) == pytest.approx(0.84)
    assert one(spark, scoring.parsed_type(F.lit(" SOP "))) == "procedural" and one(spark, scoring.parsed_type(F.lit("?"))) == "factual"
    assert one(spark, scoring.recency_boost(F.lit(12.0))) == pytest.approx(0.1)


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(4.0))
    assert [one(spark, vectors.distance(a, b, m)) for m in ("cosine", "l1", "l2", "linf")] == pytest.approx([0.2, 3, 3, 3])
    base = spark.createDataFrame([(k, [float(k % 7), float(k % 5), 1.0]) for k in range(60)] + [(90, None), (91, [1.0]), (92, [0.0, 0.0, 0.0])], "node_id long, v array<double>").repartition(5)
    asked = base.where("node_id < 9").selectExpr("node_id as query_id", "v")
    got = {(r["query_id"], r["rank"]): (r["node_id"], r["score"]) for r in vectors.nearest(base, asked, 4).collect()}
    rows = {k: (k % 7, k % 5, 1.0) for k in range(60)}
    for q in range(9):
        cos = lambda x, y: sum(s * t for s, t in zip(x, y, strict=True)) / (sum(s * s for s in x) * sum(t * t for t in y)) ** 0.5
        want = sorted((-round(cos(rows[q], v), 6), k) for k, v in rows.items())[:4]
        assert [got[q, r + 1][0] for r in range(4)] == [k for _, k in want]
    assert vectors.nearest(base, asked.limit(0), 3).count() == 0


def test_bm25_and_fusion(spark):
    nodes = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "a", "c"]), (3, ["d"]), (4, []), (5, ["e"])], "node_id long, tokens array<string>")
    queries = spark.createDataFrame([(1, ["c", "c"]), (2, ["zz"]), (3, [])], "query_id long, tokens array<string>")
    got = bm25.top(bm25.scores(bm25.build(nodes), queries), 5).collect()
    assert [(r["query_id"], r["node_id"]) for r in got] == [(1, 2)]
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, node_id long, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 10, 2)], "query_id long, node_id long, rank int")
    got = {r["node_id"]: r["score"] for r in fusion.reciprocal_rank({"bm25": a, "dense": b}, fusion.LEGAL_WEIGHTS["single"], 30).collect()}
    assert got[10] == pytest.approx(0.079133)
    votes = {r["node_id"]: r["score"] for r in fusion.rank_votes({"x": a, "y": a}, {"x": 0.5, "y": 0.5}).collect()}
    assert votes[10] == 0.5 and votes[11] == 0.25


def test_budget_and_diversity(spark):
    rows = spark.createDataFrame([(1, 1, 3000), (1, 2, 400), (1, 3, 200)], "query_id int, rank int, tokens long")
    assert [r["rank"] for r in fusion.within_budget(rows).orderBy("rank").collect()] == [1, 2]
    assert [r["rank"] for r in fusion.within_budget(rows, overshoot=True).orderBy("rank").collect()] == [1, 2, 3]
    same = spark.createDataFrame([(1, k, "s") for k in range(1, 6)], "query_id int, rank int, source string")
    assert fusion.diverse(same).count() == 3


def test_evaluation(spark):
    gt = spark.createDataFrame([("q1", ["a", "b"]), ("q2", ["c"]), ("q3", []), ("q4", []), ("q5", ["x"])], "qid string, answer array<string>")
    pred = spark.createDataFrame([("q1", ["a", "x"]), ("q2", list("abcdef")), ("q3", list("abcdef")), ("q4", ["a"])], "qid string, answer array<string>")
    r = {x["qid"]: x for x in evaluate.per_query(gt, pred).collect()}
    assert (r["q1"]["recall"], r["q1"]["precision"]) == (0.5, 0.5)
    assert r["q2"]["recall"] == 0.0 and r["q2"]["violated"] and r["q3"]["recall"] == 0.0 and r["q4"]["recall"] is None and r["q5"]["recall"] == 0.0
    m = evaluate.macro(evaluate.per_query(gt.where("qid in ('q1', 'q2')"), pred)).first()
    assert (m["recall"], m["precision"], m["n"], m["violated"]) == (0.25, 0.25, 2, 1)


def test_graph(spark):
    edges = spark.createDataFrame([("A", "B", "r"), ("B", "C", "r"), ("A", "C", "s")], "src string, dst string, relation string")
    starts = spark.createDataFrame([("A",)], "start string")
    assert {(r["node"], r["distance"]) for r in graph.traverse(edges, starts, 2, "outgoing").collect()} == {("B", 1), ("C", 1)}
    assert {tuple(r["path"]) for r in graph.simple_paths(edges, "A", "C", 3).collect()} == {("A", "C"), ("A", "B", "C")}
    again = spark.createDataFrame([("x", "y", "r1", k) for k in range(2)] + [("y", "x", "r0", 9)], "src string, dst string, relation string, ord int")
    r = graph.accumulated(again).first()
    assert (r["weight"], r["relation"]) == (2.0, "r1")
    now = F.lit("2024-01-10").cast("timestamp")
    timed = spark.createDataFrame([("a", "b", None, "2024-01-01"), ("a", "c", "2024-01-01", None)], "src string, dst string, f string, u string").select("src", "dst", F.col("f").cast("timestamp").alias("valid_from"), F.col("u").cast("timestamp").alias("valid_until"))
    assert [r["dst"] for r in graph.active(timed, now).collect()] == ["c"]
    assert graph.neighbourhood(edges, starts, 1).count() == 3
    assert graph.without_entities(edges, spark.createDataFrame([("C",)], "id string")).count() == 1
    terms = spark.createDataFrame([("alpha", "n1", "alpha"), ("alpha", "n2", "alpha beta")], "term string, node_id string, value string")
    docs = spark.createDataFrame([("n1",), ("n2",), ("d",)], "node_id string")
    q = spark.createDataFrame([(1, "Alpha")], "query_id int, entity string")
    got = {r["node_id"]: r["score"] for r in graph.retrieval_scores(terms, spark.createDataFrame([("n1", "d"), ("n2", "d")], "src string, dst string"), docs, q).collect()}
    assert got == {"n1": 2.0, "n2": 1.0, "d": 1.0}
    first = graph.query(edges, spark.createDataFrame([("B", 0), ("A", 1)], "start string, ord int"), 2, 10).collect()
    assert ("C", "B", 1) in {tuple(r) for r in first}


def test_joins(spark):
    sets = spark.createDataFrame([(1, list("abcd")), (2, list("abcd")), (3, list("abcde")), (4, ["z"]), (5, []), (6, None), (7, ["a", "b"])], "id long, items array<string>")
    got = {(r["id"], r["other"]): r["similarity"] for r in joins.set_similarity(sets).collect()}
    assert got == {(1, 2): 1.0, (2, 1): 1.0, (1, 3): 0.8, (2, 3): 0.8, (3, 1): 0.8, (3, 2): 0.8}
    index = spark.createDataFrame([("Red", 1), ("blue", 1), ("red", 2)], "keyword string, node_id long")
    q = spark.createDataFrame([(1, ["RED", "blue"])], "query_id long, keywords array<string>")
    assert {(r["node_id"], r["score"]) for r in joins.keyword_matches(index, q).collect()} == {(1, 1.0), (2, 0.5)}
    assert [r["node_id"] for r in joins.keyword_matches(index, q, match_all=True).collect()] == [1]


def test_ingestion(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "node_id long, text string, version int")
    new = spark.createDataFrame([(10, "x"), (11, "y"), (12, "z"), (13, "w"), (14, "b")], "node_id long, text string")
    d = spark.createDataFrame([(10, 1, "REPLACE"), (12, 9, "SKIP"), (13, 9, "FLAG_REVIEW"), (14, 2, "MERGE")], "new_id long, existing_id long, decision string")
    got = {r["node_id"]: (r["text"], r["version"]) for r in ingest.apply_decisions(stored, new, d).collect()}
    assert got == {1: ("x", 2), 2: ("b\n\n---\n\nb", 2), 11: ("y", 1)}
    cache = spark.createDataFrame([("a", 1)], "k string, v long")
    hits, grown = ingest.cached(spark.createDataFrame([("a",), ("b",), ("b",)], "k string"), cache, "k", lambda m: m.withColumn("v", F.lit(2).cast("long")))
    assert sorted((r["k"], r["v"]) for r in hits.collect()) == [("a", 1), ("b", 2), ("b", 2)] and grown.count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "name": "n", "passage": "p"}, {"title": "t", "text": " "}]))
    (tmp_path / "b.json").write_text(json.dumps({"id": 7, "name": "n7", "link": "l", "passage": "p7"}))
    (tmp_path / "c.json").write_text(json.dumps({"d1": {"title": "t1", "content": "c1", "type": "law"}, "d2": {"name": "t2", "text": "c2"}}))
    got = {tuple(r) for r in readers.json_documents(spark, str(tmp_path)).collect()}
    assert got == {("1", "n", "p", ""), ("7", "n7", "p7", ""), ("d1", "t1", "c1", "law"), ("d2", "t2", "c2", "")}
    (tmp_path / "q").mkdir()
    (tmp_path / "q/q.json").write_text(json.dumps({"q1": {"question": "?", "answer": ["a"]}, "q2": {"question": "!", "answer": None}}))
    assert {(r["qid"], r["answer"] and tuple(r["answer"])) for r in readers.labelled_queries(spark, str(tmp_path / "q")).collect()} == {("q1", ("a",)), ("q2", None)}
    assert {r["path"].rsplit("/", 1)[1] for r in readers.files(spark, str(tmp_path), "*.json", exclude=r"/b\.json$").collect()} == {"a.json", "c.json", "q.json"}
    spec = json.dumps({"paths": {"/x": {"get": {"summary": "s", "parameters": [{"name": "p"}], "responses": {"404": {}, "200": {"description": "ok"}}}}}})
    r = readers.api_operations(spark.createDataFrame([(spec,)], "spec string")).first()
    assert (r["path"], r["method"], r["summary"], r["parameters"], r["responses"]) == ("/x", "GET", "s", ["p"], ["200", "404"])


def test_resumable_sink(spark, tmp_path):
    todo, path, seen = spark.range(5).withColumnRenamed("id", "k"), str(tmp_path / "done"), []
    for part in (todo.where("k < 3"), todo):
        sinks.append_pending(part, path, "k", lambda d: seen.append(d.count()) or d)
    assert seen == [3, 2] and spark.read.parquet(path).count() == 5


def test_trees(spark):
    assert [tree.level_sizes(n) for n in (5, 6, 100, 10**6)] == [(0, 0), (3, 0), (10, 3), (50, 15)]
    m = spark.createDataFrame([("x", 1, [0.0, 1.0]), ("x", 2, [0.0, 3.0]), ("y", 3, [2.0, 0.0])], "cluster string, node_id long, v array<double>")
    assert {r["cluster"]: (r["v"], r["size"]) for r in tree.centroids(m).collect()} == {"x": ([0.0, 2.0], 2), "y": ([2.0, 0.0], 1)}
