"""Queries on copies of the small tables with what only larger tables have."""

import shutil

import duckdb
import pytest

from quern.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


def against_sql(spark, folder, name):
    """The query's rows, once they are those of its SQL over the tables in a folder."""
    con = duckdb.connect()
    for t in ("benchmark", "conversations", "documents", "embeddings", "labels", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, str(folder))
    columns = ", ".join(df.columns)
    got, want = [tuple(r) for r in df.collect()], con.execute(f"SELECT {columns} FROM ({SQL[name]})").fetchall()
    assert sorted(map(str, got)) == sorted(map(str, want))
    return got


@pytest.fixture
def far_ids(tmp_path):
    """Small tables whose documents and vectors have the ids of tables of over 100,000 rows."""
    shutil.copytree(DIR, tmp_path / "t", copy_function=shutil.copyfile)
    for t, k in (("documents", "doc_id"), ("embeddings", "vec_id"), ("labels", "doc_id")):
        duckdb.execute(f"COPY (SELECT * REPLACE ({k} + 99990 AS {k}) FROM '{DIR}/{t}.parquet') TO '{tmp_path}/t/{t}.parquet' (FORMAT parquet)")
    return tmp_path / "t"


def test_parents_of_many_leaves(spark, far_ids):
    assert len(against_sql(spark, far_ids, "tree_resummarised")) > 1


def test_embedding_costs_by_words(spark):
    """Wide embeddings of many sentences take no longer for each of their components, and null and empty texts are zero."""
    import time

    from pyspark.sql import functions as F

    from quern.plans import ports

    texts = spark.range(4000).select(F.when(F.col("id") > 1, F.concat_ws(" ", F.lit("a b c a"), "id")).when(F.col("id") == 1, "").alias("t"))
    wide = texts.select(ports.hashed_embedding(F.col("t"), 4096).alias("v"))
    began = time.monotonic()
    got = wide.select(F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("q")).groupBy("n", "q").count().collect()
    assert {(r["n"], r["q"]): r["count"] for r in got} == {(4096, 1.0): 3998, (4096, 0.0): 2}
    assert time.monotonic() - began < 15


def test_neighbours_of_all_in_bounded_products(spark, monkeypatch):
    """All vectors as queries: products are small, each query gives k rows and not k a partition, in one block or several."""
    import numpy as np

    from quern.functions import vectors

    v = np.random.default_rng(3).integers(-3, 4, (300, 5)).astype(float)
    base = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(300, None), (301, [1.0])], "node_id long, v array<double>").repartition(7)
    asked = base.withColumnRenamed("node_id", "query_id")
    unit = np.where((n := np.linalg.norm(v, axis=1)) > 0, n, np.nan)
    cosine = np.round(v @ v.T / (unit[:, None] * unit[None]), 6)
    gap = -np.round(((v[:, None] - v[None]) ** 2).sum(2), 6)
    for metric, s in (("cosine", cosine), ("l2", gap)):
        want = {(a, b, r + 1) for a in range(300) for r, b in enumerate(sorted((b for b in range(300) if b != a and np.isfinite(s[a, b])), key=lambda b: (-s[a, b], b))[:9])}
        for size in (64 << 20, 4096):
            monkeypatch.setattr(vectors, "QUERY_BYTES", size)
            monkeypatch.setattr(vectors, "PRODUCT_BYTES", 8 * 300 * 7)
            assert {(r["query_id"], r["node_id"], r["rank"]) for r in vectors.nearest(base, asked, 9, metric, True).collect()} == want
            assert {(r["query_id"], r["node_id"], r["rank"]) for r in vectors.nearest(base, asked.where("query_id < 50"), 9, metric, True).collect()} == {x for x in want if x[0] < 50}


def test_similar_sets_meet_few_others(spark, monkeypatch):
    """Sets of few different items share many: the pairs that leave the join are hardly more than the similar ones, and none of these is missed."""
    import random

    from quern.operators import joins

    rnd, sets = random.Random(5), []
    for k in range(240):
        sets.append(set(rnd.sample(range(300), rnd.randint(1, 120))) if k % 3 or not k else set(x for x in sets[-1] if rnd.random() > 0.08) | {rnd.randrange(300)})
    written = []
    keep = joins.materialised
    monkeypatch.setattr(joins, "materialised", lambda df: written.append(keep(df)) or written[-1])
    got = {(r["id"], r["other"]) for r in joins.set_similarity(spark.createDataFrame([(k, list(x)) for k, x in enumerate(sets)], "id long, items array<long>"), top=None).collect()}
    want = {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if a != b and len(x & y) / len(x | y) >= 0.75}
    assert got == want and len(want) > 80
    pairs = [df.count() for df in written if df.columns == ["x", "y"]]
    assert len(pairs) == 2 and pairs[0] < 10 * len(want) and pairs[1] < 2 * len(want)


def test_nothing_near_or_similar_in_empty_tables(spark):
    from quern.functions import vectors
    from quern.operators import joins

    base = spark.createDataFrame([], "node_id long, v array<double>")
    assert vectors.nearest(base, base.withColumnRenamed("node_id", "query_id"), 3).collect() == []
    assert joins.set_similarity(spark.createDataFrame([], "id long, items array<string>")).collect() == []


def test_neighbours_of_all_leave_tasks_ranked(spark, monkeypatch):
    """Queries pass several blocks in one task: no k for each block is shuffled. Copies, far more than k, tie by id, in single and double precision."""
    import numpy as np
    from pyspark.sql import functions as F

    from quern.functions import vectors

    rng = np.random.default_rng(11)
    v = rng.random((900, 8)).astype(np.float32)
    v[200:600] = v[200]
    v[700:] *= 1000
    v[3], v[4] = 0, np.nan
    base = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(900, None)], "node_id long, v array<float>")
    asked = base.withColumnRenamed("node_id", "query_id")
    w = v.astype(np.float64)
    unit = np.where((n := np.linalg.norm(w, axis=1)) > 0, n, np.nan)
    for metric, s in (("cosine", np.round(w @ w.T / (unit[:, None] * unit[None]), 6)), ("l2", -np.round(((w[:, None] - w[None]) ** 2).sum(2), 6))):
        want = {(a, b, r + 1) for a in range(900) for r, b in enumerate(sorted((b for b in range(900) if b != a and np.isfinite(s[a, b])), key=lambda b: (-s[a, b], b))[:7])}
        for kind in ("array<float>", "array<double>"):
            cast = F.col("v").cast(kind)
            for size, cut in ((64 << 20, 1 << 31), (12000, 100_000)):
                monkeypatch.setattr(vectors, "QUERY_BYTES", size)
                monkeypatch.setattr(vectors, "PAIRS", cut)
                got = vectors.nearest(base.withColumn("v", cast), asked.withColumn("v", cast), 7, metric, True)
                plan = got._jdf.queryExecution().executedPlan().toString()
                assert {(r["query_id"], r["node_id"], r["rank"]) for r in got.collect()} == want
                if kind == "array<float>":
                    assert "Window" not in plan and plan.count("MapInArrow") == 1
                    assert cut == 1 << 31 or got.rdd.getNumPartitions() >= 8


def test_neighbour_graph_counts_pairs_once(spark):
    """A pair that both ends found weighs 1, one that one found a half; rows are searched and dealt once for both ways round."""
    from quern.operators import neighbour_graph

    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (5, 5)], "node_id long, other long")
    got = neighbour_graph.symmetric(pairs)
    assert {tuple(r) for r in got.collect()} == {(1, 2, 1.0), (2, 1, 1.0), (3, 1, 0.5), (1, 3, 0.5), (5, 5, 1.0)}
    assert "Union" not in got._jdf.queryExecution().executedPlan().toString()


def test_large_sets_are_told_apart_before_they_are_sent(spark, monkeypatch):
    """Maps grow with the sets: pairs of large sets that fall short aren't sent with them, and of maps of two widths the wider is folded."""
    import random

    from quern.operators import joins

    rnd = random.Random(8)
    base = rnd.sample(range(10**9), 4000)
    sets = [set(rnd.sample(base, 2300)) | {k} for k in range(24)]  # any two share about two fifths
    sets += [set(base[:1050]), set(base[:1000]), set(base[:1300])]  # on both sides of a width
    written, keep = [], joins.materialised
    monkeypatch.setattr(joins, "materialised", lambda df: written.append(keep(df)) or written[-1])
    got = {(r["id"], r["other"]) for r in joins.set_similarity(spark.createDataFrame([(k, list(x)) for k, x in enumerate(sets)], "id long, items array<long>"), top=None).collect()}
    want = {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if a != b and len(x & y) / len(x | y) >= 0.75}
    assert got == want and len(want) == 6
    assert [df.count() for df in written if df.columns == ["x", "y"]][-1] == 3


def test_copies_on_both_sides_offer_few_ids(spark):
    """Across a field, each row gets its `top` others however many copies there are, as without that bound."""
    from quern.operators import joins

    rows = [((k % 2, k), [1, 2, 3, 4]) for k in range(40)] + [((k % 2, k), [1, 2, 3, 4, 5]) for k in range(40, 60)] + [((0, 99), [7])]
    df = spark.createDataFrame(rows, "id struct<old: int, doc: long>, items array<long>")
    every = joins.set_similarity(df, top=None, across="old").where("rank <= 2")
    few = joins.set_similarity(df, top=2, across="old")
    assert sorted(map(str, few.collect())) == sorted(map(str, every.collect())) and few.count() == 120
    assert "WindowGroupLimit [y" in few._jdf.queryExecution().executedPlan().toString()
