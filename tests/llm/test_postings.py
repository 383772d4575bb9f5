"""Neighbours come from the posting lists: recall of the lists alone, the exact search, and repeated ids, against brute force."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from quern.llm import posting_ann


def brute(ids, x, queries, k):
    out = {}
    for q, v in queries:
        s = np.array([float((v * w).sum()) for w in x])
        best = sorted((-c, i) for c, i in zip(s.tolist(), ids, strict=True) if i != q)
        seen = []
        for c, i in best:
            if i not in [j for _, j in seen]:
                seen.append((c, i))
            if len(seen) == k:
                break
        out[q] = [i for _, i in seen]
    return out


def answers(df, is_query, **options):
    got = defaultdict(list)
    for r in posting_ann.search(df, is_query, **options).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    return got


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(4)


def test_recall_of_the_lists_alone(spark, monkeypatch):
    """Noise, the worst case of any index, on far more vectors than one list or the sample holds; pilots change nothing but cost."""
    rng = np.random.default_rng(61)
    x = rng.normal(size=(12_000, 24))
    d = table(spark, range(len(x)), x)
    asks = F.col("vec_id") % 200 == 0
    want = brute(range(len(x)), x, [(q, x[q]) for q in range(0, len(x), 200)], 20)
    got = answers(d, asks, sample=3000)
    assert all(len(got[q]) == 20 for q in want)
    assert sum(len({*got[q]} & {*want[q]}) for q in want) / (20 * len(want)) >= 0.9
    monkeypatch.setattr(posting_ann, "PILOTS", 0)
    assert answers(d, asks, sample=3000) == got


def test_exact_search_in_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(62)
    x = np.concatenate((rng.normal(size=(300, 6)), rng.normal(size=(500, 6)) * 0.01 + 2))
    d = table(spark, range(800), x)
    monkeypatch.setattr(posting_ann, "BLOCK", 50)
    monkeypatch.setattr(posting_ann, "QUERY_BLOCK", 7)
    assert answers(d, F.col("vec_id") % 20 == 0, exact=True) == brute(range(800), x, [(q, x[q]) for q in range(0, 800, 20)], 20)


def test_repeated_rows_hide_no_neighbour(spark):
    v, rng = np.array([1.0, 2.0, 3.0]), np.random.default_rng(63)
    ids = [3] * 25 + [50, 40, 7] + list(range(100, 130))
    x = np.concatenate((np.repeat(v[None], 28, axis=0), rng.normal(size=(30, 3))))
    d = table(spark, [*ids, 200], np.concatenate((x, v[None] * 2)))
    got = answers(d, F.col("vec_id").isin(40, 200), k=5)
    want = brute([*ids, 200], [*x, v * 2], [(40, v), (200, v * 2)], 5)
    assert got == want and {3, 7, 50} < {*got[40]}
