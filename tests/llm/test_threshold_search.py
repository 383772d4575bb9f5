import math
import random
import re
from collections import Counter

import pytest

from quern.llm import threshold_search as ts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    """Every document scored for every item."""
    counts = [(doc, Counter(t), len(t)) for doc, t in ((d, plain_terms(x)) for d, x in docs)]
    n_docs, n_terms = sum(n > 0 for *_, n in counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        asked, found = Counter(plain_terms(text)), []
        for doc, c, n in counts:
            m = 25 + (75 * n * n_docs) // n_terms if n_terms else 0
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in asked.items() if c[t])
            if score > 0:
                found.append((-score, doc is not None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(corpus):
    rng = random.Random(3)
    texts = [r[1] for r in corpus if r[1]]
    cut = [(k, " ".join(t.split()[:30])) for k, t in enumerate(rng.sample(texts, 25))]
    return [*cut, cut[0], (3, "an id again, naé ba"), (None, "ba ba de"), (90, None), (91, ""), (92, "unheard-of qqqq"), (93, "ÉCOLE é Né ba_de")]


@pytest.mark.parametrize("k", [1, 3, 10])
def test_results_are_those_of_scoring_all(spark, docs, corpus, items, k):
    got = ts.search(docs, spark.createDataFrame(items, "item_id long, text string"), k)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_search([(r[0], r[1]) for r in corpus], items, k)


def test_blocks_of_items_give_the_same(spark, docs, corpus, items, monkeypatch):
    monkeypatch.setattr(ts, "ASKED", 40)
    monkeypatch.setattr(ts, "TOGETHER", 4)
    monkeypatch.setattr(ts, "CELLS", 200)
    got = ts.search(docs, spark.createDataFrame(items, "item_id long, text string"), 4)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_search([(r[0], r[1]) for r in corpus], items, 4)


def test_empty_tables_and_ties(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "same words here")], "item_id long, text string")
    assert ts.search(docs, none).count() == 0
    assert ts.search(no_docs, some).count() == 0
    assert ts.search(spark.createDataFrame([(1, None), (2, " .. ")], "doc_id long, text string"), some).count() == 0
    rows = [(5, "same words"), (None, "same words"), (2, "same words"), (2, "same words"), (7, "other text"), (8, "more of it"), (9, "x y z")]
    got = ts.search(spark.createDataFrame(rows, "doc_id long, text string"), some, 3).orderBy("rank").collect()
    assert [(r["rank"], r["doc_id"]) for r in got] == [(1, None), (2, 2), (3, 2)] and len({r["score"] for r in got}) == 1


def test_common_terms_make_no_candidates(spark):
    """Of an item's terms only those that can reach the seeded bound are essential."""
    rows = [(k, "rare word " * 3 if k < 12 else f"word filler{k}") for k in range(400)]
    stored = spark.createDataFrame([(0, 12, 3000, 900_000, 800_000), (1, 400, 1, 900_000, 700_000)], "number long, df long, w long, top long, kth long")
    asked = spark.createDataFrame([(0, 0, 1), (0, 1, 1)], "item long, number long, times long")
    got = {r["number"]: (r["essential"], r["theta"]) for r in ts.seeded(asked, stored).collect()}
    assert got == {0: (True, 2_400_000_000), 1: (False, 2_400_000_000)}
    found = ts.search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "rare word")], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in found.collect()) == list(range(10))
