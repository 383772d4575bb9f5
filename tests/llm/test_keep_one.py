"""Near duplicates are told by their texts: rows that share a key, or have none, are kept unless their texts are similar."""

from collections import Counter

from quern.llm import covering_simhash

from .conftest import DOCS, prose


def test_unrelated_texts_of_one_key_stay(spark):
    import random

    rng = random.Random(51)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    near = a.replace(a.split()[-1], "changed")
    rows = [(7, a), (7, b), (9, near), (None, c), (None, d), (None, c), (3, d), (7, b), (12, None), (13, ""), (None, None)]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], DOCS).repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in covering_simhash.keep_one(docs).collect())
    # one of {a, near}, one b, one c, one d, one without text
    assert got == Counter([(7, a), (7, b), (None, c), (3, d), (12, None)])


def test_groups_are_alike_for_any_partitioning(docs):
    one = {(r["doc_id"], r["node"], r["group_id"]) for r in covering_simhash.similar_groups(docs.repartition(1)).collect()}
    assert one == {(r["doc_id"], r["node"], r["group_id"]) for r in covering_simhash.similar_groups(docs.repartition(7)).collect()}


def test_frequent_shingles_are_counted_in_all_rows(spark):
    """A phrase of all texts is frequent although no text's hash is one that a sample of every third would draw."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(52)
    phrase = prose(rng, 12)
    texts = spark.createDataFrame([(f"{prose(rng, 20)} {phrase}",) for _ in range(90)], "text string").withColumn("node", F.xxhash64("text"))
    texts = [tuple(r) for r in texts.where(F.pmod("node", F.lit(3)) != 0).collect()][:30]
    frequent = covering_simhash._frequent(spark.createDataFrame(texts, "text string, node long").repartition(3), 5, 10)
    common = set(covering_simhash.shingle_set(phrase).tolist())
    for text, _ in texts:
        assert not common & set(covering_simhash.prefix(covering_simhash.shingle_set(text), 0.8, frequent).tolist())


def test_frequent_cells_by_brute_force(spark, docs, corpus):
    """However many rows and cells a task holds, every row counts once in each of its cells."""
    import numpy as np

    rows = Counter()
    for row in corpus:
        rows.update(np.unique(covering_simhash.shingle_set(row[1]) % covering_simhash.CELLS).tolist())
    least = -(-3 * len(corpus) // 60)
    for held in (1, 700, covering_simhash.HELD):
        got = covering_simhash._frequent(docs.select("text"), 5, 60, held)
        assert set(np.flatnonzero(np.unpackbits(got, bitorder="little")).tolist()) == {c for c, n in rows.items() if n >= least}
    assert least > 3 and any(n >= least for n in rows.values())
