"""The sharding query against plain Python: every draw of the tree, sizes, sums and slots."""

import math
import zlib
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from quern.llm import shard_tree


def draw(level, key):
    h = xxhash.xxh64_intdigest(level.encode(), 42)
    if key is not None:
        h = xxhash.xxh64_intdigest(key.encode(), h)
    return ((h >> 11) + 0.5) * 2.0**-53


def descend(key, tree):
    """The shard of a key, level by level; weights of a node are those of its leaves."""
    here, path = tree, "tree"
    for part in ("region", "rack", "shard"):
        groups = defaultdict(float)
        for x in here:
            groups[str(getattr(x, part))] += x.weight
        groups = {g: w for g, w in groups.items() if w > 0}
        best = min(groups, key=lambda g: (-math.log(draw(f"{path}/{g}", key)) / groups[g], g)) if len(groups) > 1 else next(iter(groups))
        here, path = [x for x in here if str(getattr(x, part)) == best], f"{path}/{best}"
    return here[0].shard


def test_query_by_brute_force(spark, corpus, tmp_path):
    rows = [*corpus, *[corpus[5]] * 9, *[(None, None, None, None, None)] * 30]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    got = shard_tree.op3_shard_tree(spark, folder).collect()
    tree = shard_tree.balanced_tree(8)
    want = []
    for doc_id, text, *_ in rows:
        key, raw = None if doc_id is None else str(doc_id), (text or "").encode()
        want.append((str(doc_id), len(raw) + 1, zlib.crc32(raw), "key", descend(key, tree), descend(key, shard_tree.grown_tree(tree))))
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == sorted(want)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got)


def test_weighted_tree_by_brute_force(spark):
    tree = [shard_tree.Leaf(0, "a", "x", 2.0), shard_tree.Leaf(1, "a", "x", 0.5), shard_tree.Leaf(2, "a", "y", 1.0), shard_tree.Leaf(3, "b", "z", 3.5), shard_tree.Leaf(4, "b", "z", 0.0)]
    ids = spark.range(500).select(F.col("id").cast("string").alias("doc_id"))
    for r in ids.select("doc_id", shard_tree.shard_of([F.col("doc_id")], tree).alias("s")).collect():
        assert r["s"] == descend(r["doc_id"], tree)
