"""Trees as they grow, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import growth


@pytest.fixture(scope="module")
def points():
    rng = random.Random(4)
    return [(k, [rng.gauss(10 * (k % 3), 1), rng.gauss(5 * (k % 2), 1)], 10) for k in range(240)]


def test_recluster_leaves_no_large_cluster(spark, points):
    got = growth.recluster(spark.createDataFrame(points, "node_id long, v array<double>, tokens int"), most=300).collect()
    sizes = {}
    for r in got:
        sizes[r["path"]] = sizes.get(r["path"], 0) + 10
    assert len(got) == 240 and max(sizes.values()) <= 300 and len(sizes) > 7


def test_recluster_keeps_what_stays_whole(spark):
    same = [(k, [1.0, 1.0], 10) for k in range(6)] + [(7, [5.0, 5.0], 500)]
    got = {r["node_id"]: r["path"] for r in growth.recluster(spark.createDataFrame(same, "node_id long, v array<double>, tokens int"), most=20).collect()}
    # equal vectors can't be split, one node isn't split
    assert len({got[k] for k in range(6)}) == 1 and got[7] != got[0]
    assert growth.recluster(spark.createDataFrame([], "node_id long, v array<double>, tokens int")).count() == 0


def test_memberships_above_the_threshold_or_the_likeliest(spark):
    rows = [(1, 0, 0.6), (1, 1, 0.3), (1, 2, 0.1), (2, 0, 0.05), (2, 1, 0.09), (2, 2, 0.09)]
    got = growth.likely(spark.createDataFrame(rows, "node_id long, cluster int, p double"), 0.1).collect()
    assert sorted((r["node_id"], r["cluster"]) for r in got) == [(1, 0), (1, 1), (2, 1)]


def test_grow_names_children_and_citations(spark):
    leaves = spark.createDataFrame([(k, f"leaf {k}", [float(k), 1.0], None if k == 3 else f"ref{k % 2}") for k in range(30)], "node_id long, text string, v array<double>, ref string")

    def by_number(layer, depth):
        n = F.regexp_extract("node_id", r"(\d+)$", 1).cast("long")
        return layer.select("node_id", F.inline(F.array(F.struct((n % (6 if depth == 1 else 2)).alias("cluster"), F.lit(0.7).alias("p")), F.struct(((n + 1) % (6 if depth == 1 else 2)).alias("cluster"), F.lit(0.2).alias("p")))))

    got = growth.grow(leaves, lambda t: t, lambda t: F.array(F.length(t).cast("double"), F.lit(1.0)), by_number, dims=2, target=0)
    nodes = {r["node_id"]: r for r in got.nodes.collect()}
    children = {}
    for e in got.edges.collect():
        children.setdefault(e["parent"], set()).add(e["child"])
    # 30 leaves, 6 and 2 summaries; two nodes are not more than dims + 1
    assert sorted(r["layer"] for r in nodes.values()) == [0] * 30 + [1] * 6 + [2] * 2
    assert children["L1_0"] == {str(k) for k in range(30) if k % 6 in (0, 5)}
    assert set(nodes["L1_0"]["text"].split("\n\n")) <= {f"leaf {c}" for c in children["L1_0"]}
    cited = {(r["node_id"], r["ref"]): (r["n"], r["total"]) for r in got.citations.collect()}
    assert cited["L1_3", "ref1"] == (4, 9) and cited["L1_3", "ref0"] == (5, 9)  # leaf 3 has no ref
    assert cited["L2_0", "ref0"][1] == sum(n for (node, _), (n, _) in cited.items() if node in children["L2_0"])
    assert growth.grow(leaves.limit(3), lambda t: t, lambda t: F.array(F.lit(1.0)), by_number, dims=2).edges.count() == 0


def test_grow_by_mixture(spark, points):
    leaves = spark.createDataFrame([(k, f"t{k}", v + [float(k % 5)] * 10, "r") for k, v, _ in points], "node_id long, text string, v array<double>, ref string")
    got = growth.grow(leaves, lambda t: F.substring(t, 1, 20), lambda t: F.array(*(F.lit(float(k)) for k in range(12))), layers=1)
    edges = got.edges.collect()
    assert {e["child"] for e in edges} == {str(k) for k, _, _ in points} and len({e["parent"] for e in edges}) > 1


def spot(t):
    return [len(t) % 7 + 1.0, len(t) % 5 - 1.5, len(t) % 3 - 1.0]


def spot_column(t):
    n = F.length(t)
    return F.array((n % 7 + 1).cast("double"), n % 5 - F.lit(1.5), (n % 3 - 1).cast("double"))


def cut(t):
    w = t.split()
    return " ".join(w[:60]) if w else t


def cosine(a, b):
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b)), 6)


def plain_merge(nodes, edges, leaves, least, top, order):
    """Level by level, all rows of a level against the level above as it stood; children are summarised by `order`."""
    nodes, edges = dict(nodes), set(edges)
    nodes.update({k: (t, v, 0) for k, (t, v) in leaves.items()})
    affected, fresh = dict(leaves), 0
    for layer in range(1, top + 1):
        above = {k: v for k, (_, v, own) in nodes.items() if own == layer}
        attached, alone = set(), []
        for k, (_, v) in affected.items():
            best = min(((-cosine(v, p), i) for i, p in above.items()), default=(1, None))
            if best[1] is not None and -best[0] >= least:
                if (best[1], k) not in edges:
                    attached.add((best[1], k))
            else:
                alone.append(k)
        changed = {}
        for k in alone:
            fresh += 1
            name = ("new", k)
            text = cut(affected[k][0])
            changed[name] = (text, spot(text), layer)
            edges.add((name, k))
        edges |= attached
        for p in {p for p, _ in attached}:
            kids = sorted((c for q, c in edges if q == p), key=order)[:50]
            text = cut("\n\n".join(nodes[c][0] for c in kids))
            changed[p] = (text, spot(text), layer)
        nodes.update(changed)
        affected = {k: (t, v) for k, (t, v, _) in changed.items()}
    return nodes, edges


def test_merging_equals_a_plain_loop(spark):
    rng = random.Random(9)
    word = lambda: "x" * rng.randint(1, 9)
    text = lambda n: " ".join(word() for _ in range(n))
    nodes = {}
    for k in range(120):
        t = text(rng.randint(3, 30))
        nodes[k] = (t, spot(t), 0)
    for k in range(120, 128):
        t = text(4)
        nodes[k] = (t, spot(t), 1)
    for k in range(128, 131):
        t = text(3)
        nodes[k] = (t, spot(t), 2)
    edges = {(120 + k % 8, k) for k in range(120)} | {(128 + k % 3, k) for k in range(120, 128)}
    leaves = {1000 + k: (t := text(rng.randint(1, 40)), spot(t)) for k in range(300)}
    frame = spark.createDataFrame([(k, *v) for k, v in nodes.items()], "node_id long, text string, v array<double>, layer int")
    links = spark.createDataFrame(list(edges), "parent long, child long")
    new = spark.createDataFrame([(k, *v) for k, v in leaves.items()], "node_id long, text string, v array<double>")
    from quern.plans.ports import leading_summary

    got_nodes, got_edges, moved = growth.merge_into(frame, links, new, leading_summary, spot_column, least=0.9)
    names = {r["node_id"]: r["old_id"] for r in moved.collect()}
    assert sorted(names.values()) == sorted(leaves) and min(names) == 131 and max(names) == 430
    rows, pairs = got_nodes.collect(), [(r["parent"], r["child"]) for r in got_edges.collect()]
    assert len(pairs) == len(set(pairs)) and len({r["node_id"] for r in rows}) == len(rows)
    by_layer = {r["node_id"]: r["layer"] for r in rows}
    for p, c in sorted(pairs, key=lambda e: by_layer[e[0]]):
        if p > 430 and p not in names:
            names[p] = ("new", names.get(c, c))
    # children are summarised in the order of their numbers, which the new ones get by their hash
    renamed = {names.get(k, k): k for k in by_layer}
    want_nodes, want_edges = plain_merge(nodes, edges, leaves, 0.9, 2, renamed.__getitem__)
    assert {(names.get(p, p), names.get(c, c)) for p, c in pairs} == want_edges
    assert {names.get(r["node_id"], r["node_id"]): (r["text"], r["layer"]) for r in rows} == {k: (t, n) for k, (t, _, n) in want_nodes.items()}
    assert sum(p in names for p, _ in pairs) > 3 and sum(1 for r in rows if r["layer"] == 2) > 3


def test_merging_into_leaves_alone(spark):
    frame = spark.createDataFrame([(5, "a", [1.0], 0)], "node_id long, text string, v array<double>, layer int")
    none = spark.createDataFrame([], "parent long, child long")
    new = spark.createDataFrame([(1, "b", [1.0]), (2, None, None)], "node_id long, text string, v array<double>")
    nodes, edges, moved = growth.merge_into(frame, none, new, lambda t: t, lambda t: F.array(F.lit(1.0)))
    assert sorted(r["layer"] for r in nodes.collect()) == [0, 0, 0, 1, 1] and edges.count() == 2 and sorted(r["node_id"] for r in moved.collect()) == [6, 7]
