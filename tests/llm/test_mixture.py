"""The mixture against a loop that takes, slot by slot, the released block due first, and against its exact weights."""

import random
from collections import Counter, defaultdict
from fractions import Fraction
from math import ceil, floor, gcd

import pytest
from pyspark.sql import functions as F

from quern.llm import pfair_mix


def order_of(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0))


def loop(rows, parts, block_rows):
    """(doc_id, source): slots, by simulating every slot until all rows are placed."""
    shared = 0
    for a in parts.values():
        shared = gcd(shared, a)
    parts = {s: a // shared for s, a in parts.items()}
    period, members = sum(parts.values()), defaultdict(list)
    for doc_id, source in order_of(rows):
        members[source].append(doc_id)
    names = sorted(parts, key=lambda s: (s is not None, s or ""))
    names.sort(key=lambda s: parts[s])  # of blocks due alike, the lighter source's first, then by name
    done, slot, out = dict.fromkeys(names, 0), 0, {}
    while any(done[s] * block_rows < len(members[s]) for s in names):
        ready = [s for s in names if floor(Fraction(done[s] * period, parts[s])) <= slot]
        s = min(ready, key=lambda s: (ceil(Fraction((done[s] + 1) * period, parts[s])), names.index(s)))
        for doc_id in members[s][done[s] * block_rows : (done[s] + 1) * block_rows]:
            out.setdefault((doc_id, s), []).append(slot)
        done[s] += 1
        slot += 1
    return out


@pytest.mark.parametrize("weights", [None, {"x": 3, "y": 5, "z": Fraction(1, 3), None: 0.25}, {"x": 1, "y": 1, "z": 1, None: 1}])
def test_against_a_loop(spark, weights):
    rng = random.Random(71)
    rows = [(k, rng.choice(["x", "x", "x", "y", "z", None])) for k in range(500)] + [(None, "x"), (None, "x"), (9, "z"), (9, "z"), (1 << 60, "y")]
    d = spark.createDataFrame(rows, "doc_id long, source string").repartition(4)
    parts = {r["source"]: r["parts"] for r in pfair_mix.target_parts(d.groupBy("source").agg(F.count(F.lit(1)).alias("rows")), weights).collect()}
    got = pfair_mix.mix(d, weights, 3).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(len(rows)))
    assert [r["slot"] for r in got] == sorted(r["slot"] for r in got)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r["doc_id"], r["source"]].append(r["slot"])
    assert {k: sorted(v) for k, v in slots.items()} == {k: sorted(v) for k, v in loop(rows, parts, 3).items()}


def worst(got, shares):
    """The largest deviation from the shares, in blocks, until a source runs out of its blocks."""
    by_slot = {r["slot"]: r["source"] for r in got}
    seen, most = Counter(), Fraction(0)
    for n in range(len(by_slot)):
        if n not in by_slot:
            break
        seen[by_slot[n]] += 1
        for s in shares if n % 50 == 0 else (by_slot[n],):
            most = max(most, abs(seen[s] - shares[s] * (n + 1)))
    return n, most


def test_thirds_and_sevenths_are_exact_for_ever(spark):
    weights = {"a": Fraction(1, 3), "b": Fraction(1, 7), "c": Fraction(11, 21)}
    d = spark.range(60_000).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, "aaaaaaabbbccccccccccc")), (F.col("id") % 21 + 1).cast("int")).alias("source"))
    n, most = worst(pfair_mix.mix(d, weights, 2).collect(), weights)
    assert n > 25_000 and most < 1


def test_any_number_of_sources(spark):
    """1,200 sources, of which one holds a third of all rows."""
    d = spark.range(18_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") % 1199).cast("string"))).alias("source"))
    parts = {r["source"]: r["parts"] for r in pfair_mix.target_parts(d.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))).collect()}
    assert len(parts) == 1200
    got = pfair_mix.mix(d, None, 2).collect()
    n, most = worst(got, {s: Fraction(a, sum(parts.values())) for s, a in parts.items()})
    assert n > 1500 and most < 1 and sorted(r["position"] for r in got) == list(range(18_000))
    given = {s: Fraction(1, 3 if s == "hot" else 7) for s in parts}
    n, most = worst(pfair_mix.mix(d, given, 2).collect(), {s: w / sum(given.values()) for s, w in given.items()})
    assert n > 1500 and most < 1


def test_odd_rows(spark, docs, corpus, no_docs):
    for weights in ({"src0": 0.0}, {"src0": -1}):
        with pytest.raises(ValueError):
            pfair_mix.mix(docs, weights)
    clash = pfair_mix.mix(docs.withColumn("position", F.lit("x")).withColumn("tau", F.lit("y")).withColumn("of", F.lit("z")))
    assert clash.columns == [*docs.columns, "position", "tau", "of", "block", "release", "slot", "deadline", "position_"]
    assert sorted(r["position_"] for r in clash.collect()) == list(range(len(corpus)))
    assert pfair_mix.mix(no_docs).count() == 0
    with pytest.raises(Exception, match="no weight for source"):
        pfair_mix.mix(docs, {"src0": 1}).collect()
