"""Mixing sources to target weights by Pfair scheduling, as DataFrame expressions.

Each source's rows are cut into blocks. A source's weight is a whole number of parts, and all sources' parts make a
period. Block k of a source with a of P parts is released at slot floor(k P / a) and due by slot ceil((k + 1) P / a).
Every slot takes, of the released blocks, the one due first. The schedule of a period is worked out once and every
block's slot follows from its number: no task holds the schedule of all blocks. On one line of slots this order meets all
deadlines, so after any number of slots a source's blocks differ from its exact share by less than one. Sources of equal
parts have the same releases and deadlines and take turns, so the schedule is one of classes of them.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from math import gcd, lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import BLOCK_OF, fresh, in_blocks, numbered_by, table, written

#: Rows of a block; parts of the largest source where no weights are given; slots of a period at most, unless all weights are equal.
BLOCK_ROWS, PARTS, MAX_PERIOD = 16, 100, 100_000


def target_parts(counts: DataFrame, weights: dict | None = None) -> DataFrame:
    """source, rows, parts of counts (source, rows): each source's weight as a whole number of parts.

    Without weights a source's parts are the root of its share of the largest source's rows, in hundredths, which lifts
    small sources; with over 1,000 sources in coarser steps, so that a period stays within MAX_PERIOD. Given weights are
    exact: whole numbers, fractions, or decimals as written (0.1 is a tenth). They must be positive and name every source;
    those of sources without rows say nothing.
    """
    if weights is None:
        most, n = counts.agg(F.max("rows"), F.count(F.lit(1))).first()
        top = min(PARTS, max(1, MAX_PERIOD // max(1, n)))
        return counts.select("source", "rows", F.greatest(F.lit(1), F.floor(F.sqrt(F.col("rows") / F.lit(most or 1)) * top + 0.5)).cast("long").alias("parts"))
    exact = {name: Fraction(str(w)) if isinstance(w, float) else Fraction(w) for name, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights are positive")
    scale = lcm(*(w.denominator for w in exact.values()))
    given = counts.sparkSession.createDataFrame([(name, int(w * scale)) for name, w in exact.items()], "name string, parts long")
    named = counts.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("name")), "left")  # as many rows as the caller gave
    missing = F.raise_error(F.concat(F.lit("no weight for source "), F.coalesce("source", F.lit("null"))))
    return named.select("source", "rows", F.when(F.col("parts").isNull(), missing).otherwise(F.col("parts")).cast("long").alias("parts"))


def period_schedule(classes: DataFrame, period: int) -> DataFrame:
    """parts, pick, tau: the slot of each block of a period. classes (parts, members): sources with equal parts.

    A class's picks go round its members. The fold works in pieces of about the root of the period, so that appending to
    what it has found stays cheap.
    """
    one = classes.agg(F.array_sort(F.collect_list(F.struct("parts", "members"))).alias("s"))
    piece = int(period**0.5) + 1
    start = F.transform("s", lambda x: F.lit(0).cast("long"))
    none = F.array().cast("array<struct<i:int,c:bigint>>")

    def step(acc, t):
        def job(c, s):
            k = F.floor(c / s["members"])
            return F.struct(k.alias("k"), c.alias("c"), s["parts"].alias("a"))

        jobs = F.transform(F.zip_with(acc["k"], F.col("s"), job), lambda x, i: F.struct(F.ceil((x["k"] + 1) * F.lit(period) / x["a"]).alias("due"), i.alias("i"), F.floor(x["k"] * F.lit(period) / x["a"]).alias("release"), x["c"].alias("c"), (x["k"] < x["a"]).alias("open")))
        best = F.array_min(F.filter(jobs, lambda x: (x["release"] <= t) & x["open"]))
        return F.struct(F.transform(acc["k"], lambda c, i: c + F.when(i == best["i"], 1).otherwise(0)).alias("k"), F.array_append(acc["out"], F.struct(best["i"].alias("i"), best["c"].alias("c"))).alias("out"))

    def pieces(acc, t):
        inner = F.aggregate(F.sequence(t, F.least(t + piece, F.lit(period).cast("long")) - 1), F.struct(acc["k"].alias("k"), none.alias("out")), step)
        return F.transform(F.array(inner), lambda x: F.struct(x["k"].alias("k"), F.array_append(acc["out"], x["out"]).alias("out")))[0]

    begin = F.struct(start.alias("k"), F.array().cast("array<array<struct<i:int,c:bigint>>>").alias("out"))
    run = one.select("s", F.flatten(F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(period - 1).cast("long"), F.lit(piece).cast("long")), begin, pieces)["out"]).alias("out"))
    return run.select("s", F.posexplode("out").alias("tau", "x")).select(F.col("s")[F.col("x.i")]["parts"].alias("parts"), F.col("x.c").alias("pick"), F.col("tau").cast("long").alias("tau"))


def mix(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs with block, release, slot, deadline and position: the order in which the mixture reads them.

    Every row is kept once. A source's rows are taken in the order of doc_id (null first; among equal ids by the hash of the
    row), `block_rows` to a block; its last block may be smaller. Slots of a source that has run out stay empty, and position
    numbers the rows that are there, from 0 without gaps; until the first source runs out, shares deviate by less than a
    block. A null source is a source of its own; there may be any number of sources. The five new columns come last; one
    that docs have a namesake of gets an underscore more. Weights whose period passes MAX_PERIOD are an error: state them
    in coarser parts.
    """
    spark, new = docs.sparkSession, fresh(docs, "block", "release", "slot", "deadline", "position")
    rows = docs.select(*(F.col(c).alias(f"in_{k}") for k, c in enumerate(docs.columns)), F.col("doc_id").alias("doc_id"), F.col("source").alias("source"))
    sources = written(target_parts(docs.groupBy("source").agg(F.count(F.lit(1)).alias("rows")), weights), "sources")
    classes = [tuple(r) for r in sources.groupBy("parts").agg(F.count(F.lit(1)).alias("members")).collect()]  # as many as different weights
    shared = reduce(gcd, (a for a, _ in classes), 0) or 1
    classes = [(a // shared, m) for a, m in classes]
    period = sum(a * m for a, m in classes)
    turn_of = F.row_number().over(Window.partitionBy("parts").orderBy(F.asc_nulls_first("source"))) - 1
    # written, so that a large source's rows can be split where it isn't broadcast
    told = written(sources.select(F.col("source").alias("of"), F.expr(f"parts div {shared}").alias("a"), turn_of.cast("long").alias("turn_in_class")), "parts")
    found = numbered_by(rows, ["source"], "doc_id", "row_in_source").join(told, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    found = found.withColumn("block", F.floor(F.col("row_in_source") / block_rows).cast("long")).withColumn("turn", F.expr("block div a"))
    if len(classes) < 2:  # equal weights: sources take turns
        slot = F.col("block") * period + F.col("turn_in_class")
    elif period > MAX_PERIOD:
        raise ValueError(f"the weights' period of {period} slots is over {MAX_PERIOD}")
    else:
        members = spark.createDataFrame(classes, "parts long, members long")
        plan = period_schedule(members, period).join(F.broadcast(members), "parts")  # both have at most MAX_PERIOD rows
        plan = written(plan.select(F.col("parts").alias("a_"), F.expr("pick div members").alias("kth"), F.expr("pick % members").alias("member"), "tau"), "schedule")
        found = found.join(F.broadcast(plan), (F.col("a") == F.col("a_")) & (F.expr("block % a") == F.col("kth")) & (F.col("turn_in_class") == F.col("member")))
        slot = F.col("turn") * period + F.col("tau")
    found = found.select(
        *(f"in_{k}" for k in range(len(docs.columns))),
        "row_in_source",
        "block",
        F.expr(f"block * {period}L div a").alias("release"),
        slot.alias("slot"),
        F.expr(f"((block + 1) * {period}L + a - 1) div a").alias("deadline"),
    )
    # neighbouring slots are numbered together, and shifted by the rows of the slots before
    placed = in_blocks(found, [], F.expr(f"slot div {max(1, BLOCK_OF // block_rows)}"), [F.col("slot"), F.col("row_in_source")], "position", repeats=False)
    return placed.select(*(F.col(f"in_{k}").alias(c) for k, c in enumerate(docs.columns)), *(F.col(c).alias(n) for c, n in zip(("block", "release", "slot", "deadline", "position"), new, strict=True)))


def op6_pfair_mix(spark, sf_dir: str) -> DataFrame:
    """The mixture's order of all documents."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


#: The same in DuckDB.
SQL = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n_rows FROM documents GROUP BY source),
top AS (SELECT max(n_rows) AS most, least({PARTS}, greatest(1, {MAX_PERIOD} // count(*))) AS top FROM counts),
raw AS (SELECT source, greatest(1, floor(sqrt(n_rows / most) * top + 0.5))::BIGINT AS a FROM counts, top),
parts AS (SELECT source, a // (SELECT list_reduce(list(a), lambda x, y: gcd(x, y)) FROM raw) AS a FROM raw),
classed AS (SELECT source, a, row_number() OVER (PARTITION BY a ORDER BY source NULLS FIRST) - 1 AS turn, count(*) OVER (PARTITION BY a) AS m FROM parts),
cls AS (SELECT list(a ORDER BY a) AS a, list(m ORDER BY a) AS m, sum(a * m)::BIGINT AS p FROM (SELECT DISTINCT a, m FROM classed)),
edf AS (
  SELECT 0::BIGINT AS t, list_transform(a, lambda x: 0::BIGINT) AS c, NULL::BIGINT AS class, NULL::BIGINT AS pick FROM cls
  UNION ALL
  SELECT t + 1, list_transform(c, lambda x, i: x + CASE WHEN i = b.i THEN 1 ELSE 0 END), b.i, c[b.i]
  FROM (SELECT t, c, list_min(list_filter(list_transform(range(1, len(c) + 1), lambda i: {{'due': ((c[i] // m[i] + 1) * p + a[i] - 1) // a[i], 'i': i, 'release': (c[i] // m[i]) * p // a[i], 'open': c[i] // m[i] < a[i]}}), lambda x: x.release <= t AND x.open)) AS b
        FROM edf, cls WHERE t < p)
),
plan AS (SELECT a[class] AS a, pick // m[class] AS kth, pick % m[class] AS turn, t - 1 AS tau, p FROM edf, cls WHERE class IS NOT NULL),
numbered AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS n FROM documents),
blocks AS (SELECT d.doc_id, d.source, n, n // {BLOCK_ROWS} AS block, a, turn FROM numbered d JOIN classed c ON d.source IS NOT DISTINCT FROM c.source),
placed AS (SELECT b.*, (b.block // b.a) * p + tau AS slot, p FROM blocks b JOIN plan ON b.a = plan.a AND b.turn = plan.turn AND b.block % b.a = plan.kth)
SELECT doc_id, source, block, (block * p // a)::BIGINT AS release, slot::BIGINT AS slot, (((block + 1) * p + a - 1) // a)::BIGINT AS deadline,
  row_number() OVER (ORDER BY slot, n) - 1 AS position
FROM placed
"""
