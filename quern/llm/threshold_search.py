"""Ranked lexical search of a stated set of items by a threshold-seeded join.

The documents become an index, a row for each with its number of terms and, of the terms that are asked for, numbers and
counts. Of every term the largest and the kth largest impact on any document's score are stored. As k documents reach the
kth impact of a term by that term alone, the best of an item's terms bounds the score of its kth document from below,
before anything is scored. The item's most common terms whose largest impacts together stay under this bound can't bring a
document into the result by themselves: they generate no candidates. The other terms, the essential ones, are joined with
the documents; a candidate that can't reach the bound even with all of the rest is dropped, the others are scored exactly.
Within a task the bound rises with the task's own kth score.

Items are taken in blocks of a bounded number of terms, so what tasks are given is bounded, and postings aren't shuffled:
a task sends on k documents an item at most.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import numbered, scratch, spread, table, told, written

#: Fixed values of the query's contract: a term, results of an item.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
#: Pairs of item and term of a block, beyond which the next block begins; items that stay in one block; cells of a task's dense tables.
ASKED, TOGETHER, CELLS = 1 << 18, 256, 1 << 21
#: Rows of the index that a task hands on at once.
SENT = 1000

_FIND = re.compile(TERM).findall
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def terms_of(text: str | None) -> list[str]:
    """The terms of a text in order; only A to Z are lower-cased."""
    if not text:
        return []
    return _FIND(text.lower() if text.isascii() else text.translate(_LOWER))


def asked_terms(items: DataFrame) -> DataFrame:
    """item, term, times: how often each item holds each of its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = Counter(terms_of(text))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["item", "term", "times"])

    return items.select("item", "text").mapInArrow(run, "item long, term string, times long")


def index(docs: DataFrame, numbers) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers of asked ones) and tfs of every row of docs (doc_id, text); numbers: a broadcast of term to number."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "n", "terms", "tfs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, number = [], numbers.value.get
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                found = terms_of(text.as_py())
                tf = Counter(map(number, found))
                tf.pop(None, None)
                rows.append((doc.as_py(), len(found), list(tf.keys()), list(tf.values())))
                if len(rows) == SENT:
                    yield packed(rows)
                    rows = []
        if rows:
            yield packed(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def postings(batch: pa.RecordBatch, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A batch of the index as postings: row in the batch, term, and its impact before the term's weight; n_docs and n_terms are the corpus's."""
    lists = batch.column("terms")
    term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(lengths)), lengths)
    m = 100 - 75 + (75 * batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64) * n_docs) // n_terms
    return row, term, (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])


def first_of(group: np.ndarray, order: list[np.ndarray], k: int) -> np.ndarray:
    """Places of the first k rows of each group, in the order of the keys `order`, the most important first."""
    by = np.lexsort([*reversed(order), group])
    sorted_ = group[by]
    starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(by) else np.empty(0, np.int64)
    nth = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
    return by[nth < k]


def impacts(found: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """term, top and kth: the largest and the kth largest impact before weights (null with fewer documents) of every asked term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term = value = np.empty(0, np.int64)
        for batch in batches:
            _, t, g = postings(batch, n_docs, n_terms)
            term, value = np.concatenate([term, t]), np.concatenate([value, g])
            best = first_of(term, [-value], k)
            term, value = term[best], value[best]
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(value, pa.int64())], ["number", "g"])

    best = found.mapInArrow(run, "number long, g long").withColumn("nth", F.row_number().over(Window.partitionBy("number").orderBy(F.desc("g")))).where(F.col("nth") <= k)
    return best.groupBy("number").agg(F.max("g").alias("top"), F.max(F.when(F.col("nth") == k, F.col("g"))).alias("kth"))


def seeded(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """asked (item, number, times) with weight, theta (the item's bound from below), most (a term's largest contribution) and essential."""
    of_item = Window.partitionBy("item")
    # from the most common term on: the sum of what these terms can contribute at most
    common_first = of_item.orderBy(F.desc("df"), "number").rowsBetween(Window.unboundedPreceding, 0)
    joined = asked.join(stored, "number").withColumn("weight", F.col("times") * F.col("w")).withColumn("most", F.col("weight") * F.col("top"))
    bounded = joined.withColumn("theta", F.coalesce(F.max(F.col("weight") * F.col("kth")).over(of_item), F.lit(0))).withColumn("together", F.sum("most").over(common_first))
    return bounded.select("item", "number", "weight", "theta", "most", (F.col("together") >= F.col("theta")).alias("essential"))


def _by(key: np.ndarray, size: int, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where each key's rows begin in the values, and these sorted by key."""
    order = np.argsort(key, kind="stable")
    return (np.searchsorted(key[order], np.arange(size + 1)), *(v[order] for v in values))


def _spans(begin: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key all places of its rows: which key, which place."""
    counts = begin[key + 1] - begin[key]
    which = np.repeat(np.arange(len(key)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + begin[key][which]


def ranked_within(plan, n_docs: int, n_terms: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over the index: the k best documents of a task for each item. plan: a broadcast of seeded() as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        items, terms = int(p["item"].max()) + 1, int(p["number"].max()) + 1
        e, r = p["essential"], ~p["essential"]
        ess_at, ess_item, ess_weight = _by(p["number"][e], terms, p["item"][e], p["weight"][e])
        rest_at, rest_term, rest_weight = _by(p["item"][r], items, p["number"][r], p["weight"][r])
        bound, rest = np.zeros(items, np.int64), np.zeros(items, np.int64)
        np.maximum.at(bound, p["item"], p["theta"])
        np.add.at(rest, p["item"][r], p["most"][r])
        kept = [np.empty(0, np.int64)] * 4  # item, score, whether the id is there, id
        step = max(1, CELLS // max(items, terms))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                row, term, g = postings(batch, n_docs, n_terms)
                which, place = _spans(ess_at, term)
                sums = np.zeros(batch.num_rows * items, np.int64)
                np.add.at(sums, row[which] * items + ess_item[place], ess_weight[place] * g[which])
                near = sums.reshape(batch.num_rows, items)
                doc, item = np.nonzero((near > 0) & (near + rest >= bound))
                if not len(doc):
                    continue
                impact = np.zeros((batch.num_rows, terms), np.int64)
                impact[row, term] = g
                which, place = _spans(rest_at, item)
                score = near[doc, item]
                np.add.at(score, which, rest_weight[place] * impact[doc[which], rest_term[place]])
                good = score >= bound[item]
                ids = batch.column("doc_id")
                there, ids = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy(zero_copy_only=False)
                kept = [np.concatenate([a, b]) for a, b in zip(kept, (item[good], score[good], there[doc[good]], ids[doc[good]]), strict=True)]
                best = first_of(kept[0], [-kept[1], kept[2], kept[3]], k)
                kept = [a[best] for a in kept]
                full = np.bincount(kept[0], minlength=items) >= k
                least = np.full(items, np.iinfo(np.int64).max)
                np.minimum.at(least, kept[0], kept[1])
                bound = np.where(full, np.maximum(bound, least), bound)
        ids = pa.array(kept[3], pa.int64(), mask=kept[2] == 0)
        yield pa.RecordBatch.from_arrays([pa.array(kept[0], pa.int64()), ids, pa.array(kept[1], pa.int64())], ["local", "doc_id", "score"])

    return run


def _blocks(asked: DataFrame) -> list[tuple[int, int]]:
    """Ranges of items whose terms make at most ASKED pairs, or TOGETHER items more. What the driver gets is a row for TOGETHER items."""
    sizes = asked.groupBy(F.expr(f"item div {TOGETHER}").alias("some")).agg(F.count(F.lit(1)).alias("pairs")).orderBy("some").collect()
    out, begin, pairs = [], None, 0
    for some, n in sizes:
        if begin is not None and pairs + n > ASKED:
            out.append((begin, some * TOGETHER))
            begin, pairs = None, 0
        begin, pairs = (some * TOGETHER if begin is None else begin), pairs + n
    return out if begin is None else [*out, (begin, (sizes[-1][0] + 1) * TOGETHER)]


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of docs (doc_id, text) with the highest scores above 0 for each item (item_id, text).

    Scores are the contract's, a form of BM25 in whole numbers. Equal scores are ranked by doc_id, null first. Every row of
    docs is a document, repeated rows and null ids too; a null or empty text has no terms. Items that agree in id and text
    are one; a null id is an id, and items that share an id only are ranked apart. Other columns don't matter. An item
    without known terms, an empty table of items or of documents give no rows.
    """
    spark = docs.sparkSession
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    with scratch(spark) as kept:
        named = written(numbered(items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct(), [], "item"), "items")
        asked = written(asked_terms(named), "asked")
        results = []
        for low, high in _blocks(asked):
            block = asked.where(F.col("item").between(low, high - 1))
            words = sorted(r[0] for r in block.select("term").distinct().collect())  # at most as many as a block's pairs
            numbers = {t: n for n, t in enumerate(words)}
            told_numbers = spark.sparkContext.broadcast(numbers)
            found = written(index(docs, told_numbers), "index")
            n_docs, n_terms = found.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
            if not n_docs:
                continue
            dfs = found.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("df"))
            # weights by the driver's own logarithm, for as many terms as a block has
            weights = [(n, df, math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))) for n, df in dfs.collect()]
            weighted = spark.createDataFrame(weights, "number long, df long, w long")
            stored = written(impacts(found, n_docs, n_terms, k).join(F.broadcast(weighted), "number").where("w > 0"), "impacts")
            local = spark.createDataFrame([(n, t) for t, n in numbers.items()], "number long, term string")
            plan = seeded(block.join(F.broadcast(local), "term").select((F.col("item") - low).alias("item"), "number", "times"), stored).toArrow()
            if plan.num_rows:
                arrays = spark.sparkContext.broadcast({c: plan.column(c).to_numpy() for c in plan.column_names})
                best = found.mapInArrow(ranked_within(arrays, n_docs, n_terms, k), "local long, doc_id long, score long")
                order = Window.partitionBy("local").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
                ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                results.append(written(ranked.select((F.col("local") + low).alias("of"), "rank", "doc_id", "score"), "ranked"))
        if not results:
            return empty
        every = results[0]
        for more in results[1:]:
            every = every.unionAll(more)
        ids = named.select("item", "item_id")
        kept.append(out := written(every.join(told(ids), F.col("of") == F.col("item")).select("item_id", "rank", "doc_id", "score"), "results"))
    return out


def op11_threshold_search(spark, sf_dir: str) -> DataFrame:
    """The ten documents that rank highest for each benchmark item."""
    return search(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))


#: The same in DuckDB: every document that shares a term is scored.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS t FROM documents),
s AS (SELECT count(*) AS nd, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
tf AS (SELECT rid, doc_id, len(t)::BIGINT AS n, term, count(*) AS tf FROM (SELECT *, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, nd),
b AS (SELECT row_number() OVER () AS item, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT *, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM b) GROUP BY ALL),
scored AS (
  SELECT item, item_id, rid, doc_id, sum(times * w.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // l))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY item, item_id, rid, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST))::INT AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= {TOP}
"""
