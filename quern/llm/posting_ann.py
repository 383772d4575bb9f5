"""Approximate nearest neighbours by balanced posting lists.

Vectors are dealt to the nearest of many centroids. A vector near a border is replicated to the lists of further
centroids whose distance is within a ratio of the nearest one's, so a query has to read few lists. Centroids come from
hierarchical balanced clustering of a bounded sample and are searched by a graph in memory: greedy search from entry
points over each centroid's nearest neighbours. A query reads the lists whose centroids are within a ratio of its
nearest one's distance. Lists and their queries are cut into blocks of bounded size, and each pair of blocks is answered
by itself. All that a query gets comes from its lists; with `exact` it reads every list.

The largest inner product is sought: vectors get one more component that makes all norms equal, so that the nearest by
distance is the largest by inner product. Scores are inner products of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import table, tidied, written

#: Vectors that the clustering reads at most, chosen by the hash of their id; centroids at most, else the root of their number.
SAMPLE, CENTROIDS = 100_000, 16_384
#: Sampled vectors that tell, with the lists they are in, how large a score a query's lists give it at least: less needn't be sent on.
PILOTS = 8192
#: Replicas: lists of a vector at most, and the ratio of squared distances within which it is replicated.
REPLICAS, CLOSURE = 2, 1.15
#: Search: lists that are read at least, the share of lists that is read at most, and the ratio of squared distances within which they are read.
MIN_LISTS, MAX_SHARE, PRUNE = 32, 0.34, 1.6
#: The graph's degree, and how many candidates its search keeps beyond those it returns.
DEGREE, BEAM = 24, 64
#: Vectors, and queries, in a block of a list.
BLOCK, QUERY_BLOCK = 4096, 8192


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)


def _balanced(x: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Labels of a clustering into `parts` whose sizes differ little: full clusters push their farthest members on."""
    centers = x[rng.choice(len(x), parts, replace=False)].copy()
    room = -(-len(x) // parts) * 5 // 4 + 1
    label = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        d = _distances(x, centers)
        prefer = np.argsort(d, axis=1, kind="stable")
        label, free = np.full(len(x), -1), np.full(parts, room)
        waiting, turn = np.arange(len(x)), 0
        while len(waiting) and turn < parts:
            want = prefer[waiting, turn]
            order = np.lexsort((d[waiting, want], want))
            sorted_want = want[order]
            place = np.arange(len(order)) - np.searchsorted(sorted_want, sorted_want)
            ok = place < free[sorted_want]
            label[waiting[order[ok]]] = sorted_want[ok]
            free -= np.bincount(sorted_want[ok], minlength=parts)
            waiting, turn = np.sort(waiting[order[~ok]]), turn + 1
        for p in range(parts):
            if (label == p).any():
                centers[p] = x[label == p].mean(axis=0)
    return label


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 11) -> np.ndarray:
    """About `lists` centroids by splitting clusters in up to 16 balanced parts until each is small enough."""
    rng, out, queue = np.random.default_rng(seed), [], [np.arange(len(x))]
    target = max(1, len(x) // max(1, lists))
    while queue:
        ids = queue.pop()
        parts = min(16, round(len(ids) / target))
        if parts < 2 or (x[ids] == x[ids[0]]).all():
            out.append(x[ids].mean(axis=0))
            continue
        label = _balanced(x[ids], parts, rng)
        groups = [ids[label == p] for p in range(parts)]
        if max(len(g) for g in groups) == len(ids):
            out.append(x[ids].mean(axis=0))
        else:
            queue += [g for g in groups if len(g)]
    return np.array(out)


@dataclass
class Graph:
    """Centroids, and for each its nearest others and some far ones, so that greedy search reaches all of them."""

    points: np.ndarray
    near: np.ndarray
    entries: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, degree: int = DEGREE, seed: int = 13) -> Graph:
        n, rng = len(points), np.random.default_rng(seed)
        near = np.empty((n, min(n, degree)), np.int64)
        for k in range(0, n, 512):
            near[k : k + 512] = np.argsort(_distances(points[k : k + 512], points), axis=1, kind="stable")[:, : near.shape[1]]
        near[:, -1] = rng.permutation(n)  # a far neighbour: the random cycle connects the graph
        return cls(points, near, rng.choice(n, min(n, 32), replace=False))

    def search(self, x: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x the k nearest points found and their squared distances, nearest first."""
        n = len(self.points)
        k, width = min(k, n), min(n, max(beam, k) + k)
        norms = (self.points * self.points).sum(1)
        own = (x * x).sum(1)[:, None]
        dist = np.full((len(x), n), np.inf, np.float64)
        rows = np.arange(len(x))[:, None]
        dist[:, self.entries] = np.maximum(own + norms[self.entries] - 2 * x @ self.points[self.entries].T, 0)
        done = np.zeros((len(x), n), bool)
        while True:
            best = np.argpartition(dist, width - 1, axis=1)[:, :width] if width < n else np.broadcast_to(np.arange(n), (len(x), n))
            d = np.where(done[rows, best] | ~np.isfinite(dist[rows, best]), np.inf, dist[rows, best])
            pick = np.argsort(d, axis=1)[:, :4]
            ok = np.isfinite(np.take_along_axis(d, pick, 1))
            if not ok.any():
                break
            at = np.take_along_axis(best, pick, 1)
            done[rows, at] |= ok
            nbr = self.near[at].reshape(len(x), -1)
            got = np.maximum(own + norms[nbr] - 2 * np.einsum("nd,nkd->nk", x, self.points[nbr]), 0)
            got[~np.repeat(ok, self.near.shape[1], axis=1)] = np.inf
            np.minimum.at(dist, (np.broadcast_to(rows, nbr.shape), nbr), got)
        found = np.argsort(dist, axis=1, kind="stable")[:, :k]
        return found, np.take_along_axis(dist, found, 1)


@dataclass
class Index:
    """What searching needs: the graph over the centroids, the norm to which vectors are completed, and some vectors with their lists."""

    graph: Graph
    norm: float
    pilots: np.ndarray
    pilot_lists: np.ndarray

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return np.concatenate((x, rest[:, None]), axis=1)

    def _closest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists that vectors may be in, and which of them hold them."""
        found, d = self.graph.search(self.lifted(x), REPLICAS, BEAM // 2)
        keep = d <= CLOSURE * d[:, :1] + 1e-12
        keep[:, 0] = True
        return found, keep

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs of vectors and the lists that hold them."""
        found, keep = self._closest(x)
        row, col = np.nonzero(keep)
        return row, found[row, col]

    def probes(self, q: np.ndarray, sizes: np.ndarray, k: int, exact: bool = False) -> np.ndarray:
        """Which lists each query reads, as a matrix; lists of `sizes` entries that can't give k neighbours send a query to all lists."""
        n = len(self.graph.points)
        most, out = max(MIN_LISTS, int(MAX_SHARE * n)), np.zeros((len(q), n), bool)
        if exact or most >= n:
            out[:] = True
            return out
        aimed = np.concatenate((q / np.maximum(np.linalg.norm(q, axis=1), 1e-300)[:, None] * self.norm, np.zeros((len(q), 1))), axis=1)
        left, width = np.arange(len(q)), MIN_LISTS
        while len(left):
            found, d = self.graph.search(aimed[left], width)
            near = (d <= PRUNE * d[:, :1] + 1e-12) | (np.arange(found.shape[1]) < MIN_LISTS)
            done = (d[:, -1] > PRUNE * d[:, 0]) | (width >= most)
            row, col = np.nonzero(near & np.isfinite(d) & done[:, None])
            out[left[row], found[row, col]] = True
            left, width = left[~done], min(2 * width, most)
        out[out @ sizes < REPLICAS * (k + 1)] = True
        return out

    def floors(self, q: np.ndarray, read: np.ndarray, k: int) -> np.ndarray:
        """The score that each query's k nearest in the lists it reads reach at least, the query's own vector left out."""
        if len(self.pilots) <= k:
            return np.full(len(q), -np.inf)
        scores = q @ self.pilots.T
        scores[~read[:, self.pilot_lists].any(axis=2)] = -np.inf
        return np.partition(scores, -k - 1, axis=1)[:, -k - 1] - 1e-9


def usable(vector: str = "embedding") -> Column:
    """Vectors that take part: not null, not empty, without null or non-finite components, not all zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def build(vectors: DataFrame, sample: int = SAMPLE) -> Index | None:
    """An index of vectors (id, v), fitted on at most `sample` of them by the hash of their id; None if there are none."""
    stats = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")).first()
    if not stats["n"]:
        return None
    picked = vectors if stats["n"] <= sample else vectors.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 40)) < int(sample / stats["n"] * (1 << 40)))
    rows = picked.orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(sample).select("v").toArrow()
    x = _matrix(rows.column(0).combine_chunks())
    index = Index(None, float(np.sqrt(stats["norm"])), x[:PILOTS].copy(), np.zeros((0, REPLICAS), np.int64))
    lists = int(min(CENTROIDS, max(1, 0.9 * stats["n"] ** 0.5)))
    index.graph = Graph.of(balanced_centroids(index.lifted(x), lists))
    for k in range(0, len(index.pilots), 256):  # few at a time: a search gathers each row's neighbours in the graph
        found, keep = index._closest(index.pilots[k : k + 256])
        index.pilot_lists = np.concatenate((index.pilot_lists[:, : found.shape[1]], np.where(keep, found, found[:, :1])))
    return index


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, exact: bool = False) -> DataFrame:
    """query_id, rank, the neighbour's key and score: for each query row the k largest inner products found with other rows.

    Ties go to the smaller key. Vectors that are null, empty, zero or hold null or non-finite components take no part;
    all others must be of one length. Repeated rows of a key and vector are one. Equal vectors are indexed once with
    their k + 1 smallest keys, as no query's answer can hold others: that loses nothing, and groups of equal vectors of
    any size cost k + 1 rows. Queries get as many rows as there are candidates, up to k. Rows of a null key take no
    part; other columns are ignored. With `exact` every list is read and the answer is that of brute force.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks"))
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    once = rows.select("id", "v").distinct()
    classes = written(once.withColumn("r", first).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "ids", "v"), "classes")
    out = f"query_id long, rank int, {key} long, score double"
    index = build(classes.select("id", "v"), sample)
    if index is None:
        return spark.createDataFrame([], out)
    shared = spark.sparkContext.broadcast(index)  # at most CENTROIDS points and their graph, and PILOTS vectors

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, lists = shared.value.lists(_matrix(b.column(2)))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), b.column(0).take(take), b.column(1).take(take), b.column(2).take(take)], names=["list", "id", "ids", "v"])

    posts = written(classes.mapInArrow(tidied(placed), "list long, id long, ids array<long>, v array<double>"), "postings")
    counted = posts.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()  # at most CENTROIDS rows
    sizes = np.zeros(len(index.graph.points), np.int64)
    sizes[[r["list"] for r in counted]] = [r["n"] for r in counted]

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j in range(0, b.num_rows, 256):
                part = b.slice(j, 256)
                q = _matrix(part.column(1))
                read = shared.value.probes(q, sizes, k, exact)
                ends = np.concatenate(([0], read.sum(axis=1).cumsum()))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(read)[1], pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shared.value.floors(q, read, k)), lists], names=["qid", "q", "floor", "lists"])

    questions = rows.where("asks").select(F.col("id").alias("qid"), F.col("v").alias("q")).distinct()
    asked = written(questions.mapInArrow(tidied(probed), "qid long, q array<double>, floor double, lists array<long>"), "questions").select(F.explode("lists").alias("list"), "qid", "q", "floor")
    # how many blocks a list's vectors and its queries make: at most CENTROIDS rows
    turns = {r["list"]: -(-r["n"] // QUERY_BLOCK) for r in asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    cut = F.broadcast(spark.createDataFrame([(r["list"], -(-r["n"] // BLOCK), turns[r["list"]]) for r in counted if r["list"] in turns], "list long, blocks int, turns int"))

    def all_of(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    dealt = posts.join(cut, "list").select("list", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), all_of("turns").alias("turn"), "id", "ids", "v")
    asked = asked.join(cut, "list").select("list", all_of("blocks").alias("block"), F.pmod(F.xxhash64("qid"), F.col("turns")).cast("int").alias("turn"), "qid", "q", "floor")

    def answer(left: Iterator, right: Iterator) -> Iterator:
        import pandas as pd

        xs, ids, lists = [], [], []
        for p in left:
            if len(p):
                xs.append(np.array(p["v"].tolist()))
                ids += p["id"].tolist()
                lists += p["ids"].tolist()
        if not xs:
            return
        x, ids = np.concatenate(xs), np.array(ids)
        order = np.argsort(ids, kind="stable")
        x, ids, lists = x[order], ids[order], [lists[o] for o in order]
        many_ = np.array([len(i) > 1 for i in lists])
        for p in right:
            for j in range(0, len(p), 512):
                qid, q = p["qid"].to_numpy()[j : j + 512], np.array(p["q"].tolist()[j : j + 512])
                if not len(qid):
                    continue
                scores = q @ x.T
                m = min(len(ids), k + 1)
                best = np.argpartition(-scores, m - 1, axis=1)[:, :m] if m < len(ids) else np.broadcast_to(np.arange(m), (len(qid), m))
                edge = np.maximum(np.take_along_axis(scores, best, 1).min(axis=1) - 1e-9, p["floor"].to_numpy()[j : j + 512])
                row, col = np.nonzero(scores >= edge[:, None])
                a, c, s = [], [], []
                for r, v in zip(row.tolist(), col.tolist(), strict=True):
                    # the sum in one order for every block, so that equal vectors score alike
                    score = float((q[r] * x[v]).sum())
                    for other in lists[v] if many_[v] else (ids[v],):
                        if other != qid[r]:
                            a.append(qid[r]), c.append(other), s.append(score)
                if a:
                    f = pd.DataFrame({"query_id": a, key: c, "score": s}).sort_values(["query_id", "score", key], ascending=[True, False, True])
                    yield f.groupby("query_id", sort=False).head(k)

    met = ["list", "block", "turn"]
    found = dealt.groupBy(*met).cogroup(asked.groupBy(*met)).applyInArrow(_arrow(answer, key), f"query_id long, {key} long, score double")
    best = found.groupBy("query_id", key).agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", key, "score")


def _arrow(answer, key: str):
    """answer as a function of two Arrow tables, a list's block and its queries."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = list(answer(iter([left.to_pandas()]), iter([right.to_pandas()])))
        schema = pa.schema([("query_id", pa.int64()), (key, pa.int64()), ("score", pa.float64())])
        return pa.concat_tables([pa.Table.from_pandas(p, schema=schema, preserve_index=False) for p in parts]) if parts else schema.empty_table()

    return run


def op9_posting_ann(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
