"""Growing trees: all large clusters split at once, layers of soft clusters with provenance, trees merged by insertion."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.tree import SHOWN, best_parents, centroids, soft_clusters
from quern.store import materialised

#: Parts that a cluster is split into at most, citations of a summary, blocks in which new nodes are numbered.
MOST_PARTS, CITED, BLOCKS = 50, 20, 64


class Tree(NamedTuple):
    """nodes (node_id, text, v, layer), edges (parent, child, p) and citations (node_id, ref, n, rank, total) of a tree."""

    nodes: DataFrame
    edges: DataFrame
    citations: DataFrame


# re-clustering


def seeds(rows: DataFrame) -> DataFrame:
    """path, centres of rows (path, node_id, v, k): each path's first k members by the hash of their id, numbered from 1."""
    order = Window.partitionBy("path").orderBy(F.md5(F.col("node_id").cast("string")), "node_id")
    first = rows.withColumn("c", F.row_number().over(order)).where(F.col("c") <= MOST_PARTS).where(F.col("c") <= F.col("k"))
    return _listed(first.select("path", "c", F.col("v").cast("array<double>").alias("v")))


def _listed(centres: DataFrame) -> DataFrame:
    """path, centres: the numbered centres (path, c, v) of a path as one array of at most MOST_PARTS."""
    return centres.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("centres"))


def assigned(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """rows (path, ...) with c, the nearest of their path's centres: squared distance to 6 places, ties to the smaller number."""

    def gap(x: Column) -> Column:
        return F.round(F.aggregate(F.zip_with("v", x["v"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d), 6)

    met = rows.join(centres, "path")
    return met.withColumn("c", F.array_min(F.transform("centres", lambda x: F.struct(gap(x).alias("gap"), x["c"].alias("c"))))["c"]).drop("centres")


def lloyd(rows: DataFrame, centres: DataFrame, steps: int) -> DataFrame:
    """rows (path, node_id, v, ...) with c after `steps` moves of the centres, those of all paths at once.

    A step is one join of rows with their path's few centres and one aggregation by path, centre and component, so the
    number of paths doesn't change the number of jobs.
    """
    labelled = materialised(assigned(rows, centres))
    for _ in range(steps):
        means = centroids(labelled.select(F.struct("path", "c").alias("cluster"), "node_id", "v"))
        labelled = materialised(assigned(rows, _listed(means.select("cluster.path", "cluster.c", "v"))))
    return labelled


def recluster(nodes: DataFrame, tokens: str = "tokens", most: int = 3500, rounds: int = 5, steps: int = 3) -> DataFrame:
    """node_id, path of nodes (node_id, v, tokens and, if there are clusters already, path): none holds over `most` tokens, if it can be split.

    Every round splits all clusters that are too large, each into as many parts as its tokens ask for, MOST_PARTS at most;
    a part's number is added to the path. A cluster that stays whole, or of one node, is kept. Rounds, not clusters, decide
    the number of jobs, and the driver gets no list of clusters.
    """
    path = F.col("path") if "path" in nodes.columns else F.lit("")
    rows = materialised(nodes.select("node_id", F.col("v").cast("array<double>").alias("v"), F.col(tokens).alias("tokens"), path.cast("string").alias("path"), F.lit(True).alias("open")))
    for _ in range(rounds):
        sizes = rows.where("open").groupBy("path").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
        parts = F.least(F.lit(MOST_PARTS), F.col("n"), F.greatest(F.lit(2), F.ceil(F.col("t") / most)))
        large = materialised(sizes.where((F.col("t") > most) & (F.col("n") > 1)).select("path", parts.cast("int").alias("k")))
        if large.isEmpty():
            break
        todo = rows.join(large, "path")
        labelled = lloyd(todo.drop("k", "open"), materialised(seeds(todo)), steps)
        split = labelled.groupBy("path").agg((F.min("c") < F.max("c")).alias("open"))
        new = labelled.join(split, "path").withColumn("path", F.when(F.col("open"), F.concat_ws("/", "path", "c")).otherwise(F.col("path"))).drop("c")
        rows = materialised(rows.join(large, "path", "left_anti").unionByName(new))
    return rows.select("node_id", "path")


# construction


def likely(memberships: DataFrame, threshold: float) -> DataFrame:
    """The memberships (node_id, cluster, p) above the threshold; of a node without such, the likeliest, ties to the smaller cluster."""
    order = Window.partitionBy("node_id").orderBy(F.desc("p"), "cluster")
    return memberships.withColumn("nth", F.row_number().over(order)).where((F.col("p") > threshold) | (F.col("nth") == 1)).drop("nth")


def mixture(layer: DataFrame, depth: int) -> DataFrame:
    """Memberships (node_id, cluster, p) of a layer (node_id, v) in a Gaussian mixture of about the root of its nodes, MOST_PARTS at most."""
    return soft_clusters(layer, min(MOST_PARTS, max(2, int(layer.count() ** 0.5))))


def grow(leaves: DataFrame, summarise: Callable[[Column], Column], embed: Callable[[Column], Column], memberships=mixture, threshold: float = 0.1, dims: int = 10, target: int = 75, layers: int = 5) -> Tree:
    """A tree over leaves (node_id, text, v, ref) in which a node has a parent for each cluster that it belongs to.

    memberships: a function from a layer (node_id, v) and its number to (node_id, cluster, p). A node is a child of all
    clusters in which p is above the threshold, else of its likeliest. A summary is made from the texts of the SHOWN
    likeliest children and cites the refs of all leaves below it, counted once for each way up, the CITED most frequent by
    name where equal; total counts all. Layers are added while there are more than dims + 1 nodes and, above the leaves, more
    than `target`. Each layer is written before the next. Leaves without ref are cited nowhere.
    """
    spark = leaves.sparkSession
    layer = materialised(leaves.select(F.col("node_id").cast("string").alias("node_id"), "text", F.col("v").cast("array<double>").alias("v"), F.lit(0).alias("layer")))
    refs = materialised(leaves.where("ref IS NOT NULL").select(F.col("node_id").cast("string").alias("node_id"), F.col("ref").cast("string").alias("ref"), F.lit(1).cast("long").alias("n")))
    nodes, edges = layer, spark.createDataFrame([], "parent string, child string, p double")
    every = spark.createDataFrame([], "node_id string, ref string, n long")
    for depth in range(1, layers + 1):
        n = layer.count()
        if n <= dims + 1 or (depth > 1 and n <= target):
            break
        name = F.concat(F.lit(f"L{depth}_"), F.col("cluster").cast("string"))
        found = likely(memberships(layer.select("node_id", "v"), depth), threshold)
        new = materialised(found.select(name.alias("parent"), F.col("node_id").cast("string").alias("child"), F.col("p").cast("double").alias("p")))
        # the few likeliest of each cluster are picked before any text is moved
        order = Window.partitionBy("parent").orderBy(F.desc("p"), "child")
        shown = new.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SHOWN)
        texts = shown.join(layer.select(F.col("node_id").alias("child"), "text"), "child")
        joined = texts.groupBy("parent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]), "\n\n").alias("t"))
        made = joined.select(F.col("parent").alias("node_id"), summarise(F.col("t")).alias("text"))
        layer = materialised(made.select("node_id", "text", embed(F.col("text")).cast("array<double>").alias("v"), F.lit(depth).alias("layer")))
        refs = materialised(new.join(refs.select(F.col("node_id").alias("child"), "ref", "n"), "child").groupBy(F.col("parent").alias("node_id"), "ref").agg(F.sum("n").alias("n")))
        nodes, edges, every = nodes.unionByName(layer), edges.unionByName(new), every.unionByName(refs)
    best = Window.partitionBy("node_id").orderBy(F.desc("n"), "ref")
    total = every.groupBy("node_id").agg(F.sum("n").alias("total"))
    cited = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= CITED).join(total, "node_id")
    return Tree(nodes, edges, cited.select("node_id", "ref", "n", "rank", "total"))


# merging


def numbered_after(rows: DataFrame, base: int) -> DataFrame:
    """rows (node_id, ...) with `number`: gapless after base, in blocks of the id's hash, in each by id."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("node_id"), F.lit(BLOCKS)))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n")).select("block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))  # at most BLOCKS rows
    nth = F.row_number().over(Window.partitionBy("block").orderBy("node_id"))
    return dealt.withColumn("nth", nth).join(F.broadcast(before), "block").withColumn("number", F.lit(base) + F.col("before") + F.col("nth")).drop("block", "before", "nth")


def summaries(edges: DataFrame, nodes: DataFrame, summarise: Callable[[Column], Column], most: int = 50, tokens: int = 12_000) -> DataFrame:
    """node_id, text: new summaries of all parents in edges, from up to `most` children in their order while they have `tokens` words together."""
    from quern.functions.text import words

    order = Window.partitionBy("parent").orderBy("child")
    first = edges.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    met = first.join(nodes.select(F.col("node_id").alias("child"), "text"), "child").withColumn("w", F.size(words(F.col("text"))))
    few = met.withColumn("sum", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("sum") <= tokens) | (F.col("nth") == 1))
    joined = few.groupBy("parent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("child", "text"))), lambda s: s["text"]), "\n\n").alias("t"))
    return joined.select(F.col("parent").alias("node_id"), summarise(F.col("t")).alias("text"))


def merge_into(nodes: DataFrame, edges: DataFrame, leaves: DataFrame, summarise: Callable[[Column], Column], embed: Callable[[Column], Column], least: float = 0.25, most: int = 50, tokens: int = 12_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, moved): another tree's leaves (node_id, text, v) inserted into a tree, level by level, without taking anything out.

    nodes (node_id: long, text, v, layer), edges (parent, child); moved (old_id, node_id) has the new numbers of the leaves.
    On each level what is new or changed below looks for the most similar node above, at `least` or more. One that has
    it as a child already changes nothing; else it gets the child, a new summary and vector, and is changed itself. What finds
    none gets a parent of its own, made from its text. All rows of a level meet the level above as it stood, so the result
    doesn't depend on their order. The number of levels stays, but leaves without a level above get one.
    """
    nodes = materialised(nodes.select(F.col("node_id").cast("long").alias("node_id"), "text", F.col("v").cast("array<double>").alias("v"), F.col("layer").cast("int").alias("layer")))
    edges = materialised(edges.select(F.col("parent").cast("long").alias("parent"), F.col("child").cast("long").alias("child")))
    last, top = nodes.agg(F.coalesce(F.max("node_id"), F.lit(-1)), F.coalesce(F.max("layer"), F.lit(0))).first()
    moved = materialised(numbered_after(leaves.select("node_id", "text", F.col("v").cast("array<double>").alias("v")), last))
    affected = moved.select(F.col("number").alias("node_id"), "text", "v")
    last += affected.count()
    nodes = nodes.unionByName(affected.withColumn("layer", F.lit(0)))
    for layer in range(1, max(1, top) + 1):
        above = nodes.where(F.col("layer") == layer)
        met = materialised(best_parents(affected.select("node_id", "v"), above.select(F.col("node_id").alias("parent"), "v"), least))
        attached = materialised(met.where("parent IS NOT NULL").select("parent", F.col("node_id").alias("child")).join(edges, ["parent", "child"], "left_anti"))
        alone = materialised(numbered_after(met.where("parent IS NULL").select("node_id").join(affected, "node_id"), last))
        last += alone.count()
        edges = materialised(edges.unionByName(attached).unionByName(alone.select(F.col("number").alias("parent"), F.col("node_id").alias("child"))))
        of_changed = edges.join(attached.select("parent").distinct(), "parent", "left_semi")
        texts = summaries(of_changed, nodes, summarise, most, tokens).unionByName(alone.select(F.col("number").alias("node_id"), summarise(F.trim("text")).alias("text")))
        changed = materialised(texts.select("node_id", "text", embed(F.col("text")).cast("array<double>").alias("v"), F.lit(layer).alias("layer")))
        nodes = materialised(nodes.join(changed.select("node_id"), "node_id", "left_anti").unionByName(changed))
        affected = changed.drop("layer")
        if changed.isEmpty():
            break
    return nodes, edges, moved.select(F.col("node_id").alias("old_id"), F.col("number").alias("node_id"))
