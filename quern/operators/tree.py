"""Summary trees: centroids, extractive summaries, best parents, beam descent, k-means levels, soft clusters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.vectors import cosine


#: Members whose texts make a summary.
SHOWN = 10


def centroids(members: DataFrame) -> DataFrame:
    """cluster, v, size of members (cluster, node_id, v): the mean vector, component by component."""
    parts = members.select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = parts.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return mean.join(size, "cluster")


def nearest_members(members: DataFrame, centers: DataFrame, n: int = 3) -> DataFrame:
    """cluster, node_id, rank of each cluster's n members with the least distance to its centroid, to 6 places."""
    gap = F.aggregate(F.zip_with("v", "c", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    met = members.join(centers.select("cluster", F.col("v").alias("c")), "cluster").select("cluster", "node_id", F.round(gap, 6).alias("gap"))
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("gap", "node_id"))).where(F.col("rank") <= n)


def best_parents(nodes: DataFrame, parents: DataFrame, least: float = 0.25) -> DataFrame:
    """node_id, parent, similarity of nodes (node_id, v) to parents (parent, v), the few centroids of a level; null where none reaches `least`.

    Parents are sent to all tasks as vectors of one level, whose number a tree bounds; ties go to the smaller parent.
    """
    from quern.functions.vectors import nearest_of

    found = nearest_of(nodes.select(F.col("node_id").alias("query_id"), "v"), parents.select(F.col("parent").alias("node_id"), "v"), 1)
    kept = found.where(F.col("score") >= least).select(F.col("query_id").alias("node_id"), F.col("node_id").alias("parent"), F.col("score").alias("similarity"))
    return nodes.select("node_id").join(kept, "node_id", "left")


def beam(queries: DataFrame, parents: DataFrame, children: DataFrame, width: int, k: int) -> DataFrame:
    """query_id, node_id, score, rank: the k best children of each query's `width` best parents.

    queries (query_id, v), parents (parent, v), children (parent, node_id, v). Each query meets the children of
    `width` parents only, by an equi join.
    """
    from quern.functions.vectors import nearest_of

    top = nearest_of(queries, parents.select(F.col("parent").alias("node_id"), "v"), width).select("query_id", F.col("node_id").alias("parent"))
    met = top.join(queries.select("query_id", F.col("v").alias("q")), "query_id").join(children, "parent")
    scored = met.select("query_id", "node_id", F.round(cosine(F.col("q"), F.col("v")), 6).alias("score")).distinct()
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id"))).where(F.col("rank") <= k)


def descend(queries: DataFrame, levels: list[DataFrame], width: int, k: int) -> DataFrame:
    """query_id, node_id, level, score, rank: what a beam of `width` nodes finds on its way from the top level down, and at the leaves k.

    queries (query_id, v); levels (parent, node_id, v) from the top, whose parents are null, to the leaves. Each level joins the
    children of the nodes that the one above kept; a child of several of them counts once.
    """
    found, kept = None, None
    for depth, level in enumerate(levels):
        last = depth == len(levels) - 1
        if kept is None:
            met = queries.withColumnRenamed("v", "q").join(F.broadcast(level), F.col("parent").isNull())  # the top level has as many nodes as a tree has roots
        else:
            met = kept.select("query_id", F.col("node_id").alias("parent")).join(level, "parent").join(queries.withColumnRenamed("v", "q"), "query_id")
        scored = met.select("query_id", "node_id", F.round(cosine(F.col("q"), F.col("v")), 6).alias("score")).distinct()
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
        kept = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (k if last else width)).withColumn("level", F.lit(len(levels) - 1 - depth))
        found = kept if found is None else found.unionByName(kept)
    return found.select("query_id", "node_id", "level", "score", "rank")


def collapsed(queries: DataFrame, nodes: DataFrame, k: int, most: int = 3500) -> DataFrame:
    """query_id, node_id, score, rank, tokens, cum: a tree's nodes of all layers as one list, nearest first, while their texts have `most` words together.

    queries (query_id, v), nodes (node_id, v, text). At most k nodes a query are looked at; texts are joined to these only.
    """
    from quern.functions.text import words
    from quern.functions.vectors import nearest
    from quern.operators.fusion import within_budget

    found = nearest(nodes.select("node_id", "v"), queries, k, exclude_same=True)
    sized = found.join(nodes.select("node_id", F.size(words(F.col("text"))).cast("long").alias("tokens")), "node_id")
    return within_budget(sized, most=most).select("query_id", "node_id", "score", "rank", "tokens", "cum")


def depths(edges: DataFrame, most: int = 32) -> DataFrame:
    """node_id, depth of all nodes of edges (parent, child): hops to the root along the smallest parent, at most `most`.

    Nodes in a circle have no root and don't come back. Each round joins the nodes that were found last with their children.
    """
    from quern.store import materialised

    up = edges.groupBy(F.col("child").alias("node_id")).agg(F.min("parent").alias("parent"))
    roots = edges.select(F.col("parent").alias("node_id")).distinct().join(up, "node_id", "left_anti")
    found = last = materialised(roots.withColumn("depth", F.lit(0)))
    for depth in range(1, most + 1):
        last = materialised(up.join(last.select(F.col("node_id").alias("parent")), "parent").select("node_id", F.lit(depth).alias("depth")))
        if last.isEmpty():
            break
        found = found.union(last)
    return found


def children_of(edges: DataFrame) -> DataFrame:
    """parent, children, n of edges (parent, child): each parent's different children in order."""
    return edges.groupBy("parent").agg(F.sort_array(F.collect_set("child")).alias("children")).withColumn("n", F.size("children"))


def layer_map(layers: DataFrame) -> DataFrame:
    """node_id, layer of layers (layer, nodes: an array): a node that stands in several has the lowest."""
    return layers.select(F.explode("nodes").alias("node_id"), "layer").groupBy("node_id").agg(F.min("layer").alias("layer"))


def touched(changed: DataFrame, edges: DataFrame, most: int = 32) -> DataFrame:
    """node_id, height of the nodes over changed (node_id): those whose summaries are to be written again, nearest first.

    height is the longest way up from a change, so that each node comes after all that it is made of.
    """
    from quern.store import materialised

    found, last = None, changed.select("node_id").distinct()
    for height in range(1, most + 1):
        last = materialised(edges.join(last.select(F.col("node_id").alias("child")), "child").select(F.col("parent").alias("node_id")).distinct())
        if last.isEmpty():
            break
        level = last.withColumn("height", F.lit(height))
        found = level if found is None else found.union(level)
    if found is None:
        return changed.sparkSession.createDataFrame([], changed.select("node_id").schema.add("height", "int"))
    return found.groupBy("node_id").agg(F.max("height").alias("height"))


def resummarised(nodes: DataFrame, edges: DataFrame, changed: DataFrame, summarise, most: int = 50, tokens: int = 12_000) -> DataFrame:
    """nodes (node_id, text) in which all that stand over changed (node_id) have new summaries, from the lowest up.

    A summary is made from the texts of up to `most` children, in their order, while they have `tokens` words together.
    """
    from quern.functions.text import words
    from quern.store import materialised

    todo = materialised(touched(changed, edges))
    for height in sorted(r["height"] for r in todo.select("height").distinct().collect()):  # at most as many as a tree has levels
        own = todo.where(F.col("height") == height).select(F.col("node_id").alias("parent"))
        made = edges.join(own, "parent").join(nodes.select(F.col("node_id").alias("child"), "text"), "child").withColumn("w", F.size(words(F.col("text"))))
        order = Window.partitionBy("parent").orderBy("child").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        few = made.withColumn("n", F.count(F.lit(1)).over(order)).withColumn("sum", F.sum("w").over(order)).where((F.col("n") <= most) & ((F.col("sum") <= tokens) | (F.col("n") == 1)))
        joined = few.groupBy("parent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("child", "text"))), lambda s: s["text"]), "\n\n").alias("t"))
        new = joined.select(F.col("parent").alias("node_id"), summarise(F.col("t")).alias("new"))
        nodes = materialised(nodes.join(new, "node_id", "left").withColumn("text", F.coalesce("new", "text")).drop("new"))
    return nodes


def with_nodes(forest: DataFrame, new: DataFrame) -> DataFrame:
    """A forest (tree_id, node_id, ...) with nodes added; one that is there already is replaced."""
    return forest.join(new.select("tree_id", "node_id"), ["tree_id", "node_id"], "left_anti").unionByName(new)


def with_tree(forest: DataFrame, tree: DataFrame) -> DataFrame:
    """A forest with a tree added; nodes of a tree of the same name go."""
    return without_tree(forest, tree.select("tree_id").distinct()).unionByName(tree)


def without_tree(forest: DataFrame, trees: DataFrame) -> DataFrame:
    """A forest without the named trees (tree_id)."""
    return forest.join(trees.select("tree_id"), "tree_id", "left_anti")


def level_sizes(n: int) -> tuple[int, int]:
    """Clusters of the two levels above n chunks; 0 where a level isn't built."""
    k1 = min(max(3, int(n**0.5)), 50) if n > 5 else 0
    return k1, (min(max(2, k1 // 3), 15) if k1 > 5 else 0)


def kmeans_levels(nodes: DataFrame, seed: int = 42) -> DataFrame:
    """node_id, level1, level2 of nodes (node_id, v): k-means on normalised vectors, then on the centroids."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    k1, k2 = level_sizes(nodes.count())
    if not k1:
        return nodes.select("node_id", F.lit(0).alias("level1"), F.lit(0).alias("level2"))
    x = Normalizer(inputCol="raw", outputCol="features").transform(nodes.select("node_id", array_to_vector(F.col("v").cast("array<double>")).alias("raw")))
    first = KMeans(k=k1, seed=seed, featuresCol="features", predictionCol="level1").fit(x).transform(x)
    if not k2:
        return first.select("node_id", "level1", F.lit(0).alias("level2"))
    centers = first.groupBy("level1").agg(F.array(*(F.avg(vector_to_array("features")[i]) for i in range(len(nodes.first()["v"])))).alias("c"))
    top = Normalizer(inputCol="raw", outputCol="features").transform(centers.select("level1", array_to_vector("c").alias("raw")))
    second = KMeans(k=k2, seed=seed, featuresCol="features", predictionCol="level2").fit(top).transform(top)
    return first.select("node_id", "level1").join(second.select("level1", "level2"), "level1").select("node_id", "level1", "level2")


def soft_clusters(nodes: DataFrame, k: int, threshold: float = 0.1, dims: int = 10, seed: int = 224) -> DataFrame:
    """node_id, cluster, p: Gaussian mixture memberships above the threshold on principal components; else the likeliest."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = nodes.select("node_id", array_to_vector(F.col("v").cast("array<double>")).alias("raw"))
    small = PCA(k=dims, inputCol="raw", outputCol="features").fit(x).transform(x)
    p = GaussianMixture(k=k, seed=seed, featuresCol="features").fit(small).transform(small).select("node_id", vector_to_array("probability").alias("p"))
    each = p.select("node_id", F.array_max("p").alias("most"), F.posexplode("p").alias("cluster", "p"))
    return each.where((F.col("p") > threshold) | (F.col("p") == F.col("most"))).select("node_id", "cluster", F.round("p", 6).alias("p"))


def insert(new: DataFrame, parents: DataFrame, least: float = 0.25) -> DataFrame:
    """node_id, parent, is_new of new (node_id, v) under parents (parent, v): the most similar parent, else one of its own.

    All new nodes meet the parents as they stood before, so the result doesn't depend on their order. New parents are
    numbered after the greatest there is, by node_id.
    """
    met = best_parents(new, parents, least)
    top = parents.agg(F.coalesce(F.max("parent"), F.lit(-1)).alias("top"))
    lone = met.where("parent is null").select("node_id", F.xxhash64("node_id").alias("h"))
    # numbered by blocks of the id's hash, so that many new parents aren't gathered in one task
    block = lone.withColumn("b", F.pmod("h", F.lit(64)))
    ahead = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = block.groupBy("b").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0)))  # at most 64 rows
    within = F.row_number().over(Window.partitionBy("b").orderBy("node_id"))
    numbered = block.withColumn("k", within).join(base.select("b", "base"), "b").join(F.broadcast(top)).select("node_id", (F.col("top") + F.col("base") + F.col("k")).alias("parent"), F.lit(True).alias("is_new"))
    return met.where("parent is not null").select("node_id", "parent", F.lit(False).alias("is_new")).unionByName(numbered)


def merge(nodes: DataFrame) -> DataFrame:
    """tree_id, old_index, new_index of nodes (tree_id, index): trees one after the other by name, each in the order of its index."""
    sizes = nodes.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy("tree_id").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("tree_id", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))  # one row a tree
    within = F.row_number().over(Window.partitionBy("tree_id").orderBy("index"))
    return nodes.withColumn("k", within).join(base, "tree_id").select("tree_id", F.col("index").alias("old_index"), (F.col("base") + F.col("k") - 1).alias("new_index"))


def build(leaves: DataFrame, summarise, embed, target: int = 75, layers: int = 5, seed: int = 42, after_layer=None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a tree over leaves (node_id, text, v): layers of k-means clusters with summaries, until at most `target` nodes.

    summarise and embed are ports; after_layer, if given, is a function from a new layer's nodes and its number to the nodes that
    are taken instead. Each layer is written before the next is built. A cluster's summary is made from its
    `SHOWN` members nearest to the centroid.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from quern.store import materialised

    nodes = layer = materialised(leaves.select("node_id", "text", F.col("v").cast("array<double>").alias("v"), F.lit(0).alias("layer")))
    edges = None
    for depth in range(1, layers + 1):
        n = layer.count()
        if n <= target or n <= 2:
            break
        k = max(2, int(n**0.5))
        x = layer.select("node_id", "text", "v", array_to_vector("v").alias("features"))
        labelled = materialised(KMeans(k=k, seed=seed, predictionCol="cluster").fit(x).transform(x).select("node_id", "text", "v", "cluster"))
        near = nearest_members(labelled, centroids(labelled), SHOWN).join(labelled.select("node_id", "text"), "node_id")
        joined = near.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]), "\n\n").alias("t"))
        name = F.concat(F.lit(f"L{depth}_"), F.col("cluster").cast("string"))
        made = joined.select(name.alias("node_id"), summarise(F.col("t")).alias("text")).select("node_id", "text", embed(F.col("text")).alias("v"), F.lit(depth).alias("layer"))
        layer = materialised(made if after_layer is None else after_layer(made, depth))
        more = labelled.select(name.alias("parent"), F.col("node_id").cast("string").alias("child"))
        nodes = nodes.withColumn("node_id", F.col("node_id").cast("string")).unionByName(layer)
        edges = more if edges is None else edges.unionByName(more)
    if edges is None:
        edges = nodes.sparkSession.createDataFrame([], "parent string, child string")
    return nodes.withColumn("node_id", F.col("node_id").cast("string")), edges


def best_mixture(nodes: DataFrame, most: int, dims: int = 10, seed: int = 224) -> DataFrame:
    """k, bic of Gaussian mixtures of 1 to `most` parts (at most as many as nodes) on principal components; the least bic is best."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    x = nodes.select(array_to_vector(F.col("v").cast("array<double>")).alias("raw"))
    n = x.count()
    small = PCA(k=dims, inputCol="raw", outputCol="features").fit(x).transform(x).select("features").persist()
    rows = []
    for k in range(1, min(most, n) + 1):
        likelihood = GaussianMixture(k=max(2, k), seed=seed, maxIter=20).fit(small).summary.logLikelihood if k > 1 else _one_gaussian(small, n, dims)
        free = k * (dims + dims * (dims + 1) / 2) + k - 1
        rows.append((k, round(free * math.log(n) - 2 * likelihood, 3)))
    small.unpersist()
    return nodes.sparkSession.createDataFrame(rows, "k long, bic double")


def _one_gaussian(points: DataFrame, n: int, dims: int) -> float:
    """The log likelihood of one Gaussian with the points' mean and covariance."""
    import numpy as np
    from pyspark.ml.functions import vector_to_array

    v = points.select(vector_to_array("features").alias("v"))
    cells = [F.covar_pop(F.col("v")[i], F.col("v")[j]).alias(f"c{i}_{j}") for i in range(dims) for j in range(dims)]
    cov = np.array(list(v.agg(*cells).first())).reshape(dims, dims)
    return float(-0.5 * n * (dims * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + dims))


def without_layers_above(nodes: DataFrame, edges: DataFrame, layer: int) -> tuple[DataFrame, DataFrame]:
    """A tree cut above a layer, ready for build() from there: its nodes, and the edges whose parent stays."""
    kept = nodes.where(F.col("layer") <= layer)
    return kept, edges.join(kept.select(F.col("node_id").alias("parent")), "parent", "left_semi")


def sliced_children(edges: DataFrame, most: int = 300) -> DataFrame:
    """edges (parent, child) with parents of over `most` children cut in several: adds `slice`."""
    order = Window.partitionBy("parent").orderBy("child")
    return edges.withColumn("slice", F.floor((F.row_number().over(order) - 1) / most).cast("int"))
