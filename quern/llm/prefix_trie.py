"""A trie of conversation prefixes, encoded as preorder intervals.

A node is a distinct sequence of first turns; its members are the conversations that start with it. Each turn is a 128-bit
hash of its role and text, and a conversation the string of its turns' hashes, so equal conversations are one class.
Classes are ranked by sorting these strings over ranges. Lexicographic order is preorder: a class adds, after the nodes
of the classes before, those of its prefixes that no earlier class has, and the classes below a node are neighbours. So a
node is known by the ranks of its first and last class. It is found by grouping the prefixes of all classes, which task by
task keeps only counts and extremes, and its subtree is the interval from its own position to the end of its last class.
Leaves and savings of a subtree are differences of prefix sums along the preorder, worked out in blocks of classes.

Members that end at a node are hashed in numeric order: ranges of them are joined to chunks by many tasks, and one pass
over a node's chunks hashes them without ever holding all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import scratch, table, told, written

#: Bytes of a turn's hash; classes of a range; the least bits of ranks that a block of prefix sums spans, and the blocks that it may come to.
MARK, RANGE_OF, BLOCK_BITS, BLOCKS = 16, 50_000, 12, 1_000_000
#: Ids of a chunk, chunks and other rows that a task hands on at once.
CHUNK, CHUNKS, SENT = 4096, 250, 10_000
#: Fixed values of the query's contract: conversations that share a start, and one more than the turns that they can share.
GRAFTED, HEADS = 5, 9
NOBODY = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, key (its turns' hashes) and sizes (the UTF-8 bytes of their texts), of turns (conv_id, turn, role, text).

    Turns are in the order of turn (null first), role, text. Null roles and texts are empty; rows without conv_id belong to
    no conversation. Of repeated rows each is a turn. A conversation is one row from here on, at 24 bytes a turn.
    """
    plain = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    mark = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    marked = plain.select("conv_id", place.alias("place"), mark.alias("mark"), F.octet_length("text").cast("long").alias("size"))
    whole = marked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "mark", "size"))).alias("t"))
    return whole.select("conv_id", F.unhex(F.array_join("t.mark", "")).alias("key"), F.col("t.size").alias("sizes"))


def grafted(found: DataFrame) -> DataFrame:
    """sequences() rebuilt by the query's contract: the first h turns of conversation c - c % 5, then c's own after its first h."""
    own = found.withColumn("base", F.expr(f"conv_id - conv_id % {GRAFTED}")).withColumn("h", F.expr(f"cast(crc32(cast(conv_id AS string)) % {HEADS} AS int)"))
    heads = found.where(f"conv_id % {GRAFTED} = 0").select(F.col("conv_id").alias("of"), F.substring("key", 1, MARK * (HEADS - 1)).alias("head"), F.slice("sizes", 1, HEADS - 1).alias("head_sizes"))
    # at most nine conversations have one base
    joined = own.join(heads, F.col("base") == F.col("of"), "left")
    key = F.concat(F.coalesce(F.expr(f"substring(head, 1, {MARK} * h)"), F.lit(b"")), F.expr(f"substring(key, {MARK} * h + 1)"))
    sizes = F.concat(F.coalesce(F.expr("slice(head_sizes, 1, h)"), F.expr("cast(array() AS array<bigint>)")), F.expr("slice(sizes, h + 1, greatest(size(sizes) - h, 0))"))
    return joined.select("conv_id", key.alias("key"), sizes.alias("sizes"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class (rank, key, sizes, n_convs, conv_id) the nodes on its path from the root; a node's id is the hash chain of its turns."""
    names = PATH.names
    rows: list[tuple] = []
    for batch in batches:
        for rank, key, sizes, n, conv in zip(*(batch.column(c).to_pylist() for c in ("rank", "key", "sizes", "n_convs", "conv_id")), strict=True):
            node, parent, depth = bytes(MARK), None, len(key) // MARK
            for d in range(depth + 1):
                if d:
                    parent, node = node, hashlib.md5(node + key[MARK * (d - 1) : MARK * d]).digest()
                rows.append((node, parent, d, sizes[d - 1] if d else 0, rank, n, conv, d == depth))
                if len(rows) == SENT:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PATH.types, strict=True)], names)
                    rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PATH.types, strict=True)], names)


PATH = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("size", pa.int64()), ("rank", pa.int64()), ("n_convs", pa.int64()), ("conv_id", pa.int64()), ("terminal", pa.bool_())])
PATH_DDL = "node binary, parent binary, depth long, size long, rank long, n_convs long, conv_id long, terminal boolean"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (class, conv_id) as chunks (class, start, ids): up to CHUNK ids of a class, joined by commas."""
    now, ids, out = None, [], []

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["class", "start", "ids"])

    for batch in batches:
        for key, conv in zip(batch.column("class").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if key != now or len(ids) == CHUNK:
                if ids:
                    out.append((now, ids[0], ",".join(map(str, ids))))
                now, ids = key, []
                if len(out) == CHUNKS:
                    yield packed()
                    out = []
            ids.append(conv)
    if ids:
        out.append((now, ids[0], ",".join(map(str, ids))))
    if out:
        yield packed()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks (class, start, ids) as (class, ends_sha256); of a class only the hash's state is held."""
    now, state, keys, found = None, None, [], []
    for batch in batches:
        for key, ids in zip(batch.column("class").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key == now:
                state.update(b",")
            else:
                if state is not None:
                    keys.append(now)
                    found.append(state.hexdigest())
                now, state = key, hashlib.sha256()
            state.update(ids.encode())
        if len(keys) >= SENT:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], ["class", "ends_sha256"])
            keys, found = [], []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([*keys, now], pa.string()), pa.array([*found, state.hexdigest()], pa.string())], ["class", "ends_sha256"])


def prefix_trie(found: DataFrame) -> DataFrame:
    """The nodes of the conversations of found (conv_id, key, sizes), as sequences() gives them, each id once.

    Returns conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, members less one times bytes of the node's last text), ends_sha256 (of the ids of
    members that end here), pos and end_pos (the subtree's interval in preorder, the end not in it). Conversations without
    turns are members of the root; without conversations there is no node.
    """
    spark = found.sparkSession
    with scratch(spark) as kept:
        convs = written(found.withColumn("class", F.md5("key")), "sequences")
        ranges = max(16, -(-convs.count() // RANGE_OF))
        classes = written(convs.groupBy("class", "key", "sizes").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")), "classes")
        ranked = written(classes.repartitionByRange(ranges, "key").sortWithinPartitions("key").withColumn("rank", F.monotonically_increasing_id()), "ranked")

        paths = ranked.select("rank", "key", "sizes", "n_convs", "conv_id").mapInArrow(_paths, PATH_DDL)
        nodes = paths.groupBy("node", "parent", "depth", "size").agg(
            F.min("rank").alias("first"), F.max("rank").alias("last"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.bool_or("terminal").alias("terminal")
        )
        # a class that ends at a node comes first below it, so a node is childless if that is its last class too
        nodes = nodes.withColumn("leaf", (F.col("terminal") & (F.col("first") == F.col("last"))).cast("long")).withColumn("own", (F.col("n_convs") - 1) * F.col("size"))
        nodes = written(nodes, "nodes")

        bits = max(BLOCK_BITS, (ranked.count() // BLOCKS).bit_length())
        summed = {"pos": F.lit(1).cast("long"), "leaves": F.col("leaf"), "saved": F.col("own")}
        blocked = nodes.withColumn("block", F.shiftright("first", bits))
        blocks = blocked.groupBy("block").agg(*(F.sum(v).alias(f"block_{c}") for c, v in summed.items()))
        ahead = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        before = written(blocks.select(F.col("block").alias("of"), *(F.coalesce(F.sum(f"block_{c}").over(ahead), F.lit(0)).alias(f"ahead_{c}") for c in summed)), "blocks")
        inside = Window.partitionBy("block").orderBy("first", "depth").rowsBetween(Window.unboundedPreceding, -1)
        local = blocked.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(c) for c, v in summed.items()))
        placed = local.join(told(before), F.col("block") == F.col("of"))
        placed = written(placed.select("node", "parent", "depth", "first", "last", "n_convs", "conv_id", "terminal", "leaf", "own", *((F.col(c) + F.col(f"ahead_{c}")).alias(c) for c in summed)), "placed")

        upto = placed.groupBy(F.col("first").alias("rank")).agg((F.max("pos") + 1).alias("end_pos"), F.max(F.col("leaves") + F.col("leaf")).alias("end_leaves"), F.max(F.col("saved") + F.col("own")).alias("end_saved"))
        out = placed.join(upto, F.col("last") == F.col("rank")).drop("rank")

        sized = convs.select("class", "conv_id").repartitionByRange(ranges, "class", "conv_id").sortWithinPartitions("class", "conv_id")
        chunks = written(sized.mapInArrow(_chunks, "class string, start long, ids string"), "chunks")
        digests = chunks.repartition("class").sortWithinPartitions("class", "start").mapInArrow(_digests, "class string, ends_sha256 string")
        ends = digests.join(ranked.select("class", "rank"), "class").select(F.col("rank").alias("end_rank"), "ends_sha256")
        out = out.join(ends, F.col("first") == F.col("end_rank"), "left").withColumn("ends_sha256", F.when(F.col("terminal"), F.col("ends_sha256")).otherwise(NOBODY))

        below = placed.where("parent IS NOT NULL").groupBy(F.col("parent").alias("above")).agg(F.count(F.lit(1)).alias("n_children"))
        # the children of one node may be a third of all: this side of the join is split where it is skewed
        parents = placed.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
        out = out.join(below, F.col("node") == F.col("above"), "left").join(parents, F.col("parent") == F.col("up"), "left")
        out = out.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
            (F.col("end_leaves") - F.col("leaves")).alias("n_leaves"), (F.col("end_saved") - F.col("saved")).alias("saved_tokens"), "ends_sha256", "pos", "end_pos",
        )
        kept.append(out := written(out, "trie"))
    return out


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt by the contract."""
    return prefix_trie(grafted(written(sequences(table(spark, sf_dir, "conversations")), "sequences"))).drop("pos", "end_pos")


#: The same in DuckDB, by the prefixes themselves. DuckDB has no crc32: the fold shifts bit by bit.
SQL = f"""
WITH own AS (
  SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
hashed AS (
  SELECT c, t, c - c % {GRAFTED} AS base, (xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % {HEADS})::INT AS h
  FROM own
),
rebuilt AS (SELECT a.c, list_concat(coalesce(b.t[1:a.h], []), a.t[a.h + 1:]) AS t FROM hashed a LEFT JOIN own b ON a.base = b.c),
member AS (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt),
node AS (
  SELECT d, t[1:d] AS p, count(*) AS n, min(c) AS c, string_agg(CASE WHEN len(t) = d THEN c::VARCHAR END, ',' ORDER BY c) AS ends, max(len(t)) AS longest
  FROM member GROUP BY ALL
),
valued AS (SELECT *, longest = d AS leaf, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * strlen(p[d].text) END AS own FROM node),
up AS (SELECT *, unnest(range(0, d + 1)) AS a FROM valued),
sums AS (SELECT a, p[1:a] AS p, sum(leaf::INT) AS leaves, sum(own) AS saved, count(*) FILTER (d = a + 1) AS children FROM up GROUP BY ALL)
SELECT v.c::BIGINT AS conv_id, v.d::BIGINT AS depth, u.c::BIGINT AS parent_conv_id, v.n::BIGINT AS n_convs, s.children::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM valued v JOIN sums s ON s.a = v.d AND s.p = v.p LEFT JOIN valued u ON u.d = v.d - 1 AND u.p = v.p[1:v.d - 1]
"""
