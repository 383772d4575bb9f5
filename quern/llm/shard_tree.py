"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws -ln(u)/weight, u from the hash of the row's key
and the child's name, and the least draw wins: children get rows in proportion to their weights, and a change of one
child's weight moves rows only into or out of that child. Where weights below a node stay as they are, its rows stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import few_decoded, fresh, numbered, table, unit_draw


@dataclass(frozen=True)
class Leaf:
    """A shard and where it stands; weight is its share relative to other shards."""

    shard: int
    region: str
    rack: str
    weight: float = 1.0


def balanced_tree(shards: int = 8, regions: int = 2, racks: int = 2) -> list[Leaf]:
    """`shards` equal leaves, dealt over `regions` with `racks` each."""
    cells = regions * racks
    return [Leaf(k, f"r{k * cells // shards // racks}", f"r{k * cells // shards // racks}k{k * cells // shards % racks}") for k in range(shards)]


def grown_tree(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region of its own: no other region's, rack's or shard's weight changes, so rows move only into it."""
    k = max((x.shard for x in tree), default=-1) + 1
    return [*tree, Leaf(k, f"grown{k}", f"grown{k}k", weight)]


def _pick(key: list[Column], level: str, children: dict[str, float]) -> Column:
    """The child's name with the least draw; ties go to the smaller name."""
    draws = [F.struct((-F.log(unit_draw(F.lit(f"{level}/{name}"), *key)) / F.lit(float(w))).alias("draw"), F.lit(name).alias("name")) for name, w in sorted(children.items()) if w > 0]
    if not draws:
        raise ValueError(f"no child of positive weight at {level}")
    return draws[0]["name"] if len(draws) == 1 else F.least(*draws)["name"]


def shard_of(key: list[Column], tree: list[Leaf]) -> Column:
    """The shard of a key. A null in the key is a value like others."""
    total: dict[tuple[str, ...], float] = {}
    for x in tree:
        if x.weight < 0:
            raise ValueError("weights aren't negative")
        for path in ((x.region,), (x.region, x.rack), (x.region, x.rack, str(x.shard))):
            total[path] = total.get(path, 0.0) + x.weight

    def below(path: tuple[str, ...]) -> Column:
        if len(path) == 3:
            return F.lit(int(path[2]))
        children = {p[-1]: w for p, w in total.items() if p[:-1] == path and w > 0}
        if len(children) == 1:
            return below((*path, next(iter(children))))
        picked, out = _pick(key, "/".join(("tree", *path)), children), None
        for name in sorted(children):
            out = F.when(picked == name, below((*path, name))) if out is None else out.when(picked == name, below((*path, name)))
        return out

    return below(()).cast("int")


def assign_shards(docs: DataFrame, tree: list[Leaf], key: str = "doc_id", shard: str = "shard") -> DataFrame:
    """docs with the shard that each row's key decides: a projection, no shuffle.

    Every row is kept, repeated rows and null keys too (nulls share one shard); an empty table stays empty. Other
    columns pass through; if one has the new column's name, the new one gets an underscore more.
    """
    return docs.withColumn(fresh(docs, shard)[0], shard_of([F.col(key).cast("string")], tree))


def op3_shard_tree(spark, sf_dir: str) -> DataFrame:
    """documents dealt to 8 shards by key, with what a ninth shard would take."""
    few_decoded(spark)
    docs, tree = table(spark, sf_dir, "documents").select("doc_id", "text"), balanced_tree(8)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    grown = shard_of([F.col("doc_id").cast("string")], grown_tree(tree))
    rows = assign_shards(docs, tree).select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), "shard", grown.alias("grown_shard"))
    out = numbered(rows, ["shard"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
