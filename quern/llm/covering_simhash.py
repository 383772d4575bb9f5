"""SimHash near-duplicates found by covering locality-sensitive hashing.

Every bit position i of a fingerprint has a vector m(i), not zero, of radius + 1 bits. For each vector v that isn't zero there is a
table whose mask keeps the positions with <m(i), v> = 1. At most `radius` positions in which two fingerprints differ
have vectors that span at most `radius` dimensions, so some v is orthogonal to all of them: that table's mask drops
every differing bit and the two meet there. No pair within the radius is missed, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import few_decoded, fresh, relieve, scratch, spread, table, tidied, told, written
from quern.llm.components import components

#: Shingles hashed at a time, so that a text of any length takes bounded memory.
PIECE = 1 << 16
#: Fingerprints of one bucket that are compared with each other; larger buckets are split by a further set of masks.
BUCKET = 4096


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """The XXH64 hashes of a text's word shingles, in pieces. Words are lower-cased in A-Z; fewer words make one shingle, none make none."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()
    if not parts:
        return
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(parts) > words:
        starts, ends = starts[: 1 - words or None], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    for k in range(0, len(starts), PIECE):
        yield np.array([xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[k : k + PIECE].tolist(), ends[k : k + PIECE].tolist(), strict=True)], dtype=np.uint64)


def simhash(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint: a bit is 1 if it is set in over half of the shingle hashes; zero for a text without words."""
    return _print_of(shingle_hashes(text, words, seed))


def _print_of(pieces) -> int:
    n, ones = 0, np.zeros(64, dtype=np.int64)
    for h in pieces:
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """(key, fp): every row's fingerprint as a signed 64-bit integer. Null and empty texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([simhash(t.as_py(), words, seed) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], names=[key, "fp"])

    rows = docs.select(F.col(key).cast("long").alias(key), "text")
    return rows.mapInArrow(tidied(run), f"{key} long, fp long")


def masks(radius: int, level: int = 0, bits: int = 64) -> list[int]:
    """The 2^(radius+1) - 1 masks, as signed 64-bit integers; each level deals the vectors m(i) to the positions anew."""
    n = (1 << radius + 1) - 1
    m = np.random.default_rng(level).permutation(bits) % n + 1
    kept = [sum(1 << int(i) for i in range(bits) if bin(int(m[i]) & v).count("1") % 2) for v in range(1, n + 1)]
    return [k - (1 << 64) if k >> 63 else k for k in kept]


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect all members within the radius, one for each member after the first of its component."""
    left, out = np.arange(len(fps)), []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= radius
            if near.any():
                found, left = left[near].tolist(), left[~near]
                out += [(at, f) for f in found]
                front += found
    return out


def _link(radius: int, bucket: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (path, key): links of the partition's forest, and the rows of buckets that are too large."""
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = p
            return x

        def send(kind: int, a, b, path) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *(pa.array(np.asarray(x, dtype=np.int64)) for x in (a, b, path))], names=["kind", "a", "b", "path"])

        rest, over = None, None  # the last bucket so far; the (path, key) of one that is being passed on
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            path, key, node, fp = cols
            if not len(path):
                continue
            cut = np.flatnonzero((path[1:] != path[:-1]) | (key[1:] != key[:-1])) + 1
            edges = np.concatenate(([0], cut, [len(path)]))
            last = edges[-2]
            yield from done(edges[:-1], cols, parent, root, send, over)
            if last > 0:
                over = None
            rest = [c[last:] for c in cols]
            if len(rest[0]) > bucket:
                over = (rest[0][0], rest[1][0])
                yield send(1, rest[2], rest[3], rest[0])
                rest = [c[-1:] for c in rest]  # keeps the bucket's name; its own row has been sent
        if rest is not None and len(rest[0]):
            yield from done(np.array([0, len(rest[0])]), rest, parent, root, send, over)

    def done(edges, cols, parent, root, send, over) -> Iterator[pa.RecordBatch]:
        path, key, node, fp = cols
        sizes, found = np.diff(edges), []
        for g in np.flatnonzero(sizes > 1).tolist():
            lo, hi = int(edges[g]), int(edges[g + 1])
            if over == (path[lo], key[lo]):
                yield send(1, node[lo + 1 : hi], fp[lo + 1 : hi], path[lo + 1 : hi])
            elif hi - lo > bucket:
                yield send(1, node[lo:hi], fp[lo:hi], path[lo:hi])
            else:
                nodes = node[lo:hi]
                for i, j in _forest(fp[lo:hi].view(np.uint64), radius):
                    a, b = int(nodes[i]), int(nodes[j])
                    if (x := root(a)) != (y := root(b)):
                        parent[max(x, y)] = min(x, y)
                        found.append((a, b))
        if found:
            a, b = zip(*found, strict=True)
            yield send(0, a, b, np.zeros(len(a)))

    return run


def links(nodes: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between nodes (node, fp[, kind]) that connect what all pairs within `radius` differing bits connect.

    Fingerprints of different `kind` don't meet. Give each fingerprint of a kind once, or as few times as can be. In a
    bucket of up to `bucket` rows every pair is compared; a larger one is dealt again by masks that fix further bits,
    until it is small or all bits are fixed, so no pair is lost and no task compares more than bucket^2 pairs at a time.
    """
    kind = F.col("kind").cast("long") if "kind" in nodes.columns else F.lit(0).cast("long")
    rows = nodes.where(F.col("fp").isNotNull()).select(kind.alias("path"), "node", "fp")
    out, level = [], 0
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        # a path has a digit of base 512 for each level, and decides the mask, so masks and keys aren't sent along
        tables = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(masks(radius)) - 1).cast("long")))
        dealt = rows.select("path", tables.alias("t"), "node", "fp").select((F.col("path") * 512 + F.col("t")).alias("path"), "node", "fp")
        key = F.col("fp").bitwiseAND(_mask_of(radius, level))
        limit = bucket if level < 5 else 1 << 62
        met = dealt.repartition(n, F.col("path"), key).sortWithinPartitions(F.col("path"), key, "fp").select("path", key.alias("key"), "node", "fp").mapInArrow(tidied(_link(radius, limit)), "kind int, a long, b long, path long")
        got = written(met, f"level{level}")
        out.append(got.where("kind = 0").select("a", "b"))
        if got.where("kind = 1").isEmpty():
            break
        rows = got.where("kind = 1").select("path", F.col("a").alias("node"), F.col("b").alias("fp"))
        level += 1
    whole = out[0]
    for x in out[1:]:
        whole = whole.union(x)
    return whole


def _mask_of(radius: int, level: int):
    """The mask of a path: all bits that its tables' masks keep."""
    out = F.lit(0).cast("long")
    for at in range(level + 1):
        digit = F.pmod(F.shiftright("path", 9 * (level - at)), F.lit(512)).cast("int") + 1
        out = out.bitwiseOR(F.element_at(F.array(*(F.lit(m) for m in masks(radius, at))), digit))
    return out


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42, key: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """(key, fp, component_id): the smallest key that is reachable over links of at most `radius` differing bits.

    Every row comes back, repeated rows too. Texts without words (null, empty, white space) have fingerprint zero and
    are linked like any other. A row with a null key is in its component but never names it, unless all keys there are
    null. Equal fingerprints are one node, so groups of copies of any size cost one row. Other columns are ignored.
    """
    fps = written(fingerprints(docs, words, seed, key), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min(key).alias("least"))
    roots = components(links(classes.select(F.col("fp").alias("node"), "fp"), radius, bucket))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # written, so that the join is between two exchanges, of which a large component's partition can be split
    names = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    return fps.join(rooted.join(names, "root").select("fp", "component_id"), "fp").select(key, "fp", "component_id")


#: Bits of a set's parity map at least and at most, and members of a block: a bucket of more is compared block by block.
MAP_BITS, MOST_BITS, MEMBERS = 1024, 1 << 16, 2048
#: Bits of the sieve that is told to all executors of hashes that stand in two texts or more.
SIEVE_BITS = 1 << 26
#: Cells that shingle hashes fall into, and rows of which three have a frequent shingle's cell. Which are frequent decides only the cost.
CELLS, FREQUENT_IN = 1 << 24, 8_000
#: Cells that are summed at a time, cells that a task holds until it sends their counts, and the most rows these are from, so that 16 bits count them.
SLICE, HELD, ROWS_HELD = 1 << 16, 1 << 18, 60_000


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The different hashes of a text's shingles, sorted."""
    found = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def prefix(hashes: np.ndarray, similarity: float, frequent: np.ndarray) -> np.ndarray:
    """The hashes of a set of which any set of that Jaccard similarity has one in its own prefix: the first in an order that is the same for all sets.

    Sets of similarity t share at least t of the larger, so of each at most n - ceil(t n) are missing in the other, and
    one more than that can't all be. Hashes in frequent cells (a bit each) come last, others by value. A set without
    hashes has the prefix 0.
    """
    if not len(hashes):
        return np.zeros(1, np.uint64)
    cell = (hashes % CELLS).astype(np.int64)
    often = (frequent[cell >> 3] >> (cell & 7) & 1).astype(bool)
    hashes = np.concatenate((hashes[~often], hashes[often]))
    return hashes[: len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets; 1 of two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _frequent(rows: DataFrame, words: int, texts: int = FREQUENT_IN, held: int = HELD) -> np.ndarray:
    """A bit for each cell: whether three or more rows, and three or more in `texts`, have a shingle hash in it. Every row is counted."""

    def counts(parts: list[np.ndarray]) -> pa.RecordBatch:
        cell, n = np.unique(np.concatenate(parts), return_counts=True)
        cut = np.flatnonzero(cell[1:] // SLICE != cell[:-1] // SLICE) + 1
        edges = [0, *cut.tolist(), len(cell)]
        place, n = (cell % SLICE).astype(np.uint16), n.astype(np.uint16)
        columns = [pa.array([x[lo:hi].tobytes() for lo, hi in zip(edges, edges[1:], strict=False)], pa.binary()) for x in (place, n)]
        return pa.RecordBatch.from_arrays([pa.array((cell[edges[:-1]] // SLICE).astype(np.int32)), *columns], names=["slice", "place", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            for t in b.column(0):
                if found := list(shingle_hashes(t.as_py(), words)):
                    parts.append(np.unique((np.concatenate(found) % CELLS).astype(np.uint32)))
                    size += len(parts[-1])
                if size >= held or len(parts) >= ROWS_HELD:
                    yield counts(parts)
                    parts, size = [], 0
        if parts:
            yield counts(parts)

    least = max(3, -(-3 * rows.count() // texts))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by slice: the slices that have frequent cells, a bit a cell."""

        def bits() -> Iterator[pa.RecordBatch]:
            if name is not None and (often := total >= least).any():
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([np.packbits(often, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

        name, total = None, np.zeros(SLICE, np.int64)
        for b in batches:
            for at, place, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != name:
                    yield from bits()
                    name, total = at, np.zeros(SLICE, np.int64)
                total[np.frombuffer(place, np.uint16)] += np.frombuffer(n, np.uint16)
        yield from bits()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.select("text").mapInArrow(tidied(run), "slice int, place binary, n binary")
    summed = counted.repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(tidied(add), "slice int, bits binary")
    got, out = summed.toArrow(), np.zeros((CELLS // SLICE, SLICE // 8), np.uint8)  # 2 MB, however many rows there are
    for at, bits in zip(*(c.to_pylist() for c in got.columns), strict=True):
        out[at] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def parity_map(hashes: np.ndarray) -> bytes:
    """For each bit whether an odd number of the hashes falls on it. Maps differ in no more bits than their sets in members.

    A map has two bits a member or more, a power of two; halves of a larger one, put over each other, are the smaller one.
    """
    bits = MAP_BITS
    while bits < min(2 * len(hashes), MOST_BITS):
        bits *= 2
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1, bitorder="little").tobytes()


def _apart(maps: list[np.ndarray], r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """In how many bits the maps of rows r and c differ, the larger of two folded to the other's size."""
    sizes, out = np.array([len(m) for m in maps]), np.zeros(len(r), np.int64)
    for size in np.unique(np.minimum(sizes[r], sizes[c])):
        here = np.flatnonzero(np.minimum(sizes[r], sizes[c]) == size)
        rows = np.unique(np.concatenate((r[here], c[here])))
        table = np.stack([np.bitwise_xor.reduce(maps[k].reshape(-1, size), axis=0) for k in rows.tolist()])
        step = max(1, (1 << 20) // int(size))  # words that are compared at a time
        for k in range(0, len(here), step):
            part = here[k : k + step]
            both = table[np.searchsorted(rows, r[part])] ^ table[np.searchsorted(rows, c[part])]
            out[part] = np.bitwise_count(both).sum(axis=1)
    return out


def _compare(similarity: float, best: bool):
    """Pairs that can be similar, from rows (token, lo, hi, block, node, n, root, map) sorted by token, lo and hi.

    Such a group holds one block of a bucket, or two whose members are paired across. Members of one root aren't paired.
    Sets of sizes m and n and similarity t differ in (1 - t) / (1 + t) (m + n) members at most, so those whose maps
    differ in more bits are left out. `best`: of each two roots of a group only the pair that is nearest to that bound.
    """

    def pairs(block, node, n, root, maps) -> Iterator[np.ndarray]:
        cross = block[0] != block[-1] if len(block) else False
        first = int(np.searchsorted(block, block[-1])) if cross else len(block)
        for i in range(0, first, 128):
            rows = np.arange(i, min(first, i + 128))
            cols = np.arange(first if cross else i, len(node))
            size = n[rows][:, None] + n[cols][None]
            least = np.minimum(n[rows][:, None], n[cols][None])
            may = (root[rows][:, None] != root[cols][None]) & (least >= similarity * (size - least) - 1e-6)
            if not cross:
                may &= cols[None] > rows[:, None]
            r, c = np.nonzero(may)
            if not len(r):
                continue
            r, c = rows[r], cols[c]
            apart, allowed = _apart(maps, r, c), (1 - similarity) / (1 + similarity) * (n[r] + n[c])
            near = apart <= allowed + 1e-6
            r, c, rank = r[near], c[near], (apart - allowed)[near]
            if best and len(r):
                x, y = np.minimum(root[r], root[c]), np.maximum(root[r], root[c])
                order = np.lexsort((node[c], node[r], rank, y, x))
                r, c, x, y = r[order], c[order], x[order], y[order]
                new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
                r, c = r[new], c[new]
            if len(r):
                yield np.stack((np.minimum(node[r], node[c]), np.maximum(node[r], node[c])))

    def group(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        *columns, raw = zip(*parts, strict=True)
        block, node, n, root = (np.concatenate(x) for x in columns)
        order = np.lexsort((node, block))
        maps = [m for part in raw for m in part]
        maps = [np.frombuffer(maps[k], np.uint64) for k in order.tolist()]
        for both in pairs(block[order], node[order], n[order].astype(np.int64), root[order], maps):
            for k in range(0, both.shape[1], 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(both[0, k : k + (1 << 17)]), pa.array(both[1, k : k + (1 << 17)])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None
        for b in batches:
            if not b.num_rows:
                continue
            token, lo, hi, block, node, n, root = (b.column(k).to_numpy() for k in range(7))
            maps = b.column(7).to_pylist()
            cut = np.flatnonzero((token[1:] != token[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(token)], strict=True):
                if (here := (token[x], lo[x], hi[x])) != name and held:
                    yield from group(held)
                    held = []
                name = here
                held.append(tuple(c[x:y] for c in (block, node, n, root, maps)))
        if held:
            yield from group(held)

    return run


def _several_cells(rows: DataFrame) -> np.ndarray:
    """A bit for each of SIEVE_BITS cells: whether a token of it stands in two of rows (first: different tokens) or more.

    Tokens are moved as packed arrays, by ranges of cells; a task sorts those of one range at a time, so no table of all
    different tokens is built.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(SIEVE_BITS // 64, 1 << max(6, (n - 1).bit_length()))
    width = SIEVE_BITS // ranges

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            token = b.column(0).flatten().to_numpy()
            at = (token & np.int64(SIEVE_BITS - 1)) // width
            order = np.argsort(at, kind="stable")
            token, at = token[order], at[order]
            edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)] if len(at) else [0]
            packed = [token[lo:hi].tobytes() for lo, hi in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(at[edges[:-1]].astype(np.int32)), pa.array(packed, pa.binary())], names=["range", "tokens"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bits(name: int, parts: list[bytes]) -> pa.RecordBatch:
            token = np.sort(np.frombuffer(b"".join(parts), np.int64))
            again = token[1:][token[1:] == token[:-1]]
            cells = np.zeros(width, bool)
            cells[(again & np.int64(SIEVE_BITS - 1)) - name * width] = True
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([np.packbits(cells, bitorder="little").tobytes()], pa.binary())], names=["range", "bits"])

        name, parts = None, []
        for b in batches:
            for at, tokens in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != name:
                    if parts:
                        yield bits(name, parts)
                    name, parts = at, []
                parts.append(tokens)
        if parts:
            yield bits(name, parts)

    dealt = rows.mapInArrow(tidied(deal), "range int, tokens binary").repartition(n, "range").sortWithinPartitions("range")
    got, out = dealt.mapInArrow(tidied(mark), "range int, bits binary").toArrow(), np.zeros((ranges, width // 8), np.uint8)  # SIEVE_BITS, however many rows there are
    for at, found in zip(*(c.to_pylist() for c in got.columns), strict=True):
        out[at] = np.frombuffer(found, np.uint8)
    return out.reshape(-1)


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", radius: int = 4) -> DataFrame:
    """(key, node, root, group_id, copies): rows whose texts are linked by shingle similarity have the same root, and group_id, their smallest key.

    Texts are linked if the Jaccard similarity of all their shingle hashes is `similarity` or more. First the covering
    tables give links between SimHashes within `radius` bits, which are tested. SimHashes of texts that are just
    similar enough may lie farther apart, so the rest is found exactly: every similar pair shares a hash of its prefixes and
    meets in that hash's bucket, and is tested unless links that passed the test connect it already. So the groups
    are those of all pairs, whatever the partitioning. Equal texts are one node (xxhash64 of the text; null is empty).
    Every row comes back; `copies` counts rows of equal key and text.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias(key), F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), "text")
    frequent = spark.sparkContext.broadcast(_frequent(rows, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, first, prints, maps = [], [], [], []
            for t in b.column(2).to_pylist():
                found = list(shingle_hashes(t, words))
                h = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
                sizes.append(len(h))
                first.append(prefix(h, similarity, frequent.value).view(np.int64))
                prints.append(_print_of(found))
                maps.append(parity_map(h))
            columns = [b.column(0), b.column(1), pa.array(sizes, pa.int32()), pa.array(first, pa.list_(pa.int64())), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "node", "n", "first", "fp", "map"])

    signed = written(rows.mapInArrow(tidied(run), f"{key} long, node long, n int, first array<long>, fp long, map binary"), "signatures")
    nodes = written(signed.groupBy("node").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("rows")), "nodes")
    # one row of each text: not those whose key isn't the least, and of rows that agree in both one
    others = signed.select(key, "node").join(nodes, "node").where(~F.col(key).eqNullSafe(F.col("least"))).select(F.col(key).alias("other_key"), F.col("node").alias("other_node"))
    once = signed.join(told(written(others, "others")), F.col(key).eqNullSafe(F.col("other_key")) & (F.col("node") == F.col("other_node")), "left_anti")
    if once.count() > nodes.count():
        once = written(once.dropDuplicates(["node"]), "once")
    once = once.drop(key)

    tested: list[DataFrame] = []

    def similar(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar, of those that weren't tested before."""
        pairs = pairs.distinct()
        for before in tested:
            pairs = pairs.join(told(before), ["a", "b"], "left_anti")
        tested.append(pairs := written(pairs, "pairs"))
        ends = told(written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends"))

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, words).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["node", "hashes"])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                near = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity - 1e-9 for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
                yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

        whole = written(rows.select("node", "text").join(ends, "node", "left_semi").dropDuplicates(["node"]).mapInArrow(tidied(sets), "node long, hashes binary"), "sets")
        both = pairs.join(whole.select(F.col("node").alias("a"), F.col("hashes").alias("s")), "a").join(whole.select(F.col("node").alias("b"), F.col("hashes").alias("t")), "b").select("a", "b", "s", "t")
        near = written(both.mapInArrow(tidied(compare), "a long, b long"), "similar")
        relieve(spark)
        return near

    # texts of one SimHash with the least of them, and the least ones of SimHashes that the tables link
    classes = written(once.groupBy("fp").agg(F.min("node").alias("rep")), "classes")
    linked = links(classes.select(F.col("fp").alias("node"), "fp"), radius)
    for end in ("a", "b"):
        linked = linked.join(classes.select(F.col("fp").alias(end), F.col("rep").alias(f"{end}_")), end)
    near = linked.select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b"))
    equal = once.select("fp", "node").join(classes, "fp").where("node != rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    found = similar(near.union(equal))

    def rooted(of: DataFrame, roots: DataFrame) -> DataFrame:
        return of.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    roots = written(components(found), "roots")
    def several(of: DataFrame) -> DataFrame:
        """Tokens that stand with two roots or more."""
        return written(of.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("token"), "several")

    # most hashes stand in one text: a sieve of those that stand in more leaves few rows to be moved
    sieve = spark.sparkContext.broadcast(_several_cells(once.select("first")).view(np.int64))

    def sieved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            token = lists.flatten().to_numpy()
            at = token & np.int64(SIEVE_BITS - 1)
            keep = np.flatnonzero(sieve.value[at >> 6] >> (at & 63) & 1)
            row = pa.array(np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())[keep])
            yield pa.RecordBatch.from_arrays([pa.array(token[keep]), b.column(0).take(row), b.column(1).take(row)], names=["token", "node", "n"])

    met = written(once.select("node", "n", "first").mapInArrow(tidied(sieved), "token long, node long, n int"), "sieved")
    met = written(met.join(told(several(rooted(met, roots))), "token", "left_semi"), "buckets")
    # of buckets with the same members one is enough
    held = met.groupBy("token").agg(F.count(F.lit(1)).alias("members"), F.bit_xor("node").alias("x"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("y"))
    held = written(held.groupBy("members", "x", "y").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("members") / MEMBERS).cast("int").alias("blocks")), "tokens")
    met = written(met.join(held, "token"), "members")
    maps = written(once.select("node", "map").join(met.select("node").distinct(), "node", "left_semi"), "maps")

    def pairs_of(members: DataFrame, best: bool) -> DataFrame:
        block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        dealt = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("token", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "n", "root", "map")
        return dealt.repartition(n, "token", "lo", "hi").sortWithinPartitions("token", "lo", "hi").mapInArrow(tidied(_compare(similarity, best)), "a long, b long")

    for best in (True, False):
        members = rooted(met, roots)
        if not best:  # only buckets that still have several roots
            members = members.join(told(several(members)), "token", "left_semi")
        more = similar(pairs_of(members.join(maps, "node"), best))
        if not more.isEmpty():
            found = found.union(more)
            roots = written(components(found), "roots")
    named = rooted(nodes.select("node", "least"), roots)
    names = written(named.groupBy("root").agg(F.min("least").alias("group_id")), "names")
    groups = named.join(names, "root").select("node", "root", "group_id")
    return signed.groupBy(key, "node").agg(F.count(F.lit(1)).alias("copies")).join(groups, "node").select(key, "node", "root", "group_id", "copies")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id") -> DataFrame:
    """docs with one row of each group of near duplicates; columns stay as they are.

    Groups are told apart by their texts, not by keys: rows of one key, or without one, whose texts aren't similar all stay. Of a
    group the row with the smallest key stays (null last; of several texts with that key the one with the least hash), of
    rows equal in key and text one. Equal hashes of 64 bits are taken for equal texts.
    """
    few_decoded(docs.sparkSession)
    k, n, h, kept_key, kept_node = fresh(docs, "gone_key", "gone_node", "gone_hash", "kept_key", "kept_node")
    with scratch(docs.sparkSession) as kept:
        groups = written(similar_groups(docs, words, similarity, key), "groups")
        first = F.min(F.struct(F.col(key).isNull().alias("none"), key, "node"))
        one = written(groups.groupBy("root").agg(first.alias("x")).select("root", F.col(f"x.{key}").alias(kept_key), F.col("x.node").alias(kept_node)), "kept")
        stays = F.col(key).eqNullSafe(F.col(kept_key)) & (F.col("node") == F.col(kept_node))
        gone = written(groups.join(one, "root").where(~stays).select(F.col(key).alias(k), F.col("node").alias(n)), "gone")
        repeated = not groups.where("copies > 1").isEmpty()
        kept.append(gone)
    hashed = docs.withColumn(h, F.xxhash64(F.coalesce("text", F.lit(""))))
    left = hashed.join(told(gone), F.col(key).cast("long").eqNullSafe(F.col(k)) & (F.col(h) == F.col(n)), "left_anti")
    if repeated:
        left = left.dropDuplicates([key, h])
    return left.drop(h)


def op8_covering_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    got = near_duplicates(spread(table(spark, sf_dir, "documents")))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
