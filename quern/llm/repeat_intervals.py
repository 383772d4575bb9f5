"""Removal of repeated byte strings, by the interval tree of an enhanced suffix array.

No suffix array of all texts is built. Winnowing picks from each window of `length` bytes one anchor, the same wherever
the window's bytes stand, so windows that are equal have equal anchors at equal places. Only anchors that occur twice
matter. Neighbouring windows with the same anchor form a run, and equal runs are counted, not gathered: a run that
occurs twice is repeated as a whole. Different runs with the same anchor meet as one bucket of a sparse suffix array:
they are sorted by what follows the anchor, a stack scan of the common prefixes gives the intervals of the tree, and
within an interval the members are told apart by what stands before the anchor. Members that agree to the left and to
the right by enough bytes are occurrences of a maximal repeat, and each of them is reported, not just neighbours.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import shared_dir, spread, table, tidied, written
from quern.llm.winnow import Winnower

LENGTH, ANCHOR = 200, 64
#: Members of a bucket that one task holds; a larger bucket is dealt again by longer anchors.
BUCKET = 1 << 15
#: Members that are sorted together, of one or many buckets.
SORTED = 1 << 15
#: Bytes of texts that are encoded at a time.
HELD = 1 << 22


def lcp_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first, last, depth) of each interval of the tree over sorted strings, children before parents.

    lcp[i] is the common prefix of strings i and i + 1; a negative entry ends a bucket, and no interval spans it.
    """
    stack: list[tuple[int, int]] = []  # (depth, first)
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            yield first, i, top
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def _common(x: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes rows a and b of x have in common; n: the rows' lengths."""
    if not x.shape[1]:
        return np.zeros(len(a), np.int64)
    differ = x[a] != x[b]
    return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1]), np.minimum(n[a], n[b]))


def _sorted(x: np.ndarray, n: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of the rows of x by group, bytes and length n; the length tells zero bytes of a text from those that fill its row."""
    head, tail = (c.astype(">u4").view(np.uint8).reshape(-1, 4) for c in (group, n))
    both = np.ascontiguousarray(np.concatenate((head, x, tail), axis=1))
    return np.argsort(both.view(f"S{both.shape[1]}").ravel(), kind="stable")


def bucket_repeats(texts: list[bytes], at: np.ndarray, k: np.ndarray, group: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Repeat groups in buckets: (members, bytes each shares to the left of its anchor, bytes to the right).

    Member i's anchor is texts[i][at[i]:at[i] + k[i]], equal in its group. A group comes out for each interval of the
    tree and each set of members in it whose left neighbours agree so far that the repeat has `length` bytes; a
    member's left extent is the longest that it shares with another of the set.
    """
    sizes = np.array([len(t) for t in texts])
    ln, rn = at, sizes - at - k
    left, right = (np.zeros((len(texts), int(n.max(initial=0))), np.uint8) for n in (ln, rn))
    for i, t in enumerate(texts):
        raw = np.frombuffer(t, np.uint8)
        left[i, : ln[i]] = raw[: at[i]][::-1]
        right[i, : rn[i]] = raw[at[i] + k[i] :]
    order = _sorted(right, rn, group)
    lcp = _common(right, rn, order[:-1], order[1:])
    lcp[group[order[:-1]] != group[order[1:]]] = -1
    rank = np.empty(len(texts), np.int64)
    rank[_sorted(left, ln, group)] = np.arange(len(texts))
    pairs: list[tuple[int, int, int]] = []
    for first, last, depth in lcp_intervals(lcp.tolist()):
        if last - first == 1:
            pairs.append((order[first], order[last], depth))
            continue
        members = order[first : last + 1]
        members = members[np.argsort(rank[members])]
        shared = _common(left, ln, members[:-1], members[1:])
        need = length - depth - int(k[members[0]])
        near = shared >= need
        if not near.any():
            continue
        extent = np.maximum(np.concatenate((np.where(near, shared, -1), [-1])), np.concatenate(([-1], np.where(near, shared, -1))))
        for part in np.split(np.arange(len(members)), np.flatnonzero(~near) + 1):
            if len(part) > 1:
                yield members[part], extent[part], depth
    if pairs:
        a, b, depth = (np.array(c) for c in zip(*pairs, strict=True))
        shared = _common(left, ln, a, b)
        for x, y, l_, r in zip(a, b, shared, depth, strict=True):
            if l_ + r + k[x] >= length:
                yield np.array([x, y]), np.array([l_, l_]), int(r)


def _extents(length: int, bucket: int, pieces: int = 4):
    """For mapInArrow over runs sorted by bucket g: what is repeated of each run, and runs of buckets that are too large."""
    columns = ("deferred", "g", "a", "u", "text", "at", "k", "lo", "hi")
    kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    schema = pa.schema(list(zip(columns, kinds, strict=True)))

    def send(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        g, a, u, texts, at, k = (list(c) for c in zip(*rows, strict=True))
        names, group = np.unique(np.array(g), return_inverse=True)
        at, k = np.array(at), np.array(k)
        lo, hi = np.full(len(rows), 1 << 30), np.full(len(rows), -1)
        for members, left, right in bucket_repeats(texts, at, k, group, length):
            np.minimum.at(lo, members, at[members] - left)
            np.maximum.at(hi, members, at[members] + k[members] + right)
        found = np.flatnonzero(hi >= 0)
        if len(found):
            yield send([(False, g[i], a[i], u[i], None, 0, 0, int(lo[i]), int(hi[i])) for i in found.tolist()])

    def dealt(row: tuple) -> Iterator[tuple]:
        """A run of a large bucket, by longer anchors: one for each range of window starts."""
        from xxhash import xxh64_intdigest

        g, a, u, text, at, k = row
        slack = length - k
        step = -(-(slack + 1) // pieces)
        for o in range(0, slack + 1, step):
            o2 = min(slack, o + step - 1)
            start, size = at - o, length - (o2 - o)
            if start >= 0 and start + size <= len(text):
                key = xxh64_intdigest(text[start : start + size], seed=(o << 16 | size) ^ (g & 0xFFFFFFFF))
                yield True, key - (1 << 64) if key >> 63 else key, a, u, text, start, size, 0, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole buckets, and the one that is being read
        start, over, seen = 0, False, set()  # where that one starts in held; whether it is passed on; its runs
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not held or row[0] != held[-1][0]:
                    if over:
                        held, over = [], False
                    if len(held) >= SORTED:
                        yield from solve(held)
                        held = []
                    start, seen = len(held), set()
                if row[5] == length:  # the anchor is the whole window: all members are repeated, whatever their number
                    if len(held) > start:
                        out += [(False, *r[:3], None, 0, 0, r[4], r[4] + r[5]) for r in ((row,) if over else (held[start], row))]
                        if not over:  # the buckets before are whole
                            yield from solve(held[:start])
                            held, start, over = held[start:], 0, True
                    else:
                        held.append(row)
                    continue
                if row[1:3] in seen:
                    continue
                seen.add(row[1:3])
                held.append(row)
                if over:
                    out += dealt(held.pop())
                elif len(held) - start > bucket:
                    for r in held[start:]:
                        out += dealt(r)
                    yield from solve(held[:start])
                    held, start, over, seen = held[-1:], 0, True, set()
            for n in range(0, len(out), 4096):
                yield send(out[n : n + 4096])
        if not over:
            yield from solve(held)

    return run, ", ".join(f"{c} {t}" for c, t in zip(columns, ("boolean", "long", "long", "long", "binary", "int", "int", "int", "int"), strict=True))


def _batched(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches whose texts have few bytes together, and those texts in UTF-8."""
    for b in batches:
        start, held, texts = 0, 0, []
        for i, t in enumerate(b.column(column)):
            raw = t.as_buffer()
            raw = b"" if raw is None else raw.to_pybytes()
            if held + len(raw) > HELD and texts:
                yield b.slice(start, i - start), texts
                start, held, texts = i, 0, []
            held += len(raw)
            texts.append(raw)
        if texts:
            yield b.slice(start), texts


def _forget(spark, name: str) -> None:
    """Takes a table out of the catalog when the driver ends, as its files go too."""
    context = spark.sparkContext
    if context._jsc is not None and not context._jsc.sc().isStopped():
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(texts, spans) of docs (doc_id, text).

    texts: k1, k2, doc_id, n_bytes, sha256, text (null where nothing of it can be repeated), one row for each row of
    docs. spans: k1, k2, and a list of (from, to) byte ranges of the text that a repeated string of `length` bytes
    covers, overlapping or not. k1, k2 hash doc_id and text: equal rows share them, and each counts as an occurrence.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(text, "doc_id", F.lit(1)).alias("k2"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picks = Winnower(length, anchor)
        for b, texts in _batched(batches, 2):
            r = picks.runs(texts)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(r.anchor)), b.column(0).take(pa.array(r.text)), b.column(1).take(pa.array(r.text))], names=["a", "k1", "k2"])

    seen = rows.select("k1", "k2", "text").mapInArrow(tidied(anchors), "a long, k1 long, k2 long")
    twice = written(seen.select("a").groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a"), "anchors")
    wanted = seen.join(twice, "a", "left_semi").groupBy("k1", "k2").agg(F.collect_set("a").alias("anchors"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picks = Winnower(length, anchor)
        kind = pa.list_(pa.struct([("a", pa.int64()), ("u", pa.int64()), ("at", pa.int64()), ("first", pa.int64()), ("stop", pa.int64())]))
        for b, texts in _batched(batches, 3):
            sets = b.column(4)
            which = [i for i, s in enumerate(sets.is_valid().to_pylist()) if s]
            r = picks.runs([texts[i] for i in which])
            found: list[list[dict]] = [[] for _ in texts]
            cols = (_signed(r.anchor).tolist(), _signed(r.cover).tolist(), r.at.tolist(), r.first.tolist(), (r.last + length).tolist())
            known = {i: set(sets[i].as_py()) for i in which}
            for t, a, u, at, first, stop in zip(r.text.tolist(), *cols, strict=True):
                if a in known[which[t]]:
                    found[which[t]].append({"a": a, "u": u, "at": at, "first": first, "stop": stop})
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([t if i in known else None for i, t in enumerate(texts)], pa.binary()), pa.array([f or None for f in found], kind)],
                names=["k1", "k2", "doc_id", "n_bytes", "sha256", "text", "runs"],
            )

    met = rows.join(wanted, ["k1", "k2"], "left").select("k1", "k2", "doc_id", "text", "anchors").mapInArrow(tidied(runs), "k1 long, k2 long, doc_id long, n_bytes long, sha256 string, text binary, runs array<struct<a:long,u:long,at:long,first:long,stop:long>>")
    # written by the key, so that joins by it don't move the texts again
    name = f"quern_{uuid.uuid4().hex}"
    met.write.bucketBy(n, "k1", "k2").option("path", f"{shared_dir(spark)}/texts").saveAsTable(name)
    atexit.register(_forget, spark, name)
    texts = spark.table(name)
    occ = texts.where("runs is not null").select("k1", "k2", F.explode("runs").alias("r")).select("k1", "k2", "r.*")
    kinds = written(occ.groupBy("a", "u").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "at", "first", "stop")).alias("rep")), "runs")
    many = kinds.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("a")
    ask = kinds.join(many, "a", "left_semi").select("rep.k1", "rep.k2", F.struct("a", "u", "rep.at", "rep.first", "rep.stop").alias("r")).groupBy("k1", "k2").agg(F.collect_list("r").alias("asked"))
    cut = texts.where("text is not null").select("k1", "k2", "text").join(ask, ["k1", "k2"]).select("text", F.explode("asked").alias("r")).select(F.col("r.a").alias("g"), "r.a", "r.u", F.expr("substring(text, cast(r.first + 1 as int), cast(r.stop - r.first as int))").alias("text"), (F.col("r.at") - F.col("r.first")).cast("int").alias("at"), F.lit(anchor).alias("k"))
    found = []
    while True:
        solve, schema = _extents(length, bucket)
        got = written(cut.repartition(n, "g").sortWithinPartitions("g").mapInArrow(tidied(solve), schema), "extents")
        found.append(got.where("not deferred").select("a", "u", "lo", "hi"))
        if got.where("deferred").isEmpty():
            break
        cut = got.where("deferred").select("g", "a", "u", "text", "at", "k")
    extents = found[0]
    for x in found[1:]:
        extents = extents.union(x)
    extents = extents.groupBy("a", "u").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    size = F.col("rep.stop") - F.col("rep.first")
    # written, so that the join below is between two exchanges, of which a large partition of one common run can be split
    kept = written(kinds.join(extents, ["a", "u"], "left").where("n > 1 or hi is not null").select("a", "u", F.when(F.col("n") > 1, F.lit(0)).otherwise(F.col("lo")).alias("lo"), F.when(F.col("n") > 1, size).otherwise(F.col("hi")).alias("hi")), "kept")
    spans = occ.join(kept, ["a", "u"]).select("k1", "k2", F.struct((F.col("first") + F.col("lo")).alias("from"), (F.col("first") + F.col("hi")).alias("to")).alias("s")).groupBy("k1", "k2").agg(F.collect_list("s").alias("spans"))
    return texts.drop("runs"), spans


def without_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes (null: the text is kept whole), for every row.

    Texts are judged as UTF-8 on the input; null is empty. A text shorter than `length` keeps all its bytes. Repeated
    rows are occurrences of one another's strings. Other columns are ignored; an empty table gives an empty one.
    """
    texts, spans = repeated_spans(docs, length, anchor, bucket)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc_id, n, sha, text, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                merged: list[list[int]] = []
                for lo, hi in sorted((s["from"], s["to"]) for s in found or ()):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                kept = None
                if merged:
                    ends = [0, *(x for m in merged for x in m), len(text)]
                    kept = b"".join(text[ends[k] : ends[k + 1]] for k in range(0, len(ends), 2))
                    sha = hashlib.sha256(kept).hexdigest()
                out.append((doc_id, n, sum(h - l_ for l_, h in merged), len(merged), sha, kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    both = texts.join(spans, ["k1", "k2"], "left").select("doc_id", "n_bytes", "sha256", "text", "spans")
    return both.mapInArrow(tidied(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op5_repeat_intervals(spark, sf_dir: str) -> DataFrame:
    """What each document loses to strings of 200 bytes that start anywhere else too."""
    return without_repeats(spread(table(spark, sf_dir, "documents"))).drop("kept")
