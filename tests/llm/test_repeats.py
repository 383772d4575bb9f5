"""Repeats against brute force where it is hard: zero bytes, buckets of every size, and rounds that mix whole and short anchors."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import repeat_intervals

from .conftest import DOCS
from .test_operators import key, removed


@pytest.mark.parametrize("bucket", [1 << 15, 40, 3, 1])
def test_zero_bytes_are_bytes(spark, bucket):
    rng = random.Random(41)
    texts = ["".join(rng.choice("a\x00") for _ in range(rng.randint(0, 40))) for _ in range(150)]
    texts += ["b" * 5 + "\x00" * n for n in range(30)] + [None, ""]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    rows += [rows[3], (None, texts[4], None, None, None), (None, None, None, None, None)]
    want = [(r[0], *w) for r, w in zip(rows, removed([(r[1] or "").encode() for r in rows], 12), strict=True)]
    got = [tuple(r)[:5] for r in repeat_intervals.without_repeats(spark.createDataFrame(rows, DOCS).repartition(3), 12, 4, bucket).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_texts_and_their_prefixes_are_told_apart():
    """Right contexts that differ only in how many zero bytes end them: each pair shares what the shorter one has."""
    texts = [b"XY\x00", b"XY", b"XY\x00", b"XY\x00\x00", b"XYb"]
    at, k = np.zeros(5, np.int64), np.full(5, 2)
    found = {tuple(sorted(int(m) for m in members)): right for members, _, right in repeat_intervals.bucket_repeats(texts, at, k, np.zeros(5, np.int64), 3)}
    assert found == {(0, 2, 3): 1}


@pytest.mark.parametrize("size", [1, 2, 3, 1000])
def test_whole_anchors_leave_other_buckets_alone(size):
    """Buckets 1, 2 and 3, the second with anchors of the whole window: what comes out doesn't depend on how rows are batched."""
    rows = [(1, 1, 10, b"--abcdefgh", 2, 4), (1, 1, 11, b"**abcdefgh", 2, 4), (2, 2, 20, b"abcdefgh", 0, 8), (2, 2, 21, b"abcdefgh", 0, 8), (2, 2, 22, b"abcdefgh", 0, 8), (3, 3, 30, b"zwwwwwwww", 1, 4), (3, 3, 31, b"ywwwwwwww", 1, 4), (4, 4, 40, b"abcdefgh", 0, 8)]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size], strict=True), kinds, strict=True)], names=["g", "a", "u", "text", "at", "k"]) for i in range(0, len(rows), size)]
    run, _ = repeat_intervals._extents(8, 100)
    got = {(r["a"], r["u"]): (r["lo"], r["hi"]) for b in run(iter(batches)) for r in b.to_pylist()}
    assert got == {(1, 10): (2, 10), (1, 11): (2, 10), (2, 20): (0, 8), (2, 21): (0, 8), (2, 22): (0, 8), (3, 30): (1, 9), (3, 31): (1, 9)}
