"""The toxicity query against plain loops: which rows are fitted on, the network's forward pass, thresholds, and scores."""

import math
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from quern.llm import toxicity_cnn as cnn

from .test_operators import toxic_rows


def held_back(doc_id):
    h = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), xxhash.xxh64_intdigest(b"threshold", 42))
    return h % 4 == 0 if h < 1 << 63 else (h - (1 << 64)) % 4 == 0


def forward(model, text):
    """The raw score of one text, position by position and filter by filter."""
    words = cnn.words_of(text)
    rows = [(model.word_rows.get(cnn._bucket(w), 0), model.prefix_rows.get(cnn._bucket("^" + w[: cnn.PREFIX]), 0)) for w in words] + [(0, 0)] * (max(cnn.WIDTHS) - 1)
    vectors = [[float(a + b) for a, b in zip(model.words[i], model.prefixes[j], strict=True)] for i, j in rows]
    z, n = model.base, 0
    for width, filters in zip(cnn.WIDTHS, model.filters, strict=True):
        for f in range(cnn.FILTERS):
            best = -math.inf
            for at in range(len(vectors)):
                s = sum(vectors[at + j][d] * float(filters[j, d, f]) for j in range(width) if at + j < len(vectors) for d in range(cnn.DIM))
                best = max(best, s + float(model.bias[n]))
            z += max(best, 0.0) * float(model.out[n])
            n += 1
    return min(max(z, -60.0), 60.0)


def plain_threshold(rows):
    """(cut, rows of the rarer class) of (step, label): every cut between steps is tried."""
    ones = sum(y for _, y in rows)
    if not 0 < ones < len(rows):
        return (-61.0 if ones else 61.0), 0
    steps, best = sorted({k for k, _ in rows}, reverse=True), None
    for n, k in enumerate(steps):
        called = [y for s, y in rows if s >= k]
        f1 = 2 * sum(called) / (len(called) + ones)
        if best is None or f1 > best[0]:
            best = f1, (k + (steps[n + 1] if n + 1 < len(steps) else k - 64)) / 2 / 64 + 0.5 / 64
    return best[1], min(ones, len(rows) - ones)


def plain_scores(docs, labels):
    """Scores of docs (doc_id, text) by labels {doc_id: 0, 1 or None}, of which all fit into the sample."""
    usable = {d: y for d, y in labels.items() if d is not None and y is not None and zlib.crc32(str(d).encode()) % 3 != 1}
    fit = sorted({d: t for d, t in sorted(((d, t or "") for d, t in docs if d in usable and not held_back(d)))}.items(), key=lambda r: zlib.crc32(str(r[0]).encode()))
    model = cnn.train([t for _, t in fit], [usable[d] for d, _ in fit])
    raw = [(d, *(x[0] for x in model.raw_scores([t], {}))) for d, t in docs]
    told = [(spoken, math.floor(z * 64), usable[d]) for d, z, spoken in raw if d in usable and held_back(d)]
    general = plain_threshold([r[1:] for r in told])[0]
    limits = {}
    for name in cnn.FUNCTION_WORDS:
        own, n = plain_threshold([r[1:] for r in told if r[0] == name])
        limits[name] = (n * own + 20 * general) / (n + 20)
    return [1 / (1 + math.exp(-min(max(z - limits.get(spoken, general) + math.log(0.7 / 0.3) + 1e-9, -60), 60))) for _, z, spoken in raw]


def test_forward_pass_by_loops():
    rows = toxic_rows(300)
    model = cnn.train([r[1] for r in rows], [r[2] for r in rows])
    texts = [r[1] for r in rows[:25]] + [None, "", "one", "two words", "12 !?"]
    got, _ = model.raw_scores(texts, {})
    assert got == pytest.approx([forward(model, t) for t in texts], abs=1e-4)


def test_query_by_loops(spark, tmp_path):
    rng = random.Random(91)
    rows = toxic_rows(700)
    docs = [(k, (rng.choice(["the of and ", "der die und ", "el los que ", "les des et ", ""]) * 3 + t)) for k, t, _ in rows] + [(5000, None), (5001, ""), (None, "no id grolt"), (3, rows[3][1])]
    labels = {k: y for k, _, y in rows} | {9999: 1, 5001: None}
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, y) for k, y in labels.items()] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = defaultdict(list)
    for r in cnn.op4_toxicity_cnn(spark, str(tmp_path)).collect():
        got[r["doc_id"]].append((r["score"], r["held_out"], r["predicted"]))
    want = defaultdict(list)
    for (d, _), score in zip(docs, plain_scores(docs, labels), strict=True):
        want[d].append((pytest.approx(score, abs=1e-6), d is not None and zlib.crc32(str(d).encode()) % 3 == 1, int(score >= 0.7)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v, key=lambda x: x[0].expected) for k, v in want.items()}
    right = [(p == labels[d]) for d, v in got.items() if labels.get(d) is not None for _, out, p in v if out]
    assert np.mean(right) > 0.95


def test_all_labels_beyond_the_sample_set_thresholds(spark):
    """Rows that the fitting sample leaves out are counted: the thresholds of a small sample use all of them."""
    rows = toxic_rows(400)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    fit, rest = cnn._labelled_ids(labels, ~cnn.held_out(), "toxic", 50)
    usable = {k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 3 != 1}
    a, b = ({r["doc_id"] for r in x.collect()} for x in (fit, rest))
    assert len(a) == 50 and not a & b and a | b == usable
    general, limits = cnn.thresholds(spark.createDataFrame([("en", 2.0, 1), ("en", 1.0, 0), ("de", 0.5, 0), ("", 3.0, 1)], "spoken string, z double, y int"))
    assert general == pytest.approx(1.5, abs=0.02) and set(limits) == set(cnn.FUNCTION_WORDS)


def test_the_driver_neither_gathers_texts_nor_trains(spark, monkeypatch):
    """Training runs in a task: the driver, whose memory is the smallest, gets the model only."""
    rows, here, train = toxic_rows(300), [], cnn.train
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    want = plain_scores([r[:2] for r in rows], {k: y for k, _, y in rows})
    monkeypatch.setattr(cnn, "train", lambda *a: here.append(len(a[0])) or train(*a))
    got = {r["doc_id"]: r["score"] for r in cnn.toxicity_scores(docs, labels, keep=["doc_id"]).collect()}
    assert not here
    assert got == {k: pytest.approx(s, abs=1e-6) for (k, _, _), s in zip(rows, want, strict=True)}
    none = cnn.toxicity_scores(docs, labels.limit(0), keep=["doc_id"]).collect()
    assert len(none) == len(rows) and all(r["score"] < cnn.PASS for r in none)
