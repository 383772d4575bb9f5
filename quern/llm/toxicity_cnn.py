"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of two hashed rows, one for the word and one for its first letters. Filters of several
widths slide over the whole text, the maximum of each over all positions is kept, and a logistic layer reads the
maxima. Hash buckets that too few training texts hold share a row of zeros. Embeddings start with each bucket's log-odds
between the classes in one component; training moves all of them. On all labelled rows that the weights didn't see, at
least a quarter, a threshold is chosen for each language, from counts of their raw scores that Spark adds up; the language
is guessed from the text's own function words. A score is the logistic of the distance to that threshold, shifted so
that the threshold scores 0.7.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from quern.llm.common import fresh, relieve, spread, table, tidied, told, written

#: Labelled rows that training takes at most, chosen by the hash of doc_id.
TRAIN_ROWS = 8_000
#: Size of embeddings, filters of each width, widths, training texts that a bucket needs, letters of a prefix.
DIM, FILTERS, WIDTHS, SEEN, PREFIX = 8, 8, (1, 2, 3), 5, 4
#: Words at a time, so that a text of any length takes bounded memory; words that a task remembers.
PIECE, WORDS_KEPT = 1 << 16, 200_000
PASS = 0.7
#: One of so many labelled rows only sets thresholds; raw scores are counted in so many steps a unit; a language's threshold counts as its rows of the rarer class to this many of all languages'.
HELD_BACK, STEPS, PRIOR = 4, 64, 20
#: Frequent function words by language, to guess a text's language.
FUNCTION_WORDS = {
    "de": "der die das und ist von ein eine mit auf nicht für sich des",
    "en": "the of and to in is that it was for on are with as",
    "es": "el los las que de se por con una para es del no como",
    "fr": "le les des et est une du dans que qui pour pas sur au",
}
_WORD = re.compile(r"[^\W\d_]+")


def _bucket(what: str) -> int:
    raw = what.encode()
    return zlib.crc32(raw) << 16 ^ zlib.adler32(raw)


def words_of(text: str | None) -> list[str]:
    """A text's words: runs of letters, lower-cased."""
    return _WORD.findall((text or "").lower())


@dataclass
class Model:
    """Rows of the word and prefix buckets (row 0: zeros), filters and output layer."""

    word_rows: dict[int, int] = field(default_factory=dict)
    prefix_rows: dict[int, int] = field(default_factory=dict)
    words: np.ndarray = field(default_factory=lambda: np.zeros((1, DIM), np.float32))
    prefixes: np.ndarray = field(default_factory=lambda: np.zeros((1, DIM), np.float32))
    filters: list[np.ndarray] = field(default_factory=lambda: [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS])
    bias: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS * len(WIDTHS), np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS * len(WIDTHS), np.float32))
    base: float = -4.0

    def ids(self, words: list[str], known: dict[str, tuple[int, int]]) -> np.ndarray:
        """Rows of each word and its prefix; `known` remembers them from text to text."""
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in words if len(words) < 50 else set(words):
            if w not in known:
                known[w] = self.word_rows.get(_bucket(w), 0), self.prefix_rows.get(_bucket("^" + w[:PREFIX]), 0)
        return np.array([known[w] for w in words], dtype=np.int32).reshape(-1, 2)

    def responses(self, ids: np.ndarray) -> np.ndarray:
        """Each filter at each position; positions past the end read zeros."""
        x = self.words[ids[:, 0]] + self.prefixes[ids[:, 1]]
        out = np.empty((len(x), len(self.out)), np.float32)
        for n, (w, c) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            part = out[:, n * FILTERS : (n + 1) * FILTERS]
            part[:] = x @ c[0]
            for k in range(1, w):
                part[:-k] += x[k:] @ c[k]
        return out + self.bias

    def pooled(self, docs: list[np.ndarray]) -> np.ndarray:
        """The maxima of the filters over each text; pieces of long texts overlap by the widest filter."""
        gap, out = max(WIDTHS) - 1, np.full((len(docs), len(self.out)), -np.inf, np.float32)
        queue, owners, tails, held = [], [], [], 0

        def flush() -> None:
            nonlocal held
            if queue:
                starts = np.concatenate(([0], np.cumsum([len(q) for q in queue])[:-1]))
                got = self.responses(np.concatenate(queue))
                for end in tails:
                    got[end - gap : end] = -np.inf  # they reach into what follows; the next piece of the text, if any, has these positions
                best = np.maximum.reduceat(got, starts, axis=0)
                np.maximum.at(out, owners, best)
            queue.clear(), owners.clear(), tails.clear()
            held = 0

        pad = np.zeros((2 * gap, 2), np.int32)
        for d, ids in enumerate(docs):
            whole, n = np.concatenate((ids, pad)), len(ids) + gap
            for k in range(0, n, PIECE):
                queue.append(whole[k : min(k + PIECE, n) + gap])
                owners.append(d)
                held += len(queue[-1])
                tails.append(held)
                if held > PIECE:
                    flush()
        flush()
        return out

    def raw(self, docs: list[np.ndarray]) -> np.ndarray:
        return np.maximum(self.pooled(docs), 0).astype(np.float64) @ self.out.astype(np.float64) + self.base if docs else np.zeros(0)

    def raw_scores(self, texts: list[str | None], known: dict[str, tuple[int, int]]) -> tuple[np.ndarray, list[str]]:
        """What the output layer says of each text, from -60 to 60, and its guessed language."""
        parts = [words_of(t) for t in texts]
        return np.clip(self.raw([self.ids(p, known) for p in parts]), -60, 60), [language(p) for p in parts]


_LANGUAGE_OF: dict[str, list[str]] = {}
for _name, _list in FUNCTION_WORDS.items():
    for _w in _list.split():
        _LANGUAGE_OF.setdefault(_w, []).append(_name)


def language(words: list[str]) -> str:
    """The language whose function words are most frequent in a text; ties to the first by name, none: empty."""
    counts = dict.fromkeys(FUNCTION_WORDS, 0)
    for w in words:
        for name in _LANGUAGE_OF.get(w, ()):
            counts[name] += 1
    best = max(counts, key=counts.get)
    return best if counts[best] else ""


def _rows(buckets: list[np.ndarray], y: np.ndarray) -> tuple[dict[int, int], np.ndarray]:
    """Rows for the buckets seen in enough texts, and each one's log-odds between the classes. buckets: each text's, without repeats."""
    flat, owner = np.concatenate(buckets), np.repeat(y, [len(b) for b in buckets])
    names, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
    ones = np.bincount(at, weights=owner, minlength=len(names))
    kept = np.flatnonzero(counts >= SEEN)
    a, n, n1, n0 = ones[kept], counts[kept], y.sum(), len(y) - y.sum()
    odds = np.log((a + 0.5) / (n1 + 1)) - np.log((n - a + 0.5) / (n0 + 1))
    return {b: k + 1 for k, b in enumerate(names[kept].tolist())}, np.concatenate(([0.0], odds))


def best_cut(steps: list[int], ones: list[int], rows: list[int]) -> float:
    """The raw score, halfway between counted steps, above which calling rows toxic has the best F1; the highest of equals."""
    at = np.argsort(steps)[::-1]
    z, hit, called = np.array(steps)[at], np.cumsum(np.array(ones)[at]), np.cumsum(np.array(rows)[at])
    k = int(np.argmax(2 * hit / (called + hit[-1])))
    return float(z[k] + (z[k + 1] if k + 1 < len(z) else z[k] - STEPS)) / 2 / STEPS + 0.5 / STEPS


def train(texts: list[str | None], labels: list[int], epochs: int = 4, batch: int = 64, rate: float = 0.05, seed: int = 7) -> Model:
    """A model of texts and 0/1 labels, alike for the same rows in the same order. With one class or no rows all texts are alike."""
    y = np.array(labels, dtype=np.int64)
    model, rng = Model(), np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        return model
    # words are read from a text when they are needed: lists of all texts' words would fill the memory
    word_buckets, prefix_buckets = [], []
    for t in texts:
        own = set(words_of(t))
        word_buckets.append(np.unique(np.array([_bucket(w) for w in own], np.int64)))
        prefix_buckets.append(np.unique(np.array([_bucket("^" + p) for p in {w[:PREFIX] for w in own}], np.int64)))
    model.word_rows, word_odds = _rows(word_buckets, y)
    model.prefix_rows, prefix_odds = _rows(prefix_buckets, y)
    del word_buckets, prefix_buckets
    for name, odds in (("words", word_odds), ("prefixes", prefix_odds)):
        rows = rng.normal(0, 0.02, (len(odds), DIM)).astype(np.float32)
        rows[:, 0] += np.clip(odds, -4, 8) / 4
        rows[0] = 0
        setattr(model, name, rows)
    model.filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for c in model.filters:
        c[0, 0, :] += 0.5
    model.out[:] = 4.0 / len(model.out)
    known: dict[str, tuple[int, int]] = {}
    ids = []
    for t in texts:
        if len(known) > 50_000:
            known.clear()
        ids.append(model.ids(words_of(t), known))
    known.clear()
    gap = max(WIDTHS) - 1
    pad = np.zeros((2 * gap, 2), np.int32)
    heavy = np.where(y == 1, min(8.0, (len(y) - y.sum()) / y.sum()), 1.0)
    weights = [model.words, model.prefixes, *model.filters, model.bias, model.out]
    seen = [np.full_like(w, 1e-3) for w in weights]
    base_seen = 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            pick = order[k : k + batch]
            docs = [np.concatenate((ids[i], pad)) for i in pick]
            ends = np.cumsum([len(d) for d in docs])
            flat = np.concatenate(docs)
            r = model.responses(flat)
            at = np.stack([r[e - len(d) : e - gap].argmax(axis=0) + e - len(d) for d, e in zip(docs, ends, strict=True)])
            top = np.take_along_axis(r, at.reshape(-1, r.shape[1]), axis=0)
            act = np.maximum(top, 0)
            z = act @ model.out + model.base
            g = ((1 / (1 + np.exp(-z)) - y[pick]) * heavy[pick] / len(pick)).astype(np.float32)
            grads = [np.zeros_like(w) for w in weights]
            grads[-1] = act.T @ g
            back = g[:, None] * model.out * (top > 0)
            grads[-2] = back.sum(axis=0)
            x = model.words[flat[:, 0]] + model.prefixes[flat[:, 1]]
            for n, w in enumerate(WIDTHS):
                cols = slice(n * FILTERS, (n + 1) * FILTERS)
                for j in range(w):
                    pos = np.minimum(at[:, cols] + j, len(flat) - 1)
                    inside = at[:, cols] + j < ends[:, None]
                    b = back[:, cols] * inside
                    grads[2 + n][j] = np.einsum("nf,nfd->df", b, x[pos])
                    step = (b[..., None] * model.filters[n][j].T[None]).reshape(-1, DIM)
                    np.add.at(grads[0], flat[pos, 0].ravel(), step)
                    np.add.at(grads[1], flat[pos, 1].ravel(), step)
            grads[0][0] = 0
            grads[1][0] = 0
            for w, s, d in zip(weights, seen, grads, strict=True):
                s += d * d
                w -= rate * d / np.sqrt(s)
            base_seen += float(g.sum()) ** 2
            model.base -= rate * float(g.sum()) / base_seen**0.5
    return model


def _labelled_ids(labels: DataFrame, usable: Column, target: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """doc_id and y of labelled rows for which usable holds: at most `rows` to fit on, and all others, which set thresholds.

    Null labels are left out, and of a repeated id the greatest label counts.
    """
    drawn = F.xxhash64(F.lit("train"), "doc_id")
    ids = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max(target).cast("int").alias("y")).withColumn("drawn", drawn)
    back = F.pmod(F.xxhash64(F.lit("threshold"), "doc_id"), F.lit(HELD_BACK)) == 0
    fit = written(ids.where(~back).orderBy("drawn", "doc_id").limit(rows), "fit")
    n, last = fit.agg(F.count(F.lit(1)), F.max("drawn")).first()
    rest = ids.where(back | (F.col("drawn") > F.lit(last))) if n == rows else ids.where(back)
    return fit.select("doc_id", "y"), rest.select("doc_id", "y")


def trained(docs: DataFrame, fit: DataFrame) -> Model:
    """A model of the rows to fit on, in the order of their ids' sums; of a repeated id the greatest text counts.

    One task trains it, and only the model comes to the driver: texts and gradients would take memory there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
        model = train([t for _, t, _ in rows], [y for _, _, y in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # at most as many rows of two numbers as may be fitted on: a bounded broadcast, and a bounded task
    rows = docs.select("doc_id", "text").join(F.broadcast(fit), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y"))
    got = rows.repartition(1).mapInArrow(tidied(run), "model binary").collect()
    return pickle.loads(bytes(got[0]["model"])) if got else Model()


def raw_scored(docs: DataFrame, model: Model, raw: str, spoken: str) -> DataFrame:
    """docs with every whole text's raw score and guessed language; null and empty texts are texts without words. All rows are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by TRAIN_ROWS
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int]] = {}
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                z, languages = shared.value.raw_scores(b.column(at).to_pylist(), known)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(z, pa.float64()), pa.array(languages, pa.string())], names=[*b.schema.names, raw, spoken])

    return docs.mapInArrow(tidied(run), StructType([*docs.schema.fields]).add(raw, DoubleType()).add(spoken, StringType()))


def thresholds(scored: DataFrame) -> tuple[float, dict[str, float]]:
    """The raw score that is toxic in general, and by guessed language, from all rows of scored (spoken, z, y).

    A language's own best cut counts by its rows of the rarer class, the general one as PRIOR of them, so languages with few
    rows lean on all. Without rows of both classes nothing is toxic, or all is. What comes to the driver are counts by
    language and step of the score.
    """
    step = F.floor(F.col("z") * STEPS).cast("int")
    found = scored.groupBy("spoken", step.alias("step")).agg(F.sum("y").alias("ones"), F.count(F.lit(1)).alias("rows")).collect()

    def of(rows: list) -> tuple[float, int]:
        ones, n = sum(r["ones"] for r in rows), sum(r["rows"] for r in rows)
        if not 0 < ones < n:
            return (-61.0 if ones else 61.0), 0
        by: dict[int, list[int]] = {}
        for r in rows:
            c = by.setdefault(r["step"], [0, 0])
            c[0] += r["ones"]
            c[1] += r["rows"]
        return best_cut(list(by), [c[0] for c in by.values()], [c[1] for c in by.values()]), min(ones, n - ones)

    general, limits = of(found)[0], {}
    for name in FUNCTION_WORDS:
        own, n = of([r for r in found if r["spoken"] == name])
        limits[name] = (n * own + PRIOR * general) / (n + PRIOR)
    return general, limits


def held_out() -> Column:
    """Rows that training never reads."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs, or of them the columns `keep`, with `score`, by a model of the labelled rows that aren't held out.

    The score is from 0 to 1, and at least 0.7 where a text reaches the threshold of its guessed language. All rows are kept;
    null and empty texts are scored as texts without words; an empty table stays empty. Without labels of both classes no
    text passes, or, if all are toxic, every text. If docs have a column named like the score, the new one, which is the
    last, gets an underscore more. Labelled texts are scored twice: for the thresholds, and with all others.
    """
    keep = docs.columns if keep is None else keep
    out, raw, spoken, y, of = fresh(docs, score, "raw", "spoken", "y", "labelled_id")
    fit, rest = _labelled_ids(labels, ~held_out(), "toxic", rows)
    model = trained(docs, fit)
    relieve(docs.sparkSession)
    labelled = told(written(rest, "labelled").select(F.col("doc_id").alias(of), F.col("y").alias(y)))
    some = docs.select("doc_id", "text").join(labelled, F.col("doc_id") == F.col(of)).select("text", y)
    general, limits = thresholds(raw_scored(some, model, raw, spoken).select(F.col(spoken).alias("spoken"), F.col(raw).alias("z"), F.col(y).alias("y")))
    scored = raw_scored(docs, model, raw, spoken)
    at = F.lit(general)
    for name, limit in sorted(limits.items()):
        at = F.when(F.col(spoken) == name, F.lit(limit)).otherwise(at)
    z = F.greatest(F.least(F.col(raw) - at + float(np.log(PASS / (1 - PASS))) + 1e-9, F.lit(60.0)), F.lit(-60.0))
    return scored.select(*keep, (1 / (1 + F.exp(-z))).alias(out))


def op4_toxicity_cnn(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    got = toxicity_scores(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PASS).cast("int").alias("predicted"))
