"""Places for models, with deterministic defaults that need none: embedding, summary, answer, tokens, relevance.

A port is a function of Columns that returns a Column, so a model is put in as a pandas UDF of the same shape.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import words
from quern.operators.chunks import sentences

DIM = 64


def hashed_embedding(text: Column, dim: int = DIM) -> Column:
    """Signed feature hashing of a text's words, scaled to norm 1; a text without words is zero.

    Words are hashed by Spark, and the signs of a batch are summed at once, so the cost grows with the words and not with
    the words times `dim`.
    """
    spots = F.transform(words(text), lambda w: (2 * F.pmod(F.xxhash64(w), F.lit(dim)) + F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2))).cast("int"))

    @F.arrow_udf("array<double>")
    def summed(lists: pa.Array) -> pa.Array:
        flat, n = np.asarray(lists.flatten(), np.int64), len(lists)
        row = np.repeat(np.arange(n), np.asarray(lists.value_lengths().fill_null(0)))
        v = np.bincount(row * dim + flat // 2, weights=1.0 - 2 * (flat % 2), minlength=n * dim).reshape(n, dim)  # sums of ones: exact
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array((v / np.where(norm > 0, norm, 1.0)).ravel() + 0.0))

    return summed(spots)


def leading_summary(text: Column, most: int = 60) -> Column:
    """The first `most` words; a text without words is itself."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.when(F.size(w) == 0, text).otherwise(F.array_join(F.slice(w, 1, most), " "))


def best_sentence(question: Column, context: Column) -> Column:
    """The context's sentence that shares most words with the question, the first of equals; empty without one."""
    asked = words(question)
    scored = F.transform(sentences(context), lambda s, i: F.struct((-F.size(F.array_intersect(words(s), asked))).alias("n"), i.alias("i"), s.alias("s")))
    return F.coalesce(F.array_min(scored)["s"], F.lit(""))


def shared_words(question: Column, text: Column) -> Column:
    """The share of a question's different words that a text has."""
    q = F.array_distinct(words(question))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, words(text))).cast("double"), F.size(q)), F.lit(0.0))


@dataclass
class Ports:
    """The models a plan uses."""

    embed: Callable[[Column], Column] = hashed_embedding
    summarise: Callable[[Column], Column] = leading_summary
    answer: Callable[[Column, Column], Column] = best_sentence
    relevance: Callable[[Column, Column], Column] = shared_words
    tokens: Callable[[Column], Column] = lambda t: F.size(words(t))
