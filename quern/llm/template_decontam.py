"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders; their values are its slots. Windows of template tokens of
the benchmark are hash-joined with those of the documents. A document holds an item if windows that lie alike cover
enough of the item and the slots agree: each value of the item stands for one value of the document and the other way
round. So a question whose numbers and names were changed throughout is found, and one whose slots contradict isn't.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import fresh, spread, table, tidied, written

#: Tokens of a window; share of an item's windows that a document must hold.
WINDOW, COVERAGE = 5, 0.8
#: Windows of the benchmark up to which documents' windows are sieved before the join; beyond it all are joined.
SIEVE = 2_000_000
#: Characters of texts that are worked on at a time, and tokens that a task remembers.
PIECE, TOKENS_KEPT = 1 << 20, 200_000
#: Units, as words or signs, which are placeholders beside a number.
UNITS = frozenset("% $ € £ ° mm cm m km mg g kg t ml l s sec second seconds min minute minutes h hour hours day days week weeks month months year years mile miles foot feet inch inches pound pounds dollar dollars euro euros cent cents percent degree degrees meter meters metre metres kilometer kilometers kilogram kilograms gram grams liter liters litre litres".split())
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[%$€£°.!?\n]")
_PLAIN, _NUMBER, _NAME, _UNIT, _STOP, _SIGN, _MEASURE = range(7)


class Tokens(dict):
    """Tokens by text: each gets a place in `hashes` and `kinds` when it is first seen."""

    def __init__(self):
        super().__init__()
        self.hashes, self.kinds = array("Q"), array("b")

    def __missing__(self, token: str) -> int:
        from xxhash import xxh64_intdigest

        lower = token.lower()
        if token in ".!?\n":
            kind = _STOP
        elif token[0].isdigit():
            kind = _NUMBER
        elif lower in UNITS:
            kind = _UNIT if lower.isalpha() else _SIGN
        else:
            kind = _NAME if len(token) > 1 and token[0].isupper() and token[1:].islower() else _PLAIN
        self[token] = len(self.hashes)
        self.hashes.append(xxh64_intdigest(lower))
        self.kinds.append(kind)
        return self[token]


def _holders() -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([0, *(xxh64_intdigest(f"<{n}>") for n in ("number", "name", "unit"))], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


class Templates:
    """The template tokens of some texts: `typed` has placeholders for numbers, names and units, `plain` leaves names as words.

    A capitalised word that begins a sentence may be a name or not: `typed` leaves it as a word, `full` makes it a name too.
    """

    def __init__(self, texts: list[str | None], tokens: Tokens):
        if len(tokens) > TOKENS_KEPT:
            tokens.clear()
            tokens.hashes, tokens.kinds = array("Q"), array("b")
        raw, sizes = [], []
        for t in texts:
            found = _TOKEN.findall(t or "")
            sizes.append(len(found) + 1)
            raw.append("\n")  # no window, unit or sentence reaches over it
            raw += found
        at = np.array(list(map(tokens.__getitem__, raw)), dtype=np.int64)
        kinds = np.frombuffer(tokens.kinds, np.int8)[at]
        begins = np.zeros(len(kinds), bool)
        begins[1:] = (kinds[1:] == _NAME) & (kinds[:-1] == _STOP)
        kinds[begins] = _PLAIN
        beside = np.zeros(len(kinds), bool)
        beside[1:] |= kinds[:-1] == _NUMBER
        beside[:-1] |= (kinds[1:] == _NUMBER) & (kinds[:-1] == _SIGN)
        kinds[((kinds == _UNIT) | (kinds == _SIGN)) & beside] = _MEASURE
        keep = np.flatnonzero((kinds != _STOP) & (kinds != _SIGN))
        kinds, begins, holders = kinds[keep], begins[keep], _holders()
        self.raw, self.keep, self.text = raw, keep, np.repeat(np.arange(len(texts)), sizes)[keep]
        self.start = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.plain = np.frombuffer(tokens.hashes, np.uint64)[at[keep]]
        self.plain[kinds == _NUMBER] = holders[1]
        self.plain[kinds == _MEASURE] = holders[3]
        self.typed = self.plain.copy()
        self.typed[kinds == _NAME] = holders[2]
        self.full = self.typed.copy()
        self.full[begins] = holders[2]
        self.slot = (kinds == _NUMBER) | (kinds == _NAME) | (kinds == _MEASURE)
        self.full_slot = self.slot | begins

    def windows(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(hashes, places, whether full) of windows of n tokens, plain ones and, where a name makes them differ, typed and full ones."""
        count = len(self.plain) - n + 1
        if count <= 0:
            return
        within = self.text[n - 1 :] == self.text[:count]
        names, begun = (np.concatenate(([0], np.cumsum(x != y))) for x, y in ((self.typed, self.plain), (self.full, self.typed)))
        for tokens, at in ((self.plain, np.flatnonzero(within)), (self.typed, np.flatnonzero(within & (names[n:] > names[:-n]))), (self.full, np.flatnonzero(within & (begun[n:] > begun[:-n])))):
            h = np.zeros(len(at), np.uint64)
            for j in range(n):
                h = _mixed(h + tokens[at + j]) * np.uint64(0xD6E8FEB86659FD93)
            yield h ^ np.uint64(n), at, tokens is self.full

    def slots(self, at: int, n: int, full: bool) -> list[str]:
        """The values of a window's slots, each with its place in the window."""
        return [f"{j}:{self.raw[self.keep[at + j]].lower()}" for j in np.flatnonzero((self.full_slot if full else self.slot)[at : at + n]).tolist()]


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(hash, item_id, at, size, of, slots, full): the windows of all items; an item of fewer tokens is one window, one without tokens none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for b in batches:
            out = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = Templates([text], tokens)
                n = min(window, len(t.plain))
                for h, at, full in t.windows(n) if n else ():
                    out += [(int(x), item, p, n, len(t.plain) - n + 1, t.slots(p, n, full), full) for x, p in zip(_signed(h).tolist(), at.tolist(), strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["hash", "item_id", "at", "size", "of", "slots", "full"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(tidied(run), "hash long, item_id long, at int, size int, of int, slots array<string>, full boolean").distinct()


def key_windows(bench: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(hash, item_id) of each item's rarest windows, so many that a document which holds the item's share of windows holds one of them.

    Of an item's places a document may miss those beyond the share; one more than that can't all be missed. Windows that
    many items have are keys of an item only if it has no rarer ones.
    """
    counts = bench.groupBy("hash").agg(F.countDistinct("item_id").alias("items"))
    places = bench.join(counts, "hash").groupBy("item_id", "at", "of").agg(F.max("items").alias("items"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("items", "at"))
    missed = F.col("of") - F.ceil(F.col("of") * coverage - 1e-9)
    chosen = places.withColumn("rank", rank).where(F.col("rank") <= missed + 1).select("item_id", "at")
    return bench.join(chosen, ["item_id", "at"]).select("hash", "item_id").distinct()


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, sieve: int = SIEVE) -> DataFrame:
    """doc_id, text_hash, item_id, covered, of, coverage, n_slots, n_changed, kind for each item that a document holds.

    kind: `exact` if all slots have the item's values, else `reparameterised`. text_hash (xxhash64 of the text) tells
    rows of the same doc_id apart; equal rows come back once. Null and empty texts and items hold nothing and are held by
    nothing. Other columns are ignored. With an empty table the result is empty.
    """
    spark = docs.sparkSession
    bench = written(benchmark_windows(items, window), "windows")
    sizes = sorted({r[0] for r in bench.select("size").distinct().collect()})  # at most `window` numbers
    known = None
    if bench.count() <= sieve:
        known = spark.sparkContext.broadcast(np.unique(bench.select("hash").toArrow().column(0).to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        if known is not None:
            table_ = np.zeros(1 << 22, bool)
            table_[known.value & ((1 << 22) - 1)] = True
        for b in batches:
            docs_, keys, texts, start = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), 0
            while start < len(texts):
                stop, held = start, 0
                while stop < len(texts) and (held == 0 or held + len(texts[stop]) <= PIECE):
                    held += len(texts[stop]) + 1
                    stop += 1
                t, out = Templates(texts[start:stop], tokens), []
                for n in sizes:
                    for h, at, full in t.windows(n):
                        h = _signed(h)
                        if known is not None:
                            maybe = np.flatnonzero(table_[h & ((1 << 22) - 1)])
                            place = np.minimum(np.searchsorted(known.value, h[maybe]), len(known.value) - 1)
                            maybe = maybe[known.value[place] == h[maybe]]
                            h, at = h[maybe], at[maybe]
                        whose = t.text[at]
                        out += [(docs_[start + d], keys[start + d], x, p - f, t.slots(p, n, full), full) for d, x, p, f in zip(whose.tolist(), h.tolist(), at.tolist(), t.start[whose].tolist(), strict=True)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t_) for c, t_ in enumerate(kinds)], names=["doc_id", "text_hash", "hash", "pos", "found", "begins"])
                start = stop

    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    seen = written(rows.mapInArrow(tidied(run), "doc_id long, text_hash long, hash long, pos int, found array<string>, begins boolean"), "hits")
    # items of which a document has a rare window; only those are compared, so a window that many items share pairs no document with all of them
    keys = written(key_windows(bench, coverage), "keys")
    maybe = seen.select("doc_id", "text_hash", "hash").join(keys, "hash").select(F.col("doc_id").alias("maybe_id"), F.col("text_hash").alias("maybe_hash"), "item_id").distinct()
    asked = seen.join(written(maybe, "maybe"), F.col("doc_id").eqNullSafe(F.col("maybe_id")) & (F.col("text_hash") == F.col("maybe_hash"))).drop("maybe_id", "maybe_hash")
    hits = asked.join(bench, ["hash", "item_id"])
    # one alignment of an item in a document: windows at the same distance, whose slots must agree one to one; if they don't with
    # the words that begin sentences as names, then they may without
    pairs = F.zip_with("slots", "found", lambda a, b: F.struct(F.regexp_replace(a, "^\\d+:", "").alias("a"), F.regexp_replace(b, "^\\d+:", "").alias("b")))
    sure = ~(F.col("full") | F.col("begins"))
    sets = [F.collect_set(F.when(which, x)).alias(name) for name, which, x in (("all_places", F.lit(True), F.col("at")), ("all_pairs", F.lit(True), pairs), ("sure_places", sure, F.col("at")), ("sure_pairs", sure, pairs))]
    alignment = hits.where(F.size("slots") == F.size("found")).groupBy("doc_id", "text_hash", "item_id", "of", (F.col("pos") - F.col("at")).alias("shift")).agg(*sets)
    alignment = alignment.withColumns({name: F.array_distinct(F.flatten(name)) for name in ("all_pairs", "sure_pairs")})

    def agrees(name: str):
        return (F.size(name) == F.size(F.array_distinct(f"{name}.a"))) & (F.size(name) == F.size(F.array_distinct(f"{name}.b")))

    chosen = alignment.withColumn("with_all", agrees("all_pairs")).where(F.col("with_all") | agrees("sure_pairs"))
    chosen = chosen.select("doc_id", "text_hash", "item_id", "of", *(F.when(F.col("with_all"), F.col(f"all_{x}")).otherwise(F.col(f"sure_{x}")).alias(x) for x in ("places", "pairs")))
    whole = chosen.groupBy("doc_id", "text_hash", "item_id", "of").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    share = F.col("covered") / F.col("of")
    changed = F.size(F.filter("pairs", lambda p: p["a"] != p["b"]))
    return whole.where(share >= coverage).select("doc_id", "text_hash", "item_id", "covered", "of", share.alias("coverage"), F.size("pairs").alias("n_slots"), changed.alias("n_changed"), F.when(changed == 0, "exact").otherwise("reparameterised").alias("kind"))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the rows that hold an item of the benchmark; their columns and all other rows stay as they are."""
    doc, key = fresh(docs, "found_doc", "found_hash")
    found = contaminated(docs, items, **options).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(key)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key))
    return docs.join(found, same, "left_anti")


def op1_template_decontam(spark, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items."""
    return contaminated(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")).drop("text_hash")
