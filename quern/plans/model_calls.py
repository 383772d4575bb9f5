"""Calls of models: texts packed into embedding calls of bounded size, summaries that are asked for again where they fail."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import ngram_overlap
from quern.store import materialised

#: Texts and estimated tokens of a call, characters of a text, characters of a token.
MOST_TEXTS, MOST_TOKENS, LONGEST, PER_TOKEN = 2048, 100_000, 32_000, 4
#: Modes of a summary; a copy has so many characters and so large a share of its five-word runs in the context.
MODES = ("details", "summary", "bullets", "keywords")
COPY_CHARS, COPY_SHARE, COPY_WORDS = 80, 0.75, 5
#: Words that are asked for, as a share of the tokens that are allowed, at least; and their share when a summary was cut off.
WORDS_OF_TOKENS, LEAST_WORDS, SHORTER, LEAST_SHORTER = 0.7, 25, 0.85, 20

#: What a worker has loaded, by the loader's name.
_LOADED: dict[str, Callable[[list[str]], Sequence[Sequence[float]]]] = {}


def prepared(text: str | None) -> str:
    """A text as it is sent: line ends are spaces, at most LONGEST characters; an empty one is a space."""
    return (text or "").replace("\n", " ").strip()[:LONGEST] or " "


def packed(texts: Iterator[tuple], most_texts: int = MOST_TEXTS, most_tokens: int = MOST_TOKENS) -> Iterator[list[tuple]]:
    """(id, text) in calls: as many in a row as stay within both bounds. A text over the bound is a call of its own."""
    call, tokens = [], 0
    for key, text in texts:
        text = prepared(text)
        own = len(text) // PER_TOKEN + 1
        if call and (tokens + own > most_tokens or len(call) == most_texts):
            yield call
            call, tokens = [], 0
        call.append((key, text))
        tokens += own
    if call:
        yield call


def embedded(texts: DataFrame, load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]], most_texts: int = MOST_TEXTS, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """node_id, v of texts (node_id, text): every row embedded, in calls packed from the rows of a partition as they stream by.

    load gives the model, a function from a list of texts to a vector each; a worker loads it once. Calls go over the
    borders of Arrow batches, so they are as large as the bounds allow; rows of at most one call are held. Repartition
    texts to decide how many calls run side by side.
    """
    name = f"{load.__module__}.{getattr(load, '__qualname__', load)}.{id(load)}"
    id_type = texts.schema["node_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        rows = ((key, text) for b in batches for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for call in packed(rows, most_texts, most_tokens):
            if model is None:
                model = _LOADED.get(name)
                if model is None:
                    model = _LOADED[name] = load()
            vectors = model([text for _, text in call])
            if len(vectors) != len(call):
                raise ValueError(f"{len(vectors)} vectors for {len(call)} texts")
            yield pa.RecordBatch.from_arrays([pa.array([key for key, _ in call]), pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float64()))], names=["node_id", "v"])

    return texts.select("node_id", "text").mapInArrow(run, f"node_id {id_type.simpleString()}, v array<double>")


def asked_words(max_tokens: int) -> int:
    """Words that a summary is asked to have, so that it ends before the tokens do."""
    return max(LEAST_WORDS, int(max(1, max_tokens) * WORDS_OF_TOKENS))


def looks_copied(summary: Column, context: Column) -> Column:
    """Whether a summary is mostly the context's own words, or begins with a heading or names a source as a copy would."""
    share = (F.length(summary) >= COPY_CHARS) & (ngram_overlap(summary, context, COPY_WORDS) >= COPY_SHARE)
    return share | F.startswith(F.ltrim(summary), F.lit("#")) | F.contains(F.substring(summary, 1, 400), F.lit("Source:"))


def has_bullets(summary: Column) -> Column:
    return F.exists(F.split(summary, "\n", -1), lambda line: F.startswith(F.ltrim(line), F.lit("- ")))


def instruction(purpose: str, mode: str, words: int) -> str:
    """What a chat model is told before the context: a default for ports that talk to one."""
    form = {"bullets": "six to ten short bullet points, each line beginning with '- '", "keywords": "ten to eighteen keywords on one line, separated by commas", "summary": f"a short summary of the main ideas in at most {words} words"}.get(mode, f"a detailed summary in at most {words} words")
    again = {"shorten": "The last answer was cut off; be shorter. ", "reword": "The last answer copied the text; use your own words. ", "bullets": "The last answer had no bullet points. "}.get(purpose, "")
    return f"{again}Write {form}. Don't quote whole sentences and leave out code."


def summarised(rows: DataFrame, ask: Callable[[Column, Column, str, int], Column], mode_of_layer: dict[int, str] | None = None, default: str = "details", max_tokens: int = 500) -> DataFrame:
    """node_id, mode, summary, asked of rows (node_id, layer, text): summaries by the mode of the layer, asked for again where they fail.

    ask: a port, (text, mode, purpose, words) to a struct of `text` and `cut` (whether it ran out of tokens). Purposes: `write`
    for all rows; `shorten` for those cut off, in fewer words; `reword` for those that look copied, unless they are
    keywords; `bullets` for bullet points without any. Each round asks only the rows that failed, three rounds at most,
    and an empty answer changes nothing. asked counts a row's calls. Without an answer the text's first words stand in, and a
    space where there are none, so that no summary is empty.
    """
    mode = F.lit(default)
    for layer, name in (mode_of_layer or {}).items():
        if name not in MODES:
            raise ValueError(f"unknown mode {name}")
        mode = F.when(F.col("layer") == layer, F.lit(name)).otherwise(mode)
    words = asked_words(max_tokens)
    todo = rows.select("node_id", F.coalesce("text", F.lit("")).alias("text"), mode.alias("mode"))
    first = todo.withColumn("a", ask(F.col("text"), F.col("mode"), "write", words))
    state = materialised(first.select("node_id", "text", "mode", F.trim(F.coalesce("a.text", F.lit(""))).alias("summary"), F.coalesce("a.cut", F.lit(False)).alias("cut"), F.lit(1).alias("asked")))
    rounds = [
        ("shorten", F.col("cut") & (F.col("summary") != ""), max(LEAST_SHORTER, int(words * SHORTER))),
        ("reword", looks_copied(F.col("summary"), F.col("text")) & (F.col("mode") != "keywords"), words),
        ("bullets", (F.col("mode") == "bullets") & ~has_bullets(F.col("summary")), words),
    ]
    for purpose, failed, fewer in rounds:
        again = materialised(state.where(failed))
        if again.isEmpty():
            continue
        answer = again.withColumn("a", ask(F.col("text"), F.col("mode"), purpose, fewer)).withColumn("new", F.trim(F.coalesce("a.text", F.lit(""))))
        better = answer.select("node_id", "text", "mode", F.when(F.col("new") != "", F.col("new")).otherwise(F.col("summary")).alias("summary"), "cut", (F.col("asked") + 1).alias("asked"))
        # rows without failure are those that weren't asked again
        state = materialised(state.join(again.select("node_id"), "node_id", "left_anti").unionByName(better))
    leading = F.array_join(F.slice(F.filter(F.split("text", r"\s+"), lambda w: w != ""), 1, max_tokens), " ")
    filled = F.when(F.col("summary") != "", F.col("summary")).when(leading != "", leading).otherwise(F.lit(" "))
    return state.select("node_id", "mode", filled.alias("summary"), "asked")
