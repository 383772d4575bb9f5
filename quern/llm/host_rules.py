"""Quality rules by host, as DataFrame expressions: each document's counts, each host's failure rates, and verdicts on both.

A document's counts come from one pass over its text. For every rule a host's documents that fail it are counted, and the
rate is shrunk towards the rate of all documents with a beta prior that is fitted to the hosts themselves: the spread of
the hosts' rates beyond what chance gives decides how many documents the prior is worth. So a host of few documents isn't
judged by them alone, and hosts that differ no more than by chance all get the common rate. A host of which by its shrunk
rate more than half of the documents fail a rule is rejected, and its verdict goes back to its documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fresh, spread, table, told, written

#: Fixed values of the query's contract: a word, what counts as a symbol, words of a window, least words, percent of repeated words.
WORD, SPACE, SYMBOLS, WINDOW, MIN_WORDS, MAX_REPEATED = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+", "#*$%&|<>", 5, 10, 20
#: Each rule's failure, on the counts. The first two are the base rules, which reject a document by themselves.
BASE_RULES = {"short": f"n_words < {MIN_WORDS}", "repeated": f"100 * n_repeat_words > {MAX_REPEATED} * n_words"}
RULES = BASE_RULES | {"symbols": "10 * n_symbols > n_words", "dup_lines": "10 * n_dup_lines > 3 * n_lines", "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words"}
#: Shrunk rate of failures of one rule beyond which a host is rejected; digits of the rates that are returned.
HOST_LIMIT, DIGITS = 0.5, 6
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """How many words stand in windows of WINDOW words that the array holds twice or more."""

    def covered(w: Column, keys: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            return F.coalesce((a["key"] == b["key"]) & (F.slice(w, a["i"] + 1, WINDOW) == F.slice(w, b["i"] + 1, WINDOW)), F.lit(False))

        placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("i"))))
        met = let(placed, lambda s: F.filter(s, lambda a, j: same(a, F.get(s, j - 1)) | same(a, F.get(s, j + 1))))
        starts = F.sort_array(F.transform(met, lambda a: a["i"]))
        begin = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
        return F.aggregate(starts, begin, lambda a, i: F.struct((a["total"] + i + WINDOW - F.greatest(i, a["end"])).alias("total"), (i + WINDOW).alias("end")), lambda a: a["total"])

    def by_keys(w: Column, hashes: Column) -> Column:
        keys = F.transform(F.slice(hashes, 1, F.size(hashes) - WINDOW + 1), lambda x, i: F.xxhash64(x, *(F.get(hashes, i + k) for k in range(1, WINDOW))))
        # equal windows have equal keys, so texts without equal keys, nearly all, aren't sorted
        return let(keys, lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), 0).otherwise(covered(w, found)))

    return let(words, lambda w: F.when(F.size(w) < WINDOW + 1, 0).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: by_keys(w, h))))


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with COUNTS as new columns, which come last; a null text has no words.

    n_lines are the lines with a word, n_dup_lines those equal to an earlier one; characters are code points.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, SPACE, -1), lambda x: x != "")
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(WORD))
    n_lines = let(lines, lambda x: F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    n_words = let(words, lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("repeats")))
    named = dict(zip(COUNTS, fresh(docs, *COUNTS), strict=True))
    at_words, at_lines = fresh(docs, "of_words", "of_lines")
    found = docs.withColumns({at_words: n_words, at_lines: n_lines, named["n_symbols"]: F.size(F.split(whole, f"[{SYMBOLS}]", -1)) - 1})
    inside = {"n_words": f"{at_words}.n", "word_chars": f"{at_words}.chars", "n_repeat_words": f"{at_words}.repeats", "n_dup_lines": f"{at_lines}.dup", "n_lines": f"{at_lines}.all"}
    return found.select(*docs.columns, *(F.col(inside.get(c, named[c])).cast("long").alias(named[c]) for c in COUNTS))


def host_rates(counts: DataFrame, rules: dict[str, str] = RULES, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n_docs, a shrunk rate for each rule, host_rate (the largest of them) and host_rejected, of counts (host, COUNTS).

    A null host is a host of its own. The prior of a rule is that of the beta-binomial distribution by the analysis of
    variance between and within hosts; without spread beyond chance, or with one document a host, every rate is the
    common one, and where each host fails always or never, it is the host's own.
    """
    hosts = written(counts.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *(F.count_if(F.expr(r)).alias(f"x_{name}") for name, r in rules.items())), "hosts")
    sums = [F.count(F.lit(1)).alias("k"), F.sum("n_docs").alias("n"), F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("n2")]
    for name in rules:
        sums += [F.sum(f"x_{name}").alias(f"x_{name}"), F.sum(F.col(f"x_{name}").cast("double") * F.col(f"x_{name}") / F.col("n_docs")).alias(f"q_{name}")]
    overall = hosts.agg(*sums).first()
    rates = {f"rate_{name}": shrunk(f"x_{name}", *prior(overall["k"], overall["n"] or 0, overall["n2"] or 0.0, overall[f"x_{name}"] or 0, overall[f"q_{name}"] or 0.0)) for name in rules}
    # a column of its own, as one rule alone has no greatest()
    most = F.array_max(F.array(*(F.col(r) for r in rates)))
    return hosts.withColumns(rates).withColumn("host_rate", most).select("host", "n_docs", *(F.round(r, DIGITS).alias(r) for r in rates), F.round("host_rate", DIGITS).alias("host_rate"), (F.col("host_rate") > limit).alias("host_rejected"))


def prior(k: int, n: int, n2: float, x: int, q: float) -> tuple[float, float | None]:
    """The mean of a rule's prior and the documents it is worth (None: without bound), from k hosts of n documents, x failing.

    n2 is the sum of the hosts' squared numbers of documents, q that of their squared failures over documents.
    """
    if not n:
        return 0.0, None
    mean = x / n
    if k < 2 or n <= k:
        return mean, None
    between, within = max(0.0, q - x * x / n) / (k - 1), max(0.0, x - q) / (n - k)
    return (mean, None) if between <= within else (mean, (n - n2 / n) / (k - 1) * within / (between - within))


def shrunk(failures: str, mean: float, worth: float | None) -> Column:
    """A host's failure rate, drawn towards the prior's mean."""
    return F.lit(mean) if worth is None else (F.col(failures) + worth * mean) / (F.col("n_docs") + worth)


def host_rules(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None, rules: dict[str, str] = RULES, limit: float = HOST_LIMIT) -> DataFrame:
    """The columns `keep` of docs (None: all) with COUNTS, base_failed, host_rate, host_rejected and kept.

    Every row is kept once and judged by itself, repeated rows and null ids too. A null or empty text has no words, so it
    fails. kept is false for documents that fail a base rule and for all of a rejected host. An empty table gives an empty
    one. New columns come last; one that docs have a namesake of gets an underscore more.
    """
    keep = docs.columns if keep is None else keep
    plain = docs.select(*(F.col(c).alias(f"in_{k}") for k, c in enumerate(keep)), F.col(host).alias("host"), F.col(text).alias("text"))
    features = written(counted(plain).drop("text"), "counts")
    verdicts = written(host_rates(features, rules, limit).select(F.col("host").alias("of"), "host_rate", "host_rejected"), "verdicts")
    joined = features.join(told(verdicts), F.col("host").eqNullSafe(F.col("of")), "left")
    base_failed = F.expr(" OR ".join(f"({r})" for r in BASE_RULES.values()))
    out = [*COUNTS, "base_failed", "host_rate", "host_rejected", "kept"]
    judged = joined.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    return judged.select(*(F.col(f"in_{k}").alias(c) for k, c in enumerate(keep)), *(F.col(c).alias(n) for c, n in zip(out, fresh(docs.select(*keep), *out), strict=True)))


def op12_host_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents; a document's host is its source."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return host_rules(docs, keep=["doc_id"]).drop("n_lines")


def _sql() -> str:
    """The same in DuckDB."""
    base = " OR ".join(f"({r})" for r in BASE_RULES.values())
    x = ", ".join(f"count(*) FILTER ({r}) AS x_{name}" for name, r in RULES.items())
    overall = ", ".join(f"sum(x_{name}) AS x_{name}, sum(x_{name}::DOUBLE * x_{name} / n_docs) AS q_{name}" for name in RULES)
    spreads = ", ".join(f"greatest(0, q_{name} - x_{name}::DOUBLE * x_{name} / n) / (k - 1) AS b_{name}, greatest(0, x_{name} - q_{name}) / nullif(n - k, 0) AS w_{name}" for name in RULES)
    rates = ", ".join(f"CASE WHEN k < 2 OR n <= k OR b_{name} <= w_{name} THEN o.x_{name} / n ELSE (h.x_{name} + n0 * w_{name} / (b_{name} - w_{name}) * o.x_{name} / n) / (h.n_docs + n0 * w_{name} / (b_{name} - w_{name})) END" for name in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '{WORD}') AS words FROM d),
win AS (SELECT rid, unnest(range(1, len(words) - {WINDOW - 2})) AS i, words FROM w WHERE len(words) > {WINDOW}),
keyed AS (SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS key FROM win),
again AS (SELECT rid, i FROM keyed QUALIFY count(*) OVER (PARTITION BY rid, key) > 1),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM again) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
f AS (
  SELECT d.doc_id, d.source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(hit.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines
  FROM d JOIN w USING (rid) JOIN lines USING (rid) LEFT JOIN hit USING (rid)
),
h AS (SELECT source, count(*) AS n_docs, {x} FROM f GROUP BY source),
s AS (SELECT count(*) AS k, sum(n_docs) AS n, sum(n_docs::DOUBLE * n_docs) AS n2, {overall} FROM h),
o AS (SELECT *, (n - n2 / n) / (k - 1) AS n0, {spreads} FROM s),
v AS (SELECT h.source, greatest({rates}) AS rate FROM h, o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed,
  round(rate, {DIGITS}) AS host_rate, rate > {HOST_LIMIT} AS host_rejected, NOT ({base}) AND NOT rate > {HOST_LIMIT} AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""


SQL = _sql()
