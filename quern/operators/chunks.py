"""Chunkers as Column expressions over one text: they return arrays of chunks, which explode() turns into rows.

Splitting, packing and windows stay in the row: nothing is shuffled, and a long text costs what its own array costs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import bound

#: Longest clause that is kept whole, window, step and shortest chunk of the legal chunker, in characters.
CLAUSE, WINDOW, STEP, SHORTEST = 512, 512, 462, 20
#: Words of a packed chunk, and of an oversize chunk's windows with what they share.
PACKED, OVERSIZE, OVERLAP = 500, 1000, 50
ARTICLE, CLAUSE_MARK, POINT = r"Điều\s+(\d+[a-zA-Z]?)[.:\s]+", r"[Kk]hoản\s+(\d+[a-zA-Z]?)[.:\s]+", r"([a-zâêôơưđ])\s*[).]\s*"
PART = "array<struct<num:string,body:string>>"


def _parts(text: Column, pattern: str) -> Column:
    """(num, body) of each mark and what follows it; what stands before the first mark is left out."""
    nums = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    bodies = F.split(text, pattern, -1)
    return F.transform(nums, lambda n, i: F.struct(n.alias("num"), F.trim(F.regexp_replace(F.get(bodies, i + 1), r"^\s+|\s+$", "")).alias("body")))


def articles(text: Column) -> Column:
    return _parts(text, ARTICLE)


def clauses(text: Column) -> Column:
    return _parts(text, CLAUSE_MARK)


def points(text: Column) -> Column:
    """Points by letter; what stands before the first is point 0; empty ones go."""
    lead = F.struct(F.lit("0").alias("num"), F.regexp_replace(F.get(F.split(text, POINT, -1), 0), r"^\s+|\s+$", "").alias("body"))
    return F.filter(F.concat(F.array(lead), _parts(text, POINT)), lambda p: p["body"] != "")


def paragraphs(text: Column, separator: str = r"\n\s*\n") -> Column:
    """Trimmed paragraphs that aren't empty."""
    return F.filter(F.transform(F.split(text, separator, -1), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Sentences after . ! ? or at line ends, trimmed, none empty."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+", -1), lambda x: F.trim(x)), lambda s: s != "")


def windows(text: Column, size: int = WINDOW, step: int = STEP) -> Column:
    """(start, text) windows of characters; the last is the first that reaches the end."""
    n = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("start"), F.substring(text, i * step + 1, F.lit(size)).alias("text")))


def word_windows(words: Column, size: int = PACKED, overlap: int = OVERLAP, over: int = OVERSIZE) -> Column:
    """Texts of up to `over` words whole; longer ones in windows of `size` words that share `overlap`."""
    n = F.size(words)
    step = size - overlap
    last = F.when(n <= over, 0).otherwise(F.ceil((n - overlap) / step) - 1).cast("int")
    width = F.when(n <= over, F.greatest(n, F.lit(1))).otherwise(size)
    return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(words, i * step + 1, width), " "))


def packed(units: Column, most: int = PACKED, joiner: str = "\n\n", count: Callable[[Column], Column] | None = None) -> Column:
    """Units joined greedily while their tokens fit in `most`; an oversize unit is a chunk of its own, after what was pending."""
    count = count or (lambda u: F.size(F.filter(F.split(u, r"\s+"), lambda w: w != "")))
    start = F.struct(F.lit("").alias("cur"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, u: Column) -> Column:
        n = u["n"]
        fits = acc["n"] + n <= most
        joined = F.when(acc["cur"] == "", u["t"]).otherwise(F.concat(acc["cur"], F.lit(joiner), u["t"]))
        flushed = F.when(acc["cur"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["cur"]))
        return F.struct(F.when(fits, joined).otherwise(u["t"]).alias("cur"), F.when(fits, acc["n"] + n).otherwise(n).alias("n"), F.when(fits, acc["out"]).otherwise(flushed).alias("out"))

    sized = F.transform(units, lambda u: F.struct(u.alias("t"), count(u).alias("n")))
    return F.aggregate(sized, start, step, lambda acc: F.when(acc["cur"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["cur"])))


def packed_with_overlap(units: Column, most: int, overlap: int, joiner: str = "\n\n") -> Column:
    """Like packed(), and each chunk after the first begins with the last `overlap` words of the one before."""
    chunks = packed(units, most, joiner)

    def tail(c: Column) -> Column:
        w = F.filter(F.split(c, r"\s+"), lambda x: x != "")
        return F.array_join(F.slice(w, F.greatest(F.size(w) - overlap + 1, F.lit(1)), F.lit(max(overlap, 1))), " ")

    if overlap <= 0:
        return chunks
    return F.flatten(F.transform(F.array(chunks), lambda all_: F.transform(all_, lambda c, i: F.when(i == 0, c).otherwise(F.concat(tail(F.get(all_, i - 1)), F.lit(joiner), c)))))


def code_chunks(text: Column) -> Column:
    """Blocks between blank lines, packed; blocks aren't trimmed."""
    return packed(F.filter(F.split(text, "\n\n", -1), lambda b: F.trim(b) != ""))


def plain_chunks(text: Column) -> Column:
    return packed(paragraphs(text))


def markdown_sections(text: Column) -> Column:
    """Sections (header, body): each begins at a heading line; lines before the first are a section without header. Headings in fences aren't."""
    start = F.struct(F.lit(False).alias("fence"), F.lit(0).alias("i"), F.array(F.lit(0)).alias("heads"))

    def step(acc: Column, line: Column) -> Column:
        head = ~acc["fence"] & line.rlike(r"^#{1,6}\s+\S") & (acc["i"] > 0)
        return F.struct((acc["fence"] != line.rlike(r"^\s*```")).alias("fence"), (acc["i"] + 1).alias("i"), F.when(head, F.array_append(acc["heads"], acc["i"])).otherwise(acc["heads"]).alias("heads"))

    def cut(lines: Column) -> Column:
        def section(heads: Column) -> Column:
            body = lambda at, k: F.array_join(F.slice(lines, at + 1, F.coalesce(F.get(heads, k + 1), F.size(lines)) - at), "\n")
            title = lambda at: F.when(F.get(lines, at).rlike(r"^#{1,6}\s+\S"), F.regexp_replace(F.get(lines, at), r"^#{1,6}\s+", ""))
            return F.transform(heads, lambda at, k: F.struct(title(at).alias("header"), F.regexp_replace(body(at, k), r"^\s+|\s+$", "").alias("body")))

        return bound(F.aggregate(lines, start, step)["heads"], section)

    return F.filter(bound(F.split(text, "\n", -1), cut), lambda s: s["body"] != "")


def markdown_packed(text: Column, most: int = PACKED, overlap: int = 40) -> Column:
    """Markdown sections, each kept whole where it fits, packed to `most` words; chunks after the first begin with the last `overlap` words before."""
    return packed_with_overlap(F.transform(markdown_sections(text), lambda s: s["body"]), most, overlap)


def sentence_chunks(text: Column, most: int = 100) -> Column:
    """Sentences packed to `most` words with spaces; a longer sentence is cut at , ; : first."""
    whole = sentences(text)
    pieces = F.flatten(F.transform(whole, lambda s: F.when(F.size(F.split(s, r"\s+")) > most, F.filter(F.transform(F.split(s, r"(?<=[,;:])\s+"), lambda x: F.trim(x)), lambda p: p != "")).otherwise(F.array(s))))
    return packed(pieces, most, " ")


def dispatched(text: Column, kind: Column) -> Column:
    """Chunks by content type: markdown and runbooks by section, code by block, else by paragraph."""
    return F.when(kind.isin("markdown", "runbook"), F.transform(markdown_sections(text), lambda s: s["body"])).when(kind == "code", code_chunks(text)).otherwise(plain_chunks(text))


def legal(docs: DataFrame) -> DataFrame:
    """chunk_id, doc_id, title, article, clause, point, text of legal documents (doc_id, title, text).

    A document is cut at its articles, those at their clauses; a clause of up to 512 characters is kept whole, a longer
    one is cut at its points, or in windows if it has none; chunks of 20 characters or less go. A document without
    articles is cut in paragraphs. Ids that recur in a document get an ordinal. Null texts give nothing.
    """
    whole = docs.where("text is not null").select("doc_id", "title", "text", articles(F.col("text")).alias("parts"))
    with_articles = whole.where(F.size("parts") > 0).select("doc_id", "title", F.posexplode("parts").alias("a", "part"))
    clauses_ = clauses(F.col("part.body"))
    by_clause = with_articles.withColumn("c", F.when(F.size(clauses_) > 0, clauses_).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("num"), F.col("part.body").alias("body")))))
    clause = by_clause.select("doc_id", "title", "a", F.col("part.num").alias("article"), F.posexplode("c").alias("b", "cl"))
    found = points(F.col("cl.body"))
    cut = F.transform(windows(F.col("cl.body")), lambda w: F.struct(F.concat(F.lit("s"), w["start"].cast("string")).alias("num"), w["text"].alias("body")))
    many = F.when(F.length("cl.body") <= CLAUSE, F.array(F.struct(F.lit(None).cast("string").alias("num"), F.col("cl.body").alias("body")))).when(F.size(found) > 1, found).otherwise(cut)
    pieces = clause.select("doc_id", "title", "a", "b", "article", F.col("cl.num").alias("clause"), F.posexplode(many).alias("p", "piece")).where(F.length("piece.body") > SHORTEST)
    place = F.concat_ws(", ", F.concat(F.lit("Điều "), F.col("article")), F.concat(F.lit("Khoản "), F.col("clause")))
    named = pieces.select(
        "doc_id", "title", "article", "clause", F.col("piece.num").alias("point"), F.concat(F.lit("["), "title", F.lit("] "), place, F.lit(": "), F.col("piece.body")).alias("text"), (F.col("a") * 1000000 + F.col("b") * 1000 + F.col("p")).alias("ord"),
        F.concat_ws("_", F.col("doc_id").cast("string"), F.concat(F.lit("a"), F.col("article")), F.concat(F.lit("c"), F.col("clause")), F.col("piece.num")).alias("base"),
    )
    plain = whole.where(F.size("parts") == 0).select("doc_id", "title", F.posexplode(paragraphs(F.col("text"))).alias("p", "body")).where(F.length("body") > SHORTEST)
    rest = plain.select("doc_id", "title", F.lit(None).cast("string").alias("article"), F.lit(None).cast("string").alias("clause"), F.lit(None).cast("string").alias("point"), F.concat(F.lit("["), "title", F.lit("] "), "body").alias("text"), F.col("p").alias("ord"), F.concat_ws("_", F.col("doc_id").cast("string"), F.lit("chunk"), F.col("p").cast("string")).alias("base"))
    both = named.unionByName(rest)
    again = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("ord"))
    return both.withColumn("n", again).select(F.when(F.col("n") > 1, F.concat("base", F.lit("~"), F.col("n").cast("string"))).otherwise(F.col("base")).alias("chunk_id"), "doc_id", "title", "article", "clause", "point", "text")


def semantic_cuts(units: DataFrame, floor: float = 0.78, spread: float = 0.5) -> DataFrame:
    """units (doc_id, pos, tokens, v) with `cut`: whether a chunk ends after the unit.

    The similarity of neighbours is held against min(0.78, mean - spread * deviation) of the document, kept in 0 to 0.99.
    """
    from quern.functions.vectors import cosine

    doc = Window.partitionBy("doc_id")
    nxt = F.lead("v").over(doc.orderBy("pos"))
    sim = units.withColumn("sim", cosine(F.col("v"), nxt))
    limit = F.least(F.lit(0.99), F.greatest(F.lit(0.0), F.least(F.lit(floor), F.avg("sim").over(doc) - spread * F.stddev_pop("sim").over(doc))))
    return sim.withColumn("cut", F.coalesce(F.col("sim") < limit, F.lit(True))).drop("v")


def semantic_chunks(units: DataFrame, most: int = PACKED, least: int = 120, overlap: int = 40) -> DataFrame:
    """doc_id, pos, text of units (doc_id, pos, text, tokens, v): segments that end at semantic_cuts(), packed with overlap.

    A segment ends at a cut only from `least` tokens on, and before a unit that would take it over `most`. A document's units meet in
    one row, which is as long as the document.
    """
    each = semantic_cuts(units).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "tokens", "cut"))).alias("u"))
    start = F.struct(F.lit("").alias("cur"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, u: Column) -> Column:
        over = (acc["cur"] != "") & (acc["n"] + u["tokens"] > most)
        out = F.when(over, F.array_append(acc["out"], acc["cur"])).otherwise(acc["out"])
        cur = F.when(over | (acc["cur"] == ""), u["text"]).otherwise(F.concat(acc["cur"], F.lit(" "), u["text"]))
        n = F.when(over, u["tokens"]).otherwise(acc["n"] + u["tokens"]).cast("int")
        ends = u["cut"] & (n >= least)
        return F.struct(F.when(ends, "").otherwise(cur).alias("cur"), F.when(ends, 0).otherwise(n).alias("n"), F.when(ends, F.array_append(out, cur)).otherwise(out).alias("out"))

    segments = F.aggregate("u", start, step, lambda acc: F.when(acc["cur"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["cur"])))
    return each.select("doc_id", F.posexplode(packed_with_overlap(segments, most, overlap)).alias("pos", "text"))
