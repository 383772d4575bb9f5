"""Secret scan: fixed patterns, and a battery of randomness tests over long tokens, all as SQL expressions.

Patterns mark assignments to secret-like names, access key ids and long hexadecimal runs. Besides, every run of 20 or
more characters that an encoding uses is a token. Its encoding is inferred from its characters: decimal, lower or upper
hexadecimal, base 32, lower letters with digits, else base 64. Three tests ask whether it looks like evenly drawn
characters of that alphabet: chi-squared on the counts of the alphabet's parts, the number of runs above and below the middle
of the alphabet, and the correlation of each character with the next. Fisher's method combines them; the less it finds, the
more random a token is.

What is reported are tokens that look random, so the error to control is a token of words among them. How random words
can look is measured on the corpus itself: from each text one decoy is cut, a run of its letters at a place that its
hash tells, written in one of the encodings. A token's p-value is the share of the decoys of its encoding and class of
lengths that look at least as random, and Benjamini-Hochberg over the tokens of that class bounds the expected share of
false secrets. Short tokens, which words imitate easily, need a better figure than long ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import fresh, spread, table, written

#: The patterns of the query's contract, and what they must reach in characters.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
ASSIGN_VALUE = 6
#: Tokens for the battery, and the bits that one must be able to hold in its inferred encoding.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
MIN_BITS = 80
#: Expected share of false secrets among the tokens that are reported for their randomness.
FDR = 0.05
#: Steps of the combined statistic, in which tokens and decoys are counted. Classes of lengths: 20 to 39, 40 to 79 and so on, the last without end.
STEP, STEPS, LENGTHS = 0.25, 400, 4
#: Parts of a text whose spans are found in one fold: the cost of appending doesn't grow with a text's matches.
PIECE = 600
#: The mark that is set around matches. In a text it is a character outside all patterns, and is replaced by another such.
MARK, OTHER = "\ue000", "\ue001"
#: The inferred encodings, in the order in which they are tried, each with its alphabet.
ENCODINGS = {
    "decimal": ("[0-9]+", "0123456789"),
    "hex": ("[0-9a-f]+", "0123456789abcdef"),
    "upper_hex": ("[0-9A-F]+", "0123456789ABCDEF"),
    "base32": ("[A-Z2-7=]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "lower_base36": ("[a-z0-9]+", "abcdefghijklmnopqrstuvwxyz0123456789"),
    "base64": (".*", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}


def marked(text: Column, pattern: str) -> Column:
    """A text cut before and after each leftmost non-overlapping match: of every two parts the second is a match."""
    return F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)


def marked_assign(text: Column) -> Column:
    """A text cut at the matches of ASSIGN: of every three parts the second is a match up to its value, the third the value."""
    return F.split(F.regexp_replace(text, ASSIGN, f"{MARK}$1{MARK}$2{MARK}"), MARK, -1)


def spans_of(parts: Column, kind: str, order: int, cycle: int = 2) -> Column:
    """Spans, in code points, of the matches in a cut text. With a cycle of 3 the value must have ASSIGN_VALUE characters.

    Pieces of PIECE parts, a whole number of cycles, are folded by themselves and then shifted by the lengths before them.
    """
    spans = "array<struct<start:int,end:int,last:int,text:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("out"), F.lit(0).alias("began"), F.lit("").alias("head"))
    sized = F.transform(parts, lambda t, i: F.struct(F.length(t).alias("n"), t.alias("t"), F.pmod(i, F.lit(cycle)).alias("c")))

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + p["n"]
        found = F.struct((acc["at"] if cycle == 2 else acc["began"]).alias("start"), end.alias("end"), p["n"].alias("last"), F.concat(acc["head"], p["t"]).alias("text"))
        return F.struct(
            end.alias("at"),
            F.when(p["c"] == cycle - 1, F.array_append(acc["out"], found)).otherwise(acc["out"]).alias("out"),
            F.when(p["c"] == 1, acc["at"]).otherwise(acc["began"]).alias("began"),
            F.when((p["c"] == 1) & F.lit(cycle == 3), p["t"]).otherwise(F.lit("")).alias("head"),
        )

    def joined_pieces(acc: Column, p: Column) -> Column:
        moved = F.transform(p["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["last"].alias("last"), s["text"].alias("text")))
        return F.struct((acc["at"] + p["at"]).alias("at"), F.array_append(acc["out"], moved).alias("out"))

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / PIECE).cast("int")), lambda k: F.aggregate(F.slice(sized, k * PIECE + 1, PIECE), start, step))
    whole = F.flatten(F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{spans}>").alias("out")), joined_pieces)["out"])
    found = F.when(F.size(parts) > PIECE, whole).when(F.size(parts) > 1, F.aggregate(sized, start, step)["out"]).otherwise(start["out"])
    kept = F.filter(found, lambda s: s["last"] >= ASSIGN_VALUE) if cycle == 3 else found
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["text"].alias("text")))


def _upper_tail(z: Column) -> Column:
    """The normal distribution's upper tail, by a polynomial with an error under 1e-7."""
    x = F.abs(z) / F.lit(2**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + x * 0.3275911)
    half = (((((t * 1.061405429 - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t) * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(F.lit(1.0) - half)


def inferred(token: Column) -> Column:
    """A token's encoding, the size k of its alphabet, and the alphabet's places x (from 0) of its characters."""
    encoding, alphabet = F.lit(None).cast("string"), F.lit("")
    for name, (pattern, letters) in reversed(ENCODINGS.items()):
        fits = token.rlike(f"^(?:{pattern})$")
        encoding, alphabet = F.when(fits, F.lit(name)).otherwise(encoding), F.when(fits, F.lit(letters)).otherwise(alphabet)
    places = F.filter(F.transform(F.split(token, ""), lambda c: F.call_function("instr", alphabet, c)), lambda i: i > 0)
    return F.struct(encoding.alias("encoding"), F.length(alphabet).cast("double").alias("k"), F.transform(places, lambda i: i.cast("double") - 1).alias("x"))


def with_tests(coded: Column) -> Column:
    """coded (array of structs of start, end, text and b, as inferred() gives it) with encoding, n, bits and stat of each token.

    stat is -log of the combined p-value: small where a token looks random.
    """

    def sums(s: Column) -> Column:
        x, k = s["b"]["x"], s["b"]["k"]
        n = F.size(x).cast("double")
        middle = (k - 1) / 2
        zero = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"), F.lit(0.0).alias("sp"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("high"))

        def step(a: Column, v: Column) -> Column:
            up = (v > middle).cast("double")
            first = a["last"] < 0
            return F.struct(
                v.alias("last"),
                (a["s"] + v - middle).alias("s"),
                (a["ss"] + (v - middle) * (v - middle)).alias("ss"),
                (a["sp"] + F.when(first, F.lit(0.0)).otherwise((a["last"] - middle) * (v - middle))).alias("sp"),
                (a["runs"] + F.when(first | ((a["last"] > middle) != (v > middle)), F.lit(1.0)).otherwise(F.lit(0.0))).alias("runs"),
                (a["high"] + up).alias("high"),
            )

        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["b"]["encoding"].alias("encoding"), k.alias("k"), n.alias("n"), F.aggregate(x, zero, step).alias("m"), F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda acc, g: acc + F.pow(F.size(F.filter(x, lambda v: F.floor(v * 8 / k) == g)).cast("double"), F.lit(2.0)) / (F.ceil((g + 1) * k / 8) - F.ceil(g * k / 8))).alias("squares"))

    def tests(s: Column) -> Column:
        n, m, k = s["n"], s["m"], s["k"]
        # eight parts of the alphabet, each expected by its symbols; Wilson and Hilferty's normal form of chi-squared
        chi = s["squares"] * k / F.greatest(n, F.lit(1.0)) - n
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / 7, F.lit(1 / 3)) - (1 - 2 / 63)) / (2 / 63) ** 0.5
        low = n - m["high"]
        mean = m["high"] * low * 2 / F.greatest(n, F.lit(1.0)) + 1
        var = F.greatest((mean - 1) * (mean - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(1e-9))
        z_runs = F.when((m["high"] == 0) | (low == 0), F.sqrt(n)).otherwise(F.abs(m["runs"] - mean) / F.sqrt(var))
        spread = (k * k - 1) / 12
        z_serial = F.abs(m["sp"]) / (spread * F.sqrt(F.greatest(n - 1, F.lit(1.0))))
        ps = [_upper_tail(z_chi), _upper_tail(z_runs) * 2, _upper_tail(z_serial) * 2]
        # Fisher: with half = -sum of logs, three p-values have the tail exp(-half) (1 + half + half^2 / 2)
        half = sum((-F.log(F.least(F.greatest(p, F.lit(1e-40)), F.lit(1.0))) for p in ps), F.lit(0.0))
        stat = F.greatest(half - F.log(1 + half + half * half / 2), F.lit(0.0))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["encoding"].alias("encoding"), n.alias("n"), (n * F.log2(k)).alias("bits"), stat.alias("stat"))

    return F.transform(F.transform(coded, sums), tests)


def coded_tokens(tokens: Column) -> Column:
    """Tokens with what inferred() says of them."""
    return F.transform(tokens, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), inferred(s["text"]).alias("b")))


def coded_decoys(text: Column) -> Column:
    """A text's decoy, as an array of one or none: some of its letters, in one encoding and class of lengths that the text's hash tells.

    A letter stands for the place that it has among A-Z, a-z, counted round the encoding's alphabet. A text of fewer letters than
    its class needs gives one of the longest class that it can, one of under 20 none.
    """
    letters, drawn = F.regexp_replace(text, "[^A-Za-z]+", ""), F.xxhash64(F.lit("decoy"), text)
    able = F.floor(F.log2(F.length(letters) / 20))
    n = F.lit(20) * F.pow(F.lit(2.0), F.least(F.pmod(drawn, F.lit(LENGTHS)), able)).cast("int")
    at = F.pmod(F.shiftright(drawn, 8), F.length(letters) - n + 1).cast("int")
    which = F.pmod(F.shiftright(drawn, 40), F.lit(len(ENCODINGS))).cast("int")
    names, sizes = (F.array(*(F.lit(x) for x in xs)) for xs in (ENCODINGS, [float(len(letters_)) for _, letters_ in ENCODINGS.values()]))
    cased = ENCODINGS["base64"][1]

    def one(s: Column) -> Column:
        k = F.element_at(sizes, s["which"] + 1)
        # where the encoding has one case, the letter's; in base 64 letters are themselves
        places = F.transform(F.split(s["cut"], ""), lambda c: F.call_function("instr", F.lit(cased), F.when(k < 64, F.upper(c)).otherwise(c)).cast("double") - 1)
        x = F.filter(F.transform(places, lambda p: p % k), lambda p: p >= 0)
        return F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("text"), F.struct(F.element_at(names, s["which"] + 1).alias("encoding"), k.alias("k"), x.alias("x")).alias("b"))

    # in an array, so that what is used more than once is worked out once
    cut = F.transform(F.array(F.struct(letters.alias("letters"), n.alias("n"), at.alias("at"), which.alias("which"))), lambda s: F.struct(F.substring(s["letters"], s["at"] + 1, s["n"]).alias("cut"), s["which"].alias("which")))
    return F.transform(F.filter(cut, lambda s: F.length(s["cut"]) >= 20), one)




def stratum(encoding: Column, n: Column) -> Column:
    """A token's class for the control of false secrets: encoding and class of lengths."""
    level = F.least(F.floor(F.log2(F.greatest(n, F.lit(20.0)) / 20)), F.lit(LENGTHS - 1))
    return F.concat(encoding, F.lit("/"), level.cast("string"))


def random_up_to(tested: DataFrame, fdr: float = FDR) -> dict[str, float]:
    """For each class the largest statistic that is reported, from tested (tokens, decoys: arrays of tested tokens).

    Benjamini-Hochberg on p-values (1 + decoys that look as random) / (1 + decoys of the class): with c decoys and m tokens
    up to a step, of D and N, the step is reported if N (1 + c) / (1 + D) <= fdr m. Where words are too few to tell, none is.
    Both are counted in steps of the statistic, so the corpus is met by one partial aggregation; a row comes back for
    each class.
    """
    both = [tested.select(F.explode(name).alias("t")).select(stratum(F.col("t.encoding"), F.col("t.n")).alias("stratum"), F.least(F.ceil(F.col("t.stat") / STEP), F.lit(STEPS)).cast("int").alias("step"), F.lit(decoy).alias("decoy")) for decoy, name in enumerate(("tokens", "decoys"))]
    counts = both[0].union(both[1]).groupBy("stratum", "step").agg(F.sum("decoy").alias("decoys"), F.sum(1 - F.col("decoy")).alias("tokens"))
    upto, whole = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("stratum")
    passed = counts.select("stratum", "step", F.sum("decoys").over(upto).alias("c"), F.sum("tokens").over(upto).alias("m"), F.sum("decoys").over(whole).alias("d"), F.sum("tokens").over(whole).alias("n"))
    passed = passed.where(F.col("n") * (1 + F.col("c")) <= F.lit(fdr) * F.col("m") * (1 + F.col("d")))
    return {r["stratum"]: r["step"] * STEP for r in passed.groupBy("stratum").agg(F.max("step").alias("step")).collect()}


#: Columns of candidates() after those that it was given.
FOUND = ("base", "tokens", "decoys")


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base (the patterns' spans), tokens (with their tests) and decoys; of clashing names the new ones get underscores."""
    base, tokens, decoys = fresh(docs, *FOUND)
    clean, p_assign, p_access, p_hex, p_token = fresh(docs, "clean", "p_assign", "p_access", "p_hex", "p_token")
    # each step is a projection of its own, so that what the next one reads more than once is computed once
    cleared = docs.withColumn(clean, F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(MARK), F.lit(OTHER)))
    cut = cleared.withColumns({p_token: marked(F.col(clean), TOKEN), p_assign: marked_assign(F.col(clean)), p_access: marked(F.col(clean), ACCESS), p_hex: marked(F.col(clean), HEX)})
    patterns = F.concat(spans_of(F.col(p_assign), "assign", 0, 3), spans_of(F.col(p_access), "access", 1), spans_of(F.col(p_hex), "hex", 2))
    return cut.select(*docs.columns, patterns.alias(base), with_tests(coded_tokens(spans_of(F.col(p_token), "random", 3))).alias(tokens), with_tests(coded_decoys(F.col(clean))).alias(decoys))


def reported(base: Column, tokens: Column, limits: dict[str, float]) -> Column:
    """The patterns' spans and the tokens that look random, by start, then by kind as listed."""

    def limit_of(s: Column) -> Column:
        name, out = stratum(s["encoding"], s["n"]), F.lit(-1.0)
        for key, at in sorted(limits.items()):
            out = F.when(name == key, F.lit(at)).otherwise(out)
        return out

    random = F.transform(F.filter(tokens, lambda s: (s["bits"] >= MIN_BITS) & (s["stat"] <= limit_of(s))), lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("order"), s["end"].alias("end"), F.lit("random").alias("kind"), s["text"].alias("text")))
    return F.array_sort(F.concat(base, random))


def with_spans(docs: DataFrame, text: str = "text", fdr: float = FDR, keep: list[str] | None = None) -> DataFrame:
    """docs, or of them the columns `keep`, with `secrets`: an array of (start, order, end, kind, text), by start, then by kind as listed.

    Kinds: assign, access, hex, and random for the battery's tokens. Starts and ends are in code points, ends exclusive.
    A null text is empty; every row is kept; where no token is in the corpus the patterns' spans remain. If docs have
    a column `secrets`, the new one, which is the last, gets an underscore more. The private character U+E000 is read as U+E001.
    Texts are read once: what was found is written to the shared folder with the columns that are kept.
    """
    keep = docs.columns if keep is None else keep
    base, tokens, decoys = fresh(docs, *FOUND)
    found = written(candidates(docs, text).select(*keep, base, tokens, decoys), "tokens")
    limits = random_up_to(found.select(F.col(tokens).alias("tokens"), F.col(decoys).alias("decoys")), fdr)
    return found.select(*keep, reported(F.col(base), F.col(tokens), limits).alias(fresh(docs, "secrets")[0]))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secret_battery(spark, sf_dir: str) -> DataFrame:
    """The spans of each document's secrets."""
    got = with_spans(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), keep=["doc_id"])
    base = F.filter("secrets", lambda s: s["order"] < 3)

    def count(order: int) -> Column:
        return F.size(F.filter("secrets", lambda s: s["order"] == order)).cast("long")

    return got.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
