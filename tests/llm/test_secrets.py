"""Tokens that look random, against plain Python and against planted keys."""

import math
import random
import re
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from quern.llm import secret_battery

from .conftest import prose

B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
ENCODINGS = [("decimal", "[0-9]+", "0123456789"), ("hex", "[0-9a-f]+", "0123456789abcdef"), ("upper_hex", "[0-9A-F]+", "0123456789ABCDEF"), ("base32", "[A-Z2-7=]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("lower_base36", "[a-z0-9]+", "abcdefghijklmnopqrstuvwxyz0123456789"), ("base64", ".*", B64)]


def tail(z):
    x = abs(z) / 2**0.5
    t = 1 / (1 + x * 0.3275911)
    half = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * math.exp(-x * x) / 2
    return half if z >= 0 else 1 - half


def stat(x, k):
    """-log of the combined p-value of a token's places x in an alphabet of k."""
    n, middle = len(x), (k - 1) / 2
    sizes = Counter(math.floor(v * 8 / k) for v in range(int(k)))
    chi = sum(c * c / sizes[g] for g, c in Counter(math.floor(v * 8 / k) for v in x).items()) * k / max(n, 1) - n
    z_chi = ((max(chi, 0) / 7) ** (1 / 3) - (1 - 2 / 63)) / (2 / 63) ** 0.5
    high = sum(v > middle for v in x)
    low, runs = n - high, 1 + sum((a > middle) != (b > middle) for a, b in zip(x, x[1:], strict=False))
    mean = 2 * high * low / max(n, 1) + 1
    z_runs = math.sqrt(n) if 0 in (high, low) else abs(runs - mean) / math.sqrt(max((mean - 1) * (mean - 2) / max(n - 1, 1), 1e-9))
    z_serial = abs(sum((a - middle) * (b - middle) for a, b in zip(x, x[1:], strict=False))) / ((k * k - 1) / 12 * math.sqrt(max(n - 1, 1)))
    half = sum(-math.log(min(max(p, 1e-40), 1)) for p in (tail(z_chi), 2 * tail(z_runs), 2 * tail(z_serial)))
    return max(half - math.log(1 + half + half * half / 2), 0)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def decoy(text):
    h = signed(xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(b"decoy", 42)))
    letters = re.sub("[^A-Za-z]+", "", text)
    if len(letters) < 20:
        return None
    n = 20 * 2 ** min(h % 4, int(math.log2(len(letters) / 20)))
    at, (name, _, alphabet) = (h >> 8) % (len(letters) - n + 1), ENCODINGS[(h >> 40) % 6]
    k = len(alphabet)
    return name, n, stat([B64.index(c if k == 64 else c.upper()) % k for c in letters[at : at + n]], k)


def by_brute_force(texts, fdr=0.05):
    """The random spans of each text."""
    tokens, counts = [], defaultdict(lambda: [Counter(), Counter()])
    for d, text in enumerate(texts):
        for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", text or ""):
            name, _, alphabet = next(e for e in ENCODINGS if re.fullmatch(e[1], m[0]))
            x = [alphabet.index(c) for c in m[0] if c in alphabet]
            s = stat(x, len(alphabet))
            level = min(3, int(math.log2(max(len(x), 20) / 20)))
            tokens.append((d, m.span(), name, level, len(x) * math.log2(len(alphabet)), s))
            counts[name, level][0][math.ceil(s / 0.25)] += 1
        if found := decoy(text or ""):
            name, n, s = found
            counts[name, min(3, int(math.log2(n / 20)))][1][math.ceil(s / 0.25)] += 1
    limits = {}
    for key, (real, fake) in counts.items():
        for step in sorted({*real, *fake}):
            c, m = sum(v for k, v in fake.items() if k <= step), sum(v for k, v in real.items() if k <= step)
            if sum(real.values()) * (1 + c) <= fdr * m * (1 + sum(fake.values())):
                limits[key] = step * 0.25
    out = defaultdict(list)
    for d, span, name, level, bits, s in tokens:
        if bits >= 80 and s <= limits.get((name, level), -1):
            out[d].append(span)
    return out


def planted(n_docs, per_kind):
    """Texts of words, some with a random key or a token of words, and which is which."""
    rng = random.Random(81)
    texts = [prose(rng, rng.randint(10, 90)) for _ in range(n_docs)]
    keys, words = [], []
    for alphabet in ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", B64[:-2] + "-_"):
        for n in (22, 32, 44, 64, 100):
            for _ in range(per_kind):
                keys.append((len(texts), n, alphabet))
                texts.append(f"{prose(rng, 8)} {''.join(rng.choice(alphabet) for _ in range(n))} {prose(rng, 5)}")
    for _ in range(per_kind * 30):
        parts = [w.strip(".") for w in prose(rng, 16).split()]
        token = rng.choice(("-", "_", "/", "")).join(parts)[: rng.randint(24, 90)]
        words.append(len(texts))
        texts.append(f"see {rng.choice((token, token.lower(), token.title(), token.upper()))} there")
    return texts, keys, words


def test_random_tokens_by_brute_force_and_planted_keys(spark):
    texts, keys, words = planted(9000, 6)
    texts += [None, "", "a" * 300, "=" * 40, ("deadbeef" * 4 + " ") * 700, " ".join("x" * 21 for _ in range(650))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["secrets"] if s["kind"] == "random"] for r in secret_battery.with_spans(d).collect()}
    assert len(got) == len(texts)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in by_brute_force(texts).items() if v}
    found = defaultdict(list)
    for k, n, alphabet in keys:
        found[n, len(alphabet)].append(bool(got[k]))
    recall = {k: round(sum(v) / len(v), 2) for k, v in sorted(found.items())}
    false, right = sum(bool(got[k]) for k in words), sum(sum(v) for v in found.values())
    print("recall by length and alphabet", recall, "precision", right / (right + false))
    # words imitate short keys of small alphabets too well; the share of false ones is bounded in expectation
    assert false / (right + false) <= 0.15
    assert min(recall[44, 64], recall[64, 64]) >= 0.8 and all(recall[100, k] == 1 for k in (16, 32, 64))


def test_many_matches_in_one_text(spark):
    """Spans of a text that is cut into many pieces are those of the patterns."""
    text = " ".join(f"token: abcdef{k} AKIA{k:016d} é" for k in range(1500))
    got = secret_battery.with_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.filter("secrets", lambda s: s["order"] < 3).alias("s")).first()["s"]
    want = [(m.start(), m.end()) for m in re.finditer(r"token: [A-Za-z0-9+/_.=-]+|AKIA[A-Z0-9]+", text)]
    assert [(s["start"], s["end"]) for s in got] == want and len(want) == 3000


def test_random_tokens_look_random_in_all_encodings(spark):
    """Evenly drawn characters have small statistics, also where the parts of the alphabet differ in size."""
    rng, rows = random.Random(6), []
    for name, _, letters in ENCODINGS:
        for n in (40, 80, 400):
            while sum(r[:2] == (name, n) for r in rows) < 120:
                token = "".join(rng.choice(letters) for _ in range(n))
                if next(e for e, pattern, _ in ENCODINGS if re.fullmatch(pattern, token)) == name:
                    rows.append((name, n, token))
    tokens = F.array(F.struct(F.lit(0).alias("start"), F.length("t").alias("end"), F.col("t").alias("text")))
    got = spark.createDataFrame(rows, "name string, n int, t string").select("name", "n", secret_battery.with_tests(secret_battery.coded_tokens(tokens))[0]["stat"].alias("stat"))
    for r in got.groupBy("name", "n").agg(F.avg((F.col("stat") > 3).cast("double")).alias("odd"), F.avg("stat").alias("mean")).collect():
        # of a uniform p-value -log is over 3 in one of twenty cases and 1 in the mean; the tests of short tokens are coarser
        assert r["odd"] <= 0.2 and r["mean"] < 1.5, tuple(r)
