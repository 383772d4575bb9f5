import re
from collections import Counter

import pytest

from quern.llm import host_rules as hr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(lines)


TEXTS = ["a b c d e f a b c d e", "a b c d e " * 3, "x " * 30, "a b c d e a b c d e", "one\none\n\n one\none", "# * $ %% &|<> a", "\x0b\x0c\r\n\t ", "é ü x   y 𝒳", "a b c d", "l1 w\nl2 w\nl1 w\n \n \nl2 w"]


def test_counts(spark, corpus):
    rows = [(k, t, "h") for k, t in enumerate([*TEXTS, *(r[1] for r in corpus)])]
    got = hr.counted(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["doc_id"]: tuple(r[c] for c in hr.COUNTS) for r in got} == {k: plain_counts(t) for k, t, _ in rows}


def rate(x, n, hosts):
    """The shrunk rate of one host by the formulas of the analysis of variance, hosts being (failures, documents)."""
    k, total, failed = len(hosts), sum(n for _, n in hosts), sum(x for x, _ in hosts)
    mean = failed / total
    between = sum(n * (x / n - mean) ** 2 for x, n in hosts) / (k - 1)
    within = sum(n * (x / n) * (1 - x / n) for x, n in hosts) / (total - k)
    if between <= within:
        return mean
    n0 = (total - sum(n * n for _, n in hosts) / total) / (k - 1)
    worth = n0 * within / (between - within)
    return (x + worth * mean) / (n + worth)


def test_host_verdicts(spark):
    good, bad = " ".join(f"wort{k}" for k in range(40)), "abc de fgh ij kl " * 8
    fine = [(h * 100 + k, good, f"host{h}") for h in range(6) for k in range(30)]
    junk = [(9000 + k, bad if k < 25 else good, "junk") for k in range(30)]
    small = [(9500, bad, "small"), (9600, good, None), (9601, bad, None), (None, good, "host0"), (9700, None, "host1")]
    got = hr.host_rules(spark.createDataFrame([*fine, *junk, *small], "doc_id long, text string, source string"))
    assert got.columns == ["doc_id", "text", "source", *hr.COUNTS, "base_failed", "host_rate", "host_rejected", "kept"]
    rows = got.collect()
    assert len(rows) == len(fine) + len(junk) + len(small)
    by = {r["doc_id"]: r for r in rows}
    hosts = [(0, 31), (0, 31), *[(0, 30)] * 4, (25, 30), (1, 1), (1, 2)]  # of the rule of repeated words
    assert by[9000]["host_rate"] == pytest.approx(rate(25, 30, hosts), abs=1e-6) and by[9000]["host_rejected"]
    assert by[9601]["host_rate"] == pytest.approx(rate(1, 2, hosts), abs=1e-6)
    # one bad document doesn't condemn a host of two, and clean documents of rejected hosts go
    assert by[9600]["kept"] and not by[9601]["kept"] and not by[9029]["kept"] and not by[9029]["base_failed"]
    assert all(by[d]["kept"] for d, _, _ in fine) and not by[9700]["kept"] and by[None]["kept"]


def test_priors(spark):
    assert hr.prior(0, 0, 0.0, 0, 0.0) == (0.0, None)
    assert hr.prior(1, 50, 2500.0, 10, 2.0) == (0.2, None)
    assert hr.prior(4, 4, 4.0, 2, 2.0) == (0.5, None)
    assert hr.prior(2, 20, 200.0, 10, 10.0) == (0.5, 0.0)  # always and never


def test_empty_and_clashing(spark, no_docs):
    assert hr.host_rules(no_docs).count() == 0
    one = spark.createDataFrame([(1, "a b", "s", "kept?", 7)], "doc_id long, text string, source string, kept string, N_words long")
    got = hr.host_rules(one)
    assert got.columns[5:] == ["n_words_", *hr.COUNTS[1:], "base_failed", "host_rate", "host_rejected", "kept_"]
    r = got.collect()[0]
    assert (r["kept"], r["N_words"], r["n_words_"], r["kept_"]) == ("kept?", 7, 2, False)
