import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    """Invented words, sentence by sentence."""
    syllables = "ba de fi go lu ma ne po ri su ta ve wi xo yu za".split()
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    out, k = [], 0
    while k < n:
        m = rng.randint(4, 12)
        out.append(" ".join(words[k : k + m]).capitalize() + ".")
        k += m
    return " ".join(out)


@pytest.fixture(scope="session")
def corpus():
    """Rows of documents: plain, copies, near copies, shared passages, nulls, empty, white space, one very long, repeated rows."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(3, 160)) for _ in range(60)]
    shared = prose(rng, 60)
    texts = [*base, *base[:6], *[base[7]] * 12]
    for b in base[10:22]:
        words = b.split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [f"{prose(rng, 20)} {shared} {prose(rng, 20)}" for _ in range(8)]
    texts += [shared + " " + shared, "ab" * 400, None, None, "", "  \n\t ", "word", "zwei worte hier", prose(rng, 9000), "né " * 150, "é", "x" * 199, "x" * 200, "x" * 201]
    rows = [(k, t, "en", "src0" if k % 3 else f"src{k % 5}", None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id", None, None, None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
