import hashlib
import random
import zlib

import pytest

from quern.llm import prefix_trie as pt

TURNS = "conv_id long, turn long, role string, text string"


def plain_sequences(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [t[1:] for t in sorted(v)] for c, v in convs.items()}


def plain_grafted(found):
    out = {}
    for c, own in found.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = [*found.get(base, [])[:h], *own[h:]]
    return out


def plain_trie(found):
    members = {}
    for c, seq in found.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    rows = []
    for p, convs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c in sorted(convs) if len(found[c]) == len(p))
        rows.append((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), sum(len(q) == len(p) + 1 for q in below), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "né", "", None])) for c in range(-12, 60) for t in range(rng.randint(1, 11))]
    out += [(c, t, "user", f"same {t}") for c in range(100, 130) for t in range(4)]
    out += [(200, None, "user", "first"), (200, 3, "x", "tie b"), (200, 3, "x", "tie a"), (200, 3, "x", "tie a"), (None, 1, "user", "nobody"), (203, 0, "u", "short")]
    rng.shuffle(out)
    return out


def collected(df):
    return sorted((tuple(r) for r in df.drop("pos", "end_pos").collect()), key=repr)


def test_trie_of_plain_conversations(spark, rows):
    got = pt.prefix_trie(pt.sequences(spark.createDataFrame(rows, TURNS)))
    assert collected(got) == plain_trie(plain_sequences(rows))


def test_trie_of_rebuilt_conversations(spark, rows, monkeypatch):
    for name, v in {"CHUNK": 4, "CHUNKS": 2, "SENT": 7, "BLOCK_BITS": 1, "RANGE_OF": 5}.items():
        monkeypatch.setattr(pt, name, v)
    got = pt.prefix_trie(pt.grafted(pt.sequences(spark.createDataFrame(rows, TURNS))))
    assert collected(got) == plain_trie(plain_grafted(plain_sequences(rows)))


def test_intervals_are_nested(spark, rows):
    got = pt.prefix_trie(pt.sequences(spark.createDataFrame(rows, TURNS))).collect()
    assert sorted(r["pos"] for r in got) == list(range(len(got)))
    open_ = []
    for r in sorted(got, key=lambda r: r["pos"]):
        while open_ and open_[-1]["end_pos"] <= r["pos"]:
            open_.pop()
        assert not open_ or r["end_pos"] <= open_[-1]["end_pos"]
        assert len(open_) == r["depth"] and (r["parent_conv_id"] == open_[-1]["conv_id"] if open_ else r["parent_conv_id"] is None)
        open_.append(r)


def test_empty_and_turnless(spark):
    assert pt.prefix_trie(pt.sequences(spark.createDataFrame([], TURNS))).count() == 0
    assert pt.prefix_trie(pt.sequences(spark.createDataFrame([(None, 0, "u", "t")], TURNS))).count() == 0
    # 1 shares its start with 0, which is absent; crc32 of "1" leaves 1 or more turns to drop
    lone = [(c, 0, "user", "only") for c in range(1, 40) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0][:2]
    got = collected(pt.prefix_trie(pt.grafted(pt.sequences(spark.createDataFrame(lone, TURNS)))))
    ends = hashlib.sha256(",".join(str(r[0]) for r in lone).encode()).hexdigest()
    assert got == [(lone[0][0], 0, None, 2, 0, 1, 0, ends)]
