"""Decontamination against plain loops over every document, item and alignment."""

import random
import re
from collections import defaultdict

import pytest

from quern.llm import template_decontam as td

from .conftest import DOCS, prose


def template(text):
    """For each kept token of a text: (word or number, typed, full, slot, slot in full), and its value."""
    raw = ["\n", *re.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[%$€£°.!?\n]", text or "")]
    signs = {u for u in td.UNITS if not u.isalpha()}
    kinds = []
    for t in raw:
        if t in ".!?\n":
            kinds.append("stop")
        elif t[0].isdigit():
            kinds.append("number")
        elif t.lower() in td.UNITS:
            kinds.append("sign" if t.lower() in signs else "unit")
        else:
            kinds.append("name" if len(t) > 1 and t[0].isupper() and t[1:].islower() else "word")
    out = []
    for k, (t, kind) in enumerate(zip(raw, kinds, strict=True)):
        begins = kind == "name" and kinds[k - 1] == "stop"
        if begins:
            kind = "word"
        number_before, number_after = k > 0 and kinds[k - 1] == "number", k + 1 < len(raw) and kinds[k + 1] == "number"
        # a unit stands after a number, a sign on either side of it
        if kind in ("unit", "sign") and (number_before or number_after and kind == "sign"):
            kind = "measure"
        if kind in ("stop", "sign"):
            continue
        plain = {"number": "<number>", "measure": "<unit>"}.get(kind, t.lower())
        typed = "<name>" if kind == "name" else plain
        slot = kind in ("number", "name", "measure")
        out.append((plain, typed, "<name>" if begins else typed, slot, slot or begins, t.lower()))
    return out


def variants(tokens, at, n):
    """(template, values of slots with their places, whether names that begin sentences are placeholders) of a window, each template once."""
    w = tokens[at : at + n]
    plain, typed, full = (tuple(t[k] for t in w) for k in range(3))
    slots, full_slots = ([(j, t[5]) for j, t in enumerate(w) if t[k]] for k in (3, 4))
    yield plain, slots, False
    if typed != plain:
        yield typed, slots, False
    if full != typed:
        yield full, full_slots, True


def one_to_one(pairs):
    return len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})


def holds(doc, item, window=5, coverage=0.8):
    """(covered, of, slots, changed) if a document's tokens hold an item's."""
    n = min(window, len(item))
    of, by_shift = len(item) - n + 1, defaultdict(lambda: (set(), set(), set(), set()))
    for pos in range(len(doc) - n + 1 if n else 0):
        theirs = list(variants(doc, pos, n))
        for at in range(of):
            for mine, slots, full in variants(item, at, n):
                for other, found, begins in theirs:
                    if mine == other and len(slots) == len(found):
                        pairs = {(a, b) for (_, a), (_, b) in zip(slots, found, strict=True)}
                        places, all_pairs, sure_places, sure_pairs = by_shift[pos - at]
                        places.add(at)
                        all_pairs |= pairs
                        if not full and not begins:
                            sure_places.add(at)
                            sure_pairs |= pairs
    places, pairs = set(), set()
    for p, q, sure_p, sure_q in by_shift.values():
        if one_to_one(q):
            places, pairs = places | p, pairs | q
        elif one_to_one(sure_q):
            places, pairs = places | sure_p, pairs | sure_q
    if n and len(places) / of >= coverage:
        return len(places), of, len(pairs), sum(a != b for a, b in pairs)
    return None


@pytest.mark.parametrize("sieve", [1 << 20, 0])
def test_by_brute_force(spark, sieve):
    rng = random.Random(101)
    names, units = ["Alice", "Robert", "Martha", "Jürgen", "Norma"], ["km", "kg", "%", "hours", "euros"]

    def problem():
        out = []
        for _ in range(rng.randint(2, 4)):
            a, b = rng.sample(names, 2)
            out.append(rng.choice([f"{a} gives {b} {rng.randint(2, 99)} {rng.choice(units)} of red paint.", f"How many {rng.choice(units)} are left if {a} walks {rng.randint(2, 9)} km?", f"Then {a} sells {rng.randint(10, 99)} of them for ${rng.randint(3, 50)} each.", prose(rng, 9)]))
        return " ".join(out)

    def changed(text):
        told = dict(zip(names, rng.sample(names + ["Victor", "Sandra"], len(names)), strict=True))
        text = re.sub("|".join(names), lambda m: told[m[0]], text)
        return re.sub(r"\d+", lambda m: str(int(m[0]) + 100), text) if rng.random() < 0.5 else re.sub(r"\d+", lambda m: str(rng.randint(1, 9)), text)

    # many items share windows, some are the same, some are short, empty or missing
    items = [(k, problem()) for k in range(60)] + [(60, "How many km are left?"), (61, "two words"), (62, ""), (63, None), (64, "42"), (65, "How many km are left?")]
    texts = [prose(rng, 20) for _ in range(20)] + [None, "", "42", "Two WORDS", ". . .", "How many kg are left? " * 30]
    for _, t in items[:60]:
        words = t.split(" ")
        texts += [f"{prose(rng, 6)} {rng.choice((t, changed(t), ' '.join(words[: len(words) * 5 // 6]), ' '.join(words[len(words) // 2 :])))} {prose(rng, 6)}"]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)] + [(None, texts[40], None, None, None), (3, texts[41], None, None, None)]
    want = set()
    for doc_id, text, *_ in rows:
        tokens = template(text)
        for item, t in items:
            if found := holds(tokens, template(t)):
                want.add((doc_id, item, *found))
    docs, bench = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = td.contaminated(docs, bench, sieve=sieve).collect()
    assert {(r["doc_id"], r["item_id"], r["covered"], r["of"], r["n_slots"], r["n_changed"]) for r in got} == want and len(want) > 60
    assert all(r["kind"] == ("exact" if r["n_changed"] == 0 else "reparameterised") for r in got) and {r["kind"] for r in got} == {"exact", "reparameterised"}
