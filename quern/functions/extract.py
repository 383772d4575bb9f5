"""Entities, relations and metadata found by patterns, as Column expressions that return arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import AUDIENCES, DOCUMENT_TYPES, DOMAINS, bound, completeness, holds_any, vote

#: Patterns and terms of legal entities.
LEGAL_MARKS = {"ARTICLE": r"(?iu)(Điều\s+\d+[a-zA-Z]?[.:\s]+)", "CLAUSE": r"(?iu)(Khoản\s+\d+[a-zA-Z]?[.:\s]+)", "POINT": r"(?iu)(Điểm\s+[a-zâêôơưđ][.:\s]+)"}
AGENCY = r"((?:Bộ|Sở|Ủy ban|Chính phủ|Quốc hội|Tòa án|Viện kiểm sát)\s+[A-ZÀ-Ỷ][a-zà-ỹ]+(?:\s+[A-ZÀ-Ỷ][a-zà-ỹ]+)*)"
LEGAL_TERMS = {
    "hợp đồng": "CONTRACT", "luật": "LAW", "nghị định": "DECREE", "thông tư": "CIRCULAR", "quyết định": "DECISION", "pháp lệnh": "ORDINANCE", "bộ luật": "CODE",
    "quyền": "RIGHT", "nghĩa vụ": "OBLIGATION", "trách nhiệm": "RESPONSIBILITY", "thanh tra": "INSPECTION", "kiểm toán": "AUDIT", "bảo hiểm": "INSURANCE", "đầu tư": "INVESTMENT",
}
LEGAL_RELATIONS = {"REFERS_TO": r"theo\s+quy\s+định\s+tại", "BASED_ON": r"căn\s+cứ\s+vào", "AMENDS": r"sửa\s+đổi", "SUPPLEMENTS": r"bổ\s+sung", "REPLACES": r"thay\s+thế", "GUIDES": r"hướng\s+dẫn", "REGULATES": r"quy\s+định", "APPLIES": r"áp\s+dụng"}
#: Patterns of operational entities; the person patterns read the text as it is, the others lower-cased.
ENTITY_PATTERNS = {
    "service": [r"\b([a-z]+-service)\b", r"\b([a-z]+-api)\b", r"\b([a-z]+-worker)\b", r"\b([a-z]+-db)\b"],
    "team": [r"\b(team [a-z]+)\b", r"\b([a-z]+ team)\b"],
    "person": [r"\b([A-Z][a-z]+ [A-Z][a-z]+)\b", r"@(\w+)\b"],
    "technology": [r"\b(kubernetes|k8s)\b", r"\b(docker)\b", r"\b(aws|gcp|azure)\b", r"\b(postgres(?:ql)?|mysql|mongodb)\b", r"\b(redis|memcached)\b", r"\b(kafka|rabbitmq)\b", r"\b(elasticsearch|opensearch)\b"],
    "endpoint": [r"(?i:GET|POST|PUT|DELETE|PATCH)\s+(/[\w/{}]+)", r"(https?://[\w./-]+)"],
    "metric": [r"\b(\w+_(?:count|total|duration|rate|latency|errors?))\b"],
}
#: Patterns of relationships; True where the second group is the source.
RELATION_PATTERNS = [
    (r"(\S+)\s+depends\s+on\s+(\S+)", "depends_on", False),
    (r"(\S+)\s+requires\s+(\S+)", "depends_on", False),
    (r"(\S+)\s+needs\s+(\S+)", "depends_on", False),
    (r"(\S+)\s+calls\s+(\S+)", "calls", False),
    (r"(\S+)\s+sends\s+(?:to|messages?)\s+(\S+)", "calls", False),
    (r"(\S+)\s+connects\s+to\s+(\S+)", "calls", False),
    (r"(\S+)\s+(?:owns|manages|maintains)\s+(\S+)", "owns", False),
    (r"(\S+)\s+is\s+(?:owned|managed|maintained)\s+by\s+(\S+)", "owns", True),
    (r"(\S+)\s+(?:is\s+)?(?:on|in|part\s+of)\s+(\S+\s+team)", "member_of", False),
    (r"(\S+)\s+leads?\s+(\S+)", "leads", False),
    (r"(\S+)\s+documents?\s+(\S+)", "documents", False),
    (r"(\S+)\s+describes?\s+(\S+)", "documents", False),
    (r"(\S+)\s+uses\s+(\S+)", "uses", False),
    (r"(\S+)\s+(?:runs|is\s+built)\s+(?:on|with)\s+(\S+)", "uses", False),
]
#: The types of inverse relationships; others become related_to.
INVERSE = {"depends_on": "depends_on", "owns": "member_of", "calls": "calls"}
DATES = [r"(\d{4}-\d{2}-\d{2})", r"((?i:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4})"]
URGENT, SOON, LATER = ["critical", "urgent", "immediately", "asap", "emergency"], ["important", "priority", "soon"], ["when possible", "low priority"]


def _named(kind: str, value: str):
    """A function of a match that makes it a struct of its type and value. (A lambda's second parameter would be the index.)"""
    return lambda v: F.struct(F.lit(kind).alias("type"), F.regexp_replace(v, r"^\s+|\s+$", "").alias(value))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def legal_entities(text: Column) -> Column:
    """(type, value) of articles, clauses, points, agencies and legal terms, in that order; marks in the order of the text."""
    parts = [F.transform(_all(text, p), _named(kind, "value")) for kind, p in LEGAL_MARKS.items()]
    parts.append(F.transform(_all(text, AGENCY), lambda v: F.struct(F.lit("AGENCY").alias("type"), F.regexp_replace(v, r"\s+", " ").alias("value"))))
    lower = F.lower(text)
    terms = F.filter(F.array(*(F.struct(F.lit("LEGAL_TERM").alias("type"), F.lit(t).alias("value")) for t in LEGAL_TERMS)), lambda x: F.contains(lower, x["value"]))
    return F.concat(*parts, terms)


def legal_relations(text: Column) -> Column:
    """The relation types whose words are in the text."""
    lower = F.lower(text)
    return F.filter(F.array(*(F.when(lower.rlike(p), F.lit(kind)) for kind, p in LEGAL_RELATIONS.items())), lambda x: x.isNotNull())


def _spots(text: Column, pattern: str, group: int = 1) -> Column:
    """(value, start, end) of each match: the group's text, and the whole match's place in characters."""
    whole, parts = _all(text, pattern, 0), F.split(text, pattern, -1)

    def placed(p: Column) -> Column:
        def length(a: Column, n: Column) -> Column:
            return F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))

        return F.transform(F.zip_with(p["whole"], p["values"], lambda w, v: F.struct(w.alias("w"), v.alias("v"))), lambda m, i: F.struct(m["v"].alias("value"), (length(p["parts"], i + 1) + length(p["whole"], i)).alias("start"), (length(p["parts"], i + 1) + length(p["whole"], i + 1)).alias("end")))

    return bound(F.struct(whole.alias("whole"), parts.alias("parts"), _all(text, pattern, group).alias("values")), placed)


def _around(text: Column, start: Column, end: Column, n: int) -> Column:
    """The text from n characters before a place to n after it."""
    first = F.greatest(F.lit(0), start - n)
    return F.substring(text, first + 1, end + n - first)


def entities(text: Column, confidence: float = 0.8, around: int = 50) -> Column:
    """(type, name, confidence, start, end, context) of operational entities, each name once for its type, whatever its case: where it is first found."""
    found = []
    for kind, patterns in ENTITY_PATTERNS.items():
        source = text if kind in ("person", "endpoint") else F.lower(text)
        spots = F.concat(*(_spots(source, p) for p in patterns))
        found.append(F.transform(spots, _of_kind(kind)))

    def once(all_: Column) -> Column:
        return F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, F.lit(1), i), lambda x: (x["type"] == e["type"]) & (x["name"] == e["name"])))

    def told(e: Column) -> Column:
        return F.struct(e["type"].alias("type"), e["name"].alias("name"), F.lit(confidence).alias("confidence"), e["start"].alias("start"), e["end"].alias("end"), _around(text, e["start"], e["end"], around).alias("context"))

    return F.transform(bound(F.concat(*found), once), told)


def _of_kind(kind: str):
    """A function of a spot that makes it a struct of type, name and place."""
    return lambda m: F.struct(F.lit(kind).alias("type"), F.regexp_replace(F.lower(m["value"]), r"^\s+|\s+$", "").alias("name"), m["start"].alias("start"), m["end"].alias("end"))


def entity_names(text: Column) -> Column:
    """The different names that entities() finds, whatever their type and place: each pattern reads the text once."""
    sources = {kind: text if kind in ("person", "endpoint") else F.lower(text) for kind in ENTITY_PATTERNS}
    found = F.concat(*(_all(sources[kind], p) for kind, patterns in ENTITY_PATTERNS.items() for p in patterns))
    return F.array_distinct(F.transform(found, lambda v: F.regexp_replace(F.lower(v), r"^\s+|\s+$", "")))


#: How all patterns of relationships begin, and the same for Java: a match begins where a word does or the last match ended, and a word before white space is taken whole.
WORD, WHOLE_WORD = r"(\S+)\s+", r"(?:(?<!\S)|\G)(\S++)\s++"


def _told(kind: str, lower: Column, pattern: str, groups: tuple[int, int], names: Column | None, around: int):
    """A function of the patterns' whole matches and the texts between them that makes them relationships."""

    def related(m: Column) -> Column:
        source, target = (F.regexp_extract(m["w"], pattern, g) for g in groups)
        sure = F.lit(True) if names is None else F.array_contains(names, source) & F.array_contains(names, target)
        return F.struct(source.alias("source"), F.lit(kind).alias("relation"), target.alias("target"), F.when(sure, 0.7).otherwise(0.5).alias("confidence"), _around(lower, m["start"], m["start"] + F.length(m["w"]), around).alias("evidence"))

    def placed(whole: Column) -> Column:
        def starts(gaps: Column) -> Column:
            def before(w: Column, i: Column) -> Column:
                return F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice(whole, F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x))

            return F.transform(F.transform(whole, lambda w, i: F.struct(w.alias("w"), before(w, i).alias("start"))), related)

        return F.when(F.size(whole) > 0, bound(F.split(lower, pattern, -1), starts))

    return placed


def relationships(text: Column, names: Column | None = None, around: int = 20) -> Column:
    """(source, relation, target, confidence, evidence) of all patterns, lower-cased, each once.

    The confidence is 0.7 where both ends are among the names of entities (lower-cased), or no names are given, else 0.5. The
    evidence is the match with `around` characters on either side. A pattern reads a text once, in time that grows with its
    length only: the words before it aren't tried again from each of their letters.
    """

    def all_of(lower: Column) -> Column:
        found = []
        for pattern, kind, swap in RELATION_PATTERNS:
            quick = WHOLE_WORD + pattern.removeprefix(WORD)
            none = F.array().cast("array<struct<source:string,relation:string,target:string,confidence:double,evidence:string>>")
            found.append(F.coalesce(bound(_all(lower, quick, 0), _told(kind, lower, quick, (2, 1) if swap else (1, 2), names, around)), none))
        return F.array_distinct(F.concat(*found))

    return F.when(text.isNotNull(), bound(F.lower(text), all_of))


def metadata(text: Column) -> Column:
    """document_type, domain, audience, dates (five at most), urgency and completeness of a text."""
    lower = F.lower(text)
    kind = vote(lower, DOCUMENT_TYPES)
    urgency = F.when(holds_any(lower, URGENT), "critical").when(holds_any(lower, SOON), "high").when(holds_any(lower, LATER), "low")
    return F.struct(kind.alias("document_type"), vote(lower, DOMAINS).alias("domain"), vote(lower, AUDIENCES).alias("audience"), F.slice(F.concat(*(_all(text, p) for p in DATES)), 1, 5).alias("dates"), urgency.alias("urgency"), completeness(text, F.coalesce(kind, F.lit(""))).alias("completeness"))


def inverse(relation: Column) -> Column:
    """The type of the inverse relationship."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in INVERSE.items() for x in kv))[relation], F.lit("related_to"))
