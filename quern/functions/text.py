"""Text functions as Column expressions: tokenizers, hashes, keyword normalising, quality, category and query analysis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of the legal tokenizer.
LEGAL_STOP_WORDS = ["các", "có", "cho", "của", "được", "để", "đó", "khi", "là", "mà", "này", "như", "tại", "theo", "trong", "từ", "và", "với"]
#: Stop words of frequency keywords.
KEYWORD_STOP_WORDS = "all and are been but can for from had has have not that the their they this was were which will with you".split()
#: Stop words of query analysis.
QUERY_STOP_WORDS = "a an can could do for how i in is should the to what when where why would".split()
#: Words that give a query its intent, tried in order.
INTENTS = {
    "procedural": ["how to", "how do", "steps to", "procedure"],
    "troubleshooting": ["error", "fail", "issue", "debug", "fix", "broken"],
    "comparative": ["compare", "difference", "vs", "better"],
    "relational": ["who", "owns", "responsible", "team", "contact"],
    "temporal": ["when", "last", "history", "changed"],
}
URGENT, PRESSING = ["urgent", "asap", "critical", "down", "outage"], ["important", "production", "customer"]
#: Indicator words of document types, domains and audiences.
DOCUMENT_TYPES = {
    "runbook": ["runbook", "playbook", "procedure", "step 1", "step 2", "how to"],
    "incident_report": ["incident", "postmortem", "root cause", "timeline", "impact"],
    "architecture": ["architecture", "design doc", "system design", "components", "diagram"],
    "api_doc": ["endpoint", "request", "response", "api", "rest", "graphql"],
    "onboarding": ["getting started", "setup", "installation", "quickstart"],
    "policy": ["policy", "compliance", "must", "required", "prohibited"],
}
DOMAINS = {
    "payments": ["payment", "transaction", "billing", "invoice", "stripe", "checkout"],
    "auth": ["authentication", "authorization", "oauth", "jwt", "login", "password"],
    "infrastructure": ["kubernetes", "docker", "aws", "terraform", "deployment", "cluster"],
    "data": ["database", "postgres", "mysql", "redis", "cache", "migration"],
    "observability": ["monitoring", "logging", "metrics", "tracing", "alerts", "dashboard"],
}
AUDIENCES = {
    "developer": ["code", "api", "sdk", "library", "function", "class"],
    "ops": ["deploy", "rollback", "scale", "incident", "alert", "oncall"],
    "manager": ["summary", "overview", "business", "stakeholder", "timeline"],
}
#: Sections that a document type is expected to have.
SECTIONS = {"runbook": ["prerequisites", "steps", "verification"], "incident_report": ["summary", "timeline", "root cause", "action items"]}
#: Rules for the knowledge type of a leaf and of a summary, tried in order.
LEAF_TYPES = {
    "procedural": ["step 1", "first,", "then,", "how to", "procedure"],
    "relational": ["depends on", "calls", "owns", "manages"],
    "temporal": ["on january", "in 2023", "last week"],
    "policy": ["must", "required", "policy", "should not"],
    "social": ["@", "email", "slack", "contact"],
}
SUMMARY_TYPES = {"procedural": ["steps", "procedure", "process", "workflow"], "relational": ["architecture", "system", "components", "services"]}


def holds_any(text: Column, words: list[str]) -> Column:
    """Whether a text has any of the words as a substring."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def first_rule(text: Column, rules: dict[str, list[str]], otherwise: str | None) -> Column:
    """The name of the first rule one of whose words is in the text."""
    out = F.lit(otherwise)
    for name, words in reversed(rules.items()):
        out = F.when(holds_any(text, words), F.lit(name)).otherwise(out)
    return out


def vote(text: Column, indicators: dict[str, list[str]]) -> Column:
    """The category with the most indicator words in the text, the first declared of equals; null without any."""
    counts = [reduce(lambda a, b: a + b, (F.contains(text, F.lit(w)).cast("int") for w in words)) for words in indicators.values()]
    best = F.greatest(*counts)
    out = F.lit(None).cast("string")
    for name, n in reversed(list(zip(indicators, counts, strict=True))):
        out = F.when((n == best) & (n > 0), F.lit(name)).otherwise(out)
    return out


def legal_tokens(text: Column) -> Column:
    """Lower-cased tokens; article, clause and point numbers stay with their word; stop words and single characters go."""
    t = F.lower(text)
    for word, number in (("điều", r"\d+"), ("khoản", r"\d+"), ("điểm", "[a-z]")):
        t = F.regexp_replace(t, rf"{word}\s+({number})", f"{word}_$1")
    found = F.regexp_extract_all(t, F.lit("([a-zA-Z0-9À-ỹ_]+)"), F.lit(1))
    return F.filter(found, lambda x: (F.length(x) > 1) & ~x.isin(LEGAL_STOP_WORDS))


def words(text: Column) -> Column:
    """Lower-cased words between white space, no-break spaces too."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")


def bound(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def frequency_keywords(text: Column, n: int = 10) -> Column:
    """The n most frequent words of three or more letters that aren't stop words; of equals the one that stands first.

    (word, place) pairs are sorted once, and each word's run in them gives its count and first place: a text's words
    are counted without leaving the row, in time that grows with them and their sort only.
    """
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?<![a-z0-9_À-ỹ])([a-z]{3,})(?![a-z0-9_À-ỹ])"), F.lit(1))
    kept = F.filter(found, lambda w: ~w.isin(KEYWORD_STOP_WORDS))
    placed = F.array_sort(F.transform(kept, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def counted(p: Column) -> Column:
        starts = F.filter(F.transform(p, lambda x, i: F.when((i == 0) | (x["w"] != F.get(p, i - 1)["w"]), i)), lambda i: i.isNotNull())
        return bound(starts, lambda s: F.transform(s, lambda at, k: F.struct((at - F.coalesce(F.get(s, k + 1), F.size(p))).alias("n"), F.get(p, at)["i"].alias("i"), F.get(p, at)["w"].alias("w"))))

    return F.transform(F.slice(F.array_sort(bound(placed, counted)), 1, n), lambda x: x["w"])


def content_hash(text: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of the trimmed, lower-cased text."""
    return F.substring(F.sha2(F.lower(F.trim(text)), 256), 1, 16)


def quality(text: Column) -> Column:
    """1, less 0.3 under 20 words, 0.2 under half letters, 0.3 under three tenths different words; at least 0."""
    w = words(text)
    n = F.size(w)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.greatest(F.length(text), F.lit(1))
    unique = F.size(F.array_distinct(w)) / F.greatest(n, F.lit(1))
    score = F.lit(1.0) - F.when(n < 20, 0.3).otherwise(0.0) - F.when(letters < 0.5, 0.2).otherwise(0.0) - F.when((n > 0) & (unique < 0.3), 0.3).otherwise(0.0)
    return F.greatest(score, F.lit(0.0))


def intent(query: Column) -> Column:
    """A query's intent by the first matching words, factual if none."""
    return first_rule(F.lower(query), INTENTS, "factual")


def urgency(query: Column) -> Column:
    q = F.lower(query)
    return F.when(holds_any(q, URGENT), 0.9).when(holds_any(q, PRESSING), 0.7).otherwise(0.5)


def query_keywords(query: Column) -> Column:
    """A query's words of three or more characters that aren't stop words."""
    return F.filter(words(query), lambda w: (F.length(w) > 2) & ~w.isin(QUERY_STOP_WORDS))


def completeness(text: Column, kind: Column) -> Column:
    """1, less 0.3 with a placeholder, times the share of expected sections that a runbook or incident report has; at least 0.1."""
    t = F.lower(text)
    score = F.lit(1.0) - F.when(holds_any(t, ["todo", "tbd", "placeholder", "[insert"]), 0.3).otherwise(0.0)
    share = F.lit(1.0)
    for name, sections in SECTIONS.items():
        found = reduce(lambda a, b: a + b, (F.contains(t, F.lit(s)).cast("int") for s in sections))
        share = F.when(kind == name, found / len(sections)).otherwise(share)
    return F.greatest(F.lit(0.1), score * share)


def knowledge_type(text: Column, layer: Column) -> Column:
    t = F.lower(text)
    return F.when(layer > 0, first_rule(t, SUMMARY_TYPES, "contextual")).otherwise(first_rule(t, LEAF_TYPES, "factual"))


def normalised_keywords(keywords: Column, limit: int, longest: int = 80) -> Column:
    """Trimmed, cut at `longest` characters with an ellipsis, without case-insensitive repeats, in order, at most `limit`."""
    trimmed = F.filter(F.transform(keywords, lambda x: F.trim(x)), lambda k: k != "")
    cut = F.transform(trimmed, lambda k: F.when(F.length(k) > longest, F.concat(F.rtrim(F.substring(k, 1, longest)), F.lit("…"))).otherwise(k))
    lower = F.transform(cut, F.lower)
    return F.slice(F.filter(cut, lambda k, i: F.array_position(lower, F.lower(k)) == i + 1), 1, limit)


def ngram_overlap(text: Column, other: Column, n: int = 5) -> Column:
    """The share of a text's different n-grams of [a-z0-9]+ that the other text has too; 0 if it has none."""

    def grams(t: Column) -> Column:
        w = F.regexp_extract_all(F.lower(t), F.lit("([a-z0-9]+)"), F.lit(1))
        # the array is bound once by the outer lambda
        return F.flatten(F.transform(F.array(w), lambda a: F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(a) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(a, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))))

    a = F.array_distinct(grams(text))
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, grams(other))) / F.size(a)).otherwise(0.0)


def html_text(html: Column) -> Column:
    """A page's text by stripping scripts, styles and tags, white space made one space."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]*>", " "), r"\s+", " "))


def markdown_normalised(text: Column) -> Column:
    """Three or more newlines become two, ends are trimmed."""
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def without_provenance(text: Column) -> Column:
    """A text without its leading source header, shortcodes, comments and extra blank lines."""
    t = F.regexp_replace(text, r"^(?:\s*(?:Source|URL|Path|Title|Updated):[^\n]*\n)+", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)\{\{.*?\}\}", ""), r"(?s)<!--.*?-->", "")
    return markdown_normalised(t)


#: Content types by suffix.
CONTENT_TYPES = {"md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "txt": "text", "py": "code", "js": "code", "ts": "code", "go": "code", "java": "code", "rs": "code", "json": "json", "yaml": "yaml", "yml": "yaml", "pdf": "pdf", "rst": "text"}


def content_type(path: Column) -> Column:
    """A path's content type by its suffix, ignoring query and fragment; text if unknown."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in CONTENT_TYPES.items() for x in kv))[suffix], F.lit("text"))
