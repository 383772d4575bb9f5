"""Main text of web pages, with each site's templates removed.

A page is read into a tree of elements. Every element that holds others or text has a hash of its subtree: name, class,
role and id, its text with digits made equal, and its children's hashes. Spark counts on how many different pages of a host
each hash stands, copies of a page being one, and subtrees that recur on many of them are the site's template and are deleted.
Nothing within the article proper is template. Menus, headers, footers, sidebars, notices, adverts, forms and
comments that a page marks as such go in any case, also on hosts with one page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import spread, table, tidied, written

#: A subtree is template if it stands on at least so many pages of its host, and on this share of them.
MIN_PAGES, MIN_SHARE = 3, 0.3
#: Template subtrees that are given to all executors; beyond it they are joined by host.
BROADCAST_ROWS = 100_000
#: Element names by what is done with them.
RAW = frozenset("script style noscript template textarea title iframe svg math xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head script style noscript template nav footer aside form button select option textarea input iframe svg annotation annotation-xml canvas dialog menu title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSED_BY = {"p": BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("table ul ol dl div section article main body td th".split())
#: Words in class, id or role that mark what isn't main text.
MARKED = frozenset("ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion comment comments discussion disqus feedback responses reply replies respond nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside footer header masthead cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription share sharing social related recommended pagination pager widget complementary contentinfo search login signup toolbar skip hidden".split())
#: Of these, words that an article's own parts have too.
OWN = frozenset("header masthead discussion feedback reply replies responses respond side aside notice notices alert share sharing social related recommended widget search login signup toolbar skip banner promo promotion subscription".split())
#: Words that mark a compound name too where they begin it, as comment-list.
LEADS = frozenset("comment comments disqus cookie cookies newsletter sidebar breadcrumb breadcrumbs pagination".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")


class Element:
    """An element; children are elements and strings."""

    __slots__ = ("children", "hash", "marks", "name", "parent", "tokens", "words")

    def __init__(self, name: str, marks: str, parent: Element | None):
        self.name, self.marks, self.parent, self.children, self.hash = name, marks, parent, [], 0
        self.tokens = frozenset(marks.split())
        self.words = frozenset(_SPLIT.split(marks)) if marks else frozenset()


def _marks(attributes: str) -> str:
    """Class, id and role, and `hidden` if the element isn't shown."""
    out = []
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            out.append(value.lower())
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            out.append("hidden")
    return " ".join(out)


def parse(page: str) -> Element:
    """The tree of a page. Ends of elements that are left out are found as browsers do for common cases; it never fails."""
    root = here = Element("", "", None)
    at, n = 0, len(page)
    lower = None
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            here.children.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            here.children.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            x = here
            while x is not None and x.name != name and not (x.name in SCOPES and name not in SCOPES and name in ("p", "b", "i", "em", "strong", "span", "a", "li")):
                x = x.parent
            if x is not None and x.name == name:
                here = x.parent
            continue
        for inner, closers in CLOSED_BY.items():
            if name in closers:
                x = here
                while x is not None and x.name != inner and x.name not in SCOPES:
                    x = x.parent
                if x is not None and x.name == inner:
                    here = x.parent
        new = Element(name, _marks(m[3]) if m[3] and not m[3].isspace() else "", here)
        here.children.append(new)
        if name in VOID or m[3].endswith("/") and name not in BLOCKS:
            continue
        if name in RAW and name not in ("svg", "math"):
            if lower is None:
                lower = page.lower()
            end = lower.find(f"</{name}", at)
            new.children.append(page[at:end] if end >= 0 else page[at:])
            at = n if end < 0 else end
            continue
        here = new
    return root


def _walk(root: Element) -> Iterator[Element]:
    """All elements, parents first."""
    stack = [root]
    while stack:
        x = stack.pop()
        yield x
        stack += [c for c in reversed(x.children) if type(c) is Element]


def hash_subtrees(root: Element) -> list[Element]:
    """Hashes all subtrees; returns those that can be template: blocks outside articles and main elements that hold none of these."""
    from xxhash import xxh64_intdigest

    order = list(_walk(root))
    for x in reversed(order):
        parts = [x.name, x.marks]
        for c in x.children:
            parts.append(str(c.hash) if type(c) is Element else _DIGITS.sub("0", _SPACE.sub(" ", c).strip()))
        x.hash = xxh64_intdigest("\x00".join(parts))
    inside, kept = {id(root): False}, set()  # kept: what stands in an article, or around it
    for x in order[1:]:
        inside[id(x)] = inside[id(x.parent)] or x.name in ("article", "main")
        if x.name in ("article", "main"):
            kept |= {id(y) for y in _up(x)}
        elif inside[id(x)]:
            kept.add(id(x))
    out = [x for x in order[1:] if x.name in BLOCKS and x.name not in ("html", "body") and id(x) not in kept]
    return out


def _unwanted(x: Element) -> bool:
    """Whether an element isn't main text by its name or marks.

    Outside articles and main elements any part of a class, id or role marks it. Inside, where words stand for what an article is
    about too, only a whole one does, and none of OWN, or one that begins with a word of LEADS.
    """
    if x.name in DROPPED:
        return True
    own = _within(x.parent, ("article", "main"))
    if x.name == "header":
        return not own
    if x.name in ("html", "body", "article", "main"):
        return False
    if not own:
        return bool(x.words & MARKED)
    return bool((x.tokens & MARKED) - OWN) or any(_SPLIT.split(t)[0] in LEADS for t in x.tokens)


def _within(x: Element, names: tuple[str, ...]) -> bool:
    while x is not None:
        if x.name in names:
            return True
        x = x.parent
    return False


def main_text(root: Element, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text: blocks in page order, white space in a block made one space, joined by two newlines.

    If the page has articles (else a main element), only they are read; an article among an article's comments isn't.
    """
    elements = list(_walk(root))
    gone = {id(x) for x in elements if _unwanted(x) or x.hash in template}
    found: set[int] = set()
    for wanted in ("article", "main"):
        found = {id(x) for x in elements if x.name == wanted and not any(id(y) in gone for y in _up(x))}
        if found:
            break
    blocks: list[list[str]] = [[]]
    # (element or string, whether it is in the part that is read); None closes a block
    stack: list[tuple] = [(root, not found)]
    while stack:
        x, read = stack.pop()
        if x is None:
            blocks.append([])
        elif type(x) is str:
            if read:
                blocks[-1].append(x)
        elif id(x) not in gone or x.name in ("html", "body"):
            read = read or id(x) in found
            if x.name == "br":
                blocks[-1].append(" ")
                continue
            block = x.name in BLOCKS
            if block:
                blocks.append([])
                stack.append((None, read))
            stack += [(c, read) for c in reversed(x.children)]
    text = (_SPACE.sub(" ", "".join(b)).strip() for b in blocks)
    return "\n\n".join(t for t in text if t)


def _has_body(root: Element, template) -> bool:
    """Whether some text outside headings is left of a page without the template."""
    heads = {id(x): x.name for x in _walk(root) if x.name in HEADINGS}
    for x in _walk(root):
        if any(type(c) is str and not c.isspace() for c in x.children) and not any(id(y) in heads or _unwanted(y) or y.hash in template for y in _up(x)):
            return True
    return False


def _up(x: Element | None) -> Iterator[Element]:
    while x is not None:
        yield x
        x = x.parent


def host_of(url: str | None) -> str:
    """The host of a URL, lower-cased; empty if there is none."""
    try:
        return urlsplit(url or "").hostname or ""
    except ValueError:
        return ""


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def template_subtrees(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, hash) of subtrees that stand on many pages of their host. A null URL is the host ''.

    Pages of a host with the same main text, digits made equal, are one page: a subtree counts once for all of them.
    Counts are partial aggregations of different pages, so no task gathers a host.
    """
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: set[tuple[str, int, int]] = set()
            for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                host = host_of(url)
                root = parse(page or "")
                own = {_signed(x.hash) for x in hash_subtrees(root)} | {0}  # 0 counts the pages
                content = _signed(xxh64_intdigest(_DIGITS.sub("0", main_text(root))))
                counts |= {(host, h, content) for h in own}
            if counts:
                hosts, hashes, contents = zip(*counts, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(hashes, pa.int64()), pa.array(contents, pa.int64())], names=["host", "hash", "content"])

    different = pages.select("url", "html").mapInArrow(tidied(run), "host string, hash long, content long").distinct()
    counted = written(different.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages), "subtrees")
    all_ = counted.where("hash = 0").select("host", F.col("pages").alias("of"))
    return counted.where("hash != 0").join(all_, "host").where(F.col("pages") >= min_share * F.col("of")).select("host", "hash")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html), by two passes over the pages.

    A null or empty page has an empty text; repeated rows come back as often, and count as pages of their host. Other
    columns are ignored. Up to `broadcast_rows` template subtrees go to all executors; more are joined to pages by host.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", "html")
    template = written(template_subtrees(rows, min_pages, min_share), "templates")
    schema = "page_id long, url string, text string, n_chars long"

    def run(shared):
        def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value if shared is not None else {}
            for b in batches:
                out = []
                own = b.column(3).to_pylist() if b.num_columns > 3 else [None] * b.num_rows
                for url, page, mine in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), own, strict=True):
                    root = parse(page or "")
                    there = mine if mine is not None else known.get(host_of(url))
                    if there:
                        able = {id(x) for x in hash_subtrees(root)}
                        for x in _walk(root):
                            x.hash = _signed(x.hash) if id(x) in able else None
                    # a page of which nothing would be left but headings isn't a template
                    text = main_text(root, set(there) if there else frozenset())
                    if there and not _has_body(root, there):
                        text = main_text(root)
                    out.append(text)
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return texts

    if template.count() <= broadcast_rows:
        known: dict[str, list] = {}
        for b in template.toArrow().to_batches():
            for host, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                known.setdefault(host, []).append(h)
        shared = spark.sparkContext.broadcast(known)
        return rows.mapInArrow(tidied(run(shared)), schema)
    # a host's templates are few: each stands on a share of its pages. Written, so that a large host's pages can be split in the join
    by_host = written(template.groupBy("host").agg(F.collect_set("hash").alias("template")), "hosts")
    host = F.udf(host_of, "string", useArrow=True)
    return rows.withColumn("host", host("url")).join(by_host, "host", "left").select("page_id", "url", "html", F.coalesce("template", F.array().cast("array<long>")).alias("template")).mapInArrow(tidied(run(None)), schema)


def op7_site_templates(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spread(table(spark, sf_dir, "pages")))
