"""The main text of whole tables against a plain version: subtrees compared as nested tuples, pages rendered by recursion."""

import re
from collections import defaultdict

import pytest

from quern.llm import site_templates as st


def shape(x):
    """A subtree as a value: names, marks, texts with digits made equal, and what is below."""
    return (x.name, x.marks, *(shape(c) if isinstance(c, st.Element) else re.sub(r"\d+", "0", re.sub(r"\s+", " ", c).strip()) for c in x.children))


def ancestors(x):
    while x is not None:
        yield x
        x = x.parent


def all_of(x):
    yield x
    for c in x.children:
        if isinstance(c, st.Element):
            yield from all_of(c)


def may_be_template(x, root):
    near = any(y.name in ("article", "main") for y in all_of(x)) or any(y.name in ("article", "main") for y in ancestors(x))
    return x is not root and x.name in st.BLOCKS and x.name not in ("html", "body") and not near


def text_of(root, template=frozenset()):
    """Blocks in page order, white space made one space, joined by empty lines."""

    def gone(x):
        own = any(y.name in ("article", "main") for y in ancestors(x.parent))
        if x.name in {"nav", "footer", "aside", "form", "script", "style", "button"} | st.DROPPED or x.name == "header" and not own:
            return True
        if x.name not in ("header", "html", "body", "article", "main") and x.marks:
            names = x.marks.split()
            if own and ({"comments", "ad", "advertisement", "navigation", "hidden", "sidebar"} & set(names) or (set(names) & st.MARKED) - st.OWN or any(re.match("(comments?|disqus|cookies?|newsletter|sidebar|breadcrumbs?|pagination)(?![a-z0-9])", t) for t in names)):
                return True
            if not own and set(re.split("[^a-z0-9]+", x.marks)) & st.MARKED:
                return True
        return may_be_template(x, root) and shape(x) in template

    def shown(x):
        return not any(gone(y) for y in ancestors(x) if y.name not in ("html", "body"))

    wanted = next((found for name in ("article", "main") if (found := [x for x in all_of(root) if x.name == name and not any(gone(y) for y in ancestors(x))])), None)
    out, now = [], []

    def close():
        out.append(re.sub(r"\s+", " ", "".join(now)).strip())
        now.clear()

    def render(x, read):
        if not (x.name in ("html", "body") or not gone(x)):
            return
        read = read or wanted is not None and any(x is w for w in wanted)
        if x.name == "br":
            now.append(" ")
            return
        if x.name in st.BLOCKS:
            close()
        for c in x.children:
            if isinstance(c, st.Element):
                render(c, read)
            elif read:
                now.append(c)
        if x.name in st.BLOCKS:
            close()

    render(root, wanted is None)
    close()
    return "\n\n".join(t for t in out if t)


def plain(rows):
    """The text of each (url, html)."""
    roots = [st.parse(html or "") for _, html in rows]
    hosts = [st.host_of(url) for url, _ in rows]
    pages, stands = defaultdict(set), defaultdict(set)
    for host, root in zip(hosts, roots, strict=True):
        content = re.sub(r"\d+", "0", text_of(root))
        pages[host].add(content)
        for x in all_of(root):
            if may_be_template(x, root):
                stands[host, shape(x)].add(content)
    for host, root in zip(hosts, roots, strict=True):
        template = {s for (h, s), on in stands.items() if h == host and len(on) >= 3 and len(on) >= 0.3 * len(pages[host])}
        headings = [x for x in all_of(root) if re.fullmatch("h[1-6]", x.name)]
        body = any(isinstance(c, str) and c.strip() and not any(y in headings or st._unwanted(y) or may_be_template(y, root) and shape(y) in template for y in ancestors(x)) for x in all_of(root) for c in x.children)
        yield text_of(root, template if body else frozenset())


def check(spark, rows, got):
    want = list(plain([r[1:3] for r in rows]))
    assert sorted((str(r["page_id"]), str(r["url"]), r["text"], r["n_chars"]) for r in got) == sorted((str(p), str(u), t, len(t)) for (p, u, _), t in zip(rows, want, strict=True))


def test_query_on_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    check(spark, rows, st.op7_site_templates(spark, "/root/testdata/sf0.001").collect())


@pytest.mark.parametrize("most", [100_000, 0])
def test_repeated_rows_mirrors_and_odd_pages(spark, most):
    box, menu = "<div><p>Buy at our shop 12</p></div>", "<ul><li>Home<li>News</ul>"
    page = "<html><head><title>x</title></head><body>{0}<div><h1>Title {1}</h1><p>Text {1} of the page</p></div>{2}</body></html>"
    rows = [(k, f"http://a.example/{k}", page.format(menu, c, box)) for k, c in enumerate("abcdefgh")]
    rows += [rows[0]] * 5 + [(50, "http://a.example/mirror", rows[1][2])]
    rows += [(20, "http://b.example/1", "<article><div><p>Only text</p></div></article>")] * 4
    rows += [(30 + k, "http://c.example/", page.format("", "same", "")) for k in range(6)]
    rows += [(40, None, None), (41, "", ""), (42, "http://d.example", "<div>" * 60 + "deep" + "</p>" * 3), (43, "bad://[", "<p>1 &lt; 2<br>next"), (None, "http://a.example/null", page.format(menu, "null", box)), (44, "http://e.example/", "<p>" + "long word " * 20_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = st.extract(d, broadcast_rows=most).collect()
    check(spark, rows, got)
    text = defaultdict(set)
    for r in got:
        text[r["page_id"]].add(r["text"])
    assert text[0] == {"Title a\n\nText a of the page"} and text[50] == text[1] and text[20] == {"Only text"}
    assert text[30] == {"Title same\n\nText same of the page"} and text[43] == {"1 < 2 next"}


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ('<section id="discussion"><p>What it means.</p></section>', "What it means."),
        ('<p id="search">Search for meaning.</p>', "Search for meaning."),
        ('<h2 class="side">The other side</h2>', "The other side"),
        ('<p class="hidden-gem">A gem.</p>', "A gem."),
        ('<div class="related">Related work is old.</div>', "Related work is old."),
        ('<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> be.</p>', "Let x=2 be."),
        ('<object data="f.pdf">The figure shows it.</object>', "The figure shows it."),
        ('<p class="notice alert">Notice this.</p>', "Notice this."),
        ('<div class="comment-list">first!</div><ol id="comments"><li>me too</li></ol><div class="ad">buy</div><p hidden>secret</p><div role="navigation">next</div>', ""),
    ],
)
def test_an_articles_own_words_stay(inner, text):
    page = f'<html><body><div id="search">find</div><div class="related-links">more</div><article><h1>Title</h1>{inner}</article></body></html>'
    assert st.main_text(st.parse(page)) == "\n\n".join(t for t in ("Title", text) if t)
