import html
import re

import pytest

from guardlake.llm import html_text
from guardlake.llm.common import table


def test_articles_of_the_table(spark, data):
    """These pages hold one plain article element each, so a pattern reads it off."""
    pages = table(spark, data, "pages")
    want = {}
    for r in pages.collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        inner = re.sub(r"</?(?:p|h1|br)>", " ", inner).replace("<b>", "").replace("</b>", "")
        want[r.page_id] = " ".join(html.unescape(inner).split())
    assert {r.id: r.text for r in html_text.extract(pages).collect()} == want


LONG = "A plain sentence of the article goes on for a while here. " * 8


@pytest.mark.parametrize("source, want", [
    (None, ""), ("", ""), ("plain &lt;text&gt; &amp; more", "plain <text> & more"),
    ("<p>one<br>two</p>three<b>f</b>our", "one two threefour"),
    ("<html><head><title>t</title><body><nav><a href=1>m</a></nav><article><header><h1>H</h1></header><p>x&nbsp;y<p>z"
     "<aside>q</aside><form>f</form><div class='reader-comments'>c</div></article><footer>z</footer>", "H x y z"),
    ("<main><p>a<script>if (1 < 2) '</p>'</script>b<style>p{}</style><!-- <p>no</p> -->c</p></main>", "abc"),
    (f"<body class='has-sidebar'><div id=sidebar><p>{LONG}</p></div><div><h2>T</h2><p>{LONG}</p><p>{LONG}</p></div></body>",
     " ".join(f"T {LONG} {LONG}".split())),
    (f"<div><ul>{''.join(f'<li><a href=/{i}>link {i}</a>' for i in range(30))}</ul></div><div><p>{LONG}</p><p>{LONG}</p></div>",
     " ".join(f"{LONG} {LONG}".split())),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<p title='a>b' hidden>no</p><p>yes</p>", "yes"),
    ("<div>" * 3000 + "deep", "deep"), ("a < b and <3 c", "a < b and <3 c"), ("<!-- never closed <p>x", ""),
])
def test_pages(source, want):
    assert html_text.main_text(source or "") == want


SHORT = "A short note by a reader of the page. " * 2
LINKS = "".join(f"<li><a href=/{i}>link {i}</a>" for i in range(30))


@pytest.mark.parametrize("begin, end", [
    ("<div class='content-sidebar-wrap'><main>", "</main></div>"), ("<div class='sidebar-right'><main>", "</main></div>"),
    ("<div class='content-sidebar-wrap'><article>", "</article></div>"), ("<div class='content-sidebar-wrap'><div>", "</div></div>"),
    ("<article class='comments-open'>", "</article>"), ("<article class='comments'>", "</article>"),
    ("<form id='aspnetForm'>", "</form>"), ("<form id='aspnetForm'><div><article>", "</article></div></form>"),
    ("<form><div class='sidebar-right'><div role=main class='widget'>", "</div></div></form>"),
])
def test_wrappers_with_names_hold_the_article(begin, end):
    body = f"<p>{LONG}</p><p>{LONG}</p><form>Search <input></form><div class='share'>Share this</div>"
    source = f"<body><nav>{LINKS}</nav>{begin}{body}{end}<div class='sidebar'>{SHORT}</div><ul>{LINKS}</ul></body>"
    assert html_text.main_text(source) == " ".join(f"{LONG} {LONG}".split())


@pytest.mark.parametrize("other", [
    f"<div id='comments'>{f'<article class=comment><p>{LONG}</p></article>' * 9}</div>", f"<div class='reader-comments'><p>{LONG}</p></div>",
    f"<div class='related-posts'>{f'<article><p>{SHORT}</p></article>' * 9}</div>", f"<form><p>{SHORT}</p></form>",
])
@pytest.mark.parametrize("tag", ["div", "article", "main"])
def test_names_still_count_beside_the_article(tag, other):
    source = f"<body><{tag}><h1>T</h1><p>{LONG}</p><p>{LONG}</p></{tag}>{other}</body>"
    assert html_text.main_text(source) == " ".join(f"T {LONG} {LONG}".split())


LONGER = f"<p>{LONG}</p>" * 4


@pytest.mark.parametrize("source, want", [
    (f"<main><h1>Head</h1><p>{LONG}</p><article>{LONGER}</article><ul>{LINKS}</ul></main>", f"Head {LONG * 5}"),
    (f"<main><article><h2>A</h2>{LONGER}</article><article><h2>B</h2><p>{LONG}</p></article></main>", f"A {LONG * 4} B {LONG}"),
    (f"<div><article><h2>A</h2>{LONGER}</article><article><h2>B</h2><p>{LONG}</p></article></div>", f"A {LONG * 4} B {LONG}"),
])
def test_parts_beside_the_greatest_article(source, want):
    page = f"<body><nav>{LINKS}</nav>{source}<ul>{LINKS}</ul></body>"
    assert html_text.main_text(page) == " ".join(want.split())


@pytest.mark.parametrize("source, want", [
    (f"<body><h1>Title</h1><div class='related-content main-text'><p>{LONG}</p></div></body>", f"Title {LONG}"),
    (f"<body><div class='widget text-widget'><p>{LONG}</p></div><div class='widget text-widget'><p>{LONG * 2}</p></div></body>", LONG * 3),
    (f"<body><div><h1>Head</h1></div><div><p>{LONG}</p><p>{LONG}</p></div><div><p>Short.</p></div><ul>{LINKS}</ul></body>", f"Head {LONG * 2} Short."),
    (f"<body><div><p>{LONG}</p><p>{LONG}</p></div><div class=share><p>Share.</p></div><div><a href=x>More</a></div></body>", LONG * 2),
])
def test_blocks_of_the_article_without_an_article_element(source, want):
    assert html_text.main_text(source) == " ".join(want.split())


@pytest.mark.parametrize("source", [
    "<div>" * 180_000, "<b>x</a>" * 120_000, "<p><button>" + "<div>" * 150_000, "<table><tr><td>" * 60_000, "<li><b>" * 120_000,
    "<span>" * 150_000 + "</p>" * 100_000, "<a href='" * 100_000, "<!--" * 200_000, "<select><option>" * 60_000 + "</i>" * 60_000,
])
def test_a_megabyte_of_open_elements_takes_seconds(source):
    import time

    began = time.process_time()
    html_text.main_text(source)
    assert time.process_time() - began < 20


def test_densities_match_a_tree_walked_plainly():
    """Trees of other make, every count taken by walking the whole subtree."""
    import math
    import random
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.nodes, self.open = [], []

        def handle_starttag(self, tag, attrs):
            node = {"tag": tag, "children": [], "text": ""}
            if self.open:
                self.open[-1]["children"].append(node)
            self.open.append(node)
            self.nodes.append(node)

        def handle_endtag(self, tag):
            self.open.pop()

        def handle_data(self, data):
            self.open[-1]["text"] += data

    def walk(node):
        yield node
        for c in node["children"]:
            yield from walk(c)

    def chars(node):
        return sum(len("".join(x["text"].split())) for x in walk(node))

    def links(node, linked):
        linked = linked or node["tag"] == "a"
        return (len("".join(node["text"].split())) if linked else 0) + sum(links(c, linked) for c in node["children"])

    def density(node, linked, share):
        c, lc = chars(node), links(node, linked)
        t, lt = max(1, sum(1 for _ in walk(node)) - 1), max(1, sum(x["tag"] == "a" for x in walk(node)) - (node["tag"] == "a"))
        if not c or not share:
            return c / t
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        return max(0.0, c / t * math.log(c / max(1, lc) * t / lt) / math.log(max(base, 1.000001)))

    rng = random.Random(4)

    def made(depth):
        out = ""
        for _ in range(rng.randint(1, 4)):
            tag = rng.choice(["div", "span", "b", "a", "section"])
            inner = made(depth - 1) if depth and tag != "a" and rng.random() < 0.7 else "word " * rng.randint(0, 30)
            out += f"<{tag}>{inner}</{tag}>"
        return out

    for _ in range(60):
        source = f"<body>{made(4)}</body>"
        tree, page = Tree(), html_text.Page(source)
        tree.feed(source)
        got, total = html_text.densities(page)
        assert [n["tag"] for n in tree.nodes] == page.tag[1:]
        share = links(tree.nodes[0], False) / max(1, chars(tree.nodes[0]))
        want = {}

        def fill(node, linked):
            want[id(node)] = density(node, linked, share)
            for c in node["children"]:
                fill(c, linked or node["tag"] == "a")

        fill(tree.nodes[0], False)
        assert got[1:] == pytest.approx([want[id(n)] for n in tree.nodes])
        sums = [sum(want[id(c)] for c in n["children"]) if n["children"] else want[id(n)] for n in tree.nodes]
        assert total[1:] == pytest.approx(sums)
        _, _, best = html_text.ranked(page)
        assert total[best[page.body]] == pytest.approx(max(sums))


def test_composite_density_of_the_formula():
    page = html_text.Page("<body><div><p>abcdefghij</p><a href=x>link</a></div></body>")
    density, total = html_text.densities(page)
    at = {t: i for i, t in enumerate(page.tag)}
    assert density[at["p"]] > density[at["div"]] > density[at["a"]]
    assert total[at["div"]] == pytest.approx(density[at["p"]] + density[at["a"]])


def test_awkward_rows(awkward, nothing):
    rows = html_text.extract(awkward, "doc_id", "text").collect()
    assert len(rows) == awkward.count() and all(r.text is not None for r in rows)
    assert html_text.extract(nothing, "doc_id", "text").count() == 0
