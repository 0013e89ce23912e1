"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from guardlake.llm.common import per_text

#: Fixed values of HTML: elements without content, with raw content, and those that begin and end a block of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes noembed".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol option p plaintext pre"
    " search section select summary table tbody td tfoot th thead title tr ul xmp".split()
)
#: Start tags that end an open paragraph, and elements that an end tag or an implied end does not reach through.
ENDS_P = BLOCK - frozenset("body br caption head html legend option tbody td tfoot th thead title tr".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
SCOPE = frozenset("html body table td th caption template object button".split())
#: Open elements that a start tag of the same group ends.
SIBLINGS = {
    **dict.fromkeys(("dd", "dt"), frozenset(("dd", "dt"))), "li": frozenset(("li",)), "option": frozenset(("option",)),
    "tr": frozenset(("tr", "td", "th")), **dict.fromkeys(("td", "th"), frozenset(("td", "th"))),
    **dict.fromkeys(("tbody", "thead", "tfoot"), frozenset(("tbody", "thead", "tfoot", "tr", "td", "th"))),
}
#: Elements, roles and name parts of what is not the article.
NOT_TEXT = frozenset(
    "aside audio button canvas datalist dialog embed footer head iframe input map menu nav noembed noframes noscript"
    " object script select style svg template textarea title video".split()
)
NOT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
NOT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent"
    " cookie cookies disclaimer disqus footer login masthead menu modal nav navbar navigation newsletter notice notices"
    " pagination pager popup promo promoted promotion related replies respond share sharing sidebar signup social sponsor"
    " sponsored subscribe toolbar widget widgets".split()
)
#: Names of what readers wrote. There may be more of it than of the article.
OF_READERS = frozenset("comment comments disqus replies respond".split())
MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*)(?:>|\Z)", re.S,
)
PART = re.compile(r"[\s_\-:]+")
#: A class that says what a page has or lacks, not what an element is.
ABOUT = re.compile(r"\b(?:has|have|with|without|no|show|hide|is)[_-]+[\w-]+|[\w-]+[_-](?:open|opened|closed|enabled|disabled)\b")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Page:
    """The nodes of a page in document order, as parallel lists; node 0 is the root.

    ``dropped`` is without the elements of ``doubtful``, which a name or a form speaks against and their content for.
    """

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.dropped, self.home = ["#root"], [-1], [False], [False]
        self.pieces: list[tuple[int, int, str]] = []  # node, blocks begun or ended before it, text
        self.named, self.rank = [0], [0]  # 1 by its name or as a form no text, 2 a name of readers; 1 article, 2 main
        self.body = self.breaks = 0
        # Depths of the open elements: by tag, of those that ends do not reach through, and of blocks.
        self.depths: dict[str, list[int]] = {}
        self.scopes, self.blocks = [0], [0]
        self._read(source)
        self.doubtful = self._doubtful() if any(self.named) else set()
        for i in range(1, len(self.tag)):
            self.dropped[i] |= self.dropped[self.parent[i]] or bool(self.named[i] and i not in self.doubtful)

    def _read(self, source: str) -> None:
        stack, at, size = [0], 0, len(source)
        while at < size:
            m = MARKUP.search(source, at)
            if m is None:
                self._text(stack[-1], source[at:])
                break
            if m.start() > at:
                self._text(stack[-1], source[at : m.start()])
            at = m.end()
            if m.group(1):
                self._end(stack, m.group(1).lower())
            elif m.group(2):
                tag = m.group(2).lower()
                node = self._start(stack, tag, m.group(3))
                if tag in RAW:
                    close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(source, at)
                    stop = close.start() if close else size
                    if not self.dropped[node]:
                        self._text(node, source[at:stop])
                    at = close.end() if close else size
                    if stack[-1] == node:
                        self._close(stack, len(stack) - 1)

    def _text(self, node: int, text: str) -> None:
        self.pieces.append((node, self.breaks, html.unescape(text)))

    def _open(self, stack: list[int], node: int) -> None:
        tag, depth = self.tag[node], len(stack)
        stack.append(node)
        self.depths.setdefault(tag, []).append(depth)
        if tag in SCOPE:
            self.scopes.append(depth)
        if tag in BLOCK:
            self.blocks.append(depth)

    def _close(self, stack: list[int], depth: int) -> None:
        """Ends the open elements from ``depth`` on."""
        blocks = len(self.blocks)
        while len(stack) > depth:
            self.depths[self.tag[stack.pop()]].pop()
        for held in (self.scopes, self.blocks):
            while held[-1] >= depth:
                held.pop()
        self.breaks += len(self.blocks) < blocks

    def _start(self, stack: list[int], tag: str, attributes: str) -> int:
        if self.tag[stack[-1]] == "head" and tag not in IN_HEAD:
            self._close(stack, len(stack) - 1)
        if tag in ENDS_P:
            self._imply(stack, frozenset(("p",)))
        if tag in SIBLINGS:
            self._imply(stack, SIBLINGS[tag], bound=("ul", "ol", "dl", "table", "select"))
        if tag in ("html", "body") and tag in self.tag:
            return self.tag.index(tag)
        self.breaks += tag in BLOCK
        node, up = len(self.tag), stack[-1]
        inside = self.home[up] or tag in ("article", "main")
        dropped, named, rank = self._unwanted(tag, attributes, inside)
        self.tag.append(tag)
        self.parent.append(up)
        self.home.append(inside or rank > 0)
        self.named.append(named)
        self.rank.append(rank)
        self.dropped.append(self.dropped[up] or dropped)
        if tag == "body":
            self.body = node
        if tag not in VOID:
            self._open(stack, node)
        return node

    def _last(self, tags) -> int:
        """The depth of the innermost open element of these tags; 0 without one."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def _imply(self, stack: list[int], tags, bound=()) -> None:
        """Ends open elements of ``tags`` (of a single tag the innermost) up to the one that bounds them."""
        if len(tags) == 1:
            depth = self._last(tags)
            if depth and depth >= max(self.scopes[-1], self._last(bound)):
                self._close(stack, depth)
            return
        stop = max(self._last(SCOPE - tags), self._last(bound))
        found = []
        for held in map(self.depths.get, tags):
            if held and held[-1] > stop:
                found.append(held[bisect_right(held, stop)])
        if found:
            self._close(stack, min(found))

    def _end(self, stack: list[int], tag: str) -> None:
        if tag in ("html", "body", "br"):
            return
        depth = self._last((tag,))
        if depth and depth >= self.scopes[-1] and (tag in BLOCK or depth >= self.blocks[-1]):
            self._close(stack, depth)

    @staticmethod
    def _unwanted(tag: str, attributes: str, inside: bool) -> tuple[bool, int, int]:
        """Whether an element is no article text, what its name says against it, and whether it is an article or main."""
        rank = {"article": 1, "main": 2}.get(tag, 0)
        named = int(tag == "form")
        if tag in NOT_TEXT or (tag == "header" and not inside):
            return True, 0, 0
        if not attributes.strip(" /\n\t\r\f"):
            return False, named, rank
        found: dict[str, str] = {}
        for name, *values in ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), html.unescape(values[0] or values[1] or values[2]).lower())
        if tag in ("html", "body"):
            return False, 0, 0
        role = found.get("role", "")
        style = found.get("style", "").replace(" ", "")
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        names = set(PART.split(ABOUT.sub(" ", found.get("class", "") + " " + found.get("id", ""))))
        unwanted = names & (NOT_NAMES if tag not in ("article", "main") else {"comment", "comments"})
        if unwanted:
            named = 2 if unwanted & OF_READERS else 1
        elif role == "form":
            named = 1
        return hidden or role in NOT_ROLES, named, rank or {"article": 1, "main": 2}.get(role, 0)

    def _doubtful(self) -> set[int]:
        """Named elements that may still hold the article.

        They hold ``main``, or an article larger than all outside such elements, or, if there is none outside, most of
        the body's text, links apart, by themselves or together with others at least a quarter as large. What has a name
        of readers needs a first heading besides, or nearly all of the text.
        """
        n, body = len(self.tag), self.body
        size, heads, hidden, under, linked = [0] * n, [False] * n, list(self.dropped), [False] * n, [False] * n
        for i in range(1, n):
            linked[i] = linked[self.parent[i]] or self.tag[i] == "a"
            hidden[i] |= hidden[self.parent[i]]
            under[i] = under[self.parent[i]] or self.named[i] > 0
        for node, _, text in self.pieces:
            if not (hidden[node] or linked[node]):
                size[node] += len("".join(text.split()))
        for i in range(n - 1, 0, -1):
            if not hidden[i]:
                up = self.parent[i]
                size[up] += size[i]
                heads[i] |= self.tag[i] == "h1"
                heads[up] |= heads[i]
        sure = lambda i: heads[i] or size[i] * 10 > size[body] * 9
        outside = max((size[i] for i in range(n) if self.rank[i] and not under[i] and not hidden[i]), default=0)
        # Size of the largest article at or below each element, and whether main is.
        article, main = [0] * n, [False] * n
        for i in range(n - 1, 0, -1):
            if not hidden[i]:
                if self.rank[i] and size[i] and (self.named[i] < 2 or sure(i)):
                    article[i] = max(article[i], size[i])
                    main[i] |= self.rank[i] == 2
                if self.named[i] < 2 or sure(i):
                    up = self.parent[i]
                    article[up] = max(article[up], article[i])
                    main[up] |= main[i]
        topmost = [i for i in range(1, n) if self.named[i] == 1 and not under[self.parent[i]] and not hidden[i]]
        largest = max((size[i] for i in topmost), default=0)
        several = {i for i in topmost if size[i] * 4 >= largest}
        if outside or sum(size[i] for i in several) * 2 <= size[body]:
            several = set()
        return several | {
            i for i in range(1, n) if self.named[i] and not hidden[i] and (self.named[i] < 2 or sure(i))
            and (main[i] or article[i] > outside or (not outside and size[i] * 2 > size[body]))
        }


def densities(page: Page) -> tuple[list[float], list[float]]:
    """Composite density of every node, and the sum of its children's (of a leaf: its own)."""
    n = len(page.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[page.parent[i]] or page.tag[i] == "a"
    for node, _, text in page.pieces:
        if not page.dropped[node]:
            size = len("".join(text.split()))
            chars[node] += size
            link_chars[node] += size if linked[node] else 0
    for i in range(n - 1, 0, -1):
        if not page.dropped[i]:
            up = page.parent[i]
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (page.tag[i] == "a")
    body_share = link_chars[page.body] / max(1, chars[page.body])
    density, total, leaf = [0.0] * n, [0.0] * n, [True] * n
    for i in range(n):
        c, t, lc, lt = chars[i], max(1, tags[i]), link_chars[i], max(1, link_tags[i])
        if c and body_share:
            base = math.log(c / max(1, c - lc) * lc + body_share * c + math.e)
            density[i] = max(0.0, c / t * math.log(c / max(1, lc) * t / lt) / math.log(max(base, 1.000001)))
        else:
            density[i] = c / t
    for i in range(n - 1, 0, -1):
        if not page.dropped[i]:
            total[page.parent[i]] += density[i]
            leaf[page.parent[i]] = False
            if leaf[i]:
                total[i] = density[i]
    return density, total


def ranked(page: Page) -> tuple[list[float], list[bool], list[int]]:
    """Density of every node, whether it is a part of the body, and the node of the greatest sum at or below it."""
    n, body = len(page.tag), page.body
    density, total = densities(page)
    inside = [False] * n
    inside[body] = True
    for i in range(body + 1, n):
        inside[i] = inside[page.parent[i]] and not page.dropped[i]
    best = [i if inside[i] else -1 for i in range(n)]
    for i in range(n - 1, body, -1):
        if inside[i]:
            up = page.parent[i]
            if total[best[i]] > total[best[up]]:
                best[up] = best[i]
    return density, inside, best


def chosen(page: Page) -> list[bool]:
    """Nodes whose text is the article's.

    Of the doubtful elements only those around or below the node of the greatest sum stay. That node sets the threshold, the least density on its path to the body. In every subtree of
    at least that density the node of the greatest sum is content. If the greatest node stands in an ``article`` or ``main``
    element, all of that element is, headings included. Outside it, what reaches the threshold in an enclosing ``main`` is
    content too, its first heading in any case, and so are sibling articles that reach it; nothing else is. Without such an
    element, the first ``h1`` before the content and plain blocks beside it (see ``beside``) are content as well.
    """
    n, body = len(page.tag), page.body
    density, inside, best = ranked(page)
    top = best[body]
    if page.doubtful:
        around, node = set(), top
        while node > 0:
            around.add(node)
            node = page.parent[node]
        below = [i == top for i in range(n)]
        for i in range(top + 1, n):
            below[i] |= below[page.parent[i]]
        gone = {i for i in page.doubtful - around if not below[i]}
        if gone:
            for i in range(1, n):
                page.dropped[i] |= page.dropped[page.parent[i]] or i in gone
            density, inside, best = ranked(page)
            top = best[body]
    root, path, home, main = top, [density[top]], -1, -1
    while root != body:
        if page.tag[root] == "main":
            main = root
        if home < 0 and page.tag[root] in ("article", "main"):
            home = root
        root = page.parent[root]
        path.append(density[root])
    content, threshold = [False] * n, min(path)
    if home >= 0:
        content[home] = True
        reached = [False] * n
        for i in range(main, n) if main not in (-1, home) else ():
            reached[i] = inside[i] and density[i] + 1e-9 >= threshold and (i == main or reached[page.parent[i]])
            if reached[i] and i != main:
                content[i if page.tag[i] == "article" else best[i]] = True
            elif inside[i] and page.tag[i] == "h1" and reached[page.parent[i]]:
                content[i] = True
        for i in range(n):
            if page.tag[i] == page.tag[home] == "article" and page.parent[i] == page.parent[home] and inside[i]:
                content[i] |= density[i] + 1e-9 >= threshold
    else:
        reached = [False] * n
        for i in range(body, n):
            reached[i] = inside[i] and density[i] + 1e-9 >= threshold and (i == body or reached[page.parent[i]])
            if reached[i]:
                content[best[i]] = True
        beside(page, content, inside)
    for i in range(1, n):
        content[i] = (content[i] or (page.parent[i] >= body and content[page.parent[i]])) and not page.dropped[i]
    return content


def beside(page: Page, content: list[bool], inside: list[bool]) -> None:
    """Adds the first ``h1`` of the body before the content, and blocks too short to be as dense as it.

    Such a block has a parent, a tag and a kind of children (headings and paragraphs, nothing else) in common with one
    that is content, and no links.
    """
    n = len(page.tag)
    plain, children = [True] * n, [False] * n
    for i in range(n - 1, 0, -1):
        children[page.parent[i]] = True
        if page.tag[i] in ("a", "form", "input", "button", "img", "ul", "table"):
            plain[i] = False
        plain[page.parent[i]] &= plain[i]
    first = next((i for i in range(n) if content[i]), n)
    told = {(page.parent[i], page.tag[i]) for i in range(n) if content[i] and page.tag[i] in ("div", "section", "p", "blockquote")}
    told |= {(page.parent[page.parent[i]], page.tag[page.parent[i]]) for i in range(1, n) if content[i] and page.tag[i] == "p" and page.parent[i] != page.body}
    words = [False] * n
    for i in range(1, n):
        if children[page.parent[i]] and page.tag[i] in ("p", "h1", "h2", "h3"):
            words[page.parent[i]] = True
    headed = any(content[i] and page.tag[i] == "h1" for i in range(n))
    for i in range(1, n):
        if not inside[i] or content[i]:
            continue
        if page.tag[i] == "h1" and i < first and not headed:
            content[i] = headed = True
        elif plain[i] and (page.parent[i], page.tag[i]) in told and (words[i] or page.tag[i] in ("p", "blockquote")):
            content[i] = True


def main_text(source: str) -> str:
    """The article of a page, its blocks in page order joined by one space."""
    page = Page(source)
    content, out, last = chosen(page), [], -1
    for node, breaks, text in page.pieces:
        if content[node]:
            out += [" ", text] if breaks != last else [text]
            last = breaks
    return " ".join("".join(out).split())


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id, text)`` per row; null or empty pages give the empty text, repeated rows are read each.

    Only the two columns are read; others may have any names. An empty table gives no rows.
    """

    def make():
        def work(ids, texts):
            return {"id": ids, "text": pa.array([main_text(t) for t in texts], pa.string())}

        return work

    return per_text(pages, id_col, html_col, "id ID_TYPE, text string", make)
