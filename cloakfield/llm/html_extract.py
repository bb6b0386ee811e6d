"""Main-text extraction by tag-path ratios.

A page's text nodes are grouped by their path of block tags from the root.  For each path the text length
and the punctuation of its nodes are summed and divided by the number of nodes; both ratios are smoothed
over neighbouring nodes in page order and fused into one score, which link text lowers.  The paths whose
score passes a threshold decide where the content is: from the root down, the walk enters the one container
that holds most of their text, unless text that passes is left outside, and stops at the first ``article``
or ``main``.  All text of that container is content but for link-heavy paths; where no container below the
body stands out, the paths that pass are the content, with the headings beside them.

Elements that name themselves as navigation, header, footer, sidebar, notice, advert, form or comments, by
tag, class, id or role, are doubted: their paths are paths of their own whose score counts ``DOUBT`` times, or
nothing beside an ``article`` or ``main`` with text, and their text is content only where it passes all the same.  An element with most of the page's passing text is
no such part, whatever it is called, and is not doubted: a theme's wrapper, or a form around the page.  For
comments, adverts and menus most is nearly all.  A heading in the header of the content is content.

Each page is parsed within its row: a page never meets another, so partitions are the scan's own and there
is no shuffle.  Defined results: null, empty or text-free html gives the empty text; unclosed tags,
comments and scripts end with the page; repeated rows give repeated results; other columns are ignored.  Very
long and very deep pages are read once from front to end and give their whole text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from cloakfield.llm._shared import table

# fixed values: element names by role, and words that name boilerplate in a class, id or role
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics".split())
RAW = frozenset("script style noscript template iframe svg object textarea title select annotation annotation-xml".split())
BOILERPLATE = frozenset("nav footer aside form button dialog menu fieldset header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMED = frozenset(("article", "main"))
CONTAINERS = frozenset("html body article main section div td table tbody tr center form fieldset header aside".split())
_EDGE, _NOT = r"(?:^|[\s_-])", r"(?<!\bno[_-])(?<!\bhas[_-])(?<!\bwith[_-])(?<!\bwithout[_-])(?<!\bis[_-])"
HINT = re.compile(
    rf"{_EDGE}{_NOT}(?:(?P<strong>ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|nav|navbar|navigation|menu|breadcrumbs?|cookies?|consent|comments?|commentlist|replies|reply|respond|disqus|discussion)|"
    rf"(?P<header>header|masthead)|banner|promo(?:tion)?|sidebar|footer|gdpr|notices?|alert|popup|modal|newsletter|subscribe|signup|share|sharing|social|"
    rf"related|recommend(?:ed|ations)?|widget|toolbar|login|search|contentinfo|complementary)(?:$|[\s_-])",
    re.I,
)

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")
#: Elements that an opening block element closes.
CLOSED_BY_BLOCK = frozenset(("p", *HEADINGS))
#: A path passes with this part of the best score, and a container is entered with this part of its parent's.
PASS, ENTER = 0.2, 0.6
#: A path with more of its text in links than this is navigation.
LINKS = 0.5
#: What a doubted path's score counts, and the part of the page's passing text from which an element is not doubted.
DOUBT, MOST, NEARLY_ALL = 0.03, 0.5, 0.9


class _Tags:
    """Reads a page from tag to tag: (end, name, closing, attributes) from the position of a ``<``, or the end alone.

    Every search goes forward and what is not there is remembered, so a broken page is read once like any other.
    A quote that is never closed is no quote, nor is any after it.
    """

    def __init__(self, page: str):
        self.page, self.last, self.quotes, self.raw = page, page.rfind(">"), True, {}

    def at(self, i: int) -> tuple[int, str, bool, str]:
        page = self.page
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4) if self.last > i else -1
            return (end + 3 if end >= 0 else len(page)), "", False, ""
        if page.startswith(("<!", "<?"), i):
            return (page.index(">", i) + 1 if self.last > i else len(page)), "", False, ""
        m = NAME.match(page, i + 1)
        if not m or self.last < m.end():
            return i + 1, "<", False, ""
        start = k = m.end()
        while self.quotes:
            stop = STOP.search(page, k)
            if not stop:
                self.quotes = False
            elif stop[0] == ">":
                return stop.end(), m[2].lower(), bool(m[1]), page[start : stop.start()]
            else:
                k = page.find(stop[0], stop.end()) + 1
                self.quotes = k > 0
        end = page.index(">", start)
        return end + 1, m[2].lower(), bool(m[1]), page[start:end]

    def after(self, name: str, i: int) -> int:
        """Behind the closing tag of an element whose content is no text, or the end of the page."""
        if self.raw.get(name):
            return len(self.page)
        m = re.compile(rf"</{name}\s*>", re.I).search(self.page, i)
        self.raw[name] = not m
        return m.end() if m else len(self.page)


class _Page:
    """The element tree of one page, as lists by element number, and its text blocks: (element, path, text, link characters).

    Element 0 is the page.  Elements with the same tags from the root have one path number.
    """

    def __init__(self, page: str):
        self.tag, self.parent, self.path, self.away, self.named = [""], [-1], [0], [False], [False]
        #: the part of the passing text from which an element that calls itself boilerplate is not; 0 for others
        self.doubt, self.header = [0.0], [False]
        self.blocks: list[tuple[int, int, str, int]] = []
        paths: dict[tuple[int, str, float], int] = {}
        stack, open_ = [0], Counter()
        parts: list[str] = []
        links = in_link = 0
        tags, at = _Tags(page), 0

        def flush() -> None:
            nonlocal links
            text = " ".join("".join(parts).split())
            if text and not self.away[stack[-1]]:
                self.blocks.append((stack[-1], self.path[stack[-1]], text, links))
            parts.clear()
            links = 0

        def leave() -> None:
            open_[self.tag[stack.pop()]] -= 1

        while at < len(page):
            if page[at] != "<":
                end = page.find("<", at)
                end = end if end >= 0 else len(page)
                name, text = "<", page[at:end]
            else:
                end, name, closing, attributes = tags.at(at)
                text = "<"
            at = end
            if name == "<":
                if not self.away[stack[-1]]:
                    text = entities.unescape(text)
                    parts.append(text)
                    if in_link:
                        links += len(text)
                continue
            if not name:
                continue
            if name in RAW:
                if not closing and not attributes.endswith("/"):
                    at = tags.after(name, at)
                continue
            if name == "br":
                parts.append(" ")
                continue
            if name in INLINE or name in MATH:
                if name == "a":
                    in_link = int(not closing)
                continue
            flush()
            if name in VOID:
                continue
            if closing:
                while open_[name]:
                    last = self.tag[stack[-1]]
                    leave()
                    if last == name:
                        break
                continue
            in_link = 0
            while self.tag[stack[-1]] in CLOSED_BY_BLOCK:
                leave()
            last = self.tag[stack[-1]]
            if name in ("li", "dt", "dd", "tr", "td", "th", "option") and last == name or name == "body" and last == "head":
                leave()
            top = stack[-1]
            doubt, header = self._doubted(name, attributes, self.named[top])
            path = paths.setdefault((self.path[top], name, doubt), len(paths) + 1)
            self.doubt.append(doubt)
            self.header.append(header)
            self.away.append(self.away[top] or name == "head")
            self.named.append(self.named[top] or name in NAMED)
            self.tag.append(name)
            self.parent.append(top)
            self.path.append(path)
            stack.append(len(self.tag) - 1)
            open_[name] += 1
        flush()


    @staticmethod
    @lru_cache(maxsize=4096)  # pages of one site repeat their tags
    def _doubted(name: str, attributes: str, named: bool) -> tuple[float, bool]:
        """The doubt of an element, and whether it calls itself a header; the header of an article is part of it."""
        if name in NAMED or name in ("html", "body"):
            return 0.0, False
        hints = [m for a, b, c in ATTRIBUTE.findall(attributes) for m in HINT.finditer(a or b or c)]
        header = name == "header" or any(m["header"] for m in hints)
        others = [m for m in hints if not (m["header"] and named)]
        if any(m["strong"] for m in others) or name in ("nav", "menu", "button"):
            return NEARLY_ALL, header
        return (MOST if others or name in BOILERPLATE and not (name == "header" and named) else 0.0), header


def _scores(blocks: list) -> dict[int, float]:
    """The fused, smoothed score of each path."""
    chars, marks, links, count = (defaultdict(float) for _ in range(4))
    for _, path, text, link in blocks:
        chars[path] += len(text)
        marks[path] += len(PUNCTUATION.findall(text))
        links[path] += link
        count[path] += 1

    def smooth(xs: list[float]) -> list[float]:
        weights = ((-1, 0.25), (0, 0.5), (1, 0.25))
        return [sum(w * xs[i + d] for d, w in weights if 0 <= i + d < len(xs)) for i in range(len(xs))]

    length, punctuation = (smooth([of[b[1]] / count[b[1]] for b in blocks]) for of in (chars, marks))
    total: dict[int, float] = defaultdict(float)
    for b, x, y in zip(blocks, length, punctuation):
        total[b[1]] += x * (1 + y)
    return {p: total[p] / count[p] * max(0.0, 1 - links[p] / chars[p]) if links[p] <= LINKS * chars[p] else 0.0 for p in total}


def main_text(page: str | None) -> str:
    """The main text of one page."""
    tree = _Page(page or "")
    blocks = tree.blocks
    if not blocks:
        return ""
    raw = _scores(blocks)
    limit = PASS * max(raw.values())
    n = len(tree.tag)

    def masses(score: dict[int, float], limit: float) -> tuple[list[int], set[int]]:
        """The passing text of each element, and the paths that pass."""
        passes, mass = {p for p, x in score.items() if x > 0 and x >= limit}, [0] * n
        for node, path, text, _ in blocks:
            mass[node] += len(text) * (path in passes)
        for k in range(n - 1, 0, -1):  # an element's number is above its parent's
            mass[tree.parent[k]] += mass[k]
        return mass, passes

    mass, _ = masses(raw, limit)
    named = [0] * n  # text in an article or main part, which what lies beside it cannot be
    for node, _, text, _ in blocks:
        named[node] += len(text) * tree.named[node]
    for k in range(n - 1, 0, -1):
        named[tree.parent[k]] += named[k]
    doubted = [False] * n
    for k in range(1, n):
        most = mass[k] > tree.doubt[k] * mass[0] and (named[k] > 0 or not named[0])
        doubted[k] = doubted[tree.parent[k]] or tree.doubt[k] > 0 and not most
    # one path can lead to elements that are doubted and to others, which from here on have paths of their own
    blocks = [(node, 2 * path + doubted[node], text, link) for node, path, text, link in blocks]
    beside = {path for node, path, _, _ in blocks if named[0] and not tree.named[node]}
    score = {p: x * (0.0 if p in beside else DOUBT) if p % 2 else x for p, x in _scores(blocks).items()}
    best = max((x for p, x in score.items() if not p % 2), default=0.0)
    limit = PASS * (best or max(score.values()))
    mass, passes = masses(score, limit)
    holds = [t in NAMED and not doubted[k] for k, t in enumerate(tree.tag)]
    below: dict[int, int] = {}  # the container of the most content in each element
    for k in range(n - 1, 0, -1):
        up = tree.parent[k]
        holds[up] |= holds[k]
        if tree.tag[k] in CONTAINERS and (up not in below or mass[k] >= mass[below[up]]):
            below[up] = k
    region = 0
    while tree.tag[region] not in NAMED and region in below:
        best = below[region]
        if mass[best] < max(1, ENTER * mass[region]) or mass[best] < mass[region] and not holds[best]:
            break
        region = best
    inside = [False] * n
    inside[region] = True
    for k in range(region + 1, n):
        inside[k] = inside[tree.parent[k]]

    def headed(k: int) -> bool:
        """Whether all that is doubted above a heading of the content is its header."""
        while k != region and k > 0:
            if tree.doubt[k] > 0 and not tree.header[k] and doubted[k]:
                return False
            k = tree.parent[k]
        return True

    def stays(b: tuple[int, int, str, int]) -> bool:
        if tree.tag[b[0]] in HEADINGS:
            return not doubted[b[0]] or headed(b[0])
        return score[b[1]] >= max(limit, 1e-9) if doubted[b[0]] else score[b[1]] > 0

    rows = [b for b in blocks if inside[b[0]] and stays(b)]
    if tree.tag[region] in ("", "html", "body"):  # no container stands out, so paths are told apart one by one
        chosen = {b[0] for b in rows if b[1] in passes}
        parents = {tree.parent[k] for k in chosen}
        rows = [b for b in rows if b[0] in chosen or tree.tag[b[0]] in HEADINGS and tree.parent[b[0]] in parents]
    return " ".join(b[2] for b in rows)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def html_extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each page."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")


def query(spark, sf_dir):
    return html_extract(table(spark, sf_dir, "pages"))
