"""Main text of web pages by tag-path ratios.

A page is read as blocks: runs of text between block-level tags, each with its root-to-leaf path of block-level elements
(an element's first class belongs to its name). Per path, text length and punctuation are summed and divided by the number
of blocks with that path; link text counts for nothing. Both series are smoothed over the page's blocks with a short
Gaussian, fused by multiplication and compared with THRESHOLD of their mean, weighted by length. All blocks of the page take part.

A path's score also has a factor for what its elements say of themselves: RAISED in an article or main; HINTED where a tag, class, id
or role says menu, footer, advert and the like (HINTED_TAGS, HINTS), WEAKLY for words that sections of an article have too (WEAK_HINTS). These
are factors of a score and not verdicts. Hints of an element that holds most of the page's score are void (a layout class such as no-sidebar, a form
around the page); a menu or footer that does is all there is, and no article. Reader comments are prose like the article, which no ratio can tell;
COMMENTS leaves them out (not an element with nearly all of the score).

The paths that pass mark the content nodes, and content nodes stay wherever they are. Of the other blocks those stay that
stand in the container of nearly all (HELD) of the content's score: the deepest such element, or the article or main around it. So a title,
a short list or a caption is not lost for its length. There, hinted blocks go; outside an article or main, links too, but
only before the first content node (not its headings) and after the last one, up to the first block that is neither.

Pages are independent: a map over Arrow batches without a shuffle. One page is held at a time, and time and memory grow with its length,
whatever is nested or left open.

Defined cases: null and empty html give an empty text; unclosed and stray tags are repaired as browsers do for the
common cases; repeated rows and null ids each get a row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from objekta.llm.common import table

#: Share of the mean fused score that a content path has at least.
THRESHOLD = 0.3
#: Share of the content score that the container holds at least, and of all scores that a layout element does.
HELD = 0.95
LAYOUT = 0.5
#: What hints leave of a path's score, and how an article or main raises it. Factors and no verdicts: text that scores high enough stays all the same.
HINTED = 0.15
WEAKLY = 0.6
RAISED = 4.0
KERNEL = (0.1, 0.8, 0.1)

# Element names of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to the end tag, or to the page's end.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: They are skipped up to their own end tag; where it is missing, only the tag is.
SKIPPED = frozenset("noscript template svg select canvas audio video object".split())
BLOCK = frozenset(
    "html body head article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption"
    " blockquote pre figure figcaption address nav header footer aside form fieldset details summary dialog menu center hgroup".split()
)
CLOSES_P = BLOCK - {"html", "body", "head", "td", "th", "tr", "thead", "tbody", "tfoot", "caption"} | {"hr"}
#: An opening tag of the key closes these open elements, up to the given limits.
SAME = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
CONTENT = frozenset(["article", "main"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
CONTAINERS = frozenset("html body article main section div td table tbody tr center".split())
HINTED_TAGS = frozenset("nav footer aside form menu dialog button label".split())
#: Words of class, id and role, compared with whole words of the attribute.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo breadcrumb breadcrumbs nav navbar navigation menu"
    " header masthead topbar banner footer bottombar sidebar aside widget widgets cookie cookies consent gdpr popup modal overlay"
    " newsletter subscribe signup login share sharing social pagination pager contentinfo complementary".split()
)
WEAK_HINTS = frozenset("side rail foot notice notices alert promotion form search skip related recommended recommendations tags copyright legal disclaimer".split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply".split())

_QUOTED = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_QUOTED})>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|[^<]+|<", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"""[.,;:!?…。，、！？；：]""")


def _hint(attributes: str) -> tuple[str, set[str]]:
    """First class, and the words of class, id and role."""
    first, words = "", set()
    for kind, value in _NAMES.findall(attributes):
        value = value.strip("\"'").lower()
        if kind.lower() == "class" and not first:
            first = value.split(" ")[0]
        words.update(_WORD.findall(value))
    return first, words


_GROUPS = tuple(dict.fromkeys(SAME.values()))
_GROUP_OF = {name: _GROUPS.index(v) for name, v in SAME.items()}


class _Element:
    __slots__ = ("name", "path", "parent", "depth", "inner", "factor", "comments", "p_at", "same_at", "score", "content", "inside")

    def __init__(self, name: str, path: int, parent: _Element | None):
        self.name, self.path, self.parent, self.score, self.content, self.inside = name, path, parent, 0.0, 0.0, False
        self.depth = parent.depth + 1 if parent else 0
        self.inner = name in CONTENT or (parent is not None and parent.inner)
        self.factor, self.comments = 1.0, False
        #: Depth of the open p that a block would close, and of the elements of each group of SAME.
        self.p_at = self.depth if name == "p" else parent.p_at if parent and name in HEADINGS else -1
        if parent is None:
            self.same_at = (-1,) * len(_GROUPS)
        elif name in _NAMED:
            self.same_at = tuple(self.depth if name in these else -1 if name in limits else parent.same_at[g] for g, (these, limits) in enumerate(_GROUPS))
        else:
            self.same_at = parent.same_at


_NAMED = frozenset().union(*(x for pair in _GROUPS for x in pair))


class _Block:
    __slots__ = ("element", "text", "linked", "score")

    def __init__(self, element: _Element, text: str, linked: int):
        self.element, self.text, self.linked, self.score = element, text, linked, 0.0

    def mostly_links(self) -> bool:
        return self.linked * 2 >= len(self.text)


def _ends(html: str, at: int, name: str) -> dict[int, int]:
    """For opening tags from a place on that have an end tag of their own: where they start, and where that ends."""
    found, open_tags = {}, []
    for m in re.finditer(rf"<!--.*?(?:-->|\Z)|<(/?){name}(?=[\s/>])(?:({_QUOTED})|([^>]*))>", html[at : html.rfind(">") + 1], re.S | re.I):
        if m[1]:
            if open_tags:
                found[open_tags.pop()] = at + m.end()
        elif m[1] is not None and not (m[2] or m[3] or "").endswith("/"):
            open_tags.append(at + m.start())
    return found


def _own_hints(element: _Element, words: set[str]) -> None:
    """What the element's own tag and attributes say; the rest is inherited when all scores are known."""
    name = element.name
    if name in ("html", "body", "main") or name in HEADINGS:
        words = set()
    if element.inner:
        words = words - {"header"}
    element.comments = not COMMENTS.isdisjoint(words)
    tag = name in HINTED_TAGS or (name == "header" and not element.inner)
    if tag or not HINTS.isdisjoint(words):
        element.factor = HINTED
    elif not WEAK_HINTS.isdisjoint(words):
        element.factor = WEAKLY


def blocks(html: str) -> tuple[list[_Block], list[_Element]]:
    """The page's blocks and block-level elements in order, boilerplate included."""
    root = _Element("#", 0, None)
    stack, elements, out, text, paths, open_at = [root], [root], [], [], {}, {}
    link_depth, linked, at, size, ends, last_tag = 0, 0, 0, len(html), {}, html.rfind(">")

    def flush():
        nonlocal linked
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                out.append(_Block(stack[-1], joined, linked))
            text.clear()
        linked = 0

    def close(depth: int):
        nonlocal link_depth
        flush()
        for e in stack[depth:]:
            open_at[e.name].pop()
        del stack[depth:]
        link_depth = 0

    while at < size:
        if at > last_tag:  # no tag ends from here on
            text.append(html[at:])
            break
        m = _TOKEN.match(html, at)
        start, at = at, m.end()
        token = m[0]
        name = m[2] or m[5]
        if name is None:
            if token[0] == "<" and len(token) > 1:
                continue
            text.append(token)
            if link_depth:
                linked += len(token.strip())
            continue
        name = name.lower()
        if m[1] or m[4]:
            if name in BLOCK:
                if open_at.get(name):
                    close(open_at[name][-1])
            elif name == "a" and link_depth:
                link_depth -= 1
            continue
        attributes = m[3] or m[6] or ""
        if name in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            end = html.find(">", end.end()) if end else -1
            at = end + 1 if end >= 0 else size
            continue
        if name in SKIPPED and not attributes.endswith("/"):
            if name not in ends:
                ends[name] = _ends(html, start, name)
            at = ends[name].get(start, at)
            continue
        if name == "br" or name == "hr":
            text.append(" ")
        if name == "a":
            link_depth += 1
        if name in CLOSES_P and stack[-1].p_at > 0:
            close(stack[-1].p_at)
        if name in _GROUP_OF:
            while (depth := stack[-1].same_at[_GROUP_OF[name]]) > 0:
                close(depth)
        if name in BLOCK and name not in VOID:
            flush()
            link_depth = 0
            above = stack[-1]
            first, words = _hint(attributes) if attributes else ("", set())
            path = paths.setdefault((above.path, name, first), len(paths) + 1)
            element = _Element(name, path, above)
            _own_hints(element, words)
            open_at.setdefault(name, []).append(element.depth)
            stack.append(element)
            elements.append(element)
    flush()
    return [b for b in out if b.element.name != "head"], elements


def _smooth(values: list[float]) -> list[float]:
    last = len(values) - 1
    return [sum(w * values[min(last, max(0, i + k - 1))] for k, w in enumerate(KERNEL)) for i in range(len(values))]


def ratios(some: list[_Block]) -> None:
    """Length and punctuation per path, smoothed over the page and fused."""
    chars, marks, count = {}, {}, {}
    for b in some:
        p = b.element.path
        count[p] = count.get(p, 0) + 1
        chars[p] = chars.get(p, 0) + max(0, len(b.text) - b.linked)
        marks[p] = marks.get(p, 0) + len(_PUNCTUATION.findall(b.text)) * (not b.mostly_links())
    length = _smooth([chars[b.element.path] / count[b.element.path] for b in some])
    marks = _smooth([marks[b.element.path] / count[b.element.path] for b in some])
    for b, x, y in zip(some, length, marks, strict=True):
        b.score = x * (1 + y)


def _inherit(some: list[_Block], elements: list[_Element]) -> None:
    """Hints go down to what is inside, but those of a layout around most of the page's score."""
    total = 0.0
    for b in some:
        total += b.score * len(b.text)
        b.element.score += b.score * len(b.text)
    for e in reversed(elements[1:]):
        e.parent.score += e.score
    for e in elements[1:]:
        e.comments = e.comments and e.score < HELD * total
        if e.score > LAYOUT * total:
            e.factor = 0.0 if e.name in HINTED_TAGS and e.name != "form" else 1.0
        e.factor, e.comments = min(e.factor, e.parent.factor), e.comments or e.parent.comments


def scores(some: list[_Block], elements: list[_Element]) -> None:
    """Ratios of the blocks' paths, times the factors of their elements."""
    ratios(some)
    _inherit(some, elements)
    for b in some:
        b.score *= b.element.factor * (RAISED if b.element.inner else 1.0)


def select(some: list[_Block], elements: list[_Element]) -> list[_Block]:
    """The blocks of the article."""
    scores(some, elements)
    bar = THRESHOLD * sum(b.score * len(b.text) for b in some) / sum(len(b.text) for b in some)
    passes = [b.score >= bar and b.score > 0 and not b.element.comments and not b.mostly_links() for b in some]
    if True not in passes:
        return []
    total = 0.0
    for b, ok in zip(some, passes, strict=True):
        if ok:
            total += b.score * len(b.text)
            b.element.content += b.score * len(b.text)
    for e in reversed(elements[1:]):
        e.parent.content += e.content
    container = max((e for e in elements if e.content >= HELD * total and (e.name in CONTAINERS or e.parent is None)), key=lambda e: e.depth)
    semantic = container
    while semantic is not None and semantic.name not in CONTENT:
        semantic = semantic.parent
    container = semantic or container
    for e in elements:
        e.inside = e is container or (e.parent is not None and e.parent.inside)
    stays = [b.element.inside and b.element.factor == 1.0 and not b.element.comments for b in some]
    start, stop = 0, len(some)
    if semantic is None:
        first, last = passes.index(True), len(passes) - 1 - passes[::-1].index(True)
        while first and some[first - 1].element.inside and some[first - 1].element.name in HEADINGS:
            first -= 1
        while start < first and (not stays[start] or some[start].mostly_links()):
            start += 1
        while stop - 1 > last and (not stays[stop - 1] or some[stop - 1].mostly_links()):
            stop -= 1
    return [b for i, b in enumerate(some) if passes[i] or (stays[i] and start <= i < stop)]


def main_text(html: str | None) -> str:
    some, elements = blocks(html or "")
    return " ".join(b.text for b in select(some, elements)) if some else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    return pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
