"""Main text of web pages by tree scoring.

A page becomes a tree of block elements. Every paragraph-like run of text earns points for its length and its commas
and passes them to its ancestors (all to the parent, half to the next, a sixth to the one above, and from there half as
many at each step); a container's points are discounted by the part of its text that stands in links. The container
with most points is the article, together with the siblings that look like parts of it.

Elements that are never the article by their tag, or are hidden, are dropped with all in them. A form, and a block whose
role or a whole word of whose class or id is foreign, is dropped too, unless it wraps the page: it has the tagged article
and none stands outside such blocks, or no tagged article stands outside and it has most of the points (a form half, a
marked block nine tenths, comments all).

Defined cases: null and empty pages give an empty text; a page cut off inside a tag, comment or script ends there;
unknown tags are inline; rows are read each by itself, so repeated rows, null ids and urls need nothing; other columns
are ignored; an empty table gives an empty result. Nothing is shuffled, and a task holds one batch of pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from keyloom.llm.common import fresh

TOKEN = re.compile(r"""<!--|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>|<[!?][^>]*>|</[^a-zA-Z][^>]*>|<(?=[a-zA-Z/!?])""")
NAMED = re.compile(r"""(class|id|role|style|aria-hidden|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))|(?<![\w-])(hidden)(?![\w-])""", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
DROPPED = RAW | frozenset("head nav header footer aside button select svg math template dialog menu object canvas audio video map fieldset".split())
BLOCKS = DROPPED | frozenset("html body main article section form div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre address figure figcaption details summary center hgroup search".split())
#: Start tags that end an open paragraph or an open element of their own kind.
ENDS_P = BLOCKS | {"hr"}
ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCE = frozenset("html body table ul ol dl article section main div td th blockquote".split())
#: Words of class and id that mark what is not the article.
FOREIGN = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
#: Of these, what readers write: it can outweigh an article.
TALK = frozenset("comment comments commentlist disqus replies reply respond".split())
FOREIGN_ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert menu menubar toolbar form".split())
#: Ways to be foreign: by tag or hidden; and, unless they wrap the page, by a form, a mark or readers' talk.
NEVER, FORM, MARKED, TALKED = 1, 2, 3, 4
#: The part of the page's points over which a foreign block is a wrapper.
WRAPS = {FORM: 0.5, MARKED: 0.9, TALKED: 0.999999}
OWN_TEXT = frozenset("p pre li dd dt td th h1 h2 h3 h4 h5 h6 summary caption figcaption address".split())
KEPT_HEADS = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre".split())


class Page:
    """Elements in order of their start: tag, parent, how foreign, whether dropped for good; and the runs of text with
    their element."""

    def __init__(self) -> None:
        self.tag, self.parent, self.foreign, self.out = ["html"], [-1], [0], [False]
        self.runs: list[tuple[int, str, int]] = []  # element, text, characters in links


def _foreign(tag: str, attrs: str) -> int:
    if tag in DROPPED:
        return NEVER
    found = FORM if tag == "form" else 0
    for m in NAMED.finditer(attrs):
        name, value = (m[1] or "hidden").lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return NEVER
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return NEVER
        if name == "role" and value in FOREIGN_ROLES:
            found = max(found, FORM if value == "form" else MARKED)
        if name in ("class", "id") and tag not in ("body", "html", "article", "main") and (marks := FOREIGN.intersection(value.split())):
            found = max(found, MARKED if marks.isdisjoint(TALK) else TALKED)
    return found


def _earned(tag: str, text: str) -> float:
    return (1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)) if len(text) >= 25 and tag[0] != "h" else 0.0


def settle(page: Page) -> None:
    """Drops the foreign blocks that do not wrap the page, and the runs in them."""
    n = len(page.tag)
    if not any(f > NEVER for f in page.foreign):
        return
    inside, full, tagged, points = [False] * n, [False] * n, [False] * n, [0.0] * n
    for i in range(n):
        inside[i] = page.foreign[i] > NEVER or (page.parent[i] >= 0 and inside[page.parent[i]])
    for e, text, _ in page.runs:
        full[e] = True
        points[e] += _earned(page.tag[e], text)
    outside = False  # whether a tagged article with text stands outside all foreign blocks
    for i in range(n - 1, -1, -1):  # children come after their parents
        if full[i] and page.tag[i] in ("article", "main"):
            tagged[i] = True
            outside = outside or not inside[i]
        if (up := page.parent[i]) >= 0:
            full[up], tagged[up] = full[up] or full[i], tagged[up] or tagged[i]
            points[up] += points[i]
    for i in range(n):
        above = page.parent[i] >= 0 and page.out[page.parent[i]]
        kind = page.foreign[i]
        wraps = not outside and (tagged[i] or points[i] > WRAPS.get(kind, 1) * points[0])
        page.out[i] = page.out[i] or above or kind > NEVER and not wraps
    page.runs = [r for r in page.runs if not page.out[r[0]]]


def parse(source: str) -> Page:
    page, stack = Page(), [0]
    held: list[str] = []
    open_: dict[str, int] = {}  # how many elements of each tag are open
    linked = link = at = 0

    def flush() -> None:
        nonlocal linked
        if held:
            if not page.out[stack[-1]] and (text := " ".join("".join(held).split())):
                page.runs.append((stack[-1], text, linked))
            held.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            held.append(text)
            if link:
                linked += len(text)

    def close(tags: tuple[str, ...], fence: frozenset[str]) -> None:
        """Ends the innermost open element of these tags and all in it, unless a fence stands before it."""
        if not any(open_.get(t) for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if (t := page.tag[stack[i]]) in tags:
                flush()
                for e in stack[i:]:
                    open_[page.tag[e]] -= 1
                del stack[i:]
                return
            if t in fence:
                return

    while at < len(source):
        m = TOKEN.search(source, at)
        if not m:
            add(source[at:])
            break
        add(source[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            end = source.find("-->", at)
            if end < 0:
                break
            at = end + 3
            continue
        if m[0] == "<":
            break  # a tag without an end
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = 0
            elif tag == "br":
                held.append(" ")
            elif tag in BLOCKS:
                close((tag,), frozenset(("td", "th", "table")) - {tag} if tag != "table" else frozenset())
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE).search(source, at)
            if not end:
                break
            at = end.end()
            continue
        if tag == "a":
            link = int("href" in m[3].lower())
        elif tag in ("br", "hr", "img"):
            held.append(" ")
        if tag in ENDS_P:
            close(("p",), FENCE)
            if tag in ENDS_SAME:
                close(ENDS_SAME[tag], frozenset(("ul", "ol", "dl", "table")))
            flush()
            if tag not in VOID:
                page.tag.append(tag)
                page.parent.append(stack[-1])
                page.foreign.append(_foreign(tag, m[3]))
                page.out.append(page.out[stack[-1]] or page.foreign[-1] == NEVER)
                stack.append(len(page.tag) - 1)
                open_[tag] = open_.get(tag, 0) + 1
                link = 0
    flush()
    settle(page)
    return page


def weighed(page: Page) -> tuple[list[float], list[int], list[int]]:
    """Points, characters and linked characters of every element, in one pass from the last element to the first."""
    n = len(page.tag)
    own, half, rest, chars, links = [0.0] * n, [0.0] * n, [0.0] * n, [0] * n, [0] * n
    for e, text, linked in page.runs:
        # A run directly in a container is a paragraph without a tag of its own; in p, li and the like it is the tag's.
        at = page.parent[e] if page.tag[e] in OWN_TEXT else e
        if at >= 0:
            own[at] += _earned(page.tag[e], text)
        chars[e] += len(text)
        links[e] += linked
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        half[up] += own[i] / 2
        rest[up] += half[i] / 3 + rest[i] / 2
        chars[up] += chars[i]
        links[up] += links[i]
    return [a + b + c for a, b, c in zip(own, half, rest)], chars, links


def extract(source: str | None) -> str:
    """The article's blocks in page order, joined by two line ends."""
    if not source:
        return ""
    page = parse(source)
    n = len(page.tag)
    points, chars, links = weighed(page)
    score = [p * (1 - k / c) if c else 0.0 for p, c, k in zip(points, chars, links)]
    best = max(range(n), key=lambda i: (score[i], chars[i] - links[i], -i)) if page.runs else 0
    if not page.runs:
        return ""
    if score[best] <= 0:  # no paragraph earned a point: the tagged article, or the fullest element without links
        tagged = [i for i in range(n) if page.tag[i] in ("article", "main") and chars[i]]
        best = tagged[0] if tagged else 0
    up = best
    while up >= 0 and page.tag[up] != "article":
        up = page.parent[up]
    best = up if up >= 0 else best
    kept = {best}
    if page.parent[best] >= 0:
        for i in range(n):
            if page.parent[i] == page.parent[best] and i != best and not page.out[i] and chars[i]:
                dense = links[i] / chars[i]
                if score[i] >= max(10, 0.2 * score[best]) or page.tag[i] == page.tag[best] == "article" and score[i] > 0 or page.tag[i] in KEPT_HEADS and dense < 0.25:
                    kept.add(i)
    inside = [False] * n
    for i in range(n):
        inside[i] = i in kept or (page.parent[i] >= 0 and inside[page.parent[i]])
    siblings_text = page.parent[best]
    return "\n\n".join(text for e, text, linked in page.runs if inside[e] or e == siblings_text and linked < 0.25 * len(text) and len(text) >= 80)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                texts = [extract(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return fresh(pages, "page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
