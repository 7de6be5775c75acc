"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block elements. What elements that never hold article text contain (navigation, footers,
asides, forms, hidden parts, and those whose class or id names them as adverts, notices, sidebars or comments) is set
apart: no text, and no evidence for others.

First pass, by density: blocks that are mostly links are boilerplate; long blocks with the stop-word density of prose are
article text, and so are shorter ones of twice that density; the rest, short or without known words, stay ambiguous.

Second pass: an ambiguous block inherits the label of its nearest decided neighbour, the last one before or the
first one after it in the same section (an article or main element, or what lies outside all of them). Nearness is
the number of element borders between two blocks, then the number of blocks; at equal nearness text wins. Outside of sections
the page's edge counts as boilerplate, one border more away than the block lies deep in the body. Only where
no neighbour is decided do elements count: inside an article or main element a block is text; outside it is text only if
no section has any. On a page without prose (tables, lists, an unknown language) length alone decides and is inherited; if no
block is long either, all blocks of its sections, or without sections all, that aren't links are text.

Edge cases: a null or empty page gives an empty text and 0 characters; unclosed and stray tags end at
the end of the page, an unclosed hidden inline element at the end of its block; a very long page is a batch of its own and
takes time in proportion to its blocks; repeated rows give equal rows; an empty table gives an empty result; columns
other than page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import pieces

STOP_WORDS = frozenset(
    "a an and are as at be by for from had has have he her his i in is it its not of on or she that the their they this to was were which will with you "
    "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer es für hat ich im in ist mit nach nicht noch oder sich sie sind so über um und von vor war wie wird zu zum zur "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous "
    "al como con de del el en es esta está ha la las lo los más me mi no para pero por que se si sin su sus también un una y ya".split()
)
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea canvas audio video head".split())
APART = frozenset("nav footer aside form button select menu dialog".split())
SECTION = frozenset(("article", "main"))
ROOT = frozenset(("html", "body"))
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side|menu|nav\w*|breadcrumbs?|footer|header|masthead|comments?|commentlist|replies|reactions|disqus|respond|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|widget|toolbar|pagination|pager|copyright|legal|disclaimer)(?:$|[\s_-])",
    re.I,
)
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
NAME = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
LETTERS = re.compile(r"[^\W\d_]+")
LONG, SHORT, LINKS, STOPS = 140, 50, 0.34, 0.15


class _Block:
    __slots__ = ("apart", "parts", "linked", "section", "path", "text", "label", "long")

    def __init__(self, section: int, apart: bool, path: tuple[int, ...]):
        self.section, self.apart, self.path, self.parts, self.linked = section, apart, path, [], 0


def _apart(name: str, attrs: str) -> bool:
    """Whether attributes name an element as something that isn't article text."""
    if not attrs:
        return False
    called = " ".join(x for t in NAME.findall(attrs) for x in t if x)
    return bool((called and name not in ("body", "html", "article", "main") and NAMED.search(called)) or HIDDEN.search(attrs))


def _inline_end(page: str, name: str, at: int) -> int:
    """Where an inline element that begins before ``at`` ends: after its own end tag, or before the block's."""
    depth = 1
    for m in TAG.finditer(page, at):
        other = (m[2] or m[5] or "").lower()
        if other in BLOCK:
            return m.start()
        if other == name:
            depth += -1 if m[1] or m[4] else 1
            if not depth:
                return m.end()
    return len(page)


def blocks(page: str) -> list[_Block]:
    """The non-empty blocks of a page in order."""
    found: list[_Block] = []
    stack: list[tuple[str, bool, int, int]] = []  # name, lies apart, section, number
    sections, links, number = 0, 0, 0
    block = _Block(0, False, ())

    def close():
        nonlocal block
        if block.parts:
            block.text = " ".join(html.unescape("".join(block.parts)).split())
            if block.text:
                found.append(block)
        block = _Block(stack[-1][2] if stack else 0, stack[-1][1] if stack else False, tuple(x[3] for x in stack if x[0] not in ROOT))

    def put(text: str):
        block.parts.append(text)
        if links:
            block.linked += len(text.strip())

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ends, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW:
            if not ends and not (attrs.endswith("/") and name in ("svg", "math")):
                shut = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = shut.end() if shut else (n if name != "head" else at)
            continue
        if name == "br":
            put(" ")
            continue
        if name not in BLOCK and name not in APART:
            if not ends and name not in VOID and _apart(name, attrs):
                at = _inline_end(page, name, at)
            elif name == "a":
                links = 0 if ends else 1
            continue
        links = 0
        if name == "hr":
            close()
            continue
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            close()
            continue
        if stack and stack[-1][0] in ("p", "li", "option", "dt", "dd", "td", "th", "tr") and (stack[-1][0] == "p" or stack[-1][0] == name):
            stack.pop()
        inside = stack[-1][2] if stack else 0
        apart = stack[-1][1] if stack else False
        if name in SECTION and not inside:
            sections += 1
            inside = sections
        apart = apart or name in APART or name == "title" or (name == "header" and not inside) or _apart(name, attrs)
        number += 1
        stack.append((name, apart, inside, number))
        close()
    close()
    return found


def by_density(b: _Block) -> bool | None:
    """The first pass: text, boilerplate, or None."""
    size = len(b.text)
    if b.linked > LINKS * size and size - b.linked < LONG:
        return False
    words = LETTERS.findall(b.text)
    stops = sum(w.lower() in STOP_WORDS for w in words) / len(words) if words else 0.0
    return True if (size >= LONG and stops >= STOPS) or (size >= SHORT and stops >= 2 * STOPS) else None


def _borders(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    same = 0
    for x, y in zip(a, b):
        if x != y:
            break
        same += 1
    return len(a) + len(b) - 2 * same


def by_neighbours(found: list[_Block]) -> list[bool]:
    """The second pass, over the blocks that aren't set apart."""
    labels = [b.label for b in found]
    if not any(labels):  # no prose: length alone
        labels = [True if x is None and b.long else x for x, b in zip(labels, found)]
    if not any(labels):
        sectioned = any(b.section for b in found)
        return [b.label is None and bool(b.section or not sectioned) for b in found]
    in_sections = any(b.section and x for b, x in zip(found, labels))
    decided = list(labels)
    before: list[int] = []
    last: dict[int, int] = {}
    for k, b in enumerate(found):
        before.append(last.get(b.section, -1))
        if decided[k] is not None:
            last[b.section] = k
    after: list[int] = [-1] * len(found)
    last = {}
    for k in range(len(found) - 1, -1, -1):
        after[k] = last.get(found[k].section, -1)
        if decided[k] is not None:
            last[found[k].section] = k
    for k, b in enumerate(found):
        if decided[k] is None:
            near = [(_borders(b.path, found[j].path), abs(j - k), not decided[j]) for j in (before[k], after[k]) if j >= 0]
            if near and not b.section:
                near.append((len(b.path) + 1, len(found), True))  # the page's edge
            labels[k] = not min(near)[2] if near else bool(b.section) or not in_sections
    return [bool(x) for x in labels]


def extract(page: str | None) -> str:
    """The main text of one page, its blocks joined by newlines."""
    if not page:
        return ""
    found = [b for b in blocks(page) if not b.apart]
    for b in found:
        b.label, b.long = by_density(b), len(b.text) >= LONG
    return "\n".join(b.text for b, kept in zip(found, by_neighbours(found)) if kept)


def _run(batches):
    for piece in pieces(batches, "html", 8 << 20):
        texts = [extract(x.as_py()) for x in piece.column("html")]
        yield pa.record_batch([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, its main text and that text's code points."""
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_run, "page_id long, url string, text string, n_chars long")
