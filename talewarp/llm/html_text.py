"""Main-text extraction (op 6) by line-block distribution.

Markup is stripped into lines, one per block of the page. Elements that are never
article text (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, comments by readers) are known by tag, role, or a name in their class and id;
empty lines stand for them, more than a window holds. A name tells such an element only
as a whole (``sidebar``, ``comments``), as the last part of it (``site-footer``), or as
the first part before a word for a box (``comment-list``), never as a part of the state
of a wrapper (``has-sidebar``, ``comments-open``); in a marked article only names of adverts tell
something of paragraphs, headings and quotations. An element that would be left out by its name, but
holds nearly all of the page's text, or its articles and most of the text, is a wrapper
and stays. Where the page marks an ``article`` or ``main`` element with text, lines
outside it count as empty too.

A line weighs the length of its text; one with links weighs as many letters and digits as
stand beside them, unless it is a heading.
Weights are summed over windows of ``WINDOW`` lines. A surge point is a line where the
sum of the window that it begins rises over a floor, a dive point is where it falls to
the floor or below, and the text between them is kept, with headings and paragraphs right
before it. The floor is ``SURGE`` of the
page's highest sum; in a marked article it is nothing, so that short lines stay. So
menus, link lists inside a marked article, copyright lines and stray lines go, while a
paragraph that is one link, between others, stays. Paragraphs beside kept ones, in the
same parent, are kept as well: a short closing paragraph after a menu isn't a stray
line. A marked article of links alone is kept whole.

The scanner reads each character a bounded number of times, however broken the markup.
Reading stops nowhere early and text is neither dropped nor capped by length. Unclosed
elements end with their parent, and those that are never closed where an article
begins. A tag that is cut off by the page's end is left out.

Defined results: null or empty html, and pages without main text, give an empty string
and 0 characters; repeated rows give repeated results; ids and urls may be null; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, map_batches

WINDOW, SURGE = 3, 0.1
SLICE_BYTES = 4 << 20

#: Elements of HTML by their part in a page.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("nav header footer aside form script style noscript template svg math iframe object canvas audio video select button textarea title head menu dialog input option datalist map".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
ARTICLE = frozenset("article main".split())
#: A block that starts ends an open one of these; a paragraph ends at any block.
ENDED_BY_ITS_LIKE = frozenset("li dt dd td th tr option".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
WORDS = frozenset("ad ads adv advert advertisement adverts advertising adsense banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay pagination paywall popup promo promoted promotion related replies reply respond rss search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split())
#: Last parts of names that make a box of what their first part names, and parts that tell a state.
BOXES = frozenset("area bar bars block blocks body bottom box buttons buttonset card column container content footer form group header inner item items left link links list menu navigation panel right row section sections slot strip title top unit units widget wrap wrapper zone".split())
STATES = frozenset("active closed disabled enabled free hide hidden less no none not off on open show shown visible with without has is js".split())
#: Elements of running text, of whose names only those of adverts tell something within a marked article; and headings.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt figcaption figure b i em strong span a code td th tr table".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertising promo promoted sponsor sponsored".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A region begins earlier by such lines right before it.
LEADS = HEADINGS | {"p"}
#: Shares of a page's text that an element holds which is a wrapper whatever its name, and one that also holds all articles.
NEARLY_ALL, MOST = 0.9, 0.5
#: Class names of an ``article`` that is a reader's comment or a teaser.
OTHER_ARTICLES = re.compile(r"(?:comment|reply|related|promo|teaser|sponsored)(?:-(?:body|item|content|entry|card|post|article|wrapper))?")

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE = re.compile(r"=\s*([\"'])")
_ATTRIBUTE = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")
_MARKS = re.compile(r"[\W_]+")


class Line(NamedTuple):
    """A block's text, its length (with links: the letters and digits beside them), whether it lies in a marked article, and its element's parent and name."""

    text: str
    weight: int
    inside: bool
    place: tuple[int, str]


_EMPTY = Line("", 0, False, (-1, ""))


@lru_cache(maxsize=64)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I)


def _attributes(text: str) -> Iterator[tuple[str, str]]:
    for name, value in _ATTRIBUTE.findall(text):
        yield name.lower(), value[1:-1] if value[:1] in ("'", '"') else value


def _names_boilerplate(name: str) -> bool:
    """Whether one class name or id names what isn't article text."""
    if name.lower() in WORDS:
        return True
    parts = [x for x in _SPLIT.split(_CAMEL.sub("-", name).lower()) if x]
    if len(parts) < 2 or not STATES.isdisjoint((parts[0], parts[-1])):
        return False
    return parts[-1] in WORDS or (parts[0] in WORDS and parts[-1] in BOXES)


def _never(tag: str, attributes: str, in_article: bool) -> str:
    """Tells an element that isn't article text: ``part`` by its tag, role or state, ``name`` by class or id, else empty."""
    if tag in NEVER and not (in_article and tag == "header"):
        return "part"
    if not attributes or tag in ("html", "body"):
        return ""
    for name, value in _attributes(attributes):
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return "part"
        if name == "role" and value.lower() in ROLES:
            return "part"
        if name in ("class", "id"):
            if tag in ARTICLE:
                if any(OTHER_ARTICLES.fullmatch(x) for x in value.lower().split()):
                    return "part"
            elif in_article and tag in RUNNING:
                if not ADVERTS.isdisjoint(value.lower().split()):
                    return "name"
            elif any(map(_names_boilerplate, value.split())):
                return "name"
    return ""


class _Scanner:
    """Tags of a page in order; a search that found nothing isn't made again."""

    def __init__(self, page: str):
        self.page, self.gone, self.last = page, set(), {}

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def end_of_tag(self, at: int) -> int:
        """Where the tag closes whose attributes start at a place: at the first ``>`` outside a quoted value."""
        page, at_first = self.page, self.find(">", at)
        end = at_first
        while end >= 0 and (value := _QUOTE.search(page, at, end)):
            shut = self.find(value[1], value.end())
            if shut < 0:
                break  # the quote isn't closed, so it is none
            if shut > end:
                end = page.find(">", shut) if ">" not in self.gone else -1
            at = shut + 1
        return end if end >= 0 else at_first

    def closes_after(self, tag: str, at: int) -> bool:
        if tag not in self.last:
            self.last[tag] = max((m.start() for m in _closing(tag).finditer(self.page)), default=-1)
        return self.last[tag] >= at


def lines(page: str) -> list[Line]:
    """The blocks of a page in order, with empty lines where other matter stood."""
    out, named, whole, articles = _scanned(page, frozenset())
    # an element that holds nearly everything is a wrapper, whatever its name
    wrappers = {number for number, held, inside in named if held and (held >= NEARLY_ALL * whole or (articles and inside == articles and held >= MOST * whole))}
    return _scanned(page, frozenset(wrappers))[0] if wrappers else out


def _scanned(page: str, wrappers: frozenset[int]) -> tuple[list[Line], list[tuple[int, int, int]], int, int]:
    """Lines; number, text and articles of each element that its name leaves out; text and articles of the page.

    Text is counted without links, scripts and the like. ``wrappers`` are left in by number.
    """
    out: list[Line] = []
    named: list[tuple[int, int, int]] = []
    open_named: list[tuple[int, int, int, int]] = []  # depth, number, and what came before
    seen = marks = anchors = 0
    text: list[str] = []
    linked: list[str] = []
    plain: list[str] = []
    stack: list[str] = []
    numbers: list[int] = []  # of the elements on the stack
    blocks: list[int] = []  # depths of the block elements on the stack
    opened: Counter[str] = Counter()
    skip: int | None = None  # depth of the element that is left out
    articles = links = element = 0
    scan = _Scanner(page)

    def flush() -> None:
        whole = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        if whole:
            heading = bool(blocks) and stack[blocks[-1]] in HEADINGS
            weight = len(whole) if heading or not linked else len(_MARKS.sub("", html.unescape("".join(plain))))
            place = (numbers[blocks[-2]] if len(blocks) > 1 else 0, stack[blocks[-1]]) if blocks else (0, "")
            out.append(Line(whole, weight, articles > 0, place))
        text.clear()
        linked.clear()
        plain.clear()

    def leave(depth: int) -> None:
        nonlocal skip, articles, links, anchors
        while len(stack) > depth:
            tag = stack[-1]
            anchors -= tag == "a"
            if open_named and open_named[-1][0] == len(stack) - 1:
                _, number, text_before, marks_before = open_named.pop()
                named.append((number, seen - text_before, marks - marks_before))
            if tag in ARTICLE and skip is None:
                flush()
                articles -= 1
            elif tag == "a" and skip is None:
                links -= 1
            stack.pop()
            numbers.pop()
            opened[tag] -= 1
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            if skip is not None and len(stack) <= skip:
                skip = None
                out.extend([_EMPTY] * WINDOW)

    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start < 0:
            start = end
        if start > at and not anchors:
            seen += len(page[at:start].strip())
        if start > at and skip is None:
            text.append(page[at:start])
            (linked if links > 0 else plain).append(page[at:start])
        if start == end:
            break
        after = page[start + 1 : start + 2]
        if after in ("!", "?"):
            comment = page.startswith("<!--", start)
            shut = scan.find("-->" if comment else ">", start + 2)
            at = end if shut < 0 else shut + (3 if comment else 1)
            continue
        name = _NAME.match(page, start + (2 if after == "/" else 1))
        if not name:
            if skip is None:
                text.append("<")
            at = start + 1
            continue
        shut = scan.end_of_tag(name.end())
        if shut < 0:
            break  # cut off
        tag, attributes, at = name[0].lower(), page[name.end() : shut], shut + 1
        block = tag in BLOCKS
        if block and skip is None:
            flush()
        if after == "/":
            if opened[tag] > 0:
                leave(len(stack) - 1 - stack[::-1].index(tag))
            continue
        if skip is not None and ((stack[skip] == "head" and tag not in IN_HEAD) or (tag in ARTICLE and not scan.closes_after(stack[skip], at))):
            leave(skip)
        if block and blocks and (stack[blocks[-1]] == "p" or (tag in ENDED_BY_ITS_LIKE and stack[blocks[-1]] == tag)):
            leave(blocks[-1])
        if tag in VOID or attributes.endswith("/"):
            continue
        element += 1
        if block:
            blocks.append(len(stack))
        stack.append(tag)
        numbers.append(element)
        opened[tag] += 1
        anchors += tag == "a"
        marks += tag in ARTICLE
        why = _never(tag, attributes, articles > 0)
        if why == "name":
            open_named.append((len(stack) - 1, element, seen, marks))
        if skip is None:
            if why == "part" or (why and element not in wrappers):
                flush()
                skip = len(stack) - 1
            elif tag in ARTICLE:
                articles += 1
            elif tag == "a":
                links += 1
        if tag in RAW:
            found = _closing(tag).search(page, at)
            at = found.end() if found else end
            leave(len(stack) - 1)
    if skip is None:
        flush()
    leave(0)
    return out, named, seen, marks


def window_sums(weights: list[int], window: int = WINDOW) -> list[int]:
    """For each line the weight of the ``window`` lines that it begins."""
    ahead, sums = sum(weights[:window]), []
    for i, weight in enumerate(weights):
        sums.append(ahead)
        ahead += (weights[i + window] if i + window < len(weights) else 0) - weight
    return sums


def regions(weights: list[int], window: int = WINDOW, floor: float = 0) -> list[tuple[int, int, int]]:
    """Surge and dive points and the highest window sum between them.

    A region starts at a line with weight, where the sum rises over ``floor``, and ends
    after its last line with weight before the sum of the next ``window`` lines isn't over it.
    """
    sums = window_sums(weights, window)
    out, start, last, peak = [], None, 0, 0
    for i, weight in enumerate(weights):
        if start is not None and sums[i] <= floor:
            out.append((start, last + 1, peak))
            start = None
        if weight and sums[i] > floor:
            start, peak = (i, 0) if start is None else (start, peak)
            last, peak = i, max(peak, sums[i])
    if start is not None:
        out.append((start, last + 1, peak))
    return out


def main_text(page: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    """The article's blocks, joined by newlines."""
    found = lines(page or "")
    marked = any(x.inside for x in found)
    usable = [x.text != "" and (x.inside or not marked) for x in found]
    weights = [x.weight if ok else 0 for x, ok in zip(found, usable, strict=True)]
    if marked and not any(weights):
        return "\n".join(x.text for x, ok in zip(found, usable, strict=True) if ok)
    floor = 0 if marked else surge * max(window_sums(weights, window), default=0)
    kept = {i for a, b, _ in regions(weights, window, floor) for i in range(a, b)}
    for i in range(len(found) - 2, -1, -1):
        if i + 1 in kept and weights[i] and found[i].place[1] in LEADS:
            kept.add(i)
    beside = {found[i].place for i in kept if weights[i] and found[i].place[1] == "p"}
    return "\n".join(x.text for i, x in enumerate(found) if usable[i] and (i in kept or x.place in beside))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "html", SLICE_BYTES):
                texts = [main_text(p) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.select("page_id").schema[0].dataType.simpleString()
    source = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(source, run, f"page_id {kind}, url string, text string, n_chars long")
