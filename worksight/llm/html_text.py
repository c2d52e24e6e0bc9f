"""Main text of web pages by smoothed text-to-tag ratios.

The standard library's parser streams events; block elements end lines.  A
line has its text, its number of tags, how much of it is link text, and the
elements that hold it.  Text length over number of tags is the ratio of a
line; lines inside furniture (menus, footers, adverts, ...: by element, role
or words of class and id) count 0.  Ratios are smoothed with a Gaussian over
neighbouring lines, in page order, and split by the threshold that best
separates two clusters.  Lines above it vote for the region that holds them:

* the outermost ``main`` or ``article`` elements with such lines, else
* the innermost element that holds all such lines; if that is the body or
  the page, only its part from the first to the last of them, and what
  stands beside them in the same element and is not mostly links.

All text of the region that is not furniture is kept, short lines too.

White space (Unicode) inside a block becomes one space, blocks are joined by
a line feed, character references are decoded.  ``br`` is white space inside
its block.  Null, empty and text-less pages give an empty text.  Unclosed
elements end with their parent, stray end tags and broken declarations are
skipped.  No page is cut: one of any length is a row like the others.
Repeated rows give repeated results; columns beside the named ones are not read.
"""

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Elements of HTML by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("script style noscript template head title svg math iframe object embed canvas audio video select option "
                    "textarea datalist map".split())
FURNITURE = frozenset("nav footer aside form menu dialog button input fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id values that mark furniture.
MARKS = frozenset("ad adbox ads adsense adslot adunit adv advert advertisement advertising adverts alert banner breadcrumb breadcrumbs "
                  "comment comments consent cookie cookies copyright disclaimer disqus footer form gdpr header login masthead menu modal nav navbar "
                  "navigation newsletter notice notices notification notifications overlay pager pagination popup promo promoted promotion recommended "
                  "related replies reply respond responses search share sharing sidebar signin signup skip social sponsor sponsored sponsors "
                  "subscribe subscription toolbar topbar widget widgets".split())
#: With one of these words beside them, the words header and form say nothing about the text.
CONTENT = frozenset("article content entry main post story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGIONS = frozenset("main article".split())
#: An element that ends the open elements named here.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "main": FURNITURE - {"dialog"}}
#: Elements that an implied end does not reach beyond.
WALLS = frozenset("article aside body div dl footer header main nav ol section table ul".split())

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class _Element:
    __slots__ = ("tag", "parent", "depth", "furniture", "skipped", "region")

    def __init__(self, tag, parent, furniture=False):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.furniture = furniture or bool(parent and parent.furniture)
        self.skipped = tag in SKIPPED or bool(parent and parent.skipped)
        self.region = parent.region if parent and parent.region else self if tag in REGIONS and not self.furniture else None


class _Line:
    __slots__ = ("element", "text", "tags", "linked")

    def __init__(self, element, text, tags, linked):
        self.element, self.text, self.tags, self.linked = element, text, tags, linked


def _is_furniture(tag: str, attrs: list, inside: "_Element") -> bool:
    if tag in FURNITURE:
        return True
    if tag == "header":
        return inside.region is None
    if tag in ("html", "body", "main") or not attrs:
        return False
    values = dict(attrs)
    if (values.get("role") or "").lower() in ROLES:
        return True
    named = f"{values.get('class') or ''} {values.get('id') or ''}"
    words = {w.lower() for w in _WORD.findall(named)} | {re.sub(r"[\W_]", "", w).lower() for w in named.split()}
    marks = words & MARKS
    if marks & {"header", "form"} and (words & CONTENT or tag in HEADINGS):
        marks -= {"header", "form"}
    return bool(marks)


class PageLines(HTMLParser):
    """Lines of a page, from parser events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.at = _Element("page", None)
        self.open = Counter()
        self.lines: list[_Line] = []
        self._pieces: list[str] = []
        self._tags = self._links = self._linked = 0

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def _break(self) -> None:
        text = " ".join("".join(self._pieces).split())
        if text:
            self.lines.append(_Line(self.at, text, self._tags, self._linked))
            self._tags = self._linked = 0
        self._pieces = []

    def _pop(self, element: _Element) -> None:
        """End ``element`` and all that is open inside it."""
        while self.at is not element.parent:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_starttag(self, tag, attrs):
        self._tags += 1
        if tag == "br":
            self._pieces.append(" ")
            return
        if tag in INLINE:
            self._links += tag == "a"
            if tag in VOID or not (self.at.tag in INLINE or attrs and _is_furniture(tag, attrs, self.at)):
                return
            self._break()
        else:
            self._break()
            self._imply_ends(CLOSES.get(tag))
        if tag not in VOID:
            self.at = _Element(tag, self.at, _is_furniture(tag, attrs, self.at))
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math"):
            self.handle_endtag(tag)

    def _imply_ends(self, ended) -> None:
        if not ended or not any(self.open[x] for x in ended):
            return
        element = self.at
        while element.parent:
            if element.tag in ended:
                self._pop(element)
                return
            if element.tag in WALLS and not ended & FURNITURE:
                return
            element = element.parent

    def handle_endtag(self, tag):
        self._tags += 1
        if tag == "a" and self._links:
            self._links -= 1
        if tag not in INLINE or self.open[tag]:
            self._break()
        if self.open[tag]:
            element = self.at
            while element.tag != tag:
                element = element.parent
            self._pop(element)

    def handle_data(self, data):
        if not self.at.skipped:
            self._pieces.append(data)
            if self._links:
                self._linked += len(data.strip())

    def finish(self) -> list[_Line]:
        self.close()
        self._break()
        return self.lines


def smoothed_ratios(lines: list[_Line], sigma: float = 1.0) -> np.ndarray:
    """Gaussian mean of the ratios of neighbouring lines; furniture has ratio 0."""
    ratios = np.array([0.0 if x.element.furniture else (len(x.text) - min(x.linked, len(x.text))) / max(x.tags, 1) for x in lines])
    reach = int(np.ceil(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights /= weights.sum()
    return np.convolve(np.pad(ratios, reach), weights, "valid")


def cluster_threshold(values: np.ndarray) -> float:
    """The smallest value of the upper of two clusters with the least squared distance to their means."""
    v = np.sort(values)
    if v[0] == v[-1]:
        return float(v[0])
    sums, n = np.cumsum(v), np.arange(1, len(v))
    between = sums[:-1] ** 2 / n + (sums[-1] - sums[:-1]) ** 2 / (len(v) - n)
    return float(v[int(np.argmax(between)) + 1])


def _holder(elements: list[_Element]) -> _Element:
    """The innermost element that holds all the given ones."""
    common = elements[0]
    for other in elements[1:]:
        while other is not common:
            if other.depth > common.depth:
                other = other.parent
            elif common.depth > other.depth:
                common = common.parent
            else:
                common, other = common.parent, other.parent
    return common


def _inside(element: _Element, region: _Element) -> bool:
    while element.depth > region.depth:
        element = element.parent
    return element is region


def _block_parent(element: _Element) -> _Element:
    """The element in which a line's paragraph, heading or item stands."""
    return element.parent if element.parent and element.tag not in WALLS else element


def main_lines(lines: list[_Line], sigma: float = 1.0) -> list[str]:
    """The lines of the content regions, in page order."""
    free = [x for x in lines if not x.element.furniture]
    if not free:
        return []
    smooth = smoothed_ratios(lines, sigma)
    own = np.array([not x.element.furniture for x in lines])
    threshold = cluster_threshold(smooth[own])
    chosen = [x for x, s, ok in zip(lines, smooth, own) if ok and s >= threshold]
    regions = {x.element.region for x in chosen} - {None}
    if not regions:
        regions = {x.element.region for x in free} - {None}
    if regions:
        return [x.text for x in free if x.element.region in regions]
    holder = _holder([_block_parent(x.element) for x in chosen])
    if holder.tag not in ("page", "html", "body"):
        return [x.text for x in free if _inside(x.element, holder)]
    beside = {_block_parent(x.element) for x in chosen}
    place = {id(x): i for i, x in enumerate(free)}
    first, last = place[id(chosen[0])], place[id(chosen[-1])]
    return [x.text for i, x in enumerate(free)
            if first <= i <= last or _block_parent(x.element) in beside and 2 * x.linked <= len(x.text)]


def page_text(html: str | None) -> str:
    parser = PageLines()
    parser.feed(html or "")
    return "\n".join(main_lines(parser.finish()))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Each page's kept columns with ``text`` and ``n_chars`` (code points)."""
    def task(batches):
        for batch in batches:
            texts = [page_text(x.as_py()) for x in batch.column("_html")]
            yield pa.RecordBatch.from_arrays([batch.column("_kept"), pa.array(texts, pa.string())], names=["_kept", "text"])

    rows = pages.select(F.struct(*keep).alias("_kept"), F.col(html_col).cast("string").alias("_html"))
    kept = rows.schema["_kept"].dataType.simpleString()
    out = rows.mapInArrow(lambda batches: task(batches), f"_kept {kept}, text string")
    return out.select("_kept.*", "text", F.char_length("text").cast("long").alias("n_chars"))
