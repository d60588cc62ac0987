"""Main text of web pages by line-block distribution.

Mark-up is stripped to lines, one for each block, and tags give each its weight: lines in menus, headers, footers
and the like and lines that are mostly links weigh nothing, lines of a marked article count more than others.
Weights are summed over a sliding window of lines. A run of lines ends where the sum dives to nothing; it is text
if the sum surges somewhere in it, or for those of its lines that share a box with a line of such a run. Where no article is marked but one box
holds most of a page's weight, the text dives at its ends too: before and behind it, only boxes of some weight beside it stay.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: A window of such a weight is a surge; a page's best window is one in any case.
SURGE = 80
#: Weight of a character in a marked article, and outside it on the same page; 1 on pages without one.
IN_MAIN, OUTSIDE = 4.0, 0.25
LINK_SHARE = 0.6
#: On unmarked pages: the share of the weight that makes a box the main one, and the share of its weight that others need to stay beside it.
MAIN_SHARE, BESIDE = 0.5, 0.2

# Element names of HTML.
_RAW = frozenset("script style noscript template title textarea iframe svg math object xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_APART = frozenset("nav footer aside form button select dialog menu head".split())
_MAIN = frozenset("article main".split())
_CLOSED_BY_NEXT = frozenset("p li dd dt td th tr option".split())
_APART_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
_APART_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner\w*|nav|navbar|navigation|menu\w*|sidebar\w*|footer|header|masthead|cookies?|consent|gdpr|notices?|alert"
    r"|popup|modal|overlay|subscri\w*|newsletter|signup|login|comments?|disqus|replies|respond|social|share|sharing|related|recommend\w*|breadcrumbs?|widget|pagination|pager|toolbar)(?=$|[\s_-])"
)
# What readers say is no article's text, even in an article of its own; names that only tell whether they may say something do not count.
_COMMENTS = re.compile(r"(?:^|\s)(?:(?:user|reader|readers|the)[_-]?)?(?:comment|repl(?:y|ies)|respon[sd]|disqus)(?!\S*(?:open|close|off|allow|enable|disable|count|link))\S*")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<![\w-])(hidden)(?![\w-])")


@dataclass
class Line:
    text: str
    linked: int
    apart: bool
    main: bool
    box: int = 0  # number of the article it is in, else of the element


@dataclass
class _Open:
    """An open element, with what holds for text in it, so that deep nesting costs nothing."""

    name: str
    apart: bool  # it or what holds it is, by kind
    named: bool  # it or what holds it is, by name, and no article in that voids it
    main: bool
    box: int

    @property
    def state(self) -> tuple[bool, bool, int]:
        return self.apart or self.named, self.main, self.box


def _is_apart(name: str, attributes: str, in_main: bool) -> tuple[bool, bool]:
    """Whether its kind sets an element apart, and whether its class or id does, which an article in it overrides."""
    if name in _APART or name == "header" and not in_main:
        return True, False
    if not attributes or name in ("html", "body"):
        return False, False
    apart, named = False, False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = (m[1] or m[5]).lower(), (m[2] or m[3] or m[4] or "").lower()
        apart |= name not in _MAIN and bool(key == "role" and value in _APART_ROLES or key == "hidden" and m[5])
        if key in ("class", "id"):
            named |= bool(_APART_NAMES.search(value))
            apart |= bool(_COMMENTS.search(value))
    return apart, named


def lines(page: str) -> list[Line]:
    """The page's blocks in order. Ends in one pass, whatever is left open or unquoted."""
    out: list[Line] = []
    parts: list[str] = []
    linked, links = 0, 0
    boxes = 0
    open_: list[_Open] = []  # the elements that matter
    held: Counter = Counter()  # how many of each name are open
    tag, at, size = _TAG, 0, len(page)

    def state() -> tuple[bool, bool, int]:
        """Apart, main and box of what stands here."""
        return open_[-1].state if open_ else (False, False, 0)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                out.append(Line(text, linked, *state()))
            parts.clear()
        linked = 0

    def close(name: str) -> None:
        if held.get(name):
            while (x := open_.pop().name) != name:
                held[x] -= 1
            held[name] -= 1

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            parts.append(page[at:lt])
            linked += (lt - at) * (links > 0)
        if lt == size:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        m = tag.match(page, lt)
        if not m and tag is _TAG and _PLAIN_TAG.match(page, lt):
            tag = _PLAIN_TAG  # a quote is never closed: from here on quotes mean nothing
            m = tag.match(page, lt)
        if not m:
            if page[lt + 1 : lt + 2].isalpha() or page[lt + 1 : lt + 2] == "/":
                end = page.find(">", lt)
                at = size if end < 0 else end + 1  # a tag cut off at the end of the page
            else:
                parts.append("<")
                at = lt + 1
            continue
        at = m.end()
        name = m[2].lower()
        if name in _BLOCK:
            flush()
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            close(name)
            continue
        if name in _RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                at = end.start() if end else size
            continue
        if name in _VOID:
            continue
        if name == "a":
            links += 1
        if name in _CLOSED_BY_NEXT and open_ and open_[-1].name == name:
            held[open_.pop().name] -= 1
        within, in_main, _ = state()
        (apart, named), main = _is_apart(name, m[3], in_main), name in _MAIN
        named &= not main or within  # an article goes by its own name only where what holds it is apart too
        if apart or named or main or name in ("div", "section", "header", "ul", "ol", "table"):
            if not m[3].endswith("/"):
                boxes += 1
                up = open_[-1] if open_ else _Open("", False, False, False, 0)
                box = boxes if main or not up.main else up.box
                open_.append(_Open(name, up.apart or apart, named or up.named and not main, up.main or main, box))
                held[name] += 1
    flush()
    return out


def _weight(line: Line, marked: bool) -> float:
    in_main = marked and line.main
    if line.apart or not in_main and line.linked > LINK_SHARE * len(line.text):
        return 0
    return len(line.text) * (IN_MAIN if in_main else OUTSIDE if marked else 1)


def _surging(weights: list[float], at_best: bool) -> list[bool]:
    """Which lines are in a run that surges; with at_best, the run of the best window does in any case."""
    n = len(weights)
    sums = [sum(weights[i : i + WINDOW]) for i in range(n)]
    surge = min(SURGE, max(sums, default=0)) or SURGE if at_best else SURGE
    out: list[bool] = []
    while len(out) < n:
        end = len(out)
        while end < n and sums[end]:
            end += 1
        out += [max(sums[len(out) : end], default=0) >= surge] * (end - len(out)) + [False] * (end < n)
    return out


def _beside(found: list[Line], weights: list[float]) -> list[bool]:
    """Which lines stand before or behind the box that holds most of a page, in a box of little weight beside it."""
    boxes: Counter = Counter()
    for x, w in zip(found, weights, strict=True):
        boxes[x.box] += w
    best, most = max(boxes.items(), key=lambda b: b[1], default=(0, 0))
    if most < MAIN_SHARE * sum(weights) or not most:
        return [False] * len(found)
    own = [k for k, x in enumerate(found) if x.box == best]
    return [not own[0] <= k <= own[-1] and boxes[x.box] < BESIDE * most for k, x in enumerate(found)]


def main_text(page: str | None) -> str:
    found = lines(page or "")
    marked = any(x.main and not x.apart for x in found)
    weights = [_weight(x, marked) for x in found]
    if not marked:
        weights = [0 if off else w for w, off in zip(weights, _beside(found, weights), strict=True)]
    surging: dict[int, bool] = {}
    for best in (True, False):  # the article's lines, or all of an unmarked page; then those outside the article
        own = [k for k, x in enumerate(found) if (x.main or not marked) == best]
        surging |= zip(own, _surging([weights[k] for k in own], best), strict=True)
    boxes = {(found[k].main, found[k].box) for k, yes in surging.items() if yes and weights[k]}
    return " ".join(x.text for k, x in enumerate(found) if weights[k] and (surging[k] or (x.main, x.box) in boxes))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages(page_id, url, html).

    A null or empty page has an empty text. Nulls in page_id and url pass through, repeated rows come back
    as often as they came, an empty table gives an empty result, other columns are not looked at. A page is read whole, in
    time that is linear in its length, whatever it leaves open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    columns = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return pages.select(*columns).mapInArrow(run, "page_id long, url string, text string, n_chars long")
