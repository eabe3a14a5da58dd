"""HTML extraction by line-block distribution.

Markup is stripped into lines: a block element's start or end ends a line, inline markup and <br> do not. Each line has a
weight, and the weights of ``window`` lines in a row are summed. Where the sum rises to the threshold is a surge, where it
falls to 0 a dive; the lines with weight between a surge and its dive are kept, with up to ``window`` lines right before
the surge that no gap parts from it (a heading). The threshold is ``surge``, or half the
largest sum if the page has less.

Weights. A line weighs its length; markup takes weight away or adds some:
* lines in a part that is not the article (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
  comments: by element name, ARIA role, or class and id) weigh nothing, but stay as lines, so the distribution keeps its
  shape. A class or id names such a part if it is a part name, or is compounded of part names and of words of place and
  kind alone (cookie-notice, site-footer; not has-sidebar, related-work). Inside the main part all words of the attribute
  must be such. It doesn't count on the element of the main part, nor around the first main part of a page that would
  else have none;
* if the page names its main part (<article>, <main>, role=main), lines in it weigh ``surge`` more, so that a single short
  one reaches the threshold, and lines outside it nothing;
* elsewhere lines that are mostly link text weigh nothing.

White space inside a block becomes one space; blocks are joined in page order by an empty line.

Edge cases: null and empty html give an empty text. Unclosed and stray tags are repaired: an end tag closes what it names
if that is open, else it only ends the line; a "<" that no ">" follows is text. An unclosed script, style or comment
swallows the rest, as in a browser. Ties don't arise. Repeated rows give repeated results, an empty table an empty one;
further columns are ignored. Time is linear in a page's length, whatever its nesting.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

# Element names of the HTML standard, by role.
_RAW = frozenset("script style noscript template textarea title iframe svg math select object canvas audio video".split())
_SKIP = _RAW | frozenset("nav header footer aside form button dialog menu head label fieldset".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = _SKIP - frozenset("label button textarea select svg math canvas audio video object iframe".split()) | frozenset(
    "address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html legend li main ol p pre section"
    " summary table tbody td tfoot th thead tr ul caption".split()
)
_MAIN = frozenset(["article", "main"])
# Words of class, id and role that name other parts of a page.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle banner banners sponsor sponsored promo promotion nav navbar navigation menu menus"
    " breadcrumb breadcrumbs sidebar sidebars aside footer header masthead comment comments respond reply replies disqus cookie cookies consent gdpr"
    " notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login share sharing social related"
    " recommended widget widgets pagination pager toolbar skip complementary contentinfo search dialog".split()
)
# Words that a compound may hold besides part names.
_PLACES = frozenset(
    "site page global main primary secondary top bottom left right inner outer box block bar list item items link links container wrapper wrap area"
    " section post posts article articles entry entries story stories form button buttons icons slot unit text message".split()
)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"=\s*([\"'])")
_ATTR = re.compile(r"(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORDS = re.compile(r"[a-z]+|[0-9]+")


def _part_words(token: str) -> bool:
    words = [w for w in _WORDS.findall(token) if not w.isdigit()]
    return not _NAMES.isdisjoint(words) and all(w in _NAMES or w in _PLACES for w in words)


def _names_part(value: str, inside: bool) -> bool:
    """Whether a class, id or role names another part of the page; inside the main part all its words must."""
    tokens = value.split()
    if inside:
        return any(map(_part_words, tokens)) and all(_part_words(t) or all(w in _PLACES or w.isdigit() for w in _WORDS.findall(t)) for t in tokens)
    return any(map(_part_words, tokens))


def _other_part(attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether attributes hide the element or give it the role of another part; whether class or id name one; whether they name the main part."""
    main = words = other = False
    for name, value in _ATTR.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" and not value:
            return True, False, False
        if name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True, False, False
        if name == "role" and value in ("main", "article"):
            main = True
        elif name == "role":
            other |= _names_part(value, inside)
        elif name in ("class", "id"):
            words |= _names_part(value, inside)
    return other, words, main


class Tags:
    """The tags of a page in order: (start, end, closing, name, attributes); name is empty for comments and declarations.

    Every search begins where the last one ended, or is remembered to find nothing from some place on.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.never: dict[str, bool] = {}

    def _find(self, what: str, at: int) -> int:
        if self.never.get(what):
            return -1
        found = self.page.find(what, at)
        self.never[what] = found < 0
        return found

    def _end(self, at: int) -> int:
        """The ">" that ends the tag that is open at ``at``: the first one outside quoted values. -1: none."""
        first = end = self._find(">", at)
        while end >= 0:
            quoted = _QUOTED.search(self.page, at, end)
            if not quoted:
                return end
            close = self._find(quoted[1], quoted.end())
            if close < 0:
                return first  # the quote never ends: it is none
            at = close + 1
            if at > end:
                end = self._find(">", at)
                if end < 0:
                    return first
        return -1

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        page = self.page
        start = self._find("<", at)
        while start >= 0:
            if page.startswith("<!--", start):
                end = self._find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, False, "", ""
            m = _NAME.match(page, start)
            if m or page.startswith(("<!", "<?"), start):
                end = self._end(m.end()) if m else self._find(">", start)
                if end >= 0:
                    return start, end + 1, bool(m and m[1]), m[2].lower() if m else "", page[m.end() : end] if m else ""
                if m and self._find(">", m.end()) < 0 or not m:
                    return None  # no tag can end from here on
            start = self._find("<", start + 1)
        return None


def lines_of(page: str, lift: bool = False) -> tuple[list[tuple[str, int, bool]], bool]:
    """(text, length of link text, in the main part) of each line; whether the page names a main part.

    lift: class and id of the elements around the first main part don't count.
    """
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element, other part, main part, other part by class or id alone
    opened: Counter[str] = Counter()
    text: list[str] = []
    links = other = hard = main = 0  # hard: open elements that are another part not by class or id alone
    found = buried = False
    link = 0

    def end_line() -> None:
        nonlocal links
        joined = " ".join("".join(text).split())
        if joined or not text:
            out.append((joined, links, main > 0))
        text.clear()
        links = 0

    def pop() -> str:
        nonlocal other, hard, main, link
        name, was_other, was_main, by_words = stack.pop()
        opened[name] -= 1
        other -= was_other
        hard -= was_other and not by_words
        main -= was_main
        link -= name == "a"
        return name

    tags = Tags(page)
    at, size = 0, len(page)
    while at < size:
        tag = tags.after(at)
        stop = tag[0] if tag else size
        if stop > at and not other:
            piece = entities.unescape(page[at:stop])
            text.append(piece)
            links += len(piece.strip()) if link else 0
        if not tag:
            break
        _, at, closing, name, attributes = tag
        if not name:
            continue
        if closing:
            if name in _BLOCK:
                end_line()
            if opened[name]:
                while pop() != name:
                    pass
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in _BLOCK:
            end_line()
            if stack:
                _close_implied(stack, name, pop)
        if name in _VOID or attributes.endswith("/") and name not in _BLOCK and name not in _RAW:
            continue
        if name in _RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else size
            continue
        is_other, by_words, is_main = _other_part(attributes, main > 0) if attributes else (False, False, False)
        is_main |= name in _MAIN
        is_other = is_other and name not in ("html", "body") or name in _SKIP and not (name == "header" and main)
        by_words = by_words and not is_other and not is_main and name not in ("html", "body")
        is_other |= by_words
        is_main = is_main and not is_other
        if is_main and other and not found and not hard:
            buried = True
            if lift:
                stack[:] = [(n, False, k, False) for n, _, k, _ in stack]
                other = 0
        is_main = is_main and not other
        found |= is_main
        if is_other and not other:
            end_line()
        stack.append((name, is_other, is_main, by_words))
        opened[name] += 1
        other += is_other
        hard += is_other and not by_words
        main += is_main
        link += name == "a"
    end_line()
    return lines_of(page, True) if buried and not found else (out, found)


def _close_implied(stack: list[tuple[str, bool, bool, bool]], name: str, pop) -> None:
    """Start tags that close an open element of the same kind."""
    pairs = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
    closes = pairs.get(name, ())
    while stack and stack[-1][0] in closes:
        pop()
    if name not in ("li", "td", "th", "dd", "dt") and stack and stack[-1][0] == "p" and name in _BLOCK:
        pop()


def weights(lines: list[tuple[str, int, bool]], found: bool, surge: int) -> list[int]:
    """A line's length, with what markup adds or takes away."""
    if found:
        return [len(t) + surge if t and inside else 0 for t, _, inside in lines]
    return [len(t) if links * 2 <= len(t) else 0 for t, links, _ in lines]


def regions(sizes: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """(first, end) of the lines from each surge of the window sums to its dive."""
    n = len(sizes)
    total = [0, *accumulate(sizes)]
    blocks = [total[min(n, i + window)] - total[i] for i in range(n)]
    need = min(surge, max(1, max(blocks, default=0) // 2))
    out, i = [], 0
    while i < n:
        if blocks[i] < need:
            i += 1
            continue
        start = i
        while start and i - start < window and blocks[start - 1] > 0:  # a heading right before
            start -= 1
        while i < n and blocks[i] > 0:
            i += 1
        out.append((start, i))
    return out


def main_text(page: str | None, window: int = 3, surge: int = 86) -> str:
    if not page:
        return ""
    lines, found = lines_of(page)
    sizes = weights(lines, found, surge)
    return "\n\n".join(lines[k][0] for first, end in regions(sizes, window, surge) for k in range(first, end) if sizes[k])


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    frame = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                got = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    kinds = dict(frame.dtypes)
    return map_arrow(frame, run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
