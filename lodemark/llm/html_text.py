"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines, one a block of the page. A line weighs as many characters as it has outside links; lines
of menus, headers, footers, sidebars, notices, adverts, forms and comments weigh nothing, and lines of an element that
the page itself marks as its article weigh SURGE more. The weights are summed over sliding windows of WINDOW lines: where
the sums rise to the threshold is a surge point, where they fall below it a dive point, and the text from surge to dive
is kept. Stretches that only a few short lines of prose part are one.

Defined results: null, empty and text-free pages give the empty text; a page without tags is one block; unclosed tags,
comments and quotes end where the page does or where the next block begins; broken character references stay as they
are; pages of any length are read whole; repeated rows give one row each; other columns are ignored; an empty table gives
no rows. The title of an article is part of it; a nested article is a reader comment.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices

#: Lines a window holds, and the characters that a window of running prose has at least.
WINDOW, SURGE = 3, 80
#: Stretches with at most so many lines between them are one; stretches with less than this share of the longest go.
BRIDGE, SHARE = 6, 1 / 3
#: Bytes of pages that a task has in Python at once.
SLICE = 4 << 20

# Element names of HTML and the words that sites use in class and id.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("aside audio button canvas datalist dialog footer map menu nav object select svg template video".split())
UNLESS_MARKED = frozenset("form header".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs byline consent cookie cookies copyright disclaimer discussion disqus dfp "
    "foot footer form gdpr header login masthead menu meta modal nav navbar navigation newsletter notice offcanvas outbrain overlay pager pagination "
    "paywall popup promo promoted promotion recommended register related reply replies respond responses search share sharebar sharing sidebar signin "
    "signup skip social sponsor sponsored sponsors subscribe subscription taboola tags toolbar topbar trending".split()
)
SIDE_STARTS = ("advert", "breadcrumb", "comment", "cookie", "footer", "masthead", "navig", "newsletter", "sidebar", "sponsor", "subscri")
SIDE_ENDS = ("comments", "footer", "header", "menu", "nav", "navbar", "sidebar")
LAYOUT_WORDS = frozenset("has no not with without".split())
SIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
ARTICLE_CLASSES = frozenset(
    "article-body article-content article-text articlebody content-body entry-content main-content maincontent mw-parser-output post-body post-content "
    "story-body story-content".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # a quoted value may hold ">"; a quote that does not close in reason ends with its tag
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]{0,4096}+\"|'[^']{0,4096}+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|\Z)""", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
ENDS_PROSE = re.compile(r"[.!?:;…。！？»”\"')\]]\s*\Z")


def _is_side(name: str) -> bool:
    """Whether one class or id names something beside the article."""
    words = [w.lower() for w in NAME_WORD.findall(name)]
    if LAYOUT_WORDS.intersection(words[:-1]):
        return False
    return any(w in SIDE_WORDS or w.startswith(SIDE_STARTS) or (w.endswith(SIDE_ENDS) and len(w) > 4) for w in words)


#: What an element says of the text in it.
PLAIN, SIDE, SOFT_SIDE, ARTICLE, BODY = range(5)


def _says(tag: str, attributes: str) -> int:
    """SIDE: no part of the article. SOFT_SIDE: unless it holds what is marked as the article. ARTICLE, BODY: marked as such."""
    if tag in NEVER:
        return SIDE
    said = SOFT_SIDE if tag in UNLESS_MARKED else ARTICLE if tag in ("article", "main") else PLAIN
    if not attributes:
        return said
    found = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return SIDE
    names = (found.get("class", "") + " " + found.get("id", "")).split()
    role = found.get("role", "").lower()
    if found.get("itemprop", "").lower() == "articlebody" or any(n.lower() in ARTICLE_CLASSES for n in names):
        return BODY
    if role in ("main", "article") or said == ARTICLE:
        # an article may be a comment
        return SIDE if tag == "article" and any(w.startswith("comment") for n in names for w in map(str.lower, NAME_WORD.findall(n))) else ARTICLE
    if role in SIDE_ROLES:
        return SIDE
    if tag not in ("html", "body") and any(map(_is_side, names)):
        return SIDE if any("comment" in n.lower() for n in names) else SOFT_SIDE
    return said


class Lines:
    """The blocks of a page: their texts, and for each its characters in links and what its elements say."""

    def __init__(self):
        self.texts: list[str] = []
        self.linked: list[int] = []
        self.side: list[bool] = []
        self.marks: list[tuple[int, int]] = []  # numbers of the innermost article and article body, 0 if none
        self.heading: list[bool] = []


def lines_of(page: str) -> Lines:
    """The page's blocks in order. White space inside one is single spaces; blocks without text are left out."""
    out = Lines()
    # open elements: name, side, soft side, number of the article, number of the body, heading
    stack: list[tuple[str, bool, bool, int, int, bool]] = [("", False, False, 0, 0, False)]
    opened: Counter = Counter()
    pieces: list[str] = []
    linked = regions = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            _, side, soft, article, body, heading = stack[-1]
            out.texts.append(text)
            out.linked.append(min(linked, len(text)))
            out.side.append(side or soft)
            out.marks.append((article, body))
            out.heading.append(heading)
        pieces.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop()[0]] -= 1

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if in_link:
                linked += len(text)

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        closing = bool(m[1] or m[4])
        if tag in RAW:
            if not closing:
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        block = tag in BLOCKS
        if block:
            flush()
        if closing:
            if tag == "a":
                in_link = False
            if opened[tag] > 0:
                depth = len(stack) - 1
                while stack[depth][0] != tag and (block or stack[depth][0] not in BLOCKS):
                    depth -= 1
                if stack[depth][0] == tag:
                    pop_to(depth)
            if block:
                in_link = False
            continue
        if block:
            # a new block ends an open paragraph, a new item the item before
            depth = len(stack) - 1
            while depth and stack[depth][0] not in BLOCKS:
                depth -= 1
            if stack[depth][0] == "p":
                pop_to(depth)
                depth = len(stack) - 1
            if tag in CLOSES and stack[depth][0] in CLOSES[tag]:
                while depth and stack[depth][0] in CLOSES[tag]:
                    pop_to(depth)
                    depth -= 1
        if opened["head"] > 0 and tag not in IN_HEAD:
            pop_to(max(1, max(k for k, x in enumerate(stack) if x[0] == "head")))
        if tag in VOID:
            continue
        if tag == "a":
            in_link = True
        _, side, soft, article, body, heading = stack[-1]
        said = _says(tag, m[3] if m[2] else m[6])
        if tag == "head":
            side = True
        if said == SIDE or (tag == "article" and article and opened["article"] > 0):
            side = True
        elif said == SOFT_SIDE:
            # the title in an article's own header is the article's
            soft = not (tag == "header" and article) or soft
        elif said == ARTICLE and not side:
            regions += 1
            article, soft = regions, False
        elif said == BODY and not side:
            regions += 1
            body, soft = regions, False
        heading = heading or tag in HEADINGS
        stack.append((tag, side, soft, article, body, heading))
        opened[tag] += 1
    flush()
    return out


def weights(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Each line's weight, and whether it lies in what the page marks as its article."""
    n = len(lines.texts)
    size = np.fromiter(map(len, lines.texts), np.int64, n)
    side = np.array(lines.side, bool)
    marked = np.zeros(n, bool)
    for k in (1, 0):  # article bodies first, then articles
        number = np.fromiter((m[k] for m in lines.marks), np.int64, n)
        total = np.bincount(number[~side], size[~side], minlength=1)
        total[0] = 0
        if total.max(initial=0) > 0:
            chosen = total >= total.max() * SHARE
            marked = chosen[np.minimum(number, len(chosen) - 1)] & (number > 0) & (number < len(chosen)) & ~side
            if k:  # the headings before the body, in the same article
                article = np.fromiter((m[0] for m in lines.marks), np.int64, n)
                own = np.isin(article, article[marked]) & (article > 0) & np.array(lines.heading, bool) & ~side
                marked |= own & (np.arange(n) < np.argmax(marked))
            break
    weight = np.where(side, 0, size - np.array(lines.linked, np.int64))
    if marked.any():
        weight = np.where(marked, size + SURGE, 0)
    return weight, marked


def stretches(weight: np.ndarray) -> list[tuple[int, int]]:
    """[surge, dive) of every stretch: windows that begin in it weigh the threshold or more."""
    n = len(weight)
    padded = np.concatenate([[0], np.cumsum(np.concatenate([weight, np.zeros(WINDOW - 1, weight.dtype)]))])
    window = padded[WINDOW:] - padded[:-WINDOW]
    most = int(window.max(initial=0))
    if most <= 0:
        return []
    high = window >= min(SURGE, max(1, most / 2))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], high, [False]]).astype(np.int8)))
    found = []
    for surge, dive in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        dive = min(n, dive + WINDOW - 1)  # the last heavy window's lines
        while dive > surge and weight[dive - 1] == 0:
            dive -= 1
        while surge < dive and weight[surge] == 0:
            surge += 1
        if found and surge <= found[-1][1]:
            found[-1] = (found[-1][0], max(dive, found[-1][1]))
        else:
            found.append((surge, dive))
    return found


def main_text(page: str | None) -> str:
    """The article of one page."""
    lines = lines_of(page or "")
    if not lines.texts:
        return ""
    weight, marked = weights(lines)
    found = stretches(weight)
    if not found:
        return ""
    if not marked.any():
        joined = [found[0]]
        for surge, dive in found[1:]:
            between = slice(joined[-1][1], surge)
            if surge - joined[-1][1] <= BRIDGE and all(weight[k] > 0 for k in range(between.start, between.stop)):
                joined[-1] = (joined[-1][0], dive)
            else:
                joined.append((surge, dive))
        size = [int(weight[a:b].sum()) for a, b in joined]
        found = [_trimmed(lines, weight, a, b) for (a, b), s in zip(joined, size, strict=True) if s >= max(size) * SHARE]
    return " ".join(lines.texts[k] for a, b in found for k in range(a, b) if weight[k] > 0)


def _trimmed(lines: Lines, weight: np.ndarray, surge: int, dive: int) -> tuple[int, int]:
    """Without the short lines at both ends that are no sentences and so only share a window with prose."""

    def beside(k: int) -> bool:
        return bool(weight[k] < SURGE // 2 and not ENDS_PROSE.search(lines.texts[k])) or lines.texts[k][0] in "©"

    a, b = surge, dive
    while a < b and beside(a) and not lines.heading[a]:
        a += 1
    while b > a and beside(b - 1):
        b -= 1
    return (a, b) if a < b else (surge, dive)


def extract(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep`, then text and n_chars (code points), for every row of pages."""

    def run(batches):
        for batch in slices(batches, "_html", SLICE):
            texts = [main_text(page) for page in batch.column("_html").to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), sizes], [*batch.schema.names[:-1], "text", "n_chars"])

    rows = pages.select(*[F.col(c) for c in keep], F.col(html_column).alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keep)])
    return rows.mapInArrow(run, f"{schema}, text string, n_chars long")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
