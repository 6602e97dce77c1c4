"""Main text of web pages by tag-path ratios (operator 5).

A page becomes a list of text nodes (blocks), each with its root-to-leaf tag path.  Text
elements (paragraphs, headings, list items ...) count for the path of the element that holds them.
For every such path the text outside links and the punctuation of its nodes are summed, and
both are divided by the page's greatest.  The two ratios are fused by their geometric mean.  They are
smoothed down the paths: a path takes the greatest ratio of those above it, so a list or a
heading inside an article has the article's ratio and a menu beside it doesn't.

Elements and words in class, id or role that may name something beside the article
(menus, footers, adverts, comments ...) are evidence, too: such a path
takes nothing from above it and its score is its own ratio times ``STRONG`` or ``WEAK``.  The threshold
follows the spread of the page's ratios (``SPREAD`` standard deviations over its paths, but no more than
``SHARE_OF_BEST`` of the best score): the less ratios differ, the less is dropped, whatever words say; only
where the sums of all paths are the very same do words decide.  The nodes of all paths that reach it are the content.

Defined results: a null page counts as empty, and a page without text gives the empty
text.  Pages are read whole.  Malformed mark-up is read on as browsers do: quotes open
only after an equals sign, ``<!-->`` is a comment, an unclosed comment or attribute
value takes the rest, however deep elements are nested;
references are decoded within a run of text.  Repeated rows and ties give equal
results, an empty table an empty one; extra columns pass through, whatever their names,
unless they carry a result's name, in which case the result replaces them.
"""

from __future__ import annotations

import html
import math
import re
import statistics
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, with_results

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't mark-up and that a reader doesn't see as text.
RAW = frozenset("script style noscript textarea title iframe noembed noframes".split())
#: Elements whose content is mark-up that isn't shown.
UNSEEN = frozenset(("template", "annotation", "annotation-xml", "datalist"))
#: Elements that stand in a line of text.
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label map mark math meter object output picture progress q rb rp rt rtc ruby s samp slot small span strike strong sub "
    "sup svg time tt u var video wbr menclose merror mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
#: Elements whose text counts for the element that holds them.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption pre blockquote address summary".split())
#: Elements, and words in class, id or role, that mostly name something beside an article's text ...
SIDE = frozenset("nav footer aside form menu dialog fieldset button select option optgroup".split())
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus dropdown footer hidden login masthead menu menus modal nav navbar navigation "
    "newsletter notice notices pagination pager popup promo promoted recommended related reply replies sidebar signup skip sponsor sponsored subscribe subscription toolbar widget".split()
)
#: ... and those that often do.
UNSURE = frozenset(("header",))
UNSURE_WORDS = frozenset("byline header search share sharing social tags".split())
#: What these leave of a path's score; the threshold in standard deviations of the page's ratios, and in shares of the best score at most.
STRONG, WEAK, SPREAD, SHARE_OF_BEST = 0.02, 0.8, 1 / 3, 0.6

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)"
    r"|</?([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))*+)(?:>|\Z)",
    re.S,
)
_MARKS = re.compile(r"(?:^|[\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|[\s\"'])hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、،।]")
_ENDS = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I | re.A) for tag in RAW}
#: What the start of an element closes, up to the nearest scope; other block elements close a paragraph.
_CLOSES = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option", "p")}
_SCOPES = frozenset("article main section div td th table ul ol dl body html blockquote nav aside header footer form figure".split())
#: Words before a side word that speak of the page's layout, not of the element.
_LAYOUT = frozenset("has with no without is not".split())


class Path:
    """A root-to-leaf tag path, what its words leave of a score, and its sums over the nodes that count for it."""

    __slots__ = ("below", "chars", "marks", "parent", "share", "side")

    def __init__(self, parent: Path | None, side: float):
        self.parent, self.side, self.below = parent, side, {}
        self.share = side * parent.share if parent else 1.0
        self.chars = self.marks = 0

    def child(self, tag: str, side: float) -> Path:
        found = self.below.get((tag, side))
        if found is None:
            found = self.below[tag, side] = Path(self, side)
        return found


def _side(tag: str, attributes: str) -> float:
    """What an element's name and words leave of a score."""
    least = STRONG if tag in SIDE else WEAK if tag in UNSURE else 1.0
    if "=" in attributes or "hidden" in attributes.lower():
        for m in _MARKS.finditer(attributes):
            for name in (m[2] or m[3] or m[4] or "").lower().split():
                parts = _WORD.findall(name)
                if parts and parts[0] not in _LAYOUT:
                    least = min(least, 1.0 if SIDE_WORDS.isdisjoint(parts) else STRONG, 1.0 if UNSURE_WORDS.isdisjoint(parts) else WEAK)
        if _HIDDEN.search(attributes):
            least = STRONG
    return least


def nodes(page: str) -> list[tuple[Path, str]]:
    """Path and text of each block in page order."""
    out: list[tuple[Path, str]] = []
    root = Path(None, 1.0)
    stack: list[tuple[str, Path, Path, bool]] = [("", root, root, False)]  # tag, path of the block elements, the path its text counts for, unseen
    opened: dict[str, int] = {}
    text: list[str] = []
    plain: list[str] = []  # what of it is in no link
    at, size = 0, len(page)

    def flush() -> None:
        if text:
            joined, own = (" ".join("".join(t).split()) for t in (text, plain))
            text.clear()
            plain.clear()
            if joined:
                path = stack[-1][2]
                path.chars += len(own)
                path.marks += len(_PUNCTUATION.findall(own))
                out.append((path, joined))

    def said(run: str) -> None:
        if not stack[-1][3]:
            text.append(html.unescape(run) if "&" in run else run)
            plain.append(" " if opened.get("a") else text[-1])

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    while at < size:
        start = page.find("<", at)
        m = None
        while start >= 0 and (m := _TOKEN.match(page, start)) is None:
            start = page.find("<", start + 1)
        if m is None:
            said(page[at:])
            break
        if start > at:
            said(page[at:start])
        at = m.end()
        if m[1] is None:
            continue
        tag = m[1].lower()
        if page[start + 1] == "/":
            if tag in VOID:
                if tag == "br":
                    said(" ")
                continue
            if tag not in INLINE:
                flush()
                if opened.get(tag):
                    while pop() != tag:
                        pass
            elif opened.get(tag):
                i = len(stack) - 1
                while stack[i][0] in INLINE and stack[i][0] != tag:
                    i -= 1
                if stack[i][0] == tag:  # an inline end doesn't close blocks
                    while len(stack) > i:
                        pop()
            continue
        if not page.endswith(">", start, at):
            break  # a tag that the page's end cuts
        if tag in RAW:
            if tag not in INLINE:
                flush()
            end = _ENDS[tag].search(page, at)
            if end is None:
                break
            close = page.find(">", end.end())
            at = size if close < 0 else close + 1
            continue
        if tag in VOID:
            if tag == "br":
                said(" ")
            elif tag not in INLINE:
                flush()
            continue
        if tag in INLINE:
            if not m[2].endswith("/"):
                stack.append((tag, *stack[-1][1:]))
                opened[tag] = opened.get(tag, 0) + 1
            continue
        flush()
        while stack[-1][0] in INLINE:  # a block start ends open inline elements
            pop()
        closes = _CLOSES.get(tag, ("p",))
        if any(opened.get(c) for c in closes):
            i = len(stack) - 1
            while i > 0 and stack[i][0] not in closes and stack[i][0] not in _SCOPES:
                i -= 1
            if stack[i][0] in closes:
                while len(stack) > i:
                    pop()
        _, path, holder, unseen = stack[-1]
        if tag not in ("html", "body"):
            side = _side(tag, m[2])
            above, path = path, path.child(tag, side)
            holder = above if tag in TEXT and side == 1.0 else path
        stack.append((tag, path, holder, unseen or tag in UNSEEN))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


def path_ratios(paths: set[Path]) -> dict[Path, float]:
    """Fused ratio of each path: text and punctuation of its nodes, each against the page's greatest."""
    chars, marks = max(p.chars for p in paths), max(p.marks for p in paths)
    return {p: math.sqrt((p.chars + 1) / (chars + 1) * (p.marks + 1) / (marks + 1)) for p in paths}


def content_paths(paths: set[Path]) -> set[Path]:
    """Paths above the threshold, ratios smoothed down the paths and weighed with what words say."""
    ratio = path_ratios(paths)
    smooth: dict[Path, float] = {}

    def of(path: Path) -> float:
        chain = []
        while path is not None and path not in smooth:
            chain.append(path)
            path = path.parent
        known = smooth[path] if path is not None else 0.0
        for step in reversed(chain):
            known = smooth[step] = max(ratio.get(step, 0.0), known if step.side == 1.0 else 0.0)
        return known

    scores = {path: of(path) * path.share for path in paths}
    least = SHARE_OF_BEST * max(scores.values())
    if len({(p.chars, p.marks) for p in paths}) > 1:
        least = min(least, SPREAD * statistics.pstdev(ratio.values()))
    return {path for path, score in scores.items() if score >= least}


def main_text(page: str) -> str:
    found = nodes(page)
    if not found:
        return ""
    content = content_paths({path for path, _ in found})
    return "\n\n".join(text for path, text in found if path in content)


def with_main_text(df: DataFrame, page: str = "html", to: str = "text") -> DataFrame:
    """``df`` with the main text of each whole page in ``to`` and its code points in ``n_chars``."""

    @F.pandas_udf("text string, n_chars long")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(p) for p in batch]
            yield pd.DataFrame({"text": pd.Series(texts, dtype=object), "n_chars": pd.Series([len(t) for t in texts], dtype="int64")})

    return with_results(df, extracted(text_or_empty(page)), ["text", "n_chars"], [to, "n_chars"])
