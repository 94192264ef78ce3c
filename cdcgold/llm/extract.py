"""Main text of HTML pages by tag-path ratios.

A page is cut into blocks of text; a block's path is the chain of block elements, with their first
class, from the root.  For every path the lengths, punctuation and link text of its blocks are
summed.  The ratio of a path is its mean text length, fused with its share of punctuation and of
text outside links; ratios are smoothed over neighbouring blocks, and blocks at or above the
threshold are content.  Their path's container is then taken but for link lists, elements that are
never article text (`AWAY`) and containers inside it whose ratio is far below.  A part whose class
says that it is no article is left out unless it holds half of the page's text by ratio.

Defined cases: a null or empty page, and one without text, gives the empty string; unclosed,
crossing and cut-off tags are read as browsers read them, near enough; repeated rows repeat.  Long
pages take time in proportion to their length: elements below `DEEPEST` others add no step to a path.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdcgold.llm.arrow import add_columns

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: Elements whose content is no markup or no text of the page.
OPAQUE = frozenset("script style textarea title noscript template iframe svg math object canvas audio video noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table caption thead tbody tfoot"
    " tr td th figure figcaption address header footer nav aside form fieldset legend details summary dialog menu center"
    " select option optgroup button label hgroup search".split()
)
#: A start tag closes these open elements, if nothing of the second set is between.
CLOSES = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"),
    "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tfoot tr td th", "table"),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
#: Elements that never hold article text.
AWAY = frozenset("nav footer aside form select option button menu dialog fieldset legend label search head".split())
#: Words in a class, id or role of parts that are not the article.
AWAY_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu"
    " breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent notice notices alert popup modal overlay"
    " newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus reply"
    " replies widget toolbar pagination pager complementary contentinfo search form copyright disclaimer gdpr paywall skip tags"
    " hidden".split()
)
#: What a class must not be judged by on elements that hold the article itself.
HOLDERS = frozenset("html body main article".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
HEADING = re.compile(r"h[1-6]$")
#: Steps of a path, and named elements around a block, that are told apart; browsers nest no deeper.
DEEPEST = 512


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int  # characters inside links
    away: bool
    named: tuple[int, ...] = ()  # elements around it whose class, id or role has one of AWAY_WORDS, by number


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}


def _is_away(tag: str, attrs: dict[str, str], inside_article: bool) -> bool:
    """By its element or as hidden; what only the words of its class say, the ratios must agree with."""
    if tag in AWAY or (tag == "header" and not inside_article):
        return True
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
        return True
    return tag == "article" and bool(_words(attrs) & {"comment", "comments", "reply"})


def _words(attrs: dict[str, str]) -> set[str]:
    return {w.lower() for k in ("class", "id", "role") for w in _PART.findall(attrs.get(k, ""))}


def _is_named(tag: str, attrs: dict[str, str]) -> bool:
    if tag == "p" or HEADING.match(tag):  # a part of a name tells the look of a line, not what it is
        return bool(set(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()) & AWAY_WORDS)
    return tag not in HOLDERS and bool(_words(attrs) & AWAY_WORDS)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    # tag, path, away, numbers of named elements around
    stack: list[tuple[str, tuple[str, ...], bool, tuple[int, ...]]] = []
    open_at: dict[str, list[int]] = defaultdict(list)  # by tag: its places in the stack
    known: dict[tuple[str, ...], tuple[str, ...]] = {}  # equal paths are kept once
    n_named = 0
    words: list[str] = []
    linked, link_depth = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(words)).split())
        if text:
            _, path, away, named = stack[-1] if stack else ("", (), False, ())
            out.append(Block(path, text, min(linked, len(text)), away, named))
        words.clear()
        linked = 0

    def cut(height: int) -> None:
        while len(stack) > height:
            open_at[stack.pop()[0]].pop()

    def pop(tags: frozenset[str] | set[str], until: frozenset[str]) -> None:
        """Close the open elements of `tags` that are inside the nearest one of `until`."""
        edge = max((open_at[t][-1] for t in until if open_at[t]), default=-1)
        places = [(open_at[t], bisect_right(open_at[t], edge)) for t in tags]
        cut(min((at[k] for at, k in places if k < len(at)), default=len(stack)))

    def say(text: str) -> None:
        nonlocal linked
        words.append(text)
        linked += len(text) if link_depth else 0

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            say(m["cdata"].replace("&", "&amp;"))
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag == "a":
                link_depth = max(0, link_depth - 1)
            elif tag in BLOCK:
                flush()
                if open_at[tag]:
                    cut(open_at[tag][-1])
                link_depth = 0
            continue
        if tag in OPAQUE:
            if not m["attrs"].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            words.append(" ")
        elif tag in ("br", "hr"):
            words.append(" ")
            if tag == "hr":
                flush()
        elif tag == "a":
            link_depth = 1
        elif tag in BLOCK:
            flush()
            link_depth = 0
            if tag in CLOSES:
                pop(*CLOSES[tag])
            elif tag not in ("html", "body"):
                pop({"p"}, frozenset({"td", "th", "table", "button"}))
                while HEADING.match(tag) and stack and HEADING.match(stack[-1][0]):
                    cut(len(stack) - 1)
            attrs = _attributes(m["attrs"]) if m["attrs"].strip() else {}
            inside = bool(open_at["article"] or open_at["main"])
            _, path, away, named = stack[-1] if stack else ("", (), False, ())
            away = away or _is_away(tag, attrs, inside)
            name = attrs.get("class", "").split()
            if _is_named(tag, attrs) and len(named) < DEEPEST:
                n_named += 1
                named = (*named, n_named)
            if len(path) < DEEPEST:
                path = (*path, f"{tag}.{name[0]}" if name else tag)
            open_at[tag].append(len(stack))
            stack.append((tag, known.setdefault(path, path), away, named))
    flush()
    return out


def _smooth(values: np.ndarray, width: int = 1) -> np.ndarray:
    kernel = np.exp(-(np.arange(-2 * width, 2 * width + 1) ** 2) / (2.0 * width * width))
    padded = np.pad(values, 2 * width, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


@dataclass
class PathRatio:
    blocks: int = 0
    chars: int = 0
    marks: int = 0
    linked: int = 0

    @property
    def value(self) -> float:
        """Mean length of a block, times punctuation and text outside links."""
        free = 1.0 - self.linked / max(1, self.chars)
        return self.chars / max(1, self.blocks) * (0.1 + min(1.0, 20.0 * self.marks / max(1, self.chars))) * free


def ratios(found: list[Block]) -> dict[tuple[str, ...], PathRatio]:
    out: dict[tuple[str, ...], PathRatio] = defaultdict(PathRatio)
    for b in found:
        r = out[b.path]
        r.blocks += 1
        r.chars += len(b.text)
        r.marks += len(PUNCTUATION.findall(b.text))
        r.linked += b.linked
    return out


def _without_named(found: list[Block]) -> list[Block]:
    """The blocks outside elements that are named as no article and hold less than half of the page's text.

    Text counts by its path's ratio, and where there is an article or main, only text inside it.
    """
    by_path = ratios(found)
    inside = {p for p in by_path if any(x.split(".")[0] in ("article", "main") for x in p)}
    size: dict[int, float] = defaultdict(float)
    whole = 0.0
    for b in found:
        weight = by_path[b.path].value * len(b.text) if b.path in inside or not inside else 0.0
        whole += weight
        for k in b.named:
            size[k] += weight
    return [b for b in found if all(2 * size[k] >= whole > 0 for k in b.named)]


def _apart(path: tuple[str, ...], best: tuple[str, ...]) -> tuple[str, ...]:
    """The innermost container on a path that is not on the content path; none if all are."""
    for i in range(len(path), 0, -1):
        if path[i - 1].split(".")[0] in ("div", "section", "center"):
            return path[:i] if path[:i] != best[:i] else ()
    return ()


def content(found: list[Block]) -> list[Block]:
    """The blocks of the main text."""
    kept = _without_named([b for b in found if not b.away])
    if not kept:
        return []
    by_path = ratios(kept)
    score = np.array([by_path[b.path].value for b in kept])
    smooth = _smooth(score)
    # the content path is that with most text, weighed by its ratio
    mass: dict[tuple[str, ...], float] = defaultdict(float)
    for b, s in zip(kept, score, strict=True):
        mass[b.path] += s * len(b.text)
    best = max(mass, key=lambda p: (mass[p], -len(p)))
    holder = _holder(best)
    limit = min(0.5 * by_path[best].value, smooth.max())
    parts: dict[tuple[str, ...], PathRatio] = defaultdict(PathRatio)
    part = {p: _apart(p, best) for p in by_path}
    for p, r in by_path.items():
        if part[p]:
            own = parts[part[p]]
            own.blocks, own.chars = own.blocks + r.blocks, own.chars + r.chars
            own.marks, own.linked = own.marks + r.marks, own.linked + r.linked
    poor = {k for k, r in parts.items() if r.value < 0.5 * limit}
    out, last_heading = [], None
    for b, own, around in zip(kept, score, smooth, strict=True):
        r = by_path[b.path]
        links_only = r.linked > 0.6 * r.chars and r.marks < 0.03 * r.chars
        inside = b.path[: len(holder)] == holder
        if inside and not links_only and part[b.path] not in poor:
            if last_heading is not None and not out:
                out.append(last_heading)
            out.append(b)
        elif not inside and not links_only and own >= limit and around >= limit and r.marks and _near(b.path, holder):
            out.append(b)
        elif not inside and not out and b.path and b.path[-1].split(".")[0] == "h1":
            last_heading = b
    return out


def _holder(path: tuple[str, ...]) -> tuple[str, ...]:
    """The nearest article or main around a path, else its parent."""
    for i in range(len(path), 0, -1):
        if path[i - 1].split(".")[0] in ("article", "main"):
            return path[:i]
    tail = {"p", "li", "ul", "ol", "blockquote", "td", "tr", "tbody", "table", "pre", "dd", "dl", "figure", "figcaption"}
    i = len(path)
    while i > 1 and path[i - 1].split(".")[0] in tail:
        i -= 1
    return path[:i]


def _near(path: tuple[str, ...], holder: tuple[str, ...]) -> bool:
    """Whether a path shares all but the last step of the holder."""
    return path[: len(holder) - 1] == holder[:-1]


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in content(blocks(page or "")))


def extract(pages: DataFrame, page: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))

    def texts(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        out = [main_text(x.as_py()) for x in batch.column("html")]
        return {"text": pa.array(out, pa.string()), "n_chars": pa.array(map(len, out), pa.int64())}

    return add_columns(rows, texts, "text string, n_chars long", "html", ["page_id", "url"])
