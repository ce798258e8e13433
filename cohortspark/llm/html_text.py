"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is read once into blocks of words and the tags between them; elements that are boilerplate by their kind (menus,
page headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) are left out whole. What
remains is a sequence in which words score positive and tags negative, by weights from labelled pages; one linear scan
finds the contiguous region with the highest sum. Each ``article`` or ``main`` element that the region reaches into is
added in full, so a short paragraph at its edge is not lost; one inside another is a part of it. Nothing of the region is
left out.

Labelled pages are those whose markup names their article (``article`` or ``main``), together with a few built-in ones.
Weights are smoothed log ratios of how often words of a context, or tags of a name, stand inside and outside, counted
over all pages; the features are kinds of tags, so their number is bounded.

Defined results: a null or empty page, or one without words, has an empty text; character references are decoded;
white space inside a block becomes one space; blocks follow in page order, joined by two line feeds; nothing else is
dropped, and no length is limited. Text outside any tag is a block too. Repeated pages get equal texts. Columns besides
the named ones pass through unread.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
SPACE = frozenset("br td th img".split())
CONTAINERS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KNOWN = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot"
    " thead tr ul".split()
)
# Elements that hold no part of an article, whatever their attributes.
DROPPED = frozenset(
    "head script style noscript template iframe object embed svg canvas math nav footer aside form button select datalist textarea"
    " option dialog menu noembed noframes xmp map audio video title".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# Words of class and id attributes that name boilerplate.
DROPPED_NAMES = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs masthead footer sidebar aside ad ads adv advert adverts advertisement"
    " advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup"
    " modal overlay newsletter subscribe subscription signup login register share sharing social related recommended recommendations"
    " comment comments commentlist responses discussion disclaimer reply replies respond disqus pagination pager widget toolbar skip topbar header toc search form".split()
)
CONTENT_NAMES = frozenset("article content post entry main body text story".split())
# Parts of run-together names.
DROPPED_INSIDE = ("cookie", "advert", "sponsor", "newsletter", "breadcrumb", "navbar", "popup", "subscrib", "banner")
PARTLY = frozenset("header sidebar".split())
DENYING = frozenset("has have with without no not is".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>", re.DOTALL
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PARTS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    tag: str = "body"
    container: int = -1
    inside: bool = False
    linked: int = 0
    tags: list[str] = field(default_factory=list)  # tags since the block before
    text: str = ""
    words: int = 0


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(source)}


def is_dropped(tag: str, source: str, within: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not within):
        return True
    if not source or source.isspace():
        return False
    got = attributes(source)
    if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(got.get("style", "").lower()):
        return True
    if got.get("role", "").lower() in DROPPED_ROLES:
        return True
    if tag in ("html", "body") or tag in CONTAINERS and not within:
        return False
    named = f"{got.get('class', '')} {got.get('id', '')}".lower()
    return any(is_boilerplate_name(x) for x in named.split())


def is_boilerplate_name(name: str) -> bool:
    """Whether a class or id names boilerplate; ``has-sidebar`` or ``article-header`` name what holds the article."""
    parts = _NAME_PARTS.findall(name)
    if not parts or parts[0] in DENYING:
        return False
    holds = any(p in CONTENT_NAMES for p in parts)
    named = any(p in DROPPED_NAMES and not (holds and p in PARTLY) for p in parts)
    return named or any(x in name for x in DROPPED_INSIDE)


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page without boilerplate elements, with the tags before each."""
    out: list[Block] = []
    now = Block()
    stack: list[tuple[str, bool, int]] = []  # tag, dropped, number of the outermost container
    dropped = links = containers = 0
    at, n = 0, len(page)

    def close_block() -> None:
        nonlocal now
        now.text = " ".join("".join(now.parts).split())
        if now.text:
            now.words = now.text.count(" ") + 1
            out.append(now)
            now = Block()
        now.parts = []
        now.linked = 0
        now.tag = next((t for t, _, _ in reversed(stack) if t not in INLINE), "body")
        now.container = stack[-1][2] if stack else -1
        now.inside = now.container >= 0

    def pop_to(k: int) -> None:
        nonlocal dropped, links
        while len(stack) > k:
            tag, gone, _ = stack.pop()
            dropped -= gone
            links -= tag == "a"

    def words(text: str) -> None:
        if text and not dropped:
            text = entities.unescape(text)
            now.parts.append(text)
            if links:
                now.linked += len(text.split())

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            words(page[at:])
            break
        words(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing, source = m[2].lower(), bool(m[1]), m[3]
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            continue
        block = tag not in INLINE and tag not in SPACE
        if tag in SPACE and not dropped:
            now.parts.append(" ")
        if closing:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            if k >= 0:
                pop_to(k)
        elif tag not in VOID:
            if block:
                # A new paragraph, item or row ends an open one of its kind in the same list, table or page.
                ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "option": ("option",)}.get(tag, ())
                for k in range(len(stack) - 1, -1, -1):
                    name = stack[k][0]
                    if name == "p" or name in ends:
                        pop_to(k)
                        break
                    if name not in INLINE:
                        break
            held = stack[-1][2] if stack else -1
            gone = is_dropped(tag, source, held >= 0)
            if tag in CONTAINERS and not (gone or dropped):
                held, containers = (containers, containers + 1) if held < 0 else (held, containers)
            stack.append((tag, gone, held))
            dropped += gone
            links += tag == "a"
        if block:
            if not dropped:
                now.tags.append(tag if tag in KNOWN else "other")
            close_block()
    stack.clear()
    close_block()
    return out


@dataclass
class Weights:
    word: dict[str, float]
    tag: dict[str, float]
    link: float

    def of(self, b: Block) -> float:
        tag = b.tag if b.tag in KNOWN else "other"
        return (b.words - b.linked) * self.word.get(tag, 0.5) + b.linked * self.link

    def before(self, b: Block) -> float:
        return sum(self.tag.get(t, -0.2) for t in b.tags)


def counts_of(page: str) -> Counter:
    """(feature, inside) counts of a labelled page; nothing for a page that does not name its article."""
    blocks = blocks_of(page)
    out: Counter = Counter()
    if not any(b.inside for b in blocks):
        return out
    for b in blocks:
        tag = b.tag if b.tag in KNOWN else "other"
        out[f"word {tag}", b.inside] += b.words - b.linked
        out["link", b.inside] += b.linked
        for t in b.tags:
            out[f"tag {t}", b.inside] += 1
    return out


# Built-in labelled pages: how articles and their surroundings commonly look.
SEED_PAGES = (
    "<body><div><a>w</a> <a>w</a></div><ul><li><a>w w</a></li><li><a>w</a></li></ul><article><h1>w w w</h1>"
    + "<p>w w w w w w w w w w w w w w w w w w w w w w w w</p>" * 4
    + "<h2>w w</h2><ul><li>w w w w w w w</li></ul><blockquote>w w w w w w w w</blockquote><pre>w w w w w</pre>"
    + "<table><tr><td>w w</td><td>w</td></tr></table></article><div><a>w w</a></div><ul><li><a>w</a></li></ul><div>w w</div></body>",
    "<body><div>w w</div><table><tr><td><a>w</a></td></tr></table><main><section><h2>w w w</h2>"
    + "<div>w w w w w w w w w w w w w</div>" * 2
    + "<p>w w w w w w w w w w w w w w w w</p></section></main><div><a>w</a></div><p>w w <a>w</a></p></body>",
)
SEED_WEIGHT = 20


def weights_of(counts: Counter) -> Weights:
    """Words never score below 0.1 and tags never above -0.02, so a region is held together by its words alone."""
    inside_all = sum(n for (f, i), n in counts.items() if i and f.startswith("word")) + 1.0
    outside_all = sum(n for (f, i), n in counts.items() if not i and f.startswith("word")) + 1.0
    tags_in = sum(n for (f, i), n in counts.items() if i and f.startswith("tag")) + 1.0
    tags_out = sum(n for (f, i), n in counts.items() if not i and f.startswith("tag")) + 1.0

    def ratio(f: str, a: float, b: float) -> float:
        return math.log((counts[f, True] + 1.0) / a) - math.log((counts[f, False] + 1.0) / b)

    names = {f for f, _ in counts}
    word = {f[5:]: min(max(0.5 + 0.25 * ratio(f, inside_all, outside_all), 0.1), 2.0) for f in names if f.startswith("word ")}
    tag = {f[4:]: max(min(0.3 * (ratio(f, tags_in, tags_out) - 2.0), -0.02), -4.0) for f in names if f.startswith("tag ")}
    for t in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
        tag[t] = max(tag.get(t, -0.05), -0.05)
    link = min(max(0.3 + 0.25 * ratio("link", inside_all, outside_all), 0.1), 1.0)
    return Weights(word, tag, link)


def best_region(blocks: list[Block], weights: Weights) -> tuple[int, int]:
    """[first, end) of the blocks with the highest sum; the leftmost, then the longest, of equal ones."""
    best, region = 0.0, (0, 0)
    total, first = 0.0, 0
    for k, b in enumerate(blocks):
        if total + weights.before(b) <= 0:
            total, first = 0.0, k
        else:
            total += weights.before(b)
        total += weights.of(b)
        if total >= best:
            if total > best or region[0] == first:
                region = (first, k + 1)
            best = total
    return region


def main_text(page: str | None, weights: Weights) -> str:
    blocks = blocks_of(page or "")
    first, end = best_region(blocks, weights)
    while 0 < first and blocks[first - 1].tag in HEADINGS and not blocks[first - 1].linked:
        first -= 1  # a title is short, but it belongs to the text that follows
    reached = {b.container for b in blocks[first:end] if b.inside}
    return "\n\n".join(b.text for k, b in enumerate(blocks) if first <= k < end or b.container in reached)


def fit(pages: DataFrame, html: str = "html") -> Weights:
    """Weights from all labelled pages of the table and the built-in ones; a few hundred counts reach the driver."""

    def run(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in data:
            total: Counter = Counter()
            for page in batch.column(0).to_pylist():
                total.update(counts_of(page or ""))
            keys = sorted(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f for f, _ in keys], pa.string()),
                    pa.array([i for _, i in keys], pa.bool_()),
                    pa.array([total[k] for k in keys], pa.int64()),
                ],
                names=["feature", "inside", "n"],
            )

    counted = pages.select(html).mapInArrow(run, "feature string, inside boolean, n long")
    counts: Counter = Counter()
    for page in SEED_PAGES:
        counts.update({k: n * SEED_WEIGHT for k, n in counts_of(page).items()})
    for r in counted.groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect():
        counts[r["feature"], r["inside"]] += r["n"]
    return weights_of(counts)


def extract(pages: DataFrame, weights: Weights, html: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``carry`` columns of every page and its main ``text``."""
    slim = pages.select(*carry, F.col(html).alias("_html"))
    fields = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in carry)

    def run(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in data:
            texts = [main_text(p, weights) for p in batch.column(len(carry)).to_pylist()]
            columns = [batch.column(k) for k in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*carry, "text"])

    return slim.mapInArrow(run, f"{fields}, text string")
