"""Main-text extraction by tag-path ratios.

A page is read into text blocks, each with its path of tags and classes from the root. Per path, text length and
punctuation are aggregated to two ratios, the mean of both over the path's blocks (a block counts as full from 100
characters and five marks on); link text counts for neither. Their geometric mean, times the path's prior weight, is its
raw score. Scores are smoothed over neighbouring paths: half of a path's score is its own, half that of its container,
the mean over the paths in it weighted by their text, or part of what the containers around it and in it have. A path is
content if its smoothed score reaches a part of the page's mean score, again weighted by text. So every decision follows
from ratios: without them no path is content.

Structure is a prior weight only: elements that are called menus, notices, adverts or comments, and forms, weigh less,
which leaves a page whose whole text lies in such an element alone; text beside an article that holds most of the page
weighs less, main headings weigh more. Elements that HTML defines as something else than main text (nav, footer, aside
and their roles) have no weight.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Part of the page's text that an article has to hold for text beside it to weigh less.
MOST = 0.5
#: How much the container's score counts in a path's, how much of a container's score its neighbours get, and the part of the page's mean score that makes a path content.
SMOOTH, OUTWARD, CONTENT = 0.5, 0.5, 0.4
#: Characters and marks (and one) from which on a block is full text: more says no more about its density.
FULL = (100, 6)
#: Elements below this many others share a path, so that paths stay short; their text is read all the same.
DEEPEST = 100
#: Prior weights: of a main heading, of links that stand in the page's body itself, of forms and of elements named as no main text, of text beside an article.
HEADING, LINKS, NAMED, BESIDE = 1.5, 0.5, 0.05, 0.5

#: HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav noframes ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template iframe svg object canvas textarea title xmp noembed".split())
#: Elements and roles that are something else than main text by HTML's and ARIA's definitions; a header only outside an article.
OTHER_TAGS = frozenset("head nav footer aside button select dialog menu datalist audio video".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar form".split())
#: Words by which authors name such elements, and words that may stand beside them in a name.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer header masthead "
    "cookie cookies consent notice notices banner popup modal newsletter subscribe login signup share sharing social related recommended comment comments disqus discussion replies "
    "pagination pager search widget toolbar copyright disclaimer".split()
)
BESIDE_NAMES = frozenset("list item items box block bar area section container wrapper wrap inner outer link links button buttons icons text title message body thread post posts left right top bottom site page global fixed sticky layout results row panel module slot".split())
CONTAINERS = frozenset("html body article main section div td center".split())
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[a-z0-9]+")
_DIGITS = re.compile(r"\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[,.;:!?…،。，、؛؟]")
_HEADING = re.compile("h[1-6]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_FENCES = frozenset("html body article main section div table td th ul ol dl blockquote aside nav header footer form fieldset figure details dialog".split())


def _named(value: str) -> bool:
    """Whether a class or an id says that its element is no main text: by such words and by-words alone."""
    for one in value.split():
        words = set(_WORDS.findall(_CAMEL.sub(" ", one).lower()))
        if words & NAMES and not words - NAMES - BESIDE_NAMES:
            return True
    return False


def _read_tag(tag: str, attributes: str, inside: bool) -> tuple[str, float, bool]:
    """An element's name in paths, its prior weight, and whether it is an article or main part."""
    name, weight, article = tag, 0.0 if tag in OTHER_TAGS or tag == "header" and not inside else NAMED if tag == "form" else 1.0, tag in ("article", "main")
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or key == "style" and _HIDDEN.search(value) or key == "role" and value.strip().lower() in OTHER_ROLES:
                weight = 0.0
            elif key == "role" and value.strip().lower() == "main":
                article = True
            elif key in ("class", "id"):
                name += "".join(f".{x}" for x in _DIGITS.sub("", value.replace("/", "")).split())
                if tag not in ("html", "body", "main") and not _HEADING.fullmatch(tag) and _named(value):
                    weight *= NAMED
    return name, weight, article


@dataclass(frozen=True)
class Place:
    """An open element: its tag, its path, the path of its container, its prior weight, the outermost article or main
    part it is in (empty if none), and whether it is a link."""

    tag: str
    path: str
    container: str
    weight: float
    article: str
    link: bool


def blocks(html: str) -> list[tuple[Place, str, int]]:
    """Text blocks in page order: (place, text, characters of it in links). Unclosed and stray tags are borne; what a
    page doesn't show (scripts, hidden elements, elements without weight) is left out. Text of a named element inside
    a paragraph is a block of its own."""
    found: list[tuple[Place, str, int]] = []
    stack = [Place("", "", "", 1.0, "", False)]
    running: dict[float, list] = {}  # by weight: place, pieces, link characters

    def flush() -> None:
        for place, pieces, linked in running.values():
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                found.append((place, text, min(linked, len(text))))
        running.clear()

    def add(text: str) -> None:
        top = stack[-1]
        if not top.weight:
            return
        if top.weight not in running:
            if not text.strip():
                return
            running[top.weight] = [top, [], 0]
        running[top.weight][1].append(text)
        if top.link:
            running[top.weight][2] += len(text.strip())

    def close(names: tuple[str, ...], fences: frozenset[str] = frozenset()) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                del stack[k:]
                return
            if stack[k].tag in fences:
                return

    at, end = 0, len(html)
    for_raw: dict[str, re.Pattern] = {}
    while at < end:
        m = _MARKUP.search(html, at)
        if not m:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        if tag in BLOCK:
            flush()
        if m[1] or m[4]:
            close((tag,), _FENCES if tag not in _FENCES else frozenset())
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW and not attributes.rstrip().endswith("/"):
            stop = for_raw.setdefault(tag, re.compile(f"</{tag}(?=[\\s/>]|\\Z)[^>]*>?", re.I)).search(html, at)
            at = stop.end() if stop else end
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:
            close(("p",), _FENCES)
        if tag in _CLOSES:
            close(_CLOSES[tag], frozenset(("ul", "ol", "dl", "table", "select")))
        top = stack[-1]
        name, weight, article = _read_tag(tag, attributes, bool(top.article))
        path = f"{top.path}/{name}" if len(stack) <= DEEPEST else top.path
        stack.append(Place(tag, path, path if tag in CONTAINERS else top.container, top.weight * weight, top.article or (path if article else ""), top.link or tag == "a"))
    flush()
    return found


def _above(path: str) -> list[str]:
    """A path and all paths above it, outermost first."""
    steps = path.split("/")
    return ["/".join(steps[:k]) for k in range(2, len(steps) + 1)]


def ratios(found: list[tuple[Place, str, int]]) -> dict[str, tuple[Place, float, float]]:
    """Per path: one place on it, its raw score (both ratios fused, times its prior weight), and its mass, the weighted
    characters that are no link."""
    sums: dict[str, list] = {}
    for place, text, linked in found:
        free = 1 - linked / len(text)
        at = sums.setdefault(place.path, [place, 0, 0.0, 0.0, 0.0])
        at[1] += 1
        at[2] += min(len(text), FULL[0]) * free
        at[3] += min(1 + len(_PUNCTUATION.findall(text)), FULL[1]) * free
        at[4] += len(text) * free * place.weight
    return {path: (place, math.sqrt(length / n * marks / n) * place.weight, mass) for path, (place, n, length, marks, mass) in sums.items()}


def smoothed(scores: dict[str, tuple[Place, float, float]]) -> dict[str, float]:
    """Scores of paths with those of their neighbours: each container has the mean of the paths that stand in it by mass;
    from it, OUTWARD goes to the container around it, then to those in it, in the measure of their prior weights."""
    total, mass, weight = {"": 0.0}, {"": 0.0}, {"": 0.0}
    for place, score, m in scores.values():
        for c in ["", *_above(place.container)] if place.container else [""]:
            weight[c] = max(weight.get(c, 0.0), place.weight)
        total[place.container] = total.get(place.container, 0.0) + m * score
        mass[place.container] = mass.get(place.container, 0.0) + m
    own = {c: total[c] / mass[c] if mass.get(c) else 0.0 for c in weight}
    for c in sorted(own, key=lambda c: -c.count("/")):
        if c:
            around = _around(c, own)
            own[around] = max(own[around], OUTWARD * own[c])
    for c in sorted(own, key=lambda c: c.count("/")):
        if c:
            around = _around(c, own)
            own[c] = max(own[c], OUTWARD * own[around] * weight[c] / weight[around])
    return {path: (1 - SMOOTH) * score + SMOOTH * own[place.container] * place.weight / weight[place.container] for path, (place, score, _) in scores.items()}


def _around(container: str, among: dict[str, float]) -> str:
    above = container.rpartition("/")[0]
    while above not in among:
        above = above.rpartition("/")[0]
    return above


def main_text(html: str | None) -> str:
    """Main text of a page, one line per block; empty if there is none."""
    found = blocks(html) if html else []
    if not found:
        return ""
    scores = ratios(found)
    page = sum(m for _, _, m in scores.values())
    if not page:
        return ""
    articles: dict[str, float] = {}
    links: dict[str, list[int]] = {}
    for place, text, linked in found:
        free = len(text) - linked
        if place.article:
            articles[place.article] = articles.get(place.article, 0.0) + free * place.weight
        at = links.setdefault(place.path, [0, 0])
        at[0] += linked
        at[1] += len(text)
    article = max((a for a, m in articles.items() if m > MOST * page), default=None)
    bar = CONTENT * sum(m * score for _, score, m in scores.values()) / page
    content = {}
    for path, score in smoothed(scores).items():
        place = scores[path][0]
        if place.container.rpartition("/")[2].split(".")[0] in ("", "html", "body"):
            score *= 1 - LINKS * links[path][0] / links[path][1]
        if place.article != article and article is not None:
            score *= BESIDE
        if place.tag == "h1" and place.article != article:
            score *= HEADING
        content[path] = score > 0 and score >= bar * (1 - 1e-9)
    return "\n".join(text for place, text, _ in found if content[place.path])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null and empty pages have empty text; whole pages are read whatever their size; a page of links alone has
    no main text; paths that tie at the bar are content; repeated rows each give a row; an empty table gives no rows; other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string").select("*", F.length("text").cast("long").alias("n_chars"))
