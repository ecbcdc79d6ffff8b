"""Main text of web pages by consensus of the pages of a host.

Every page scores its containers: a block's characters outside links count for the containers around it, less
with each level. The best container's path of generalised tags and classes (``body/div.post-#/article``) is the page's vote; votes of
a task are added up before the shuffle, so a host of a third of all pages is a row per task and path. Each host's
``PATHS`` most voted paths are the feature's result; every page is then read again and its
text taken from the first of them that it has, from its own best container where it has none. The
votes are a written table, so Spark broadcasts them by their measured size or joins by host.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmill.session import cut_lineage

PATHS = 3
FADE = 0.7  # share of a block's score that passes on to the next container outward
HELD = 10_000  # votes that a task adds up before it hands them on
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>", re.S
)
NAMES = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
RAW = frozenset("script style noscript template iframe svg math textarea title object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr img".split()
)
DROPPED_TAGS = frozenset("nav aside form footer button select option menu dialog head fieldset input".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations breadcrumb breadcrumbs sidebar widget nav navbar navigation menu toolbar comment comments commentlist "
    "reply replies respond disqus discussion pagination pager footer copyright masthead topbar skip tracking".split()
)
CLOSED_BY = {  # an opening tag ends these, unless one of the stops lies between
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}


@dataclass
class Box:
    """An element that is not inline."""

    tag: str
    path: str
    up: Box | None
    dropped: bool
    score: float = 0.0
    items: int = 0  # list items
    chars: int = 0
    linked: int = 0


@dataclass
class Block:
    text: str
    box: Box


@dataclass
class Page:
    boxes: list[Box] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def _named(attributes: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in NAMES.finditer(attributes)} if attributes else {}


def _words(name: str) -> set[str]:
    return {w.lower() for w in PART.findall(name)}


def _is_dropped(tag: str, names: dict[str, str], in_article: bool) -> bool:
    if tag in DROPPED_TAGS or (tag == "header" and not in_article) or "hidden" in names or names.get("aria-hidden") == "true":
        return True
    if tag in ("body", "html", "article", "main") and "comment" not in names.get("class", ""):
        return False
    if re.search(r"display\s*:\s*none", names.get("style", "")) or names.get("role", "").lower() in DROPPED_ROLES:
        return True
    words = _words(f"{names.get('class', '')} {names.get('id', '')}")
    return bool(words & DROPPED_WORDS) or ("header" in words and not in_article and tag != "h1")


def general(tag: str, names: dict[str, str]) -> str:
    """Tag and classes, numbers as #."""
    classes = sorted({re.sub(r"[0-9]+", "#", c.lower()) for c in names.get("class", "").replace("/", " ").split()})
    return ".".join([tag, *classes])


class Reader:
    """Boxes and text blocks of one page, in page order."""

    def __init__(self, text: str):
        self.page, self.parts, self.size, self.linked = Page(), [], 0, 0
        self.stack: list[tuple[str, Box | None]] = []  # inline elements have no box
        self.box = Box("", "", None, False)
        self.links = 0
        at = 0
        while (m := TOKEN.search(text, at)) is not None:
            self._text(text[at : m.start()])
            at = m.end()
            close, tag = m[1] or m[4], (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if close:
                self._close(tag)
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(text, at)
                at = len(text) if end is None else end.end()
            else:
                self._open(tag, m[3] or m[6] or "")
        self._text(text[at:])
        self._flush()

    def _text(self, raw: str) -> None:
        if raw and not self.box.dropped:
            plain = html.unescape(raw)
            self.parts.append(plain)
            if self.links:
                self.linked += len(plain.strip())

    def _flush(self) -> None:
        text, linked = " ".join("".join(self.parts).split()), self.linked
        self.parts, self.linked = [], 0
        if not text:
            return
        self.page.blocks.append(Block(text, self.box))
        worth, box = max(0.0, len(text) - 2.0 * linked), self.box
        if box.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "td", "dd", "dt") and box.up is not None:
            box.chars, box.linked, box = box.chars + len(text), box.linked + linked, box.up
        while box is not None:
            box.score += worth
            box.chars, box.linked = box.chars + len(text), box.linked + linked
            worth, box = worth * FADE, box.up

    def _pop(self, to: int) -> None:
        while len(self.stack) > to:
            tag, box = self.stack.pop()
            if tag == "a":
                self.links = max(0, self.links - 1)
            if box is not None:
                self._flush()
                self.box = box.up

    def _ends(self, tags: set[str], stops: set[str]) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                self._pop(i)
            elif self.stack[i][0] in stops:
                break

    def _open(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag in ("br", "hr", "img", "input"):
                self.parts.append(" ")
            return
        if tag in INLINE:
            names = _named(attributes)
            if "hidden" not in names and "none" not in names.get("style", ""):
                self.links += tag == "a"
                self.stack.append((tag, None))
                return
        self._flush()
        if any(t == "p" for t, _ in self.stack) and tag not in INLINE:
            self._ends({"p"}, {"td", "th", "button", "table", "article", "section", "div", "li"})
        if tag in CLOSED_BY:
            self._ends(*CLOSED_BY[tag])
        names = _named(attributes)
        up = self.box
        inside = any(t == "article" for t, _ in self.stack)
        step = general(tag, names)
        path = step if tag in ("html", "body") else f"{up.path}/{step}" if up.path and up.tag != "html" else step
        self.box = Box(tag, path, up, up.dropped or _is_dropped(tag, names, inside))
        if tag == "li":
            up.items += 1
        self.stack.append((tag, self.box))
        self.page.boxes.append(self.box)

    def _close(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._pop(i)
                return
            if tag in INLINE and self.stack[i][1] is not None:
                return  # an inline end tag does not end blocks
        if tag == "p":
            self._flush()


def read_page(text: str | None) -> Page:
    return Reader(text).page if text else Page()


def _is_menu(box: Box) -> bool:
    return box.tag in ("ul", "ol") and box.items >= 3 and box.linked >= 0.9 * box.chars > 0


def best_box(page: Page) -> Box | None:
    """The container with the highest score; of equal ones the innermost."""
    able = [b for b in page.boxes if not b.dropped and b.score > 0 and b.tag not in ("html", "p")]
    return max(enumerate(able), key=lambda x: (x[1].score, x[0]))[1] if able else None


def _text_in(page: Page, wanted: set[int]) -> str:
    """Blocks inside the wanted boxes (by identity), without dropped boxes and menus."""
    keep: dict[int, bool] = {}

    def inside(box: Box) -> bool:
        chain, state = [], False
        while box is not None:
            if id(box) in keep:
                state = keep[id(box)]
                break
            chain.append(box)
            box = box.up
        for b in reversed(chain):
            state = (state or id(b) in wanted) and not b.dropped and not _is_menu(b)
            keep[id(b)] = state
        return state

    return " ".join(b.text for b in page.blocks if inside(b.box))


def main_text(text: str | None, paths: list[str]) -> str:
    """Text of the first of ``paths`` that the page has with text, else of its best container, else of all its blocks."""
    page = read_page(text)
    for path in paths:
        wanted = {id(b) for b in page.boxes if b.path == path and not b.dropped}
        if wanted and (found := _text_in(page, wanted)):
            return found
    best = best_box(page)
    if best is not None and (found := _text_in(page, {id(best)})):
        return found
    return " ".join(b.text for b in page.blocks if not b.box.dropped)


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html", paths: int = PATHS) -> DataFrame:
    """``host, paths``: each host's most voted container paths, best first (ties: higher score, then path)."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes: dict[tuple[str, str], list[float]] = {}

        def handed() -> pa.RecordBatch:
            rows = [(host, path, int(n), score) for (host, path), (n, score) in votes.items()]
            votes.clear()
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = (pa.string(), pa.string(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["host", "path", "votes", "score"])

        for batch in batches:
            for host, text in zip(batch["host"].to_pylist(), batch["html"], strict=True):
                best = best_box(read_page(text.as_py()))
                if best is not None:
                    own = votes.setdefault((host, best.path), [0, 0.0])
                    own[0] += 1
                    own[1] += round(best.score)  # whole numbers: sums do not depend on their order
            if len(votes) > HELD:
                yield handed()
        yield handed()

    given = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    votes = given.mapInArrow(vote, "host string, path string, votes long, score double")
    votes = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("score"), "path")
    best = votes.withColumn("at", F.row_number().over(order)).where(F.col("at") <= paths)
    listed = best.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "path"))).alias("p"))
    return cut_lineage(listed.select("host", F.col("p.path").alias("paths")), "paths")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", paths: int = PATHS) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row.

    A null or empty page has the empty text; pages without a URL, or with one that has no host, vote together as the host ''. Repeated rows vote and
    are returned each; a null id stays null; an empty table gives no rows. Pages are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h.as_py(), p.as_py() or []) for h, p in zip(batch["html"], batch["paths"], strict=True)]
            size = pa.array([len(t) for t in text], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(text, pa.string()), size], ["page_id", "url", "text", "n_chars"])

    given = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"),
        host_of(F.col(url_col)).alias("host"),
    )
    known = given.join(host_paths(pages, url_col, html_col, paths), "host", "left").select("page_id", "url", "html", "paths")
    return known.mapInArrow(run, "page_id long, url string, text string, n_chars long")
