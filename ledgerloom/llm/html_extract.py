"""Main text of web pages by two passes of block rules.

A page is cut into blocks (runs of text between block-level tags). Pass one
decides the clear cases from stop-word density, length and link density, and
from where a block stands: what is inside menus, headers, footers, sidebars,
forms, notices, adverts or reader comments is dropped whatever it says. Pass two
gives each undecided, short block the label of its nearest decided neighbours
in the same container; between a kept and a dropped one at the same distance
the kept one wins, and without any the container decides: an article or main
element keeps, the bare page drops.

Results for odd input: a null or empty page, or one without main text, has text
'' and n_chars 0; repeated rows give repeated rows; an empty table gives an
empty table; only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

# Elements by what they do to blocks.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noframes ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
SILENT = frozenset("head script style noscript template svg math canvas object embed audio video map iframe noembed noframes".split())
ASIDE = frozenset("nav header footer aside form menu dialog button select option datalist fieldset label input textarea search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset("article main".split())
CLOSES_P = BLOCK - {"body", "html", "option", "optgroup", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}
# Words in class, id or role that name what is not main text.
NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside complementary contentinfo comment comments disqus replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations toolbar widget pagination pager skip search form copyright legal disclaimer".split())
# Frequent function words of the four languages.
STOP = frozenset(
    "the of and to a in is it that for on with as was be by this are or from at an not have has but his her they you we "
    "le la les de des du un une et en que qui dans pour par sur au aux ce est pas plus ne se sont avec "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat "
    "el los las del y que se por con para una su al lo como más pero sus es no".split()
)
#: A block this long (code points) is decided by its stop words; a shorter one with links only by its links.
LONG = 70
STOPS = 0.18
LINKS = 0.5

_TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|</[^>]*>", re.S)
_NAME = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    """box: the container's place in the page; dropped: stands in what is no main text."""

    box: int
    main: bool
    dropped: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""

    def close(self) -> bool:
        self.text = " ".join("".join(self.parts).split())
        return bool(self.text)


def _names(attributes: str) -> bool:
    """Whether class, id or role name a part that is not main text."""
    for m in _NAME.finditer(attributes):
        for word in m[1].strip("\"'").split():
            if not NAMES.isdisjoint(_PART.findall(_CAMEL.sub(" ", word).lower())):
                return True
    return False


def blocks_of(page: str) -> list[Block]:
    """The non-empty blocks in page order."""
    out: list[Block] = []
    # Open elements: name, block box, whether in main, dropped, silent, in a link.
    stack: list[tuple[str, int, bool, bool, bool, bool]] = []
    # Places in the stack of each name, of block elements, and of those that no left-out end tag reaches over.
    places: defaultdict[str, list[int]] = defaultdict(list)
    block_places, walls = [], []
    box, boxes, main, dropped, silent, link = 0, 0, False, False, False, False
    block = Block(0, False, False)

    def ended() -> None:
        nonlocal block
        if block.parts and block.close():
            out.append(block)
        block = Block(box, main, dropped)

    def pop_to(i: int) -> None:
        nonlocal box, main, dropped, silent, link
        _, box, main, dropped, silent, link = stack[i]
        for x in stack[i:]:
            places[x[0]].pop()
        del stack[i:]
        broke = bool(block_places) and block_places[-1] >= i
        for kept in (block_places, walls):
            while kept and kept[-1] >= i:
                kept.pop()
        if broke:
            ended()

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else size]
        if text and not silent:
            text = entities.unescape(text)
            block.parts.append(text)
            if link:
                block.linked += len("".join(text.split()))
        if not m:
            break
        at = m.end()
        if not (name := (m[2] or "").lower()):
            continue
        if m[1]:
            if name == "br":
                block.parts.append(" ")
            # A stray end tag of a phrase does not close the blocks around it.
            if places[name] and (name in BLOCK or not block_places or places[name][-1] > block_places[-1]):
                pop_to(places[name][-1])
            continue
        if name in ("br", "wbr", "img", "hr") or name in VOID:
            if name == "hr":
                ended()
            elif name != "wbr":
                block.parts.append(" ")
            continue
        # HTML lets these end tags be left out.
        closes = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(name, ())
        closes += ("p",) if name in CLOSES_P else ()
        if name == "body":
            closes += ("head",)
        open_ = max((places[c][-1] for c in closes if places[c]), default=-1)
        if open_ >= 0 and (not walls or open_ >= walls[-1]):
            pop_to(open_)
        attributes = m[3] or ""
        places[name].append(len(stack))
        if name in BLOCK:
            block_places.append(len(stack))
            if name not in ("p", "td", "th", "head"):
                walls.append(len(stack))
        stack.append((name, box, main, dropped, silent, link))
        in_article = main
        if name in BLOCK:
            boxes += 1
            if name in MAIN or name in ("section", "div", "body", "td") and not main:
                box = boxes
        main = main or name in MAIN
        # An article's own header holds its title; the page's header does not.
        named = bool(attributes) and (_names(attributes) or bool(_HIDDEN.search(attributes)))
        dropped = dropped or (name in ASIDE and not (name == "header" and in_article)) or (named and name not in ("html", "body", "main"))
        silent = silent or name in SILENT
        link = link or name == "a"
        if name in BLOCK:
            ended()
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if not silent and not dropped and name != "title":
                block.parts.append(page[at : end.start() if end else size])
            at = end.start() if end else size
        elif attributes.endswith("/") and name in SILENT:
            pop_to(len(stack) - 1)
    ended()
    return out


def first_pass(b: Block) -> bool | None:
    """True: main text; False: not; None: undecided."""
    if b.dropped:
        return False
    solid = len(b.text.replace(" ", ""))
    if b.linked > LINKS * solid and not (b.main and len(b.text) >= LONG):
        return False if not b.main else None
    if len(b.text) >= LONG:
        words = [w.strip(".,;:!?\"'()«»").lower() for w in b.text.split()]
        density = sum(w in STOP for w in words) / len(words)
        # Inside an article a long block is main text in any style; outside it must read like prose.
        if b.main or density >= STOPS:
            return True
        return None if density >= STOPS / 3 else False
    return None


def second_pass(blocks: list[Block], decided: list[bool | None]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided block of the same container."""
    far = len(blocks) + 1
    label: list[bool] = []
    before: dict[int, dict[bool, int]] = {}
    after: list[dict[bool, int]] = [{}] * len(blocks)
    seen: dict[int, dict[bool, int]] = {}
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        after[i] = dict(seen.get(b.box, {}))
        # What stands aside (a notice within the article) says nothing about its neighbours.
        if decided[i] is not None and not b.dropped:
            seen.setdefault(b.box, {})[decided[i]] = i
    for i, b in enumerate(blocks):
        if decided[i] is not None:
            label.append(decided[i])
            if not b.dropped:
                before.setdefault(b.box, {})[decided[i]] = i
            continue
        near = {v: min(abs(i - before.get(b.box, {}).get(v, -far)), abs(after[i].get(v, far + len(blocks)) - i)) for v in (True, False)}
        if min(near.values()) >= far:
            label.append(b.main)
        else:
            label.append(near[True] <= near[False])
    return label


def main_text(page: str | None) -> str:
    """The main text of a whole page: blocks in page order, joined by line feeds."""
    blocks = blocks_of(page or "")
    labels = second_pass(blocks, [first_pass(b) for b in blocks])
    if any(b.main and keep for b, keep in zip(blocks, labels, strict=True)):
        # The page names its article: text elsewhere on it is not part of it.
        labels = [keep and b.main for b, keep in zip(blocks, labels, strict=True)]
    return "\n".join(b.text for b, keep in zip(blocks, labels, strict=True) if keep)


def _page_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    return pages.select("page_id", "url", "html").mapInArrow(_page_batches, "page_id long, url string, text string, n_chars long")


def op8_html_blocks(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
