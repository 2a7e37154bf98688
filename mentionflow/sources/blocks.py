"""Elements of captured pages, selected by tag and class, with their nesting.

A page is a stream of tags and texts; a stack of open elements says where each one ends, by the rules of
HTML that decide it: void tags open nothing; a block tag ends an open ``p``; ``li``, ``dt``, ``dd``,
``option``, ``tr``, ``td`` and ``th`` end the one before in their list or table; a closing block tag ends all that
is open inside it; a closing inline tag ends its element only, and counts for nothing across a block; a
closing tag without an open element is ignored; the end of the page ends the rest. Every step costs the
same whatever is open (the last element of each kind is at hand), so a page takes time in proportion to its tags.

Pages are rows of Arrow batches: there is no shuffle, and a page is one row as it was captured. Scripts,
styles and comments have no text; entities stay as they are; an attribute's value may not hold ``<`` or ``>``."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean_text, long_enough
from ..operators.standardize import standardize_posts

# The elements that are post items on the captured site, in their order.
POST_SELECTORS = (
    "div[class*='AnonymousHome']",
    "div[class*='timeline-live']",
    "div[class*='TimelineItem_item_']",
    ".timeline__item",
    ".status-item",
    "article",
    "div.flow-item",
    "div.feed-item",
    "div[class*='item__']",
)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that inline tags don't reach across.
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hgroup html li main menu nav object ol option p pre section select summary table tbody td template tfoot th thead
title tr ul""".split())
#: Blocks whose opening tag ends an open p.
ENDS_P = BLOCK - frozenset("body button caption dialog head html object option select tbody td template tfoot th thead title tr".split())
#: An open p beyond one of these is not ended.
P_SCOPE = frozenset("button caption html object table td template th".split())
#: Opening tag: what it ends, and beyond which elements it doesn't.
IMPLIED = {
    "li": (("li",), ("ol", "ul", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
#: Inline elements that are ended alone, wherever they were opened.
FORMATTING = frozenset("a b big code em font i s small strike strong tt u".split())

EDGE = " \t\n\r\f"
HIDDEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<script\b[^>]*>.*?(?:</script\s*>|\Z)|<style\b[^>]*>.*?(?:</style\s*>|\Z)")
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>")
CLASS = re.compile(r"""(?i)\sclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
SELECTOR = re.compile(r"""([a-zA-Z][a-zA-Z0-9-]*)?(?:\.([\w-]+)|\[class\*=['"]?([^'"\]]+)['"]?\])?""")


def parse_selector(s: str) -> tuple[str | None, str | None, str | None]:
    """(tag, class, part of the class attribute) of ``tag``, ``.class``, ``tag.class`` or ``tag[class*='part']``."""
    m = SELECTOR.fullmatch(s.strip())
    if not m or not any(m.groups()):
        raise ValueError(f"selector {s!r}: only a tag, a class and a part of the class attribute are supported")
    return (m[1].lower() if m[1] else None, m[2], m[3])


def matches(selectors: Sequence[tuple], tag: str, classes: str) -> bool:
    return any((t is None or t == tag) and (c is None or c in classes.split()) and (p is None or p in classes) for t, c, p in selectors)


class _Open:
    """The open elements of a page. Those of each name, and of the groups that rules ask for, are stacks of their own."""

    def __init__(self):
        self.stack: list[list] = []  # [name, number in the stack, open, start of its text or None, tag number]
        self.of: dict[str, list] = {}

    def last(self, *names: str) -> int:
        """Number of the last open element of these names, -1 if there is none."""
        best = -1
        for n in names:
            own = self.of.get(n)
            while own and not own[-1][2]:
                own.pop()
            if own:
                best = max(best, own[-1][1])
        return best

    def push(self, name: str, entry: list):
        self.stack.append(entry)
        for key in (name, *(("#block",) if name in BLOCK else ()), *(("#scope",) if name in P_SCOPE else ())):
            self.of.setdefault(key, []).append(entry)

    def end_from(self, number: int) -> Iterator[list]:
        """End the elements from that number on, the inner ones first."""
        while len(self.stack) > number:
            e = self.stack.pop()
            if e[2]:
                e[2] = False
                yield e


def page_elements(html: str, selectors: Sequence[tuple]) -> list[tuple[int, str, str]]:
    """(number of the tag, tag, text) of the elements of a page that one of ``selectors`` matches, by their start.
    A block tag or ``br`` is a line end in the text, but for the white space at its ends."""
    html = HIDDEN.sub("", html)
    open_, texts, out, at = _Open(), [], [], 0

    def ended(entries):
        for name, _, _, start, k in entries:
            if start is not None:
                out.append((k, name, "".join(texts[start:]).strip(EDGE)))
    for k, m in enumerate(TAG.finditer(html)):
        texts.append(html[at:m.start()])
        at, closing, name = m.end(), m[1], m[2].lower()
        line = ["\n"] if name in BLOCK or name == "br" else []
        if closing:
            own = open_.last(name)
            if own >= 0 and name in FORMATTING:
                entry = open_.stack[own]
                ended([entry])
                entry[2] = False
            elif own >= 0 and (name in BLOCK or own > open_.last("#block")):
                ended(open_.end_from(own))
            texts += line
            continue
        if name in ENDS_P and open_.last("p") > open_.last("#scope"):
            ended(open_.end_from(open_.last("p")))
        if name in IMPLIED:
            ends, beyond = IMPLIED[name]
            if open_.last(*ends) > open_.last(*beyond):
                ended(open_.end_from(open_.last(*ends)))
        texts += line
        if name not in VOID:
            c = CLASS.search(m[3])
            hit = matches(selectors, name, next((g for g in c.groups() if g is not None), "") if c else "")
            open_.push(name, [name, len(open_.stack), True, len(texts) if hit else None, k])
    texts.append(html[at:])
    ended(open_.end_from(0))
    return sorted(out)


#: Characters of pages, more or less, whose elements a task holds as Python objects at a time; a longer page is taken alone.
CHUNK_CHARS = 1 << 20


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most CHUNK_CHARS characters (bytes) of a column, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > CHUNK_CHARS:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if sizes:
        yield batch.slice(start)


def selected_blocks(pages: DataFrame, selectors: Sequence[str] = POST_SELECTORS, html: str = "html") -> DataFrame:
    """(page_id, url, pos, tag, raw_text) of the elements that one of the selectors matches; an element inside another
    is a row of its own, and its text is in both. ``pos`` is the number of its opening tag in the page."""
    chosen = [parse_selector(s) for s in selectors]

    def run(batches):
        for b in (c for whole in batches for c in _chunks(whole, 2)):
            rows = [(i, *e) for i, h in enumerate(b.column(2).to_pylist()) for e in page_elements(h or "", chosen)]
            at, pos, tag, text = zip(*rows, strict=True) if rows else ([],) * 4
            own = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(pos, pa.int64()), pa.array(tag, pa.string()), pa.array(text, pa.string())],
                                             ["page_id", "url", "pos", "tag", "raw_text"])
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.col(html)).mapInArrow(run, f"page_id {kind}, url string, pos bigint, tag string, raw_text string")


def cleaned_blocks(blocks: DataFrame) -> DataFrame:
    """(page_id, pos, tag, text): the blocks that are long enough, cleaned."""
    return blocks.filter(long_enough("raw_text")).select("page_id", "pos", "tag", clean_text("raw_text").alias("text"))


def selected_posts(pages: DataFrame, selectors: Sequence[str] = POST_SELECTORS, key_fn: str = "xxh64", max_per_tab: int | None = None) -> DataFrame:
    """Posts of the selected elements: the language in the URL is the tab, pages and their elements are in capture order."""
    b = selected_blocks(pages, selectors).select(
        "raw_text", F.regexp_extract("url", r"/([a-z]{2})/", 1).alias("tab"), F.lit(0).alias("tab_rank"),
        (F.col("page_id") * F.lit(2 ** 31) + F.col("pos")).alias("ingest_seq"), F.lit(None).cast("string").alias("author"), "page_id", "pos")
    return standardize_posts(b, key_fn=key_fn, max_per_tab=max_per_tab)
