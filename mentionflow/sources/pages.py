"""Captured pages → post rows.

Blocks are the post-like elements of each page (paragraphs, headings, list
items by default). Every block tag, opening or closing, ends a run of text; a
run belongs to the innermost block it stands in, so a nested block's text is
not repeated in the outer one, and the outer block's text before and after it
is kept, as runs of their own. Text outside all blocks is left out. Then the usual
standardisation applies (length filter, cleaning, id, first-wins de-dup
across all pages, validity, symbols/URLs, per-tab cap). No parser, no UDF.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.standardize import standardize_posts

BLOCK_TAGS = ("p", "h1", "li")


def tag_pattern(tags=BLOCK_TAGS) -> str:
    """An opening or closing block tag (no look-around, so RE2 can run it too)."""
    return rf"(?i)</?(?:{'|'.join(tags)})(?:\s[^>]*)?>"


def page_blocks(pages: DataFrame, html="html", tags=BLOCK_TAGS, tab=None) -> DataFrame:
    """One row per run of block text: page_id, pos (number of the run in the
    page), raw_text (tags removed), tab. Runs between two tags without any character are left out."""
    tab_col = tab if tab is not None else F.regexp_extract("url", r"/([a-z]{2})/", 1)
    p = pages.select("page_id", tab_col.alias("tab"), F.coalesce(F.col(html), F.lit("")).alias("_h"))
    p = p.select("page_id", "tab", F.split("_h", tag_pattern(tags), -1).alias("runs"),
                 F.regexp_extract_all("_h", F.lit(tag_pattern(tags)), F.lit(0)).alias("marks"))
    # how many blocks are open after each tag
    open_after = F.aggregate("marks", F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(
        F.element_at(a, -1) + F.when(F.startswith(t, F.lit("</")), -1).otherwise(1))))
    p = p.select("page_id", "tab", F.arrays_zip(F.col("runs").alias("run"), open_after.alias("depth")).alias("z"))
    b = p.select("page_id", "tab", F.posexplode("z").alias("pos", "z")).filter("z.depth > 0")
    b = b.select("page_id", "pos", "tab", F.regexp_replace("z.run", r"<[^>]+>", "").alias("raw_text"))
    return b.filter(F.length("raw_text") > 0)


def page_posts(pages: DataFrame, key_fn: str = "xxh64", max_per_tab: int | None = None,
               tags=BLOCK_TAGS) -> DataFrame:
    b = page_blocks(pages, tags=tags)
    b = b.select("raw_text", "tab", F.lit(0).alias("tab_rank"),
                 (F.col("page_id") * F.lit(2 ** 31) + F.col("pos")).alias("ingest_seq"),
                 F.lit(None).cast("string").alias("author"), "page_id", "pos")
    return standardize_posts(b, key_fn=key_fn, max_per_tab=max_per_tab)
