"""Raw post rows → clean, keyed, de-duplicated, capped posts.

Order matters and follows the capture loop: short raw texts are dropped,
texts are cleaned, the id is the key of the cleaned text, the first copy of
an id wins across all tabs, invalid posts are dropped, symbols/URLs are
extracted (after de-dup, so each distinct text is scanned once). With a cap,
each tab takes its first posts that no tab before it took.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (clean_text, content_hash, extract_symbols, extract_urls,
                         long_enough, post_id)
from ..session import staged
from .dedup import capped_capture, first_rows


def cleaned_post_is_valid(text="text", tab="tab") -> F.Column:
    """P1 on cleaned text (no white space at either end): non-empty text and
    tab; the id is always 16 hex digits."""
    return (F.coalesce(F.length(text) > 0, F.lit(False))
            & F.coalesce(F.length(tab) > 0, F.lit(False)))


def standardize_posts(raw: DataFrame, raw_text="raw_text", key_fn="xxh64",
                      max_per_tab: int | None = None, symbols: bool = True,
                      urls: bool = True, ticker_kwargs: dict | None = None,
                      taken: DataFrame | None = None) -> DataFrame:
    """``raw`` needs ``raw_text, tab, tab_rank, ingest_seq``, the last two
    naming a row; other columns (author, created_at, engagement …) are carried
    along. ``max_per_tab`` caps each tab as the capture loop does
    (``capped_capture``); ``taken`` (id, tab): posts that earlier runs stored, counted in the cap."""
    return distinct_posts(cleaned_posts(raw, raw_text, key_fn), key_fn, max_per_tab, symbols, urls, ticker_kwargs, taken)


def cleaned_posts(raw: DataFrame, raw_text="raw_text", key_fn="xxh64") -> DataFrame:
    """The rows that are long enough, with their cleaned ``text`` and its key as ``id``."""
    df = raw.filter(long_enough(raw_text))
    df = df.withColumn("text", clean_text(raw_text)).drop(raw_text)
    return df.withColumn("id", post_id("text", key_fn))


def distinct_posts(df: DataFrame, key_fn="xxh64", max_per_tab: int | None = None, symbols: bool = True, urls: bool = True,
                   ticker_kwargs: dict | None = None, taken: DataFrame | None = None) -> DataFrame:
    """Posts of ``cleaned_posts``: de-duplicated (or capped), valid, with what is extracted from their texts."""
    # The id is marked as seen before the validity test, so de-dup comes
    # first. Validity is tested after the aggregate on the cleaned text, where
    # "not blank" is just "not empty"; a filter placed before the aggregate
    # would be pushed into the scan with the cleaning regexes inlined again.
    if max_per_tab:
        # the rounds read narrow columns, and the texts of the chosen
        df = capped_capture(staged(df.filter(cleaned_post_is_valid()), "cleaned"), max_per_tab, taken)
    else:
        df = first_rows(df, "id", ("tab_rank", "ingest_seq")).filter(cleaned_post_is_valid())
    if symbols:
        df = df.withColumn("symbols", extract_symbols("text", **(ticker_kwargs or {})))
    if urls:
        df = df.withColumn("urls", extract_urls("text"))
    author = "author" if "author" in df.columns else F.lit(None).cast("string")
    return df.withColumn("content_hash", content_hash("text", author, "tab", key_fn=key_fn))
