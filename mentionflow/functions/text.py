"""Text cleaning and small string operators (JVM-side regex, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import col
from .lexicons import MIN_RAW_TEXT_LEN, TRUNCATE_SUFFIX, URL_PATTERN

# Python's Unicode ``\s`` also covers U+001C..U+001F, Java's (?U)\s does not.
TAG_RE = r"<[^>]+>"
SPACE_RUN_RE = r"(?U)[\s\x{1c}-\x{1f}]+"
CONTROL_RE = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}]"


def clean_text(c) -> Column:
    """Strip tags, collapse white space, drop control characters, trim.

    NULL or empty gives ``""``. Control characters are removed *after* the
    white-space collapse, so ``"a \\x00 b"`` keeps two spaces. Entities are
    not decoded.
    """
    t = F.coalesce(col(c), F.lit(""))
    t = F.regexp_replace(t, TAG_RE, "")
    t = F.regexp_replace(t, SPACE_RUN_RE, " ")
    t = F.regexp_replace(t, CONTROL_RE, "")
    # after the collapse the only white space left is U+0020, so trim suffices
    return F.trim(t)


def long_enough(c, min_len: int = MIN_RAW_TEXT_LEN) -> Column:
    """Raw-text length filter applied before cleaning (NULL is too short)."""
    return F.coalesce(F.length(col(c)) >= F.lit(min_len), F.lit(False))


def extract_urls(c) -> Column:
    """Distinct http(s) URLs, sorted; trailing punctuation is kept."""
    pattern = "(?U)" + URL_PATTERN.replace(r"[^\s", r"[^\s\x{1c}-\x{1f}")
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(pattern), F.lit(0))
    return F.array_sort(F.array_distinct(found))


def truncate(c, max_length: int = 200, suffix: str = TRUNCATE_SUFFIX) -> Column:
    """Keep texts up to ``max_length``; longer ones are cut and get ``suffix``."""
    t = col(c)
    keep = max(max_length - len(suffix), 0)
    return F.when(F.length(t) <= F.lit(max_length), t).otherwise(
        F.concat(F.substring(t, 1, keep), F.lit(suffix)))
