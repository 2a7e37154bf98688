"""Formatting and parsing helpers used by reports (all Catalyst functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import col
from .lexicons import (BAR_GLYPH, BAR_WIDTH, EPOCH_MS_THRESHOLD, SENTIMENT_ICONS,
                       TIMESTAMP_DISPLAY_FORMAT, UNKNOWN_ICON)

# strptime formats of the original tool, as Spark datetime patterns; the
# fraction accepts 1..6 digits like %f does
_STRING_FORMATS = [
    "yyyy-M-d'T'H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]'Z'",
    "yyyy-M-d'T'H:m:s'Z'",
    "yyyy-M-d H:m:s",
    "yyyy-M-d",
]


def format_timestamp(ts=None, fmt: str = TIMESTAMP_DISPLAY_FORMAT) -> Column:
    """Render a timestamp; NULL/absent means now."""
    t = F.current_timestamp() if ts is None else F.coalesce(col(ts), F.current_timestamp())
    return F.date_format(t, fmt)


def parse_timestamp_string(s) -> Column:
    s = col(s)
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in _STRING_FORMATS])


def parse_timestamp_number(x) -> Column:
    """Epoch seconds, or milliseconds when larger than 2100-01-01 in seconds."""
    x = col(x).cast("double")
    secs = F.when(x > F.lit(EPOCH_MS_THRESHOLD), x / F.lit(1000.0)).otherwise(x)
    return F.timestamp_micros(F.round(secs * F.lit(1_000_000)).cast("long"))


def calculate_progress(cur, total) -> Column:
    cur, total = col(cur), col(total)
    return F.when(total <= 0, F.lit(0.0)).otherwise(
        F.least(F.lit(100.0), cur / total * F.lit(100.0))).cast("double")


def format_number(n) -> Column:
    """Thousands separators, no decimals (``1,234``)."""
    return F.format_number(col(n).cast("long"), 0)


def sentiment_icon(s) -> Column:
    m = F.create_map(*[x for kv in SENTIMENT_ICONS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.try_element_at(m, F.lower(col(s))), F.lit(UNKNOWN_ICON))


def bar(x, total, width: int = BAR_WIDTH, glyph: str = BAR_GLYPH) -> Column:
    """``glyph`` repeated int(x/total*width) times; NULL when total is 0."""
    x, total = col(x), col(total)
    n = F.floor(x / total * F.lit(width)).cast("int")
    return F.when(total > 0, F.repeat(F.lit(glyph), n))
