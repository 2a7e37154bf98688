"""Ticker-symbol extraction with Catalyst regex functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import col
from .lexicons import NAMED_CODE_PATTERN, TICKER_PATTERNS

# (?iU): case-insensitive, Unicode classes and case folding (Python defaults)
_CI = "(?iU)"
# a text without any of these cannot match any pattern: skip the regex chain
GUARD_RE = _CI + r"\$|SH|SZ|HK|\d{6}\."


def _groups(pattern: str) -> int:
    import re
    return re.compile(pattern).groups


def _pattern_hits(text: Column, pattern: str, flags: str) -> Column:
    p = F.lit(flags + pattern)
    n = _groups(pattern)
    if n == 1:
        return F.regexp_extract_all(text, p, F.lit(1))
    # one scan of the text for whole matches, then the groups of each short
    # match are glued together
    whole = F.regexp_extract_all(text, p, F.lit(0))
    glue = "".join(f"${i}" for i in range(1, n + 1))
    anchored = F.lit(flags + "^(?:" + pattern + ")$")
    return F.transform(whole, lambda m: F.regexp_replace(m, anchored, F.lit(glue)))


def extract_symbols(c, patterns=None, named_pattern: str | None = NAMED_CODE_PATTERN,
                    guard: bool = False) -> Column:
    """Distinct upper-cased symbols, sorted.

    Each pattern is applied case-insensitively; multi-group matches are
    concatenated; results shorter than 2 characters are dropped. The
    ``$name(CODE)$`` pattern is case-sensitive and yields the code only.
    ``guard=True`` skips texts without any candidate character first (measured
    slower when most texts do carry candidates).
    """
    text = F.coalesce(col(c), F.lit(""))
    pats = TICKER_PATTERNS if patterns is None else patterns
    parts = [_pattern_hits(text, p, _CI) for p in pats]
    syms = F.filter(F.transform(F.concat(*parts), lambda s: F.upper(s)),
                    lambda s: F.length(s) >= 2)
    if named_pattern:
        named = F.regexp_extract_all(text, F.lit("(?U)" + named_pattern), F.lit(2))
        syms = F.concat(syms, F.transform(named, lambda s: F.upper(s)))
    out = F.array_sort(F.array_distinct(syms))
    if guard:
        out = F.when(text.rlike(GUARD_RE), out).otherwise(F.array().cast("array<string>"))
    return out


def canonical_symbols(symbols) -> Column:
    """Merge ticker twins: ``600519SH``/``600519.SH`` style becomes ``SH600519``
    and a bare code is dropped when a prefixed twin sits in the same array."""
    arr = col(symbols)
    norm = F.transform(arr, lambda s: F.regexp_replace(s, r"^(\d{5,6})(SH|SZ|HK)$", "$2$1"))
    kept = F.filter(norm, lambda s: ~(s.rlike(r"^\d{5,6}$") & F.exists(
        norm, lambda t: t.isin(F.concat(F.lit("SH"), s), F.concat(F.lit("SZ"), s),
                               F.concat(F.lit("HK"), s)))))
    return F.array_sort(F.array_distinct(kept))
