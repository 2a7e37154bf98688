"""Column-level operators (Catalyst expressions)."""

from .formatting import (bar, calculate_progress, format_number, format_timestamp,
                         parse_timestamp_number, parse_timestamp_string, sentiment_icon)
from .keys import content_hash, content_key, hex_key, post_id, xxh64_hex
from .sentiment import (keyword_sentiment, label_from_counts, market_mood, overall_sentiment,
                        sectors, sentiment_class, sentiment_ratio, share_pct, theme_trend)
from .text import clean_text, extract_urls, long_enough, truncate
from .tickers import canonical_symbols, extract_symbols
from .validate import is_valid_post, post_problems, summary_problems

__all__ = [
    "bar", "calculate_progress", "format_number", "format_timestamp",
    "parse_timestamp_number", "parse_timestamp_string", "sentiment_icon",
    "content_hash", "content_key", "hex_key", "post_id", "xxh64_hex",
    "keyword_sentiment", "label_from_counts", "market_mood", "overall_sentiment",
    "sectors", "sentiment_class", "sentiment_ratio", "share_pct", "theme_trend",
    "clean_text", "extract_urls", "long_enough", "truncate",
    "canonical_symbols", "extract_symbols",
    "is_valid_post", "post_problems", "summary_problems",
]
