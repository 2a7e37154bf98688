"""Content keys: xxh64 (seed 0) computed inside the JVM.

``F.xxhash64`` is seeded with 42 and chains each column's hash into the seed
of the next one. The long below hashes to 0 under seed 42, so prefixing it
re-seeds the next column with 0: ``xxhash64(lit(K), s) == XXH64(s, seed=0)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import col

SEED0_PREFIX = -365884300664092260


def xxh64_hex(c) -> Column:
    """16 lower-case hex digits of XXH64(utf8(c), seed 0)."""
    h = F.xxhash64(F.lit(SEED0_PREFIX), col(c))
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def hex_key(c, key_fn: str = "xxh64") -> Column:
    """Key of a string column. ``md5``/``sha2`` give 16-hex prefixes of those
    digests (for oracles without xxh64, or when 64 bits are too few)."""
    if key_fn == "xxh64":
        return xxh64_hex(c)
    if key_fn == "md5":
        return F.substring(F.md5(col(c)), 1, 16)
    if key_fn == "sha2":
        return F.sha2(col(c), 256)
    raise ValueError(f"unknown key_fn {key_fn!r}")


def content_key(content, *extras, key_fn: str = "xxh64") -> Column:
    """Key of ``":".join([content] + [e for e in extras if e])``.

    Empty or NULL extras are skipped (no empty slot): ``concat_ws`` drops NULLs
    and ``nullif`` turns ``""`` into NULL.
    """
    parts = [F.coalesce(col(content), F.lit(""))]
    parts += [F.nullif(col(e).cast("string"), F.lit("")) for e in extras]
    return hex_key(F.concat_ws(":", *parts), key_fn)


def post_id(cleaned_text, key_fn: str = "xxh64") -> Column:
    """Post id = first 16 hex digits of the content key of the cleaned text."""
    return F.substring(content_key(cleaned_text, key_fn=key_fn), 1, 16)


def content_hash(text="text", author="author", tab="tab", key_fn: str = "xxh64") -> Column:
    """Post content hash of ``text:author:tab``; a missing author leaves an
    empty slot, so there are always two colons."""
    s = F.concat(F.coalesce(col(text), F.lit("")), F.lit(":"),
                 F.coalesce(col(author), F.lit("")), F.lit(":"),
                 F.coalesce(col(tab), F.lit("")))
    return hex_key(s, key_fn)
