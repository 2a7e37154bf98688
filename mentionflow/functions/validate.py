"""Record validity: the post predicate and the per-field checks of stored
records, as boolean columns (bad rows are split off, never fatal)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import col

SENTIMENTS = ["positive", "neutral", "negative", "unknown"]


def _nonempty(c) -> Column:
    return F.coalesce(F.length(col(c)) > 0, F.lit(False))


def is_valid_post(id_col="id", text_col="text", tab_col="tab") -> Column:
    """id, text and tab non-empty and text not blank."""
    blank = F.coalesce(F.length(F.trim(F.regexp_replace(col(text_col), r"(?U)[\s\x{1c}-\x{1f}]+", " "))) > 0,
                       F.lit(False))
    return _nonempty(id_col) & _nonempty(text_col) & blank & _nonempty(tab_col)


def _reasons(checks) -> Column:
    arr = F.array(*[F.when(bad, F.lit(reason)) for reason, bad in checks])
    return F.filter(arr, lambda r: r.isNotNull())


def post_problems(df_cols=None) -> Column:
    """Array of reasons why a post row would be rejected (empty = valid)."""
    checks = [
        ("missing_id", F.col("id").isNull()),
        ("missing_text", F.col("text").isNull()),
        ("missing_tab", F.col("tab").isNull()),
        ("negative_like_count", F.coalesce(F.col("like_count") < 0, F.lit(False))),
        ("negative_comment_count", F.coalesce(F.col("comment_count") < 0, F.lit(False))),
        ("negative_retweet_count", F.coalesce(F.col("retweet_count") < 0, F.lit(False))),
        ("negative_view_count", F.coalesce(F.col("view_count") < 0, F.lit(False))),
    ]
    return _reasons(checks)


def summary_problems() -> Column:
    """Array of reasons why a summary row would be rejected (empty = valid)."""
    score = F.col("sentiment_score")
    checks = [
        ("missing_post_id", F.col("post_id").isNull()),
        ("missing_post_hash", F.col("post_hash").isNull()),
        ("missing_tab", F.col("tab").isNull()),
        ("missing_summary", F.col("summary").isNull()),
        ("bad_sentiment", ~F.coalesce(F.col("sentiment").isin(*SENTIMENTS), F.lit(True))),
        ("score_out_of_range", F.coalesce((score < -1.0) | (score > 1.0) | F.isnan(score), F.lit(False))),
        ("negative_processing_time", F.coalesce(F.col("processing_time_ms") < 0, F.lit(False))),
        ("preview_too_long", F.coalesce(F.length("original_text_preview") > 200, F.lit(False))),
    ]
    return _reasons(checks)


# ---------------------------------------------- records of JSON envelopes
#: Field → (kind, may be null, default, least, greatest); a default of MISSING
#: makes the field required. Kinds: str, int, float, bool, time, list, dict.
MISSING = object()
POST_FIELDS = {
    "id": ("str", False, MISSING), "text": ("str", False, MISSING), "html": ("str", False, ""), "timestamp": ("time", False, None),
    "tab": ("str", False, MISSING), "author": ("str", True, None), "author_id": ("str", True, None), "author_avatar": ("str", True, None),
    "author_verified": ("bool", False, False), "like_count": ("int", False, 0, 0), "comment_count": ("int", False, 0, 0),
    "retweet_count": ("int", False, 0, 0), "view_count": ("int", False, 0, 0), "symbols": ("list", False, []), "urls": ("list", False, []),
    "images": ("list", False, []), "post_url": ("str", True, None), "created_at": ("time", True, None), "source": ("str", True, None),
    "raw_data": ("dict", False, "{}"),
}
SUMMARY_FIELDS = {
    "post_id": ("str", False, MISSING), "post_hash": ("str", False, MISSING), "tab": ("str", False, MISSING), "summary": ("str", False, MISSING),
    "key_points": ("list", False, []), "tickers": ("list", False, []), "companies": ("list", False, []), "themes": ("list", False, []),
    "sectors": ("list", False, []), "sentiment": ("str", False, "unknown"), "sentiment_score": ("float", False, 0.0, -1.0, 1.0),
    "sentiment_reasoning": ("str", True, None), "processed_at": ("time", False, None), "model_used": ("str", False, ""),
    "processing_time_ms": ("int", False, 0, 0), "original_text_preview": ("str", False, ""),
}


def _field(v: str, name: str) -> Column:
    return F.try_variant_get(F.col(v), f"$.{name}", "variant")


def _as(v: str, name: str, kind: str) -> Column:
    """The field as a value of its kind; NULL if it is none."""
    path, sort = f"$.{name}", F.schema_of_variant(_field(v, name))
    text = F.try_variant_get(F.col(v), path, "string")
    number = F.when(sort == "BOOLEAN", F.try_variant_get(F.col(v), path, "boolean").cast("double")).when(
        ~sort.isin("VOID", "OBJECT") & ~F.startswith(sort, F.lit("ARRAY")) & ~F.startswith(sort, F.lit("OBJECT")), text.try_cast("double"))
    if kind == "str":
        return F.when(sort == "STRING", text)
    if kind == "int":
        return F.when(number == F.floor(number), number.cast("decimal(38,0)").try_cast("bigint"))
    if kind == "float":
        return F.when(~F.isnan(number), number)
    if kind == "bool":
        low = F.lower(text)
        return F.when(sort == "BOOLEAN", F.try_variant_get(F.col(v), path, "boolean")).when(
            low.isin("1", "true", "t", "yes", "y", "on", "1.0"), True).when(low.isin("0", "false", "f", "no", "n", "off", "0.0"), False)
    if kind == "time":
        return F.when(sort == "STRING", text.try_cast("timestamp")).when(number.isNotNull() & (sort != "BOOLEAN"), F.timestamp_seconds(number))
    if kind == "list":
        items = F.try_variant_get(F.col(v), path, "array<string>")
        return F.when(sort.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(items, lambda x: x.isNull()), items)
    return F.when(F.startswith(sort, F.lit("OBJECT")), F.to_json(_field(v, name)))


def record_problems(v: str, fields: dict) -> Column:
    """Reasons why a record (variant column ``v``) is rejected: it is no object, a
    required field is missing, a field is null that must not be or has another type, a
    number is out of its range, a label unknown, a preview too long. Empty: valid."""
    is_object = F.coalesce(F.startswith(F.schema_of_variant(F.col(v)), F.lit("OBJECT")), F.lit(False))
    checks = []
    for name, (kind, nullable, default, *bounds) in fields.items():
        there, value = _field(v, name).isNotNull(), _as(v, name, kind)
        null = there & (F.schema_of_variant(_field(v, name)) == "VOID")
        if default is MISSING:
            checks.append((f"missing_{name}", ~there))
        wrong = there & value.isNull() & ~null if nullable else there & value.isNull()
        checks.append((f"wrong_type_{name}", F.coalesce(wrong, F.lit(False))))
        if bounds:
            low = F.coalesce(value < bounds[0], F.lit(False))
            high = F.coalesce(value > bounds[1], F.lit(False)) if len(bounds) > 1 else F.lit(False)
            checks.append((f"out_of_range_{name}" if len(bounds) > 1 else f"negative_{name}", low | high))
    if "sentiment" in fields:
        checks.append(("bad_sentiment", ~F.coalesce(_as(v, "sentiment", "str").isin(*SENTIMENTS), F.lit(True))))
        checks.append(("preview_too_long", F.coalesce(F.length(_as(v, "original_text_preview", "str")) > 200, F.lit(False))))
    return F.when(~is_object, F.array(F.lit("malformed_record"))).otherwise(_reasons(checks))


def record_value(v: str, name: str, fields: dict) -> Column:
    """The value of a field of a valid record, or its default (times: now)."""
    kind, nullable, default, *_ = fields[name]
    value = _as(v, name, kind)
    if default is MISSING or (default is None and nullable):
        return value
    if kind == "time":
        return F.coalesce(value, F.current_timestamp())
    return F.coalesce(value, F.array().cast("array<string>") if kind == "list" else F.lit(default))
