"""Explicit schemas (no inference on any read)."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
L = T.LongType()
A = T.ArrayType(T.StringType())

POST = T.StructType([
    T.StructField("id", S, False),
    T.StructField("text", S, False),
    T.StructField("html", S, True),
    T.StructField("timestamp", T.TimestampType(), True),
    T.StructField("tab", S, False),
    T.StructField("author", S, True),
    T.StructField("author_id", S, True),
    T.StructField("author_avatar", S, True),
    T.StructField("author_verified", T.BooleanType(), True),
    T.StructField("like_count", L, True),
    T.StructField("comment_count", L, True),
    T.StructField("retweet_count", L, True),
    T.StructField("view_count", L, True),
    T.StructField("symbols", A, True),
    T.StructField("urls", A, True),
    T.StructField("images", A, True),
    T.StructField("post_url", S, True),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("source", S, True),
    T.StructField("raw_data", S, True),
    T.StructField("content_hash", S, True),
    T.StructField("ingest_seq", L, True),
])

SUMMARY = T.StructType([
    T.StructField("post_id", S, False),
    T.StructField("post_hash", S, False),
    T.StructField("tab", S, False),
    T.StructField("summary", S, False),
    T.StructField("key_points", A, True),
    T.StructField("tickers", A, True),
    T.StructField("companies", A, True),
    T.StructField("themes", A, True),
    T.StructField("sectors", A, True),
    T.StructField("sentiment", S, True),
    T.StructField("sentiment_score", T.DoubleType(), True),
    T.StructField("sentiment_reasoning", S, True),
    T.StructField("processed_at", T.TimestampType(), True),
    T.StructField("model_used", S, True),
    T.StructField("processing_time_ms", L, True),
    T.StructField("original_text_preview", S, True),
    T.StructField("ingest_seq", L, True),
])

RESPONSE = T.StructType([
    T.StructField("post_id", S, False),
    T.StructField("response", S, True),
    T.StructField("total_tokens", L, True),
])

ENVELOPE_META_POSTS = T.StructType([
    T.StructField("tab", S), T.StructField("job_name", S),
    T.StructField("total_posts", L), T.StructField("new_posts_this_save", L),
    T.StructField("last_updated", S),
])
ENVELOPE_META_SUMMARIES = T.StructType([
    T.StructField("tab", S), T.StructField("job_name", S),
    T.StructField("total_summaries", L), T.StructField("new_summaries_this_save", L),
    T.StructField("last_updated", S),
])
