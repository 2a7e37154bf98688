"""Adapters from the benchmark tables to the post / summary / response model.

* post: a ``documents`` row; tab = ``source``; capture order = ``doc_id``.
  The prose carries no tickers, so each text gets a ticker tail that is a
  function of the text itself (exact copies stay exact copies):
  `` $N(SH<len%97, 6 digits>)$`` and, when ``len % 3 == 0``, `` 600519.SH``.
  The second one makes a single symbol hold a third of all mentions.
* engagement: ``events`` of user ``doc_id % number of users``; click → like,
  signup → comment, purchase → retweet, view → view; first event = created_at.
* summary: a ``labels`` row; toxic → negative, else quality → positive,
  else neutral; themes = [lang]; sectors from a test lexicon.
* model response: JSON built from the document, with planted faults by
  ``doc_id % 10`` (broken JSON, missing keys, bad score, odd labels, NULL …).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import (clean_text, content_hash, extract_symbols, long_enough, post_id, sectors, truncate)
from ..functions.lexicons import TEST_SECTOR_KEYWORDS
from ..operators.standardize import cleaned_posts, distinct_posts, standardize_posts
from ..session import read_table, staged

TICKER_MOD = 97


def ticker_tail(text="text") -> F.Column:
    t = F.col(text)
    n = F.length(t)
    code = F.lpad((n % TICKER_MOD).cast("string"), 6, "0")
    extra = F.when(n % 3 == 0, F.lit(" 600519.SH")).otherwise(F.lit(""))
    return F.concat(t, F.lit(" $N(SH"), code, F.lit(")$"), extra)


def source_rank(src="source") -> F.Column:
    return F.substring(F.col(src), 4, 10).cast("int")


def documents_raw(spark: SparkSession, sf_dir: str, tickers: bool = True,
                  extra=()) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        (ticker_tail("text") if tickers else F.col("text")).alias("raw_text"),
        F.col("source").alias("tab"),
        source_rank("source").alias("tab_rank"),
        F.col("doc_id").alias("ingest_seq"),
        F.lit(None).cast("string").alias("author"),
        *extra,
    )


def engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-user engagement counts: one partial+final hash aggregate."""
    e = read_table(spark, sf_dir, "events")
    et = F.col("event_type")
    return e.groupBy("user_id").agg(
        F.count_if(et == "click").cast("long").alias("like_count"),
        F.count_if(et == "signup").cast("long").alias("comment_count"),
        F.count_if(et == "purchase").cast("long").alias("retweet_count"),
        F.count_if(et == "view").cast("long").alias("view_count"),
        F.min("ts").alias("created_at"),
    )


def with_engagement(posts: DataFrame, eng: DataFrame) -> DataFrame:
    # users are numbered from 0: the modulus comes from the data, so every event reaches a post
    n = eng.agg(F.coalesce(F.max("user_id") + 1, F.lit(1))).scalar()
    p = posts.withColumn("user_id", F.col("ingest_seq") % n)
    out = p.join(eng, on="user_id", how="left").drop("user_id")
    for c in ("like_count", "comment_count", "retweet_count", "view_count"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0).cast("long")))
    return out


def posts(spark: SparkSession, sf_dir: str, key_fn: str = "xxh64", engage: bool = True,
          max_per_tab: int | None = None) -> DataFrame:
    p = standardize_posts(documents_raw(spark, sf_dir), key_fn=key_fn, max_per_tab=max_per_tab)
    return with_engagement(p, engagement(spark, sf_dir)) if engage else p


def labelled_summaries(spark: SparkSession, sf_dir: str, key_fn: str = "xxh64") -> DataFrame:
    """One summary per labelled document (a post can get several; the
    latest ``ingest_seq`` is the one that counts, see ``last_wins``)."""
    lab = read_table(spark, sf_dir, "labels")
    d = documents_raw(spark, sf_dir, extra=("lang",))
    j = d.join(lab, F.col("ingest_seq") == F.col("doc_id"), "inner")
    text = clean_text("raw_text")
    sentiment = (F.when(F.col("toxic") == 1, F.lit("negative"))
                 .when(F.col("quality") == 1, F.lit("positive"))
                 .otherwise(F.lit("neutral")))
    score = (F.when(F.col("toxic") == 1, F.lit(-0.6))
             .when(F.col("quality") == 1, F.lit(0.8)).otherwise(F.lit(0.0)))
    j = j.withColumn("text", text)
    return j.select(
        post_id("text", key_fn).alias("post_id"),
        content_hash("text", F.lit(None).cast("string"), "tab", key_fn=key_fn).alias("post_hash"),
        F.col("tab"),
        F.concat(F.lit("Labelled "), F.col("lang"), F.lit(" post")).alias("summary"),
        F.array().cast("array<string>").alias("key_points"),
        extract_symbols("text").alias("tickers"),
        F.array(F.concat(F.lit("Co-"), F.upper("lang")), F.concat(F.lit("Co-"), F.col("tab"))).alias("companies"),
        F.array(F.col("lang")).alias("themes"),
        sectors("text", TEST_SECTOR_KEYWORDS).alias("sectors"),
        sentiment.alias("sentiment"),
        score.cast("double").alias("sentiment_score"),
        F.lit("From labels").alias("sentiment_reasoning"),
        F.lit("labels").alias("model_used"),
        truncate("text", 200).alias("original_text_preview"),
        F.col("ingest_seq"),
        F.col("tab_rank"),
    )


def _j(s) -> F.Column:
    """A JSON string literal of a column (values here need no escaping)."""
    return F.concat(F.lit('"'), s, F.lit('"'))


def model_responses(posts_df: DataFrame) -> DataFrame:
    """One model reply per post, derived from the post, with planted faults
    chosen by ``ingest_seq % 10`` (``% 20`` splits case 0):

    0 broken JSON (20k) / a JSON array (20k+10), 1 only a summary,
    2 score 7 (out of range), 3 label "bullish", 4 NULL (the call failed),
    5 score as the string "0.5" and label "Positive", 6 ``"summary": null``,
    7 ``"tickers": [1]``, 8 label "unknown", 9 empty content.
    """
    seq = F.col("ingest_seq")
    k = seq % 10
    code = F.lpad((seq % 89).cast("string"), 6, "0")
    label = (F.when(k == 3, F.lit("bullish")).when(k == 5, F.lit("Positive"))
             .when(k == 8, F.lit("unknown"))
             .when(seq % 3 == 0, F.lit("positive")).when(seq % 3 == 1, F.lit("negative"))
             .otherwise(F.lit("neutral")))
    score = (F.when(k == 2, F.lit("7")).when(k == 5, F.lit('"0.5"'))
             .otherwise(F.format_string("%.2f", ((seq % 21) - 10) / F.lit(10.0))))
    summary = F.when(k == 6, F.lit("null")).otherwise(_j(F.concat(F.lit("Post from "), F.col("tab"))))
    tickers = F.when(k == 7, F.lit("[1]")).otherwise(F.concat(F.lit('["SH'), code, F.lit('"]')))
    body = F.concat(
        F.lit('{"summary": '), summary,
        F.lit(', "key_points": ["first point", "second point"], "tickers": '), tickers,
        F.lit(', "companies": ['), _j(F.concat(F.lit("Co-"), F.col("tab"))), F.lit("]"),
        F.lit(', "themes": ['), _j(F.concat(F.lit("Theme-"), (seq % 7).cast("string"))), F.lit("]"),
        F.lit(', "sectors": ["Finance"], "sentiment": '), _j(label),
        F.lit(', "sentiment_score": '), score,
        F.lit(', "sentiment_reasoning": "generated"}'))
    response = (F.when((k == 0) & (seq % 20 == 0), F.lit('{"summary": "cut off'))
                .when(k == 0, F.lit("[1, 2]"))
                .when(k == 1, F.lit('{"summary": "only a summary"}'))
                .when(k == 4, F.lit(None).cast("string"))
                .when(k == 9, F.lit(""))
                .otherwise(body))
    tokens = F.when(k == 4, F.lit(None)).otherwise(F.length("text") % 1000 + 100).cast("long")
    return posts_df.select(F.col("id").alias("post_id"), response.alias("response"),
                           tokens.alias("total_tokens"))


def capture_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture log (tab, at, error): each event is an access of the tab that
    its user reads; events of type ``error`` failed."""
    e = read_table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("tab"),
                    F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "error").alias("error"))


def captured_and_posts(spark: SparkSession, sf_dir: str, key_fn: str = "xxh64", engage: bool = True) -> tuple[DataFrame, DataFrame]:
    """(captured, posts) from one cleaning of the texts, which is staged. captured: (tab, candidate) of every
    captured row; candidate: long enough, and not blank once cleaned."""
    raw = documents_raw(spark, sf_dir)
    clean = staged(cleaned_posts(raw, key_fn=key_fn), "cleaned")
    short = raw.filter(~F.coalesce(long_enough("raw_text"), F.lit(False))).select("tab", F.lit(False).alias("candidate"))
    rows = clean.select("tab", F.coalesce(F.length("text") > 0, F.lit(False)).alias("candidate")).unionByName(short)
    p = distinct_posts(clean, key_fn)
    return rows, with_engagement(p, engagement(spark, sf_dir)) if engage else p


def conversations_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second post feed: conversation turns; tab = role (user first),
    capture order = (conversation, turn)."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select(
        F.col("text").alias("raw_text"), F.col("role").alias("tab"),
        F.when(F.col("role") == "user", F.lit(0)).otherwise(F.lit(1)).alias("tab_rank"),
        (F.col("conv_id") * F.lit(2 ** 31) + F.col("turn")).alias("ingest_seq"),
        F.lit(None).cast("string").alias("author"))


def write_envelopes(spark: SparkSession, sf_dir: str, path: str, per_file: int = 500) -> None:
    """Documents as ``posts_<tab>.json`` envelopes of at most ``per_file``
    records, faults planted by ``doc_id % 11``: 1 a count that is a word, 2 a
    null count, 3 a negative count, 4 no text, 5 a number among the symbols,
    6 a count as a string of digits (accepted), 7 a stale content hash (computed
    anew), 8 no counts at all (defaults), 9 a number for the tab, 10 a null list."""
    d = read_table(spark, sf_dir, "documents").filter(F.col("text").isNotNull() & F.col("source").isNotNull())
    k = F.col("doc_id") % 11
    text = ticker_tail("text")
    count = F.when(k == 1, F.lit('"many"')).when(k == 2, F.lit("null")).when(k == 3, F.lit("-1")).when(k == 6, F.lit('"12"')).otherwise(
        (F.col("doc_id") % 50).cast("string"))
    symbols = F.when(k == 5, F.lit("[1]")).when(k == 10, F.lit("null")).otherwise(F.to_json(extract_symbols(text)))

    def quoted(c):  # a JSON string
        j = F.to_json(F.struct(c.alias("v")))
        return F.substr(j, F.lit(6), F.length(j) - 6)
    parts = [F.concat(F.lit('"id": "'), F.col("doc_id").cast("string"), F.lit('"')),
             F.when(k != 4, F.concat(F.lit('"text": '), quoted(text))),
             F.concat(F.lit('"tab": '), F.when(k == 9, F.lit("9")).otherwise(quoted(F.col("source")))),
             F.when(k != 8, F.concat(F.lit('"like_count": '), count)),
             F.concat(F.lit('"symbols": '), symbols),
             F.when(k == 7, F.lit('"content_hash": "stale"'))]
    # ranges of per_file ids hold a few rows of each tab: neighbouring ranges share an envelope while they fit
    part = F.floor(F.col("doc_id") / per_file)
    n = d.groupBy(F.col("source").alias("tab"), part.alias("range")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("tab")
    room = F.greatest(F.lit(per_file) - F.max("n").over(w), F.lit(1))
    part_of = n.select("tab", "range", F.floor((F.sum("n").over(w.orderBy("range")) - F.col("n")) / room).alias("part"))
    rec = d.select(F.col("source").alias("tab"), part.alias("range"), "doc_id",
                   F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("r"))
    rec = rec.join(part_of.select(F.col("tab").alias("_t"), F.col("range").alias("_g"), "part"), (F.col("tab") == F.col("_t")) & F.col("range").eqNullSafe(F.col("_g")))
    one = rec.groupBy("tab", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "r"))), lambda x: x["r"]), ",\n").alias("body"))
    env = one.select(F.concat(F.lit("posts_"), F.col("tab"), F.lit(".json")).alias("file"), F.concat(
        F.lit('{"metadata": {"tab": "'), F.col("tab"), F.lit('"}, "posts": ['), F.col("body"), F.lit("]}")).alias("value"))
    env.repartition("file", F.xxhash64("value")).write.option("maxRecordsPerFile", 1).partitionBy("file").text(path)
