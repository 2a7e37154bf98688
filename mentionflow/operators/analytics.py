"""Aggregations over posts and summaries (stock mentions, themes, sentiment,
tab statistics, top discussions).

Scale notes
* every count is a partial+final hash aggregate, so a symbol/theme/tab that
  holds a third of all rows costs one row per map partition in the shuffle;
* "first N per key" lists (sample ids, quotes, top stocks of a tab) use
  ``row_number() <= N``; Catalyst adds a partial ``WindowGroupLimit`` before
  the exchange, so at most N rows per key per map partition move;
* nothing collects an unbounded group: lists are capped first, pairs are
  returned as rows;
* global top-k is ``orderBy().limit(k)`` (``TakeOrderedAndProject``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import (overall_sentiment, sentiment_class, sentiment_ratio, theme_trend)
from ..sources.tabs import with_spine
from .dedup import capture_position, last_wins

POST_ORDER = ("tab_rank", "ingest_seq")


def _pos(*cols) -> F.Column:
    return F.struct(*[F.col(c) for c in cols])


def latest_summaries(summaries: DataFrame, cols=("sentiment", "companies", "summary")) -> DataFrame:
    """The last summary per ``post_id`` (capture order of the summaries)."""
    keep = ["post_id", *POST_ORDER, *[c for c in cols if c in summaries.columns]]
    return last_wins(summaries.select(*keep), "post_id", POST_ORDER)


def posts_with_sentiment(posts: DataFrame, summaries: DataFrame,
                         cols=("sentiment", "companies")) -> DataFrame:
    """Posts ⟕ latest summary on id; no summary → neutral."""
    s = latest_summaries(summaries, cols).drop(*POST_ORDER)
    s = s.withColumnRenamed("post_id", "id")
    return posts.join(s, on="id", how="left")


def _symbol_rows(posts: DataFrame, summaries: DataFrame) -> DataFrame:
    j = posts_with_sentiment(posts, summaries, ("sentiment",))
    return j.select(F.explode(F.array_distinct("symbols")).alias("symbol"),
                    sentiment_class("sentiment").alias("cls"),
                    capture_position(*POST_ORDER).alias("first_pos"), "id", *POST_ORDER)


def stock_mentions(posts: DataFrame, summaries: DataFrame) -> DataFrame:
    """A1 + P18/P19: one row per symbol with class counts, overall label,
    bullish ratio and the capture position of its first mention."""
    e = _symbol_rows(posts, summaries)
    agg = e.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("mention_count"),
        F.count_if(F.col("cls") == "positive").cast("long").alias("positive_mentions"),
        F.count_if(F.col("cls") == "neutral").cast("long").alias("neutral_mentions"),
        F.count_if(F.col("cls") == "negative").cast("long").alias("negative_mentions"),
        F.min("first_pos").alias("first_pos"),
    )
    return (agg.withColumn("overall_sentiment", overall_sentiment("positive_mentions", "negative_mentions"))
            .withColumn("sentiment_ratio", sentiment_ratio("positive_mentions", "negative_mentions")))


def top_k(df: DataFrame, k: int, order: list, rank_col: str = "rank") -> DataFrame:
    """Global top-k with a 1-based rank (TakeOrderedAndProject, then a window
    over at most k rows)."""
    top = df.orderBy(*order).limit(k)
    return top.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))


def mention_order():
    return [F.col("mention_count").desc(), F.col("first_pos").asc(), F.col("symbol").asc()]


def top_stocks(posts: DataFrame, summaries: DataFrame, k: int = 20) -> DataFrame:
    """O1 + O4: most discussed stocks, ranked."""
    return top_k(stock_mentions(posts, summaries), k, mention_order())


def stock_names(posts: DataFrame, summaries: DataFrame) -> DataFrame:
    """A2: the most frequent company of the summaries of posts mentioning a
    symbol; ties go to the company seen first; symbols without any → none."""
    j = posts_with_sentiment(posts, summaries, ("companies",))
    j = j.filter(F.size("companies") > 0)
    e = j.select(F.explode(F.array_distinct("symbols")).alias("symbol"), "companies", *POST_ORDER)
    e = e.select("symbol", F.posexplode("companies").alias("cpos", "company"), *POST_ORDER)
    c = e.groupBy("symbol", "company").agg(
        F.count(F.lit(1)).alias("n"), F.min(_pos(*POST_ORDER, "cpos")).alias("first"))
    best = c.groupBy("symbol").agg(
        F.min(F.struct((-F.col("n")).alias("k"), F.col("first").alias("f"), F.col("company").alias("c"))).alias("b"))
    return best.select("symbol", F.col("b.c").alias("name"))


def stock_samples(posts: DataFrame, n: int = 5) -> DataFrame:
    """A3: first ``n`` post ids per symbol in capture order."""
    e = posts.select(F.explode(F.array_distinct("symbols")).alias("symbol"), "id", *POST_ORDER)
    w = Window.partitionBy("symbol").orderBy(*POST_ORDER)
    r = e.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    return r.groupBy("symbol").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda s: s["id"]).alias("sample_post_ids"))


def _theme_rows(summaries: DataFrame) -> DataFrame:
    return summaries.select(
        F.posexplode(F.concat(F.coalesce("themes", F.array().cast("array<string>")),
                              F.coalesce("sectors", F.array().cast("array<string>")))).alias("tpos", "theme"),
        sentiment_class("sentiment").alias("cls"), "tickers", "original_text_preview", *POST_ORDER)


def themes(summaries: DataFrame) -> DataFrame:
    """A4 + P20: one row per theme (a theme listed in both themes and sectors
    counts twice)."""
    t = _theme_rows(summaries)
    # (capture position, array position) packed into DECIMAL(38,0): same
    # order as the struct, but a fixed-size buffer (hash aggregate)
    occ = (capture_position(*POST_ORDER).cast("decimal(38,0)") * F.lit(str(10 ** 8)).cast("decimal(38,0)")
           + F.col("tpos").cast("decimal(38,0)")).cast("decimal(38,0)")
    agg = t.withColumn("_occ", occ).groupBy("theme").agg(
        F.count(F.lit(1)).alias("mention_count"),
        F.count_if(F.col("cls") == "positive").cast("long").alias("positive"),
        F.count_if(F.col("cls") == "neutral").cast("long").alias("neutral"),
        F.count_if(F.col("cls") == "negative").cast("long").alias("negative"),
        F.min("_occ").alias("first_pos"),
    )
    return agg.withColumn("trend", theme_trend("positive", "negative")).withColumn(
        "sentiment_distribution",
        F.create_map(F.lit("positive"), F.col("positive"), F.lit("neutral"), F.col("neutral"),
                     F.lit("negative"), F.col("negative")))


def theme_order():
    return [F.col("mention_count").desc(), F.col("first_pos").asc(), F.col("theme").asc()]


def theme_stocks(summaries: DataFrame) -> DataFrame:
    """A5 as rows: distinct (theme, ticker) pairs."""
    t = _theme_rows(summaries)
    return t.select("theme", F.explode("tickers").alias("ticker")).distinct()


def theme_stock_lists(summaries: DataFrame, n: int | None = None) -> DataFrame:
    """The related stocks of each theme (sorted), as an array; ``n``: only the
    first of them, for display. (Distinct tickers of a theme: a list of the
    report, as long as the ticker universe at most.)"""
    p = theme_stocks(summaries)
    if n is None:
        return p.groupBy("theme").agg(F.array_sort(F.collect_set("ticker")).alias("related_stocks"))
    w = Window.partitionBy("theme").orderBy("ticker")
    r = p.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    return r.groupBy("theme").agg(F.array_sort(F.collect_list("ticker")).alias("related_stocks"))


def theme_quotes(summaries: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` previews per theme, in occurrence order."""
    t = _theme_rows(summaries)
    w = Window.partitionBy("theme").orderBy(*POST_ORDER, "tpos")
    r = t.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    return r.groupBy("theme").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "original_text_preview"))),
                    lambda s: s["original_text_preview"]).alias("quotes"))


def overall_counts(summaries: DataFrame) -> DataFrame:
    """One row of class counts (zeros on empty input)."""
    cls = sentiment_class("sentiment")
    return summaries.agg(
        F.count_if(cls == "positive").cast("long").alias("positive"),
        F.count_if(cls == "neutral").cast("long").alias("neutral"),
        F.count_if(cls == "negative").cast("long").alias("negative"),
    )


def job_totals(posts: DataFrame, summaries: DataFrame, approx: bool = False) -> DataFrame:
    """Posts collected, distinct content hashes, summaries — one
    aggregate over the tagged union of both inputs (no join)."""
    u = posts.select(F.col("content_hash"), F.lit(0).alias("_src")).unionByName(
        summaries.select(F.lit(None).cast("string").alias("content_hash"), F.lit(1).alias("_src")))
    distinct = (F.approx_count_distinct("content_hash") if approx
                else F.count_distinct("content_hash"))
    return u.agg(F.count_if(F.col("_src") == 0).cast("long").alias("total_posts_collected"),
                 distinct.cast("long").alias("total_unique_posts"),
                 F.count_if(F.col("_src") == 1).cast("long").alias("total_posts_summarized"))


def ensure_post_columns(posts: DataFrame) -> DataFrame:
    """Optional post fields absent from a source get the record defaults
    (counts 0, author / url / created_at NULL)."""
    defaults = {"like_count": F.lit(0).cast("long"), "comment_count": F.lit(0).cast("long"),
                "retweet_count": F.lit(0).cast("long"), "view_count": F.lit(0).cast("long"),
                "author": F.lit(None).cast("string"), "post_url": F.lit(None).cast("string"),
                "created_at": F.lit(None).cast("timestamp")}
    missing = {k: v for k, v in defaults.items() if k not in posts.columns}
    return posts.withColumns(missing) if missing else posts


def engagement_score() -> F.Column:
    """Likes + 2·comments + 3·retweets."""
    return (F.col("like_count") + F.col("comment_count") * 2 + F.col("retweet_count") * 3).cast("long")


def top_discussions(posts: DataFrame, summaries: DataFrame, k: int = 10, texts: DataFrame | None = None) -> DataFrame:
    """O3 + J2: top-k posts by engagement (stable), with the latest summary's
    sentiment and text when one exists. The k ids are broadcast (k rows) to
    pre-filter the summaries before their last-wins aggregation. Where
    ``posts`` has no ``text``, it comes from ``texts`` (id, text), for k rows."""
    scored = ensure_post_columns(posts).withColumn("engagement", engagement_score())
    order = [F.col("engagement").desc(), *[F.col(c).asc() for c in POST_ORDER]]
    top = top_k(scored, k, order)
    if texts is not None and "text" not in top.columns:
        t = texts.select("id", "text").join(F.broadcast(top.select("id")), "id", "left_semi").dropDuplicates(["id"])
        top = top.join(F.broadcast(t), "id", "left")
    ids = top.select(F.col("id").alias("post_id"))
    s = summaries.join(F.broadcast(ids), on="post_id", how="left_semi")
    s = latest_summaries(s, ("sentiment", "summary")).drop(*POST_ORDER).withColumnRenamed("post_id", "id")
    return top.join(F.broadcast(s), on="id", how="left")


def discussion_struct() -> F.Column:
    """Nested discussion record (NULL sentiment/summary are dropped by
    ``to_json``)."""
    return F.struct(
        F.col("id"), F.col("tab"), F.col("text"), F.col("author"), F.col("symbols"),
        F.struct(F.col("like_count").alias("likes"), F.col("comment_count").alias("comments"),
                 F.col("retweet_count").alias("retweets")).alias("engagement"),
        F.col("post_url").alias("url"),
        F.col("sentiment"), F.col("summary"))


def top_per_tab(rows: DataFrame, item: str, n: int = 3) -> DataFrame:
    """The ``n`` most frequent items per tab (ties by item), as a sorted-by-
    rank array; a partial ``WindowGroupLimit`` bounds what a hot tab ships."""
    c = rows.groupBy("tab", item).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("tab").orderBy(F.col("_n").desc(), F.col(item).asc())
    r = c.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n)
    return r.groupBy("tab").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rk", item))), lambda s: s[item]).alias(f"top_{item}s"))


def capture_log_stats(log: DataFrame) -> DataFrame:
    """(tab, crawl_duration_seconds, errors_count) of a capture log (tab, at,
    error): from the first to the last entry of the tab, and its failed ones."""
    return log.groupBy("tab").agg(
        ((F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))) / F.lit(1e6)).alias("crawl_duration_seconds"),
        F.count_if("error").cast("long").alias("errors_count"))


def tab_statistics(raw: DataFrame, posts: DataFrame, summaries: DataFrame, tabs: DataFrame,
                   top_n: int = 3, log: DataFrame | None = None) -> DataFrame:
    """A9 + J7: one row per configured tab (empty tabs included).

    total_posts: captured rows; valid_posts: posts kept; duplicate_posts:
    captured rows long enough whose id another row has taken (``raw`` has
    ``tab`` and ``candidate``, true for these); dropped_posts: all that were not kept; class
    counts through J1; the top symbols and themes; earliest/latest post time;
    duration and errors from the capture ``log`` (tab, at, error), 0 without one."""
    cand = F.count_if("candidate").cast("long") if "candidate" in raw.columns else F.lit(None).cast("long")
    raw_counts = raw.groupBy("tab").agg(F.count(F.lit(1)).alias("total_posts"), cand.alias("candidates"))
    zero = F.lit(0).cast("long")
    if log is None:
        logged = tabs.select("tab", F.lit(0.0).alias("crawl_duration_seconds"), zero.alias("errors_count"))
    else:
        logged = capture_log_stats(log)
    j = posts_with_sentiment(posts, summaries, ("sentiment",))
    cls = sentiment_class("sentiment")
    created = F.col("created_at") if "created_at" in posts.columns else F.lit(None).cast("timestamp")
    kept = j.groupBy("tab").agg(
        F.count(F.lit(1)).alias("valid_posts"),
        F.count_if(cls == "positive").cast("long").alias("positive_posts"),
        F.count_if(cls == "neutral").cast("long").alias("neutral_posts"),
        F.count_if(cls == "negative").cast("long").alias("negative_posts"),
        F.min(created).alias("earliest_post"), F.max(created).alias("latest_post"))
    tops = top_per_tab(posts.select("tab", F.explode(F.array_distinct("symbols")).alias("symbol")),
                       "symbol", top_n)
    by_theme = top_per_tab(summaries.select("tab", F.explode(F.concat(
        F.coalesce("themes", F.array().cast("array<string>")), F.coalesce("sectors", F.array().cast("array<string>")))).alias("theme")),
        "theme", top_n)
    out = with_spine(tabs, raw_counts.join(kept, "tab", "full").join(logged, "tab", "full")) \
        .join(tops, "tab", "left").join(by_theme, "tab", "left")
    return out.select(
        "tab", "tab_rank",
        F.coalesce("total_posts", zero).alias("total_posts"),
        F.coalesce("valid_posts", zero).alias("valid_posts"),
        (F.coalesce("total_posts", zero) - F.coalesce("valid_posts", zero)).alias("dropped_posts"),
        F.greatest(F.coalesce("candidates", zero) - F.coalesce("valid_posts", zero), zero).alias("duplicate_posts"),
        F.coalesce("positive_posts", zero).alias("positive_posts"),
        F.coalesce("neutral_posts", zero).alias("neutral_posts"),
        F.coalesce("negative_posts", zero).alias("negative_posts"),
        F.coalesce("top_symbols", F.array().cast("array<string>")).alias("top_stocks"),
        F.coalesce("top_themes", F.array().cast("array<string>")).alias("top_themes"),
        "earliest_post", "latest_post", F.coalesce("crawl_duration_seconds", F.lit(0.0)).alias("crawl_duration_seconds"),
        F.coalesce("errors_count", zero).alias("errors_count"))


def tab_counts(posts: DataFrame) -> DataFrame:
    """Posts per tab and the total (tab NULL) in one rollup pass."""
    return posts.rollup("tab").agg(F.count(F.lit(1)).alias("n"))


def run_summary(posts: DataFrame, summaries: DataFrame, tabs: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Totals of a run, one aggregate over the tagged union of its inputs;
    duration (first to last entry) and errors come from the capture ``log`` (tab, at, error)."""
    u = (posts.select(F.lit(0).alias("_src"))
         .unionByName(summaries.select(F.lit(1).alias("_src")))
         .unionByName(tabs.select(F.lit(2).alias("_src"))))
    if log is None:
        u = u.withColumns({"at": F.lit(None).cast("timestamp"), "error": F.lit(None).cast("boolean")})
    else:
        u = u.unionByName(log.select(F.lit(3).alias("_src"), F.col("at").cast("timestamp").alias("at"), "error"), allowMissingColumns=True)
    return u.agg(F.count_if(F.col("_src") == 0).cast("long").alias("total_posts"),
                 F.count_if(F.col("_src") == 1).cast("long").alias("total_summaries"),
                 F.count_if(F.col("_src") == 2).cast("long").alias("tabs_crawled"),
                 F.coalesce((F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))) / F.lit(1e6), F.lit(0.0)).alias("duration_seconds"),
                 F.count_if(F.col("error")).cast("long").alias("errors"))


def global_rank(df: DataFrame, order: list, rank_col: str = "rank") -> DataFrame:
    """1-based rank under a total order, without a single-partition window.

    The range-partitioned sort keeps rows in order inside and across
    partitions; ``monotonically_increasing_id`` then holds (partition,
    position). Per-partition row counts (one row per partition) give prefix
    offsets, joined back by partition id (bounded by the partition count)."""
    s = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    s = s.withColumn("_pid", F.shiftright("_mid", 33))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0))).select("_pid", "_off")
    out = s.join(F.broadcast(offs), "_pid")
    pos = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn(rank_col, (F.col("_off") + pos + 1).cast("long")).drop("_mid", "_pid", "_off")
