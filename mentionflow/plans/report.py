"""The Markdown report as a DataFrame of ordered lines, and K3/K4.

Every section is a small DataFrame ``(section_no, item_no, line_no, line)``
built from the aggregates (top-k limits keep each section bounded: 10 themes,
20 stocks, 15 themes, 10 discussions, the tab dimension, 10 stock details),
so only display rows are ever brought together. Optional lines are NULL and
dropped. ``report_lines`` unions the sections; ``write_report`` writes them
in order as one text file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import format_number, sentiment_icon, truncate
from ..functions.formatting import bar, format_timestamp
from ..functions.lexicons import (QUOTE_LEN, REPORT_FOOTER, REPORT_SOURCE_LINE, REPORT_TITLE,
                                  TREND_ICONS)
from ..functions.sentiment import market_mood
from ..operators import analytics as A

LINE_COLS = ["section_no", "item_no", "line_no", "line"]


def _lines(df: DataFrame, section: int, item: Column, lines: list) -> DataFrame:
    """Explode a list of line expressions per row; NULL lines are skipped."""
    arr = F.array(*[(F.lit(x) if isinstance(x, str) else x).cast("string") for x in lines])
    out = df.select(F.lit(section).alias("section_no"), item.cast("long").alias("item_no"),
                    F.posexplode(arr).alias("line_no", "line"))
    return out.filter(F.col("line").isNotNull()).select(
        "section_no", "item_no", F.col("line_no").cast("long").alias("line_no"), "line")


def _static(spark, section: int, lines: list, item: int = 0) -> DataFrame:
    return _lines(spark.range(1), section, F.lit(item), lines)


def _s(c) -> Column:
    return F.col(c).cast("string")


def _trend_icon(trend: Column) -> Column:
    return (F.when(trend == "up", F.lit(TREND_ICONS["up"]))
            .when(trend == "down", F.lit(TREND_ICONS["down"])).otherwise(F.lit(TREND_ICONS["stable"])))


def _fill(template: str, value: Column) -> Column:
    """``template`` with its one ``{…}`` slot replaced by ``value``."""
    head, _, rest = template.partition("{")
    tail = rest.partition("}")[2]
    return F.concat(F.lit(head), value, F.lit(tail))


def header(totals: DataFrame, job_name: Column, generated: Column, title: str = REPORT_TITLE) -> DataFrame:
    """Title and totals."""
    return _lines(totals, 1, F.lit(0), [
        _fill(title, job_name), "",
        F.concat(F.lit("**Generated:** "), generated),
        F.concat(F.lit("**Total Posts Collected:** "), format_number("total_posts_collected")),
        F.concat(F.lit("**Unique Posts:** "), format_number("total_unique_posts")),
        F.concat(F.lit("**Posts Summarized:** "), format_number("total_posts_summarized")), ""])


def one_decimal(x: Column) -> Column:
    """One digit after the point, a tie of the exact binary value to the even
    digit (``format_number`` rounds so; ``%.1f`` would round ties up)."""
    return F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))


def executive_summary(overall: DataFrame) -> DataFrame:
    """R2: mood sentence, omitted when there are no summaries."""
    tot = F.col("positive") + F.col("negative") + F.col("neutral")

    def pct(c):
        return one_decimal(F.col(c) / tot * 100.0)
    sentence = F.when(tot > 0, F.concat(
        F.lit("Overall market sentiment is **"), market_mood("positive", "negative", "neutral"),
        F.lit("** with "), pct("positive"), F.lit("% positive, "), pct("negative"),
        F.lit("% negative, and "), pct("neutral"), F.lit("% neutral discussions.")))
    return _lines(overall, 2, F.lit(0), ["## Executive Summary", "", sentence, ""])


def key_points(themes_ranked: DataFrame, quotes: DataFrame, k: int = 10) -> DataFrame:
    """Top themes with an icon and their first quote."""
    spark = themes_ranked.sparkSession
    t = themes_ranked.filter(F.col("rank") <= k).join(quotes, "theme", "left")
    icon = sentiment_icon(F.when(F.col("trend") == "up", F.lit("positive"))
                          .when(F.col("trend") == "down", F.lit("negative")).otherwise(F.lit("neutral")))
    q0 = F.element_at(F.col("quotes"), 1)
    body = _lines(t, 3, F.col("rank"), [
        F.concat(_s("rank"), F.lit(". **"), F.col("theme"), F.lit("** ("), _s("mention_count"),
                 F.lit(" mentions) "), icon),
        F.when(F.size("quotes") > 0, F.concat(F.lit('   - *"'), truncate(q0, QUOTE_LEN), F.lit('"*')))])
    head = _static(spark, 3, ["## Key Discussion Points", ""], 0)
    tail = _static(spark, 3, [""], 1_000_000)
    return head.unionByName(body).unionByName(tail)


def stock_table(top_stocks: DataFrame) -> DataFrame:
    """Most discussed stocks table (top 20 ranked)."""
    spark = top_stocks.sparkSession
    head = _static(spark, 4, ["## Most Discussed Stocks", "",
                              "| Rank | Symbol | Mentions | Sentiment | Bullish | Bearish | Neutral |",
                              "|------|--------|----------|-----------|---------|---------|---------|"])
    rows = _lines(top_stocks, 4, F.col("rank"), [F.concat_ws(
        " ", F.lit("|"), _s("rank"), F.lit("|"), F.col("symbol"), F.lit("|"), _s("mention_count"),
        F.lit("|"), sentiment_icon("overall_sentiment"), F.lit("|"), _s("positive_mentions"), F.lit("|"),
        _s("negative_mentions"), F.lit("|"), _s("neutral_mentions"), F.lit("|"))])
    return head.unionByName(rows).unionByName(_static(spark, 4, [""], 1_000_000))


def sentiment_section(overall: DataFrame) -> DataFrame:
    """Class counts."""
    return _lines(overall, 5, F.lit(0), [
        "## Sentiment Distribution", "",
        F.concat(F.lit("📈 **Positive:** "), _s("positive"), F.lit(" posts")),
        F.concat(F.lit("➡️ **Neutral:** "), _s("neutral"), F.lit(" posts")),
        F.concat(F.lit("📉 **Negative:** "), _s("negative"), F.lit(" posts")), ""])


def themes_section(themes_ranked: DataFrame, related: DataFrame, k: int = 15) -> DataFrame:
    """Top themes with trend icon, related stocks (first 5), sentiment."""
    spark = themes_ranked.sparkSession
    t = themes_ranked.filter(F.col("rank") <= k).join(related, "theme", "left")
    body = _lines(t, 6, F.col("rank"), [
        F.concat(F.lit("### "), F.col("theme"), F.lit(" "), _trend_icon(F.col("trend"))),
        F.concat(F.lit("- **Mentions:** "), _s("mention_count")),
        F.when(F.size("related_stocks") > 0,
               F.concat(F.lit("- **Related Stocks:** "), F.array_join(F.slice("related_stocks", 1, 5), ", "))),
        F.concat(F.lit("- **Sentiment:** Positive "), _s("positive"), F.lit(", Negative "), _s("negative"),
                 F.lit(", Neutral "), _s("neutral")), ""])
    return _static(spark, 6, ["## Investment Themes & Sectors", ""]).unionByName(body)


def discussions_section(top: DataFrame) -> DataFrame:
    """Top discussions, verbatim."""
    spark = top.sparkSession
    author = F.coalesce(F.col("author"), F.lit("None"))
    body = _lines(top, 7, F.col("rank"), [
        F.concat(F.lit("### Discussion #"), _s("rank")),
        F.concat(F.lit("**Tab:** "), F.col("tab"), F.lit(" | **Author:** "), author),
        F.when(F.size("symbols") > 0, F.concat(F.lit("**Stocks Mentioned:** "), F.array_join("symbols", ", "))),
        F.when(F.col("sentiment").isNotNull(), F.concat(F.lit("**Sentiment:** "), F.col("sentiment"))),
        "", F.concat(F.lit("> "), F.col("text")), "",
        F.concat(F.lit("*👍 "), _s("like_count"), F.lit(" | 💬 "), _s("comment_count"), F.lit(" | 🔄 "),
                 _s("retweet_count"), F.lit("*")),
        F.when(F.col("post_url").isNotNull(), F.concat(F.lit("[View Original]("), F.col("post_url"), F.lit(")"))),
        "", "---", ""])
    return _static(spark, 7, ["## Representative Discussions (Verbatim Quotes)", ""]).unionByName(body)


def tabs_section(stats: DataFrame) -> DataFrame:
    """Per-tab collection statistics, in tab order."""
    spark = stats.sparkSession
    head = _static(spark, 8, ["## Data Collection Statistics", "", "| Tab | Posts | Duration (s) | Errors |",
                              "|-----|-------|--------------|--------|"])
    rows = _lines(stats, 8, F.col("tab_rank") + 1, [F.concat(
        F.lit("| "), F.col("tab"), F.lit(" | "), _s("valid_posts"), F.lit(" | "),
        one_decimal(F.col("crawl_duration_seconds")), F.lit(" | "), _s("errors_count"), F.lit(" |"))])
    return head.unionByName(rows).unionByName(_static(spark, 8, [""], 1_000_000))


def stock_details(top_stocks: DataFrame, k: int = 10) -> DataFrame:
    """Ratio and bars of the top stocks."""
    spark = top_stocks.sparkSession
    t = top_stocks.filter(F.col("rank") <= k)
    tot = F.col("positive_mentions") + F.col("negative_mentions") + F.col("neutral_mentions")
    has = tot > 0
    body = _lines(t, 9, F.col("rank"), [
        F.concat(F.lit("### "), F.col("symbol")),
        F.concat(F.lit("**Total Mentions:** "), _s("mention_count")),
        F.concat(F.lit("**Sentiment Ratio:** "), one_decimal(F.col("sentiment_ratio") * 100.0),
                 F.lit("% bullish")), "",
        F.when(has, F.lit("```")),
        F.when(has, F.concat(F.lit("Bullish:  "), bar("positive_mentions", tot), F.lit(" ("), _s("positive_mentions"), F.lit(")"))),
        F.when(has, F.concat(F.lit("Bearish:  "), bar("negative_mentions", tot), F.lit(" ("), _s("negative_mentions"), F.lit(")"))),
        F.when(has, F.concat(F.lit("Neutral:  "), bar("neutral_mentions", tot), F.lit(" ("), _s("neutral_mentions"), F.lit(")"))),
        F.when(has, F.lit("```")), ""])
    return _static(spark, 9, ["## Detailed Stock Analysis", ""]).unionByName(body)


def footer(spark, generated: Column, footer_line: str = REPORT_FOOTER,
           source_line: str = REPORT_SOURCE_LINE) -> DataFrame:
    return _lines(spark.range(1), 10, F.lit(0), ["---", "", footer_line, _fill(source_line, generated)])


def report_lines(posts: DataFrame, summaries: DataFrame, stats: DataFrame,
                 job_end: Column | None = None, job_name: Column | None = None,
                 title: str = REPORT_TITLE, footer_line: str = REPORT_FOOTER,
                 source_line: str = REPORT_SOURCE_LINE, texts: DataFrame | None = None) -> DataFrame:
    """All sections as ordered lines. ``job_end`` defaults to now; the
    title and closing lines are parameters (``{…}`` marks the value slot).
    ``texts`` (id, text) is where R7 finds its ten texts if ``posts`` has none."""
    spark = posts.sparkSession
    end = job_end if job_end is not None else F.current_timestamp()
    generated = format_timestamp(end)
    name = job_name if job_name is not None else F.date_format(end, "'run_'yyyyMMdd_HHmmss")
    totals = A.job_totals(posts, summaries)
    overall = A.overall_counts(summaries)
    th = A.themes(summaries)
    themes_ranked = A.top_k(th, 15, A.theme_order())
    quotes = A.theme_quotes(summaries, 3)
    related = A.theme_stock_lists(summaries, 5)
    top_stocks = A.top_stocks(posts, summaries, 20)
    top = A.top_discussions(posts, summaries, 10, texts)
    if "post_url" not in top.columns:
        top = top.withColumn("post_url", F.lit(None).cast("string"))
    if "author" not in top.columns:
        top = top.withColumn("author", F.lit(None).cast("string"))
    parts = [header(totals, name, generated, title), executive_summary(overall),
             key_points(themes_ranked, quotes, 10), stock_table(top_stocks),
             sentiment_section(overall), themes_section(themes_ranked, related, 15),
             discussions_section(top), tabs_section(stats), stock_details(top_stocks, 10),
             footer(spark, generated, footer_line, source_line)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_report(lines: DataFrame, path: str) -> str:
    """K3: one ordered Markdown text file (single partition: the report is
    bounded by its display limits)."""
    (lines.repartition(1).sortWithinPartitions(*LINE_COLS[:3]).select("line")
     .write.mode("overwrite").text(path))
    return path


def report_document(posts: DataFrame, summaries: DataFrame, stats: DataFrame,
                    job_name: Column, job_end: Column, top_k: int = 10, texts: DataFrame | None = None) -> DataFrame:
    """The one-row part of the nested report: job, totals, overall
    sentiment, per-tab statistics (the tab dimension) and the top
    discussions (P27, k rows). Every list in it is bounded."""
    totals = A.job_totals(posts, summaries)
    overall = A.overall_counts(summaries).select(F.create_map(
        F.lit("positive"), F.col("positive"), F.lit("neutral"), F.col("neutral"),
        F.lit("negative"), F.col("negative")).alias("overall_sentiment"))
    tabs = stats.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        F.col("tab"), F.struct(*[F.col(c) for c in stats.columns if c != "tab_rank"]))))).alias("tab_statistics"))
    top = A.top_discussions(posts, summaries, top_k, texts)
    for c in ("author", "post_url"):
        if c not in top.columns:
            top = top.withColumn(c, F.lit(None).cast("string"))
    disc = top.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", A.discussion_struct().alias("d")))),
                               lambda x: x["d"]).alias("top_discussions"))
    # four single-row frames → one row: union (missing columns NULL) and
    # take the non-NULL value of each column
    parts = [totals, overall, tabs, disc]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    cols = [c for p in parts for c in p.columns]
    one = u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])
    return one.select(job_name.alias("job_name"), job_end.alias("job_end"), *cols)


def write_report_json(posts: DataFrame, summaries: DataFrame, stats: DataFrame, path: str,
                      job_name: Column, job_end: Column, texts: DataFrame | None = None) -> str:
    """K4: ``path/summary`` (one JSON document: totals, tabs, top
    discussions) plus ``path/stock_mentions`` and ``path/themes`` as JSON
    Lines (one row per symbol / theme, written in parallel). A single
    document holding every symbol would funnel an unbounded list into one
    task, so those lists are separate parts of the same report."""
    report_document(posts, summaries, stats, job_name, job_end, texts=texts).coalesce(1) \
        .write.mode("overwrite").json(f"{path}/summary")
    m = A.stock_mentions(posts, summaries).join(A.stock_names(posts, summaries), "symbol", "left") \
        .join(A.stock_samples(posts, 5), "symbol", "left").drop("first_pos")
    m.write.mode("overwrite").json(f"{path}/stock_mentions")
    t = A.themes(summaries).join(A.theme_quotes(summaries, 3), "theme", "left") \
        .join(A.theme_stock_lists(summaries), "theme", "left").drop("first_pos")
    t.write.mode("overwrite").json(f"{path}/themes")
    return path
