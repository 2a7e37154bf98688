"""Registered queries: ``(spark, sf_dir) -> DataFrame`` over the whole tables.

Column names equal those of the matching oracle SQL in ``oracle.py``.
Arrays are rendered with ``array_join(.., '|')`` and doubles rounded to 6
places so results compare by value.
"""

from __future__ import annotations

import uuid as _uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import (bar, calculate_progress, canonical_symbols, clean_text, content_hash,
                         content_key, extract_symbols, extract_urls, format_number,
                         is_valid_post, long_enough, parse_timestamp_number,
                         parse_timestamp_string, post_problems, sectors, sentiment_icon, truncate,
                         xxh64_hex)
from ..functions.lexicons import TEST_SECTOR_KEYWORDS, TEST_SENTIMENT_KEYWORDS
from ..functions.sentiment import with_keyword_sentiment
from ..operators import analytics as A
from ..operators import dedup as DD
from ..operators import enrich as E
from ..operators import lexicon_join as LJ
from ..session import read_table, scratch_path, staged
from ..sources import blocks as BL
from ..sources import driver_tables as D
from ..sources import pages as PG
from ..sources import store as ST
from ..sources import tabs as TB
from ..streaming import ordered as SO
from ..streaming import streams as SS
from . import report as RP

QUERIES: dict = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


@register("stock_mentions")
def stock_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most discussed stocks, top 20."""
    posts = D.posts(spark, sf_dir, engage=False)
    summ = D.labelled_summaries(spark, sf_dir)
    top = A.top_stocks(posts, summ, 20)
    return top.select(
        F.col("rank").cast("long").alias("rank"), "symbol", "mention_count", "positive_mentions",
        "neutral_mentions", "negative_mentions", "overall_sentiment",
        _r6("sentiment_ratio").alias("sentiment_ratio"))


# ---------------------------------------------------------------- helpers


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


def _joined(c) -> F.Column:
    return F.array_join(F.col(c) if isinstance(c, str) else c, "|")


# ------------------------------------------------------ text and keys (P*)
@register("clean_text")
def q_clean_text(spark, sf_dir):
    """P2 + P3 on every document."""
    d = _docs(spark, sf_dir).filter(long_enough("text"))
    c = clean_text("text")
    return d.select("doc_id", F.md5(c).alias("text_md5"), F.length(c).cast("long").alias("n"))


@register("clean_pages")
def q_clean_pages(spark, sf_dir):
    """P3 on raw web pages (tags, scripts' text kept, entities kept)."""
    p = read_table(spark, sf_dir, "pages")
    c = clean_text("html")
    return p.select("page_id", F.md5(c).alias("text_md5"), F.length(c).cast("long").alias("n"))


@register("content_key")
def q_content_key(spark, sf_dir):
    """Key of cleaned text joined with its source (md5 variant)."""
    d = _docs(spark, sf_dir).withColumn("t", clean_text("text"))
    return d.select("doc_id", content_key("t", "source", key_fn="md5").alias("key"))


@register("content_hash")
def q_content_hash(spark, sf_dir):
    """P5: key of text:author:tab, author missing (md5 variant)."""
    d = _docs(spark, sf_dir).withColumn("t", clean_text("text"))
    return d.select("doc_id", content_hash("t", F.lit(None).cast("string"), "source",
                                           key_fn="md5").alias("key"))


@register("content_key_xxh64")
def q_content_key_xxh64(spark, sf_dir):
    """P4 with the native xxh64 key (checked against published vectors)."""
    d = _docs(spark, sf_dir).withColumn("t", clean_text("text"))
    return d.select("doc_id", xxh64_hex("t").alias("key"))


@register("symbols")
def q_symbols(spark, sf_dir):
    """P6 on every ticker-bearing document text."""
    d = D.documents_raw(spark, sf_dir)
    s = extract_symbols("raw_text")
    return d.select(F.col("ingest_seq").alias("doc_id"), _joined(s).alias("symbols"),
                    F.size(s).cast("long").alias("n_symbols"))


@register("symbols_canonical")
def q_symbols_canonical(spark, sf_dir):
    """Ticker twins merged."""
    d = D.documents_raw(spark, sf_dir)
    s = canonical_symbols(extract_symbols("raw_text"))
    return d.select(F.col("ingest_seq").alias("doc_id"), _joined(s).alias("symbols"))


@register("urls")
def q_urls(spark, sf_dir):
    """P7 over page URL + raw HTML."""
    p = read_table(spark, sf_dir, "pages")
    t = F.concat(F.lit("see "), F.col("url"), F.lit(" and "), F.col("html"))
    u = extract_urls(t)
    return p.select("page_id", _joined(u).alias("urls"), F.size(u).cast("long").alias("n_urls"))


@register("keyword_sentiment")
def q_keyword_sentiment(spark, sf_dir):
    """P8 with the Latin test lexicon on cleaned documents."""
    d = _docs(spark, sf_dir).select("doc_id", clean_text("text").alias("t"))
    k = with_keyword_sentiment(d, "t", TEST_SENTIMENT_KEYWORDS, prefix="")
    return k.select("doc_id", "label", _r6("score").alias("score"),
                    F.col("pos_hits").cast("long").alias("pos_hits"),
                    F.col("neg_hits").cast("long").alias("neg_hits"),
                    F.col("neu_hits").cast("long").alias("neu_hits"))


@register("keyword_sentiment_join")
def q_keyword_sentiment_join(spark, sf_dir):
    """The same classification as a join against a lexicon table."""
    d = _docs(spark, sf_dir).select("doc_id", clean_text("text").alias("text"))
    lex = LJ.lexicon_frame(spark, TEST_SENTIMENT_KEYWORDS)
    out = LJ.sentiment_by_join(d, lex, key="doc_id", text="text")
    return out.select("doc_id", "label", _r6("score").alias("score"), "pos_hits", "neg_hits", "neu_hits")


@register("lexicon_hits")
def q_lexicon_hits(spark, sf_dir):
    """J5 with a lexicon from the data: in how many documents each word of the benchmark, product name and nation occurs (as a sub-string)."""
    words = read_table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("keyword"))
    words = words.unionByName(read_table(spark, sf_dir, "part").select(F.lower("p_name").alias("keyword"))).unionByName(
        read_table(spark, sf_dir, "nation").select(F.lower("n_name").alias("keyword"))).filter(F.length("keyword").between(2, 30)).distinct()
    d = _docs(spark, sf_dir).select("doc_id", clean_text("text").alias("text"))
    hits = LJ.keyword_hits(d, words.select(F.lit("any").alias("label"), "keyword"), "doc_id", "text", lower=True)
    return hits.groupBy("keyword").agg(F.count("*").alias("documents"))


@register("sectors")
def q_sectors(spark, sf_dir):
    """P9 with the test sector lexicon (case-sensitive, ordered)."""
    d = _docs(spark, sf_dir)
    return d.select("doc_id", _joined(sectors(clean_text("text"), TEST_SECTOR_KEYWORDS)).alias("sectors"))


@register("truncate")
def q_truncate(spark, sf_dir):
    """P10: 200-character preview and 100-character summary stem."""
    d = _docs(spark, sf_dir).withColumn("t", clean_text("text"))
    return d.select("doc_id", truncate("t", 200).alias("preview"), truncate("t", 100).alias("short"))


@register("parse_timestamp")
def q_parse_timestamp(spark, sf_dir):
    """P12 + P11: event times rendered in the 4 string forms and as epoch
    seconds / milliseconds, parsed back and formatted."""
    e = read_table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")  # stored without zone; session zone is UTC
    forms = {
        "f_iso_frac": parse_timestamp_string(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")),
        "f_iso": parse_timestamp_string(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        "f_space": parse_timestamp_string(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")),
        "f_date": parse_timestamp_string(F.date_format(ts, "yyyy-MM-dd")),
        "f_epoch_s": parse_timestamp_number(F.unix_seconds(ts)),
        "f_epoch_ms": parse_timestamp_number(F.unix_millis(ts)),
        "f_bad": parse_timestamp_string(F.concat(F.lit("bad "), F.col("event_id").cast("string"))),
    }
    return e.select("event_id", *[F.date_format(v, "yyyy-MM-dd HH:mm:ss").alias(k) for k, v in forms.items()])


@register("progress")
def q_progress(spark, sf_dir):
    """Share of purchase events per user, in percent."""
    e = read_table(spark, sf_dir, "events")
    g = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("cur"),
                                 F.count(F.lit(1)).alias("total"))
    return g.select("user_id", _r6(calculate_progress("cur", "total")).alias("progress"))


@register("format_number")
def q_format_number(spark, sf_dir):
    """Thousands separators on per-type event counts and value sums."""
    e = read_table(spark, sf_dir, "events")
    g = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"),
                                    F.sum(F.round(F.col("value") * 1000)).cast("long").alias("v"))
    return g.select("event_type", format_number("n").alias("n_fmt"), format_number("v").alias("v_fmt"))


@register("sentiment_icon")
def q_sentiment_icon(spark, sf_dir):
    """Icon of a label (case-insensitive, unknown labels → ❓)."""
    lab = read_table(spark, sf_dir, "labels")
    s = (F.when(F.col("toxic") == 1, F.lit("Negative")).when(F.col("quality") == 1, F.lit("POSITIVE"))
         .when(F.col("doc_id") % 2 == 0, F.lit("neutral")).otherwise(F.lit("meh")))
    return lab.select("doc_id", s.alias("label"), sentiment_icon(s).alias("icon"))


@register("bars")
def q_bars(spark, sf_dir):
    """P22 + P19: text bars and bullish ratio of every symbol."""
    m = A.stock_mentions(D.posts(spark, sf_dir, engage=False), D.labelled_summaries(spark, sf_dir))
    tot = F.col("positive_mentions") + F.col("negative_mentions") + F.col("neutral_mentions")
    return m.select("symbol", bar("positive_mentions", tot).alias("bull_bar"),
                    bar("negative_mentions", tot).alias("bear_bar"),
                    bar("neutral_mentions", tot).alias("neutral_bar"),
                    _r6(F.col("sentiment_ratio") * 100).alias("ratio_pct"))


@register("valid_split")
def q_valid_split(spark, sf_dir):
    """P1 + P16: planted bad rows are flagged with their reasons."""
    d = _docs(spark, sf_dir)
    t = clean_text("text")
    rows = d.select(
        "doc_id",
        F.when(F.col("doc_id") % 50 == 0, F.lit("")).otherwise(F.md5(t)).alias("id"),
        F.when(F.col("doc_id") % 45 == 0, F.lit(" \t ")).otherwise(t).alias("text"),
        F.when(F.col("doc_id") % 60 == 0, F.lit(None).cast("string")).otherwise(F.col("source")).alias("tab"),
        F.when(F.col("doc_id") % 40 == 0, F.lit(-1)).otherwise(F.col("n_chars")).cast("long").alias("like_count"),
        F.lit(0).cast("long").alias("comment_count"), F.lit(0).cast("long").alias("retweet_count"),
        F.lit(0).cast("long").alias("view_count"))
    return rows.select("doc_id", is_valid_post().alias("valid"), _joined(post_problems()).alias("reasons"))


# ------------------------------------------------------------- enrichment
def _posts_md5(spark, sf_dir, engage=False):
    return D.posts(spark, sf_dir, key_fn="md5", engage=engage)


@register("fallback_summary")
def q_fallback_summary(spark, sf_dir):
    """P23 over every post (test lexicons)."""
    s = E.fallback_summaries(_posts_md5(spark, sf_dir), TEST_SENTIMENT_KEYWORDS, TEST_SECTOR_KEYWORDS)
    return s.select("post_id", "summary", "sentiment", _r6("sentiment_score").alias("sentiment_score"),
                    _joined("sectors").alias("sectors"), _joined("tickers").alias("tickers"),
                    "original_text_preview", "model_used")


@register("parse_responses")
def q_parse_responses(spark, sf_dir):
    """P24 + P25 + P26: one summary per post from its model reply or the fallback."""
    p = staged(_posts_md5(spark, sf_dir), "posts")  # posts, and the replies that are made from them
    s = E.summarize(p, D.model_responses(p))
    return s.select("post_id", "model_used", "sentiment", _r6("sentiment_score").alias("sentiment_score"),
                    _joined("tickers").alias("tickers"), "summary",
                    _joined(F.concat("themes", "sectors")).alias("topics"),
                    _joined("companies").alias("companies"), "sentiment_reasoning")


@register("prompt")
def q_prompt(spark, sf_dir):
    """Request text per post."""
    pr = E.prompts(_posts_md5(spark, sf_dir))
    return pr.select("post_id", F.md5("user_prompt").alias("prompt_md5"),
                     (F.length("system_prompt") + F.length("user_prompt")).cast("long").alias("prompt_len"))


def _echo_responder(system_prompt: str, user_prompt: str):
    """A local stand-in for a model: a valid reply for most posts, garbage
    or an exception for some."""
    n = len(user_prompt)
    if n % 7 == 0:
        raise RuntimeError("simulated call failure")
    if n % 5 == 0:
        return "not json"
    label = ("positive", "negative", "neutral")[n % 3]
    return ('{"summary": "echo", "sentiment": "%s", "sentiment_score": 0.25}' % label, n % 500)


@register("enrich_udf")
def q_enrich_udf(spark, sf_dir):
    """U2 + U3: responder run by mapInPandas, then parse-or-fallback."""
    p = staged(_posts_md5(spark, sf_dir), "posts")
    r = E.respond_with(p, _echo_responder)
    s = E.summarize(p, r)
    return s.select("post_id", "model_used", "sentiment")


@register("enrich_stats")
def q_enrich_stats(spark, sf_dir):
    """A10 per tab."""
    p = staged(_posts_md5(spark, sf_dir), "posts")
    return E.enrichment_stats(p, D.model_responses(p))


# ------------------------------------------------ de-dup, caps, selection


@register("first_wins")
def q_first_wins(spark, sf_dir):
    """One post per id across all tabs; lowest (tab rank, capture order) wins."""
    p = _posts_md5(spark, sf_dir)
    return p.select("id", "tab", "ingest_seq")


@register("last_summary")
def q_last_summary(spark, sf_dir):
    """The latest summary per post id."""
    s = D.labelled_summaries(spark, sf_dir, key_fn="md5")
    w = A.latest_summaries(s, ("sentiment", "tab"))
    return w.select("post_id", "tab", "ingest_seq", "sentiment")


@register("tab_cap")
def q_tab_cap(spark, sf_dir):
    """At most 10 posts per tab in capture order."""
    p = _posts_md5(spark, sf_dir)
    c = DD.tab_cap(p, 10, rank_col="rn")
    return c.select("tab", F.col("ingest_seq").alias("doc_id"), F.col("rn").cast("long").alias("rn"))


def _capture(spark, sf_dir, cap):
    p = D.posts(spark, sf_dir, key_fn="md5", engage=False, max_per_tab=cap)
    return p.select("id", "tab", F.col("ingest_seq").alias("doc_id"))


@register("capture_cap_10")
def q_capture_cap_10(spark, sf_dir):
    """W1 + W2 as the capture loop has them: each tab in order takes 10 posts that no tab before it took."""
    return _capture(spark, sf_dir, 10)


@register("capture_cap_100")
def q_capture_cap_100(spark, sf_dir):
    """The same with the configured default of 100 posts."""
    return _capture(spark, sf_dir, 100)


@register("tab_select")
def q_tab_select(spark, sf_dir):
    """Tab selection with the fallback rule (unknown names dropped)."""
    dim = TB.source_tabs(spark, sf_dir)
    chosen = TB.select_tabs(dim, ["src1", "src3", "SRC5", "bogus"])
    p = _posts_md5(spark, sf_dir)
    return TB.filter_tabs(p, chosen).groupBy("tab").agg(F.count(F.lit(1)).alias("n"))


def _stored_and_new(spark, sf_dir):
    """Stored batch: posts of English documents; new batch: all posts."""
    raw = D.documents_raw(spark, sf_dir, extra=("lang",))
    allp = D.standardize_posts(raw, key_fn="md5")
    stored = allp.filter(F.col("lang") == "en")
    return stored, allp


@register("dedup_new")
def q_dedup_new(spark, sf_dir):
    """Rows of a new batch whose content hash is not stored yet."""
    stored, new = _stored_and_new(spark, sf_dir)
    fresh = DD.dedup_new(new.select("content_hash", "ingest_seq", "tab"),
                         stored.select("content_hash"), "content_hash", ("ingest_seq",))
    return fresh.select(F.col("ingest_seq").alias("doc_id"), "content_hash")


@register("dup_flag")
def q_dup_flag(spark, sf_dir):
    """Membership probe of each post's content hash in the stored set."""
    stored, new = _stored_and_new(spark, sf_dir)
    f = DD.dup_flag(new.select("content_hash", "ingest_seq"), stored.select("content_hash"))
    return f.select(F.col("ingest_seq").alias("doc_id"), "is_duplicate")


@register("new_summaries")
def q_new_summaries(spark, sf_dir):
    """J4 + U-2: summaries whose post id is not stored in their tab (no in-batch de-dup)."""
    s = D.labelled_summaries(spark, sf_dir, key_fn="md5")
    lab = read_table(spark, sf_dir, "labels").filter(F.col("quality") == 1).select(F.col("doc_id").alias("ingest_seq"))
    stored = s.join(lab, on="ingest_seq", how="left_semi")
    return DD.new_summaries(s, stored).select("post_id", F.col("ingest_seq").alias("doc_id"))


# ------------------------------------------------------------ aggregates
def _posts_summ(spark, sf_dir, key_fn="md5", engage=False):
    return (D.posts(spark, sf_dir, key_fn=key_fn, engage=engage),
            D.labelled_summaries(spark, sf_dir, key_fn=key_fn))


@register("stock_names")
def q_stock_names(spark, sf_dir):
    """A2: most frequent company per symbol (ties: first seen)."""
    p, s = _posts_summ(spark, sf_dir)
    return A.stock_names(p, s)


@register("stock_samples")
def q_stock_samples(spark, sf_dir):
    """A3: first 5 post ids per symbol in capture order."""
    p, _ = _posts_summ(spark, sf_dir)
    return A.stock_samples(p, 5).select("symbol", _joined("sample_post_ids").alias("sample_post_ids"))


@register("themes")
def q_themes(spark, sf_dir):
    """A4 + P20 + O2: theme counts, sentiment split, trend, rank."""
    _, s = _posts_summ(spark, sf_dir)
    ranked = A.global_rank(A.themes(s), A.theme_order())
    return ranked.select(F.col("rank").cast("long").alias("rank"), "theme", "mention_count",
                         "positive", "neutral", "negative", "trend")


@register("theme_stocks")
def q_theme_stocks(spark, sf_dir):
    """A5: distinct (theme, ticker) pairs."""
    _, s = _posts_summ(spark, sf_dir)
    return A.theme_stocks(s)


@register("theme_quotes")
def q_theme_quotes(spark, sf_dir):
    """First 3 previews per theme, in order."""
    _, s = _posts_summ(spark, sf_dir)
    q = A.theme_quotes(s, 3)
    return q.select("theme", F.size("quotes").cast("long").alias("n_quotes"),
                    F.md5(_joined("quotes")).alias("quotes_md5"))


@register("overall_sentiment")
def q_overall_sentiment(spark, sf_dir):
    """Class counts over all summaries."""
    _, s = _posts_summ(spark, sf_dir)
    return A.overall_counts(s)


@register("market_mood")
def q_market_mood(spark, sf_dir):
    """Mood and class shares."""
    from ..functions import market_mood, share_pct
    _, s = _posts_summ(spark, sf_dir)
    o = A.overall_counts(s)
    tot = F.col("positive") + F.col("neutral") + F.col("negative")
    return o.select(market_mood("positive", "negative", "neutral").alias("mood"),
                    _r6(share_pct("positive", tot)).alias("pos_pct"),
                    _r6(share_pct("negative", tot)).alias("neg_pct"),
                    _r6(share_pct("neutral", tot)).alias("neu_pct"))


@register("job_totals")
def q_job_totals(spark, sf_dir):
    """Posts, distinct content hashes, summaries."""
    p, s = _posts_summ(spark, sf_dir)
    return A.job_totals(p, s)


@register("sketched_totals")
def q_sketched_totals(spark, sf_dir):
    """A8 by mergeable sketches: four saves in two jobs that share posts, one save replayed. The distinct totals of each tab and
    of all come from the audits; beside them the exact ones, and whether the estimate is within four standard errors."""
    p = staged(_posts_md5(spark, sf_dir), "posts")
    layouts = [ST.JobLayout(scratch_path(spark, f"store-{_uuid.uuid4().hex}"), f"run_{j}") for j in range(2)]
    for j, k in ((0, 0), (0, 1), (0, 1), (1, 1), (1, 2)):
        ST.save_posts(p.filter(F.col("ingest_seq") % 3 == k), layouts[j], save_id=f"save-{k}", key_fn="md5")
    exact = ST.load_posts(spark, layouts[0]).unionByName(ST.load_posts(spark, layouts[1])).select("tab", "content_hash")
    exact = exact.rollup("tab").agg(F.count_distinct("content_hash").alias("exact"))
    named = F.coalesce("tab", F.lit("(all)")).alias("tab")
    both = exact.select(named, "exact").join(ST.sketched_totals(spark, layouts).select(named, "unique_posts"), "tab", "left")
    return both.select("tab", "exact", (F.abs(F.col("unique_posts") - F.col("exact")) <= F.col("exact") * 0.032 + 1).alias("close"))


@register("top_discussions")
def q_top_discussions(spark, sf_dir):
    """P17 + O3 + J2: top 10 posts by engagement with their summaries."""
    p, s = _posts_summ(spark, sf_dir, engage=True)
    t = A.top_discussions(p, s, 10)
    return t.select(F.col("rank").cast("long").alias("rank"), "id", "tab", "engagement",
                    "like_count", "comment_count", "retweet_count", "sentiment", "summary")


# ------------------------------------------------------ tabs and pages


def _fmt_ts(c):
    return F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd HH:mm:ss")


@register("tab_stats")
def q_tab_stats(spark, sf_dir):
    """A9 + J7: per-tab statistics over the tab spine (empty tabs included)."""
    seen, p = D.captured_and_posts(spark, sf_dir, "md5")
    s = staged(D.labelled_summaries(spark, sf_dir, key_fn="md5"), "summaries")
    st = A.tab_statistics(seen, staged(p.drop("text", "urls"), "posts"), s, TB.source_tabs(spark, sf_dir), log=D.capture_log(spark, sf_dir))
    return st.select("tab", "total_posts", "valid_posts", "dropped_posts", "duplicate_posts", "positive_posts",
                     "neutral_posts", "negative_posts", _joined("top_stocks").alias("top_stocks"),
                     _joined("top_themes").alias("top_themes"),
                     _fmt_ts("earliest_post").alias("earliest_post"), _fmt_ts("latest_post").alias("latest_post"),
                     _r6("crawl_duration_seconds").alias("crawl_duration_seconds"), "errors_count")


@register("tab_counts")
def q_tab_counts(spark, sf_dir):
    """Posts per tab plus the total row (tab NULL)."""
    p, _ = _posts_summ(spark, sf_dir)
    return A.tab_counts(p)


@register("run_summary")
def q_run_summary(spark, sf_dir):
    """Totals of the run."""
    p, s = _posts_summ(spark, sf_dir)
    r = A.run_summary(p, s, TB.source_tabs(spark, sf_dir), D.capture_log(spark, sf_dir))
    return r.withColumn("duration_seconds", _r6("duration_seconds"))


@register("page_posts")
def q_page_posts(spark, sf_dir):
    """S5 + P1: posts extracted from captured pages."""
    pg = read_table(spark, sf_dir, "pages")
    pp = PG.page_posts(pg, key_fn="md5")
    return pp.select("page_id", F.col("pos").cast("long").alias("pos"), "id", "tab", "text",
                     _joined("urls").alias("urls"))


@register("selected_blocks")
def q_selected_blocks(spark, sf_dir):
    """Elements by tag and class with their nesting, cleaned (the pages have articles, advertisements, lists and open paragraphs)."""
    b = BL.selected_blocks(read_table(spark, sf_dir, "pages"), ("article", ".ad", "div[class*='item__']", "nav", "li", "p", "b"))
    return BL.cleaned_blocks(b)


@register("selected_posts")
def q_selected_posts(spark, sf_dir):
    """S5 + W2 + P1: posts of the elements that the capture loop selects."""
    p = BL.selected_posts(read_table(spark, sf_dir, "pages"), key_fn="md5")
    return p.select("page_id", "pos", "id", "tab", "text", _joined("urls").alias("urls"))


# ------------------------------------------------------------- report


def _report_inputs(spark, sf_dir):
    """(posts, summaries, statistics, the last event, (id, text) of the posts)."""
    seen, p = D.captured_and_posts(spark, sf_dir, "md5")
    s = D.labelled_summaries(spark, sf_dir, key_fn="md5")
    # every section reads posts and summaries: they are written once to the shared
    # folder, and the texts are read for the ten top discussions only
    p, s = staged(p.drop("urls"), "posts"), staged(s, "summaries")
    stats = A.tab_statistics(seen, p, s, TB.source_tabs(spark, sf_dir), log=D.capture_log(spark, sf_dir))
    end = read_table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("e"))
    return p.drop("text"), s, stats, end, p.select("id", "text")


@register("report_lines")
def q_report_lines(spark, sf_dir):
    """The whole Markdown report as ordered lines; the report time is
    the last event time (deterministic)."""
    p, s, stats, end, texts = _report_inputs(spark, sf_dir)
    job_end = F.lit(end.first()["e"])
    return RP.report_lines(p, s, stats, job_end=job_end, texts=texts)


@register("report_file")
def q_report_file(spark, sf_dir):
    """K3: the Markdown report written as one file and read back, numbered lines."""
    path = scratch_path(spark, f"report-{_uuid.uuid4().hex}")
    RP.write_report(q_report_lines(spark, sf_dir), path)
    t = spark.read.text(path, wholetext=True).agg(F.concat_ws("", F.collect_list("value")).alias("t"))  # one bounded file
    return t.select(F.posexplode(F.split(F.regexp_replace("t", "\n$", ""), "\n")).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no").cast("long"))


@register("report_stocks")
def q_report_stocks(spark, sf_dir):
    """Most-discussed-stocks table lines."""
    p, s = _posts_summ(spark, sf_dir)
    return RP.stock_table(A.top_stocks(p, s, 20))


@register("report_sentiment")
def q_report_sentiment(spark, sf_dir):
    """Sentiment distribution lines."""
    _, s = _posts_summ(spark, sf_dir)
    return RP.sentiment_section(A.overall_counts(s))


@register("report_tabs")
def q_report_tabs(spark, sf_dir):
    """Per-tab statistics table lines."""
    p, s, stats, *_ = _report_inputs(spark, sf_dir)
    return RP.tabs_section(stats)


# ---------------------------------------------------- store and streams


@register("roundtrip_store")
def q_roundtrip_store(spark, sf_dir):
    """K1 + K5 + K6 + S3: save all posts, save them again (a replay), read
    back per tab; the second save must add nothing."""
    layout = ST.JobLayout(scratch_path(spark, f"store-{_uuid.uuid4().hex}"), "run_roundtrip")
    p = _posts_md5(spark, sf_dir)
    ST.save_posts(p, layout, save_id="first")
    ST.save_posts(p, layout, save_id="second")
    ST.save_posts(p, layout, save_id="second")  # retried: no further audit rows
    audit = spark.read.parquet(layout.audit)
    per = audit.groupBy("tab").agg(
        F.sum(F.when(F.col("save_id") == "first", F.col("new_rows")).otherwise(0)).cast("long").alias("new_first"),
        F.sum(F.when(F.col("save_id") == "second", F.col("new_rows")).otherwise(0)).cast("long").alias("new_second"),
        F.count(F.lit(1)).alias("saves"), F.max("total_rows").alias("total_rows"))
    rows = ST.load_posts(spark, layout).groupBy("tab").agg(F.count(F.lit(1)).alias("rows"))
    return rows.join(per, "tab", "left").na.fill(0, ["new_first", "new_second"])


@register("roundtrip_summaries")
def q_roundtrip_summaries(spark, sf_dir):
    """K2 + S4: summaries saved twice; stored rows per tab."""
    layout = ST.JobLayout(scratch_path(spark, f"store-{_uuid.uuid4().hex}"), "run_roundtrip")
    s = D.labelled_summaries(spark, sf_dir, key_fn="md5")
    ST.save_summaries(s, layout, save_id="first")
    ST.save_summaries(s, layout, save_id="second")
    once = ST.read_stored(spark, layout.summary).groupBy("tab").agg(F.count(F.lit(1)).alias("rows"))
    other = ST.JobLayout(layout.base, "run_overwritten")
    ST.save_summaries(s.filter(F.col("ingest_seq") % 2 == 0), other)
    ST.save_summaries(s, other, incremental=False)
    again = ST.read_stored(spark, other.summary).groupBy("tab").agg(F.count(F.lit(1)).alias("rows_overwritten"))
    return once.join(again, "tab", "full")


@register("roundtrip_json")
def q_roundtrip_json(spark, sf_dir):
    """S3/S4 JSON form: posts exported as JSON Lines per tab and read back
    with the explicit schema."""
    path = scratch_path(spark, f"jsonl-{_uuid.uuid4().hex}")
    p = _posts_md5(spark, sf_dir)
    ST.write_jsonl(p.select("id", "text", "tab", "symbols", "urls", "content_hash", "ingest_seq"), path)
    back = ST.read_jsonl(spark, path)
    return back.groupBy("tab").agg(F.count(F.lit(1)).alias("rows"),
                                   F.count_distinct("content_hash").alias("hashes"))


def _state_partitions(spark) -> int:
    """State-store partitions for the stream queries: the task slots."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001
        return 8


def _split_documents(spark, sf_dir, rows_per_file=2000):
    """The documents table written as files of a few thousand rows (a file stream source)."""
    path = scratch_path(spark, f"docs-stream-{_uuid.uuid4().hex}")
    D.documents_raw(spark, sf_dir).write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return path


@register("stream_dedup")
def q_stream_dedup(spark, sf_dir):
    """T1 + T3 + T4 + T5: documents as a file stream (two files per trigger, more of a large table),
    de-duplicated by id, saved by foreachBatch; the stream is then replayed
    from a fresh checkpoint into the same store and must add nothing."""
    src = _split_documents(spark, sf_dir)
    schema = spark.read.parquet(src).schema
    layout = ST.JobLayout(scratch_path(spark, f"store-{_uuid.uuid4().hex}"), "run_stream")
    for attempt in range(2):
        s = SS.standardize_stream(SS.post_stream(spark, src, schema, max_files_per_trigger=SS.files_per_trigger(spark, src, 2)), key_fn="md5")
        q = SS.start_post_sink(s, layout, scratch_path(spark, f"ckpt-{_uuid.uuid4().hex}"), available_now=True,
                               state_partitions=_state_partitions(spark), key_fn="md5")
        SS.run_once(q)
    return ST.load_posts(spark, layout).groupBy("id").agg(F.count(F.lit(1)).alias("rows"))


@register("stream_first_wins")
def q_stream_first_wins(spark, sf_dir):
    """T4 in capture order: files of documents in shuffled order, two per trigger; late copies at earlier
    positions correct what was passed on before, so the result is the batch ``first_wins``."""
    src = scratch_path(spark, f"docs-stream-{_uuid.uuid4().hex}")
    d = D.documents_raw(spark, sf_dir)
    d.repartition(8, F.xxhash64("ingest_seq")).write.parquet(src)
    path = scratch_path(spark, f"first-seen-{_uuid.uuid4().hex}")
    s = SO.first_seen(SS.post_stream(spark, src, spark.read.parquet(src).schema, max_files_per_trigger=2), key_fn="md5")
    SS.run_once(SO.start_first_seen_sink(s, path, scratch_path(spark, f"ckpt-{_uuid.uuid4().hex}"), available_now=True,
                                         state_partitions=_state_partitions(spark)))
    return SO.current_posts(SO.first_seen_log(spark, path)).select("id", "tab", "ingest_seq")


@register("stream_isolated_tabs")
def q_stream_isolated_tabs(spark, sf_dir):
    """One tab fails in the stream and in the first re-drive, the others are stored; a second re-drive stores it once."""
    src = _split_documents(spark, sf_dir)
    layout = ST.JobLayout(scratch_path(spark, f"store-{_uuid.uuid4().hex}"), "run_isolated")

    def refuse(rows, tab):
        if tab == "src3":
            raise ValueError("rows of src3 refused")
    s = SS.standardize_stream(SS.post_stream(spark, src, spark.read.parquet(src).schema,
                                             max_files_per_trigger=SS.files_per_trigger(spark, src, 4)), key_fn="md5")
    SS.run_once(SO.start_isolated_sink(s, layout, scratch_path(spark, f"ckpt-{_uuid.uuid4().hex}"), refuse, available_now=True,
                                       state_partitions=_state_partitions(spark), key_fn="md5"))
    for check in (refuse, None, None):
        SO.redrive(spark, layout, check, key_fn="md5")
    return ST.load_posts(spark, layout).groupBy("id").agg(F.count(F.lit(1)).alias("rows"))


@register("stream_summaries")
def q_stream_summaries(spark, sf_dir):
    """The post stream enriched per micro-batch; summaries saved once per post."""
    src = _split_documents(spark, sf_dir)
    schema = spark.read.parquet(src).schema
    layout = ST.JobLayout(scratch_path(spark, f"store-{_uuid.uuid4().hex}"), "run_stream")
    s = SS.standardize_stream(SS.post_stream(spark, src, schema, max_files_per_trigger=SS.files_per_trigger(spark, src, 2)), key_fn="md5")
    s = s.withColumn("tab_rank", F.lit(0)).withColumn("ingest_seq", F.col("ingest_seq"))
    q = SS.start_summary_sink(s, layout, scratch_path(spark, f"ckpt-{_uuid.uuid4().hex}"), available_now=True,
                              state_partitions=_state_partitions(spark))
    SS.run_once(q)
    return ST.read_stored(spark, layout.summary).groupBy("post_id").agg(F.count(F.lit(1)).alias("rows"))


@register("stream_two_sources")
def q_stream_two_sources(spark, sf_dir):
    """T5 + U1: two streams (documents of English and of other languages), each
    with a checkpoint of its own, into one layout; the callback sees each micro-batch.
    The ids stored, which must be those of both streams, and the rows the callbacks saw."""
    layout = ST.JobLayout(scratch_path(spark, f"store-{_uuid.uuid4().hex}"), "run_two")
    seen = scratch_path(spark, f"seen-{_uuid.uuid4().hex}")
    for i, keep in enumerate((F.col("lang") == "en", ~F.col("lang").eqNullSafe("en"))):
        src = scratch_path(spark, f"docs-stream-{_uuid.uuid4().hex}")
        D.documents_raw(spark, sf_dir, extra=("lang",)).filter(keep).drop("lang").write.parquet(src)
        s = SS.standardize_stream(SS.post_stream(spark, src, spark.read.parquet(src).schema), key_fn="md5")
        q = SS.start_post_sink(s, layout, scratch_path(spark, f"ckpt-{_uuid.uuid4().hex}"), available_now=True, key_fn="md5",
                               callback=lambda b, _: b.groupBy("tab").agg(F.count(F.lit(1)).alias("n")).write.mode("append").parquet(seen),
                               state_partitions=_state_partitions(spark))
        SS.run_once(q)
    ids = ST.load_posts(spark, layout).agg(F.count_distinct("id").alias("stored_ids"))
    u = ids.unionByName(spark.read.parquet(seen).agg(F.sum("n").alias("seen")), allowMissingColumns=True)
    return u.agg(F.max("stored_ids").alias("stored_ids"), F.max("seen").alias("seen"))


@register("tab_dimension")
def q_tab_dimension(spark, sf_dir):
    """The configured tabs and the sources that the documents add, in order."""
    return TB.source_tabs(spark, sf_dir).select("tab", "tab_rank", "description")


@register("timestamps_shown")
def q_timestamps_shown(spark, sf_dir):
    """P11 + K6: event times as reports show them, and the job name of each time's second."""
    from ..functions import format_timestamp
    e = read_table(spark, sf_dir, "events")
    return e.select("event_id", format_timestamp(F.col("ts").cast("timestamp")).alias("shown"),
                    F.date_format(F.col("ts").cast("timestamp"), "'run_'yyyyMMdd_HHmmss").alias("job"))


@register("discussions_json")
def q_discussions_json(spark, sf_dir):
    """The nested record of each of the top 10 discussions, as JSON."""
    p, s = _posts_summ(spark, sf_dir, engage=True)
    t = A.top_discussions(A.ensure_post_columns(p), s, 10)
    return t.select(F.col("rank").cast("long").alias("rank"), F.to_json(A.discussion_struct()).alias("record"))


@register("envelope_import")
def q_envelope_import(spark, sf_dir):
    """S1 + S3 + P16 + A1: documents written as JSON envelopes of at most 500
    records, some with planted faults, imported, saved, and their symbols counted: valid
    records by tab, rejected ones by reason, mentions by symbol."""
    path = scratch_path(spark, f"envelopes-{_uuid.uuid4().hex}")
    D.write_envelopes(spark, sf_dir, path)
    valid, rejected = ST.read_envelopes(spark, f"{path}/*/*", "posts")
    layout = ST.JobLayout(scratch_path(spark, f"store-{_uuid.uuid4().hex}"), "run_import")
    ST.save_posts(valid, layout)
    stored = ST.load_posts(spark, layout)
    none = spark.createDataFrame([], "post_id string, sentiment string, companies array<string>, tab_rank int, ingest_seq bigint")
    m = A.stock_mentions(stored, none)
    return (valid.groupBy("tab").agg(F.count(F.lit(1)).alias("n")).select(F.lit("valid").alias("kind"), F.col("tab").alias("key"), "n")
            .unionByName(stored.groupBy("tab").agg(F.count_distinct("content_hash").alias("n")).select(
                F.lit("stored").alias("kind"), F.col("tab").alias("key"), "n"))
            .unionByName(rejected.select(F.explode("reasons").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(
                F.lit("rejected").alias("kind"), "key", "n"))
            .unionByName(m.select(F.lit("symbol").alias("kind"), F.col("symbol").alias("key"), F.col("mention_count").alias("n"))))


@register("report_json")
def q_report_json(spark, sf_dir):
    """K4: the nested report written as JSON, read back: totals and the
    number of symbol and theme records."""
    p, s, stats, end, texts = _report_inputs(spark, sf_dir)
    e = end.first()["e"]
    path = scratch_path(spark, f"report-json-{_uuid.uuid4().hex}")
    RP.write_report_json(p, s, stats, path, F.lit("run_report"), F.lit(e), texts=texts)
    doc = spark.read.json(f"{path}/summary").select(
        "total_posts_collected", "total_unique_posts", "total_posts_summarized",
        F.size("top_discussions").cast("long").alias("discussions"),
        F.size(F.json_object_keys(F.to_json("tab_statistics"))).cast("long").alias("tabs"))
    n_sym = spark.read.json(f"{path}/stock_mentions").select(F.lit(1).alias("_sym"))
    n_th = spark.read.json(f"{path}/themes").select(F.lit(1).alias("_th"), F.size("related_stocks").alias("_rel"))
    u = doc.unionByName(n_sym, allowMissingColumns=True).unionByName(n_th, allowMissingColumns=True)
    return u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in doc.columns],
                 F.count("_sym").alias("stock_records"), F.count("_th").alias("theme_records"),
                 F.sum(F.greatest("_rel", F.lit(0))).cast("long").alias("related_stocks"))


@register("conversation_posts")
def q_conversation_posts(spark, sf_dir):
    """S3/U-1 with a second feed: conversation turns standardized like posts
    (cross-role first-wins de-dup), counted per role."""
    p = D.standardize_posts(D.conversations_raw(spark, sf_dir), key_fn="md5")
    return p.groupBy("tab").agg(F.count(F.lit(1)).alias("posts"),
                                F.sum(F.length("text")).cast("long").alias("chars"),
                                F.sum(F.size("urls")).cast("long").alias("urls"))
