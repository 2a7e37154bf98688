"""Table cases (FIXTURES §3) through the DataFrame operators."""

import random

import pytest
from pyspark.sql import functions as F

from mentionflow.functions import content_hash
from mentionflow.operators import analytics as A
from mentionflow.operators import dedup as DD
from mentionflow.operators import enrich as E
from mentionflow.operators.standardize import standardize_posts

POSTS = "id string, text string, tab string, tab_rank int, ingest_seq long, symbols array<string>, like_count long, comment_count long, retweet_count long, author string, post_url string, content_hash string"
SUMMS = "post_id string, tab string, tab_rank int, ingest_seq long, summary string, tickers array<string>, companies array<string>, themes array<string>, sectors array<string>, sentiment string, original_text_preview string"


def _pair(spark):
    posts = spark.createDataFrame([
        ("1", "茅台涨停了！利好消息", "热门", 0, 1, ["SH600519"], 100, 50, 0, None, None, "h1"),
        ("2", "银行股今天表现不佳", "热门", 0, 2, ["SH601398"], 50, 20, 0, None, None, "h2"),
    ], POSTS)
    summ = spark.createDataFrame([
        ("1", "热门", 0, 1, "s1", ["SH600519"], ["贵州茅台"], ["白酒"], ["消费"], "positive", "茅台涨停了！利好消息"),
        ("2", "热门", 0, 2, "s2", ["SH601398"], ["工商银行"], ["银行"], ["金融"], "negative", "银行股今天表现不佳"),
    ], SUMMS)
    return posts, summ


def test_report_pair(spark):
    posts, summ = _pair(spark)
    m = {r.symbol: r for r in A.stock_mentions(posts, summ).collect()}
    assert set(m) == {"SH600519", "SH601398"}
    assert m["SH600519"].positive_mentions == 1 and m["SH601398"].negative_mentions == 1
    o = A.overall_counts(summ).first()
    assert (o.positive, o.neutral, o.negative) == (1, 0, 1)
    t = {r.theme: r for r in A.themes(summ).collect()}
    assert {k: v.trend for k, v in t.items()} == {"白酒": "up", "消费": "up", "银行": "down", "金融": "down"}
    names = {r.symbol: r.name for r in A.stock_names(posts, summ).collect()}
    assert names == {"SH600519": "贵州茅台", "SH601398": "工商银行"}
    top = A.top_discussions(posts, summ, 10).orderBy("rank").collect()
    assert [r.engagement for r in top] == [200, 90] and top[0].sentiment == "positive"


def test_edge_rules(spark):
    posts, summ = _pair(spark)
    extra_posts = spark.createDataFrame([
        ("3", "no summary", "热门", 0, 3, ["SH600519"], 0, 0, 0, None, None, "h3")], POSTS)
    extra_summ = spark.createDataFrame([
        # a later summary of post 1 replaces the first (last wins), label unknown → neutral
        ("1", "热门", 0, 9, "s1b", [], ["A", "B"], ["白酒"], ["白酒"], "unknown", "q"),
    ], SUMMS)
    p, s = posts.unionByName(extra_posts), summ.unionByName(extra_summ)
    m = {r.symbol: r for r in A.stock_mentions(p, s).collect()}
    r = m["SH600519"]
    assert (r.mention_count, r.positive_mentions, r.neutral_mentions, r.negative_mentions) == (2, 0, 2, 0)
    t = {r.theme: r.mention_count for r in A.themes(s).collect()}
    assert t["白酒"] == 3  # listed in themes and sectors of one summary: counts twice
    # tie between companies: the first seen wins
    names = {r.symbol: r.name for r in A.stock_names(p, s).collect()}
    assert names["SH600519"] == "A"
    empty = A.overall_counts(s.limit(0)).first()
    assert (empty.positive, empty.neutral, empty.negative) == (0, 0, 0)


def test_first_wins_across_tabs(spark):
    raw = spark.createDataFrame([
        ("same text here", "B", 1, 1, None), ("same text here", "A", 0, 5, None),
        ("tiny", "A", 0, 2, None), ("<b></b>     ", "A", 0, 3, None), ("other text!", "B", 1, 4, None)],
        "raw_text string, tab string, tab_rank int, ingest_seq long, author string")
    p = standardize_posts(raw).collect()
    got = sorted((r.text, r.tab) for r in p)
    assert got == [("other text!", "B"), ("same text here", "A")]


def test_tab_cap_and_dedup_new(spark):
    df = spark.range(0, 30).select(F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("tab"),
                                   F.col("id").alias("ingest_seq"),
                                   (F.col("id") % 7).cast("string").alias("content_hash"))
    capped = DD.tab_cap(df, 4, rank_col="rn").collect()
    assert sorted((r.tab, r.ingest_seq) for r in capped if r.tab == "A") == [("A", 0), ("A", 3), ("A", 6), ("A", 9)]
    stored = df.filter(F.col("ingest_seq") < 3).select("content_hash")
    fresh = DD.dedup_new(df, stored, "content_hash", ("ingest_seq",)).collect()
    assert sorted(r.content_hash for r in fresh) == ["3", "4", "5", "6"]
    assert all(r.ingest_seq < 7 for r in fresh)


RESPONSES = [
    ('{"summary": "ok", "sentiment": "positive", "sentiment_score": 0.8, "tickers": ["SH1"]}', "parsed", "positive"),
    ("not json", "fallback", None),
    ("[1,2]", "fallback", None),
    ("{}", "parsed", "neutral"),
    ('{"sentiment": "Positive"}', "parsed", "positive"),
    ('{"sentiment": "bullish"}', "parsed", "neutral"),
    ('{"sentiment": "unknown"}', "parsed", "unknown"),
    ('{"sentiment_score": 7}', "fallback", None),
    ('{"sentiment_score": "0.5"}', "parsed", "neutral"),
    ('{"summary": null}', "fallback", None),
    ('{"key_points": "str"}', "fallback", None),
    ('{"tickers": [1]}', "fallback", None),
    ("", "fallback", None),
    (None, "fallback", None),
]


def test_parse_or_fallback(spark):
    rows = [(str(i), "茅台涨停了！看好白酒板块", "热门", 0, i, ["SH600519"], 0, 0, 0, None, None, None)
            for i in range(len(RESPONSES))]
    posts = spark.createDataFrame(rows, POSTS).withColumn("content_hash", content_hash())
    resp = spark.createDataFrame([(str(i), r[0], 10) for i, r in enumerate(RESPONSES)],
                                 "post_id string, response string, total_tokens long")
    got = {r.post_id: r for r in E.summarize(posts, resp, model_name="m").collect()}
    assert len(got) == len(RESPONSES)
    for i, (_, kind, label) in enumerate(RESPONSES):
        r = got[str(i)]
        if kind == "parsed":
            assert r.model_used == "m", (i, r)
            assert r.sentiment == label
        else:
            assert r.model_used == "fallback", (i, r)
            assert r.sentiment == "positive" and abs(r.sentiment_score - 0.9) < 1e-9
            assert r.sectors == ["Consumer"] and r.tickers == ["SH600519"]
            assert r.summary.endswith(" (Auto-generated)")
    assert got["0"].tickers == ["SH1", "SH600519"]
    assert got["8"].sentiment_score == 0.5
    st = E.enrichment_stats(posts, resp, by_tab=False).first()
    # 13 completed calls, 12 with content; failures: the NULL call + 5 parse
    # errors ([1,2], score 7, null summary, string key_points, int ticker);
    # undecodable JSON falls back without counting as a failure
    assert (st.total_requests, st.successful_requests, st.failed_requests) == (13, 12, 6)


def test_fallback_neutral_score(spark):
    rows = [("1", "今天市场波动不大", "热门", 0, 1, [], 0, 0, 0, None, None, "h")]
    posts = spark.createDataFrame(rows, POSTS)
    r = E.fallback_summaries(posts).first()
    assert r.sentiment == "neutral" and r.sentiment_score == -0.5
    r0 = E.fallback_summaries(posts, neutral_score=0.0).first()
    assert r0.sentiment_score == 0.0


def test_global_rank_matches_row_number(spark):
    from pyspark.sql import Window
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 1000).alias("v"), F.col("id"))
    order = [F.col("v").desc(), F.col("id").asc()]
    a = A.global_rank(df, order).select("id", "rank")
    b = df.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("id", F.col("rank").cast("long"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def capture_loop(rows, cap, stored=()):
    """The tabs one after the other, as the capture loop takes posts."""
    seen, count = {i for i, _ in stored}, {}
    for _, t in stored:
        count[t] = count.get(t, 0) + 1
    out = []
    for _, t in sorted({(r[2], r[1]) for r in rows}):
        for i, tab, rank, seq in sorted((r for r in rows if r[1] == t), key=lambda r: r[3]):
            if count.get(t, 0) < cap and i not in seen:
                seen.add(i)
                count[t] = count.get(t, 0) + 1
                out.append((i, tab, rank, seq))
    return sorted(out)


@pytest.mark.parametrize("seed,cap", [(1, 3), (2, 1), (3, 10), (4, 5)])
def test_capped_capture_is_the_loop(spark, seed, cap):
    rng = random.Random(seed)
    rows = [(f"p{rng.randrange(120)}", f"t{t}", t // 2, s) for s in range(600) for t in [min(rng.randrange(14), rng.randrange(14))]]
    stored = [(f"p{i}", f"t{i % 4}") for i in range(0, 40, 7)] if seed > 2 else []
    kind = "id string, tab string, tab_rank int, ingest_seq long"
    have = spark.createDataFrame(stored, "id string, tab string") if stored else None
    got = DD.capped_capture(spark.createDataFrame(rows, kind), cap, have)
    assert sorted(map(tuple, got.collect())) == capture_loop(rows, cap, stored)


def test_capped_capture_of_many_tabs(spark):
    """10,000 tabs: a few rounds, not one for each tab; a chain of refused copies goes down many of them."""
    rows = [(f"p{t}-{k}", f"t{t:05}", t, 10 * t + k) for t in range(10000) for k in range(3)]
    rows += [(f"p{t - 1}-2", f"t{t:05}", t, 10 * t + 5) for t in range(1, 10000, 2)]
    rows += [("chain", f"t{t:05}", t, 10 * t + 9) for t in range(0, 30, 1)]
    kind = "id string, tab string, tab_rank int, ingest_seq long"
    got = DD.capped_capture(spark.createDataFrame(rows, kind), 2)
    assert sorted(map(tuple, got.collect())) == capture_loop_by_tab(rows, 2)


def capture_loop_by_tab(rows, cap):
    by_tab, seen, out = {}, set(), []
    for r in rows:
        by_tab.setdefault((r[2], r[1]), []).append(r)
    for t in sorted(by_tab):
        took = 0
        for r in sorted(by_tab[t], key=lambda r: r[3]):
            if took < cap and r[0] not in seen:
                seen.add(r[0])
                took += 1
                out.append(r)
    return sorted(out)


def test_large_lexicon(spark):
    """100,000 keywords of 2 to 30 characters: the hits are those of ``in``, from a small multiple of them as candidates."""
    from mentionflow.operators import lexicon_join as L
    rng = random.Random(8)
    syllables = [a + b for a in "bcdfghklmnprstvwz" for b in "aeiouäé日本"]
    texts = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(120)) for _ in range(120)] + ["", "ba", "x" * 20000]
    keywords = {"".join(rng.choice(syllables + [" "]) for _ in range(rng.randrange(1, 15)))[:30] for _ in range(118000)}
    for t in texts[:100]:
        at = rng.randrange(len(t) - 40)
        keywords.add(t[at:at + rng.randrange(2, 31)])
    keywords = sorted(k for k in keywords if 2 <= len(k) <= 30)[:100000] + ["b", "日", "xxx", "q", ""]
    d = spark.createDataFrame(list(enumerate(texts)) + [(None, "ba"), (500, None)], "id long, text string")
    lex = spark.createDataFrame([("l", k) for k in keywords] + [("m", "ba"), ("l", None)], "label string, keyword string")
    want = {(i, "l", k) for k in keywords if k for i, t in enumerate(texts) if k in t} | {(i, "m", "ba") for i, t in enumerate(texts) if "ba" in t}
    got = [tuple(r) for r in L.keyword_hits(d, lex, "id", "text").collect()]
    assert len(keywords) > 99000 and len(got) == len(want) and set(got) == want
    src = L.staged(spark.createDataFrame(list(enumerate(texts)), "_r long, _t string"), "t")
    made = L.candidates(src, lex.select("keyword").where("length(keyword) > 0").distinct()).count()
    assert made < 6 * len(want)
