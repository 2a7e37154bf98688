"""Algebraic properties and tab selection rules."""

import random
import re
import warnings

from pyspark.sql import functions as F

from conftest import SF_SMALL
from mentionflow.functions import clean_text
from mentionflow.operators import analytics as A
from mentionflow.sources import driver_tables as D
from mentionflow.sources import tabs as TB


def test_class_counts_add_up(spark):
    p = D.posts(spark, SF_SMALL, engage=False)
    s = D.labelled_summaries(spark, SF_SMALL)
    m = A.stock_mentions(p, s)
    bad = m.filter(F.col("positive_mentions") + F.col("neutral_mentions") + F.col("negative_mentions")
                   != F.col("mention_count")).count()
    assert bad == 0
    # every post contributes once per distinct symbol
    total = p.select(F.sum(F.size(F.array_distinct("symbols")))).first()[0]
    assert m.agg(F.sum("mention_count")).first()[0] == total
    t = A.themes(s)
    assert t.filter(F.col("positive") + F.col("neutral") + F.col("negative") != F.col("mention_count")).count() == 0
    o = A.overall_counts(s).first()
    assert o.positive + o.neutral + o.negative == s.count()


def test_select_tabs_rules():
    known = ["热门", "7x24", "ETF"]
    assert TB.select_tabs(known, []) == known
    assert TB.select_tabs(known, ["ALL"]) == known
    assert TB.select_tabs(known, ["ETF", "热门"]) == ["ETF", "热门"]
    with warnings.catch_warnings(record=True):
        warnings.simplefilter("always")
        assert TB.select_tabs(known, ["etf", "bogus"]) == known  # case-sensitive names; nothing left → all
        assert TB.select_tabs(known, ["bogus", "7x24"]) == ["7x24"]


def _clean_spec(t):
    """The cleaning rules written out directly (small brute-force check)."""
    if not t:
        return ""
    t = re.sub(r"<[^>]+>", "", t)
    t = re.sub(r"\s+", " ", t)
    t = "".join(ch for ch in t if not (ord(ch) <= 8 or ord(ch) in (11, 12) or 14 <= ord(ch) <= 31
                                       or 127 <= ord(ch) <= 159))
    return t.strip()


def test_clean_text_matches_spec_on_random_strings(spark):
    rng = random.Random(7)
    alphabet = ["a", "b", "<", ">", "p", "/", " ", "\t", "\n", "\x00", "\x0b", "\x1c", "\x85", "\xa0",
                "　", " ", "é", "涨", "&", ";", "\x7f", "\x9f"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", clean_text("t").alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _clean_spec(t), repr(t)
