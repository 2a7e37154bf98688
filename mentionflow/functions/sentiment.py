"""Keyword sentiment, sector tagging and the small sentiment rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import col
from .lexicons import SECTOR_KEYWORDS, SENTIMENT_KEYWORDS


def _hits(text: Column, keywords) -> Column:
    """Number of distinct keywords that occur as sub-strings of ``text``
    (a sum of ``contains`` tests: plain codegen, no lambda)."""
    kws = list(dict.fromkeys(keywords))
    if not kws:
        return F.lit(0)
    out = None
    for k in kws:
        e = F.when(F.contains(text, F.lit(k)), F.lit(1)).otherwise(F.lit(0))
        out = e if out is None else out + e
    return out


def sql_str(v: str) -> str:
    """A Spark SQL string literal (backslash and quote escaped)."""
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _hits_sql(col_name: str, keywords) -> Column:
    """``_hits`` as one SQL expression: the same plan, built in one call
    instead of several per keyword."""
    kws = list(dict.fromkeys(keywords))
    if not kws:
        return F.lit(0)
    c = _ident(col_name)
    return F.expr(" + ".join(f"(CASE WHEN contains({c}, {sql_str(k)}) THEN 1 ELSE 0 END)" for k in kws))


def _caseless(ch: str) -> bool:
    """True for characters that lower-casing neither changes nor produces:
    CJK ideographs/punctuation and ASCII non-letters."""
    o = ord(ch)
    if o < 128:
        return not ch.isalpha()
    return (0x3000 <= o <= 0x303F or 0x3400 <= o <= 0x4DBF or 0x4E00 <= o <= 0x9FFF
            or 0xF900 <= o <= 0xFAFF)


def needs_lower(lexicon: dict) -> bool:
    """``k in text.lower()`` equals ``k in text`` when every keyword character
    is caseless in the sense above, so the (costly) lower-casing can be
    skipped for such lexicons (the default one is all CJK)."""
    return not all(_caseless(c) for kws in lexicon.values() for k in kws for c in k)


def label_from_counts(p, n, u) -> Column:
    """(label, confidence) from positive/negative/neutral hit counts."""
    p, n, u = col(p), col(n), col(u)
    total = p + n + u
    pos_conf = F.least(F.lit(0.9), F.lit(0.5) + (p - n) / (total * F.lit(2.0)))
    neg_conf = F.least(F.lit(0.9), F.lit(0.5) + (n - p) / (total * F.lit(2.0)))
    label = (F.when(total == 0, F.lit("neutral"))
             .when(p > n * F.lit(1.5), F.lit("positive"))
             .when(n > p * F.lit(1.5), F.lit("negative"))
             .otherwise(F.lit("neutral")))
    conf = (F.when(total == 0, F.lit(0.5))
            .when(p > n * F.lit(1.5), pos_conf)
            .when(n > p * F.lit(1.5), neg_conf)
            .otherwise(F.lit(0.5)))
    return F.struct(label.alias("label"), conf.cast("double").alias("score"))


def keyword_sentiment(c, lexicon: dict | None = None) -> Column:
    """Struct ``(label, score, pos_hits, neg_hits, neu_hits)`` of a text.

    The text is lower-cased; each class counts the distinct keywords present
    (overlaps count: a longer keyword and its sub-string both hit).
    """
    lex = SENTIMENT_KEYWORDS if lexicon is None else lexicon
    t = F.coalesce(col(c), F.lit(""))
    t = F.lower(t) if needs_lower(lex) else t
    p = _hits(t, lex.get("positive", []))
    n = _hits(t, lex.get("negative", []))
    u = _hits(t, lex.get("neutral", []))
    s = label_from_counts(p, n, u)
    return F.struct(s["label"].alias("label"), s["score"].alias("score"),
                    p.alias("pos_hits"), n.alias("neg_hits"), u.alias("neu_hits"))


def with_keyword_sentiment(df, text, lexicon: dict | None = None, prefix: str = "ks_",
                           only_if: Column | None = None):
    """DataFrame form of ``keyword_sentiment``: the (lower-cased) text, then
    the hit counts, then label and score, each its own projection. Catalyst
    does not inline an expensive column referenced several times, so every
    keyword scan runs once per row. ``only_if`` limits the scans to the rows
    that need them (others get NULL)."""
    lex = SENTIMENT_KEYWORDS if lexicon is None else lexicon
    t0 = F.coalesce(col(text), F.lit(""))
    lt = f"{prefix}_lt"
    df = df.withColumn(lt, F.lower(t0) if needs_lower(lex) else t0)
    t = F.col(lt)

    def gate(e):
        return e if only_if is None else F.when(only_if, e)
    out = df.withColumns({
        f"{prefix}pos_hits": gate(_hits_sql(lt, lex.get("positive", []))),
        f"{prefix}neg_hits": gate(_hits_sql(lt, lex.get("negative", []))),
        f"{prefix}neu_hits": gate(_hits_sql(lt, lex.get("neutral", []))),
    }).drop(lt)
    s = label_from_counts(f"{prefix}pos_hits", f"{prefix}neg_hits", f"{prefix}neu_hits")
    return out.withColumns({f"{prefix}label": s["label"], f"{prefix}score": s["score"]})


def sectors(c, sector_keywords=None) -> Column:
    """Sectors (in configured order) with at least one keyword in the text;
    case-sensitive sub-string match."""
    sk = SECTOR_KEYWORDS if sector_keywords is None else sector_keywords
    if isinstance(c, str):  # one SQL expression: same plan, one build call
        t = f"coalesce({_ident(c)}, '')"
        items = []
        for name, kws in sk:
            cond = " OR ".join(f"contains({t}, {sql_str(k)})" for k in kws) or "false"
            items.append(f"CASE WHEN {cond} THEN {sql_str(name)} END")
        if not items:
            return F.array().cast("array<string>")
        return F.expr(f"array_except(array({', '.join(items)}), array(CAST(NULL AS STRING)))")
    t = F.coalesce(col(c), F.lit(""))
    tagged = []
    for name, kws in sk:
        cond = None
        for k in kws:
            e = F.contains(t, F.lit(k))
            cond = e if cond is None else (cond | e)
        tagged.append(F.when(cond, F.lit(name)) if cond is not None else F.lit(None).cast("string"))
    if not tagged:
        return F.array().cast("array<string>")
    # drop the NULL slots, keeping order (array_except is codegen'd; the
    # names are distinct so its de-dup changes nothing)
    return F.array_except(F.array(*tagged), F.array(F.lit(None).cast("string")))


def majority_rule(pos, neg, up="positive", down="negative", flat="neutral") -> Column:
    """``pos > 1.5*neg`` → up; ``neg > 1.5*pos`` → down; else flat."""
    pos, neg = col(pos), col(neg)
    return (F.when(pos > neg * F.lit(1.5), F.lit(up))
            .when(neg > pos * F.lit(1.5), F.lit(down))
            .otherwise(F.lit(flat)))


def overall_sentiment(pos, neg) -> Column:
    return majority_rule(pos, neg)


def theme_trend(pos, neg) -> Column:
    return majority_rule(pos, neg, "up", "down", "stable")


def sentiment_ratio(pos, neg) -> Column:
    """pos/(pos+neg); 0.5 when both are 0 (zero guarded for ANSI mode)."""
    pos, neg = col(pos), col(neg)
    tot = pos + neg
    return F.when(tot == 0, F.lit(0.5)).otherwise(pos / tot).cast("double")


def market_mood(pos, neg, neu) -> Column:
    """bullish / bearish / mixed from the class shares; NULL when no rows."""
    pos, neg, neu = col(pos), col(neg), col(neu)
    tot = pos + neg + neu
    return (F.when(tot == 0, F.lit(None).cast("string"))
            .when(pos > neg, F.lit("bullish"))
            .when(neg > pos, F.lit("bearish"))
            .otherwise(F.lit("mixed")))


def share_pct(x, total) -> Column:
    """x/total*100 as double; NULL when total is 0."""
    x, total = col(x), col(total)
    return F.when(total == 0, F.lit(None).cast("double")).otherwise(x / total * F.lit(100.0))


def sentiment_class(s) -> Column:
    """positive / negative stay; anything else (neutral, unknown, NULL) → neutral."""
    s = col(s)
    return F.when(s == "positive", F.lit("positive")).when(s == "negative", F.lit("negative")) \
        .otherwise(F.lit("neutral"))
