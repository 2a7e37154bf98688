"""Text × lexicon on sub-string containment, as an equi-join on rare grams.

A nested-loop join of every text with every keyword grows with both sides.
Texts and keywords are cut at spaces. A keyword's piece lies in one piece of a text that holds it, and the distinct pieces
of all texts, the vocabulary, are far fewer than their characters; so only these are cut into grams. Each keyword is filed
under its rarest gram (of ``GRAM`` characters, shorter pieces under themselves), by the number of texts' pieces that hold it; a vocabulary
entry can only hold the keywords filed under its own grams, and those candidates are tested with ``contains``. Keywords with a gram that
no text holds are out at once. The texts meet their keywords by an equi-join of their pieces; a keyword with a space is tested on the
whole text. Texts without spaces are pieces themselves. The rows joined are as many as the texts have pieces, plus a small multiple
of the hits, however large the lexicon is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sentiment import label_from_counts
from ..session import staged

#: Characters of a gram.
GRAM = 4
#: What parts the pieces of a text.
SPACE = " "
#: Keywords, or grams of keywords, that are sent to every task at most (some 60 bytes each); beyond, they are joined by a shuffle.
BROADCAST_KEYWORDS = 200_000


def lexicon_frame(spark: SparkSession, lexicon: dict) -> DataFrame:
    rows = [(label, kw) for label, kws in lexicon.items() for kw in dict.fromkeys(kws)]
    return spark.createDataFrame(rows, "label string, keyword string")


def keyword_hits(df: DataFrame, lexicon: DataFrame, key: str, text: str, lower: bool = False) -> DataFrame:
    """(key, label, keyword), once for each keyword that is part of the text. Empty
    and NULL keywords are part of none; rows with a NULL key or text have none."""
    lex = lexicon.select("label", "keyword").filter(F.length("keyword") > 0).distinct()
    src = df.select(key, (F.lower(text) if lower else F.col(text)).alias("_t")).filter(F.col("_t").isNotNull() & F.col(key).isNotNull())
    # written once: the texts are read for their pieces, and again for the candidates of several pieces
    src = staged(src.withColumn("_r", F.monotonically_increasing_id()), "lexicon-texts")
    kws = staged(lex.select("keyword").distinct().withColumn("_k", F.monotonically_increasing_id()), "lexicon-keywords")
    texts, of = _found(src, kws, key)
    sure = _met(texts, of.filter(~F.col("spaced"))).select(key, "_k")
    open_ = _met(texts, of.filter("spaced")).select("_r", "_k").distinct().join(src, "_r").join(_few(kws), "_k")
    hits = sure.unionByName(open_.filter(F.col("_t").contains(F.col("keyword"))).select(key, "_k")).distinct()
    named = lex.join(kws, "keyword").select("_k", "label", "keyword")
    return hits.join(_few(named), "_k").select(key, "label", "keyword")


def _grams(c: str, n: int) -> F.Column:
    """The ``n`` characters from each position on, once each."""
    return F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1)))


def _pieces(c: str) -> F.Column:
    """What stands between spaces, once each; a space too if there is one."""
    between = F.filter(F.array_distinct(F.split(F.col(c), SPACE)), lambda x: x != "")
    return F.when(F.instr(c, SPACE) > 0, F.concat(between, F.array(F.lit(SPACE)))).otherwise(between)


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_KEYWORDS + 1).count() <= BROADCAST_KEYWORDS else df


def _found(src: DataFrame, keywords: DataFrame, *carried: str) -> tuple[DataFrame, DataFrame]:
    """((_r, ``carried`` ..., token), (token, spaced, ks)): the pieces of the texts, and of each piece the numbers of the keywords whose
    rarest gram it holds, and the keyword's whole piece around it; ``spaced``: those with a space. ``src``: (_r, _t, ``carried``), ``keywords``: (_k, keyword)
    distinct and not empty, both written."""
    own = F.when(F.length("piece") == 1, _grams("piece", 1))
    for n in range(2, GRAM + 1):
        own = own.when((F.length("piece") == n) if n < GRAM else F.lit(True), _grams("piece", n))
    # a keyword of spaces has no piece but the space, another needs none
    pieces = F.when(F.trim("keyword") == "", F.array(F.lit(SPACE))).otherwise(F.array_except(_pieces("keyword"), F.array(F.lit(SPACE))))
    filed = keywords.select("_k", (F.instr("keyword", SPACE) > 0).alias("spaced"), F.explode(pieces).alias("piece"))
    filed = staged(filed.select("_k", "spaced", "piece", F.explode(own).alias("gram")), "lexicon-grams")
    sizes = sorted(r[0] for r in filed.select(F.length("gram")).distinct().collect())  # of 1 to GRAM
    texts = src.select("_r", *carried, F.explode(_pieces("_t")).alias("token"))
    tokens = staged(texts.groupBy("token").agg(F.count("*").alias("n")), "lexicon-tokens")
    every = F.array_distinct(F.concat(*[_grams("token", n) for n in sizes])) if sizes else F.array().cast("array<string>")
    holders = tokens.select("token", "n", F.explode(every).alias("gram"))
    holders = staged(holders.join(_few(filed.select("gram").distinct()), "gram", "left_semi"), "lexicon-holders")
    count = holders.groupBy("gram").agg(F.sum("n").alias("n"))
    known = filed.join(count, "gram", "left").groupBy("_k", "spaced").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "piece")).alias("least"))
    index = known.where("least.n > 0").select("_k", "spaced", F.col("least.gram").alias("gram"), F.col("least.piece").alias("piece"))
    index = staged(index, "lexicon-index")
    of = holders.select("token", "gram").join(_few(index), "gram").filter(F.col("token").contains(F.col("piece")))
    return texts, staged(of.groupBy("token", "spaced").agg(F.collect_set("_k").alias("ks")), "lexicon-of")


def _met(texts: DataFrame, of: DataFrame) -> DataFrame:
    """The texts' pieces with the keywords of each, one at a time (_k)."""
    return texts.join(_few(of.select("token", "ks")), "token").select(*[c for c in texts.columns if c != "token"], F.explode("ks").alias("_k"))


def candidates(src: DataFrame, keywords: DataFrame) -> DataFrame:
    """(_r, keyword): the texts that may hold a keyword, those that do among them; those of keywords without a space do.
    ``src``: (_r, _t) written; ``keywords``: distinct and not empty."""
    kws = staged(keywords.withColumn("_k", F.monotonically_increasing_id()), "lexicon-keywords")
    return _met(*_found(src, kws)).distinct().join(_few(kws), "_k").select("_r", "keyword")


def sentiment_by_join(df: DataFrame, lexicon: DataFrame, key: str = "id",
                      text: str = "text") -> DataFrame:
    """Keyword sentiment of each row via hits ⋈ lexicon; same result as
    ``functions.keyword_sentiment`` with the lexicon as literals."""
    counts = keyword_hits(df, lexicon, key, text, lower=True).groupBy(key).agg(
        F.count_if(F.col("label") == "positive").alias("pos_hits"),
        F.count_if(F.col("label") == "negative").alias("neg_hits"),
        F.count_if(F.col("label") == "neutral").alias("neu_hits"))
    out = df.select(key).join(counts, on=key, how="left").na.fill(0, ["pos_hits", "neg_hits", "neu_hits"])
    s = label_from_counts("pos_hits", "neg_hits", "neu_hits")
    return out.select(key, s["label"].alias("label"), s["score"].alias("score"),
                      F.col("pos_hits").cast("long").alias("pos_hits"),
                      F.col("neg_hits").cast("long").alias("neg_hits"),
                      F.col("neu_hits").cast("long").alias("neu_hits"))
