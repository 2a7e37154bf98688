"""Enrichment: one summary row per post, from a model response when it
parses, else from the keyword fallback.

* ``fallback_summaries`` — keyword sentiment + sectors + truncations (P23)
* ``parse_responses``    — response JSON → summary fields with the original
  acceptance rules, decided per row by Catalyst variant functions (P24)
* ``summarize``          — posts ⟕ responses → parsed-or-fallback (P25)
* ``prompts``            — request text per post (P28)
* ``respond_with``       — run a user responder over request batches with
  ``mapInPandas``; one failing row yields NULL, never a failed task (U2/U3)
* ``enrichment_stats``   — request / success / failure / token counts (A10)
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sectors as sector_tags, truncate
from ..functions.sentiment import with_keyword_sentiment
from ..functions.lexicons import (DEFAULT_MODEL_NAME, FALLBACK_MODEL, FALLBACK_REASONING,
                                  FALLBACK_SUFFIX, FALLBACK_SUMMARY_LEN, PREVIEW_LEN,
                                  SYSTEM_PROMPT, USER_PROMPT_PREFIX)

SUMMARY_COLS = ["post_id", "post_hash", "tab", "summary", "key_points", "tickers", "companies",
                "themes", "sectors", "sentiment", "sentiment_score", "sentiment_reasoning",
                "model_used", "original_text_preview"]
LABELS = ["positive", "neutral", "negative", "unknown"]
STRING_FIELDS = ["summary", "sentiment"]
ARRAY_FIELDS = ["key_points", "tickers", "companies", "themes", "sectors"]


def _empty():
    return F.array().cast("array<string>")


def _with_fallback(df: DataFrame, text="text", symbols="symbols", lexicon=None,
                   sector_keywords=None, neutral_score=None, only_if=None) -> DataFrame:
    """Adds a ``fb`` struct column with the fallback summary fields
    (computed only where ``only_if`` holds, when given)."""
    df = with_keyword_sentiment(df, text, lexicon, prefix="_ks_", only_if=only_if)
    lab, conf = F.col("_ks_label"), F.col("_ks_score")
    score = F.when(lab == "positive", conf).otherwise(-conf)
    if neutral_score is not None:
        score = F.when(lab == "neutral", F.lit(float(neutral_score))).otherwise(score)
    fb = F.struct(
        F.concat(truncate(text, FALLBACK_SUMMARY_LEN), F.lit(FALLBACK_SUFFIX)).alias("summary"),
        _empty().alias("key_points"),
        F.coalesce(F.col(symbols), _empty()).alias("tickers"),
        _empty().alias("companies"),
        _empty().alias("themes"),
        sector_tags(text, sector_keywords).alias("sectors"),
        lab.alias("sentiment"),
        score.cast("double").alias("sentiment_score"),
        F.lit(FALLBACK_REASONING).alias("sentiment_reasoning"),
        F.lit(FALLBACK_MODEL).alias("model_used"),
    )
    return df.withColumn("fb", fb).drop("_ks_pos_hits", "_ks_neg_hits", "_ks_neu_hits",
                                        "_ks_label", "_ks_score")


def fallback_summaries(posts: DataFrame, lexicon=None, sector_keywords=None,
                       neutral_score=None) -> DataFrame:
    """P23 for every post."""
    df = _with_fallback(posts, "text", "symbols", lexicon, sector_keywords, neutral_score)
    return df.select(
        F.col("id").alias("post_id"), F.col("content_hash").alias("post_hash"), "tab",
        "fb.*", truncate("text", PREVIEW_LEN).alias("original_text_preview"),
        "tab_rank", "ingest_seq",
    ).select(*SUMMARY_COLS, "tab_rank", "ingest_seq")


def _vtype(v, key):
    return F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))


def response_checks(response="response", parsed: str | None = None):
    """Columns describing a raw response: ``called`` (a call completed),
    ``content`` (non-empty), ``decoded`` (valid JSON), ``ok`` (all fields
    acceptable), plus the variant ``v``. Pass ``parsed`` (a column holding
    ``try_parse_json(response)``) so the JSON is parsed once per row."""
    r = F.col(response) if isinstance(response, str) else response
    v = F.col(parsed) if parsed else F.try_parse_json(r)
    is_obj = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    conds = [is_obj]
    for k in STRING_FIELDS:  # missing → default, explicit null / non-string → error
        conds.append(F.coalesce(_vtype(v, k) == "STRING", F.lit(True)))
    # the reasoning may also be null
    conds.append(F.coalesce(_vtype(v, "sentiment_reasoning").isin("STRING", "VOID"), F.lit(True)))
    for k in ARRAY_FIELDS:
        arr_ok = F.coalesce(_vtype(v, k).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(True))
        no_null = ~F.exists(F.coalesce(F.try_variant_get(v, f"$.{k}", "array<string>"), _empty()),
                            lambda x: x.isNull())
        conds.append(arr_ok & no_null)
    st = _vtype(v, "sentiment_score")
    sv = F.try_variant_get(v, "$.sentiment_score", "double")
    score_ok = st.isNull() | (
        ~st.isin("VOID") & ~F.startswith(st, F.lit("ARRAY")) & ~F.startswith(st, F.lit("OBJECT"))
        & F.coalesce(sv.between(-1.0, 1.0) & ~F.isnan(sv), F.lit(False)))
    conds.append(score_ok)
    ok = conds[0]
    for c in conds[1:]:
        ok = ok & c
    content = F.coalesce(F.length(r) > 0, F.lit(False))
    decoded = content & v.isNotNull()
    return {
        "v": v, "called": r.isNotNull(), "content": content, "decoded": decoded,
        "ok": decoded & ok,
        # an exception was raised: the call itself, or parsing a decoded reply
        "failed": r.isNull() | (decoded & ~ok),
    }


def _parsed_struct(v, symbols, model_name):
    def arr(k):
        return F.coalesce(F.try_variant_get(v, f"$.{k}", "array<string>"), _empty())
    lab = F.lower(F.coalesce(F.try_variant_get(v, "$.sentiment", "string"), F.lit("neutral")))
    lab = F.when(lab.isin(*LABELS), lab).otherwise(F.lit("neutral"))
    return F.struct(
        F.coalesce(F.try_variant_get(v, "$.summary", "string"), F.lit("")).alias("summary"),
        arr("key_points").alias("key_points"),
        F.concat(arr("tickers"), F.coalesce(symbols, _empty())).alias("tickers"),
        arr("companies").alias("companies"),
        arr("themes").alias("themes"),
        arr("sectors").alias("sectors"),
        lab.alias("sentiment"),
        F.coalesce(F.try_variant_get(v, "$.sentiment_score", "double"), F.lit(0.0)).alias("sentiment_score"),
        F.try_variant_get(v, "$.sentiment_reasoning", "string").alias("sentiment_reasoning"),
        F.lit(model_name).alias("model_used"),
    )


_LAST_KEY_WINS = "spark.sql.variant.allowDuplicateKeys"


def _with_variant(df: DataFrame, json_col: str, name: str) -> DataFrame:
    """``df`` with the parsed JSON; of repeated keys the last counts. Spark fixes
    that choice when the expression is built, so the session's setting is put back at once."""
    conf = df.sparkSession.conf
    old = conf.get(_LAST_KEY_WINS, None)
    conf.set(_LAST_KEY_WINS, "true")
    try:
        return df.withColumn(name, F.try_parse_json(json_col))
    finally:
        conf.set(_LAST_KEY_WINS, old) if old is not None else conf.unset(_LAST_KEY_WINS)


def summarize(posts: DataFrame, responses: DataFrame | None = None,
              model_name: str = DEFAULT_MODEL_NAME, lexicon=None, sector_keywords=None,
              neutral_score=None, keep_checks: bool = False) -> DataFrame:
    """P25: exactly one summary per post. ``responses`` has
    ``post_id, response[, total_tokens]``; of several replies to one post the
    greatest text counts. A post without a row was not asked: it takes the fallback, and
    is no failure."""
    if responses is None:
        j = posts.withColumn("response", F.lit(None).cast("string")) \
            .withColumn("total_tokens", F.lit(None).cast("long")).withColumn("_asked", F.lit(None).cast("boolean"))
    else:
        r = responses.withColumnRenamed("post_id", "id")
        if "total_tokens" not in r.columns:
            r = r.withColumn("total_tokens", F.lit(None).cast("long"))
        # one reply for each post, whatever the table holds: a text in two
        # tabs has one id, and both posts take its reply
        r = r.groupBy("id").agg(F.max(F.struct("response", "total_tokens")).alias("r"))
        j = posts.join(r.select("id", "r.response", "r.total_tokens", F.lit(True).alias("_asked")), on="id", how="left")
    # parse once; then the check flags; then the chosen struct (each step is
    # its own projection, so nothing expensive is evaluated twice per row)
    j = _with_variant(j, "response", "_v")
    chk = response_checks("response", "_v")
    j = j.withColumns({"_called": chk["called"], "_content": chk["content"],
                       "_ok": chk["ok"], "_failed": F.coalesce("_asked", F.lit(False)) & chk["failed"]})
    j = _with_fallback(j, "text", "symbols", lexicon, sector_keywords, neutral_score,
                       only_if=~F.col("_ok"))
    parsed = _parsed_struct(F.col("_v"), F.col("symbols"), model_name)
    s = F.when(F.col("_ok"), parsed).otherwise(F.col("fb"))
    extra = []
    if keep_checks:
        extra = [F.col("_called").alias("called"), F.col("_content").alias("has_content"),
                 F.col("_failed").alias("failed"), F.col("total_tokens")]
    out = j.select(
        F.col("id").alias("post_id"), F.col("content_hash").alias("post_hash"), "tab",
        s.alias("s"), truncate("text", PREVIEW_LEN).alias("original_text_preview"),
        "tab_rank", "ingest_seq", *extra)
    return out.select("post_id", "post_hash", "tab", "s.*", "original_text_preview",
                      "tab_rank", "ingest_seq",
                      *[c for c in ("called", "has_content", "failed", "total_tokens") if keep_checks])


def enrichment_stats(posts: DataFrame, responses: DataFrame, by_tab: bool = True) -> DataFrame:
    """A10: requests (completed calls), successes (non-empty content),
    failures (call or parse raised), tokens over successes, fallbacks."""
    s = summarize(posts, responses, keep_checks=True)
    aggs = [
        F.count_if(F.col("called")).cast("long").alias("total_requests"),
        F.count_if(F.col("has_content")).cast("long").alias("successful_requests"),
        F.count_if(F.col("failed")).cast("long").alias("failed_requests"),
        F.coalesce(F.sum(F.when(F.col("has_content"), F.col("total_tokens"))), F.lit(0)).cast("long").alias("total_tokens"),
        F.count_if(F.col("model_used") == FALLBACK_MODEL).cast("long").alias("fallback_summaries"),
        F.count(F.lit(1)).alias("summaries"),
    ]
    return s.groupBy("tab").agg(*aggs) if by_tab else s.agg(*aggs)


def prompts(posts: DataFrame, system_prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """The user message of each post and the system text."""
    return posts.select(F.col("id").alias("post_id"),
                        F.concat(F.lit(USER_PROMPT_PREFIX), F.col("text")).alias("user_prompt"),
                        F.lit(system_prompt).alias("system_prompt"))


RESPONSE_SCHEMA = T.StructType([T.StructField("post_id", T.StringType()),
                                T.StructField("response", T.StringType()),
                                T.StructField("total_tokens", T.LongType())])


def respond_with(posts: DataFrame, responder: Callable[[str, str], "str | tuple | None"],
                 partitions: int | None = None, system_prompt: str = SYSTEM_PROMPT,
                 concurrency: int = 1) -> DataFrame:
    """Call ``responder(system_prompt, user_prompt)`` for each post in
    Arrow batches on the executors. It returns the reply text or
    ``(text, total_tokens)``; an exception gives a NULL reply (the post then
    falls back) and never fails the task. ``partitions`` bounds the tasks,
    ``concurrency`` the requests that a task has open at a time."""
    req = prompts(posts, system_prompt).select("post_id", "user_prompt")
    if partitions:
        req = req.repartition(partitions)

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        import pandas as pd

        def ask(up):
            try:
                r = responder(system_prompt, up)
            except Exception:  # noqa: BLE001 - one bad row must not fail the batch
                r = None
            return r if isinstance(r, tuple) else (r, None)
        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in batches:
                out, toks = map(list, zip(*pool.map(ask, pdf["user_prompt"]), strict=True)) if len(pdf) else ([], [])
                yield pd.DataFrame({"post_id": pdf["post_id"], "response": out,
                                    "total_tokens": pd.array(toks, dtype="Int64")})
    return req.mapInPandas(run, RESPONSE_SCHEMA)
