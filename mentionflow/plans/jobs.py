"""The three batch jobs of a run, end to end.

1. ``capture_job``  raw rows or captured pages → standardized posts → store
2. ``enrich_job``   stored posts ⟕ model replies → parse-or-fallback → store
3. ``report_job``   stored posts + summaries → Markdown report + report JSON

Each job reads what the previous one committed, so a lost executor or a
failed job is re-run from stored data, and re-running a job adds nothing
(idempotent saves).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicons import DEFAULT_MODEL_NAME, REPORT_FILENAME
from ..operators import analytics as A
from ..operators.enrich import respond_with, summarize
from ..operators.standardize import standardize_posts
from ..sources import store as ST
from ..sources import tabs as TB
from . import report as RP


def capture_job(raw: DataFrame, layout: ST.JobLayout, max_per_tab: int | None = None,
                tabs: list[str] | None = None, key_fn: str = "xxh64") -> int:
    """``raw`` has ``raw_text, tab, tab_rank, ingest_seq`` (+ optional author,
    created_at, engagement columns). ``max_per_tab`` (no cap by default) counts
    the posts stored before. Returns the number of posts added."""
    if tabs:
        raw = TB.filter_tabs(raw, tabs)
    stored = ST.load_posts(raw.sparkSession, layout) if max_per_tab else None
    posts = standardize_posts(raw, key_fn=key_fn, max_per_tab=max_per_tab,
                              taken=None if stored is None else stored.select("id", "tab"))
    return ST.save_posts(posts, layout, key_fn=key_fn)


def enrich_job(spark: SparkSession, layout: ST.JobLayout, responses: DataFrame | None = None,
               model_name: str = DEFAULT_MODEL_NAME, responder=None, partitions: int | None = None,
               **kwargs) -> int:
    """Summarize stored posts that have no stored summary yet.

    With a ``responder`` (U2), replies are first committed to
    ``<job>/responses`` (one per post; posts already answered are skipped),
    then parsed from there: a lost executor or a re-run never calls the
    model twice for a committed reply, and a re-run parses the same text."""
    posts = ST.load_posts(spark, layout)
    if posts is None:
        return 0
    done = ST.read_stored(spark, layout.summary)
    if done is not None:
        posts = posts.join(done.select(F.col("post_id").alias("id"), "tab").distinct(), ["id", "tab"], "left_anti")
    if responder is not None:
        answered = ST.read_stored(spark, layout.responses)
        todo = posts if answered is None else posts.join(
            answered.select(F.col("post_id").alias("id")).distinct(), "id", "left_anti")
        respond_with(todo, responder, partitions).write.mode("append").parquet(layout.responses)
        responses = spark.read.parquet(layout.responses)
    return ST.save_summaries(summarize(posts, responses, model_name=model_name, **kwargs), layout)


def report_job(spark: SparkSession, layout: ST.JobLayout, tab_dim: DataFrame | None = None,
               raw: DataFrame | None = None) -> str:
    """Markdown report (K3) and report JSON (K4) from the stored tables."""
    posts = ST.load_posts(spark, layout)
    summaries = ST.read_stored(spark, layout.summary)
    if summaries is None:
        summaries = spark.createDataFrame([], "post_id string, tab string, tab_rank int, ingest_seq long, "
                                              "summary string, tickers array<string>, companies array<string>, "
                                              "themes array<string>, sectors array<string>, sentiment string, "
                                              "original_text_preview string")
    dim = tab_dim if tab_dim is not None else TB.tab_dimension(spark)
    raw_tabs = raw.select("tab") if raw is not None else posts.select("tab")
    extra = posts.select("tab").distinct().join(dim.select("tab"), "tab", "left_anti")
    dim = dim.unionByName(extra, allowMissingColumns=True)  # stored tabs that are not configured
    stats = A.tab_statistics(raw_tabs, posts, summaries, dim)
    end = F.current_timestamp()
    lines = RP.report_lines(posts, summaries, stats, job_end=end, job_name=F.lit(layout.job_name))
    RP.write_report(lines, f"{layout.reports}/{REPORT_FILENAME}")
    RP.write_report_json(posts, summaries, stats, f"{layout.reports}/report_data", F.lit(layout.job_name), end)
    return layout.reports
