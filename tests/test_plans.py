"""Plan-shape checks: the scale properties the design relies on."""

import pytest

from conftest import SF_SMALL


def _plan(spark, name):
    from __spark_entry__ import queries
    df = queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["stock_mentions", "stock_names", "stock_samples", "themes", "theme_quotes",
                                  "theme_stocks", "tab_stats", "top_discussions", "keyword_sentiment_join",
                                  "parse_responses", "job_totals", "run_summary", "dup_flag", "dedup_new"])
def test_no_pairs_no_single_partition(spark, name):
    plan = _plan(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, (name, bad)


def test_theme_rank_is_distributed(spark):
    plan = _plan(spark, "themes")
    # no window over all themes; the single-partition step left is the prefix
    # sum over per-partition row counts (one row per partition)
    assert "windowspecdefinition(mention_count" not in plan
    assert "rangepartitioning(mention_count" in plan


@pytest.mark.parametrize("name", ["stock_samples", "theme_quotes", "tab_cap"])
def test_first_n_is_pre_limited_before_the_shuffle(spark, name):
    plan = _plan(spark, name)
    assert "WindowGroupLimit" in plan and "Partial" in plan, name


def test_dedup_is_cut_before_the_shuffle(spark):
    """A hot id ships one row for each task; the store, whose rows are files, finds them on narrow rows."""
    plan = _plan(spark, "first_wins")
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "partial_min(" in _plan(spark, "dedup_new")


def test_flagship_join_reuses_dedup_partitioning(spark):
    plan = _plan(spark, "stock_mentions")
    # exchanges: de-dup and J1 by id, last-wins by post_id, mentions by symbol
    assert plan.count("hashpartitioning(id") == 1
    assert plan.count("hashpartitioning(post_id") == 1


@pytest.mark.parametrize("name,scans", [("first_wins", 1), ("stock_samples", 1), ("stock_mentions", 2), ("stock_names", 2), ("keyword_sentiment", 1)])
def test_texts_are_read_and_cleaned_once(spark, name, scans):
    """Once for the posts, and once for the summaries where a query reads them."""
    plan = _plan(spark, name)
    assert sum("FileScan" in line and "text" in line.split("ReadSchema")[1] for line in plan.splitlines() if "ReadSchema" in line) == scans


@pytest.mark.parametrize("name", ["parse_responses", "enrich_stats", "tab_stats"])
def test_staged_posts_are_not_cleaned_again(spark, name):
    plan = _plan(spark, name)
    assert sum("documents.parquet" in line and "text" in line.split("ReadSchema")[1] for line in plan.splitlines() if "ReadSchema" in line) == (name == "tab_stats")  # lengths of the short rows


def test_scan_prunes_columns(spark):
    plan = _plan(spark, "themes")
    assert "ReadSchema: struct<doc_id:bigint,quality:int,toxic:int>" in plan
    assert "n_chars" not in plan


def test_mention_counts_use_hash_aggregation(spark):
    plan = _plan(spark, "stock_mentions")
    sym_aggs = [l for l in plan.splitlines() if "Aggregate(key" in l and "symbol" in l]
    assert sym_aggs and all("HashAggregate" in l for l in sym_aggs)


@pytest.mark.parametrize("name", ["stock_mentions", "dedup_new"])
def test_no_aggregate_carries_text(spark, name):
    """Rows are de-duplicated on narrow keys: no aggregation buffer holds a text."""
    plan = _plan(spark, name)
    aggs = [line for line in plan.splitlines() if "Aggregate(" in line]
    assert aggs and not any("text" in line for line in aggs), aggs


def test_lexicon_join_runs_in_the_jvm(spark):
    plan = _plan(spark, "keyword_sentiment_join")
    for bad in ("Python", "Pandas", "Arrow", "NestedLoop"):
        assert bad not in plan
