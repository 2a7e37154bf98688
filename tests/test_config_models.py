"""Configuration and record-model checks (the original's TestConfig /
TestModels, in DataFrame form)."""

from pyspark.sql import functions as F

from mentionflow.functions import content_hash, summary_problems
from mentionflow.functions.validate import SENTIMENTS
from mentionflow.sources import store as ST
from mentionflow.sources import tabs as TB


def test_tabs_in_order(spark):
    dim = TB.tab_dimension(spark).orderBy("tab_rank").collect()
    assert [r.tab for r in dim] == ["热门", "7x24", "视频", "基金", "资讯", "达人", "私募", "ETF"]
    assert all(r.description for r in dim)


def test_job_layout():
    name = ST.job_name_at()
    assert name.startswith("run_") and len(name) == len("run_20251207_150619")
    lay = ST.JobLayout("/base", name)
    assert lay.raw.endswith("/raw") and lay.summary.endswith("/summary") and lay.reports.endswith("/reports")
    assert lay.raw.startswith(f"/base/{name}/")


def test_content_hash_with_author(spark):
    df = spark.createDataFrame([("1", "Same content", "热门", "user1"), ("2", "Same content", "热门", "user1"),
                                ("3", "Different", "热门", "user1"), ("4", "Same content", "热门", "user2")],
                               "id string, text string, tab string, author string")
    h = {r.id: r.h for r in df.select("id", content_hash().alias("h")).collect()}
    assert h["1"] == h["2"] and h["1"] != h["3"] and h["1"] != h["4"]


def test_summary_record_checks(spark):
    assert SENTIMENTS == ["positive", "neutral", "negative", "unknown"]
    rows = [("123", "abc123", "热门", "This is a summary", "positive", 0.8, 0, "p"),
            ("124", "abc124", "热门", "s", "bullish", 0.1, 0, "p"),
            ("125", "abc125", "热门", "s", "neutral", 1.5, 0, "p"),
            ("126", "abc126", "热门", "s", "neutral", 0.0, -1, "x" * 201)]
    df = spark.createDataFrame(rows, "post_id string, post_hash string, tab string, summary string, "
                                     "sentiment string, sentiment_score double, processing_time_ms long, "
                                     "original_text_preview string")
    got = {r.post_id: r.p for r in df.select("post_id", summary_problems().alias("p")).collect()}
    assert got["123"] == []
    assert got["124"] == ["bad_sentiment"]
    assert got["125"] == ["score_out_of_range"]
    assert got["126"] == ["negative_processing_time", "preview_too_long"]


def test_recommended_conf_scales_with_input():
    from mentionflow.session import recommended_conf
    small = recommended_conf(10 << 30, executor_memory_gb=16, cores_per_executor=4, executors=10)
    big = recommended_conf(100 << 40, executor_memory_gb=16, cores_per_executor=4, executors=1000)
    assert int(small["spark.sql.shuffle.partitions"]) >= 80  # at least 2 waves of slots
    # ~100 TB at <= 512 MB per partition: hundreds of thousands of partitions
    assert int(big["spark.sql.shuffle.partitions"]) >= (100 << 40) // (512 << 20)
    assert int(big["spark.sql.adaptive.advisoryPartitionSizeInBytes"]) <= 512 << 20
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
