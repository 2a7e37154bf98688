"""Storage idempotency, envelope import, stream = batch, J5 join = literals."""

import json
import os
import tempfile
import uuid

from pyspark.sql import functions as F

from conftest import SF_SMALL
from mentionflow.functions.lexicons import TEST_SENTIMENT_KEYWORDS
from mentionflow.functions.sentiment import with_keyword_sentiment
from mentionflow.functions import clean_text
from mentionflow.operators import lexicon_join as LJ
from mentionflow.session import scratch_path
from mentionflow.sources import driver_tables as D
from mentionflow.sources import store as ST
from mentionflow.streaming import streams as SS


def test_resave_adds_nothing(spark):
    layout = ST.JobLayout(scratch_path(spark, f"t-{uuid.uuid4().hex}"), "run_test")
    p = D.posts(spark, SF_SMALL, key_fn="md5", engage=False)
    n = p.count()
    assert ST.save_posts(p, layout) == n
    assert ST.save_posts(p, layout) == 0
    assert ST.load_posts(spark, layout).count() == n
    s = D.labelled_summaries(spark, SF_SMALL, key_fn="md5")
    ns = s.count()
    assert ST.save_summaries(s, layout) == ns
    assert ST.save_summaries(s, layout) == 0
    # non-incremental save with nothing new writes nothing
    assert ST.save_posts(p, layout, incremental=False) == 0
    audit = spark.read.parquet(layout.audit)
    assert audit.filter(F.col("table") == "posts").agg(F.sum("new_rows")).first()[0] == n


def test_envelope_import(spark):
    d = tempfile.mkdtemp(prefix="env-")
    good = {"id": "1", "text": "茅台涨停了！利好消息", "tab": "热门", "symbols": ["SH600519"], "like_count": 3}
    bad_count = {"id": "2", "text": "x", "tab": "热门", "like_count": -1}
    no_text = {"id": "3", "tab": "热门"}
    with open(os.path.join(d, "posts_热门.json"), "w") as f:
        json.dump({"metadata": {"tab": "热门", "job_name": "run_x", "total_posts": 3, "new_posts_this_save": 3,
                                "last_updated": "2025-12-07T06:00:00"}, "posts": [good, bad_count, no_text]},
                  f, ensure_ascii=False, indent=2)
    with open(os.path.join(d, "posts_ETF.json"), "w") as f:
        f.write("{ not json")
    valid, rejected = ST.read_envelopes(spark, os.path.join(d, "posts_*.json"), "posts")
    v = valid.collect()
    assert [(r.id, r.file_tab) for r in v] == [("1", "热门")]
    reasons = sorted(tuple(r.reasons) for r in rejected.collect())
    assert reasons == [("missing_text",), ("negative_like_count",), ("unreadable_file",)]
    v2, r2 = ST.read_envelopes(spark, os.path.join(d, "missing_*.json"), "posts")
    assert v2.count() == 0 and r2.count() == 0


import pytest  # noqa: E402


@pytest.mark.parametrize("salts", [None, 4])
def test_stream_equals_batch(spark, salts):
    src = scratch_path(spark, f"src-{uuid.uuid4().hex}")
    D.documents_raw(spark, SF_SMALL).repartition(4).write.parquet(src)
    schema = spark.read.parquet(src).schema
    layout = ST.JobLayout(scratch_path(spark, f"s-{uuid.uuid4().hex}"), "run_stream")
    for _ in range(2):  # replay from a fresh checkpoint: idempotent
        s = SS.standardize_stream(SS.post_stream(spark, src, schema, max_files_per_trigger=1), key_fn="md5",
                                  hot_key_salts=salts)
        SS.run_once(SS.start_post_sink(s, layout, scratch_path(spark, f"c-{uuid.uuid4().hex}"), available_now=True))
    streamed = {r.id for r in ST.load_posts(spark, layout).select("id").collect()}
    batch = {r.id for r in D.posts(spark, SF_SMALL, key_fn="md5", engage=False).select("id").collect()}
    assert streamed == batch
    assert ST.load_posts(spark, layout).count() == len(batch)


def test_lexicon_join_equals_literals(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", clean_text("text").alias("text"))
    lit = with_keyword_sentiment(d, "text", TEST_SENTIMENT_KEYWORDS, prefix="").select(
        "doc_id", "label", "score", "pos_hits", "neg_hits", "neu_hits")
    joined = LJ.sentiment_by_join(d, LJ.lexicon_frame(spark, TEST_SENTIMENT_KEYWORDS), key="doc_id")
    a = sorted(tuple(r) for r in lit.collect())
    b = sorted(tuple(r) for r in joined.collect())
    assert a == b


def test_three_jobs_end_to_end(spark):
    from mentionflow.plans import jobs
    from mentionflow.sources import tabs as TB
    layout = ST.JobLayout(scratch_path(spark, f"j-{uuid.uuid4().hex}"), "run_e2e")
    raw = D.documents_raw(spark, SF_SMALL)
    added = jobs.capture_job(raw, layout, max_per_tab=5)
    assert added == ST.load_posts(spark, layout).count() <= 5 * 20
    assert jobs.capture_job(raw, layout, max_per_tab=5) == 0  # re-run: nothing new
    posts = ST.load_posts(spark, layout)
    n = jobs.enrich_job(spark, layout, D.model_responses(posts))
    assert n == added and jobs.enrich_job(spark, layout) == 0
    out = jobs.report_job(spark, layout, TB.source_tabs(spark), raw)
    text = "\n".join(r.value for r in spark.read.text(f"{out}/final_report.md").collect())
    assert text.startswith("# Investor Discussion Report — run_e2e") and "## Detailed Stock Analysis" in text
    assert spark.read.json(f"{out}/report_data/summary").first()["total_posts_collected"] == added


def test_failed_batch_is_replayed_not_lost(spark):
    """A micro-batch that fails is replayed from the checkpoint when the
    query restarts; nothing is lost and nothing is stored twice."""
    src = scratch_path(spark, f"src-{uuid.uuid4().hex}")
    D.documents_raw(spark, SF_SMALL).repartition(4).write.parquet(src)
    schema = spark.read.parquet(src).schema
    layout = ST.JobLayout(scratch_path(spark, f"s-{uuid.uuid4().hex}"), "run_fail")
    ckpt = scratch_path(spark, f"c-{uuid.uuid4().hex}")
    state = {"failed": False}

    def flaky(batch, batch_id):
        if batch_id == 1 and not state["failed"]:
            state["failed"] = True
            raise RuntimeError("simulated sink failure")

    s = SS.standardize_stream(SS.post_stream(spark, src, schema, max_files_per_trigger=1), key_fn="md5")
    q = SS.start_post_sink(s, layout, ckpt, available_now=True, callback=flaky)
    with pytest.raises(Exception, match="simulated sink failure|FOREACH_BATCH"):
        SS.run_once(q)
    s = SS.standardize_stream(SS.post_stream(spark, src, schema, max_files_per_trigger=1), key_fn="md5")
    SS.run_once(SS.start_post_sink(s, layout, ckpt, available_now=True, callback=flaky))
    stored = ST.load_posts(spark, layout)
    batch = D.posts(spark, SF_SMALL, key_fn="md5", engage=False)
    assert stored.count() == batch.count()
    assert {r.id for r in stored.select("id").collect()} == {r.id for r in batch.select("id").collect()}


def test_enrich_job_commits_replies_first(spark):
    from mentionflow.plans import jobs
    layout = ST.JobLayout(scratch_path(spark, f"r-{uuid.uuid4().hex}"), "run_resp")
    jobs.capture_job(D.documents_raw(spark, SF_SMALL), layout, max_per_tab=3)
    n_posts = ST.load_posts(spark, layout).count()

    def responder(system_prompt, user_prompt):
        return '{"summary": "s", "sentiment": "positive", "sentiment_score": 0.5}'
    assert jobs.enrich_job(spark, layout, responder=responder) == n_posts
    assert spark.read.parquet(layout.responses).count() == n_posts
    assert jobs.enrich_job(spark, layout, responder=responder) == 0
    assert spark.read.parquet(layout.responses).count() == n_posts  # no second call
    s = spark.read.parquet(layout.summary)
    assert s.filter(F.col("model_used") == "fallback").count() == 0


def test_non_incremental_save_replaces_partitions(spark):
    """K1 with incremental=False: the affected tabs hold only the unseen
    posts of this save; other tabs are untouched."""
    layout = ST.JobLayout(scratch_path(spark, f"o-{uuid.uuid4().hex}"), "run_ow")
    p = D.posts(spark, SF_SMALL, key_fn="md5", engage=False)
    first = p.filter(F.col("tab").isin("src0", "src1"))
    early = first.filter(F.col("ingest_seq") < 100)  # both tabs have early and late posts
    ST.save_posts(early, layout)
    n_new = ST.save_posts(first, layout, incremental=False)
    late = first.filter(F.col("ingest_seq") >= 100).count()
    assert n_new == late
    assert ST.load_posts(spark, layout).count() == late
    ST.save_posts(p.filter(F.col("tab") == "src2"), layout)
    # de-dup is against what is stored: the early posts were replaced, so
    # they are unseen again and now replace the late ones; src2 is untouched
    n2 = ST.save_posts(first, layout, incremental=False)
    assert n2 == early.count()
    assert ST.save_posts(early, layout, incremental=False) == 0  # nothing unseen: nothing written
    tabs = {r.tab for r in ST.load_posts(spark, layout).select("tab").distinct().collect()}
    assert tabs == {"src0", "src1", "src2"}
    assert ST.load_posts(spark, layout).filter(F.col("tab") != "src2").count() == early.count()


def test_stream_dedup_within_watermark(spark):
    """T4 bounded option: with an event time, de-dup state is kept only
    for the watermark delay; copies inside it are still removed."""
    src = scratch_path(spark, f"src-{uuid.uuid4().hex}")
    # event times from 2024-01-01 on (a row at the epoch would sit on the
    # initial watermark and count as late)
    raw = D.documents_raw(spark, SF_SMALL).withColumn("ts", F.timestamp_seconds(F.col("ingest_seq") * 60 + 1704067200))
    raw.repartition(4).write.parquet(src)
    schema = spark.read.parquet(src).schema
    layout = ST.JobLayout(scratch_path(spark, f"w-{uuid.uuid4().hex}"), "run_wm")
    s = SS.standardize_stream(SS.post_stream(spark, src, schema, max_files_per_trigger=2), key_fn="md5",
                              event_time="ts", watermark="1 day")
    SS.run_once(SS.start_post_sink(s.drop("ts"), layout, scratch_path(spark, f"c-{uuid.uuid4().hex}"),
                                   available_now=True, state_partitions=4))
    streamed = {r.id for r in ST.load_posts(spark, layout).select("id").collect()}
    batch = {r.id for r in D.posts(spark, SF_SMALL, key_fn="md5", engage=False).select("id").collect()}
    assert streamed == batch


def _rows(spark, rows):
    return spark.createDataFrame(rows, "id string, text string, tab string, author string, content_hash string, tab_rank int, ingest_seq bigint")


def test_save_ids_hashes_tabs_and_totals(spark):
    """A retried save adds and reports nothing more; NULL hashes are computed, not
    merged; tabs stay strings; the audit tells what is stored, also for zero new rows."""
    layout = ST.JobLayout(scratch_path(spark, f"a-{uuid.uuid4().hex}"), "run_a")
    rows = [(str(i), f"text {i}", "007" if i % 2 else "012", None, None, 0, i) for i in range(5)]
    assert ST.save_posts(_rows(spark, rows), layout, save_id="one") == 5
    assert ST.save_posts(_rows(spark, rows), layout, save_id="one") == 0
    assert ST.save_posts(_rows(spark, rows), layout, save_id="two") == 0
    assert sorted({r.tab for r in ST.load_posts(spark, layout).collect()}) == ["007", "012"]
    audit = {(r.save_id, r.tab): (r.new_rows, r.total_rows) for r in ST.read_stored(spark, layout.audit).collect()}
    assert audit == {("one", "007"): (2, 2), ("one", "012"): (3, 3), ("two", "007"): (0, 2), ("two", "012"): (0, 3)}
    assert ST.save_posts(_rows(spark, [("9", "new", "007", None, None, 0, 9)]), layout, incremental=False, save_id="three") == 1
    after = {r.tab: (r.new_rows, r.total_rows) for r in ST.read_stored(spark, layout.audit).filter("save_id = 'three'").collect()}
    assert after == {"007": (1, 1)}


def test_save_writes_a_bounded_number_of_files(spark):
    layout = ST.JobLayout(scratch_path(spark, f"f-{uuid.uuid4().hex}"), "run_f")
    ST.save_posts(D.posts(spark, SF_SMALL, key_fn="md5", engage=False), layout)
    stored = ST.load_posts(spark, layout)
    assert len(stored.inputFiles()) <= stored.select("tab").distinct().count() * ST.FILES_PER_TAB


def test_summaries_by_tab_and_overwrite(spark):
    layout = ST.JobLayout(scratch_path(spark, f"s-{uuid.uuid4().hex}"), "run_s")
    def make(keys):
        return spark.createDataFrame(keys, "post_id string, tab string")
    assert ST.save_summaries(make([("1", "a"), ("1", "b"), ("2", "a")]), layout) == 3
    assert ST.save_summaries(make([("1", "c"), ("1", "a")]), layout) == 1  # the same text in another tab
    assert ST.save_summaries(make([("1", "a"), ("2", "a"), ("3", "a"), ("4", "a")]), layout, incremental=False) == 4
    assert sorted(tuple(r) for r in ST.read_stored(spark, layout.summary).select("post_id", "tab").collect()) == [
        ("1", "a"), ("1", "b"), ("1", "c"), ("2", "a"), ("3", "a"), ("4", "a")]


def test_run_once_does_not_pass_an_unfinished_stream():
    class Query:
        stopped = False
        def awaitTermination(self, timeout=None):
            return False
        def stop(self):
            self.stopped = True
    q = Query()
    with pytest.raises(TimeoutError):
        SS.run_once(q, timeout_s=1)
    assert q.stopped


def test_cap_leaves_a_copy_to_the_next_tab(spark):
    """W1 + W2: a post beyond the cap of its tab isn't seen yet, so its copy in a later tab is taken;
    what earlier runs stored counts in the cap."""
    from mentionflow.operators.standardize import standardize_posts
    raw = spark.createDataFrame([("first post of a", "a", 0, 1), ("shared post", "a", 0, 2), ("shared post", "b", 1, 3), ("only in b", "b", 1, 4),
                                 ("first post of a", "b", 1, 5)], "raw_text string, tab string, tab_rank int, ingest_seq bigint")
    def kept(n, taken=None):
        return sorted((r.tab, r.ingest_seq) for r in standardize_posts(raw, max_per_tab=n, taken=taken).collect())
    assert kept(1) == [("a", 1), ("b", 3)]
    assert kept(2) == [("a", 1), ("a", 2), ("b", 4)]
    first = standardize_posts(raw, max_per_tab=1).select("id", "tab")
    assert kept(1, first) == []
    assert kept(2, first) == [("b", 4)]


def test_one_reply_for_each_post_and_unasked_posts(spark):
    from mentionflow.operators import enrich as E
    posts = spark.createDataFrame([("1", "a text", "h", "x", [], 0, 1), ("1", "a text", "g", "y", [], 1, 2), ("2", "b text", "k", "x", [], 0, 3)],
                                  "id string, text string, content_hash string, tab string, symbols array<string>, tab_rank int, ingest_seq bigint")
    replies = spark.createDataFrame([("1", '{"summary": "s"}', 5), ("1", '{"summary": "s"}', 5)], "post_id string, response string, total_tokens bigint")
    assert E.summarize(posts, replies).count() == 3
    r = E.enrichment_stats(posts, replies, by_tab=False).first()
    assert (r.total_requests, r.failed_requests, r.fallback_summaries, r.summaries) == (2, 0, 1, 3)


def test_envelope_values(spark):
    """Types as the record model has them: strings of digits count, words and nulls do not; defaults are filled."""
    d = tempfile.mkdtemp(prefix="env-")
    posts = [{"id": "1", "text": "t", "tab": "007", "like_count": "12", "content_hash": "stale"}, {"id": 5, "text": "t", "tab": "a"},
             {"id": "2", "text": "t", "tab": "a", "view_count": "many"}, {"id": "3", "text": "t", "tab": "a", "symbols": None},
             {"id": "4", "text": "t", "tab": "a", "urls": ["x", 1]}, {"id": "6", "text": "t", "tab": "a", "like_count": 1.5}, 7]
    with open(os.path.join(d, "posts_007.json"), "w") as f:
        json.dump({"metadata": {}, "posts": posts}, f)
    valid, rejected = ST.read_envelopes(spark, os.path.join(d, "posts_*.json"))
    v = valid.collect()
    assert [(r.id, r.tab, r.like_count, r.view_count, r.symbols, r.tab_rank, r.ingest_seq) for r in v] == [("1", "007", 12, 0, [], 0, 0)]
    assert v[0].content_hash != "stale" and len(v[0].content_hash) == 16
    assert sorted(r.reasons[0] for r in rejected.collect()) == [
        "malformed_record", "wrong_type_id", "wrong_type_like_count", "wrong_type_symbols", "wrong_type_urls", "wrong_type_view_count"]


def test_sketched_totals(spark):
    """Sketches of saves: a replay counts once, a replacing save ends what its tab held, jobs merge."""
    from pyspark.sql import functions as F
    rows = lambda a, b, tab: spark.range(a, b).select(F.concat(F.lit("text "), "id").alias("text"), F.lit(tab).alias("tab"), F.concat(F.lit(f"{tab}-"), "id").alias("content_hash"))
    one, two = ST.JobLayout(tempfile.mkdtemp(prefix="mf-sk-"), "run_1"), ST.JobLayout(tempfile.mkdtemp(prefix="mf-sk-"), "run_2")
    ST.save_posts(rows(0, 3000, "a").unionByName(rows(0, 500, "b")), one, save_id="s1")
    ST.save_posts(rows(2000, 4000, "a"), one, save_id="s2")
    ST.save_posts(rows(2000, 4000, "a"), one, save_id="s2")
    ST.save_posts(rows(3000, 5000, "a"), two, save_id="s1")
    near = lambda got, want: all(abs(got[k] - n) <= 0.032 * n + 1 for k, n in want.items()) and set(got) == set(want)
    totals = lambda *x: {r.tab: r.unique_posts for r in ST.sketched_totals(spark, list(x)).collect()}
    assert near(totals(one), {"a": 4000, "b": 500, None: 4500})
    assert near(totals(one, two), {"a": 5000, "b": 500, None: 5500})
    ST.save_posts(rows(9000, 9100, "b"), one, incremental=False, save_id="s3")
    assert near(totals(one), {"a": 4000, "b": 100, None: 4100})
    assert totals(ST.JobLayout(tempfile.mkdtemp(prefix="mf-sk-"), "none")) == {}
