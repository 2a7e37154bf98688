"""T4 in capture order, and T7: tabs of a micro-batch that fail alone."""

import random
import tempfile

from pyspark.sql import functions as F

from mentionflow.sources.store import JobLayout, load_posts, read_stored
from mentionflow.streaming import ordered as O
from mentionflow.streaming import streams as S

KIND = "raw_text string, tab string, tab_rank int, ingest_seq long, author string"


def files(spark, batches):
    """A folder with one file for each batch, in their order."""
    src = tempfile.mkdtemp(prefix="mf-src-") + "/s"
    for rows in batches:
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(src)
    return S.post_stream(spark, src, spark.read.parquet(src).schema, max_files_per_trigger=1)


def drain(query):
    S.run_once(query, timeout_s=240)


def test_late_copies_at_earlier_positions_correct(spark):
    rng = random.Random(3)
    rows = [(f"text number {rng.randrange(30)}", f"t{r}", r, s, None) for s in range(160) for r in [rng.randrange(4)]]
    rng.shuffle(rows)
    batches = [rows[i:i + 40] for i in range(0, 160, 40)] + [[("tiny", "t0", 0, 999, None), ("<b></b>      ", "t0", 0, 998, None)]]
    path, ckpt = (tempfile.mkdtemp(prefix="mf-o-") + "/x" for _ in range(2))
    drain(O.start_first_seen_sink(O.first_seen(files(spark, batches)), path, ckpt, available_now=True, state_partitions=2))
    log = O.first_seen_log(spark, path)
    got = sorted((r.text, r.tab_rank, r.ingest_seq) for r in O.current_posts(log).collect())
    want = {}
    for t, _, r, s, _ in rows:
        want[t] = min(want.get(t, (r, s)), (r, s))
    assert got == sorted((t, *p) for t, p in want.items())
    # a correction names what it replaces, which was passed on before; nothing later than what is known is passed on
    by_id = {}
    for r in log.collect():
        by_id.setdefault(r.id, []).append(((r.tab_rank, r.ingest_seq), (r.replaces_rank, r.replaces_seq)))
    assert any(len(x) > 1 for x in by_id.values())
    for own in by_id.values():
        chain = sorted(own, reverse=True)
        assert chain[0][1] == (None, None) and [b for _, b in chain[1:]] == [p for p, _ in chain[:-1]]


def test_tabs_fail_alone_and_are_stored_once(spark):
    rows = [[(f"post {i} of batch {b} in {t}", t, k, 100 * b + i, None) for k, t in enumerate(("a", "b", "c")) for i in range(4)] for b in range(2)]
    layout = JobLayout(tempfile.mkdtemp(prefix="mf-iso-"), "run")
    calls = []

    def check(frame, tab):
        calls.append(tab)
        if tab == "b":
            raise ValueError("not today")
    s = S.standardize_stream(files(spark, rows))
    drain(O.start_isolated_sink(s, layout, tempfile.mkdtemp(prefix="mf-c-") + "/c", check, available_now=True, state_partitions=2))
    assert {r["tab"]: r["count"] for r in load_posts(spark, layout).groupBy("tab").count().collect()} == {"a": 8, "c": 8}
    dead = read_stored(spark, O.dead_letters(layout))
    assert dead.count() == 8 and {r.reason for r in dead.select("reason").distinct().collect()} == {"ValueError: not today"}
    failed = O.redrive(spark, layout, check)
    assert len(failed) == 2 and all("not today" in x for x in failed.values()) and load_posts(spark, layout).where("tab = 'b'").count() == 0
    assert set(O.redrive(spark, layout).values()) == {None}
    assert O.redrive(spark, layout) == {}
    stored = load_posts(spark, layout)
    assert stored.where("tab = 'b'").count() == 8 == stored.where("tab = 'b'").select("id").distinct().count()
    assert {"reason", "save_id"} - set(stored.columns) == {"reason"}


def test_processing_time_trigger(spark):
    """Flushes at an interval, a second one for rows that came after the first; then the stream is stopped."""
    import time
    src = tempfile.mkdtemp(prefix="mf-t2-") + "/s"
    one = lambda n: spark.createDataFrame([(f"post number {n}", "a", 0, n, None)], KIND).coalesce(1).write.mode("append").parquet(src)
    one(1)
    layout = JobLayout(tempfile.mkdtemp(prefix="mf-t2-"), "run")
    s = S.standardize_stream(S.post_stream(spark, src, spark.read.parquet(src).schema), hot_key_salts=None)
    q = S.start_post_sink(s, layout, tempfile.mkdtemp(prefix="mf-c-") + "/c", interval_seconds=5, state_partitions=1)

    def until(n):
        end = time.time() + 120
        while time.time() < end:
            now = load_posts(spark, layout)
            if now is not None and now.count() == n:
                return True
            time.sleep(1)
        return False
    try:
        assert until(1)
        one(2)
        assert until(2)
    finally:
        q.stop()
    assert read_stored(spark, layout.audit).select("save_id").distinct().count() >= 2
