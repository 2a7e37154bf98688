"""Work that grows no faster than the tables: micro-batches, pieces, slices, envelopes."""

import tempfile

import pyarrow as pa
from pyspark.sql import functions as F

from mentionflow.llm import fuzzy_lines
from mentionflow.operators import lexicon_join as L
from mentionflow.sources import blocks as B
from mentionflow.sources import driver_tables as D
from mentionflow.sources import store as ST
from mentionflow.streaming import ordered as O
from mentionflow.streaming import streams as S


def test_micro_batches_do_not_grow_with_the_source(spark):
    src = tempfile.mkdtemp(prefix="mf-f-") + "/s"
    spark.range(100).repartition(50).write.parquet(src)
    n = len(spark.read.parquet(src).inputFiles())
    assert n > 2 * S.MAX_BATCHES and -(-n // S.files_per_trigger(spark, src, 2)) <= S.MAX_BATCHES
    assert S.files_per_trigger(spark, src, 40) == 40


def test_first_seen_settles_buckets_of_ids(spark):
    """One bucket of state: all ids of a micro-batch in one call; other columns come back as they were, NULL among whole numbers too."""
    src, path, ckpt = (tempfile.mkdtemp(prefix="mf-b-") + "/x" for _ in range(3))
    kind = "raw_text string, tab string, tab_rank int, ingest_seq long, author string, big long, at timestamp"
    batches = [[(f"text number {i % 7}", "t", 0, 100 * (3 - b) + i, None, 2 ** 62 + 1 if i % 2 else None, None) for i in range(20)] for b in range(3)]
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
    raw = S.post_stream(spark, src, spark.read.parquet(src).schema, max_files_per_trigger=1)
    S.run_once(O.start_first_seen_sink(O.first_seen(raw, buckets=1), path, ckpt, available_now=True, state_partitions=2), timeout_s=240)
    now = O.current_posts(O.first_seen_log(spark, path)).collect()
    assert sorted((r.text, r.ingest_seq, r.big) for r in now) == [(f"text number {i}", 100 + i, 2 ** 62 + 1 if i % 2 else None) for i in range(7)]


def test_pages_are_taken_in_slices():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * B.CHUNK_CHARS, None, "", "y", "z" * (B.CHUNK_CHARS // 2), "w" * (B.CHUNK_CHARS // 2)])], ["html"])
    parts = list(B._chunks(b, 0))
    assert [p.num_rows for p in parts] == [3, 2, 1] and pa.Table.from_batches(parts).combine_chunks().column(0).to_pylist() == b.column(0).to_pylist()
    assert list(B._chunks(b.slice(0, 0), 0)) == []


def test_texts_meet_keywords_by_pieces(spark):
    texts = ["ab cd", "  ", "xab", "a b", "ab  cd", "b", "日本 ab c", " lead", "abcab cd ab"]
    kws = [" ", "  ", "b c", "ab", "a", "b  ", "本 a", " l", "cd ", "d", "   ", "bcab cd"]
    d = spark.createDataFrame(list(enumerate(texts)) + [(0, "cd")], "id long, text string")
    lex = spark.createDataFrame([("l", k) for k in kws], "label string, keyword string")
    got = [tuple(r) for r in L.keyword_hits(d, lex, "id", "text").collect()]
    want = {(i, "l", k) for k in kws for i, t in [*enumerate(texts), (0, "cd")] if k in t}
    assert len(got) == len(want) and set(got) == want
    # characters of the texts are looked at once for each distinct piece
    same = spark.range(300).select(F.col("id").alias("_r"), F.lit("the same few words again").alias("_t"))
    kw = L.staged(spark.createDataFrame([(0, "ame"), (1, "ords")], "_k long, keyword string"), "t")
    assert sorted(r.token for r in L._found(L.staged(same, "t"), kw)[1].collect()) == ["same", "words"]


def test_envelopes_are_filled(spark):
    """Tabs that alternate by row still fill their envelopes, up to the limit."""
    d = tempfile.mkdtemp(prefix="mf-e-")
    docs = spark.range(1, 2001).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"),
                                       F.concat(F.lit("src"), (F.col("id") % 10).cast("string")).alias("source"))
    docs.write.parquet(f"{d}/documents.parquet")
    D.write_envelopes(spark, d, f"{d}/out", per_file=100)
    files = spark.read.text(f"{d}/out/*/*", wholetext=True).select(F.regexp_count("value", F.lit('"id": "')).alias("n"))
    sizes = [r.n for r in files.collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 100 and len(sizes) <= 30


def test_audits_count_stored_rows_where_they_are(spark, monkeypatch):
    """No stored row is dealt out by its tab, or read in one task with all others; counts and sketches are those of each save, for few tabs and many."""
    rows = spark.range(2000).select(F.col("id").cast("string").alias("content_hash"), F.concat(F.lit("t"), F.col("id") % 3).alias("tab"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few in (10, 1):
            monkeypatch.setattr(ST, "BROADCAST_TABS", few)
            at = ST.JobLayout(tempfile.mkdtemp(prefix="mf-a-"), "j")
            assert ST.save_posts(rows.where("content_hash < 900"), at, save_id="a") == 900
            assert ST.save_posts(rows.where("tab <> 't2'"), at, save_id="b") == 734
            plan = ST._audit_counts(ST.read_stored(spark, at.raw), "posts", "b", rows.select("tab").distinct())._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "partial_count" in plan
            got = {(r.tab, r.total_rows, r.new_rows) for r in spark.read.parquet(at.audit).where("save_id = 'b'").collect()}
            assert got == {("t0", 667, 367), ("t1", 667, 367)}
            assert {r.tab: round(r.unique_posts / 10) for r in ST.sketched_totals(spark, [at]).where("tab < 't2'").collect()} == {"t0": 67, "t1": 67}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_signatures_are_of_every_position(spark):
    """Long lines too: the least hash of each value is that of the whole set of shingles."""
    line = " ".join(f"word{i * i}" for i in range(200))
    d = spark.createDataFrame([(1, line)], "doc_id long, text string")
    got = fuzzy_lines.signatures(fuzzy_lines.lines_of(d)).collect()
    every = {line[i:i + fuzzy_lines.SHINGLE] for i in range(len(line) - fuzzy_lines.SHINGLE + 1)}
    h = F.shiftright(F.xxhash64(F.lit(0), F.col("x")).bitwiseXOR(F.lit(fuzzy_lines._constants(1)[0])), 32).cast("int")
    want = spark.createDataFrame([(x,) for x in every], "x string").agg(F.min(h)).first()[0]
    assert [r.m0 for r in got] == [want]


def test_signatures_and_sets_of_lines_of_any_length(spark):
    """Chunks lose, add and shorten no shingle: lengths around theirs, other alphabets and planes, breaks inside the line."""
    abc = "abcdefg \r\u2028hij klmäöüß日本語😀xyz0123456789"
    lines = [(abc * 3)[k:k + n] for k in (0, 5, 25) for n in range(1, 60)] + ["plain ascii only, " * 4]
    d = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    of = fuzzy_lines.lines_of(d).where(F.length("norm") >= fuzzy_lines.SHINGLE)
    pos = of.select("k1", "k2", "norm", F.explode(F.sequence(F.lit(1), F.length("norm") - fuzzy_lines.SHINGLE + 1)).alias("p"))
    pos = pos.select("k1", "k2", F.substring("norm", F.col("p"), F.lit(fuzzy_lines.SHINGLE)).alias("x"))
    cs, rows = fuzzy_lines._constants(fuzzy_lines.BANDS), fuzzy_lines.ROWS
    want = pos.groupBy("k1", "k2").agg(*[F.min(F.shiftright(F.xxhash64(F.lit(m % rows), F.col("x")).bitwiseXOR(F.lit(cs[m // rows])), 32).cast("int")).alias(f"m{m}") for m in range(len(cs) * rows)])
    got = fuzzy_lines.signatures(of)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100
    sets = {(r.k1, r.k2): sorted(r.s) for r in pos.groupBy("k1", "k2").agg(F.collect_set(F.xxhash64("x")).alias("s")).collect()}
    assert {(r.k1, r.k2): sorted(r.s) for r in of.select("k1", "k2", fuzzy_lines._shingles("norm").alias("s")).collect()} == sets
    # one regular expression match for each chunk, not for each shingle
    assert of.agg(F.max(F.size(fuzzy_lines._chunks("norm")))).first()[0] <= -(-72 // fuzzy_lines.SPAN)


def test_shingle_sets_are_cut_by_position(spark):
    """No regular expression match for each shingle: the pairs' sets come from positions."""
    d = spark.createDataFrame([(1, "a plain line of words\nwörter, 日本語 and 😀 in a line"), (2, "short")], "doc_id long, text string")
    of = fuzzy_lines.lines_of(d)
    pairs = spark.createDataFrame([], "a1 long, a2 long, b1 long, b2 long")
    plan = fuzzy_lines.verified(pairs, of)._jdf.queryExecution().optimizedPlan().toString()
    assert f"{{{fuzzy_lines.SHINGLE}}}))." not in plan
    got = {r.norm: r.n for r in of.select("norm", F.size(fuzzy_lines._shingles("norm")).alias("n")).collect()}
    assert got == {"a plain line of words": 14, "wörter, 日本語 and 😀 in a line": 20, "short": 0}
    n = {r.doc_id: r.n_lines for r in fuzzy_lines.report(spark.createDataFrame([(1, "ä\n\n日本\n"), (2, None), (3, "")], "doc_id long, text string")).collect()}
    assert n == {1: 4, 2: 0, 3: 1}
