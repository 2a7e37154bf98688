"""Job-scoped storage (K1–K6) and the JSON import/export forms.

Native layout (Parquet, partitioned by tab)::

    <base>/<job_name>/raw/tab=<tab>/...        posts
    <base>/<job_name>/summary/tab=<tab>/...    summaries
    <base>/<job_name>/audit/                   one row per (save, tab)
    <base>/<job_name>/reports/                 final_report.md, report_data/

Saves are idempotent: new posts are anti-joined on ``content_hash`` against
what is stored (and de-duplicated inside the batch), summaries on
``post_id`` and tab; a replayed save adds nothing. Each save stamps its rows
with a ``save_id``; counts are read back from committed files, so they survive
task retries and executor loss. A ``save_id`` names one save: repeated after
its audit rows are there, it stores and reports nothing more.

A batch is first written to the shared scratch folder, so its transformations
run once; it is spread over at most ``FILES_PER_TAB`` files for each tab, and
the scratch copy is removed after the save.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import content_hash
from ..functions.lexicons import RAW_FILE_PREFIX, SUMMARY_FILE_PREFIX, TABS
from ..functions.validate import POST_FIELDS, SUMMARY_FIELDS, record_problems, record_value
from ..operators.dedup import dedup_new, new_summaries
from ..schemas import POST, SUMMARY, ENVELOPE_META_POSTS, ENVELOPE_META_SUMMARIES
from ..session import remove_path, scratch_path, staged


def job_name_at(ts: _dt.datetime | None = None) -> str:
    """K6: ``run_%Y%m%d_%H%M%S``."""
    return (ts or _dt.datetime.now()).strftime("run_%Y%m%d_%H%M%S")


class JobLayout:
    def __init__(self, base: str, job_name: str | None = None):
        self.base = base.rstrip("/")
        self.job_name = job_name or job_name_at()

    @property
    def root(self) -> str:
        return f"{self.base}/{self.job_name}"

    raw = property(lambda self: f"{self.root}/raw")
    summary = property(lambda self: f"{self.root}/summary")
    responses = property(lambda self: f"{self.root}/responses")
    audit = property(lambda self: f"{self.root}/audit")
    reports = property(lambda self: f"{self.root}/reports")


#: Files that one save writes for a tab at most.
FILES_PER_TAB = 8


def read_stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or None when nothing was written yet. ``tab`` is read
    as the string it was written as (``007`` stays ``007``)."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:  # PATH_NOT_FOUND / unable to infer: empty store
        msg = str(e)
        if "PATH_NOT_FOUND" in msg or "UNABLE_TO_INFER_SCHEMA" in msg or "does not exist" in msg:
            return None
        raise
    if "tab" in df.columns and not isinstance(df.schema["tab"].dataType, T.StringType):
        fields = [T.StructField("tab", T.StringType()) if f.name == "tab" else f for f in df.schema.fields]
        df = spark.read.schema(T.StructType(fields)).parquet(path)
    return df


AUDIT_SCHEMA = T.StructType([
    T.StructField("table", T.StringType()), T.StructField("tab", T.StringType()),
    T.StructField("job_name", T.StringType()), T.StructField("total_rows", T.LongType()),
    T.StructField("new_rows", T.LongType()), T.StructField("last_updated", T.TimestampType()),
    T.StructField("save_id", T.StringType()), T.StructField("sketch", T.BinaryType()), T.StructField("replaces", T.BooleanType())])

#: Sketches of distinct content hashes: 2^SKETCH_K registers (8 KB for a tab and save at most), a standard error of about 0.8 %.
SKETCH_K = 14


def _write_audit(spark, layout: JobLayout, table: str, path: str, save_id: str, tabs: DataFrame, replaces: bool = False) -> int:
    """K5: one audit row for each tab of the batch: rows this save added (0
    included) and rows now stored, counted from the committed files; returns the
    number of rows added. Only the batch's partitions are read, and of them the
    ``save_id`` column and, for posts, the hash: a mergeable sketch of the hashes that this save added
    goes into the row, so distinct totals need no stored post (``sketched_totals``)."""
    now = read_stored(spark, path)
    if now is None:
        counts = tabs.select("tab", F.lit(0).cast("long").alias("total_rows"), F.lit(0).cast("long").alias("new_rows"), F.lit(None).cast("binary").alias("sketch"))
    else:
        counts = tabs.join(_audit_counts(now, table, save_id, tabs), "tab", "left").na.fill(0, ["total_rows", "new_rows"])
    rows = counts.select(F.lit(table).alias("table"), "tab", F.lit(layout.job_name).alias("job_name"), "total_rows", "new_rows",
                         F.current_timestamp().alias("last_updated"), F.lit(save_id).alias("save_id"), "sketch", F.lit(replaces).alias("replaces"))
    # one file, a row for each tab of the batch; only these rows meet in one task, the stages before keep theirs
    rows.repartition(1).write.mode("append").parquet(layout.audit)
    return int(_audit_of(spark, layout, table, save_id).agg(F.sum("new_rows")).first()[0] or 0)


def _audit_counts(now: DataFrame, table: str, save_id: str, tabs: DataFrame) -> DataFrame:
    """(tab, total_rows, new_rows, sketch) of the stored rows ``now``. Each task counts its own rows before the shuffle:
    no stored row is dealt out by its tab. The tabs are sent to every task, or, if many, joined to the counts."""
    mine = F.col("save_id") == save_id
    sketch = F.hll_sketch_agg(F.when(mine, F.col("content_hash")), F.lit(SKETCH_K)) if table == "posts" else F.lit(None).cast("binary")
    if _few(tabs):
        now = now.join(F.broadcast(tabs), "tab", "left_semi")
    return now.groupBy("tab").agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(mine).cast("long").alias("new_rows"), sketch.alias("sketch"))


def _audit_of(spark, layout: JobLayout, table: str, save_id: str) -> DataFrame | None:
    a = read_stored(spark, layout.audit)
    return None if a is None else a.filter((F.col("table") == table) & (F.col("save_id") == save_id))


def _save(new: DataFrame, path: str, incremental: bool, save_id: str, spread_by: str) -> None:
    """Write the new rows, tab and a bounded salt deciding the task: a hot tab is
    split over FILES_PER_TAB tasks, and no save leaves more files than that for a tab."""
    salt = F.pmod(F.xxhash64(spread_by), F.lit(FILES_PER_TAB))
    stamped = new.withColumn("save_id", F.lit(save_id)).repartition("tab", salt)
    w = stamped.write.partitionBy("tab")
    if incremental:
        w.mode("append").parquet(path)
    else:
        w.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def sketched_totals(spark: SparkSession, layouts: list[JobLayout]) -> DataFrame:
    """A8 from the audits alone: (tab, unique_posts) with the estimated number of distinct content hashes stored in each tab
    of these jobs, and over all of them (tab NULL). Sketches merge, so a replayed save, or a post that two jobs stored,
    counts once; a save that replaced a tab ends what was there before. The estimate's standard error is about 0.8 %."""
    every = None
    for layout in layouts:
        a = read_stored(spark, layout.audit)
        if a is not None:
            a = a.filter(F.col("table") == "posts").select(F.lit(layout.root).alias("job"), "tab", "last_updated", "replaces", "sketch")
            every = a if every is None else every.unionByName(a)
    if every is None:
        return spark.createDataFrame([], "tab string, unique_posts long")
    last = every.filter("replaces").groupBy("job", "tab").agg(F.max("last_updated").alias("since"))
    live = every.join(last, ["job", "tab"], "left").filter("(since IS NULL OR last_updated >= since) AND sketch IS NOT NULL")
    # sketches of one tab meet after partial unions: a tab is as many rows as it had saves
    return live.rollup("tab").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_posts")).distinct()


def already_saved(spark: SparkSession, layout: JobLayout, save_id: str, table: str = "posts") -> bool:
    """True when a save with this id has been committed (replayed batch)."""
    a = _audit_of(spark, layout, table, save_id)
    return a is not None and not a.isEmpty()


def _staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def save_posts(posts: DataFrame, layout: JobLayout, incremental: bool = True,
               save_id: str | None = None, key_fn: str = "xxh64") -> int:
    """K1: store unseen posts; returns how many were added.

    A NULL ``content_hash`` is computed from text, author and tab.
    ``incremental=False`` replaces the partitions of the affected tabs with
    the unseen posts only; with nothing new nothing is written. The content
    hash includes the tab, so only the stored partitions of the batch's tabs
    can hold a match: the anti-join reads just those, by dynamic partition pruning."""
    spark = posts.sparkSession
    save_id = save_id or uuid.uuid4().hex
    if already_saved(spark, layout, save_id, "posts"):
        return 0
    author = "author" if "author" in posts.columns else F.lit(None).cast("string")
    own = content_hash("text", author, "tab", key_fn=key_fn) if "text" in posts.columns else None
    if "content_hash" not in posts.columns:
        posts = posts.withColumn("content_hash", own)
    elif own is not None:
        posts = posts.withColumn("content_hash", F.coalesce("content_hash", own))
    batch, scratch = _staged(posts.drop("save_id"), "batch")
    try:
        # (a filter on the tabs lets Spark prune the stored partitions by them)
        tabs = batch.select("tab").distinct().filter(F.col("tab") >= "")
        stored = read_stored(spark, layout.raw)
        if stored is not None:
            stored = stored.join(F.broadcast(tabs), "tab", "left_semi").select("content_hash") if _few(tabs) else stored.select("content_hash")
        order = [c for c in ("tab_rank", "ingest_seq") if c in batch.columns]
        # the staged files don't change, so neither do the row numbers
        rows = batch.withColumn("_row", F.monotonically_increasing_id())
        new = dedup_new(rows, stored, "content_hash", [*order, "_row"], ["_row"]).drop("_row")
        if not incremental and new.isEmpty():
            return 0
        if incremental:
            _save(new, layout.raw, True, save_id, "content_hash")
        else:  # the batch was computed against the table whose partitions it replaces
            held, second = _staged(new, "batch")
            _save(held, layout.raw, False, save_id, "content_hash")
            remove_path(spark, second)
        return _write_audit(spark, layout, "posts", layout.raw, save_id, tabs, not incremental)
    finally:
        remove_path(spark, scratch)


#: Tabs that are sent to every task to prune partitions; a batch with more is joined by a shuffle.
BROADCAST_TABS = 10_000


def _few(tabs: DataFrame) -> bool:
    return tabs.limit(BROADCAST_TABS + 1).count() <= BROADCAST_TABS


def save_summaries(summaries: DataFrame, layout: JobLayout, incremental: bool = True,
                   save_id: str | None = None) -> int:
    """K2: store summaries whose post id is not stored yet in their tab;
    ``incremental=False`` replaces the partitions of the affected tabs with all of them."""
    spark = summaries.sparkSession
    save_id = save_id or uuid.uuid4().hex
    if already_saved(spark, layout, save_id, "summaries"):
        return 0
    batch, scratch = _staged(summaries.drop("save_id"), "batch")
    try:
        stored = read_stored(spark, layout.summary) if incremental else None
        new = new_summaries(batch, stored)
        if not incremental and new.isEmpty():
            return 0
        _save(new, layout.summary, incremental, save_id, "post_id")
        return _write_audit(spark, layout, "summaries", layout.summary, save_id, batch.select("tab").distinct())
    finally:
        remove_path(spark, scratch)


def load_posts(spark: SparkSession, layout: JobLayout, tabs: list[str] | None = None) -> DataFrame | None:
    """S1/S3 on the native layout; a tab list becomes a partition filter."""
    df = read_stored(spark, layout.raw)
    if df is not None and tabs:
        df = df.filter(F.col("tab").isin(tabs))
    return df


# ------------------------------------------------------ JSON forms
def _envelope_schema(meta: T.StructType, key: str) -> T.StructType:
    # each record is kept as raw JSON text and parsed one by one, so one bad
    # record is rejected alone (the file is not lost)
    return T.StructType([T.StructField("metadata", meta), T.StructField(key, T.ArrayType(T.StringType())),
                         T.StructField("_corrupt_record", T.StringType())])


def read_envelopes(spark: SparkSession, pattern: str, kind: str = "posts", tabs=None, key_fn: str = "xxh64"):
    """Read ``{metadata, posts|summaries: [...]}`` documents.

    Returns ``(valid, rejected)``. Each record is checked field by field
    (missing → default, null or a value of another type → rejected, see
    ``functions.validate``), its content hash is computed anew, and it gets what the
    analytics need: ``tab_rank`` (configured tabs first, in their order, then the others by
    name) and ``ingest_seq`` (its number in the file, after the files before it).
    The tab of a file (``posts_<tab>.json``) is ``file_tab``; a missing path
    gives empty frames; an unreadable file or an invalid record lands in
    ``rejected`` with reasons. An envelope is one multi-line document (not
    splittable); its records are dealt out over all tasks once it is read."""
    if kind == "posts":
        meta, key, schema, prefix, fields = ENVELOPE_META_POSTS, "posts", POST, RAW_FILE_PREFIX, POST_FIELDS
    else:
        meta, key, schema, prefix, fields = ENVELOPE_META_SUMMARIES, "summaries", SUMMARY, SUMMARY_FILE_PREFIX, SUMMARY_FIELDS
    rej_schema = T.StructType([T.StructField("file_tab", T.StringType()), T.StructField("record", T.StringType()),
                               T.StructField("reasons", T.ArrayType(T.StringType()))])
    names = [f.name for f in schema.fields]
    valid_schema = T.StructType([*schema.fields, T.StructField("tab_rank", T.IntegerType()), T.StructField("file_tab", T.StringType())])
    try:
        text = spark.read.text(pattern, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return (spark.createDataFrame([], valid_schema), spark.createDataFrame([], rej_schema))
        raise
    raw = text.select(
        "value", F.from_json("value", _envelope_schema(meta, key), {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("j"),
        F.col("_metadata.file_path").alias("file"),
        F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), rf"{prefix}([^/]*)\.json", 1).alias("file_tab"))
    broken = F.col("j").isNull() | F.col("j._corrupt_record").isNotNull()
    bad_files = raw.filter(broken).select("file_tab", F.col("value").alias("record"), F.array(F.lit("unreadable_file")).alias("reasons"))
    raw = raw.filter(~broken)
    recs = raw.select("file_tab", "file", F.posexplode(f"j.{key}").alias("pos", "record"))
    recs = recs.repartition("file", "pos").withColumn("_v", F.try_parse_json("record"))
    checked = recs.withColumn("reasons", record_problems("_v", fields))
    values = {n: record_value("_v", n, fields) for n in names if n in fields}
    ok = F.size("reasons") == 0
    # files are read and records parsed once: what is valid as its columns, what is not as its text
    checked = staged(checked.select("file_tab", "file", "pos", "reasons", F.when(~ok, F.col("record")).alias("record"), *[
        F.when(ok, values.get(f.name, F.lit(None)).cast(f.dataType)).alias(f"v_{f.name}") for f in schema.fields if f.name != "ingest_seq"]), "envelopes")
    valid = checked.filter(ok).select("file_tab", "file", "pos", *[F.col(f"v_{f.name}").alias(f.name) for f in schema.fields if f.name != "ingest_seq"])
    if kind == "posts":
        valid = valid.withColumn("content_hash", content_hash("text", "author", "tab", key_fn=key_fn))
    order = {name: i for i, (name, _) in enumerate(tabs or TABS)}
    rank = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))]), F.col("tab")), F.lit(len(order)))
    # one row for each tab and for each file: small, numbered in one task
    dim = valid.select("tab", rank.alias("r")).distinct().withColumn("tab_rank", F.row_number().over(Window.orderBy("r", "tab")) - 1).drop("r")
    files = checked.groupBy("file").agg((F.max("pos") + 1).alias("n")).withColumn(  # files without records have no row that asks for them
        "before", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    valid = valid.join(dim, "tab").join(files.select("file", "before"), "file")
    valid = valid.withColumn("ingest_seq", (F.col("before") + F.col("pos")).cast("long"))
    rejected = checked.filter(F.size("reasons") > 0).select("file_tab", "record", "reasons").unionByName(bad_files)
    return valid.select(*names, "tab_rank", "file_tab"), rejected


def write_jsonl(df: DataFrame, path: str) -> str:
    """Export as JSON Lines partitioned by tab (splittable, parallel)."""
    df.write.mode("overwrite").partitionBy("tab").json(path)
    return path


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = POST) -> DataFrame:
    fields = [f for f in schema.fields if f.name != "tab"]
    return spark.read.schema(T.StructType(fields)).json(path)
