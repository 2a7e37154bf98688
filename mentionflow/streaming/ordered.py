"""First-wins de-dup of a stream in capture order, and micro-batches whose tabs fail alone.

T4: ``first_seen`` holds for each id the first position (tab rank, capture order) seen so far, narrow state without
texts, by bucket of ids. A copy at an earlier position that arrives late is passed on as a correction, with the position that it replaces; later
copies are dropped. The content hash needs no state of its own: equal hashes have equal texts, so equal
ids. The passed rows are a log; its first row of each id is the batch result, in whatever order files arrive.

T7: ``start_isolated_sink`` stores each tab of a micro-batch or puts its rows, with the reason and the save's name, into
the dead-letter table; the stream goes on. ``redrive`` saves them later under the same name, so a tab is stored once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.dedup import first_rows
from ..operators.standardize import cleaned_post_is_valid, cleaned_posts
from ..session import remove_path, scratch_path
from ..sources.store import JobLayout, already_saved, read_stored, save_posts
from .streams import _start, _stream_id, _trigger

POSITION = ("tab_rank", "ingest_seq")
#: Buckets of ids that the state is kept by.
BUCKETS = 512
#: A known id (16 hex digits), its first position, and when it was seen last (ms).
SEEN = np.dtype([("id", "S16"), ("rank", "<i8"), ("seq", "<i8"), ("at", "<i8")])
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
REPLACES = T.StructType([T.StructField("replaces_rank", T.LongType()), T.StructField("replaces_seq", T.LongType())])


def first_seen(raw: DataFrame, raw_text="raw_text", key_fn: str = "xxh64", ttl_seconds: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The stream of valid cleaned posts that are the first of their id so far, with the position they replace (NULL:
    none). ``ttl_seconds``: an id not seen for that long is forgotten; without it state is kept for the run.

    State is kept by bucket of ids, fixed in number by the checkpoint: a call of Python settles all ids of a bucket at once, and what a
    micro-batch costs in calls does not grow with its ids. A bucket's copies are read as batches, which leave one row for
    each id. ``tab_rank`` and ``ingest_seq`` must not be NULL."""
    # a file is one task or a few, cleaning is dear: the rows are dealt out first. Blank texts have an id of their own, so they are left out
    # at the end, and no filter cleans each text a second time
    posts = cleaned_posts(raw.filter(F.length("tab") > 0).repartition(*POSITION), raw_text, key_fn)
    # pandas has no NULL among whole numbers: columns that are neither texts nor the position go as one JSON text
    rest = [f.name for f in posts.schema.fields if f.name not in POSITION and not isinstance(f.dataType, T.StringType)]
    plain = [c for c in posts.columns if c not in rest]
    kinds = T.StructType([posts.schema[c] for c in rest])
    packed = posts.select(*plain, *([F.to_json(F.struct(*rest), JSON).alias("_rest")] if rest else []),
                          F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("_bucket"))
    names = packed.columns[:-1]
    schema = T.StructType([*packed.schema.fields[:-1], *REPLACES.fields])
    order = ["id", *POSITION]

    def step(key, frames, state):
        known = np.frombuffer(state.get[0], SEEN) if state.exists else np.empty(0, SEEN)
        now = 0
        if ttl_seconds:
            now = state.getCurrentProcessingTimeMs()
            known = known[known["at"] + 1000 * ttl_seconds > now]
        best = None
        for f in frames:
            f = f[names] if best is None else pd.concat([best, f[names]], ignore_index=True)
            best = f.sort_values(order, kind="stable").drop_duplicates("id")
        if best is not None and len(best):
            own = np.empty(len(best), SEEN)
            own["id"] = best["id"].str.encode("ascii").to_numpy()
            own["rank"], own["seq"], own["at"] = best[POSITION[0]].to_numpy(), best[POSITION[1]].to_numpy(), now
            at = np.searchsorted(known["id"], own["id"])  # both are in the order of the id
            old = np.zeros(len(own), bool)
            old[at < len(known)] = known["id"][at[at < len(known)]] == own["id"][at < len(known)]
            was = known[at[old]]
            passed = ~old
            passed[old] = (own["rank"][old] < was["rank"]) | (own["rank"][old] == was["rank"]) & (own["seq"][old] < was["seq"])
            late = ~passed
            out = best[passed].copy()
            for c, f in zip(REPLACES.names, ("rank", "seq"), strict=True):
                before = pd.array(np.zeros(len(own), np.int64), "Int64")
                before[old] = was[f]
                before[~old] = pd.NA
                out[c] = before[passed]
            for f in ("rank", "seq"):  # a later copy moves nothing but the time of its id
                own[f][late] = known[f][at[late]]
            gone = np.ones(len(known), bool)
            gone[at[old]] = False
            known = np.concatenate([known[gone], own])
            known = known[np.argsort(known["id"], kind="stable")]
            if len(out):
                yield out
        if len(known):
            state.update((known.tobytes(),))
            if ttl_seconds:
                state.setTimeoutDuration(1000 * ttl_seconds)
        elif state.exists:
            state.remove()
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_seconds else GroupStateTimeout.NoTimeout
    held = T.StructType([T.StructField("seen", T.BinaryType())])
    out = packed.groupBy("_bucket").applyInPandasWithState(step, schema, held, "append", timeout)
    if rest:
        out = out.withColumn("_rest", F.from_json("_rest", kinds, JSON))
    out = out.select(*[F.col(f"_rest.{c}").alias(c) if c in rest else F.col(c) for c in posts.columns], *REPLACES.names)
    return out.filter(cleaned_post_is_valid())


def start_first_seen_sink(stream: DataFrame, path: str, checkpoint: str, interval_seconds: int | None = None,
                          available_now: bool = False, state_partitions: int | None = None):
    """Write each micro-batch of ``first_seen`` into a folder of its own under ``path``: a replayed one is written over."""
    def each(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{path}/save={_stream_id(batch.sparkSession, checkpoint)}-{batch_id}")
    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append")
    return _start(_trigger(w, interval_seconds, available_now), stream.sparkSession, state_partitions)


def first_seen_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows that the sink wrote, corrections included."""
    return spark.read.parquet(path).drop("save")


def current_posts(log: DataFrame) -> DataFrame:
    """The posts as of now: of each id the row at the first position."""
    return first_rows(log, "id", POSITION).drop("replaces_rank", "replaces_seq")


# ------------------------------------------------------------- isolation
def dead_letters(layout: JobLayout) -> str:
    return f"{layout.root}/dead_letters"


def _save_id(sid: str, tab: str | None) -> str:
    return f"{sid}-tab-{tab}"


def start_isolated_sink(stream: DataFrame, layout: JobLayout, checkpoint: str, check: Callable[[DataFrame, str], None] | None = None,
                        interval_seconds: int | None = None, available_now: bool = False, state_partitions: int | None = None, key_fn: str = "xxh64"):
    """``start_post_sink`` whose tabs fail alone. ``check(rows, tab)`` may refuse a tab's rows by raising. The tabs that pass are saved together;
    should that fail, each by itself. Rows of tabs that fail go to the dead-letter table under the name of their save."""
    def each(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        sid = f"posts-{_stream_id(spark, checkpoint)}-{batch_id}"
        path = scratch_path(spark, f"stream-batch-{uuid.uuid4().hex}")
        batch.write.parquet(path)
        try:
            held = spark.read.schema(batch.schema).parquet(path)
            good, bad = [], {}
            for (tab,) in sorted(held.select("tab").distinct().collect()):  # tabs are configuration: a name for each
                try:
                    if check is not None:
                        check(held.filter(F.col("tab") == tab), tab)
                    good.append(tab)
                except Exception as e:  # noqa: BLE001 - whatever a check raises concerns its tab only
                    bad[tab] = f"{type(e).__name__}: {e}"
            try:
                if good:
                    save_posts(held.filter(F.col("tab").isin(good)), layout, incremental=True, save_id=sid, key_fn=key_fn)
            except Exception:  # noqa: BLE001 - which tab it was shows when each is saved by itself
                for tab in good:
                    try:
                        save_posts(held.filter(F.col("tab") == tab), layout, incremental=True, save_id=_save_id(sid, tab), key_fn=key_fn)
                    except Exception as e:  # noqa: BLE001
                        bad[tab] = f"{type(e).__name__}: {e}"
            for tab, reason in bad.items():  # a replay writes the same folder again
                rows = held.filter(F.col("tab") == tab).withColumn("reason", F.lit(reason))
                rows.write.mode("overwrite").parquet(f"{dead_letters(layout)}/save_id={_save_id(sid, tab)}")
        finally:
            remove_path(spark, path)
    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return _start(_trigger(w, interval_seconds, available_now), stream.sparkSession, state_partitions)


def redrive(spark: SparkSession, layout: JobLayout, check: Callable[[DataFrame, str], None] | None = None, key_fn: str = "xxh64") -> dict[str, str | None]:
    """Save what the dead-letter table holds: {save name: None, or the reason it failed again}. A save that has succeeded is named in the
    audit, so neither a second run nor a replayed batch stores it twice; its letters are removed."""
    dead = read_stored(spark, dead_letters(layout))
    out: dict[str, str | None] = {}
    if dead is None:
        return out
    for sid, tab in sorted(map(tuple, dead.select("save_id", "tab").distinct().collect())):
        rows = dead.filter((F.col("save_id") == sid)).drop("save_id", "reason")
        try:
            if check is not None:
                check(rows, tab)
            if not already_saved(spark, layout, sid):
                save_posts(rows, layout, incremental=True, save_id=sid, key_fn=key_fn)
            out[sid] = None
            remove_path(spark, f"{dead_letters(layout)}/save_id={sid}")
        except Exception as e:  # noqa: BLE001 - the letter stays
            out[sid] = f"{type(e).__name__}: {e}"
    return out
