"""Helpers shared by the training-data operators: table reads, folds, scratch
tables in the shared checkpoint folder, and distributed connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Rows of labels whose crc32(id) mod FOLDS is 0 are never learned from.
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col="doc_id") -> F.Column:
    """True where crc32 of the id, as text, is 0 modulo ``FOLDS`` (NULL id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it
    back: later stages start from files that survive a lost executor."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sample_ids(rows: DataFrame, n: int, id_col="doc_id") -> DataFrame:
    """At most ``n`` distinct ids, in the order of a hash of the id: the same
    rows at every partitioning. Only ids move; ``n`` bounds the result."""
    ids = rows.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    return ids.orderBy(F.xxhash64(id_col), id_col).limit(n)


#: Parts that a long text of a sample is cut to, evenly spread from its start to its end.
PARTS = 8


def texts_of(docs: DataFrame, ids: DataFrame, rows: int, total_chars: int, id_col="doc_id",
             text_col="text") -> list[tuple]:
    """Collect (columns of ``ids`` ..., text), one row for each id: at most ``rows`` of them and ``total_chars``
    characters. A text with more than its even share of these is cut to PARTS parts of it before anything moves, so
    every text counts and none is left out. ``ids`` is that bounded sample: it is broadcast."""
    share = max(PARTS, total_chars // max(1, rows))
    step = share // PARTS
    n = F.length(text_col)
    parts = [F.substring(F.col(text_col), (F.floor((n - step) * i / (PARTS - 1)) + 1).cast("int"), F.lit(step)) for i in range(PARTS)]
    t = docs.select(id_col, F.when(n <= share, F.col(text_col)).otherwise(F.concat_ws("\n", *parts)).alias("_text")).where(F.col(text_col).isNotNull())
    j = t.join(F.broadcast(ids), id_col).groupBy(*ids.columns).agg(F.min("_text").alias("_text"))
    return sorted(tuple(r) for r in j.collect())


#: Rows of an Arrow batch. Texts may be long, so a batch has far fewer rows than Spark's default.
BATCH_ROWS = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of at most BATCH_ROWS rows, which bounds what the JVM and a
    Python worker hold at a time. It is a setting of the session (Spark has none for a
    query); one that the session has made smaller stays."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_KEY, "10000")) <= BATCH_ROWS:
        conf.set(_BATCH_KEY, str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, NULL as the empty string."""
    return [x or "" for x in column.to_pylist()]


def each_text(batches: Iterator[pa.RecordBatch], fn, names: list[str], types: list) -> Iterator[pa.RecordBatch]:
    """Apply ``fn(text) -> tuple`` to the second column of each batch, keeping
    the first column, and return the tuples as the columns ``names``."""
    for b in batches:
        out = [fn(t) for t in strings(b.column(1))]
        cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
            [b.schema.names[0], *names])


def components(edges: DataFrame, a="a", b="b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list by alternating large-star and
    small-star steps (Kiveris et al. 2014).

    Returns ``(node, root)`` for every node that has an edge to another node;
    ``root`` is the smallest node of its component. Each round is a grouped
    minimum and an equi-join; it is written to the shared checkpoint folder
    before the next, and nothing but its row count reaches the driver.
    Self-loops, repeated and NULL-ended edges add nothing; an empty edge list gives an
    empty result."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")) \
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = stored(e, "edges")
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        # large star: connect every larger neighbour of u to the least of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "large")
        # small star: connect u and its smaller neighbours to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small = stored(small, "small")
        # done when every node has one parent and no parent has a parent
        s = small.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        again = s.where("n > 1").limit(1).count() or \
            small.join(small.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        e = small
        if not again:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
