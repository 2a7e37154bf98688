"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

The words of a source, its documents in a shuffled order, are one ring that is cut into blocks of
``BLOCK`` words. Slot ``n`` of the schedule is the golden-ratio point of ``n``; mapped through the
cumulative shares it names a source, its rank among the source's slots names the block. A source
that has had its target gets no more slots; those it lacks, as a sequence is only nearly even, come at the end.

Awkward inputs: a NULL text has no words, a NULL source is a source (the last), rows that repeat an id
are documents of their own, an empty table gives an empty mix. Other columns are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, and so of a slot; the last block of a source's target may be shorter.
BLOCK = 1024
#: Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
#: A target is at most so many times the words of its source.
MAX_REPEAT = 3
#: Points are whole numbers below 2^31; the odd step is 2^31 over the golden ratio, so 2^31 slots in a row have different points.
GRID_BITS = 31
STEP = 1327217885
#: Slots are ranked in chunks of 2^CHUNK_BITS, so no task ranks a whole source.
CHUNK_BITS = 14
#: The table of sources is sent to every task up to this many, and shuffled beyond.
BROADCAST_SOURCES = 100_000


def sized(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """(rid, pid, doc_id, source, size): a row for each document, ordered by ``rid`` by source and, within it, shuffled
    by the MD5 of the id. Ranges of that order are dealt over tasks; equal rows may be parted too."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       F.monotonically_increasing_id().alias("salt"))
    order = ["source", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "doc_id", "size", "salt"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "source", "size", F.monotonically_increasing_id().alias("rid"))
    return stored(rows.withColumn("pid", F.shiftright("rid", 33)), "mix-rows")


def targets(rows: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(sid, source, weight, source_size, target) of each source. All words are shared by weight; a target stops at
    ``max_repeat`` times its source, and the excess goes to the others by weight until none is above.

    In the order of size over weight the stopped sources come first: one pass over the running sums finds the
    level of the others. The one task that does it reads a row for each source."""
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long")).withColumn("weight", w.cast("long"))
    big = "decimal(38,0)"
    order = W.orderBy((F.col("source_size") / F.col("weight")).asc(), "sid")
    s = s.withColumn("cap", (F.col("source_size") * max_repeat).cast(big)).withColumn("rn", F.row_number().over(order))
    s = s.withColumn("before", F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)).cast(big))
    s = s.withColumn("rest", F.sum("source_size").over(W.partitionBy()).cast(big) - F.coalesce("before", F.lit(0).cast(big)))
    s = s.withColumn("open", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("free", F.col("cap") * F.col("open") > F.col("rest") * F.col("weight"))
    first = F.min(F.when(F.col("free"), F.struct("rn", "rest", "open"))).over(W.partitionBy())
    s = s.withColumn("first", first)
    level = (F.col("first.rest") * F.col("weight")).cast("double") / F.col("first.open").cast("double")
    target = F.when(F.col("rn") >= F.col("first.rn"), level).otherwise(F.col("cap").cast("double"))
    return s.select("sid", "source", "weight", "source_size", target.alias("target"))


def quotas(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """``sources`` with quota (the target in whole words), need (slots for it), and lo and hi (its share of the points)."""
    s = sources.withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
    s = s.withColumn("need", F.ceil(F.col("quota") / F.lit(float(block))).cast("long"))
    total = F.greatest(F.sum("need").over(W.partitionBy()), F.lit(1))
    upto = F.sum("need").over(W.orderBy("sid"))

    def point(n):
        return F.floor(n.cast("decimal(20,0)") * F.lit(2 ** GRID_BITS).cast("decimal(11,0)") / total.cast("decimal(20,0)")).cast("long")
    return s.withColumn("slots", F.sum("need").over(W.partitionBy())).withColumn("lo", point(upto - F.col("need"))).withColumn("hi", point(upto))


def _few(sources: DataFrame, n: int) -> DataFrame:
    return F.broadcast(sources) if n <= BROADCAST_SOURCES else sources


def schedule(sources: DataFrame) -> DataFrame:
    """(slot, sid, rank): the slots of the mix in order, each with its source and its number among the source's
    slots. ``sources`` as ``quotas`` returns them, written or cached."""
    spark = sources.sparkSession
    n, slots = sources.agg(F.count("*"), F.coalesce(F.max("slots"), F.lit(0))).first()
    # points are matched by cell, so a slot meets the few sources of its cell only
    bits = min(GRID_BITS, max(10, (2 * n).bit_length()))
    shift = GRID_BITS - bits
    cells = sources.where("hi > lo").select("sid", "lo", "hi", "need", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))).alias("cell"))
    point = F.pmod((F.pmod("slot", F.lit(2 ** GRID_BITS)) + 1) * F.lit(STEP), F.lit(2 ** GRID_BITS))
    at = spark.range(slots).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("cell", F.shiftright("point", shift))
    hit = at.join(_few(cells, n), "cell").where("point >= lo AND point < hi").select("slot", "sid", "need", F.shiftright("slot", CHUNK_BITS).alias("chunk"))
    hit = stored(hit, "mix-slots")
    counts = hit.groupBy("sid", "chunk").agg(F.count("*").alias("m"))
    before = counts.withColumn("before", F.sum("m").over(W.partitionBy("sid").orderBy("chunk")) - F.col("m")).select("sid", "chunk", "before")
    rank = F.col("before") + F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = hit.join(before, ["sid", "chunk"]).withColumn("rank", rank).where("rank < need").select("slot", "sid", "rank")
    had = counts.groupBy("sid").agg(F.sum("m").alias("had"))
    late = sources.join(had, "sid", "left").withColumn("had", F.coalesce("had", F.lit(0).cast("long"))).where("had < need")
    late = late.select("sid", F.explode(F.sequence(F.col("had"), F.col("need") - 1)).alias("rank"))
    # few rows: a sequence of points lacks some log(slots) slots of a source
    late = late.select((F.lit(slots) + F.row_number().over(W.orderBy("rank", "sid")) - 1).cast("long").alias("slot"), "sid", "rank")
    return ranked.unionByName(late)


def mix(rows: DataFrame, sources: DataFrame, block: int = BLOCK, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(slot, sid, rank, rid, doc_id, epoch, from_word, to_word): the mix in order of (slot, from the ring's start on),
    each piece of a document with its words, from the first inclusive to the last exclusive. ``epoch`` counts the rounds of its source."""
    n = sources.count()
    few = _few(sources.select("sid", F.col("source").alias("of"), "source_size", "quota"), n)
    own = rows.join(few, F.col("source").eqNullSafe(F.col("of"))).select("rid", "pid", "doc_id", "size", "sid", "source_size", "quota")
    parts = own.groupBy("sid", "pid").agg(F.sum("size").alias("m"))
    before = parts.withColumn("before", F.sum("m").over(W.partitionBy("sid").orderBy("pid")) - F.col("m")).select("sid", "pid", "before")
    run = F.sum("size").over(W.partitionBy("sid", "pid").orderBy("rid")) - F.col("size")
    own = own.where("size > 0").withColumn("run", run).join(before, ["sid", "pid"]).withColumn("start", F.col("before") + F.col("run"))
    e = own.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1)))).withColumn("a", F.col("start") + F.col("epoch") * F.col("source_size"))
    e = e.withColumn("z", F.least(F.col("a") + F.col("size"), F.col("quota"))).where("a < z")
    b = e.withColumn("rank", F.explode(F.sequence(F.expr(f"a div {block}"), F.expr(f"(z - 1) div {block}"))))
    pieces = b.select("sid", "rank", "rid", "doc_id", "epoch", (F.greatest("a", F.col("rank") * block) - F.col("a")).alias("from_word"),
                      (F.least("z", (F.col("rank") + 1) * block) - F.col("a")).alias("to_word"))
    return schedule(sources).join(pieces, ["sid", "rank"]).select("slot", "sid", "rank", "rid", "doc_id", "epoch", "from_word", "to_word")


def taken(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", block: int = BLOCK, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs``: ``taken`` are its words in the mix, repeats counted."""
    rows = sized(docs, id_col, text_col, source_col)
    sources = stored(quotas(targets(rows, weights, max_repeat), block), "mix-sources")
    got = mix(rows, sources, block, max_repeat).groupBy("rid").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    few = _few(sources.select(F.col("source").alias("of"), "source_size", "target"), sources.count())
    all_ = rows.join(few, F.col("source").eqNullSafe(F.col("of"))).select("rid", F.col("doc_id").alias(id_col), "size", "source_size", "target")
    return all_.join(got, "rid", "left").select(id_col, "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def oracle() -> str:
    """The same result without a schedule: the words of a document that lie in its source's quota."""
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, row_number() OVER () AS salt FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s0),
t AS (SELECT sum(source_size)::HUGEINT AS total FROM s1),
-- a source is stopped when its cap is at most its share at the level where all sources of a smaller ratio are stopped
s2 AS (SELECT a.*, (SELECT coalesce(sum(3 * b.source_size), 0) FROM s1 b WHERE (b.source_size * 6 // b.w, b.sid) < (a.source_size * 6 // a.w, a.sid)) AS capped,
              (SELECT sum(b.w) FROM s1 b WHERE (b.source_size * 6 // b.w, b.sid) >= (a.source_size * 6 // a.w, a.sid)) AS open_w FROM s1 a),
s3 AS (SELECT *, 3 * source_size * open_w > (total - capped) * w AS free, total - capped AS rest FROM s2, t),
lv AS (SELECT rest, open_w, source_size * 6 // w AS r, sid AS fsid FROM s3 WHERE free ORDER BY source_size * 6 // w, sid LIMIT 1),
s4 AS (SELECT s3.*, CASE WHEN lv.r IS NOT NULL AND (source_size * 6 // w, sid) >= (lv.r, lv.fsid) THEN (lv.rest * w)::DOUBLE / lv.open_w::DOUBLE
                    ELSE (3 * source_size)::DOUBLE END AS target FROM s3 LEFT JOIN lv ON true),
s5 AS (SELECT *, floor(target + 0.5)::BIGINT AS quota FROM s4),
p AS (SELECT d.*, source_size, target, quota,
        sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size, salt) - size AS a
      FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(a + size, quota) - least(a, quota)) + greatest(0, least(a + source_size + size, quota) - least(a + source_size, quota))
        + greatest(0, least(a + 2 * source_size + size, quota) - least(a + 2 * source_size, quota)))::BIGINT AS taken
FROM p"""
