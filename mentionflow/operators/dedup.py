"""Key-based row selection: first-wins / last-wins de-dup, per-tab caps,
anti/semi joins against stored rows.

All of them avoid putting a whole key group into one task: de-dup is a
hash/sort aggregate with a map-side partial step (a hot key is reduced to one
row per input partition before the shuffle), caps use ``row_number() <= n``
which Catalyst plans as a partial ``WindowGroupLimit`` before the exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import remove_staged, staged


def first_wins(df: DataFrame, key="id", order=("tab_rank", "ingest_seq"), row_id=None) -> DataFrame:
    """One row per key: the smallest ``order`` tuple wins.

    The winners are found on narrow rows (key and position), and the rows that
    lost are taken out by an anti-join on ``row_id`` (default: the position), so
    text is never an aggregation buffer. ``row_id`` must name a row; rows with a
    NULL key are no copies of each other and stay."""
    keys = [key] if isinstance(key, str) else list(key)
    row_id = list(row_id or order)
    narrow = df.select(*dict.fromkeys([*keys, *order, *row_id])).withColumn("_pos", _position(list(order)))
    best = narrow.groupBy(*keys).agg(F.min("_pos").alias("_first"))
    lost = narrow.join(best, keys).filter(F.col("_pos") > F.col("_first")).select(*row_id)
    return df.join(lost, row_id, "left_anti").select(*df.columns)


def first_rows(df: DataFrame, key="id", order=("tab_rank", "ingest_seq")) -> DataFrame:
    """One row per key that is never NULL: the smallest ``order`` tuple wins.

    ``df`` is read once, with all its columns: ``row_number() = 1`` is planned as a ``WindowGroupLimit`` before
    the shuffle, which leaves a key one row for each task, and one after it. The rows come out partitioned by
    the key. For wide rows that are dear to make; ``first_wins`` reads cheap rows (files) twice, but never sorts the wide ones."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc() for c in order])
    return df.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")


def _position(order: list[str]) -> F.Column:
    """One comparable value of an order; (tab_rank, ingest_seq) as a decimal,
    a buffer of fixed size that keeps the minimum a hash aggregate."""
    return capture_position(*order) if order == ["tab_rank", "ingest_seq"] else F.struct(*order)


def capture_position(tab_rank="tab_rank", ingest_seq="ingest_seq") -> F.Column:
    """(tab rank, capture order) packed into one DECIMAL(30,0) with the same
    ordering: (rank + 2^31)·10^20 + (seq + 2^63). A decimal aggregation
    buffer is fixed-size, so ``min`` of it runs as a hash aggregate instead
    of the sort aggregate a struct buffer forces."""
    r = F.col(tab_rank).cast("decimal(30,0)") + F.lit(2 ** 31).cast("decimal(30,0)")
    q = F.col(ingest_seq).cast("decimal(30,0)") + F.lit(str(2 ** 63)).cast("decimal(30,0)")
    return (r * F.lit(str(10 ** 20)).cast("decimal(30,0)") + q).cast("decimal(30,0)")


def last_wins(df: DataFrame, key="post_id", order=("ingest_seq",)) -> DataFrame:
    """One row per key: the largest ``order`` tuple wins (later saves replace)."""
    keys, order = ([key] if isinstance(key, str) else list(key)), list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    out = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_w"))
    return out.select(*keys, *[F.col(f"_w.{c}").alias(c) for c in order + rest]).select(*df.columns)


def tab_cap(df: DataFrame, max_per_tab: int, tab="tab", order=("ingest_seq",),
            rank_col: str | None = None) -> DataFrame:
    """At most ``max_per_tab`` rows per tab in capture order."""
    w = Window.partitionBy(tab).orderBy(*[F.col(c).asc() for c in order])
    rn = rank_col or "_rn"
    out = df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= max_per_tab)
    return out if rank_col else out.drop(rn)


#: Tabs and chosen rows that are sent to every task at most (some 50 bytes each); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000


def _few(df: DataFrame, n: int | None = None) -> DataFrame:
    n = df.limit(BROADCAST_ROWS + 1).count() if n is None else n
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def capped_capture(df: DataFrame, max_per_tab: int, stored: DataFrame | None = None) -> DataFrame:
    """W1 + W2 as the capture loop has them: the tabs in order (rank, then name), each takes
    its first ``max_per_tab`` posts that no tab before it took. A post beyond the
    cap isn't seen yet: a later tab may take its copy. ``stored`` (id, tab):
    posts taken by earlier runs; they are seen, and count in their tab.

    Deferred acceptance finds what the loop finds, for all tabs at once. Each id offers itself to the first tab that does
    not refuse it; a tab with more offers than room keeps the first in capture order, and refuses what lies
    behind its last one from then on. That limit only moves forward, so the rounds end when none moves; the first
    ``r`` tabs are right after ``r`` rounds at the latest, and most after a few. A round reads narrow offers (id, tab, position)
    and the limits, a row for each tab; only the number of moved limits reaches the driver."""
    spark = df.sparkSession
    tabs = df.select("tab", "tab_rank").distinct()
    numbered = tabs.withColumn("tab_no", F.row_number().over(Window.orderBy("tab_rank", "tab")))  # a row for each tab
    room = F.lit(max_per_tab).cast("long")
    if stored is not None:
        have = stored.groupBy(F.col("tab").alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
        numbered = numbered.join(have, F.col("tab").eqNullSafe(F.col("_t")), "left").drop("_t")
        room = F.greatest(room - F.coalesce("_n", F.lit(0).cast("long")), F.lit(0).cast("long"))
    made = [staged(numbered.select("tab", "tab_rank", "tab_no", room.alias("room")), "capture-tabs")]
    few = _few(made[0])
    one = df.select("id", "tab", "tab_rank", "ingest_seq").join(
        few.select(F.col("tab").alias("_t"), F.col("tab_rank").alias("_r"), "tab_no"),
        F.col("tab").eqNullSafe(F.col("_t")) & F.col("tab_rank").eqNullSafe(F.col("_r")))
    offers = one.groupBy("id", "tab_no").agg(F.min("ingest_seq").alias("seq"))
    if stored is not None:
        offers = offers.join(stored.select("id").distinct(), "id", "left_anti")
    made.append(staged(offers, "capture-offers"))
    offers, limits, moved = made[1], None, 1
    while moved:
        open_ = offers
        if limits is not None:
            open_ = offers.join(_few(limits), "tab_no", "left").where("last IS NULL OR seq < last OR seq = last AND id <= last_id")
        choice = open_.groupBy("id").agg(F.min(capture_position("tab_no", "seq")).alias("p"))
        # the position names the offer: its tab and its place there
        tab_no = (F.floor(F.col("p") / F.lit(str(10 ** 20)).cast("decimal(30,0)")) - F.lit(2 ** 31)).cast("int").alias("tab_no")
        seq = (F.col("p") % F.lit(str(10 ** 20)).cast("decimal(30,0)") - F.lit(str(2 ** 63)).cast("decimal(30,0)")).cast("long").alias("seq")
        held = choice.select("id", tab_no, seq).join(few.select("tab_no", "room"), "tab_no")
        w = Window.partitionBy("tab_no").orderBy("seq", "id")
        # a tab that is full, or has no room, has a limit: its last one kept
        first = held.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max_per_tab)
        full = first.where("n = room").select("tab_no", F.col("seq").alias("last"), F.col("id").alias("last_id"))
        none = few.where("room = 0").select("tab_no", F.lit(-2 ** 63).alias("last"), F.lit("").alias("last_id"))
        now = staged(full.unionByName(none), "capture-limits")
        made.append(now)
        if limits is None:
            moved = now.limit(1).count()
        else:
            before = limits.select("tab_no", F.struct("last", "last_id").alias("_b"))
            moved = now.join(_few(before), "tab_no", "left").where(~F.col("_b").eqNullSafe(F.struct("last", "last_id"))).limit(1).count()
        limits = now
    chosen = staged(first.where("n <= room").select("id", "tab_no", F.col("seq").alias("ingest_seq")).join(
        few.select("tab_no", "tab", "tab_rank"), "tab_no").drop("tab_no"), "capture")
    for t in made:
        remove_staged(t)
    return df.join(_few(chosen), ["id", "tab", "tab_rank", "ingest_seq"], "left_semi")


def dedup_new(new: DataFrame, stored: DataFrame | None, key="content_hash",
              order=("ingest_seq",), row_id=None) -> DataFrame:
    """Rows of ``new`` whose key is unseen: one per key inside the batch
    (first in capture order), none whose key is already stored."""
    first = first_wins(new, key, order, row_id) if order else new.dropDuplicates([key])
    if stored is None:
        return first
    return first.join(stored.select(key).distinct(), on=key, how="left_anti")


def dup_flag(df: DataFrame, seen: DataFrame, key="content_hash", flag="is_duplicate") -> DataFrame:
    """Adds a boolean ``flag``: key present in ``seen`` (semi-join probe)."""
    marks = seen.select(key).distinct().withColumn(flag, F.lit(True))
    return df.join(marks, on=key, how="left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def new_summaries(new: DataFrame, stored: DataFrame | None, keys=("post_id", "tab")) -> DataFrame:
    """Summaries whose post id is not stored yet in their tab (no in-batch de-dup)."""
    if stored is None:
        return new
    return new.join(stored.select(*keys).distinct(), on=list(keys), how="left_anti")
