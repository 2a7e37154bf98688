"""Hard-negative mining with a GNAT-style multiway hyperplane tree.

A node has up to ``FANOUT`` split points (rows of a bounded sample); a row goes to its nearest one, down to a leaf. For every
split point the node keeps the range of its distances to the rows below each sibling, and of those rows' norms. The ranges come from
all rows. A query's window of scores is an annulus around it, as distance^2 = |a|^2 + |x|^2 - 2 a.x;
siblings whose range cannot meet it are left out. What remains are leaves, whose rows are scored exactly, so results are exact.

Rows and queries meet in blocks: leaves are split into chunks, queries into blocks, by counts. Nothing but the tree (of the
sample's size) and counts reaches the driver.

Awkward inputs: rows with a NULL label, vector or id, or a NULL or non-finite component take no part; of equal rows (id, label
and vector) one counts; different rows of one id are rows of their own, ordered by label and a hash of the vector after the id; vectors of several lengths are
filled up with zeros; scores beyond 64 bits are cut to the range of a long; other columns are not read; an empty table gives none."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, stored

#: Sample rows that the tree is made of at most, and their components in all.
SAMPLE = 4096
SAMPLE_COMPONENTS = 1 << 21
FANOUT = 8
#: Sample rows of a leaf.
LEAF_SAMPLE = 48
#: Rows of a chunk of a leaf and queries of a block, on average; bigger leaves have more chunks.
CHUNK = 8192
QUERIES = 4096
#: Queries that are scored against a chunk at a time.
STEP = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is from LOW to HIGH hundredths of the positive's.
LOW, HIGH = 30, 90
#: Distances are compared with this share of room for rounding.
ROOM = 1e-9
KEY = ["vec_id", "label", "digest"]


def rows_of(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, digest, embedding, salt) of the rows that take part, labels changed where vec_id is divisible by 7."""
    ok = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    e = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(ok)
    return e.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.xxhash64("embedding").alias("digest"), "embedding",
                    F.monotonically_increasing_id().alias("salt"))


def matrix(column) -> np.ndarray:
    """floor(256 x) of the vectors of an Arrow list column as doubles, short ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    n = np.diff(column.offsets.to_numpy())
    values = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    d = int(n.max(initial=0))
    if (n == d).all():
        return values.reshape(len(n), d)
    out = np.zeros((len(n), d))
    out[np.arange(d) < n[:, None]] = values
    return out


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``x`` as int64."""
    d = min(a.shape[1], x.shape[1])
    a, x = a[:, :d], x[:, :d]
    if np.abs(a).max(initial=0) * np.abs(x).max(initial=0) * max(d, 1) < 2.0 ** 53:
        return (a @ x.T).astype(np.int64)
    whole = [[int(v) for v in r] for r in a], [[int(v) for v in r] for r in x]
    top = 2 ** 63 - 1
    return np.array([[max(-top - 1, min(top, sum(p * q for p, q in zip(r, s, strict=True)))) for s in whole[1]] for r in whole[0]], np.int64).reshape(len(a), len(x))


def distances(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    d = max(a.shape[1], x.shape[1])
    a, x = (np.pad(m, ((0, 0), (0, d - m.shape[1]))) for m in (a, x))
    with np.errstate(all="ignore"):
        sq = (a * a).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (a @ x.T)
    return np.sqrt(np.maximum(np.nan_to_num(sq, nan=np.inf), 0))


class Tree:
    """Nodes of split points. A child is a node (its number) or a leaf (~number)."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.points, self.ids = points, ids  # (n, d), and KEY as (n, 3)
        self.splits: list[list[int]] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.ranges: dict[tuple[int, int, int], tuple] = {}  # (node, split, child): lo, hi of distances
        self.norms: dict[tuple[int, int], tuple] = {}
        if len(points):
            self._node(np.arange(len(points)))

    def _node(self, own) -> int:
        far = distances(self.points[own], self.points[own[:1]])[:, 0]
        split = [0]
        while len(split) < FANOUT and far.max() > 0:  # the next split point is the farthest from those before
            split.append(int(far.argmax()))
            far = np.minimum(far, distances(self.points[own], self.points[own[split[-1:]]])[:, 0])
        if len(own) <= LEAF_SAMPLE and self.splits or len(split) < 2:
            if not self.splits:  # one leaf only: a root with one child
                self.splits.append([int(own[0])])
                self.children.append([self._leaf()])
                return 0
            return self._leaf()
        me = len(self.splits)
        self.splits.append([int(own[s]) for s in split])
        self.children.append([])
        near = distances(self.points[own], self.points[self.splits[me]]).argmin(1)
        for j in range(len(split)):
            self.children[me].append(self._node(own[near == j]))
        return me

    def _leaf(self) -> int:
        self.leaves += 1
        return ~(self.leaves - 1)

    def walk(self, x: np.ndarray):
        """(node, distances to its split points, child of each row, numbers of the rows) of each node that rows of ``x`` pass."""
        todo = [(0, np.arange(len(x)))] if self.splits else []
        while todo:
            node, at = todo.pop()
            d = distances(x[at], self.points[self.splits[node]])
            child = d.argmin(1)
            yield node, d, child, at
            for j, c in enumerate(self.children[node]):
                if c >= 0 and (child == j).any():
                    todo.append((c, at[child == j]))

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        for node, _, child, at in self.walk(x):
            c = np.array(self.children[node])[child]
            out[at[c < 0]] = ~c[c < 0]
        return out

    def survivors(self, a: np.ndarray, windows: list[tuple[float, float]]) -> list[int]:
        """Leaves that may hold a row whose score with ``a`` lies in one of the windows (from, to)."""
        norm, out = float(np.sqrt((a * a).sum())), []
        todo = [(0, list(windows))] if self.splits and windows else []
        while todo:
            node, ws = todo.pop()
            d = distances(a[None, :], self.points[self.splits[node]])[0]
            for j, c in enumerate(self.children[node]):
                if (node, j) not in self.norms:
                    continue  # no row went there
                nlo, nhi = self.norms[node, j]
                lo, hi = 0.0, np.inf
                for i in range(len(d)):
                    rlo, rhi = self.ranges[node, i, j]
                    if np.isfinite(d[i]) and np.isfinite(rhi):
                        lo, hi = max(lo, d[i] - rhi, rlo - d[i]), min(hi, d[i] + rhi)
                left = [w for w in ws if _meets(norm, nlo, nhi, lo, hi, *w)]
                if left and c < 0:
                    out.append(~c)
                elif left:
                    todo.append((c, left))
        return out


def _meets(norm, nlo, nhi, lo, hi, first, last) -> bool:
    """Whether a row of norm [nlo, nhi] at a distance of [lo, hi] can have a score of [first, last]."""
    with np.errstate(all="ignore"):
        room = ROOM * (norm * norm + nhi * nhi + 1)
        if first > norm * nhi + room or last < -norm * nhi - room:
            return False
        far = norm * norm + nhi * nhi - 2 * first  # squares of the annulus around the query
        near = norm * norm + nlo * nlo - 2 * last
        return not (lo * lo > far + room or hi * hi < near - room)


def grown(rows: DataFrame) -> tuple[Tree, DataFrame, dict]:
    """The tree, the rows (written) with their ``leaf``, and the rows of each leaf."""
    dim = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    n = max(FANOUT, min(SAMPLE, SAMPLE_COMPONENTS // max(dim, 1)))
    got = rows.orderBy(F.xxhash64("vec_id", "digest"), *KEY).limit(n).select(*KEY, "embedding").toArrow()
    ids = np.stack([got.column(c).to_numpy().astype(np.int64) for c in KEY], 1) if got.num_rows else np.zeros((0, 3), np.int64)
    _, once = np.unique(ids, axis=0, return_index=True)
    once.sort()
    tree = Tree(matrix(got.column("embedding"))[once], ids[once])

    def assign(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tree.assign(matrix(b.column("embedding"))), pa.int32()), *b.columns], ["leaf", *b.schema.names])
    own = stored(map_arrow(rows, assign, "leaf int, vec_id bigint, label bigint, digest bigint, embedding " + rows.schema["embedding"].dataType.simpleString() + ", salt bigint"), "gnat-rows")

    def measure(batches):
        for b in batches:
            x, out = matrix(b.column("embedding")), []
            norms = np.sqrt((x * x).sum(1))
            for node, d, child, at in tree.walk(x):
                for j in np.unique(child):
                    m, k = child == j, norms[at[child == j]]
                    out += [(node, i, int(j), float(d[m, i].min()), float(d[m, i].max()), float(k.min()), float(k.max())) for i in range(d.shape[1])]
            cols = list(zip(*out, strict=True)) or [[]] * 7
            types = [pa.int32()] * 3 + [pa.float64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["node", "i", "j", "lo", "hi", "nlo", "nhi"])
    part = map_arrow(own.select("embedding"), measure, "node int, i int, j int, lo double, hi double, nlo double, nhi double")
    # as many rows as the tree has pairs of siblings
    for r in part.groupBy("node", "i", "j").agg(F.min("lo"), F.max("hi"), F.min("nlo"), F.max("nhi")).collect():
        tree.ranges[r[0], r[1], r[2]] = (r[3], r[4])
        tree.norms[r[0], r[2]] = (r[5], r[6])
    return tree, own, {r[0]: r[1] for r in own.groupBy("leaf").count().collect()}


def first_of(score, ids, k: int) -> np.ndarray:
    """Numbers of the first ``k``: higher scores first, then by ``ids`` (columns KEY)."""
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at, 2], ids[at, 1], ids[at, 0], -score[at]))[:k]]


def _bound(s: np.ndarray, k: int) -> int | None:
    """The k-th best of the scores, if there are so many: rows below it don't count."""
    return int(np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else None


def search(tree: Tree, own: DataFrame, counts: dict, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """(ak, w, rank, score, vec_id, label, digest): for each window of each query the first ``k`` rows of its label (``same``, itself
    left out) or of others. ``queries``: (ak, vec_id, label, digest, embedding, lo, hi), lo and hi arrays of equal length."""
    blocks = max(1, -(-queries.count() // QUERIES))

    def plan(batches):
        for b in batches:
            a, rows = matrix(b.column("embedding")), b.drop_columns(["embedding"]).to_pylist()
            s, out, at = scores(a, tree.points), [], []
            for q, r in enumerate(rows):
                fits = tree.ids[:, 1] == r["label"]
                fits = fits & (tree.ids != [r[c] for c in KEY]).any(1) if same else ~fits
                own_s, windows = s[q][fits], []
                for lo, hi in zip(r["lo"], r["hi"], strict=True):
                    if lo <= hi:
                        least = _bound(own_s[(own_s >= lo) & (own_s <= hi)], k)
                        windows.append((float(lo if least is None else max(lo, least)), float(hi)))
                found = tree.survivors(a[q], windows)
                at += [q] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32()), *b.take(pa.array(at, pa.int64())).columns], ["leaf", *b.schema.names])
    names = ["ak", *KEY, "embedding", "lo", "hi"]
    kind = own.schema["embedding"].dataType.simpleString()
    pairs = map_arrow(queries.select(*names), plan, f"leaf int, ak bigint, vec_id bigint, label bigint, digest bigint, embedding {kind}, lo array<bigint>, hi array<bigint>")
    chunks = F.coalesce(F.element_at(F.create_map(*[F.lit(int(v)) for x in counts.items() for v in (x[0], -(-x[1] // CHUNK))]), F.col("leaf")), F.lit(1)) if counts else F.lit(1)
    left = pairs.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).withColumn("block", F.pmod(F.xxhash64("ak"), F.lit(blocks)).cast("int"))
    right = own.withColumn("chunk", F.pmod("salt", chunks).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).drop("salt")

    def score_chunk(q: pa.Table, x: pa.Table) -> pa.Table:
        out = []
        if q.num_rows and x.num_rows:
            ids = np.stack([x.column(c).to_numpy() for c in KEY], 1)
            ids, once = np.unique(ids, axis=0, return_index=True)
            rows = matrix(x.column("embedding"))[once]
            for start in range(0, q.num_rows, STEP):
                part = q.slice(start, STEP)
                s = scores(matrix(part.column("embedding")), rows)
                for n, r in enumerate(part.drop_columns(["embedding"]).to_pylist()):
                    fits = ids[:, 1] == r["label"]
                    fits = fits & (ids != [r[c] for c in KEY]).any(1) if same else ~fits
                    for w, (lo, hi) in enumerate(zip(r["lo"], r["hi"], strict=True)):
                        at = np.flatnonzero(fits & (s[n] >= lo) & (s[n] <= hi))
                        at = at[first_of(s[n][at], ids[at], k)]
                        out += [(r["ak"], w, int(s[n][i]), *map(int, ids[i])) for i in at]
        cols = list(zip(*out, strict=True)) or [[]] * 6
        types = [pa.int64(), pa.int32()] + [pa.int64()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["ak", "w", "score", *KEY])
    keys = ["leaf", "chunk", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score_chunk, "ak bigint, w int, score bigint, vec_id bigint, label bigint, digest bigint")
    # equal rows of several chunks have one rank; what of a query leaves a task is cut to k before the shuffle
    rank = F.dense_rank().over(W.partitionBy("ak", "w").orderBy(F.desc("score"), *KEY))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).distinct()


def mine(embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (vec_id divisible by 100) and each
    of its first ``positives`` other rows of its label the first ``negatives`` rows of other labels whose
    score is from LOW to HIGH hundredths of the positive's. Higher scores come first, then smaller ids."""
    tree, own, counts = grown(rows_of(embeddings))
    anchors = own.where("vec_id % 100 = 0").dropDuplicates(KEY).select(*KEY, "embedding")
    anchors = stored(anchors.withColumn("ak", F.monotonically_increasing_id()), "anchors")
    least, top = F.lit(-2 ** 63), F.lit(2 ** 63 - 1)
    pos = stored(search(tree, own, counts, anchors.withColumns({"lo": F.array(least), "hi": F.array(top)}), positives, True), "positives")
    # the window in whole scores; scores times 100 need more than 64 bits. A negative positive has none
    s = F.col("score").cast("decimal(38,0)")
    lo, hi = F.ceil(s * LOW / 100).cast("long"), F.floor(s * HIGH / 100).cast("long")
    listed = pos.groupBy("ak").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), lo.alias("lo"), hi.alias("hi")))).alias("p"))
    asked = stored(anchors.join(listed, "ak").withColumns({"lo": F.col("p.lo"), "hi": F.col("p.hi")}), "asked")
    neg = search(tree, own, counts, asked, negatives, False)
    out = neg.select("ak", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(
        asked.select("ak", F.col("vec_id").alias("anchor_id"), "p"), "ak")
    return out.select("anchor_id", F.get("p", "w")["positive_id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id",
                      F.get("p", "w")["positive_score"].alias("positive_score"), "negative_score")


def oracle() -> str:
    """The same by comparing every anchor with every row."""
    dot = "list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1] * z[2], 0)))::BIGINT"
    return f"""
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (SELECT a.vec_id AS anchor_id, a.label AS al, b.vec_id AS id, b.label AS bl, {dot} AS score
      FROM r a JOIN r b ON a.vec_id % 100 = 0 AND (a.vec_id <> b.vec_id OR a.label <> b.label OR a.embedding <> b.embedding)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE al = bl
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE al <> bl AND {LOW}::HUGEINT * positive_score <= 100::HUGEINT * score AND 100::HUGEINT * score <= {HIGH}::HUGEINT * positive_score
QUALIFY rank <= {NEGATIVES}"""
