"""Line dedup by MinHash: character-shingle signatures, banding, exact Jaccard
verification, and a distributed union-find that keeps one line of each component.
DataFrame functions only.

Lines are compared trimmed and in lower case, by their sets of shingles of ``SHINGLE`` characters at every position;
signatures are taken from the same whole sets, whatever the length of a line.

A bucket gives star-shaped candidates: each line with the bucket's first and last line, however many there are. Lines of buckets
of three and more also have finer keys, so two similar lines among many less similar ones meet in a
bucket of few. All candidates are verified on the whole sets; links between them are never taken from signatures."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import remove_staged
from .common import components, stored

SHINGLE = 8
SIMILARITY = 0.8
#: Shingles that are taken from one chunk of a line: a regular expression finds chunks, not each of them.
SPAN = 16
#: Bands of rows: at similarity 0.8 a pair is found with chance 1 - (1 - 0.8^4)^8 = 0.985, at 0.9 with 0.9999.
BANDS = 8
ROWS = 4
#: Finer keys, each of so many values of the signature. Among 350 versions of a line with 1 to 3 of 24 words changed,
#: where most are no more than 0.7 similar, they connect over 99 % of the similar pairs.
FINE = 64
FINE_ROWS = 10
#: Every line that is not blank counts; those shorter than a shingle join equal ones only.
MIN_CHARS = 1
#: Candidates with fewer equal signature values are not compared on the whole sets: at similarity 0.8 a pair has
#: 25.6 of 32 equal on average, and fewer than 18 with a chance of about 1 in 1,000.
MIN_EQUAL = 18
#: Lines and buckets up to this many are broadcast (some 60 bytes each); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _constants(n: int) -> list[int]:
    """Signed 64-bit numbers spread evenly: the top bits, which decide a minimum, all differ."""
    return [((i * 0x9E3779B97F4A7C15 + 0x5851F42D4C957F2D) % 2 ** 64) - 2 ** 63 for i in range(n)]


def lines_of(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, pos, norm, k1, k2) of the lines that are compared; k1 and k2 are 128 bits that name the normal form."""
    # outer explodes: an inner one would have the line split twice, in a filter of its own
    ex = docs.select(F.col(id_col).alias("id"), F.posexplode_outer(F.split(text_col, "\n")).alias("pos", "line"))
    norm = ex.where((F.length(F.trim("line")) >= MIN_CHARS) & F.col("line").rlike(r"[^\s]")).select("id", "pos", F.lower(F.trim("line")).alias("norm"))
    return norm.select("id", "pos", "norm", F.xxhash64("norm").alias("k1"), F.xxhash64(F.lit(1), F.col("norm")).alias("k2"))


def _chunks(c: str) -> F.Column:
    """The line in one pass as chunks of SPAN + SHINGLE - 1 characters, of which neighbours share SHINGLE - 1, so each
    position has its shingle in one of them; the last one may be shorter, and a line shorter than a shingle has none."""
    return F.regexp_extract_all(F.col(c), F.lit(rf"(?s)(?=(.{{{SHINGLE},{SPAN + SHINGLE - 1}}})).{{1,{SPAN}}}"), F.lit(1))


def _pieces_of_chunk(chunk: str) -> list[F.Column]:
    """The bytes of the shingle at each of the SPAN positions of a chunk; a shorter chunk repeats its last one, which changes
    no minimum. Chunks of one byte for each character are cut as bytes."""
    n = F.length(chunk)
    at = [F.least(F.lit(i + 1), n - (SHINGLE - 1)) for i in range(SPAN)]
    size = F.lit(SHINGLE)
    plain = F.octet_length(chunk) == n
    return [F.when(plain, F.substring(F.col(chunk).cast("binary"), p, size)).otherwise(F.substring(chunk, p, size).cast("binary")) for p in at]


def signatures(lines: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(k1, k2, m0 ...) of the distinct lines: for each constant the least of the hashes of the line's shingles, those
    at every position, combined with it. All copies of a line meet in one row, by partial minima before the shuffle.
    The rows of a band come from hashes of their own: one hash combined with several constants depends too much on itself in small sets."""
    chunks = lines.select("k1", "k2", F.explode(_chunks("norm")).alias("chunk"))
    # a projection of its own for each step: Spark evaluates a column that later ones use many times once
    x = chunks.select("k1", "k2", *[p.alias(f"x{i}") for i, p in enumerate(_pieces_of_chunk("chunk"))])
    h = x.select("k1", "k2", *[F.xxhash64(F.lit(r), F.col(f"x{i}")).alias(f"h{r}_{i}") for r in range(rows) for i in range(SPAN)])
    values = [F.least(*[F.col(f"h{m % rows}_{i}").bitwiseXOR(F.lit(_constants(bands)[m // rows])) for i in range(SPAN)]) for m in range(bands * rows)]
    return h.groupBy("k1", "k2").agg(*[F.shiftright(F.min(v), 32).cast("int").alias(f"m{m}") for m, v in enumerate(values)])


def keyed(sigs: DataFrame, groups: list[list[int]], salt: int) -> DataFrame:
    """(k1, k2, bucket): for each group of signature values a key of the line."""
    keys = [F.xxhash64(F.lit(salt + g), *[F.col(f"m{i}") for i in rows]) for g, rows in enumerate(groups)]
    return sigs.select("k1", "k2", F.explode(F.array(*keys)).alias("bucket"))


BAND_ROWS = [list(range(b * ROWS, (b + 1) * ROWS)) for b in range(BANDS)]
_draw = random.Random(1)
#: Fixed draws of FINE_ROWS of the signature's values.
FINE_KEYS = [sorted(_draw.sample(range(BANDS * ROWS), FINE_ROWS)) for _ in range(FINE)]


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def shared(keys: DataFrame) -> DataFrame:
    """(bucket, k1, k2, n, lo, hi) of the lines in buckets of n > 1 lines, written; lo and hi are the least and greatest k1.
    Counts are hash aggregates, and the lines are joined to them: no bucket is gathered."""
    full = stored(keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "line-buckets")
    members = stored(keys.join(_few(full), "bucket"), "line-members")
    ends = members.groupBy("bucket").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi"))
    return members.join(_few(ends), "bucket")


def stars(members: DataFrame) -> DataFrame:
    """(a1, a2, b1, b2), once each, a before b: each line with its bucket's first line, and with its last."""
    ends = members.where("k1 = lo OR n > 2 AND k1 = hi").select("bucket", F.col("k1").alias("e1"), F.col("k2").alias("e2"))
    both = members.select("bucket", "k1", "k2").join(_few(ends), "bucket").where("k1 <> e1 OR k2 <> e2")
    first = F.expr("k1 < e1 OR k1 = e1 AND k2 < e2")
    own, end = [F.col("k1"), F.col("k2")], [F.col("e1"), F.col("e2")]
    cols = [F.when(first, x).otherwise(y) for x, y in zip(own + end, end + own, strict=True)]
    return both.select(*[c.alias(n) for c, n in zip(cols, ("a1", "a2", "b1", "b2"), strict=True)]).distinct()


def _shingles(c: str) -> F.Column:
    """Distinct shingles of a line by 64-bit hashes, cut by position: lines of one byte for each character as bytes, others chunk by chunk."""
    def at_each(x, n):
        return F.transform(F.sequence(F.lit(1), n - (SHINGLE - 1)), lambda p: F.xxhash64(F.substring(x, p, F.lit(SHINGLE))))
    n = F.length(c)
    # the array of one has the bytes made once, not at each position
    plain = F.transform(F.array(F.col(c).cast("binary")), lambda b: at_each(b, n))
    chunked = F.transform(_chunks(c), lambda x: at_each(x, F.length(x)))
    return F.array_distinct(F.flatten(F.when((n == F.octet_length(c)) & (n >= SHINGLE), plain).otherwise(chunked)))


def _both(pairs: DataFrame, of: DataFrame, cols: list[str]) -> DataFrame:
    """``pairs`` with the columns of ``of`` (by k1, k2) for a and for b, prefixed."""
    for x in "ab":
        side = of.select(F.col("k1").alias(f"{x}1"), F.col("k2").alias(f"{x}2"), *[F.col(c).alias(f"{x}_{c}") for c in cols])
        pairs = pairs.join(side, [f"{x}1", f"{x}2"])
    return pairs


def near(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs with MIN_EQUAL equal values of their signatures."""
    values = [f"m{i}" for i in range(BANDS * ROWS)]
    equal = reduce(lambda x, y: x + y, [(F.col(f"a_{c}") == F.col(f"b_{c}")).cast("int") for c in values])
    return _both(pairs, sigs, values).where(equal >= MIN_EQUAL).select("a1", "a2", "b1", "b2")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose shingle sets have that Jaccard similarity at least."""
    j = _both(pairs, texts, ["norm"]).select("a1", "a2", "b1", "b2", _shingles("a_norm").alias("sa"), _shingles("b_norm").alias("sb"))
    j = j.withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return j.where(F.col("both") >= F.lit(similarity) * (F.size("sa") + F.size("sb") - F.col("both"))).select("a1", "a2", "b1", "b2")


def links(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(a, b, a1, a2, b1, b2) verified links between distinct lines, named by their k1 and k2. NULL and empty texts and blank lines
    give none, nor do equal lines (they are one line here), whatever their rows; other columns are not read."""
    made = []

    def held(df, name):
        out = stored(df, name)
        made.append(out)
        return out
    every = held(signatures(lines_of(docs, id_col, text_col)), "line-signatures")
    coarse = held(shared(keyed(every, BAND_ROWS, 0)), "line-coarse")
    wanted = _few(coarse.select("k1", "k2").distinct())
    texts = lines_of(docs, id_col, text_col).join(wanted, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("norm").alias("norm"))
    texts = held(texts, "line-texts")
    crowded = _few(coarse.where("n > 2").select("k1", "k2").distinct())
    fine = held(shared(keyed(every.join(crowded, ["k1", "k2"], "left_semi"), FINE_KEYS, BANDS)), "line-fine")
    sigs = every.join(wanted, ["k1", "k2"], "left_semi")
    pairs = held(near(stars(coarse.unionByName(fine)), sigs), "line-pairs")
    good = stored(verified(pairs, texts).select(_name("a1", "a2").alias("a"), _name("b1", "b2").alias("b"), "a1", "a2", "b1", "b2"), "line-links")
    for df in made:
        remove_staged(df)
    return good


def _name(k1="k1", k2="k2") -> F.Column:
    return F.concat_ws(":", F.hex(k1), F.hex(k2))


def removed(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, removed): sorted positions (from 0) of the lines of each document
    that go, for documents that lose any. Of each component of equal or similar lines,
    the first by id and position stays. Rows of one id are one document, rows without an id take no part; an empty table gives none."""
    own = stored(lines_of(docs, id_col, text_col).select("id", "pos", "k1", "k2").where("id IS NOT NULL"), "lines")
    found = links(docs, id_col, text_col)
    names = found.select(F.col("a").alias("k"), "a1", "a2").union(found.select("b", "b1", "b2")).distinct()
    node, root = (names.select(F.col("k").alias(x), F.col("a1").alias(f"{y}1"), F.col("a2").alias(f"{y}2")) for x, y in (("node", "k"), ("root", "r")))
    linked = components(found).join(node, "node").join(root, "root").select("k1", "k2", "r1", "r2")
    copied = own.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").join(linked, ["k1", "k2"], "left_anti")
    # the lines that others equal or resemble, each with the line that names its component
    need = stored(linked.unionByName(copied.select("k1", "k2", F.col("k1").alias("r1"), F.col("k2").alias("r2"))), "line-groups")
    rows = stored(own.join(_few(need), ["k1", "k2"]).select("id", "pos", "r1", "r2"), "line-copies")
    keep = rows.groupBy("r1", "r2").agg(F.min(F.struct("id", "pos")).alias("keep"))
    gone = rows.join(_few(keep), ["r1", "r2"]).where((F.col("id") != F.col("keep.id")) | (F.col("pos") != F.col("keep.pos")))
    return gone.groupBy("id").agg(F.array_sort(F.collect_set("pos")).alias("removed")).withColumnRenamed("id", id_col)


def report(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, n_lines, n_removed, removed) of every row of ``docs``; ``removed`` are the
    positions as text. NULL texts have no lines, an empty text has one; rows that
    repeat an id are one document and lose the same lines; rows with a NULL id lose none."""
    # a line break is one byte: no character is counted
    n = F.coalesce(F.octet_length(text_col) - F.octet_length(F.replace(text_col, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines")
    out = docs.select(id_col, n).join(removed(docs, id_col, text_col), id_col, "left")
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select(id_col, "n_lines", F.size(gone).cast("long").alias("n_removed"), F.array_join(gone.cast("array<string>"), ",").alias("removed"))


def dedup_lines(docs: DataFrame, id_col="doc_id", text_col="text", chars_col="n_chars") -> DataFrame:
    """``docs`` without the lines that go, columns as they are (``chars_col``, if there
    is one, is the new length). A document that loses all its lines stays, with an empty text."""
    own = "_gone"
    while own in docs.columns:  # no column of the caller's is shadowed
        own += "_"
    gone = removed(docs.select(id_col, text_col), id_col, text_col).withColumnRenamed("removed", own)
    lines = F.split(text_col, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), own)
    text = F.when(F.col(own).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    j = docs.join(gone, id_col, "left").withColumn(text_col, text)
    if chars_col in docs.columns:
        j = j.withColumn(chars_col, F.when(F.col(own).isNull(), F.col(chars_col)).otherwise(F.length(text_col)).cast(docs.schema[chars_col].dataType))
    return j.select(*docs.columns)
