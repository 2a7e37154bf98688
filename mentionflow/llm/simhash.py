"""SimHash near-duplicates with pigeonring filtering (Qin and Xiao 2018).

The 64 bits are a ring of ``max_bits + 1`` segments. Two fingerprints within
``max_bits`` have a chain of consecutive segments, from some segment on, whose
differences over the first l segments stay within l * max_bits / segments, for
every l. Fingerprints without a partner in any chain of all but one segment are
pruned by an equi-join on keys that spell out the differences its budget
allows; on the whole ring the key test is the full Hamming check. All members
of a key group are linked to its least one, so a group costs as many rows as it has members."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, map_arrow, stored, strings

BITS = 64
SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: Shingles hashed before their bits are added up: bounds the memory of a text.
BLOCK = 200_000


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of the word shingles, as a signed 64-bit number."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    n, digest = max(1, len(words) - shingle_words + 1), xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(b" ".join(words[i:i + shingle_words]), SEED) for i in range(at, min(n, at + BLOCK))], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp) of every row of ``docs``. NULL, empty and blank texts have
    fingerprint 0; a text of fewer words than a shingle is one shingle."""
    def run(batches):
        for b in batches:
            fp = [fingerprint(t, shingle_words) for t in strings(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], [b.schema.names[0], "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, fp bigint")


def ring(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _bits(i: int, length: int, layout: list[tuple[int, int]]) -> list[int]:
    """Bits of ``length`` consecutive segments of the ring from segment ``i``."""
    return [b for s in range(length) for b in range(layout[(i + s) % len(layout)][0], sum(layout[(i + s) % len(layout)]))]


def _mask(bits) -> int:
    """Signed number with these bits set."""
    mask = sum(1 << b for b in bits)
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def chain_keys(fps: DataFrame, length: int, layout: list[tuple[int, int]], budget: int) -> DataFrame:
    """(fp, c, v): keys of the chains of ``length`` segments, c telling where the
    chain begins and what is masked. Two fingerprints share a key exactly if
    in one of the chains the first segment is equal (its budget is 0) and at most
    ``budget`` (0 or 1) bits differ in all."""
    masks = []
    for i in range(len(layout)):
        own = _bits(i, length, layout)
        if budget == 0:
            masks.append((i << 8, _mask(own)))
        else:
            masks += [(i << 8 | b + 1, _mask(set(own) - {b})) for b in own[layout[i][1]:]]
    m = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(x).cast("long").alias("m")) for c, x in masks])).alias("k")
    return fps.select("fp", m).select("fp", F.col("k.c").alias("c"), F.col("fp").bitwiseAND(F.col("k.m")).alias("v"))


def ring_keys(fps: DataFrame, budget: int) -> DataFrame:
    """(fp, c, v) keys of the whole ring: those that share one differ in at most
    ``budget`` bits, and all that do share one. 1: any one bit masked. 2: the values within one bit
    (two fingerprints within two bits have one in common)."""
    if budget == 1:
        masks = [(b, _mask(set(range(BITS)) - {b})) for b in range(BITS)]
        value = F.col("fp").bitwiseAND(F.col("k.m"))
    else:
        masks = [(0, 0), *[(0, _mask({b})) for b in range(BITS)]]
        value = F.col("fp").bitwiseXOR(F.col("k.m"))
    m = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(x).cast("long").alias("m")) for c, x in masks])).alias("k")
    return fps.select("fp", m).select("fp", F.col("k.c").alias("c"), value.alias("v"))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) links between distinct fingerprints within ``max_bits`` bits: not
    all pairs, but enough that their components are those of all pairs.

    Key groups are small whatever the data: distinct fingerprints that agree
    on two of three segments differ in the 22 bits left, so 2^22 rows of 20 bytes at most."""
    if max_bits not in (1, 2):
        raise ValueError("max_bits must be 1 or 2")
    segments = max_bits + 1
    length = segments - 1
    keys = chain_keys(fps, length, ring(segments), length * max_bits // segments)
    same = W.partitionBy("c", "v")
    chained = keys.withColumn("n", F.count("*").over(same)).where("n > 1").select("fp").distinct()
    whole = ring_keys(chained, max_bits).withColumn("low", F.min("fp").over(same)).where("fp <> low")
    pairs = whole.select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def groups(docs: DataFrame, id_col="doc_id", text_col="text", shingle_words: int = SHINGLE_WORDS,
           max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component_id) of every row of ``docs``; ``component_id`` is the
    least id reachable over fingerprints within ``max_bits`` bits. A row with a NULL id
    gets the least id of its group (NULL if it has none); repeated rows are one group."""
    return _rooted(docs, id_col, text_col, shingle_words, max_bits).select(id_col, "fp", "component_id")


def _rooted(docs: DataFrame, id_col="doc_id", text_col="text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component_id, root): with the fingerprint that names the group."""
    fp = stored(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    least = stored(fp.groupBy("fp").agg(F.min(id_col).alias("least")), "least")
    nodes = components(links(least.select("fp"), max_bits))
    rooted = least.join(nodes.select(F.col("node").alias("fp"), "root"), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(best, "root").select("fp", "component_id", "root")
    return fp.join(by_fp, "fp").select(id_col, "fp", "component_id", "root")


def hex_of(col="fp") -> F.Column:
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def one_of_each(docs: DataFrame, id_col="doc_id", text_col="text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` with the least id of each group, columns as they are.

    Rows that repeat an id are judged each by its own text: of those in one group the one with the least text
    stays (of equal texts the least row), and those of other groups stay in theirs. Rows with a NULL id cannot be named as a copy, and stay."""
    g = stored(_rooted(docs, id_col, text_col, shingle_words, max_bits), "simhash-groups").where(F.col(id_col).isNotNull())
    own = {c: "_sh" + c for c in ("key", "fp", "root", "n")}
    while set(own.values()) & set(docs.columns):
        own = {c: "_" + x for c, x in own.items()}
    key, fp, root, n = own.values()
    again = stored(g.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col), "simhash-repeated")
    kept = g.where(F.col("component_id") == F.col(id_col)).select(id_col).distinct()
    once = docs.join(kept, id_col, "left_semi").join(again, id_col, "left_anti")
    several = docs.join(again, id_col, "left_semi").withColumn(key, F.md5(F.coalesce(text_col, F.lit(""))))
    prints = fingerprints(several.select(key, text_col), key, text_col, shingle_words).distinct().select(key, F.col("fp").alias(fp))
    named = g.where(F.col("component_id") == F.col(id_col)).select(id_col, F.col("fp").alias(fp), F.col("root").alias(root)).distinct()
    first = W.partitionBy(id_col, root).orderBy(text_col, F.to_json(F.struct(*docs.columns)))
    several = several.join(prints, key).join(named, [id_col, fp]).withColumn(n, F.row_number().over(first)).where(F.col(n) == 1)
    return once.unionByName(several.select(*docs.columns)).unionByName(docs.where(F.col(id_col).isNull())).select(*docs.columns)
