"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

Texts up to ``chunk_chars`` are one chunk. Longer ones are cut into overlapping
chunks that are pre-tokenised in parallel; neighbours are stitched at the first
position of their overlap where both begin a pre-token, as from a common
boundary on both must agree; the pieces of each stitched part are then encoded
by themselves. Decoding concatenates the raw bytes of the ids."""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, strings

CHUNK_CHARS = 65536
OVERLAP = 512
#: A pre-token is certain when this many characters from its start are seen
#: (the longest contraction) and it isn't the last one seen.
LOOK = 3
#: Distinct pieces whose ids a task remembers; then it starts afresh.
REMEMBERED = 100_000
#: Ids a task gathers before it hands rows on.
FLUSH_IDS = 500_000


def _default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _default_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Pieces:
    """Ids of pre-tokens, remembered within a task."""

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.encode_piece, self.pattern, self.memory = core.encode_single_piece, regex.compile(pattern), {}

    def ids(self, pieces: list[str]) -> list[int]:
        memory = self.memory
        if len(memory) > REMEMBERED:
            memory.clear()
        for p in set(pieces).difference(memory):
            memory[p] = self.encode_piece(p.encode("utf-8", "replace"))
        return list(chain.from_iterable([memory[p] for p in pieces]))

    def of(self, text: str) -> list[int]:
        return self.ids(self.pattern.findall(text))


def _lists(values: array, ends: list[int]) -> pa.Array:
    offsets = pa.array(np.array([0, *ends], dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(values, dtype=np.int32) if values else np.array([], np.int32)))


def _encoded(batches, path: str, pattern: str, names: list[str], text_of):
    """Rows with the columns ``names`` as they are and ``ids``; ``text_of(batch)`` gives the pieces."""
    pieces = Pieces(path, pattern)
    for b in batches:
        values, ends, first = array("i"), [], 0
        for r, own in enumerate(text_of(pieces, b)):
            values.extend(own)
            ends.append(len(values))
            if len(values) >= FLUSH_IDS or r == b.num_rows - 1:
                part = b.slice(first, r + 1 - first)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.names.index(n)) for n in names), _lists(values, ends)], [*names, "ids"])
                values, ends, first = array("i"), [], r + 1


def _chunks(batches, chunk: int, overlap: int):
    """(id, copy, k, start, chunk) of the overlapping chunks of each text.
    ``copy`` tells rows apart that repeat an id, within the task and by its number."""
    from pyspark import TaskContext
    task, row = TaskContext.get().partitionId(), 0
    for b in batches:
        for i, text in zip(b.column(0), strings(b.column(1)), strict=True):
            row += 1
            rows = [(k, s, text[s:s + chunk]) for k, s in enumerate(range(0, max(1, len(text) - overlap), chunk - overlap))]
            for at in range(0, len(rows), 64):
                part = rows[at:at + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i.as_py()] * len(part), b.schema.field(0).type), pa.array([(task << 40) + row] * len(part), pa.int64()),
                     pa.array([k for k, _, _ in part], pa.int32()), pa.array([s for _, s, _ in part], pa.int64()),
                     pa.array([t for _, _, t in part], pa.string())],
                    [b.schema.names[0], "copy", "k", "start", "chunk"])


def _starts(batches, pattern: str, overlap: int):
    """Adds ``head`` and ``tail``: positions in the whole text where pre-tokens
    begin in the overlap with the chunk before and after. ``head`` may be wrong
    until it agrees with the tail of the chunk before; ``tail`` has certain starts only."""
    find = regex.compile(pattern)
    for b in batches:
        heads, tails = [], []
        for s, t in zip(b.column("start").to_pylist(), b.column("chunk").to_pylist(), strict=True):
            at = [m.start() for m in find.finditer(t)]
            heads.append([s + p for p in at if p < overlap])
            sure = []
            for p, after in zip(at, [*at[1:], None], strict=True):
                sure.append(p)
                if after is None or p + LOOK > len(t):
                    break  # this one may end elsewhere once more is seen
            tails.append([s + p for p in sure if p >= len(t) - overlap and p + LOOK <= len(t)])
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, kind), pa.array(tails, kind)], [*b.schema.names, "head", "tail"])


def _segment_ids(pieces: Pieces, batch: pa.RecordBatch):
    """Ids of each stitched part: its chunks are put together, and the
    pre-tokens that begin from ``lo`` until before ``hi`` are encoded."""
    for parts in batch.column("parts").to_pylist():
        base = parts[0]["start"]
        text = parts[0]["chunk"]
        for p in parts[1:]:
            text += p["chunk"][len(text) + base - p["start"]:]
        lo = 0 if parts[0]["lo"] is None else parts[0]["lo"] - base
        hi = len(text) if parts[-1]["hi"] is None else parts[-1]["hi"] - base
        yield pieces.ids([m.group() for m in pieces.pattern.finditer(text, lo, min(len(text), hi + LOOK)) if m.start() < hi])


def encode(docs: DataFrame, id_col="doc_id", text_col="text", path: str | None = None, pattern: str | None = None,
           chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(id, ids) of every row of ``docs``, without special tokens.

    NULL and empty texts have no ids; repeated rows are encoded each; other
    columns are not read; an empty table gives none. Where two neighbouring
    chunks have no common boundary (one pre-token as long as the overlap), they
    are encoded together."""
    if not LOOK < overlap < chunk_chars // 2:
        raise ValueError("the overlap must be over 3 characters and under half a chunk")
    path, pattern = path or _default_path(), pattern or _default_pattern()
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def short(batches):
        yield from _encoded(batches, path, pattern, ["_id"], lambda p, b: (p.of(t) for t in strings(b.column(1))))

    def cut(batches):
        yield from _chunks(batches, chunk_chars, overlap)

    def starts(batches):
        yield from _starts(batches, pattern, overlap)

    def segments(batches):
        yield from _encoded(batches, path, pattern, ["_id", "copy", "segment"], _segment_ids)

    whole = map_arrow(d.where(F.length("_text") <= chunk_chars), short, f"_id {kind}, ids array<int>")
    chunks = map_arrow(d.where(F.length("_text") > chunk_chars), cut,
                       f"_id {kind}, copy bigint, k int, start bigint, chunk string").repartition("copy", "k")
    chunks = map_arrow(chunks, starts, f"_id {kind}, copy bigint, k int, start bigint, chunk string, head array<bigint>, tail array<bigint>")
    w = W.partitionBy("copy").orderBy("k")
    seams = chunks.withColumn("lo", F.array_min(F.array_intersect(F.lag("tail").over(w), "head"))) \
        .withColumn("hi", F.array_min(F.array_intersect("tail", F.lead("head").over(w)))) \
        .withColumn("segment", F.sum(F.when(F.col("lo").isNotNull() | (F.col("k") == 0), 1).otherwise(0)).over(w))
    parts = seams.groupBy("_id", "copy", "segment").agg(
        F.sort_array(F.collect_list(F.struct("k", "start", "chunk", "lo", "hi"))).alias("parts"))
    done = map_arrow(parts.repartition("copy", "segment"), segments, f"_id {kind}, copy bigint, segment bigint, ids array<int>")
    joined = done.groupBy("_id", "copy").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("segment", "ids"))), lambda s: s["ids"])).alias("ids"))
    return whole.unionByName(joined.select("_id", "ids")).withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, id_col="doc_id", ids_col="ids", path: str | None = None) -> DataFrame:
    """``encoded`` (id, ids) with ``decoded``: the raw bytes of the ids, concatenated. NULL ids: none."""
    path = path or _default_path()
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        ranks = load_ranks(path)
        raw = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            raw[i] = piece
        for b in batches:
            ids = b.column(1)
            out = pa.array((b"".join([raw[i] for i in own.as_py() or ()]) for own in ids), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), ids, out], [b.schema.names[0], "ids", "decoded"])

    return map_arrow(encoded.select(id_col, F.col(ids_col).alias("ids")), run, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def digests(decoded: DataFrame, id_col="doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of the rows of ``decode``."""
    ids = F.coalesce(F.col("ids"), F.array().cast("array<int>"))
    return decoded.select(
        id_col, F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
