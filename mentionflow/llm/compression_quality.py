"""Quality classifier by compression: two zstandard dictionaries, one trained on
good and one on bad labelled text; the normalised difference of the compressed
sizes, calibrated, is the score."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, held_out, map_arrow, sample_ids, texts_of

#: Parameters. Texts are compressed in blocks, so that repetition inside a long
#: text does not hide what the dictionaries know of it.
BLOCK = 256
DICT_BYTES = 65536
LEVEL = 3
#: Bounds of the labelled sample: rows of each class, and characters in all.
DICT_ROWS = 1000
CALIBRATION_ROWS = 2000
SAMPLE_CHARS = 120_000_000
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: tuple
    scale: tuple
    weights: tuple  # of the calibration; empty: ``constant`` is the score
    constant: float = 0.5
    block: int = BLOCK


def _compressor(dictionary: bytes) -> zs.ZstdCompressor:
    p = zs.ZstdCompressionParameters.from_level(LEVEL, format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=False,
                                                write_dict_id=False, write_checksum=False)
    return zs.ZstdCompressor(compression_params=p, dict_data=zs.ZstdCompressionDict(dictionary))


def _dictionary(texts: list[bytes], size: int, block: int) -> bytes:
    blocks = [t[i:i + block] for t in texts for i in range(0, len(t), block)]
    try:
        return zs.train_dictionary(size, blocks, k=64, d=8, steps=1).as_bytes()
    except zs.ZstdError:  # too few samples to train on: their text itself is the dictionary
        return b"".join(blocks)[-size:]


def _sizes(model: Model):
    """Function text -> (difference of the compressed sizes over the length,
    mean compressed size over the length)."""
    good, bad = _compressor(model.good), _compressor(model.bad)
    empty, n = len(good.compress(b"")), model.block

    def sizes(text: str) -> tuple[float, float]:
        data = text.encode("utf-8", "replace")
        g = b = 0
        for i in range(0, len(data), n):
            part = data[i:i + n]
            g += len(good.compress(part)) - empty
            b += len(bad.compress(part)) - empty
        length = max(1, len(data))
        return (b - g) / length, (b + g) / (2 * length)
    return sizes


def _terms(x: np.ndarray) -> np.ndarray:
    """Terms of the calibration: difference, size, their product and squares, one."""
    return np.column_stack([x, x[:, 0] * x[:, 1], x ** 2, np.ones(len(x))])


def fit(texts_labels: list[tuple[str, int]], calibration: list[tuple[str, int]], shares: tuple[float, float],
        block: int = BLOCK, dict_bytes: int = DICT_BYTES) -> Model:
    """Train the dictionaries on the first rows and the calibration (weighted
    logistic regression by Newton steps) on the second. ``shares``: of label 0
    and 1 among all labelled rows. With a class missing: a constant score,
    the share of label 1 (0.5 without labels)."""
    by = {k: [t.encode("utf-8", "replace") for t, y in texts_labels if y == k and t] for k in (0, 1)}
    y = np.array([y for _, y in calibration], dtype=float)
    if not by[0] or not by[1] or len(set(y)) < 2:
        total = sum(shares)
        return Model(b"", b"", (), (), (), shares[1] / total if total else 0.5, block)
    m = Model(_dictionary(by[1], dict_bytes, block), _dictionary(by[0], dict_bytes, block), (), (), (), block=block)
    sizes = _sizes(m)
    x = np.array([sizes(t) for t, _ in calibration])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = _terms((x - mean) / scale)
    weight = np.where(y == 1, shares[1] / max(1, (y == 1).sum()), shares[0] / max(1, (y == 0).sum()))
    weight *= len(y) / weight.sum()
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - 1e-2 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return Model(m.good, m.bad, tuple(mean), tuple(scale), tuple(w), block=block)


def train(docs: DataFrame, labels: DataFrame, label_col="quality", id_col="doc_id", text_col="text",
          dict_rows: int = DICT_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """Fit on a bounded sample of the labelled rows outside the held-out fold
    (``dict_rows`` + ``calibration_rows`` of each class, in hash order). The
    class shares count all those labels. NULL labels, ids and texts are not learned from;
    an id labelled twice counts with its least label."""
    lab = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()) \
        .groupBy(id_col).agg(F.min(label_col).cast("int").alias("_y"))
    counts = {r["_y"]: r["n"] for r in lab.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n = dict_rows + calibration_rows
    ids = None
    for k in (0, 1):
        part = sample_ids(lab.where(F.col("_y") == k), n, id_col).withColumn("_y", F.lit(k))
        ids = part if ids is None else ids.unionByName(part)
    first, rest = [], []
    rows = texts_of(docs, ids, 2 * n, SAMPLE_CHARS, id_col, text_col)
    for k in (0, 1):
        own = sorted(((hash_of(i), t, y) for i, y, t in rows if y == k))
        cut = min(dict_rows, (len(own) + 1) // 3 if len(own) < n else dict_rows)
        first += [(t, y) for _, t, y in own[:cut]]
        rest += [(t, y) for _, t, y in own[cut:]] or [(t, y) for _, t, y in own]
    return fit(first, rest, (counts.get(0, 0), counts.get(1, 0)))


def hash_of(key) -> int:
    """A fixed pseudo-random order of ids (splits the sample into two parts)."""
    import zlib
    return zlib.crc32(f"part-{key}".encode())


def scorer(model: Model):
    """Function text -> (score,)."""
    if not model.weights:
        return lambda text: (float(model.constant),)
    sizes = _sizes(model)
    mean, scale, w = (np.array(v) for v in (model.mean, model.scale, model.weights))

    def score(text: str) -> tuple[float]:
        z = float((_terms((np.array([sizes(text)]) - mean) / scale) @ w)[0])
        return (float(1 / (1 + np.exp(-np.clip(z, -30, 30)))),)
    return score


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``.

    The score rises with the chance of label 1. A NULL or empty text has size 0
    and gets the score of that point; repeated rows are scored each; other
    columns, whatever their names, are not read; an empty table gives none."""
    def run(batches):
        yield from each_text(batches, scorer(model), ["score"], [pa.float64()])

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, score double")
    return out.select(id_col, held_out(id_col).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, id_col="doc_id", text_col="text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with their columns as they
    are. Scoring and filtering is one pass; no join, so repeated and NULL ids
    are each judged on their own text."""
    def run(batches):
        judge = scorer(model)
        for b in batches:
            at = b.schema.names.index(text_col)
            keep = [judge(t or "")[0] >= threshold for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))
    return map_arrow(docs, run, docs.schema)
