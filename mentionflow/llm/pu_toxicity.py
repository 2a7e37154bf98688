"""Toxicity by non-negative positive-unlabelled learning: a numpy classifier
trained from confirmed toxic texts and unlabelled texts, with the class-prior
corrected risk of Kiryo et al. (2017)."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, held_out, map_arrow, sample_ids, texts_of

#: Bounds of the training sample: rows, and characters in all.
POSITIVE_ROWS = 2000
UNLABELLED_ROWS = 6000
SAMPLE_CHARS = 120_000_000
#: Size of the feature table and the word-start lengths that count as features.
FEATURES = 512
PREFIXES = (4, 5, 6)
MIN_POSITIVE = 3
THRESHOLD = 0.5
EDGE = " .,;:!?#$%&*|<>()[]{}\"'`~-_=+/\\"


@dataclass(frozen=True)
class Model:
    weights: dict
    bias: float


def features(text: str) -> set[str]:
    """Distinct lower-case words without edge punctuation, and word starts
    (marked by ``^``). A word of a kind counts once, however long the text."""
    words = {w.strip(EDGE) for w in set(text.lower().split())}
    out = set(words)
    for n in PREFIXES:
        out.update(["^" + w[:n] for w in words if len(w) >= n])
    out.discard("")
    return out


def fit(positive: list[str], unlabelled: list[str], prior: float, n_features: int = FEATURES, steps: int = 300,
        rate: float = 0.05, decay: float = 1e-5) -> Model:
    """Train a linear classifier on presence features with the non-negative
    risk ``prior * R+(P) + max(0, R-(U) - prior * R-(P))`` under the logistic
    loss, by Adam. Features are those whose share among positives most exceeds
    their share among negatives, where the latter is the unlabelled share less
    ``prior`` times the positive share. Without positives or unlabelled texts
    the score is the constant ``prior``."""
    prior = min(max(prior, 1e-4), 0.9)
    bias0 = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model({}, bias0)
    # the feature sets are made again where they are needed: all of them at once would be many times the texts
    cp = Counter(f for t in positive for f in features(t))
    least = min(MIN_POSITIVE, len(positive))
    cp = {f: c for f, c in cp.items() if c >= least}
    cu = Counter(f for t in unlabelled for f in features(t) & cp.keys())
    lift = {}
    for f, c in cp.items():
        p = c / len(positive)
        neg = max(0.0, cu.get(f, 0) / len(unlabelled) - prior * p) / (1 - prior)
        lift[f] = c * np.log((p + 1 / len(positive)) / (neg + 1 / len(unlabelled)))
    names = sorted(lift, key=lambda f: (-lift[f], f))[:n_features]
    index = {f: i for i, f in enumerate(names)}

    def matrix(texts):
        x = np.zeros((len(texts), len(names)), np.float32)
        for r, t in enumerate(texts):
            x[r, [index[f] for f in features(t) & index.keys()]] = 1
        return x
    xp, xu = matrix(positive), matrix(unlabelled)
    w, b = np.zeros(len(names), np.float32), bias0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, steps + 1):
        zp, zu = xp @ w + b, xu @ w + b
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative >= 0:
            gp, gu = -prior * np.ones_like(sp) / len(sp), su / len(su)
        else:  # the negative risk is under 0: step back along it
            gp, gu = prior * sp / len(sp), -su / len(su)
        g = np.append(gp @ xp + gu @ xu + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = (w - d[:-1]).astype(np.float32), float(b - d[-1])
    return Model({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}, b)


def train(docs: DataFrame, labels: DataFrame, label_col="toxic", id_col="doc_id", text_col="text",
          positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> Model:
    """Fit on bounded samples outside the held-out fold: confirmed toxic rows,
    and texts whose label is not looked at. The class prior is the toxic share
    of all labelled rows outside that fold. NULL labels, ids and texts are not learned from, an id labelled twice counts with its
    greatest label, rows of one id count once (with the least text); without labels the prior is 0.5. Texts beyond an even share of SAMPLE_CHARS count by parts."""
    lab = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()) \
        .groupBy(id_col).agg(F.max(label_col).alias("_y"))
    n, n1 = lab.agg(F.count("*"), F.count_if(F.col("_y") == 1)).first()
    positive = sample_ids(lab.where("_y = 1"), positive_rows, id_col).withColumn("_s", F.lit(1))
    rest = sample_ids(docs.where(~held_out(id_col)), unlabelled_rows, id_col).withColumn("_s", F.lit(0))
    rows = texts_of(docs, positive.unionByName(rest), positive_rows + unlabelled_rows, SAMPLE_CHARS, id_col, text_col)
    return fit([t for _, s, t in rows if s == 1], [t for _, s, t in rows if s == 0], n1 / n if n else 0.5)


def scorer(model: Model):
    """Function text -> (score,)."""
    weights, bias = model.weights, model.bias

    def score(text: str) -> tuple[float]:
        z = bias + sum(weights[f] for f in features(text) & weights.keys())
        return (float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))),)
    return score


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``. Empty and NULL
    texts have no features and get the score of the bias; repeated rows are
    scored each; other columns are not read; an empty table gives none."""
    def run(batches):
        yield from each_text(batches, scorer(model), ["score"], [pa.float64()])

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, score double")
    return out.select(id_col, held_out(id_col).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
