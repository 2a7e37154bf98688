"""Hard-negative mining against a comparison of all rows."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mentionflow.llm import negative_mining as N


def vectors(spark, data, kind="float"):
    return spark.createDataFrame(data, f"vec_id bigint, embedding array<{kind}>, label int")


def slow(data, kind=np.float32):
    rows = set()
    for i, v, lab in data:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        rows.add((i, int(math.fmod(lab + 1, 10)) if i % 7 == 0 else lab, tuple(float(kind(x)) for x in v)))
    rows = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows]
    top, out = 2 ** 63 - 1, []
    for a in (r for r in rows if r[0] % 100 == 0):
        s = sorted((-max(-top - 1, min(top, sum(p * q for p, q in zip(a[2], r[2], strict=False)))), r[0], r[1]) for r in rows if r is not a)
        for ps, pid, _ in [x for x in s if x[2] == a[1]][:5]:
            fit = [x for x in s if x[2] != a[1] and 30 * -ps <= 100 * -x[0] <= 90 * -ps]
            out += [(a[0], pid, k, n, -ps, -ns) for k, (ns, n, _) in enumerate(fit[:10], 1)]
    return sorted(out)


def clustered(seed, n=1500, d=12, groups=25, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    return [(i, [float(np.float32(x)) for x in centres[g] + spread * rng.normal(size=d)], int(g % 10) if rng.random() < 0.6 else int(rng.integers(10)))
            for i, g in enumerate(rng.integers(groups, size=n))]


def mined(spark, data, kind="float", **extra):
    d = vectors(spark, data, kind).withColumns({c: F.lit(f"own {c}") for c in ("leaf", "salt", "digest", "ak", "lo", "w")})
    out = N.mine(d, **extra)
    assert out.columns[:6] == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_clustered(spark, seed, monkeypatch):
    monkeypatch.setattr(N, "SAMPLE", 300)
    monkeypatch.setattr(N, "CHUNK", 40)
    monkeypatch.setattr(N, "QUERIES", 5)
    data = clustered(seed)
    got = mined(spark, data)
    assert got and got == slow(data)


def test_siblings_are_left_out(spark, monkeypatch):
    """On clustered vectors most leaves are eliminated, and none that holds a row of the window."""
    monkeypatch.setattr(N, "SAMPLE", 400)
    monkeypatch.setattr(N, "LEAF_SAMPLE", 8)
    data = clustered(3, n=2000, spread=0.01)
    tree, own, counts = N.grown(N.rows_of(vectors(spark, data)))
    rows = own.toArrow()
    x, leaf = N.matrix(rows.column("embedding")), rows.column("leaf").to_numpy()
    seen = 0
    for q in range(0, len(x), 40):
        s = N.scores(x[q:q + 1], x)[0]
        lo, hi = 0.97 * s[q], 1.02 * s[q]
        left = set(tree.survivors(x[q], [(lo, hi)]))
        assert set(leaf[(s >= lo) & (s <= hi)].tolist()) <= left
        seen += len(left)
    assert tree.leaves > 20 and seen < 0.3 * tree.leaves * len(range(0, len(x), 40))


def test_awkward_rows(spark):
    rng = random.Random(4)
    data = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.5, 1.0, 0.003]) for _ in range(6)], rng.randrange(3)) for i in range(400)]  # many ties
    data += [(500, None, 1), (501, [1.0] * 6, None), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (503, [float("nan")] * 6, 1), (504, [float("inf")] + [0.0] * 5, 2),
             (None, [1.0] * 6, 1), (700, [0.0] * 6, 2), (800, [], 1), (801, [2.0, 1.0], 1), (900, [1.0] * 9, 0), (1000, [-3.0] * 6, -7)]
    data += [(0, data[0][1], data[0][2])] * 3 + [(i, data[i][1], data[i][2]) for i in range(50)]
    assert mined(spark, data) == slow(data)


def test_one_vector_held_by_many(spark, monkeypatch):
    monkeypatch.setattr(N, "CHUNK", 100)
    data = [(i, [0.5, 0.25, -0.125], i % 3) for i in range(900)] + [(1000 + i, [0.5 * i / 40, 0.2, 0.1], i % 5) for i in range(80)]
    assert mined(spark, data) == slow(data)


def test_scores_beyond_doubles(spark):
    data = [(i, [float(2 ** 20 + i), float(3 ** 12 - i), 1e9 * (i % 5)], i % 2) for i in range(60)] + [(100, [1e30, -1e30, 1.0], 1), (200, [1e30, 1.0, 1.0], 0)]
    assert mined(spark, data, "double") == slow(data, np.float64)


def test_nothing(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == [] and mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_sql(spark):
    data = clustered(5, n=400)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", data)
    assert sorted(con.execute(N.oracle()).fetchall()) == slow(data)
