"""Source mixing: targets, schedule and taken words against plain versions."""

import hashlib
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from mentionflow.llm import source_mixing as M


def plain_targets(sizes, weights=(1, 2, 3)):
    """{source: target}: share by weight, cap, share the excess again until nothing is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = Fraction(sum(sizes.values())), {}
    while True:
        open_ = [s for s in names if s not in stopped]
        rest, ws = total - sum(stopped.values()), sum(w[s] for s in open_)
        share = {s: rest * w[s] / ws for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return {**stopped, **share}
        stopped |= {s: Fraction(3 * sizes[s]) for s in over}


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def random_rows(seed, hot=0.4, n=400):
    rng = random.Random(seed)
    names = ["a", "b", "é", "Z", "日本", None, "tiny", "void"]
    rows = []
    for i in range(n):
        s = "a" if rng.random() < hot else rng.choice(names[:6])
        rows.append((i, None if rng.random() < 0.05 else " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), s))
    return rows + [(9001, "one two", "tiny"), (9002, "", "void"), (9003, "x " * 5000, "b"), (None, "no id here", "b"), *[(9007, "same words here", "b")] * 3]


@pytest.mark.parametrize("seed,block", [(1, 16), (2, 1024), (3, 7)])
def test_taken(spark, seed, block):
    rows = random_rows(seed)
    out = M.taken(docs(spark, rows).withColumns({c: F.lit(f"own {c}") for c in ("size", "rid", "sid", "target", "of", "rank")}), block=block).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = plain_targets(sizes)
    assert any(want[s] == 3 * sizes[s] > 0 for s in sizes)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in out) == sorted((i is None, i or 0, len((t or "").split())) for i, t, _ in rows)
    # the ring of each source, laid out in the order of the ids' MD5
    ring = {}
    for i, t, s in sorted(rows, key=lambda r: (hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest(), r[0] is not None, r[0] or 0)):
        ring.setdefault(s, []).extend([i] * len((t or "").split()))
    took = {}
    for s, words in ring.items():
        for k in range(int(want[s] + Fraction(1, 2))):
            took[words[k % len(words)]] = took.get(words[k % len(words)], 0) + 1
    got = {}
    for r in out:
        assert r.taken <= 3 * r.size
        got[r.doc_id] = got.get(r.doc_id, 0) + r.taken
    assert {k: v for k, v in got.items() if v} == took
    names = {}
    for i, _, s in rows:
        names[i] = s
    for r in out:
        assert abs(r.target - float(want[names[r.doc_id]])) < 1e-6 and r.source_size == sizes[names[r.doc_id]]


def test_schedule_is_even(spark):
    """At every point of the schedule a source has had about its share."""
    rows = M.sized(docs(spark, random_rows(5, n=3000)))
    sources = M.stored(M.quotas(M.targets(rows), 8), "s")
    need = {r.sid: r.need for r in sources.collect()}
    plan = M.schedule(sources).orderBy("slot").collect()
    assert len({r.slot for r in plan}) == len(plan) == sum(need.values())
    seen = dict.fromkeys(need, 0)
    for k, r in enumerate(plan, 1):
        assert r.rank == seen[r.sid]
        seen[r.sid] += 1
        assert all(abs(seen[s] - k * need[s] / len(plan)) < 8 for s in need)
    assert seen == need


def test_mix_is_whole_blocks(spark):
    rows = M.sized(docs(spark, random_rows(6)))
    sources = M.stored(M.quotas(M.targets(rows), 32), "s")
    of = {r.sid: r for r in sources.collect()}
    words = {}
    for r in M.mix(rows, sources, 32).collect():
        words[r.sid, r.rank] = words.get((r.sid, r.rank), 0) + r.to_word - r.from_word
    for (sid, rank), n in words.items():
        assert n == min(32, of[sid].quota - rank * 32)


def test_reruns_and_partitions_agree(spark):
    d = docs(spark, random_rows(4))
    one = sorted(map(str, M.taken(d).collect()))
    assert one == sorted(map(str, M.taken(d.repartition(7, "doc_id")).collect()))


def test_nothing(spark):
    assert M.taken(docs(spark, [])).collect() == []
    out = M.taken(docs(spark, [(1, None, None), (2, " \n", "s")])).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in out) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
