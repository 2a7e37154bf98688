"""Conversation repair against all edit sequences, a plain programme, and its SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from mentionflow.llm import conversation_repair as R

SPACE = " \t\n\x0b\x0c\r"
FORM = re.compile(r"(s?(ua)+)?")


def all_edits(letters):
    """(cost, audit) of the best of all edit sequences of a few letters, with at most two inserts in a row."""
    best, stack = None, [("", "", 0, 0)]
    while stack:
        audit, out, k, cost = stack.pop()
        if best and cost > best[0]:
            continue
        if k == len(letters) and FORM.fullmatch(out) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if not audit.endswith("II"):
            stack += [(audit + "I", out + r, k, cost + 5) for r in "ua"]
        if k < len(letters):
            x = letters[k]
            stack.append((audit + "D", out, k + 1, cost + 2))
            if x != "d":
                cut = 5 if x.isupper() else 0
                stack.append((audit + "K", out + x.lower(), k + 1, cost + cut))
                stack += [(audit + "R", out + r, k + 1, cost + cut + 1) for r in "ua"]
    return best


def by_rules(letters, rules=()):
    of, state = R.matrices(list(rules)), R.START
    for x in R.compressed(letters, rules):
        state = R.times(state, of[x])
    return R.best(state)


def test_all_edit_sequences():
    rng = random.Random(1)
    for _ in range(150):
        s = "".join(rng.choice("suaoSUAOd") for _ in range(rng.randrange(5)))
        assert by_rules(s) == all_edits(s), s


def test_rules_change_nothing():
    rng = random.Random(2)
    rules = [("u", "a", ""), ("", "", ""), ("d", "d", ""), ("o", "U", ""), ("", "", "")]
    for _ in range(200):
        s = "".join(rng.choice("uauauauasoUAd") for _ in range(rng.randrange(300)))
        assert by_rules(s, rules) == by_rules(s)


def test_ropes():
    rng = random.Random(3)
    made = [("", "")]
    for _ in range(400):
        a, b = rng.choice(made), rng.choice(made)
        t = rng.choice(["D", "K", "KK", "RRI"])
        made.append((R.joined(R.joined(a[0], b[0]), t), a[1] + b[1] + t) if len(a[1] + b[1]) < 5000 else (t, t))
    for _ in range(3000):
        a, b = rng.choice(made), rng.choice(made)
        assert R.text_of(a[0]) == a[1] and R.less(a[0], b[0]) == (a[1] < b[1])


def slow(rows):
    """{conv_id: result} of the report, row by row."""
    out = {c: [] for c, *_ in rows}
    for c, t, r, x in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        f = zlib.crc32(key.encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if f == 1 else re.sub("[.!?]", "", x) if f == 2 else x
        out[c] += [(t, "user" if f == 4 else r, x)] * (0 if f == 0 else 2 if f == 3 else 1)
    for c, turns in out.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.md5(r[2].encode()).hexdigest()))
        seen, letters, n = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, r, x in turns:
            end = x.rstrip(SPACE)
            kind = "blank" if not end else "duplicate" if (r, x) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((r, x))
            if kind:
                n[kind] += 1
            y = r[:1] if r[:1] in ("s", "u", "a") else "o"
            letters += "d" if kind in ("blank", "duplicate") else y.upper() if kind else y
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        own = {t for t, *_ in turns if t is not None}
        cost, audit = by_rules(letters)
        lines, last, at = [], "", iter(turns)
        for e in audit:
            row = ("", "") if e == "I" else next(at)[1:]
            if e != "D":
                role = row[0] if e == "K" else "assistant" if last == "u" else "user"
                last = role[0]
                lines.append(f"{role}:{row[1]}")
        out[c] = (max(own) - min(own) + 1 - len(own) if own else 0, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def rows(spark, data):
    return spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")


def awkward(seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "What?", "", " \n", None, "Same text here!", "x" * 20000 + ".", "ends with space. \t", "日本語。", "日本."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "usher", "Assistant"]
    data = [(rng.choice([*range(25), None]), rng.choice([*range(12), None]), rng.choice(roles), rng.choice(texts)) for _ in range(500)]
    return data + data[:40] + [(900, None, "user", "a"), (900, None, None, None), (901, 5, "user", "q?")]


@pytest.mark.parametrize("seed", [1, 2])
def test_report(spark, seed):
    data = awkward(seed)
    d = rows(spark, data).withColumns({c: F.lit(f"own {c}") for c in ("ord", "first", "audit", "h1", "letter", "f", "salt")})
    got = {r[0]: tuple(r)[1:] for r in R.report(d.repartition(5)).collect()}
    assert got == slow(data)


def test_long_conversation(spark):
    """A conversation of many segments over many tasks, its turns in no order."""
    rng = random.Random(5)
    data = [(1, t, ["user", "assistant"][t % 2] if rng.random() < 0.9 else "system", f"text {rng.randrange(12000)}{'.' if rng.random() < 0.9 else ''}") for t in range(15000)]
    data += [(2, t, "user", "Same.") for t in range(300)] + [(0, 0, "user", "q?")]
    rng.shuffle(data)
    got = {r[0]: tuple(r)[1:] for r in R.report(rows(spark, data)).collect()}
    assert got == slow(data)


def test_repaired_rows(spark):
    data = [(1, 0, "user", "Hi."), (1, 1, "user", "Hello?"), (2, 0, "assistant", "Alone."), (2, 1, "assistant", "Again"), (3, 0, "tool", "")]
    own = R.stored(R.ordered(rows(spark, data)), "t")
    out = {}
    for r in sorted(R.repaired(own, R.audits(own)).collect()):
        out.setdefault(r.conv_id, []).append((r.role, r.text, r.edit))
    assert out == {1: [("user", "Hi.", "K"), ("assistant", "Hello?", "R")]}


def test_nothing(spark):
    assert R.report(rows(spark, [])).collect() == []


def test_sql(spark):
    data = awkward(7)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", data)
    assert {r[0]: tuple(r)[1:] for r in con.execute(R.oracle()).fetchall()} == slow(data)
