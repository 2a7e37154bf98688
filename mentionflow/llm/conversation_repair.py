"""Conversation structure repair by a grammar-compressed dynamic programme.

A row of a conversation is one letter: the initial of its role (``s``, ``u``, ``a``, else ``o``; a capital if its text is cut
short) or ``d`` where it must go. Re-Pair rules, learned from the letters of all conversations, name
frequent neighbours; each rule has one min-plus transfer matrix over the states of the role grammar
``(s?(ua)+)?``, built bottom-up from those of its two parts, with the edits (the audit) as ropes that share their
parts. A conversation is then a product of few matrices.

Rows go by turn (NULL first), within it by role and text (its first ``PREFIX`` characters, then its MD5).

Awkward inputs: a NULL of any column reads as one space, but for a NULL turn in ``gaps``; rows with a NULL conv_id are one
conversation; rows that repeat a turn, and equal rows, are rows of their own (an equal one is a
duplicate); a role may be empty; other columns are not read; an empty table gives none.
No task holds a whole conversation: what streams through one is its letters (in segments) and, for the hash, its texts."""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, stored

SPACE = " \t\n\x0b\x0c\r"
PREFIX = 64
#: Letters of a segment at most.
SEGMENT = 4096
#: Rules that are learned, those of a round, and occurrences from which a pair is worth a rule. They decide the speed only.
MAX_RULES = 256
RULES_PER_ROUND = 16
MIN_PAIRS = 16

# ------------------------------------------------------------------ ropes
#: An audit is a string, or for longer ones a pair of parts that other audits share.
ROPE_LEAF = 64


class Rope:
    __slots__ = ("left", "right", "size")

    def __init__(self, left, right):
        self.left, self.right, self.size = left, right, size_of(left) + size_of(right)


def size_of(r) -> int:
    return len(r) if isinstance(r, str) else r.size


def joined(a, b):
    if not size_of(a) or not size_of(b):
        return a if size_of(a) else b
    return text_of(a) + text_of(b) if size_of(a) + size_of(b) <= ROPE_LEAF else Rope(a, b)


def leaves(r):
    stack = [r]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield x
        else:
            stack += (x.right, x.left)


def text_of(r) -> str:
    return r if isinstance(r, str) else "".join(leaves(r))


def less(a, b) -> bool:
    """``a`` before ``b`` in ASCII order, leaf by leaf up to the first difference."""
    if isinstance(a, str) and isinstance(b, str) or a is b:
        return a is not b and a < b
    x, y, ia, ib = "", "", leaves(a), leaves(b)
    while True:
        x, y = x or next(ia, ""), y or next(ib, "")
        n = min(len(x), len(y))
        if not n or x[:n] != y[:n]:
            return x[:n] < y[:n] if n else len(x) < len(y)
        x, y = x[n:], y[n:]


# --------------------------------------------------------------- matrices
#: States: 0 nothing yet, 1 after the system row, 2 after a user's, 3 after an assistant's; 0 and 3 may be the end.
STATES, ENDS = range(4), (0, 3)
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5


def times(m, n):
    """Min-plus product of two matrices {(from, to): (cost, audit)}; of equal costs the ASCII-least audit. Audits of one state and
    cost are never a proper start of each other (more inserts cost more), so least parts make the least whole."""
    out = {}
    for (i, k), (c, r) in m.items():
        for j in STATES:
            if (k, j) in n:
                d, s = n[k, j]
                old = out.get((i, j))
                if old is None or c + d < old[0]:
                    out[i, j] = (c + d, joined(r, s))
                elif c + d == old[0] and less(t := joined(r, s), old[1]):
                    out[i, j] = (c + d, t)
    return out


def _inserts():
    """Inserted rows between two others: none, or the shortest way to another state."""
    one = {(i, i): (0, "") for i in STATES} | {(i, j): (INSERT, "I") for x in "ua" for i, j in NEXT[x].items()}
    return times(one, one)


INSERTS = _inserts()


def letter_matrix(x: str) -> dict:
    """Inserts, then one edit of a row with that letter."""
    m = {(i, i): (DELETE, "D") for i in STATES}
    if x != "d":
        cut = CUT if x.isupper() else 0
        m |= {(i, j): (REROLE + cut, "R") for to in "ua" for i, j in NEXT[to].items()}
        m |= {(i, j): (KEEP + cut, "K") for i, j in NEXT.get(x.lower(), {}).items()}
    return times(INSERTS, m)


def matrices(rules: list[tuple[str, str, str]]) -> dict:
    """{symbol: matrix} of the letters and, bottom-up, of the rules (left, right, symbol)."""
    out = {x: letter_matrix(x) for x in "suaoSUAOd"}
    for left, right, name in rules:
        out[name] = times(out[left], out[right])
    return out


def compressed(letters: str, rules) -> str:
    for left, right, name in rules:
        letters = letters.replace(left + right, name)
    return letters


def best(state: dict) -> tuple[int, str]:
    """Cost and audit of the cheapest way to an end; ``state``: {(0, j): (cost, audit)} of all rows."""
    last = times(state, INSERTS)
    ways = [(last[0, j][0], text_of(last[0, j][1])) for j in ENDS if (0, j) in last]
    return min(ways)


START = {(0, 0): (0, "")}

# ------------------------------------------------------------------- rows


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows with the faults that crc32 of ``conv_id:turn`` modulo 20 plants."""
    one = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))
    d = conversations.select("conv_id", "turn", F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text"), (F.crc32(key) % 20).alias("f"))
    text = F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    d = d.where("f <> 0").withColumn("text", text).withColumn("role", F.when(F.col("f") == 4, "user").otherwise(F.col("role")))
    return d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("f") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, ord, initial, letter, h1, h2): ``rows`` written in order, ``ord`` numbering them across all
    conversations; ranges of that order, not conversations, are dealt over tasks. ``letter`` is blank for rows without text."""
    text = F.coalesce("text", F.lit(" "))
    r = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("salt"))
    order = ["conv_id", "turn", "role", F.substring("text", 1, PREFIX), F.md5("text"), "salt"]
    r = r.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("ord", F.monotonically_increasing_id())
    cut = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(cut == "", "").when(F.right(cut, F.lit(1)).isin(".", "!", "?"), letter).otherwise(F.upper(letter))
    return stored(r.select("conv_id", "turn", "role", "text", "ord", initial.alias("initial"), letter.alias("letter"),
                           F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.col("text")).alias("h2")), "turns")


SEGMENTS = T.StructType([T.StructField("first", T.LongType()), T.StructField("letters", T.StringType()), *[
    T.StructField(c, T.LongType()) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "min_turn", "max_turn")],
    T.StructField("head", T.StringType()), T.StructField("tail", T.StringType())])
LEGAL = {"su", "ua", "au"}


def _segment(conv, rows) -> tuple:
    """(conv_id and the columns of SEGMENTS) of rows (turn, ord, initial, letter, first of its kind)."""
    blank = sum(r[3] == "" for r in rows)
    dup = sum(r[3] != "" and not r[4] for r in rows)
    letters = "".join(r[3] if r[3] and r[4] else "d" for r in rows)
    bad = sum(a[2] + b[2] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    turns = [r[0] for r in rows if r[0] is not None]
    return (conv, rows[0][1], letters, blank, dup, sum(x.isupper() for x in letters), bad, len(set(turns)), min(turns, default=None),
            max(turns, default=None), rows[0][2], rows[-1][2])


def segments(rows: DataFrame) -> DataFrame:
    """A row for each run of at most SEGMENT rows of a conversation that a task has: its letters and counts."""
    conv = rows.schema["conv_id"]
    schema = T.StructType([conv, *SEGMENTS])
    new = rows.groupBy("conv_id", "role", "h1", "h2").agg(F.min("ord").alias("ord")).select("ord", F.lit(True).alias("new"))
    narrow = rows.select("conv_id", "turn", "ord", "initial", "letter").join(new, "ord", "left")
    narrow = narrow.select("conv_id", "turn", "ord", "initial", "letter", F.coalesce("new", F.lit(False)).alias("new"))

    def run(batches):
        held, of = [], None

        def flush():
            while held:
                yield _segment(of, held[:SEGMENT])
                del held[:SEGMENT]
        for b in batches:
            out = []
            cols = [c.to_pylist() for c in b.columns]
            for c, group in groupby(zip(*cols, strict=True), key=lambda r: r[0]):
                if held and c != of:
                    out += flush()
                of = c
                held += [r[1:] for r in group]
                while len(held) > SEGMENT:
                    out.append(_segment(of, held[:SEGMENT]))
                    del held[:SEGMENT]
            yield _batch(out, schema)
        yield _batch(list(flush()), schema)
    return stored(map_arrow(narrow.repartitionByRange("ord").sortWithinPartitions("ord"), run, schema), "segments")


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema
    to = to_arrow_schema(schema)
    cols = list(zip(*rows, strict=True)) or [[] for _ in to]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, to, strict=True)], schema=to)


def learn(segs: DataFrame, max_rules: int = MAX_RULES, min_pairs: int = MIN_PAIRS) -> list[tuple[str, str, str]]:
    """Re-Pair rules (left, right, new symbol) from the letters of all segments: the most frequent pairs of
    neighbours, counted over the distinct strings. A round takes several pairs that share no symbol; what reaches the driver are
    the counts of a round's leading pairs."""
    forms = stored(segs.groupBy("letters").agg(F.count("*").alias("n")), "letter-forms")
    rules: list[tuple[str, str, str]] = []
    while len(rules) < max_rules:
        def count(batches, rules=tuple(rules)):
            for b in batches:
                pairs = Counter()
                for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    s, at = compressed(s, rules), -2
                    for k in range(len(s) - 1):
                        if s[k] == s[k + 1] and at == k - 1 and s[k - 1] == s[k]:
                            continue  # aaa has one aa
                        at = k
                        pairs[s[k:k + 2]] += n
                yield pa.RecordBatch.from_arrays([pa.array(list(pairs), pa.string()), pa.array(list(pairs.values()), pa.int64())], ["pair", "n"])
        top = map_arrow(forms, count, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
        top = top.where(F.col("n") >= min_pairs).orderBy(F.desc("n"), "pair").limit(4 * RULES_PER_ROUND).collect()
        used, before = set(), len(rules)
        for r in top:
            if len(rules) < min(max_rules, before + RULES_PER_ROUND) and not used & set(r.pair):
                used |= set(r.pair)
                rules.append((r.pair[0], r.pair[1], chr(0xE000 + len(rules))))
        if len(rules) == before:
            break
    return rules


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has rows; ``rows`` as
    ``ordered`` returns them. The segments of a conversation stream through one task in order."""
    segs = segments(rows)
    rules = learn(segs)
    schema = T.StructType([rows.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("audit", T.StringType())])

    def run(batches):
        of, cells, state, done = matrices(rules), None, None, {}

        def after(state, letters):
            """The state row after a segment; short forms from the start are met again and again."""
            short = state is START and len(letters) <= 64
            if short and letters in done:
                return done[letters]
            out = state
            for x in compressed(letters, rules):
                out = times(out, of[x])
            if short and len(done) < 100_000:
                done[letters] = out
            return out

        def ended(c):
            gaps = 0 if c["lo"] is None else c["hi"] - c["lo"] + 1 - c["turns"]
            return (c["conv"], gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], *best(state))
        for b in batches:
            out = []
            for r in b.to_pylist():
                if cells is None or cells["conv"] != r["conv_id"]:
                    if cells is not None:
                        out.append(ended(cells))
                    cells, state = {"conv": r["conv_id"], "lo": None, "hi": None, "turns": 0, "tail": None} | dict.fromkeys(COUNTS, 0), START
                for c in ("blank", "duplicate", "truncated", "illegal"):
                    cells[c] += r[c]
                cells["illegal"] += cells["tail"] is not None and cells["tail"] + r["head"] not in LEGAL
                cells["tail"] = r["tail"]
                if r["min_turn"] is not None:
                    cells["turns"] += r["turns"] - (cells["hi"] == r["min_turn"])
                    cells["lo"], cells["hi"] = r["min_turn"] if cells["lo"] is None else cells["lo"], r["max_turn"]
                state = after(state, r["letters"])
            yield _batch(out, schema)
        yield _batch([ended(cells)] if cells is not None else [], schema)
    return map_arrow(segs.repartition("conv_id").sortWithinPartitions("conv_id", "first"), run, schema)


def _replayed(rows: DataFrame, audit: DataFrame, ids: DataFrame | None, emit, schema: T.StructType) -> DataFrame:
    """Stream each conversation, its audit first, then its rows in order; ``emit`` gets (conv_id, the audit's row or None, an
    iterator of the repaired (role, text, edit)) and yields result rows."""
    none = [F.lit(None).cast("string").alias(c) for c in ("role", "text")]
    no = [F.lit(None).cast("long").alias(c) for c in COUNTS] + [F.lit(None).cast("string").alias("audit")]
    parts = audit.select("conv_id", F.lit(-1).cast("long").alias("ord"), *none, *COUNTS, "audit").unionByName(rows.select("conv_id", "ord", "role", "text", *no))
    if ids is not None:
        parts = parts.unionByName(ids.select("conv_id", F.lit(-2).cast("long").alias("ord"), *none, *no))

    def stream(batches):
        for b in batches:
            yield from zip(*[c.to_pylist() for c in b.columns], strict=True)

    def edited(audit, rows):
        last, rows = None, iter(rows)
        for e in audit:
            role, text = ("", "") if e == "I" else next(rows)[2:4]
            if e == "D":
                continue
            if e != "K":
                role = "assistant" if last == "u" else "user"
            last = role[0]
            yield role, text, e

    def run(batches):
        out = []
        for conv, group in groupby(stream(batches), key=lambda r: r[0]):
            head = next(group)
            if head[1] == -2:
                head = next(group, None)
            for r in emit(conv, head, edited(head[-1], group) if head else iter(())):
                out.append(r)
                if len(out) == 1000:
                    yield _batch(out, schema)
                    out = []
        yield _batch(out, schema)
    return map_arrow(parts.repartition("conv_id").sortWithinPartitions("conv_id", "ord"), run, schema)


def repaired(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text, edit): the rows of each conversation after its cheapest edits."""
    schema = T.StructType([rows.schema["conv_id"], T.StructField("pos", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("role", "text", "edit")]])

    def emit(conv, head, rows):
        for k, r in enumerate(rows):
            yield conv, k, *r
    return _replayed(rows, audit, None, emit, schema)


def report(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conv_id of
    ``conversations``, with (``damage``) the planted faults. One without rows has zeros, an empty audit, and the empty string's hash."""
    rows = ordered(damaged(conversations) if damage else conversations)
    ids = conversations.select("conv_id").distinct()
    schema = T.StructType([rows.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in COUNTS],
                           *[T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256")]])

    def emit(conv, head, rows):
        h = hashlib.sha256()
        for k, (role, text, _) in enumerate(rows):
            h.update(f"{chr(10) if k else ''}{role}:{text}".encode())
        yield conv, *(head[4:] if head else (0,) * len(COUNTS) + ("",)), h.hexdigest()
    return _replayed(rows, stored(audits(rows), "audits"), ids, emit, schema)


def oracle() -> str:
    """The same for ``report`` over ``conversations``: the programme row by row over the four states, without rules."""
    def add(s, cost, edit):
        return f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}'}}"

    def when(test, x):
        return f"CASE WHEN {test} THEN {x} ELSE {far} END"
    far = "{'c': 1000000000000, 'a': ''}"
    live, cut = "x <> 'd'", "(CASE WHEN x <> lower(x) THEN 5 ELSE 0 END)"
    t2 = f"least(s2, {add('s0', 5, 'I')}, {add('s1', 5, 'I')}, {add('s3', 5, 'I')})"
    t3 = f"least(s3, {add('s2', 5, 'I')}, {add('s0', 10, 'II')}, {add('s1', 10, 'II')})"
    to_user = [when(f"lower(x) = 'u' AND {live}", add(t, cut, "K")) for t in ("t0", "t1", "t3")] + [when(live, add(t, f"1 + {cut}", "R")) for t in ("t0", "t1", "t3")]
    n1 = f"least({add('t1', 2, 'D')}, {when("lower(x) = 's'", add('t0', cut, 'K'))})"
    n2 = f"least({add('t2', 2, 'D')}, {', '.join(to_user)})"
    n3 = f"least({add('t3', 2, 'D')}, {when("lower(x) = 'a'", add('t2', cut, 'K'))}, {when(live, add('t2', f'1 + {cut}', 'R'))})"
    return rf"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b:
    list_reduce(list_prepend(xor(c, b), range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END))) % 20 AS f FROM conversations),
e AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM d, (SELECT unnest([1, 2]) AS copy) WHERE f <> 0 AND (copy = 1 OR f = 3)),
r AS (SELECT *, left(role, 1) AS ini, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, {PREFIX}), md5(text)) AS k FROM e),
l AS (SELECT *, t = '' AS is_blank, t <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS is_dup,
        lag(ini) OVER (PARTITION BY conv_id ORDER BY k) AS prev FROM r),
x AS (SELECT *, CASE WHEN is_blank OR is_dup THEN 'd' WHEN right(t, 1) IN ('.', '!', '?') THEN y ELSE upper(y) END AS x
      FROM (SELECT *, CASE WHEN ini IN ('s', 'u', 'a') THEN ini ELSE 'o' END AS y FROM l)),
w AS (SELECT conv_id, 0::BIGINT AS k, {{'c': 0::BIGINT, 'a': ''}} AS s0, {far} AS s1, {far} AS s2, {far} AS s3 FROM conversations GROUP BY 1
      UNION ALL
      SELECT conv_id, k, {add('t0', 2, 'D')}, {n1}, {n2}, {n3}
      FROM (SELECT w.conv_id, x.k, x.x, s0 AS t0, s1 AS t1, {t2} AS t2, {t3} AS t3 FROM w JOIN x ON w.conv_id IS NOT DISTINCT FROM x.conv_id AND x.k = w.k + 1)),
b AS (SELECT conv_id, least(s0, {t3}) AS best FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1),
a AS (SELECT conv_id, best.c AS cost, best.a AS audit FROM b),
o AS (SELECT conv_id, e, p, sum(CASE WHEN e = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) AS k,
        sum(CASE WHEN e = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) AS j
      FROM (SELECT conv_id, unnest(string_split(audit, '')) AS e, generate_subscripts(string_split(audit, ''), 1) AS p FROM a WHERE audit <> '')),
q AS (SELECT o.*, x.role, x.text, max(CASE WHEN j = 1 AND e = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY o.conv_id) AS sys
      FROM o LEFT JOIN x ON o.conv_id IS NOT DISTINCT FROM x.conv_id AND o.k = x.k AND o.e <> 'I'),
h AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (j - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS lines
      FROM q WHERE e <> 'D' GROUP BY 1),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_dup) AS duplicate,
        count(*) FILTER (x <> lower(x)) AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM a LEFT JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON a.conv_id IS NOT DISTINCT FROM h.conv_id"""
