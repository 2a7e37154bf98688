"""Personal data by weak supervision: exact base patterns, and further spans on
which regex, gazetteer and context labelers vote; expectation-maximisation
estimates how reliable each labeler is, and the estimated labels train the span
classifier that decides. DataFrame functions only: what reaches the driver are
counts of vote and feature patterns, whose number the code fixes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone", "secret", "name")
#: Base patterns. They find what the plain patterns of the kinds find, leftmost and
#: non-overlapping, but look at each character a bounded number of times: possessive
#: runs begin where a run begins, and repeated groups are written as runs up to a stop.
EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.(?=[A-Za-z0-9-])[A-Za-z0-9.-]*?[A-Za-z0-9-]"
         r"(?=\.\.|\.?[^A-Za-z0-9.-]|\.?\z)")
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?=(?:[\x20-]?[0-9]){11})[0-9\x20-]*?(?<=[0-9])"
        r"(?=[\x20-]{2}|[\x20-]?[^0-9\x20-]|[\x20-]?\z)")  # of 12 digits or more
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Fixed values of the labelers.
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra"
NAMES = """anna ana alice andrea antonio carlos carmen charles claire david elena emma eva felix francisco hans helena henry isabel jack james jean
jose juan julia karl kate laura lea lisa louis lucas lucia luis maria marie mark martin mary max michael miguel nina noah olivia paul peter
pierre robert sara sarah sofia sophie thomas tom william""".split()
PROVIDERS = "gmail googlemail outlook hotmail yahoo icloud proton protonmail gmx web aol mail live msn orange free".split()
NEAR = r"(?i)\b(e-?mail|mail|contact|write|phone|tel|telephone|call|mobile|cell|fax|card|visa|mastercard|amex|credit|account|iban|" \
       r"host|server|address|token|key|secret|password|passwd|pwd|apikey|api_key|auth|bearer|credential|dear|signed|regards)\b"
AWAY = r"(?i)\b(version|isbn|issn|page|pages|vol|volume|chapter|section|figure|fig|table|license|licence|rfc|build|release|line|item|no)\b"
CONTEXT_CHARS = 30

#: Candidates, in the order in which a place is tried: quoted or long secrets, written-out
#: addresses, titles with names, and runs of digit groups, local telephone numbers among them.
_AT = r"\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?"
_DOT = r"(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?|\x20dot\x20)"
CANDIDATE = (r"(?i:\b(?:token|secret|password|passwd|pwd|api_?key|access_?key|key)\b)\x20?[=:]\x20?[\"']?[A-Za-z0-9+/_-]{12,}+"
             r"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+" + _AT + r"[A-Za-z0-9-]{1,63}(?:" + _DOT + r"[A-Za-z0-9-]{1,63}){0,125}" + _DOT + r"[A-Za-z]{2,63}\b"
             r"|\b(?:" + TITLES + r")\.?\x20[A-ZÀ-Ý][a-zà-ÿ]{1,30}(?:\x20[A-ZÀ-Ý][a-zà-ÿ]{1,30})?"
             r"|(?<![0-9+.-])\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,7}){1,4}+(?![0-9])"
             r"|(?<![0-9A-Za-z+])[0-9]{9,19}+(?![0-9A-Za-z])")
#: A place where a candidate may be, of each alternative; texts without one are not searched.
CANDIDATE_HINT = r"[0-9]{2}|(?i:[\[(\x20]at[\])\x20]|(?:token|secret|password|passwd|pwd|key)\x20?[=:])|\b(?:" + TITLES + r")\.?\x20[A-ZÀ-Ý]"

#: Votes: personal, not personal, no opinion.
YES, NO, NONE = 1, 0, 2
LABELERS = ("shape", "gazetteer", "context", "away", "checksum", "plain")
EM_ROUNDS = 100
PRIOR = 0.3
THRESHOLD = 0.5

_FOUND = "array<struct<s:int,e:int,m:string,before:string>>"
#: Matches whose offsets are added up at a time: the work grows with the matches, not with their square.
BLOCK = 64


def _bound(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def find(text: str, pattern: str, possible: Column) -> Column:
    """Matches of ``pattern`` in column ``text`` as (s, e, m, before): code point
    offsets, end exclusive, and the characters before. The parts between the matches give the offsets."""
    m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.from_json(F.lit("[]"), _FOUND)
    zipped = _bound(m, lambda m: F.zip_with(m, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), lambda x, g: F.struct(
        x.alias("m"), g.alias("g"), (F.length(g) + F.length(x)).alias("n"))))

    def step(a, x):
        s = a["at"] + F.length(x["g"])
        own = F.struct(s.alias("s"), (a["at"] + x["n"]).alias("e"), x["m"].alias("m"), F.right(x["g"], F.lit(CONTEXT_CHARS)).alias("before"))
        return F.struct((a["at"] + x["n"]).alias("at"), F.concat(a["out"], F.array(own)).alias("out"))

    def blocks(z):
        return F.transform(F.sequence(F.lit(0), ((F.size(z) - 1) / BLOCK).cast("int")), lambda b: F.slice(z, b * BLOCK + 1, F.lit(BLOCK)))

    def begins(parts):
        """Where each block begins: the sum of those before."""
        return F.aggregate(parts, F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(
            F.element_at(a, -1) + F.aggregate(p, F.lit(0), lambda n, x: n + x["n"]))))

    def offsets(z):
        return F.when(F.size(z) == 0, empty).otherwise(_bound(blocks(z), lambda parts: F.flatten(F.zip_with(
            parts, F.slice(begins(parts), F.lit(1), F.size(parts)), lambda p, at: F.aggregate(
                p, F.struct(at.alias("at"), empty.alias("out")), step, lambda a: a["out"])))))
    return F.when(possible, _bound(zipped, offsets)).otherwise(empty)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check (empty: no)."""
    n = F.length(digits)

    def add(a, i):
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return a + F.when((n - i) % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    return (n > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0)


def _valid_card(x: Column) -> Column:
    d = _digits(x["m"])
    return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)


def _valid_ip(x: Column) -> Column:
    def part(p):
        p = F.regexp_replace(p, "^0+", "")
        return (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255"))
    return F.forall(F.split(x["m"], r"\."), part)


def _valid_phone(x: Column) -> Column:
    return F.length(_digits(x["m"])).between(9, 15)


def _kinded(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("o"), x["e"].alias("e")))


def _vote(yes: Column | None = None, no: Column | None = None) -> Column:
    out = F.lit(NONE)
    if no is not None:
        out = F.when(no, NO).otherwise(out)
    return F.when(yes, YES).otherwise(out) if yes is not None else out


def _labelled(x: Column) -> Column:
    """A candidate with kind, votes and feature code."""
    m, before = x["m"], F.lower(x["before"])
    digits = _digits(m)
    secret = m.rlike(r"(?i)^\(?(token|secret|password|passwd|pwd|api_?key|access_?key|key)\b")
    name = m.rlike(r"^(?:" + TITLES + r")\.?\x20[A-ZÀ-Ý]")
    email = m.rlike(r"(?i)(\(at\)|\[at\]|\x20at\x20)") & ~name & ~secret
    kind = F.when(secret, 4).when(name, 5).when(email, 0).when(F.length(digits) >= 12, 2).otherwise(3)
    grouped = m.rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$")
    value = F.regexp_extract(m, r"[=:]\x20?[\"']?(.*)$", 1)
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.length(value) >= 20)
    words = F.split(F.lower(m), r"[^a-zà-ÿ]+")
    one_digit = digits.rlike(r"^([0-9])\1*$")
    near, away = before.rlike(NEAR), before.rlike(AWAY)
    known = F.arrays_overlap(words, F.array(*map(F.lit, NAMES + PROVIDERS)))
    checked = F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    plain_at = m.rlike(r"(?i)\x20at\x20") & ~m.rlike(r"(?i)\x20dot\x20|\(dot\)|\[dot\]|\.")
    votes = [
        _vote((secret & mixed) | (~secret & ~name & ~email & grouped) | (email & m.rlike(r"(?i)[\[(]at[\])]")), (kind == 3) & ~grouped | plain_at),
        _vote(known, name & ~known),
        _vote(near | secret, None),
        _vote(None, away),
        _vote(checked, (kind == 2) & ~checked),
        _vote(None, one_digit & (F.length(digits) > 0) | (secret & ~mixed)),
    ]
    code = reduce(lambda a, v: a * 3 + v, votes, F.lit(0))
    bucket = F.when(F.length(digits) == 0, 0).when(F.length(digits) < 9, 1).when(F.length(digits) < 12, 2).otherwise(3)
    flags = [grouped, mixed, near | secret, away, known, checked]
    feature = reduce(lambda a, f: a * 2 + f.cast("int"), flags, kind * 4 + bucket)
    return F.struct(x["s"].alias("s"), kind.alias("o"), x["e"].alias("e"), code.alias("votes"), feature.alias("feature"))


N_FLAGS = 6


def spans(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, base, candidates) of every row: arrays of spans (s start, o kind
    number, e end), candidates with their votes and features as codes."""
    d = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t = F.col("t")
    d = d.withColumn("digit", t.rlike("[0-9]"))
    d = d.select(
        id_col, "t", find("t", EMAIL, F.contains(t, F.lit("@"))).alias("email"), find("t", IP, F.col("digit")).alias("ip"),
        find("t", CARD, F.col("digit")).alias("card"), find("t", PHONE, F.contains(t, F.lit("+"))).alias("phone"),
        find("t", CANDIDATE, t.rlike(CANDIDATE_HINT)).alias("more"))
    base = F.sort_array(F.concat(
        _kinded(F.col("email"), "email"), _kinded(F.filter("ip", _valid_ip), "ip"), _kinded(F.filter("card", _valid_card), "card"),
        _kinded(F.filter("phone", _valid_phone), "phone")))
    d = d.select(id_col, base.alias("base"), "more")
    free = F.filter("more", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return d.select(id_col, "base", F.transform(free, _labelled).alias("candidates"))


def _votes(code: int) -> list[int]:
    out = []
    for _ in LABELERS:
        out.append(code % 3)
        code //= 3
    return out[::-1]


def reliabilities(counts: dict[int, int], rounds: int = EM_ROUNDS) -> tuple[dict[int, float], list[tuple[float, float]], float]:
    """EM over vote patterns: (chance of personal for each pattern, for each
    labeler the chance that it votes right on personal and on other spans when it has an opinion, share of personal).
    Counts are smoothed, which also settles which class is which."""
    right, share = [(0.8, 0.8)] * len(LABELERS), PRIOR
    chance: dict[int, float] = {}
    for _ in range(rounds):
        for code in counts:
            p, q = share, 1 - share
            for v, (a, b) in zip(_votes(code), right, strict=True):
                if v != NONE:
                    p, q = p * (a if v == YES else 1 - a), q * (b if v == NO else 1 - b)
            chance[code] = p / (p + q)
        new = []
        for i in range(len(LABELERS)):
            yes = [8.0, 2.0, 2.0, 8.0]  # personal voted yes, personal voted no, other voted yes, other voted no
            for code, n in counts.items():
                v = _votes(code)[i]
                if v != NONE:
                    yes[0 if v == YES else 1] += n * chance[code]
                    yes[2 if v == YES else 3] += n * (1 - chance[code])
            new.append((yes[0] / (yes[0] + yes[1]), yes[3] / (yes[2] + yes[3])))
        total = sum(counts.values())
        share_new = (sum(n * chance[c] for c, n in counts.items()) + 10 * PRIOR) / (total + 10)
        moved = max([abs(share - share_new), *(abs(x - y) for a, b in zip(right, new, strict=True) for x, y in zip(a, b, strict=True))])
        right, share = new, share_new
        if moved < 1e-7:
            break
    return chance, right, share


def _inputs(feature: int) -> list[int]:
    """Numbers of the classifier's inputs that are on: one for kind and digit bucket, one for each flag."""
    on = [len(KINDS) * 4 + i for i in range(N_FLAGS) if feature >> (N_FLAGS - 1 - i) & 1]
    return [feature >> N_FLAGS, *on]


def classifier(rows: list[tuple[int, float, float]], rounds: int = 400, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Weights (the last is the bias) of a logistic regression on the labels that EM
    estimated: ``rows`` are (feature code, spans, sum of their chances)."""
    w = [0.0] * (len(KINDS) * 4 + N_FLAGS + 1)
    total = sum(n for _, n, _ in rows) or 1
    for _ in range(rounds):
        g = [decay * x for x in w]
        for feature, n, s in rows:
            on = [*_inputs(feature), len(w) - 1]
            z = sum(w[i] for i in on)
            e = (n / (1 + math.exp(-max(-30.0, min(30.0, z)))) - s) / total
            for i in on:
                g[i] += e
        w = [x - rate * 4 * y for x, y in zip(w, g, strict=True)]
    return w


def detect(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, base, added) of every row of ``docs``: the base spans, and the
    candidates that the classifier takes for personal, which overlap no base span.

    The labelers' votes on all candidates of all rows are counted by pattern (3^6 at most) for the EM,
    features by pattern (1536 at most) for the classifier. NULL and empty texts have no
    spans; repeated rows count each; other columns are not read; an empty table gives none."""
    found = stored(spans(docs, id_col, text_col), "pii-spans")
    c = found.select(F.explode("candidates").alias("c")).select("c.votes", "c.feature") \
        .groupBy("votes", "feature").agg(F.count("*").alias("n"))
    # at most 3^6 * 1536 pairs in principle; the votes follow from the features but for a few flags, so a few hundred
    rows = [tuple(r) for r in c.collect()]
    by_vote: dict[int, int] = {}
    for v, _, n in rows:
        by_vote[v] = by_vote.get(v, 0) + n
    chance, _, _ = reliabilities(by_vote)
    by_feature: dict[int, tuple[float, float]] = {}
    for v, f, n in sorted(rows):
        a, b = by_feature.get(f, (0.0, 0.0))
        by_feature[f] = (a + n, b + n * chance[v])
    w = classifier([(f, n, s) for f, (n, s) in sorted(by_feature.items())])

    def personal(x):
        f = x["feature"]
        z = F.element_at(F.array(*[F.lit(v) for v in w[:len(KINDS) * 4]]), F.shiftright(f, N_FLAGS) + 1) + w[-1]
        for i in range(N_FLAGS):
            z = z + F.when(F.shiftright(f, N_FLAGS - 1 - i) % 2 == 1, F.lit(w[len(KINDS) * 4 + i])).otherwise(0.0)
        return z >= math.log(THRESHOLD / (1 - THRESHOLD))
    added = F.transform(F.filter("candidates", personal), lambda x: F.struct(x["s"].alias("s"), x["o"].alias("o"), x["e"].alias("e")))
    return found.select(id_col, "base", added.alias("added"))


def _text_of(column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.element_at(kinds, x["o"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digests(detected: DataFrame, id_col="doc_id") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of the rows of ``detect``."""
    counts = [F.size(F.filter("base", _of_kind(o))).cast("long").alias(f"n_{KINDS[o]}") for o in range(4)]
    return detected.select(id_col, *counts, F.sha2(_text_of("base"), 256).alias("base_sha256"),
                           _text_of(F.sort_array(F.concat("base", "added"))).alias("spans"))


def _of_kind(o: int):
    return lambda x: x["o"] == o
