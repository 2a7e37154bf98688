"""The operators against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pytest
import tiktoken
import xxhash

from mentionflow.llm import (byte_bpe, compression_quality, distribution_divergence, fuzzy_lines, pu_toxicity, simhash, template_decontamination,
                             viterbi_counts, warc_derivatives, weak_pii)
from mentionflow.llm.common import components

SMALL, MID, LABELLED = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def table(spark, name="documents", sf=SMALL):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2200)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges + [(7, 7)], "a bigint, b bigint")).collect())
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: r for n, r in roots({x for e in edges for x in e}, edges).items() if n in linked}


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rng = random.Random(3)
    base = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(50)) for _ in range(400)]
    texts = [" ".join(base)]
    for _ in range(60):
        own = list(base)
        own[rng.randrange(400)] = "CHANGED" + str(rng.randrange(9))
        texts.append("\t".join(own))
    texts += [" ".join(rng.choice(base) for _ in range(rng.randrange(1, 60))) for _ in range(60)] + ["", "É Ü", "a b"]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in simhash.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    fp = {i: slow_fingerprint(t) for i, t in rows}
    assert {i: r.fp % 2 ** 64 for i, r in got.items()} == fp
    edges = [(a, b) for a in fp for b in fp if a < b and bin(fp[a] ^ fp[b]).count("1") <= 2]
    assert {i: r.component_id for i, r in got.items()} == roots(fp, edges)
    assert len(set(roots(fp, edges).values())) < len(texts)


@pytest.mark.parametrize("max_bits", [1, 2])
def test_pigeonring_links_lose_nothing(spark, max_bits):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for n in (1, 2, 3):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = [f - 2 ** 64 if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    got = [tuple(r) for r in simhash.links(df, max_bits).collect()]
    near = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % 2 ** 64).count("1") <= max_bits]
    assert all(bin((a ^ b) % 2 ** 64).count("1") <= max_bits for a, b in got)
    assert roots(signed, got) == roots(signed, near)


@pytest.mark.parametrize("chunk,overlap", [(65536, 512), (200, 20), (40, 6)])
def test_byte_bpe_as_tiktoken(spark, chunk, overlap):
    import public_tokenizers as p
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=byte_bpe.load_ranks(p.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    rng = random.Random(chunk)
    odd = ["x" * 500, " " * 300 + "a", "it's they're we'll " * 30, "\n\n\n  \n x " * 40, "<|endoftext|>" * 20, "日本🙂 é " * 40,
           "".join(rng.choice(" '\nresvml1.é🙂") for _ in range(3000))]
    docs = table(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(10 ** 6 + i, t) for i, t in enumerate(odd)], "doc_id bigint, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs, chunk_chars=chunk, overlap=overlap))).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_viterbi_as_the_tokenizer_library():
    from tokenizers import Tokenizer, models
    pieces, fallback = viterbi_counts.load_pieces(viterbi_counts._default_path())
    own = viterbi_counts.Counts(pieces, fallback)
    vocab = [("<unk>", -1.0), *[(f"<0x{i:02X}>", -1.0) for i in range(256)], *pieces]
    other = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    rng = random.Random(1)
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SMALL}/documents.parquet'").fetchall()]
    texts += ["", "  ", " a \n b", "日本語 🙂🙂 x", "\x00 a", "a" * 50, "▁▁ x▁ ▁y"] + ["".join(rng.choice(" abthe▁🙂é\n") for _ in range(60)) for _ in range(200)]
    for t in texts:
        assert own.of(t)[1] == len(other.encode(t.replace(" ", "▁"), add_special_tokens=False).ids), t[:80]
    ties = viterbi_counts.Counts((("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -2.0), ("bc", -2.0), ("abc", -3.0)), True)
    lib = Tokenizer(models.Unigram([("<unk>", -9.0), *[(f"<0x{i:02X}>", -9.0) for i in range(256)], ("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -2.0),
                                    ("bc", -2.0), ("abc", -3.0)], unk_id=0, byte_fallback=True))
    for t in ("abc", "abcabc", "cab", "bcb", "aabbcc"):
        assert ties.of(t)[1] == len(lib.encode(t).ids)


def test_divergence_base_rules(spark):
    got = {r.doc_id: r for r in distribution_divergence.judge(table(spark)).collect()}
    for doc, text in duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall():
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        n = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        twice = {j for i in range(len(w) - 7) if n[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice))
        assert r.base_failed == (len(w) < 20 or 100 * len(twice) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_divergence_verdicts(spark):
    """On labelled rows: clean documents stay, most junk goes."""
    d = table(spark, sf=MID).join(table(spark, "labels", MID), "doc_id").drop("toxic")
    rows = distribution_divergence.judge(table(spark, sf=MID)).join(d.select("doc_id", "quality").distinct(), "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1 and not r.base_failed], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.995 * len(good) and sum(r.kept for r in bad) <= 0.2 * len(bad)


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(d) <= 19 and luhn,
            "phone": 9 <= len(d) <= 15}[kind]


def test_pii_base_spans(spark):
    rng = random.Random(3)
    odd = ["".join(rng.choice(["1", "2", "55", ".", ".", "-", " ", "@", "a", "b", "_", "+", "(", "é", "\n", "4111111111111111", "🙂"])
                   for _ in range(rng.choice([5, 20, 60]))) for _ in range(600)]
    odd += ["1." * 5000, "1 " * 5000, "a@b" + ".c" * 3000, "a" * 50000 + "@x", "a@b.c_d@e.f", "a@b..c", "4111 1111-1111 1111, 0255.1.1.1 256.1.1.1"]
    docs = table(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(10 ** 6 + i, t) for i, t in enumerate(odd)], "doc_id bigint, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in weak_pii.digests(weak_pii.detect(docs)).collect():
        spans = sorted((m.start(), o, m.end()) for o, (k, p) in enumerate(BASE) for m in re.finditer(p, texts[r.doc_id]) if passes(k, m.group()))
        text = [f"{BASE[o][0]}:{a}:{e}" for a, o, e in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(text).encode()).hexdigest(), texts[r.doc_id][:100]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(o == k for _, o, _ in spans) for k in range(4))
        assert set(text) <= set(r.spans.split(",")) or not text


def test_pii_weak_labels(spark):
    """EM tells a reliable labeler from a noisy one, and the classifier adds what the base patterns miss."""
    rng = random.Random(2)
    counts = collections.Counter()
    for _ in range(4000):
        personal = rng.random() < 0.4
        votes = [int(personal) if rng.random() < p else 1 - int(personal) for p in (0.95, 0.9, 0.6)] + [2, 2, 2]
        code = 0
        for v in votes:
            code = code * 3 + v
        counts[code] += 1
    _, right, share = weak_pii.reliabilities(counts)
    assert abs(share - 0.4) < 0.06 and right[0][0] > 0.9 and right[2][0] < 0.75
    texts = ["token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", "mail me: john (at) gmail dot com", "call 555-123-4567 now", "meet at noon. all is well", "chapter 12 34"]
    d = spark.createDataFrame(list(enumerate(texts * 20)), "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in weak_pii.digests(weak_pii.detect(d)).collect()}
    assert got[0].startswith("secret:0:") and got[1].startswith("email:") and got[2] == "phone:5:17" and got[3] == ""


def test_pii_candidates_are_whole(spark):
    """Secrets are found without other digits around, and secrets and written-out addresses to their end."""
    texts = ["api_key=aK3bQ9xZ7mP4tL8vN2wR", "Password: " + "aB3" * 300, "john (at) mail dot example dot co dot uk, or so", "meet me at noon. all is well"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: [(c.o, c.s, c.e) for c in r.candidates] for r in weak_pii.spans(d).collect()}
    assert got == {0: [(4, 0, 28)], 1: [(4, 0, 910)], 2: [(0, 0, 40)], 3: []}


def line_sets(docs):
    where = collections.defaultdict(list)
    for doc, text in sorted(docs):
        for pos, line in enumerate(text.split("\n")):
            n = line.strip(" ").lower()
            if len(n) >= fuzzy_lines.MIN_CHARS:
                where[n].append((doc, pos))
    return where


def slow_removed(docs):
    where = line_sets(docs)
    names = list(where)
    sets, seen, edges = [], collections.defaultdict(list), []
    for i, n in enumerate(names):
        s = {n[k:k + fuzzy_lines.SHINGLE] for k in range(len(n) - fuzzy_lines.SHINGLE + 1)}
        for j, both in collections.Counter(j for g in s for j in seen[g]).items():
            if both >= fuzzy_lines.SIMILARITY * (len(s) + len(sets[j]) - both):
                edges.append((j, i))
        sets.append(s)
        for g in s:
            seen[g].append(i)
    groups = collections.defaultdict(list)
    for i, r in roots(range(len(names)), edges).items():
        groups[r] += where[names[i]]
    return {x for g in groups.values() for x in g if x != min(g)}, len(edges)


def test_fuzzy_lines(spark):
    rng = random.Random(11)
    words = [rng.choice("lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod".split()) + str(rng.randrange(40)) for _ in range(400)]
    docs = [(i, r[0]) for i, r in enumerate(duckdb.sql(f"SELECT text FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall())]
    shared = [" ".join(rng.sample(words, 30)) for _ in range(6)]
    for i in range(150):  # one line with many variants: a large bucket
        line = shared[0].split()
        line[rng.randrange(30)] = f"v{i}"
        docs.append((1000 + i, " ".join(line) + "\nshort\n" + shared[i % 6].upper()))
    exact, edges = slow_removed(docs)
    got = {(r.doc_id, int(p)) for r in fuzzy_lines.report(spark.createDataFrame(docs, "doc_id bigint, text string")).collect() for p in r.removed.split(",") if p}
    assert edges > 1000 and got <= exact and len(got) >= 0.98 * len(exact)


def jaccard(a, b):
    a, b = ({x[k:k + fuzzy_lines.SHINGLE] for k in range(len(x) - fuzzy_lines.SHINGLE + 1)} for x in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("edit", ["first", "last", "appended"])
def test_fuzzy_lines_recall_by_length(spark, edit):
    """Lines with one edit that leaves them similar enough are linked, short ones too."""
    rng = random.Random(17)
    pairs = {}
    for size in (20, 25, 30, 40, 60, 100):
        for _ in range(150):
            line = ""
            while len(line) < size:
                line += "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) + " "
            line = line[:size - 1] + "q"
            other = {"first": "#" + line[1:], "last": line[:-1] + "#", "appended": line + "#"}[edit]
            if jaccard(line, other) >= fuzzy_lines.SIMILARITY:
                pairs.setdefault(size, []).append((line, other))
    docs = [(i, "\n".join(p)) for i, p in enumerate(p for x in pairs.values() for p in x)]
    got = {r.doc_id: r.n_removed for r in fuzzy_lines.report(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    at = 0
    for size, own in pairs.items():
        assert sum(got[i] for i in range(at, at + len(own))) >= 0.97 * len(own), size
        at += len(own)
    assert len(pairs) == 6


def test_fuzzy_lines_recall_of_long_lines(spark):
    """Around the borders between the kinds of signatures, with words changed, put in and left out; each size on its own."""
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10)))
    pairs = {}
    for size in (85, 99, 130, 250, 395, 420, 510, 900):
        while len(pairs.setdefault(size, [])) < 60:
            words = [word() for _ in range(size // 6)]
            other = list(words)
            for _ in range(rng.randrange(1, max(2, size // 80))):
                at = rng.randrange(len(other))
                other[at:at + 1] = rng.choice([[], [word()], [other[at], word()]])
            line, other = " ".join(words), " ".join(other)
            if jaccard(line, other) >= fuzzy_lines.SIMILARITY:
                pairs[size].append((line, other))
    docs = [(i, "\n".join(p)) for i, p in enumerate(p for x in pairs.values() for p in x)]
    got = {r.doc_id: r.n_removed for r in fuzzy_lines.report(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    for k, size in enumerate(pairs):
        assert sum(got[i] for i in range(60 * k, 60 * k + 60)) >= 57, size


def test_fuzzy_lines_without_spaces(spark):
    """Unlike URLs with one start share few buckets; similar lines that differ at their start are linked."""
    rng = random.Random(23)
    tail = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(50)) for _ in range(400)]
    docs = [(i, f"https://{t}") for i, t in enumerate(tail)] + [(1000 + i, f"http://{t}") for i, t in enumerate(tail[:40])]
    docs += [(2000, "ein\tlanger\tsatz\tmit\ttabs\tund\tohne\tleerzeichen\tdarin"), (2001, "Xin\tlanger\tsatz\tmit\ttabs\tund\tohne\tleerzeichen\tdarin")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert fuzzy_lines.shared(fuzzy_lines.keyed(fuzzy_lines.signatures(fuzzy_lines.lines_of(d)), fuzzy_lines.BAND_ROWS, 0)).agg({"n": "max"}).first()[0] < 50
    exact, edges = slow_removed(docs)
    got = {(r.doc_id, int(p)) for r in fuzzy_lines.report(d).collect() for p in r.removed.split(",") if p}
    assert edges == 41 and got <= exact and len(got) >= 0.97 * len(exact)


def test_fuzzy_lines_connect_versions_of_hot_lines(spark):
    """Versions of hot lines, most of them unlike: of all similar pairs, found by comparing all, at least 98 % are in one component, and no others are linked."""
    rng = random.Random(29)
    docs = []
    for _ in range(3):
        base = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(24)]
        for _ in range(350):
            line = list(base)
            for at in rng.sample(range(24), rng.choice([1, 2, 3])):
                line[at] = f"{rng.choice('abcdefgh')}{at}"
            docs.append((len(docs), " ".join(line)))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    text = {(r.k1, r.k2): r.norm for r in fuzzy_lines.lines_of(d).collect()}
    names = {f"{a & 2 ** 64 - 1:X}:{b & 2 ** 64 - 1:X}": n for (a, b), n in text.items()}
    lines = sorted(text.values())
    similar = [(a, b) for k, a in enumerate(lines) for b in lines[k + 1:] if jaccard(a, b) >= fuzzy_lines.SIMILARITY]
    made = [(names[r.a], names[r.b]) for r in fuzzy_lines.links(d).collect()]
    got = roots(lines, made)
    assert len(similar) > 1000 and all(jaccard(*p) >= fuzzy_lines.SIMILARITY for p in made)
    assert sum(got[a] == got[b] for a, b in similar) >= 0.98 * len(similar)
    assert len(made) < 30 * len(lines)  # no all-pairs


def test_short_lines_that_repeat(spark):
    """Equal short lines go but for the first; blank ones stay, tabs and carriage returns too."""
    docs = spark.createDataFrame([(1, "Menu\n\n\t\r\nOne more short\nlog in"), (2, " menu\n\n\t\r\nan other\nLog in "), (3, "}\n}\nx")], "doc_id bigint, text string")
    assert {r.doc_id: r.removed for r in fuzzy_lines.report(docs).collect()} == {1: "", 2: "0,4", 3: "1"}


def test_removed_lines_leave_the_text(spark):
    docs = spark.createDataFrame([(1, "This line is said twice here.\nand a unique one that stays", 1), (2, "x\nThis line is said twice here.\n", 2), (3, "This line is said twice HERE.", 3)],
                                 "doc_id bigint, text string, n_chars bigint")
    out = {r.doc_id: (r.text, r.n_chars) for r in fuzzy_lines.dedup_lines(docs).collect()}
    assert out == {1: ("This line is said twice here.\nand a unique one that stays", 1), 2: ("x\n", 2), 3: ("", 0)}


def test_decontamination(spark):
    docs, bench = table(spark, sf=MID), table(spark, "benchmark", MID)
    got = {(r.doc_id, r.item_id) for r in template_decontamination.matches(docs, bench).collect()}
    true = set(duckdb.sql(f"SELECT doc_id, item_id FROM '{MID}/documents.parquet' d JOIN '{MID}/benchmark.parquet' b ON contains(d.text, b.text)").fetchall())
    assert got == true and len(true) > 10
    item = "A train leaves the old town of Bern at 8 hours and drives 120 km to the lake near Thun, so how far does Anna ride in 3 hours on it?"
    same = item.replace("Bern", "Lyon").replace("Thun", "Metz").replace("120", "95").replace("Anna", "Paul")
    twisted = "At 5 km from Rome and 7 km from Rome lies a town; it has 5 towers and 7 gates, and from Rome to Rome the way is 5 km of stone and 5 km of sand."
    broken = twisted.replace("7 km from Rome lies", "7 km from Oslo lies").replace("5 towers", "6 towers")
    b = spark.createDataFrame([(1, item), (2, twisted)], "item_id bigint, text string")
    d = spark.createDataFrame([(1, "Well. " + same + " Good."), (2, broken), (3, "no question at all, only words that go on and on and on"), (4, item), (5, twisted)], "doc_id bigint, text string")
    out = {(r.doc_id, r.item_id): r.reparameterised for r in template_decontamination.matches(d, b).collect()}
    # (2, 2) has 21 words of its item in a row, from "towers" to the end
    assert out == {(1, 1): True, (2, 2): False, (4, 1): False, (5, 2): False}


def test_decontamination_in_any_case(spark):
    """All benchmark items are found in upper, lower and title case, and nothing in documents without one."""
    items = duckdb.sql(f"SELECT item_id, text FROM '{MID}/benchmark.parquet'").fetchall()
    forms = [str, str.upper, str.lower, str.title]
    docs = [(1000 * f + i, "Some words before it. " + forms[f](t) + " And after.") for i, t in items for f in range(4)]
    got = {(r.doc_id, r.item_id) for r in template_decontamination.matches(spark.createDataFrame(docs, "doc_id bigint, text string"), table(spark, "benchmark", MID)).collect()}
    assert got >= {(1000 * f + i, i) for i, _ in items for f in range(4)} and len(items) == 40


def test_decontamination_without_windows(spark):
    """Formulas and lists are found verbatim, items of a few words where they are a line; one word is no item."""
    items = [(1, "12 + 30 = 42 km"), (2, "Anna, Paul, Bern, Oslo, Rome and Lyon"), (3, "Name the capital"), (4, "yes"), (5, "two words")]
    docs = [(1, "what is 12 + 30 = 42 km then"), (2, "they are ANNA, PAUL, BERN, OSLO, ROME AND LYON today"), (3, "line\nname the Capital\nline"),
            (4, "yes\nyes"), (5, "only two words of many in a line"), (6, "two words"), (7, "12 + 31 = 43 km")]
    out = template_decontamination.matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(1, 1), (2, 2), (3, 3), (6, 5)}


def test_decontamination_of_repeated_rows_and_clashing_names(spark):
    from pyspark.sql import functions as F
    text = "Which river runs through the old town of Bern and then north to the Rhine near Basel at last?"
    d = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (3, "")], "doc_id bigint, text string").withColumns({c: F.lit(c) for c in ("id", "pos", "h", "slots", "plain", "total", "item")})
    out = template_decontamination.matches(d, spark.createDataFrame([(1, text), (1, text)], "item_id bigint, text string")).collect()
    assert [(r.doc_id, r.item_id, r.share, r.reparameterised) for r in out] == [(1, 1, 1.0, False)]


def test_decontamination_with_one_value_changed(spark):
    """A conflict of one value leaves the other windows, and two values may become one."""
    long = ("A farmer near the river keeps 12 sheep and a few old goats in the barn behind his house, where the roof was mended last summer by two "
            "friends who came from far away, and every morning before work he counts 12 sheep again while his dog waits at the gate")
    speeds = "One train drives 60 km in the first hour and the other one drives 80 km in the same time, so which of the two is faster?"
    b = spark.createDataFrame([(1, long), (2, speeds)], "item_id bigint, text string")
    d = spark.createDataFrame([(1, long.replace("counts 12", "counts 13")), (2, speeds.replace("60", "70").replace("80", "70"))], "doc_id bigint, text string")
    out = {(r.doc_id, r.item_id): r.reparameterised for r in template_decontamination.matches(d, b).collect()}
    assert out == {(1, 1): False, (2, 2): True}


def labelled():
    rows = duckdb.sql(f"SELECT doc_id, text, quality, toxic FROM '{LABELLED}/documents.parquet' JOIN '{LABELLED}/labels.parquet' USING (doc_id) ORDER BY hash(doc_id)").fetchall()
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    return [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5], held


def test_quality_on_held_out_rows():
    train, held = labelled()
    good, bad = [r[1] for r in train if r[2] == 1], [r[1] for r in train if r[2] == 0]
    k = len(bad) // 3
    m = compression_quality.fit([(t, 1) for t in good[:400]] + [(t, 0) for t in bad[:k]], [(t, 1) for t in good[400:]] + [(t, 0) for t in bad[k:]], (len(bad), len(good)))
    score = compression_quality.scorer(m)
    kept = {q: [score(r[1])[0] >= 0.3 for r in held if r[2] == q] for q in (0, 1)}
    assert sum(kept[1]) >= 0.99 * len(kept[1]) and sum(kept[0]) <= 0.12 * len(kept[0])


def test_the_difference_decides_quality():
    """Ablation: the compressed-size difference alone orders held-out rows nearly as well as the calibrated score; the mean size alone does not."""
    train, held = labelled()
    good, bad = [r[1] for r in train if r[2] == 1], [r[1] for r in train if r[2] == 0]
    k = len(bad) // 3
    m = compression_quality.fit([(t, 1) for t in good[:400]] + [(t, 0) for t in bad[:k]], [(t, 1) for t in good[400:]] + [(t, 0) for t in bad[k:]], (len(bad), len(good)))
    sizes, score = compression_quality._sizes(m), compression_quality.scorer(m)
    points = [(*sizes(r[1]), score(r[1])[0], r[2]) for r in held]

    def area(i):
        ones, zeros = [p[i] for p in points if p[3] == 1], [p[i] for p in points if p[3] == 0]
        a = sum((x > y) + 0.5 * (x == y) for x in ones for y in zeros) / (len(ones) * len(zeros))
        return max(a, 1 - a)
    assert area(0) > 0.99 and area(2) - area(0) < 0.01 and area(1) < area(0) - 0.02


def test_toxicity_on_held_out_rows():
    train, held = labelled()
    prior = sum(r[3] for r in train) / len(train)  # as train() has it
    m = pu_toxicity.fit([r[1] for r in train if r[3] == 1], [r[1] for r in train][:2500], prior)
    score = pu_toxicity.scorer(m)
    hit = {t: [score(r[1])[0] >= 0.5 for r in held if r[3] == t] for t in (0, 1)}
    assert sum(hit[1]) >= 0.9 * len(hit[1]) and sum(hit[0]) <= 0.01 * len(hit[0])


def test_one_of_each_keeps_other_texts_of_an_id(spark):
    a, b = "one two three four five six seven eight nine ten", "entirely other words stand here and nothing is alike at all"
    d = spark.createDataFrame([(1, a, "x"), (1, b, "y"), (1, a, "x"), (2, a, "z"), (3, b, "z"), (4, "a third text on its own, longer than the others by far", "z")],
                              "doc_id bigint, text string, key string")
    got = sorted(tuple(r) for r in simhash.one_of_each(d.repartition(3)).collect())
    assert got == sorted([(1, a, "x"), (1, b, "y"), (4, "a third text on its own, longer than the others by far", "z")])


def test_long_labelled_texts_are_learned_from(spark):
    """A labelled text of 300,000 characters changes both models, and no more of it than its share moves."""
    from mentionflow.llm.common import texts_of
    long = " ".join(f"rare{i % 50} words{i % 7}" for i in range(20000))
    docs = [(i, f"plain text number {i} with some words " * 5) for i in range(60)] + [(1001, long)]
    labels = [(i, i % 2, int(i % 10 == 1)) for i in range(60)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    with_it, without = (spark.createDataFrame(x, "doc_id bigint, quality int, toxic int") for x in (labels + [(1001, 0, 1)], labels))
    assert len(long) > 250_000 and zlib.crc32(b"1001") % 5
    assert compression_quality.train(d, with_it) != compression_quality.train(d, without)
    assert pu_toxicity.train(d, with_it) != pu_toxicity.train(d, without)
    (_, text), = texts_of(d, spark.createDataFrame([(1001,)], "doc_id bigint"), 10, 80_000)
    assert len(text) <= 8000 + 8 and "rare0 " in text


def test_labels_of_the_held_out_fold_change_no_score(spark):
    docs = [(i, ("good prose about the harbour and its ships " if i % 2 else "zxcv qwer !!!! asdf ") * (3 + i % 4)) for i in range(200)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)]
    one, two = (spark.createDataFrame([(i, (i % 2) ^ (flip & held[i]), (i % 2) ^ 1 ^ (flip & held[i])) for i in range(200)], "doc_id bigint, quality int, toxic int") for flip in (0, 1))
    for op in (compression_quality, pu_toxicity):
        a, b = ({r.doc_id: (r.score, r.held_out) for r in op.score(d, op.train(d, x)).collect()} for x in (one, two))
        assert a == b and {i for i, r in a.items() if r[1]} == {i for i in range(200) if held[i]}


def test_warc_round_trip(spark):
    page = ('<html lang="en"><head><title>A &amp; B</title><style>p{}</style></head><body><!-- no --><p>One <b>two</b>&nbsp;three</p>'
            '<script>var x = "<p>";</script><ul><li>four<li>five &lt;6&gt;</ul><a href="/x?a=1&amp;b=2">l</a><a class=c href=\'y\'>m</a><a href="/x?a=1&amp;b=2">n</a></body></html>')
    pages = spark.createDataFrame([(1, "http://h/p", page)], "page_id bigint, url string, html string")
    out = warc_derivatives.derivatives(warc_derivatives.responses_of(pages))
    meta, text = (next(r for r in out.collect() if r.record_type == k) for k in ("metadata", "conversion"))
    parsed = {r.headers["WARC-Type"]: r for r in warc_derivatives.parse(out).collect()}
    assert parsed["conversion"].block.decode().split("\n") == ["One two three", "four", "five <6>", "lmn"]
    lines = parsed["metadata"].block.decode().split("\r\n")
    assert "title: A & B" in lines and lines.count("outlink: /x?a=1&b=2") == 1 and "outlink: y" in lines
    assert "sourceHeader: content-type: text/html; charset=utf-8" in lines
    for k, r in (("metadata", meta), ("conversion", text)):
        h = parsed[k].headers
        assert h["WARC-Refers-To"] == r.refers_to == meta.refers_to and h["WARC-Record-ID"] == r.record_id
        assert h["WARC-Block-Digest"] == warc_derivatives.digest(parsed[k].block) and int(h["Content-Length"]) == len(parsed[k].block)
        assert h["WARC-Source-Payload-Digest"] == warc_derivatives.digest(page.encode())
    assert text.record_id != meta.record_id


def test_warc_keeps_every_header(spark):
    head = "HTTP/1.1 200 OK\r\nDate: Mon, 01 Jan 2024 00:00:00 GMT\r\nX-Robots-Tag: noarchive\r\nContent-Type: text/html\r\nLink: </a>; rel=next\r\nLink: </b>; rel=prev\r\n\r\n"
    one = spark.createDataFrame([(1, "<urn:uuid:1>", "http://h/", "2024-01-01T00:00:00Z", head, "<p>x")],
                                "page_id bigint, record_id string, target_uri string, date string, http_headers string, payload string")
    parsed = {r.headers["WARC-Type"]: r.block.decode() for r in warc_derivatives.parse(warc_derivatives.derivatives(one)).collect()}
    assert [x[14:] for x in parsed["metadata"].split("\r\n") if x.startswith("sourceHeader: ")] == [
        "date: Mon, 01 Jan 2024 00:00:00 GMT", "x-robots-tag: noarchive", "content-type: text/html", "link: </a>; rel=next", "link: </b>; rel=prev"]


def test_pipeline(spark):
    """Each stage on what its predecessor kept, against the same rules by brute force."""
    import corpus_pipeline as c
    docs = table(spark)
    names = docs.columns
    prior, stages = docs, {}
    for name, f in c.STAGES:
        prior = stages[name] = c.stored(f(spark, prior, SMALL), f"test-{name}")
        if name != c.STAGES[-1][0]:
            assert prior.columns == names
    kept = {n: [(r.doc_id, r.text) for r in s.collect()] for n, s in stages.items() if n != "tokens"}
    gone, _ = slow_removed(kept["quality"])
    expect = {d: "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone) for d, t in kept["quality"]}
    assert dict(kept["lines"]) == expect
    fp = {d: slow_fingerprint(t) for d, t in kept["lines"]}
    comp = roots(fp, [(a, b) for a in fp for b in fp if a < b and bin(fp[a] ^ fp[b]).count("1") <= 2])
    assert {d for d, _ in kept["near_duplicates"]} == set(comp.values())
    items = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SMALL}/benchmark.parquet'").fetchall()]
    assert {d for d, _ in kept["decontaminate"]} == {d for d, t in kept["near_duplicates"] if not any(i in t for i in items)}
    out = {r.doc_id: r for r in c.run(spark, SMALL).collect()}
    assert set(out) == {d for d, _ in kept["decontaminate"]}
    assert all(out[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for d, t in kept["decontaminate"])


def test_entry_lists_all():
    from __spark_entry__ import oracle_sql, queries
    names = [n for n in queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in queries()
    assert "op2_distribution_divergence" in oracle_sql()
