"""Benchmark decontamination by template: numbers, names and units become typed
placeholders, template windows of documents and benchmark items are hash-joined,
and each value in the slots must map to one, which catches questions that
were asked again with other parameters.

Next to the templates there are plain windows, of the words themselves in lower case: they find verbatim passages whatever
the slots around them do, and copies in other case, where names can't be told. An item of fewer words than a window
(two at least) is found where it is a whole line."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stored, strings

WINDOW = 5
#: Words of a window that must be no placeholder.
MIN_PLAIN = 3
#: A document holds an item if so much of its windows match, or so many in a row (13 words).
MIN_SHARE = 0.8
MIN_RUN = 9
#: Bits of the filter that documents are checked against before the join: 512 KB at any benchmark size.
FILTER_BITS = 22
#: Benchmark windows up to this many are broadcast to the join (about 150 bytes each); beyond, both sides are shuffled.
BROADCAST_WINDOWS = 200_000
#: Distinct raw words a task remembers.
REMEMBERED = 300_000
#: Words handled at a time.
PART_WORDS = 200_000

NUM, NAME, UNIT = 1, 2, 3
EDGE = ".,;:!?\"'()[]{}¶*#%&|<>~`“”‘’«»¿¡"
NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(?:st|nd|rd|th|k|m|bn)?$", re.I)
NUMBER_WORDS = frozenset("""zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion""".split())
UNITS = frozenset("""mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg lb lbs oz pound pounds ton tons ml l litre litres
liter liters s sec second seconds min minute minutes h hour hours day days week weeks month months year years cent cents dollar
dollars euro euros usd eur gbp percent % degrees °c °f mph kph km/h hz khz mhz ghz kb mb gb tb""".split())
MIX = np.uint64(0x9E3779B97F4A7C15)
PLAIN = np.uint64(0x5851F42D4C957F2D)


class Canonical(dict):
    """Code of each raw word, remembered within a task; the arrays tell, by
    code, the hash of the word, its kind at the start of a sentence and inside one, whether it is a
    unit, and whether it ends a sentence."""

    def __init__(self, window: int = WINDOW, min_plain: int = MIN_PLAIN):
        super().__init__()
        self.window, self.min_plain = window, min_plain
        self.hash, self.flags = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint8)

    def __missing__(self, raw: str) -> int:
        code = len(self)
        if code >= len(self.hash):
            self.hash, self.flags = np.resize(self.hash, 2 * code), np.resize(self.flags, 2 * code)
        word = raw.strip(EDGE)
        low = word.lower()
        number = bool(NUMBER.match(word)) or low in NUMBER_WORDS
        capital = len(word) > 1 and word[0].isupper() and word[1:].islower()
        self.hash[code] = xxhash.xxh64_intdigest(low.encode("utf-8", "replace"), 7)
        self.flags[code] = number | capital << 1 | (low in UNITS) << 2 | raw.rstrip("\"')]”’»").endswith((".", "!", "?", "¶")) << 3 | raw.endswith("¶") << 4
        self[raw] = code
        return code

    def windows(self, words: list[str], ends: np.ndarray):
        """Of texts that end before the positions ``ends``: kinds, (hashes of the template windows from each word on, which of them lie in
        one text and have words enough), the same of plain windows, and (starts, hashes) of the lines that are shorter than a window."""
        if len(self) > REMEMBERED:
            self.clear()
        n = len(words)
        codes = np.fromiter(map(self.__getitem__, words), np.int64, n)
        f = self.flags[codes]
        number, first = f & 1 > 0, np.ones(n, bool)
        first[1:] = f[:-1] & 8 > 0  # begins a sentence: a capital tells nothing
        starts = np.append(0, ends[:-1])
        first[starts[starts < n]] = True
        kinds = np.where(number, NUM, np.where((f & 2 > 0) & ~first, NAME, 0)).astype(np.uint8)
        kinds[1:][(f[1:] & 4 > 0) & number[:-1] & ~first[1:]] = UNIT
        h = np.where(kinds > 0, kinds.astype(np.uint64), self.hash[codes])
        m = max(0, n - self.window + 1)
        acc, plain, own = np.zeros(m, np.uint64), np.zeros(m, np.int8), np.full(m, PLAIN, np.uint64)
        for i in range(self.window):
            acc = (acc ^ h[i:i + m]) * MIX
            acc ^= acc >> np.uint64(29)
            own = (own ^ self.hash[codes[i:i + m]]) * MIX
            own ^= own >> np.uint64(29)
            plain += kinds[i:i + m] == 0
        inside = np.repeat(ends, np.diff(np.append(0, ends)))[:m] - np.arange(m) >= self.window
        return kinds, (acc, inside & (plain >= self.min_plain)), (own, inside), self._lines(codes, f, ends)

    def _lines(self, codes: np.ndarray, f: np.ndarray, ends: np.ndarray):
        stops = np.union1d(np.flatnonzero(f & 16) + 1, ends[ends > 0])
        starts = np.append(0, stops)[:-1]
        short = (stops - starts < self.window) & (stops - starts > 1)
        starts, size = starts[short], (stops - starts)[short]
        h = size.astype(np.uint64) * PLAIN
        for i in range(self.window - 1):
            on = size > i
            step = (h[on] ^ self.hash[codes[starts[on] + i]]) * MIX
            h[on] = step ^ step >> np.uint64(29)
        return starts, h

    def slots(self, words: list[str], kinds: np.ndarray, at: int) -> list[str]:
        return [f"{kinds[i]}:{words[i].strip(EDGE).lower()}" for i in range(at, at + self.window) if kinds[i]]


def _in_parts(texts: list[str]):
    """(number of the first text, words, ends of the texts) of some texts at a time."""
    words, ends, first = [], [], 0
    for i, text in enumerate(texts):
        words += text.replace("\n", "¶ ").split()
        ends.append(len(words))
        if len(words) >= PART_WORDS or i == len(texts) - 1:
            yield first, words, np.array(ends)
            words, ends, first = [], [], i + 1


def windows(rows: DataFrame, id_col: str, text_col="text", window: int = WINDOW, min_plain: int = MIN_PLAIN,
            passing: np.ndarray | None = None) -> DataFrame:
    """(id, pos, h, slots, plain, total, total_plain) of the template windows of every text, of its plain windows (no slots) and of
    its short lines, the totals being the numbers of the first and of the others in the text; ``passing``: only those whose hash has its bit in this filter."""
    def run(batches):
        canonical = Canonical(window, min_plain)
        for b in batches:
            for offset, words, ends in _in_parts(strings(b.column(1))):
                kinds, (h, good), (own, inside), (line, line_h) = canonical.windows(words, ends)
                at = [np.flatnonzero(good), np.flatnonzero(inside), line]
                hashes = [h[at[0]], own[at[1]], line_h]
                total, plain, lines = (np.bincount(np.searchsorted(ends, x, "right"), minlength=len(ends)) for x in at)
                if passing is None:  # an item is found by a line only if it has no window
                    only = plain[np.searchsorted(ends, line, "right")] == 0
                    at[2], hashes[2] = line[only], line_h[only]
                plain = np.where(plain > 0, plain, lines)
                if passing is not None:
                    for k, x in enumerate(hashes):
                        slot = x >> np.uint64(64 - FILTER_BITS)
                        hit = (passing[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
                        at[k], hashes[k] = at[k][hit], x[hit]
                slots = [canonical.slots(words, kinds, p) for p in at[0].tolist()] + [[]] * (len(at[1]) + len(at[2]))
                is_plain = np.arange(len(slots)) >= len(at[0])
                at, h = np.concatenate(at).astype(np.int64), np.concatenate(hashes)
                row = np.searchsorted(ends, at, "right")
                starts = np.append(0, ends[:-1])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row + offset)), pa.array((at - starts[row]).astype(np.int32)), pa.array(h.view(np.int64)),
                     pa.array(slots, pa.list_(pa.string())), pa.array(is_plain), pa.array(total[row].astype(np.int32)), pa.array(plain[row].astype(np.int32))],
                    ["id", "pos", "h", "slots", "plain", "total", "total_plain"])

    kind = rows.schema[id_col].dataType.simpleString()
    return map_arrow(rows.select(id_col, text_col), run, f"id {kind}, pos int, h bigint, slots array<string>, plain boolean, total int, total_plain int")


def _filter(items: DataFrame) -> np.ndarray:
    """Bit filter of the window hashes; its size doesn't depend on theirs."""
    slot = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    words = items.select(F.shiftright(slot, 6).alias("w"), slot.alias("s")) \
        .select("w", F.expr("shiftleft(1L, cast(s % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for r in words:
        out[r["w"]] = np.uint64(r["b"] & 0xFFFFFFFFFFFFFFFF)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text",
            window: int = WINDOW, min_plain: int = MIN_PLAIN, min_share: float = MIN_SHARE, min_run: int = MIN_RUN) -> DataFrame:
    """(id, item, n_windows, item_windows, share, longest, reparameterised) of
    the documents that hold a benchmark item.

    Windows that match at one offset form an alignment; those of its windows count
    whose slots' item values have one value each in the document, and all plain ones. An item is held if windows
    that count cover ``min_share`` of its template windows or of its plain ones, or one alignment has ``min_run`` of them. NULL and empty
    texts and NULL ids match nothing; repeated rows of one id are one
    document; an empty benchmark gives no rows."""
    items = windows(benchmark.where(F.col(item_col).isNotNull()), item_col, item_text, window, min_plain)
    items = stored(items.select(F.col("id").alias("item"), F.col("pos").alias("item_pos"), "h", F.col("slots").alias("item_slots"),
                                "total", "total_plain"), "benchmark-windows")
    passing, n = _filter(items), items.count()
    own = windows(docs.where(F.col(id_col).isNotNull()), id_col, text_col, window, min_plain, passing).drop("total", "total_plain")
    joined = own.join(F.broadcast(items) if n <= BROADCAST_WINDOWS else items, "h")
    pairs = F.zip_with("item_slots", "slots", lambda i, d: F.struct(i.alias("i"), d.alias("d")))
    aligned = joined.groupBy("id", "item", "total", "total_plain", (F.col("pos") - F.col("item_pos")).alias("offset")).agg(
        F.collect_set(F.struct(F.col("item_pos").alias("at"), pairs.alias("pairs"), "plain")).alias("w"))
    # item values with several values in the document: only the windows that hold one are left out
    values = aligned.withColumn("i", F.array_sort(F.transform(F.array_distinct(F.flatten("w.pairs")), lambda p: p["i"])))
    values = values.withColumn("torn", F.filter("i", lambda x, n: (n > 0) & (x == F.get("i", n - 1))))
    good = values.withColumn("w", F.filter("w", lambda w: ~F.arrays_overlap(w["pairs"]["i"], F.col("torn")))).where(F.size("w") > 0)

    def at(test):
        return F.array_distinct(F.transform(F.filter("w", test), lambda w: w["at"]))
    good = good.select("id", "item", "total", "total_plain", at(lambda w: F.lit(True)).alias("at"), at(lambda w: ~w["plain"]).alias("as_template"),
                       at(lambda w: w["plain"]).alias("as_plain"), F.flatten("w.pairs").alias("pairs"))
    per = good.groupBy("id", "item").agg(
        F.max("total").alias("total"), F.max("total_plain").alias("total_plain"), F.max(F.size("at")).alias("longest"),
        *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("at", "as_template", "as_plain")],
        F.max(F.exists("pairs", lambda p: p["i"] != p["d"])).alias("reparameterised"))
    shares = [F.coalesce(F.size(c) / F.when(F.col(t) > 0, F.col(t)), F.lit(0.0)) for c, t in (("as_template", "total"), ("as_plain", "total_plain"))]
    share = F.greatest(*shares)
    return per.where((share >= min_share) | (F.col("longest") >= min_run)).select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), F.size("at").cast("long").alias("n_windows"),
        F.greatest("total", "total_plain").cast("long").alias("item_windows"), F.round(share, 6).alias("share"),
        F.col("longest").cast("long").alias("longest"), "reparameterised", F.lit(True).alias("contaminated"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, columns as they are. Rows with a NULL id stay."""
    found = matches(docs, benchmark, id_col, text_col, **options).select(id_col).distinct()
    return docs.join(found, id_col, "left_anti")
