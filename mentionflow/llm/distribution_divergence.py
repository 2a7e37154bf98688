"""Quality rule by distribution divergence: the character-class and common-word
histograms of a document against those of its language, by Jensen-Shannon
distance, with minimum-length guards. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: White space between words, as a character class.
SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
MIN_BASE_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Guards: shorter documents are not judged by that histogram.
MIN_CHARS = 100
MIN_WORDS = 50
#: Distances (0 to 1) beyond which a document diverges; a short document may
#: be further from the classes, by this number over its words.
MAX_CLASS_DISTANCE = 0.16
SHORT_SLACK = 10.0
MAX_WORD_DISTANCE = 0.35

#: Character classes, each taken from what the ones before it left over. The last is what remains.
CLASSES = (("lower", "[a-z]+"), ("space", SPACE + "+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("symbol", r"[#*$%&|<>]+"), ("punct", "[!-~]+"))
#: Common words of the languages that have a reference. Documents of other languages share one reference
#: and have no common words.
COMMON = {
    "en": "the of and to in a is that for it was on are as with be by this at from or have an not which you".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se il sont avec".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus".split(),
}
OTHER = "other"


def _shares(counts: F.Column) -> F.Column:
    """Counts as shares of their sum; NULL if it is 0."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.when(total > 0, counts), lambda x: x / total)


def _js(p: F.Column, q: F.Column) -> F.Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares; NULL if one is NULL."""
    def part(x, y):
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def features(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """Per row: id, ``lang`` of its reference, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, ``classes`` and ``common`` (count vectors)."""
    lang = F.when(F.col(lang_col).isin(*COMMON), F.col(lang_col)).otherwise(OTHER)
    nothing = F.array().cast("array<string>")
    stop = reduce(lambda c, k: c.when(F.col("lang") == k, F.array(*map(F.lit, COMMON[k]))), COMMON, F).otherwise(nothing)
    found = reduce(lambda c, k: c.when(F.col("lang") == k, F.filter("w", lambda x: F.lower(x).isin(COMMON[k]))), COMMON, F).otherwise(nothing)
    d = docs.select(F.col(id_col), lang.alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.withColumn("w", F.array_remove(F.split("t", SPACE + "+"), "")).withColumn("stop", stop)
    # what each class leaves over
    left = ["t"]
    for name, pattern in CLASSES:
        d = d.withColumn(f"r_{name}", F.regexp_replace(left[-1], pattern, ""))
        left.append(f"r_{name}")
    lengths = [F.length(c) for c in left]
    classes = F.array(*[(a - b).cast("long") for a, b in zip(lengths, lengths[1:], strict=False)], lengths[-1].cast("long"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        id_col, "lang", "w", "stop", classes.alias("classes"), F.size("w").cast("long").alias("n_words"), lines.alias("lines"),
        F.transform(found, lambda x: F.lower(x)).alias("found"), F.transform("w", lambda x: F.xxhash64(x)).alias("h1"))
    for n in (1, 2, 4):  # hashes of 2, 4 and 8 words in a row; those that run over the end are cut off below
        d = d.withColumn(f"h{2 * n}", F.zip_with(f"h{n}", F.when(F.size(f"h{n}") > n, F.slice(f"h{n}", n + 1, F.size(f"h{n}"))).otherwise(
            F.array().cast("array<bigint>")), lambda a, b: F.xxhash64(a, b)))
    d = d.withColumn("win", F.when(F.col("n_words") >= WINDOW, F.slice("h8", 1, F.size("h8") - (WINDOW - 1))).otherwise(
        F.array().cast("array<bigint>")))
    repeats = F.size(F.array_distinct("win")) < F.size("win")
    d = d.withColumn("sorted", F.when(repeats, F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    n = F.size("sorted")
    twice = F.filter("sorted", lambda x, k: (x["h"] == F.get("sorted", k - 1)["h"]) | (x["h"] == F.get("sorted", k + 1)["h"]))
    d = d.withColumn("at", F.when(F.col("sorted").isNotNull() & (n > 1), F.sort_array(F.transform(
        F.filter(twice, lambda x: x.isNotNull()), lambda x: x["i"]))).otherwise(F.array().cast("array<int>")))
    covered = F.aggregate("at", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")), lambda s, p: F.struct(
        p.alias("last"), (s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n")), lambda s: s["n"])
    common = F.transform("stop", lambda x: (F.size("found") - F.size(F.array_remove("found", x))).cast("long"))
    names = [c for c, _ in CLASSES]
    return d.select(
        id_col, "lang", "n_words",
        (F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x) - F.col("classes")[names.index("space")]).alias("word_chars"),
        F.col("classes")[names.index("symbol")].alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"),
        "classes", F.concat(common, F.array(F.col("n_words") - F.size("found"))).alias("common"))


def _distances(f: DataFrame, accepted: DataFrame) -> DataFrame:
    """``f`` with class_distance and word_distance to the histograms of the ``accepted`` rows of the language."""
    n_classes, n_words = len(CLASSES) + 1, max(map(len, COMMON.values())) + 1
    sums = accepted.groupBy("lang").agg(
        *[F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(n_classes)],
        *[F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(n_words)])
    # one row for each language of COMMON and one for the others: bounded
    ref = sums.select("lang", _shares(F.array(*[f"c{i}" for i in range(n_classes)])).alias("q_class"),
                      _shares(F.array_compact(F.array(*[f"w{i}" for i in range(n_words)]))).alias("q_word"))
    j = f.join(F.broadcast(ref), "lang", "left")
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    by_class = F.when(chars >= MIN_CHARS, _js(F.col("p_class"), F.col("q_class")))
    by_word = F.when((F.col("n_words") >= MIN_WORDS) & (F.size("common") > 1), _js(F.col("p_word"), F.col("q_word")))
    j = j.withColumn("p_class", _shares(F.col("classes"))).withColumn("p_word", _shares(F.col("common")))
    return j.select(*f.columns, F.round(by_class, 6).alias("class_distance"), F.round(by_word, 6).alias("word_distance"))


def _diverges() -> F.Column:
    slack = SHORT_SLACK / F.greatest(F.col("n_words"), F.lit(1))
    return (F.coalesce(F.col("class_distance"), F.lit(0.0)) > MAX_CLASS_DISTANCE + slack) | (
        F.coalesce(F.col("word_distance"), F.lit(0.0)) > MAX_WORD_DISTANCE)


def judge(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """Base features and verdict of every row of ``docs``.

    References: the summed histograms of all documents of a language that the
    base rules accept; then again of those that don't diverge from the first ones. NULL texts are empty; an empty text has 0 words and fails the base rules;
    a NULL or unknown language goes by the reference of the other languages; repeated
    rows are judged each; other columns are not read. Distances are NULL where
    the guard holds or there's nothing to compare; NULL doesn't fail a document."""
    f = features(docs, id_col, text_col, lang_col)
    failed = (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    f = stored(f.withColumn("base_failed", failed), "divergence-features")
    n_classes, n_words = len(CLASSES) + 1, max(map(len, COMMON.values())) + 1
    first = _distances(f, f.where("NOT base_failed"))
    judged = _distances(f, first.where(~F.col("base_failed") & ~_diverges()).drop("class_distance", "word_distance"))
    return judged.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance",
                    "base_failed", (~F.col("base_failed") & ~_diverges()).alias("kept"))


def oracle(table: str = "documents") -> str:
    """DuckDB SQL of ``judge``."""
    names = [c for c, _ in CLASSES]
    left, steps = "t", []
    for name, pattern in CLASSES:
        steps.append(f"regexp_replace({left}, '{pattern}', '', 'g') AS r_{name}")
        left = f"r_{name}"
    chain = "t"
    counts = []
    for name in names:
        counts.append(f"length({chain}) - length(r_{name})")
        chain = f"r_{name}"
    counts.append(f"length({chain})")
    lists = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in COMMON.items())

    def distances(name: str, accepted: str) -> str:
        js = "sqrt(greatest(0.0, list_sum(list_transform(list_zip({p}, {q}), lambda z: " \
             "(CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END) + " \
             "(CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END))) / 2))"
        return f"""{name}_sums AS (
  SELECT lang, kind, i, sum(x) AS x FROM (
    SELECT lang, 'c' AS kind, unnest(classes) AS x, generate_subscripts(classes, 1) AS i FROM {accepted}
    UNION ALL SELECT lang, 'w', unnest(common), generate_subscripts(common, 1) FROM {accepted}) GROUP BY ALL),
{name}_ref AS (
  SELECT lang, kind, list(x / nullif(total, 0) ORDER BY i) AS q FROM (
    SELECT *, sum(x) OVER (PARTITION BY lang, kind) AS total FROM {name}_sums) GROUP BY lang, kind),
{name} AS (
  SELECT f.*, CASE WHEN list_sum(classes) >= {MIN_CHARS} THEN round({js.format(p="list_transform(classes, lambda x: x / list_sum(classes))", q="c.q")}, 6) END AS class_distance,
    CASE WHEN n_words >= {MIN_WORDS} AND len(common) > 1 THEN round({js.format(p="list_transform(common, lambda x: x / list_sum(common))", q="w.q")}, 6) END AS word_distance
  FROM f LEFT JOIN {name}_ref c ON c.lang = f.lang AND c.kind = 'c' LEFT JOIN {name}_ref w ON w.lang = f.lang AND w.kind = 'w')"""

    diverges = f"(coalesce(class_distance, 0) > {MAX_CLASS_DISTANCE} + {SHORT_SLACK} / greatest(n_words, 1) OR coalesce(word_distance, 0) > {MAX_WORD_DISTANCE})"
    nested = "t"
    sub = f"SELECT doc_id, CASE WHEN lang IN ({', '.join(repr(k) for k in COMMON)}) THEN lang ELSE '{OTHER}' END AS lang, coalesce(text, '') AS {nested}, row_number() OVER () AS rid FROM {table}"
    for step in steps:
        sub = f"SELECT *, {step} FROM ({sub})"
    return f"""
WITH d AS (
  SELECT *, list_filter(regexp_split_to_array(t, '{SPACE}+'), lambda x: x <> '') AS w, coalesce(CASE lang {lists} END, []) AS stop,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM ({sub})),
win AS (
  SELECT rid, i, list_aggregate(w[i:i + {WINDOW - 1}], 'string_agg', ' ') AS k FROM (
    SELECT rid, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM d WHERE len(w) >= {WINDOW})),
twice AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS last FROM (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, sum(least({WINDOW}, i - coalesce(last, -{WINDOW}))) AS n FROM twice GROUP BY rid),
f AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, [{', '.join(f'({c})::BIGINT' for c in counts)}] AS classes,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    list_concat(list_transform(stop, lambda s: len(list_filter(w, lambda x: lower(x) = s))::BIGINT), [len(list_filter(w, lambda x: NOT list_contains(stop, lower(x))))::BIGINT]) AS common,
    len(w) < {MIN_BASE_WORDS} OR 100 * coalesce(rep.n, 0) > {MAX_REPEAT_PERCENT} * len(w) AS base_failed
  FROM d LEFT JOIN rep USING (rid)),
good0 AS (SELECT * FROM f WHERE NOT base_failed),
{distances("first", "good0")},
good1 AS (SELECT * FROM first WHERE NOT base_failed AND NOT {diverges}),
{distances("second", "good1")}
SELECT doc_id, n_words, (list_sum(classes) - classes[{names.index('space') + 1}])::BIGINT AS word_chars, classes[{names.index('symbol') + 1}] AS n_symbols,
  n_dup_lines, n_repeat_words, class_distance, word_distance, base_failed, NOT base_failed AND NOT {diverges} AS kept
FROM second"""
