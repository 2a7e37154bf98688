"""Every operator on NULLs, empty, blank and long texts, repeated rows, an empty
table, and extra columns whose names the operators use themselves."""

import pytest
from pyspark.sql import functions as F

from mentionflow.llm import (byte_bpe, compression_quality, distribution_divergence, fuzzy_lines, pu_toxicity, simhash, template_decontamination,
                             viterbi_counts, warc_derivatives, weak_pii)

LONG = "word " * 30000
ROWS = [(1, "A plain text of a few words, and some more of them.", "en"), (1, "A plain text of a few words, and some more of them.", "en"), (2, None, None),
        (3, "", "en"), (4, " \n\t ", "xx"), (None, "A text without an id, long enough to be a line.", "de"), (5, LONG, "fr"),
        (6, "a" * 70000, None), (7, "日本語のテキスト 🙂\nline two", "ja"), (8, "\n\n\n", "es")]
CLASHING = ("score", "kept", "ids", "fp", "k", "w", "t", "id", "pos", "removed", "base", "lang2", "held_out", "_text2", "n", "h", "item")
LABELS = [(1, 1, 0), (3, 0, 1), (None, 1, 1), (5, None, None), (7, 1, 0)]


def docs(spark, rows=ROWS):
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    return d.withColumns({c: F.lit(f"own {c}") for c in CLASHING}).withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})


def labels(spark, rows=LABELS):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def bench(spark, rows=((1, "A plain text of a few words, and some more of them."), (2, None), (None, "x"))):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")


def by_quality(spark, d):
    return compression_quality.score(d, compression_quality.train(d, labels(spark)))


def by_toxicity(spark, d):
    return pu_toxicity.score(d, pu_toxicity.train(d, labels(spark)))


ONE_EACH = {
    "quality": by_quality, "toxicity": by_toxicity, "divergence": lambda s, d: distribution_divergence.judge(d),
    "simhash": lambda s, d: simhash.groups(d), "pii": lambda s, d: weak_pii.digests(weak_pii.detect(d)),
    "lines": lambda s, d: fuzzy_lines.report(d), "dedup_lines": lambda s, d: fuzzy_lines.dedup_lines(d),
    "viterbi": lambda s, d: viterbi_counts.counts(d), "bpe": lambda s, d: byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(d)))}


@pytest.mark.parametrize("name", ONE_EACH)
def test_one_row_for_each_row(spark, name):
    d = docs(spark)
    out = ONE_EACH[name](spark, d).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in ROWS)
    ones = [tuple(r) for r in out if r["doc_id"] == 1]
    assert ones[0] == ones[1]


@pytest.mark.parametrize("name", ONE_EACH)
def test_empty_table(spark, name):
    assert ONE_EACH[name](spark, docs(spark, [])).collect() == []


def test_empty_texts(spark):
    d = docs(spark, [(1, None, None), (2, "", "en")])
    assert [(r.n_tokens, r.score) for r in viterbi_counts.counts(d).collect()] == [(0, 0.0)] * 2
    assert [r.n_tokens for r in byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(d))).collect()] == [0, 0]
    assert {(r.doc_id, r.fp, r.component_id) for r in simhash.groups(d).collect()} == {(1, 0, 1), (2, 0, 1)}
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in distribution_divergence.judge(d).collect())
    assert all(r.spans == "" and r.n_email == 0 for r in weak_pii.digests(weak_pii.detect(d)).collect())
    assert {(r.doc_id, r.n_lines, r.n_removed) for r in fuzzy_lines.report(d).collect()} == {(1, 0, 0), (2, 1, 0)}


def test_filters_keep_columns(spark):
    d = docs(spark)
    none = compression_quality.Model(b"", b"", (), (), (), 0.9)
    for out in (compression_quality.keep_good(d, none), simhash.one_of_each(d), fuzzy_lines.dedup_lines(d),
                template_decontamination.without_leaks(d, bench(spark))):
        assert out.columns == d.columns and out.dtypes == d.dtypes
    assert compression_quality.keep_good(d, none).count() == len(ROWS)
    kept = simhash.one_of_each(d).collect()
    assert [r.doc_id for r in kept].count(1) == 1 and [r.doc_id for r in kept].count(None) == 1
    assert sorted(x for x in (r.doc_id for r in kept) if x in (2, 3, 4, 8)) == [2]  # all of them blank
    left = template_decontamination.without_leaks(d, bench(spark)).collect()
    assert 1 not in [r.doc_id for r in left] and len(left) == len(ROWS) - 2


def test_decontamination_of_nothing(spark):
    assert template_decontamination.matches(docs(spark, []), bench(spark)).collect() == []
    assert template_decontamination.matches(docs(spark), bench(spark, [])).collect() == []


def test_training_without_labels(spark):
    d = docs(spark)
    q = compression_quality.score(d, compression_quality.train(d, labels(spark, []))).collect()
    assert {r.score for r in q} == {0.5} and {r.predicted for r in q} == {1}
    t = pu_toxicity.score(d, pu_toxicity.train(d, labels(spark, []))).collect()
    assert all(0 <= r.score <= 1 for r in t)


def test_responses_of_awkward_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "http://x/", ""), (2, "http://x/", ""), (None, "u", "<p>a</p>")],
                                  "page_id bigint, url string, html string").withColumn("record", F.lit("own"))
    out = warc_derivatives.derivatives(warc_derivatives.responses_of(pages)).collect()
    assert len(out) == 8 and all(r.refers_to and r.record for r in out)
    two = [tuple(r) for r in out if r.page_id == 2]
    assert two[:2] == two[2:]
    assert warc_derivatives.derivatives(warc_derivatives.responses_of(pages.limit(0))).collect() == []
