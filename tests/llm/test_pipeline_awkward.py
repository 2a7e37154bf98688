"""The pipeline's stages on NULLs, empty and long texts, repeated rows, clashing column names and empty tables."""

import tempfile

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c

GOOD = "The harbour lies in the north of the old town, and its ships bring corn, wood and wool from many lands every week. "
ROWS = [(1, GOOD * 4, "en"), (1, GOOD * 4, "en"), (2, None, None), (3, "", "en"), (4, " \n\t ", "xx"), (None, "A text without an id, long enough to be a line.", "de"),
        (5, "word and more words " * 9000, "fr"), (6, "a" * 70000, None), (7, "日本語のテキスト 🙂\nline two", "ja"), (8, "\n\n\n", "es"),
        (9, "Some other prose about trains. A train leaves the old town of Bern at 8 hours and drives 120 km to the lake near Thun, so how far is it?", "en")]
ITEM = "A train leaves the old town of Bern at 8 hours and drives 120 km to the lake near Thun, so how far is it?"


def folder(spark, rows, labels, items):
    d = tempfile.mkdtemp(prefix="mf-pipe-")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns(
        {"source": F.lit("s"), "n_chars": F.length("text").cast("long"), **{x: F.lit(f"own {x}") for x in ("fp", "removed", "_text", "_gone", "root", "key", "score", "id", "h1")}})
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs


def test_awkward_rows(spark):
    d, docs = folder(spark, ROWS, [(1, 1, 0), (None, 1, 1), (5, None, None)], [(1, ITEM), (2, None), (None, "x")])
    rows = {}
    at = c.table(spark, d, "documents")
    for name, stage in c.STAGES:
        at = c.stored(stage(spark, at, d), f"test-{name}")
        rows[name] = at.collect()
        if name != c.STAGES[-1][0]:
            assert sorted(at.columns) == sorted(docs.columns)
            assert all(r["_text"] == "own _text" and r.key == "own key" for r in rows[name])
    ids = {n: [r.doc_id for r in x] for n, x in rows.items()}
    # one label class: nothing is rejected; of the blank texts one stays, of the equal rows one; the leak goes
    assert len(ids["quality"]) == len(ids["lines"]) == len(ROWS)
    assert sorted(x for x in ids["near_duplicates"] if x) == [1, 2, 5, 6, 7, 9] and None in ids["near_duplicates"]
    assert 9 not in ids["decontaminate"] and len(ids["decontaminate"]) == len(ids["near_duplicates"]) - 1
    assert sorted(map(str, ids["tokens"])) == sorted(map(str, ids["decontaminate"]))


@pytest.mark.parametrize("labels,items", [([], []), ([(1, 1, 0), (3, 0, 1)], [(1, ITEM)])])
def test_empty_documents(spark, labels, items):
    d, _ = folder(spark, [], labels, items)
    assert c.run(spark, d).collect() == []
