"""Driver contract: entry runs, every query has a callable, oracles agree on
a few fast queries at sf0.001 (the full sf0.01 check is tools/oracle_check.py)."""

import duckdb
import pytest

from conftest import SF_SMALL
from tools.oracle_check import TABLES, canon


def test_entry(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 20
    assert df.columns[:2] == ["rank", "symbol"]


def test_registry_consistent():
    from __spark_entry__ import oracle_sql, queries
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q)


@pytest.mark.parametrize("name", ["stock_mentions", "symbols", "keyword_sentiment", "parse_responses",
                                  "themes", "tab_stats", "top_discussions", "page_posts"])
def test_oracle_small(spark, name):
    from __spark_entry__ import oracle_sql, queries
    df = queries()[name](spark, SF_SMALL)
    sc, sr = canon(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    cur = con.execute(oracle_sql()[name])
    dc, dr = canon([d[0] for d in cur.description], cur.fetchall())
    assert sc == dc and sr == dr
