"""Tab dimension (S7), tab selection (S6) and the tab spine used by per-tab
statistics (J7). Tabs are configuration: a handful of rows, never data-sized."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicons import TABS

TAB_SCHEMA = "tab string, tab_rank int, description string"


def tab_dimension(spark: SparkSession, tabs=None) -> DataFrame:
    """The configured tabs in display order with their descriptions."""
    rows = [(name, i, desc) for i, (name, desc) in enumerate(tabs or TABS)]
    return spark.createDataFrame(rows, TAB_SCHEMA)


def source_tabs(spark: SparkSession, sf_dir: str | None = None, n: int = 24) -> DataFrame:
    """Tab dimension of the benchmark tables: the configured ``src0 .. src{n-1}``
    (more than occur, so empty tabs exist, which must still be reported), and
    whatever other sources the documents at ``sf_dir`` have."""
    rows = [(f"src{i}", i, f"source {i}") for i in range(n)]
    dim = spark.createDataFrame(rows, TAB_SCHEMA)
    if sf_dir is None:
        return dim
    seen = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("tab")).where("tab IS NOT NULL").distinct()
    more = seen.join(dim.select("tab"), "tab", "left_anti").select(
        "tab", F.try_to_number(F.substring("tab", 4, 9), F.lit("999999999")).cast("int").alias("tab_rank"), F.col("tab").alias("description"))
    return dim.unionByName(more)


def select_tabs(dim: DataFrame | list, names) -> list[str]:
    """Resolve a tab selection: empty or any "all" (any case) → all tabs;
    exact names are kept in the given order, unknown names are dropped with
    a warning; nothing left → all tabs."""
    if isinstance(dim, DataFrame):
        known = [r[0] for r in dim.orderBy("tab_rank").select("tab").collect()]  # a few rows
    else:
        known = list(dim)
    names = list(names or [])
    if not names or any(str(n).lower() == "all" for n in names):
        return known
    chosen = []
    for n in names:
        if n in known:
            chosen.append(n)
        else:
            import warnings
            warnings.warn(f"Unknown tab {n!r}", stacklevel=2)
    return chosen or known


def filter_tabs(df: DataFrame, tabs: list[str], col: str = "tab") -> DataFrame:
    """Keep rows of the chosen tabs; on tab-partitioned storage this is a
    partition filter (only those directories are read)."""
    return df.filter(F.col(col).isin(list(dict.fromkeys(tabs))))


def with_spine(dim: DataFrame, per_tab: DataFrame, fill=0) -> DataFrame:
    """Every tab of the dimension appears, missing aggregates are zero."""
    out = dim.join(per_tab, on="tab", how="left")
    num = [f.name for f in per_tab.schema.fields
           if f.name != "tab" and f.dataType.typeName() in ("long", "integer", "double")]
    return out.na.fill(fill, num) if num else out
