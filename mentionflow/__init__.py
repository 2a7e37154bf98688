"""mentionflow: investor-discussion analytics as PySpark DataFrame functions.

Every public operator is a pure function ``f(df, ...) -> DataFrame`` built from
Catalyst expressions, joins, aggregates and windows, so the same code runs in a
batch job, inside ``foreachBatch`` and (where Spark allows) on a streaming
DataFrame.
"""

__version__ = "0.1.0"
