"""Inputs derived from the standard tables: the same expressions in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.catalog.registry import Tables

_GAPPY = [
    "l_orderkey",
    "l_linenumber",
    "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity",
    "l_extendedprice",
    "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_discount END AS l_discount",
    "CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag",
    "l_linestatus",
    "l_shipdate",
]
# lineitem with null cells
GAPPY = f"gappy AS (SELECT {', '.join(_GAPPY)} FROM lineitem)"


def gappy(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr(*_GAPPY)


_MESSY = [
    "c_custkey",
    "CASE c_custkey % 4 WHEN 0 THEN concat('  ', c_mktsegment, ' ') WHEN 1 THEN lower(c_mktsegment) "
    "WHEN 2 THEN concat(c_mktsegment, '!!') ELSE concat('big ', c_mktsegment, '  ', CAST(c_custkey % 10 AS STRING), 'x') END AS segment",
    "CASE c_custkey % 3 WHEN 0 THEN CAST(c_acctbal AS STRING) WHEN 1 THEN CAST(c_nationkey AS STRING) ELSE 'n/a' END AS amount",
    "CASE c_custkey % 5 WHEN 0 THEN 'soon' WHEN 1 THEN NULL ELSE concat('2024-0', CAST(1 + c_custkey % 9 AS STRING), '-1', CAST(c_custkey % 10 AS STRING)) END AS day",
]
# customer with stray spaces, mixed case, punctuation, numbers as text and bad dates
MESSY = f"messy AS (SELECT {', '.join(_MESSY)} FROM customer)"


def messy(t: Tables) -> DataFrame:
    return t.customer.selectExpr(*_MESSY)


def rounded(df: DataFrame, digits: int = 4, cols=None) -> DataFrame:
    """Round double columns: sums differ in the last bits between engines."""
    doubles = cols or [c for c, k in df.dtypes if k in ("double", "float")]
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else df[c] for c in df.columns])
