"""Equi-joins by name in which a null key meets a null key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.columns import col
from lumenframe.plans.storage import materialize


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys``; the result has the columns of ``left`` and the other columns of ``right``.

    The right keys are renamed first, so tables that stem from the same source never collide. Spark
    broadcasts a side it measures to be small and splits skewed partitions of a sort-merge join.
    """
    named = {k: f"_match_{i}" for i, k in enumerate(keys)}
    other = right.select(*[col(k).alias(n) for k, n in named.items()], *[col(c) for c in right.columns if c not in named])
    on = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(n)) for k, n in named.items()])
    return left.join(other, on, how).drop(*named.values())


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``match`` with a derived table of one row per key (weights, codes, per-group statistics).

    The derived table is computed once and written down. Its real size on disk is then known when the
    join is planned: below ``spark.sql.autoBroadcastJoinThreshold`` the large side is not shuffled at all,
    above it the join is a shuffle join whose skewed partitions AQE splits.
    """
    return match(left, materialize(right), keys, how)
