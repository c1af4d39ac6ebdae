"""Long series as rows of consecutive values, and aggregates that fold such rows in order.

A recursion over a series needs its values in order. Instead of one task per series, a series becomes rows of ``size`` values;
each row is worked on by itself and leaves a summary, and the summaries of a series are combined pairwise-associatively in a
tree, ``FAN`` at a time. So a series of any length is shared out, and a task holds one chunk or ``FAN`` summaries.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.columns import col
from lumenframe.plans.joins import match
from lumenframe.plans.ordering import as_list, with_position
from lumenframe.plans.storage import materialize

SIZE = 1 << 16
FAN = 16


def series_chunks(s: DataFrame, order, value: str, key=None, size: int = SIZE, back: int = 0) -> DataFrame:
    """(key…, chunk, own, total, mean, values): ``size`` consecutive values, after up to ``back`` values of the chunk before.

    ``own`` is the place of the chunk's first value of its own, ``total`` and ``mean`` are those of the series.
    """
    keys, back = as_list(key), min(back, size)
    placed = with_position(s.select(*[col(k) for k in keys], *as_list(order), col(value).cast("double").alias("_v")), order, keys, "_pos")
    sums = s.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("total"), F.avg(col(value)).alias("mean"))
    home = F.expr(f"_pos div {size}")
    copies = F.array_compact(F.array(home, F.when(F.col("_pos") % size >= size - back, home + 1)))
    parts = placed.withColumn("chunk", F.explode(copies)).groupBy(*[col(k) for k in keys], "chunk").agg(F.sort_array(F.collect_list(F.struct("_pos", "_v"))).alias("_held"))
    named = match(parts, sums, keys) if keys else parts.crossJoin(F.broadcast(sums))  # one row without a key
    own = F.greatest(F.lit(0), F.col("chunk") * size - F.element_at("_held", 1)["_pos"]).cast("int")
    chunks = named.where(F.col("chunk") * size < F.col("total"))
    return materialize(chunks.select(*[col(k) for k in keys], "chunk", own.alias("own"), "total", "mean", F.col("_held._v").alias("values")))


def fold_chunks(parts: DataFrame, key, combine: Callable[[list], object]) -> DataFrame:
    """Fold the binary ``part`` of each series' chunks in order: (key…, chunk, part) to one row with chunk 0.

    ``combine`` takes some consecutive parts and returns the part of them all; it has to be associative.
    """
    keys, schema = as_list(key), parts.schema
    top = parts.agg(F.max("chunk")).first()[0] or 0

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        out = rows.iloc[:1].copy()
        out["part"] = [combine(list(rows["part"]))]
        out["chunk"] //= FAN
        return out

    while top > 0:
        parts = materialize(parts.groupBy(*[col(k) for k in keys], F.expr(f"chunk div {FAN}").alias("_up")).applyInPandas(run, schema))
        top //= FAN
    return parts
