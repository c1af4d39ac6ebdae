"""Row order without a one-task window.

A window over one long series, or over a key that holds a third of all rows, would sort all of
it in one task. Every ordered operator therefore first asks for the size of the largest series
(one counting job). Up to ``WINDOW_ROWS`` a plain window partitioned by key is used. Beyond that
the rows are range-partitioned by (key, order) and given dense global positions; windows then run
on fixed-size chunks of positions, with the few rows a frame reaches back to copied into the
neighbouring chunk. Chunks are equal in size whatever the skew of keys.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window

from lumenframe.functions.columns import col
from lumenframe.plans.joins import lookup, match
from lumenframe.plans.storage import materialize

WINDOW_ROWS = 2_000_000
CHUNK_ROWS = 1_000_000
MAX_CHUNKS = 100_000
_ROW_BITS = 33  # monotonically_increasing_id: partition in the upper bits, row in the lower 33


def as_list(value) -> list[str]:
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)


def series_window(order, key=None) -> WindowSpec:
    keys = as_list(key)
    part = [col(k) for k in keys] if keys else [F.lit(0)]
    return Window.partitionBy(*part).orderBy(*[_sort(o) for o in as_list_any(order)])


def as_list_any(value) -> list:
    return list(value) if isinstance(value, (list, tuple)) else [value]


def _sort(o) -> Column:
    return col(o) if isinstance(o, str) else o


def largest_series(df: DataFrame, key=None) -> tuple[int, int]:
    """(rows of the largest series, rows in all)."""
    keys = as_list(key)
    if not keys:
        n = df.count()
        return n, n
    row = df.groupBy(*[col(k) for k in keys]).count().agg(F.max("count"), F.sum("count")).first()
    return row[0] or 0, row[1] or 0


def global_position(df: DataFrame, order, rows: int, name: str = "_pos", chunk_rows: int | None = None) -> DataFrame:
    """Dense 0-based position of every row in the given order, for any number of rows."""
    chunk = chunk_rows or max(CHUNK_ROWS, rows // MAX_CHUNKS + 1)
    parts = max(1, -(-rows // chunk))
    sort = [_sort(o) for o in as_list_any(order)]
    placed = _placed(df, sort, parts)
    # One row per partition, at most MAX_CHUNKS in all: small enough for one window and a broadcast.
    before = Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_pid")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    local = F.col("_rid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.join(F.broadcast(starts), "_pid")
        .withColumn(name, F.col("_start") + local)
        .drop("_pid", "_rid", "_start")
    )


def _placed(df: DataFrame, sort: list[Column], parts: int) -> DataFrame:
    """Range-partitioned and sorted rows with partition and row ids, written down so that they stay fixed.

    Rows that are equal in the whole order could not be split over partitions, so each row first gets a
    number of its own. It is written down before it is used: the ranges then never depend on a rerun.
    """
    numbered = materialize(df.withColumn("_tie", F.monotonically_increasing_id()))
    return materialize(
        numbered.repartitionByRange(parts, *sort, F.col("_tie"))
        .sortWithinPartitions(*sort, F.col("_tie"))
        .drop("_tie")
        .withColumn("_rid", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright("_rid", _ROW_BITS))
    )


def running_total(
    df: DataFrame, order, sums: Mapping[str, str], window_rows: int | None = None, chunk_rows: int | None = None
) -> DataFrame:
    """Add running totals (``sums``: output name to summed column) over all rows in the given order."""
    rows = df.count()
    sort = [_sort(o) for o in as_list_any(order)]
    if rows <= (WINDOW_ROWS if window_rows is None else window_rows):
        w = Window.partitionBy(F.lit(0)).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(col(c)).over(w).alias(n) for n, c in sums.items()])
    chunk = chunk_rows or max(CHUNK_ROWS, rows // MAX_CHUNKS + 1)
    placed = _placed(df, sort, max(1, -(-rows // chunk)))
    before = Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_pid")
        .agg(*[F.sum(col(c)).alias(f"_t_{n}") for n, c in sums.items()])
        .select("_pid", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums])
    )
    w = Window.partitionBy("_pid").orderBy("_rid").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(F.broadcast(starts), "_pid").select(
        *[col(c) for c in df.columns], *[(F.col(f"_s_{n}") + F.sum(col(c)).over(w)).alias(n) for n, c in sums.items()]
    )


def with_position(
    df: DataFrame, order, key=None, name: str = "pos", window_rows: int | None = None, chunk_rows: int | None = None
) -> DataFrame:
    """Add the 0-based position of each row inside its series."""
    keys = as_list(key)
    largest, rows = largest_series(df, keys)
    if largest <= (WINDOW_ROWS if window_rows is None else window_rows):
        return df.withColumn(name, (F.row_number().over(series_window(order, keys)) - 1).cast("long"))
    placed = global_position(df, [*keys, *as_list_any(order)], rows, "_gpos", chunk_rows)
    if not keys:
        return placed.withColumnRenamed("_gpos", name)
    first = placed.groupBy(*[col(k) for k in keys]).agg(F.min("_gpos").alias("_first"))
    return lookup(placed, first, keys).withColumn(name, F.col("_gpos") - F.col("_first")).drop("_gpos", "_first")


def over_series(
    df: DataFrame,
    order,
    key,
    build: Callable[[WindowSpec], Mapping[str, Column]],
    back: int,
    forward: int = 0,
    window_rows: int | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add window columns whose frames reach at most ``back`` rows back and ``forward`` rows on."""
    keys = as_list(key)
    largest, rows = largest_series(df, keys)
    if largest <= (WINDOW_ROWS if window_rows is None else window_rows):
        made = build(series_window(order, keys))
        return df.select("*", *[c.alias(n) for n, c in made.items()])
    base = chunk_rows or max(CHUNK_ROWS, rows // MAX_CHUNKS + 1)
    chunk = max(base, back, forward, 1)
    placed = global_position(df, [*keys, *as_list_any(order)], rows, "_pos", base)
    at, home = F.col("_pos") % chunk, F.floor(F.col("_pos") / chunk)
    placed = placed.withColumn(
        "_chunk",
        F.explode(
            F.filter(
                F.array(
                    home,
                    F.when(at >= chunk - back, home + 1) if back else F.lit(None).cast("long"),
                    F.when((at < forward) & (home > 0), home - 1) if forward else F.lit(None).cast("long"),
                ),
                lambda c: c.isNotNull(),
            )
        ),
    )
    w = Window.partitionBy("_chunk", *[col(k) for k in keys]).orderBy("_pos")
    made = build(w)
    return (
        placed.select("*", *[c.alias(n) for n, c in made.items()])
        .filter(F.col("_chunk") == F.floor(F.col("_pos") / chunk))
        .drop("_chunk", "_pos")
    )


def nearest_known(
    df: DataFrame,
    order,
    key,
    found: Mapping[str, Column],
    directions: Mapping[str, str],
    window_rows: int | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """For every row the nearest non-null value at or before it ("back") or at or after it ("on").

    ``found`` maps an output name to an expression, ``directions`` the same name to a direction.
    """
    keys = as_list(key)
    largest, rows = largest_series(df, keys)

    def local(part: list[Column], by: list[str]) -> dict[str, Column]:
        # A frame that runs to the end of its partition is rescanned for every row; the mirrored order
        # with a frame from the start is a single pass.
        sides = {
            "back": Window.partitionBy(*part).orderBy(*[col(o).asc() for o in by]),
            "on": Window.partitionBy(*part).orderBy(*[col(o).desc() for o in by]),
        }
        return {
            name: F.last(expr, True).over(sides[directions[name]].rowsBetween(Window.unboundedPreceding, 0))
            for name, expr in found.items()
        }

    if largest <= (WINDOW_ROWS if window_rows is None else window_rows):
        made = local([col(k) for k in keys] or [F.lit(0)], as_list(order))
        return df.select("*", *[c.alias(n) for n, c in made.items()])
    chunk = chunk_rows or max(CHUNK_ROWS, rows // MAX_CHUNKS + 1)
    placed = global_position(df, [*keys, *as_list_any(order)], rows, "_pos", chunk)
    placed = materialize(placed.withColumn("_chunk", F.floor(F.col("_pos") / chunk)))
    marked = placed.select("*", *[e.alias(f"_v_{n}") for n, e in found.items()])
    # What each chunk knows by itself: one row per (key, chunk), so a hot key keeps few rows here.
    know = marked.groupBy("_chunk", *[col(k) for k in keys]).agg(
        *[
            (F.max_by if directions[n] == "back" else F.min_by)(
                F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), F.col("_pos"))
            ).alias(f"_k_{n}")
            for n in found
        ]
    )
    part = [col(k) for k in keys] or [F.lit(0)]
    earlier = Window.partitionBy(*part).orderBy(col("_chunk").asc()).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*part).orderBy(col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = know.select(
        "_chunk",
        *keys,
        *[F.last(f"_k_{n}", True).over(earlier if directions[n] == "back" else later).alias(f"_c_{n}") for n in found],
    )
    made = local([F.col("_chunk"), *[col(k) for k in keys]], ["_pos"])
    inner = placed.select("*", *[c.alias(n) for n, c in made.items()])
    return match(inner, carry, ["_chunk", *keys], "left").select(
        *[col(c) for c in df.columns], *[F.coalesce(col(n), col(f"_c_{n}")).alias(n) for n in found]
    )
