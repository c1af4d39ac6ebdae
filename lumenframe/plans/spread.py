"""Using all cores on inputs that arrive in few pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.columns import col

PIECE_BYTES = 4 << 20
SMALL_BYTES = 1 << 30  # of Catalyst's estimate; one of rows of no known size is far larger
NARROW_ROWS = 100_000  # of numbers only: no fewer in a piece (Catalyst's estimate for a join is far too large)
LOOKED_AT = 1_000  # rows that tell how long texts are
WIDE = ("string", "binary", "array", "struct", "map")


def _estimate(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pieces(df: DataFrame) -> int:
    """One for every core, and so many that a piece stays small however large the input is.

    Numbers are measured by Catalyst's estimate. Texts, bytes and nested values may be far larger than their file, so the
    length of some rows and the number of all are taken.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    wide = [c for c, kind in df.dtypes if kind.startswith(WIDE)]
    if wide:
        long = sum((F.coalesce(F.octet_length(col(c).cast("string")), F.lit(0)) for c in wide), F.lit(8))
        mean = df.select(long.alias("n")).limit(LOOKED_AT).agg(F.avg("n")).first()[0] or 0
        return max(cores, -(-int(df.count() * mean) // PIECE_BYTES))
    by_size = -(-_estimate(df) // PIECE_BYTES)
    return cores if by_size <= cores else max(cores, min(by_size, -(-df.count() // NARROW_ROWS)))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of an input to every core in front of an expensive step.

    A file with one row group is read by one task however large it is and however many cores there are, so the rows are
    dealt into pieces whose number grows with the input. Rows of no known size that need no more pieces than there are
    cores are left as they are.
    """
    return dealt(df) if _estimate(df) >= SMALL_BYTES else df.repartition(pieces(df))


def dealt(df: DataFrame) -> DataFrame:
    """``spread`` for an input that needs more pieces than there are cores; a smaller one is left as it is."""
    n = pieces(df)
    return df.repartition(n) if n > df.sparkSession.sparkContext.defaultParallelism else df
