"""Sums of products of all column pairs, over the rows where both are known.

One expression per pair would make a plan that grows with the square of the columns. Here every Arrow batch is a matrix of
values and one of known cells, and all pairs' sums are four matrix products; the sums of the partitions are added in a tree.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.columns import col
from lumenframe.plans.chunks import fold_chunks
from lumenframe.plans.onepass import one_row
from lumenframe.plans.spread import spread
from lumenframe.plans.storage import materialize


def _summed(df: DataFrame, products) -> object:
    """The sum over all batches of ``products(batch)`` (an array), or None without rows."""

    def run(batches):
        from pyspark import TaskContext

        total = None
        for b in batches:
            if b.num_rows:
                part = products(b)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"chunk": [TaskContext.get().partitionId()], "part": [pickle.dumps(total)]})

    parts = materialize(df.mapInArrow(run, "chunk long, part binary"))
    row = fold_chunks(parts, None, lambda ps: pickle.dumps(sum(pickle.loads(p) for p in ps))).select("part").collect()
    return sum(pickle.loads(r.part) for r in row) if row else None


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where null) and known cells (0 or 1)."""
    known = np.stack([np.asarray(c.is_valid()) for c in batch.columns], axis=1).astype(float)
    values = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
    return values, known


def pair_correlations(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(Pearson correlation, rows) of every pair; NaN where a column is constant, too few rows give NaN as well.

    Values are taken less their column's mean, so the sums do not cancel; a column with one value is recognised by its ends.
    """
    as_double = {c: col(c).cast("double") for c in cols}
    facts = one_row(df, {(n, c): f(as_double[c]) for c in cols for n, f in (("mean", F.avg), ("low", F.min), ("high", F.max))})
    shifted = spread(df.select(*[(as_double[c] - F.lit(facts[("mean", c)] or 0.0)).alias(f"v{i}") for i, c in enumerate(cols)]))

    def products(b: pa.RecordBatch) -> np.ndarray:
        v, m = _matrix(b)
        with np.errstate(invalid="ignore"):
            return np.stack([m.T @ m, v.T @ m, (v * v).T @ m, v.T @ v])

    sums = _summed(shifted, products)
    if sums is None:
        return np.full((len(cols), len(cols)), np.nan), np.zeros((len(cols), len(cols)))
    n, sx, sxx, sxy = sums  # sx[i, j]: the sum of column i where j is known too
    constant = np.array([facts[("low", c)] == facts[("high", c)] for c in cols])
    with np.errstate(all="ignore"):
        spread_ = np.maximum(sxx - sx * sx / n, 0.0)
        r = (sxy - sx * sx.T / n) / np.sqrt(spread_ * spread_.T)
    r[constant, :] = r[:, constant] = np.nan
    return np.where(n > 1, r, np.nan), n


def flag_products(df: DataFrame, flags: Sequence[Column]) -> np.ndarray | None:
    """Rows in which both flags of a pair are set; the diagonal holds the rows with one flag. None without rows."""
    many = len(flags)
    marked = spread(df.select(*[f.alias(f"f{i}") for i, f in enumerate(flags)]))

    def products(b: pa.RecordBatch) -> np.ndarray:
        f = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1).astype(np.float32)
        return np.stack([(f.T @ f).astype(np.int64), np.full((many, many), b.num_rows)])  # a batch's counts are exact in float32

    return _summed(marked, products)
