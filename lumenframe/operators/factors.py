"""Non-negative matrix factorisation of a sparse table by alternating non-negative least squares.

X (rows x columns, cells that are not listed are zero) is approximated by W H with the squared error over all cells, the
zeros included. With H fixed, a row of W is a least-squares problem of k unknowns in the Gram matrix H H' and the row's
products with H, which are a sum over its listed cells; with W fixed the same holds for a column of H. So a half step is one
join, one aggregate and one small solve per row. Factors are broadcast, ``FEW`` at a time, so that only partial sums are shuffled;
beyond ``BLOCKS`` times ``FEW`` factors the cells are. Factors and sums that are no longer needed are deleted, so the disk holds
those of one iteration. Only k x k matrices are collected.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.columns import col
from lumenframe.plans.storage import discard, materialize

SWEEPS, SETTLED = 1000, 1e-12
FEW = 1_000_000  # rows of factors that may be broadcast; the cells, many times as many, then stay where they lie
BLOCKS = 64  # of ``FEW`` factors at most, each met by a pass over the cells


def solve_nonnegative(gram: np.ndarray, products: np.ndarray) -> np.ndarray:
    """For each row b of ``products`` the x >= 0 that minimises x'Gx/2 - b'x, by sweeps over the coordinates."""
    diagonal = np.diag(gram)
    live = np.flatnonzero(diagonal > 0)
    x = np.zeros_like(products)
    x[:, live] = np.maximum(products[:, live] / diagonal[live], 0.0)
    for _ in range(SWEEPS):
        moved = 0.0
        for j in live:
            fresh = np.maximum(x[:, j] + (products[:, j] - x @ gram[j]) / diagonal[j], 0.0)
            moved = max(moved, float(np.abs(fresh - x[:, j]).max(initial=0.0)))
            x[:, j] = fresh
        if moved <= SETTLED * max(1.0, float(x.max(initial=0.0))):
            break
    return x


def _names(k: int) -> list[str]:
    return [f"f{j}" for j in range(k)]


def _gram(factors: DataFrame, k: int) -> np.ndarray:
    names = _names(k)
    row = factors.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]]).first()
    out = np.zeros((k, k))
    for i, a in enumerate(names):
        for j, b in enumerate(names[i:], i):
            out[i, j] = out[j, i] = row[f"{a}_{b}"]
    return out


def _half_step(cells: DataFrame, factors: DataFrame, gram: np.ndarray, by: str, other: str) -> DataFrame:
    """Factors of ``by`` (p… are the products with ``factors``, which are keyed by ``other``)."""
    k = len(gram)
    names = _names(k)
    totals = [F.sum(F.col("_v") * F.col(n)).alias("p" + n[1:]) for n in names]
    many, parts = factors.count(), []
    blocks = -(-many // FEW) if FEW else BLOCKS + 1
    if blocks <= 1:
        sums = cells.join(F.broadcast(factors), other).groupBy(by).agg(*totals)
    elif blocks > BLOCKS:
        sums = cells.join(factors, other).groupBy(by).agg(*totals)
    else:
        block = F.pmod(F.xxhash64(other), F.lit(blocks))
        for b in range(blocks):
            parts.append(materialize(cells.where(block == b).join(F.broadcast(factors.where(block == b)), other).groupBy(by).agg(*totals)))
        sums = reduce(DataFrame.unionAll, parts).groupBy(by).agg(*[F.sum(p).alias(p) for p in ("p" + n[1:] for n in names)])

    def run(frames):
        for f in frames:
            x = solve_nonnegative(gram, f[["p" + n[1:] for n in names]].to_numpy(dtype=float))
            yield pd.concat([f, pd.DataFrame(dict(zip(names, x.T, strict=True)), index=f.index)], axis=1)

    schema = ", ".join([f"{by} {dict(cells.dtypes)[by]}", *(f"p{n[1:]} double" for n in names), *(f"{n} double" for n in names)])
    made = materialize(sums.mapInPandas(run, schema))
    for p in parts:
        discard(p)
    return made


def start_value(column: Column, topic: int, seed: int) -> Column:
    """A number above 0 and up to 1 that depends on the column's name, the topic and the seed only."""
    return (F.pmod(F.xxhash64(column, F.lit(topic), F.lit(seed)), F.lit(1 << 40)) + F.lit(1)) / F.lit(float(1 << 40))


def nmf(
    cells: DataFrame, row: str, column: str, value: str, k: int, iterations: int = 200, tolerance: float = 1e-4, seed: int = 42
) -> tuple[DataFrame, DataFrame, float]:
    """(factors of the rows, factors of the columns, loss): keys and k numbers f0, f1, … each.

    ``cells``: a (row, column) at most once, value at least 0. Ends when an iteration lowers the loss by less than ``tolerance``
    of the squared sum of the cells. The loss is the squared error over all cells of the matrix.
    """
    x = materialize(cells.select(col(row).alias("_row"), col(column).alias("_col"), col(value).cast("double").alias("_v")).where("_v <> 0"))
    whole = x.agg(F.coalesce(F.sum(F.col("_v") * F.col("_v")), F.lit(0.0))).first()[0]
    h = materialize(x.select("_col").distinct().select("_col", *[start_value(F.col("_col"), j, seed).alias(n) for j, n in enumerate(_names(k))]))
    h_gram, before, w = _gram(h, k), np.inf, None
    for _ in range(iterations):
        last = w, h
        w = _half_step(x, h.select("_col", *_names(k)), h_gram, "_row", "_col")
        w_gram = _gram(w, k)
        h = _half_step(x, w.select("_row", *_names(k)), w_gram, "_col", "_row")
        h_gram = _gram(h, k)
        for old in last:
            if old is not None:
                discard(old)
        old = last = None
        cells.sparkSession._jvm.System.gc()  # Spark frees the shuffles of plans that are gone
        met = h.agg(F.coalesce(F.sum(sum(F.col(f"p{j}") * F.col(f"f{j}") for j in range(k))), F.lit(0.0))).first()[0]
        loss = max(0.0, whole - 2 * met + float((w_gram * h_gram).sum()))
        if before - loss <= tolerance * whole:
            break
        before = loss
    return w.select(F.col("_row").alias(row), *_names(k)), h.select(F.col("_col").alias(column), *_names(k)), loss
