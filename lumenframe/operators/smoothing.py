"""Holt-Winters smoothing of series of any length by a parallel scan.

With its three parameters fixed, a step of additive smoothing maps the state (level, trend, seasons) affinely, and the sum of
squared errors over some steps is a quadratic form of the state before them. Both are kept as matrices over (1, state), for
all parameters of a grid at once: a chunk of a series gives its matrices without knowing the state it starts from, and two
neighbouring chunks compose to the matrices of both (``compose``), which is associative.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.columns import col
from lumenframe.plans import chunks as ch
from lumenframe.plans.joins import match
from lumenframe.plans.ordering import as_list
from lumenframe.plans.storage import materialize

WIDTHS = [0.45 / 3**i for i in range(4)]  # half widths of the grid in its rounds
CENTRE = [0.5, 0.5, 0.5]
_GRAM_ROWS = 256


def grid(centre, width: float) -> np.ndarray:
    """Five values of each smoothing parameter (level, trend, season) around the best so far: (125, 3)."""
    axes = [np.clip(np.linspace(c - width, c + width, 5), 0.001, 0.999) for c in centre]
    return np.stack([x.ravel() for x in np.meshgrid(*axes)], axis=1)


def first_state(y: np.ndarray, period: int) -> np.ndarray:
    """(1, level, trend, seasons) before the first value, from the first two periods."""
    level = y[:period].mean()
    return np.concatenate([[1.0, level, (y[period : 2 * period].mean() - level) / period], y[:period] - level])


def run(y: np.ndarray, period: int, params: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state map, Gram matrix of the errors) of each parameter row over the values ``y``, which begin a period.

    ``start``: (period + 3, c), the state as a linear function of c unknowns. The identity leaves the state before ``y`` open,
    a single column fixes it.
    """
    n, c = len(params), start.shape[1]
    state = np.repeat(start[:, None, :], n, axis=1)  # (component, parameter, unknown)
    level, trend, season = state[1].copy(), state[2].copy(), state[3:]
    a, ab, g = (x[:, None] for x in (params[:, 0], params[:, 0] * params[:, 1], params[:, 2] * (1 - params[:, 0])))
    gram, errors, at = np.zeros((n, c, c)), np.empty((_GRAM_ROWS, n, c)), 0
    for t, value in enumerate(y.tolist()):
        s = season[t % period]
        level += trend
        e = errors[at]
        np.negative(level + s, out=e)
        e[:, 0] += value
        trend += ab * e
        level += a * e
        s += g * e
        at += 1
        if at == _GRAM_ROWS:
            gram += np.matmul(errors.transpose(1, 2, 0), errors.transpose(1, 0, 2))
            at = 0
    rest = errors[:at]
    gram += np.matmul(rest.transpose(1, 2, 0), rest.transpose(1, 0, 2))
    state[1], state[2] = level, trend
    return state.transpose(1, 0, 2), gram


def compose(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The maps and Gram matrices of consecutive stretches as those of the whole."""
    state, gram = parts[0]
    for after, errors in parts[1:]:
        gram = gram + state.transpose(0, 2, 1) @ errors @ state
        state = after @ state
    return state, gram


def best_of(params: np.ndarray, state: np.ndarray, gram: np.ndarray) -> tuple[list[float], np.ndarray]:
    sse = np.where(np.isfinite(gram[:, 0, 0]), gram[:, 0, 0], np.inf)
    i = int(np.argmin(sse))
    return params[i].tolist(), state[i, :, 0]


def fit(y: np.ndarray, period: int) -> np.ndarray:
    """Final state of a series held as an array, with the parameters of the best grid point."""
    centre, start = CENTRE, first_state(y, period)[:, None]
    for width in WIDTHS:
        params = grid(centre, width)
        centre, state = best_of(params, *run(y, period, params, start))
    return state


def ahead(state: np.ndarray, total: int, horizon: int, period: int) -> np.ndarray:
    steps = np.arange(1, horizon + 1)
    return state[1] + state[2] * steps + state[3:][(total + steps - 1) % period]


def fit_chunks(chunks: DataFrame, key, period: int) -> DataFrame:
    """(key…, state) of the series of ``series_chunks`` (whole periods each), by one pass and one fold per round."""
    keys = as_list(key)
    fields = [chunks.schema[k] for k in keys]
    part_schema = T.StructType([*fields, T.StructField("chunk", T.LongType()), T.StructField("part", T.BinaryType())])
    best_schema = T.StructType([*fields, T.StructField("centre", T.ArrayType(T.DoubleType())), T.StructField("state", T.ArrayType(T.DoubleType()))])
    best = chunks.where("chunk = 0").select(*[col(k) for k in keys], F.array(*map(F.lit, CENTRE)).alias("centre"))

    def combine(parts: list[bytes]) -> bytes:
        return pickle.dumps(compose([pickle.loads(p) for p in parts]))

    for width in WIDTHS:

        def summaries(frames, width=width):
            for f in frames:
                made = []
                for chunk, values, mean, centre in zip(f["chunk"], f["values"], f["mean"], f["centre"], strict=True):
                    y = np.asarray(values, float) - mean  # smoothing shifts with the level; small numbers cancel better
                    start = np.eye(period + 3) if chunk else first_state(y, period)[:, None]
                    made.append(pickle.dumps(run(y, period, grid(centre, width), start)))
                yield f[[*keys, "chunk"]].assign(part=made)

        def choose(frames, width=width):
            for f in frames:
                found = [best_of(grid(c, width), *pickle.loads(p)) for c, p in zip(f["centre"], f["part"], strict=True)]
                yield f[keys].assign(centre=[c for c, _ in found], state=[s.tolist() for _, s in found])

        told = match(chunks, best.select(*[col(k) for k in keys], "centre"), keys) if keys else chunks.crossJoin(F.broadcast(best.select("centre")))
        folded = ch.fold_chunks(materialize(told.mapInPandas(summaries, part_schema)), keys, combine)
        old = best.select(*[col(k) for k in keys], "centre")
        best = materialize((match(folded, old, keys) if keys else folded.crossJoin(F.broadcast(old))).mapInPandas(choose, best_schema))
    return best.select(*[col(k) for k in keys], "state")


def smooth_forecast(known: DataFrame, horizon: int, order, key=None, period: int = 12, size: int | None = None) -> DataFrame:
    """(key…, step, forecast): the fitted state carried on; a series of less than two periods goes on with its mean."""
    keys = as_list(key)
    length = max(2, (size or ch.SIZE) // period) * period
    chunks = ch.series_chunks(known, order, "value", keys, length)
    schema = T.StructType([*[chunks.schema[k] for k in keys], T.StructField("step", T.IntegerType()), T.StructField("forecast", T.DoubleType())])

    def rows(f: pd.DataFrame, states: list) -> pd.DataFrame:
        """``horizon`` rows for each row of ``f``; a state of None stands for the mean."""
        out = f[keys].loc[f.index.repeat(horizon)].reset_index(drop=True)
        paths = [np.zeros(horizon) if s is None else ahead(np.asarray(s), t, horizon, period) for s, t in zip(states, f["total"], strict=True)]
        paths = [np.where(np.isfinite(p).all(), p, 0.0) + m for p, m in zip(paths, f["mean"], strict=True)]
        return out.assign(step=np.tile(np.arange(1, horizon + 1, dtype=np.int32), len(f)), forecast=np.concatenate(paths) if paths else [])

    def whole(frames):
        for f in frames:
            yield rows(f, [fit(np.asarray(v, float) - m, period) if len(v) >= 2 * period else None for v, m in zip(f["values"], f["mean"], strict=True)])

    single = chunks.where(F.col("total") <= length).mapInPandas(whole, schema)  # a series of one chunk is fitted where it lies
    long = chunks.where(F.col("total") > length)
    if long.isEmpty():
        return single
    states = fit_chunks(long, keys, period)
    facts = long.where("chunk = 0").select(*[col(k) for k in keys], "total", "mean")
    told = match(facts, states, keys) if keys else facts.crossJoin(F.broadcast(states))

    def carried(frames):
        for f in frames:
            yield rows(f, list(f["state"]))

    return single.unionByName(told.mapInPandas(carried, schema))
