"""ARIMA and SARIMA by least squares over chunks of a series.

The model is phi(B) Phi(B^s) (1-B)^d (1-B^s)^D y = c + theta(B) Theta(B^s) e: lags of the product of a plain and a seasonal
polynomial have products as coefficients. Starting values come from two regressions (Hannan-Rissanen); then steps of
Gauss-Newton with damping minimise the conditional sum of squared innovations.

Everything a step needs is a Gram matrix of few columns, a sum over chunks. Innovations follow a linear recurrence; a chunk
brings ``BURN`` values of its predecessor, and candidates whose moving-average roots are nearer to the unit circle than
``RADIUS`` are refused, so what came before the chunk has faded to 1e-14 where its own values begin.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

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

RADIUS = 0.999
BURN = 1 << 15  # RADIUS ** BURN is below 1e-14
STEPS = 40  # evaluations at most
EXACT = 1e-10  # relative gain below which a step ends the search


@dataclass(frozen=True)
class Order:
    p: int = 1
    d: int = 1
    q: int = 1
    sp: int = 0
    sd: int = 0
    sq: int = 0
    period: int = 12

    @property
    def constant(self) -> bool:
        return self.d + self.sd == 0  # a differenced model has none

    @property
    def lost(self) -> int:
        """Values that differencing takes from the front."""
        return self.d + self.sd * self.period

    @property
    def ar_top(self) -> int:
        return self.p + self.sp * self.period

    @property
    def ma_top(self) -> int:
        return self.q + self.sq * self.period

    @property
    def size(self) -> int:
        return int(self.constant) + self.p + self.sp + self.q + self.sq

    def long(self, n: int) -> int:
        """Lags of the long autoregression whose residuals stand in for the innovations at first."""
        return min(max(10, self.ar_top + 2, self.ma_top + 2), max(1, n // 4)) if self.q + self.sq else 0

    def fits(self, n: int) -> bool:
        return n >= 2 * self.size + max(self.ar_top, self.ma_top) + self.long(n) + 3

    def parts(self, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(constant, phi, Phi, theta, Theta) as polynomials from lag 0 on."""
        at = int(self.constant)
        out = []
        for count, step, sign in ((self.p, 1, -1), (self.sp, self.period, -1), (self.q, 1, 1), (self.sq, self.period, 1)):
            poly = np.zeros(count * step + 1)
            poly[0], poly[step::step] = 1.0, sign * beta[at : at + count]
            out.append(poly)
            at += count
        return (float(beta[0]) if self.constant else 0.0, *out)

    def invertible(self, beta: np.ndarray) -> bool:
        _, _, _, theta, seasonal = self.parts(beta)
        return all(len(m) == 1 or not m[1:].any() or np.abs(np.roots(m)).max() <= limit for m, limit in ((theta, RADIUS), (seasonal[:: self.period] if self.sq else seasonal, RADIUS**self.period)))


def differenced(y: np.ndarray, order: Order) -> np.ndarray:
    for step in [1] * order.d + [order.period] * order.sd:
        y = y[step:] - y[:-step]
    return y


def _inverse(poly: np.ndarray, n: int) -> np.ndarray:
    """The first n coefficients of 1 / poly, doubled by Newton steps."""
    out = np.array([1.0 / poly[0]])
    while len(out) < n:
        m = min(2 * len(out), n)
        out = 2 * np.pad(out, (0, m - len(out))) - _product(_product(out, out, m), poly[:m], m)
    return out


def _product(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The first n values of the convolution of two sequences."""
    if min(len(a), len(b)) <= 64:
        return np.pad(np.convolve(a, b), (0, n))[:n]
    size = 1 << (len(a) + len(b) - 2).bit_length()
    return np.pad(np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[: len(a) + len(b) - 1], (0, n))[:n]


def _back(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([np.zeros(min(k, len(x))), x[: max(0, len(x) - k)]])


def innovations(x: np.ndarray, order: Order, beta: np.ndarray, jacobian: bool = True) -> np.ndarray:
    """Columns: the innovations and their derivatives by each parameter; zero before the first full set of lags."""
    n = len(x)
    constant, phi, sphi, theta, stheta = order.parts(beta)
    with np.errstate(all="ignore"):
        ma = _product(theta, stheta, order.ma_top + 1)
        response = _inverse(ma, n) if order.ma_top else np.ones(1)

        def solved(w: np.ndarray) -> np.ndarray:
            w = w.copy()
            w[: order.ar_top] = 0.0
            return _product(w, response, n) if order.ma_top else w

        e = solved(_product(x, _product(phi, sphi, order.ar_top + 1), n) - constant)
        if not jacobian:
            return e[:, None]
        columns = [e] + ([solved(np.full(n, -1.0))] if order.constant else [])
        plain, seasonal = _product(x, sphi, n), _product(x, phi, n)
        columns += [solved(-_back(plain, i)) for i in range(1, order.p + 1)]
        columns += [solved(-_back(seasonal, order.period * i)) for i in range(1, order.sp + 1)]
        plain, seasonal = _product(e, stheta, n), _product(e, theta, n)
        columns += [_product(-_back(plain, i), response, n) for i in range(1, order.q + 1)]
        columns += [_product(-_back(seasonal, order.period * i), response, n) for i in range(1, order.sq + 1)]
        return np.stack(columns, axis=1)


def _lagged(x: np.ndarray, lags: list[int]) -> list[np.ndarray]:
    return [_back(x, k) for k in lags]


@dataclass
class Search:
    """Where the fit of one series stands: what is to be summed next, and the best parameters so far."""

    n: int  # values after differencing
    stage: str = "start"  # long, start, trial, done
    noise: np.ndarray | None = None  # the long autoregression
    beta: np.ndarray | None = None
    gram: np.ndarray | None = None
    trial: np.ndarray | None = None
    damping: float = 1e-3
    steps: int = 0


def _stored(search: Search) -> bytes:
    return pickle.dumps(vars(search))


def _loaded(stored: bytes) -> Search:
    return Search(**pickle.loads(stored))


def begin(n: int, order: Order) -> Search:
    return Search(n, "long" if order.q + order.sq else "start")


def gram(x: np.ndarray, own: int, at_start: bool, order: Order, search: Search) -> np.ndarray:
    """The Gram matrix the search asks for, over the values from ``own`` on (``x`` is differenced, with what lies before)."""
    long = order.long(search.n)
    if search.stage == "long":
        columns, first = [x, np.ones(len(x)), *_lagged(x, list(range(1, long + 1)))], long
    elif search.stage == "start":
        noise = np.zeros(len(x))
        if long:
            noise = x - np.stack([np.ones(len(x)), *_lagged(x, list(range(1, long + 1)))], axis=1) @ search.noise
            noise[:long] = 0.0
        ones = [np.ones(len(x))] if order.constant else []
        seasons = [order.period * i for i in range(1, order.sp + 1)]
        columns = [x, *ones, *_lagged(x, [*range(1, order.p + 1), *seasons])]
        columns += _lagged(noise, [*range(1, order.q + 1), *(order.period * i for i in range(1, order.sq + 1))])
        first = long + max(order.ar_top, order.ma_top)
    else:
        columns, first = list(innovations(x, order, search.trial).T), order.ar_top
    rows = np.stack(columns, axis=1)[max(own, first if at_start else 0) :]
    with np.errstate(all="ignore"):
        return rows.T @ rows


def _solve(gram_: np.ndarray, damping: float = 0.0) -> np.ndarray:
    """Least squares of the first column on the others."""
    inner = gram_[1:, 1:] + damping * np.diag(np.diag(gram_)[1:])
    return np.linalg.lstsq(inner, gram_[1:, 0], rcond=None)[0]


def advance(search: Search, order: Order, got: np.ndarray) -> Search:
    """The search after the Gram matrix it asked for."""
    search.steps += 1
    if search.stage == "long":
        search.noise, search.stage = _solve(got), "start"
        return search
    if search.stage == "start":
        beta = _solve(got) if order.size else np.empty(0)
        ma = slice(order.size - order.q - order.sq, order.size)
        for _ in range(60):
            if order.invertible(beta):
                break
            beta[ma] *= 0.9
        search.trial, search.stage = beta, "trial"
        return search
    better = np.isfinite(got).all() and (search.gram is None or got[0, 0] < search.gram[0, 0])
    if better:
        gain = np.inf if search.gram is None else 1 - got[0, 0] / max(search.gram[0, 0], 1e-300)
        search.beta, search.gram = search.trial, got
        search.damping = max(search.damping / 10, 1e-12)
    else:
        gain, search.damping = np.inf, search.damping * 10
    if search.gram is None or not order.size or gain < EXACT or search.damping > 1e6 or search.steps >= STEPS:
        search.stage = "done"
        return search
    for _ in range(20):
        trial = search.beta - _solve(search.gram, search.damping)
        if np.isfinite(trial).all() and order.invertible(trial):
            search.trial = trial
            return search
        search.damping *= 10
    search.stage = "done"
    return search


def fit(y: np.ndarray, order: Order) -> np.ndarray | None:
    """Parameters of a series held as an array, or None if it is too short or nothing fits."""
    x = differenced(y, order)
    if not order.fits(len(x)):
        return None
    search = begin(len(x), order)
    while search.stage != "done":
        search = advance(search, order, gram(x, 0, True, order, search))
    return search.beta


def ahead(y: np.ndarray, order: Order, beta: np.ndarray, horizon: int) -> np.ndarray:
    """The next values after ``y``, which may be the end of a longer series."""
    x = differenced(y, order)
    e = innovations(x, order, beta, jacobian=False)[:, 0]
    constant, phi, sphi, theta, stheta = order.parts(beta)
    ar, ma = _product(phi, sphi, order.ar_top + 1), _product(theta, stheta, order.ma_top + 1)
    path, shocks = x.tolist(), e.tolist()
    for _ in range(horizon):
        nxt = constant - sum(c * path[-k] for k, c in enumerate(ar.tolist()) if k and c) + sum(c * shocks[-k] for k, c in enumerate(ma.tolist()) if k and c)
        path.append(nxt)
        shocks.append(0.0)
    out, steps = path[len(x) :], [1] * order.d + [order.period] * order.sd
    for i in reversed(range(len(steps))):  # undo the differences, last first
        history = y
        for step in steps[:i]:
            history = history[step:] - history[:-step]
        history = history[-steps[i] :].tolist()
        for h in range(horizon):
            history.append(history[-steps[i]] + out[h])
        out = history[steps[i] :]
    return np.array(out)


def fit_chunks(chunks: DataFrame, key, order: Order) -> DataFrame:
    """(key…, beta) of the series of ``series_chunks``: one pass over the chunks and one fold for each step of the search."""
    keys = as_list(key)
    fields = [chunks.schema[k] for k in keys]
    part_schema = T.StructType([*fields, T.StructField("chunk", T.LongType()), T.StructField("part", T.BinaryType())])
    state_schema = T.StructType([*fields, T.StructField("search", T.BinaryType()), T.StructField("open", T.BooleanType())])

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        return match(left, right, keys) if keys else left.crossJoin(F.broadcast(right))  # one row without a key

    def started(frames):
        for f in frames:
            yield f[keys].assign(search=[_stored(begin(int(t) - order.lost, order)) for t in f["total"]], open=True)

    def summed(frames):
        for f in frames:
            made = []
            for chunk, own, values, search in zip(f["chunk"], f["own"], f["values"], f["search"], strict=True):
                x = differenced(np.asarray(values, float), order)
                made.append(pickle.dumps(gram(x, max(0, own - order.lost), chunk == 0, order, _loaded(search))))
            yield f[[*keys, "chunk"]].assign(part=made)

    def stepped(frames):
        for f in frames:
            after = [advance(_loaded(s), order, pickle.loads(p)) for s, p in zip(f["search"], f["part"], strict=True)]
            yield f[keys].assign(search=[_stored(s) for s in after], open=[s.stage != "done" for s in after])

    def combine(parts: list[bytes]) -> bytes:
        return pickle.dumps(sum(pickle.loads(p) for p in parts))

    state = materialize(chunks.where("chunk = 0").select(*[col(k) for k in keys], "total").mapInPandas(started, state_schema))
    done: list[DataFrame] = []
    for _ in range(STEPS + 2):
        sums = ch.fold_chunks(materialize(joined(chunks, state.drop("open")).mapInPandas(summed, part_schema)), keys, combine)
        after = materialize(joined(sums, state.drop("open")).mapInPandas(stepped, state_schema))
        done.append(after.where(~F.col("open")))
        state = after.where("open")
        if state.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("open")


def arima_forecast(known: DataFrame, horizon: int, sort, key=None, order: Order = Order(), size: int | None = None, burn: int = BURN) -> DataFrame:  # noqa: B008
    """(key…, step, forecast); a series too short for its model, or without a finite forecast, goes on with its mean."""
    keys = as_list(key)
    back = burn + order.lost + order.ar_top + order.ma_top
    length = max(size or ch.SIZE, back)
    chunks = ch.series_chunks(known, sort, "value", keys, length, back)
    schema = T.StructType([*[chunks.schema[k] for k in keys], T.StructField("step", T.IntegerType()), T.StructField("forecast", T.DoubleType())])

    def path(values: np.ndarray, beta, mean: float) -> np.ndarray:
        out = np.full(horizon, np.nan) if beta is None else ahead(values, order, beta, horizon)
        return out if np.isfinite(out).all() else np.full(horizon, mean)

    def rows(f: pd.DataFrame, betas: list) -> pd.DataFrame:
        out = f[keys].loc[f.index.repeat(horizon)].reset_index(drop=True)
        paths = [path(np.asarray(v, float), b, m) for v, b, m in zip(f["values"], betas, f["mean"], strict=True)]
        return out.assign(step=np.tile(np.arange(1, horizon + 1, dtype=np.int32), len(f)), forecast=np.concatenate(paths) if paths else [])

    def whole(frames):
        for f in frames:
            yield rows(f, [fit(np.asarray(v, float), order) for v in f["values"]])

    single = chunks.where(F.col("total") <= length).mapInPandas(whole, schema)  # a series of one chunk is fitted where it lies
    long = chunks.where(F.col("total") > length)
    if long.isEmpty():
        return single
    found = fit_chunks(long, keys, order)
    last = long.where(F.col("chunk") == F.expr(f"(total - 1) div {length}")).drop("chunk")

    def carried(frames):
        for f in frames:
            yield rows(f, [_loaded(s).beta for s in f["search"]])

    told = match(last, found, keys) if keys else last.crossJoin(F.broadcast(found))
    return single.unionByName(told.mapInPandas(carried, schema))
