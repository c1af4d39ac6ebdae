"""Exact nearest neighbours by a metric cell index.

Every point belongs to the cell of its nearest pivot and keeps its distance to it. A query first looks into its own cell,
which bounds its k-th distance. The bound then rules out other cells by the triangle inequality (distance to the pivot less
the cell's radius) and by the plane between two pivots, and rules out single points of the remaining cells by their distance
to a centre. Cells and queries are packed into tiles of bounded size, which are written down; files of tiles of queries meet
files of tiles of points where a cell is reached, as pairs of rows that are never shuffled, however many cells a query reaches.
Where cells hold few queries, those of several cells share a tile. Products of matrices choose the pairs that are measured
exactly, and only points within the bound leave a comparison.

Equal points are one point with its k + 1 smallest ids, and equal queries are one query, so a value that a third of the rows
share costs no pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.columns import col
from lumenframe.plans.joins import match
from lumenframe.plans.storage import materialize

TILE = 2_000  # points or queries in a tile
STEP = 256  # queries measured at a time
MEASURED = 1 << 15  # pairs of a query and a point measured exactly at a time
HELD = 8  # tiles in a file, so that a task holds few of them
PIVOTS = 4_096  # at most; their rows are held by every task
SLACK = 1e-9  # of a squared distance, for rounding


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T, 0.0)


def _stack(column) -> np.ndarray:
    return np.stack(column).astype(float)


def _placed(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Points (id, x) with cell and r, the number of the nearest pivot and the distance to it."""

    def run(frames):
        for f in frames:
            if len(f):
                d = squared(_stack(f["x"]), pivots)
                cell = d.argmin(axis=1)
                yield f.assign(cell=cell.astype(np.int32), r=np.sqrt(d[np.arange(len(f)), cell]))

    return points.mapInPandas(run, "id long, x array<double>, cell int, r double")


def _tiles(rows: DataFrame, fields: list[str], tile: int, prefix: str) -> DataFrame:
    """At most some ``tile`` rows of a cell packed into one row, dealt by id: cell and an array for each field."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).alias("_parts"))
    dealt = match(rows, sizes, ["cell"]).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")))
    held = dealt.groupBy("cell", "_part").agg(F.collect_list(F.struct(*fields)).alias("_rows"))
    return held.select("cell", *[(F.flatten(F.col("_rows.x")) if f == "x" else F.col(f"_rows.{f}")).alias(prefix + f) for f in fields])


class _Nearest:
    """The nearest points so far of the queries of one tile, with the squared distance beyond which a point is none of them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, bound: np.ndarray, own: np.ndarray, keep: int):
        self.ids, self.x, self.keep, self.own = ids, x, keep, own
        self.bound = bound.astype(float)
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]  # query, point, squared distance
        self.fresh = 0

    def meet(self, t_ids: np.ndarray, t: np.ndarray, cell: int) -> None:
        """Measure the points of a tile that may be nearer than the bounds; those of a query's own cell are known already."""
        given, centre = t, t.mean(axis=0)
        t = t - centre
        r = np.sqrt((t * t).sum(axis=1))
        on = np.flatnonzero(self.own != cell)
        q = self.x[on] - centre
        far = np.sqrt((q * q).sum(axis=1))
        limit = self.bound[on] * (1 + SLACK) + SLACK * (1 + far)
        near = far - r.max() <= limit
        on, q, far, limit = on[near], q[near], far[near], limit[near]
        if not len(on):
            return
        # a point nearer than the bound lies in a shell around the centre
        shell = (r >= (far - limit).min()) & (r <= (far + limit).max())
        t_ids, given, t, r = t_ids[shell], given[shell], t[shell], r[shell]
        if not len(t):
            return
        span = float((far.max() + r.max()) ** 2)
        kind = np.float32 if 1e-25 < span < 1e30 else np.float64
        error = 2 * (t.shape[1] + 16) * float(np.finfo(kind).eps)  # of a distance from a product of matrices, in parts of (far + r) squared
        slack = (error + SLACK) * (far + r.max()) ** 2
        left, right = np.column_stack([q, far**2, np.ones(len(q))]).astype(kind), np.column_stack([-2 * t, np.ones(len(t)), r**2]).astype(kind).T
        for at in range(0, len(on), STEP):
            here = slice(at, at + STEP)
            d = left[here] @ right
            most = limit[here] ** 2
            if np.isinf(most).any():
                n = min(self.keep, d.shape[1])
                most = np.minimum(most, np.maximum(np.partition(d, n - 1, axis=1)[:, n - 1], 0) + slack[here])
            i, j = np.divmod(np.flatnonzero(d <= (most + slack[here]).astype(kind)[:, None]), d.shape[1])
            for some in range(0, len(i), MEASURED):
                a, b = i[some : some + MEASURED], j[some : some + MEASURED]
                self.add(on[here][a], t_ids[b], ((self.x[on[here][a]] - given[b]) ** 2).sum(axis=1))

    def add(self, i: np.ndarray, tid: np.ndarray, d: np.ndarray) -> None:
        self.found.append((i, tid, d))
        self.fresh += len(i)
        if self.fresh > self.keep * len(self.ids):
            self.settle()

    def settle(self) -> None:
        i, tid, d = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((tid, d, i))
        i, tid, d = i[order], tid[order], d[order]
        on = (rank := np.arange(len(i)) - np.searchsorted(i, i)) < self.keep
        last = rank == self.keep - 1
        self.bound[i[last]] = np.minimum(self.bound[i[last]], np.sqrt(d[last]))
        self.found, self.fresh = [(i[on], tid[on], d[on])], 0

    def rows(self) -> pd.DataFrame:
        self.settle()
        i, tid, d = self.found[0]
        return pd.DataFrame({"qid": self.ids[i], "tid": tid, "d": d})


def _compared(pairs: DataFrame, keep: int) -> DataFrame:
    """(qid, tid, d): candidates of every pair of a tile of queries (q…) and a tile of points (t…, cell).

    Pairs of one tile of queries that follow each other share its bounds, which get closer, and leave ``keep`` rows a query.
    """

    def run(frames):
        held = None
        for f in frames:
            for q_ids, x, bound, own, t_ids, t, cell in zip(*(f[n] for n in ("q_id", "q_x", "q_bound", "q_own", "t_id", "t_x", "cell")), strict=True):
                if held is None or not np.array_equal(held.ids, q_ids):
                    if held is not None:
                        yield held.rows()
                    held = _Nearest(q_ids, x.reshape(len(q_ids), -1).astype(float), bound, own, keep)
                held.meet(t_ids, t.reshape(len(t_ids), -1).astype(float), cell)
        if held is not None:
            yield held.rows()

    return pairs.mapInPandas(run, "qid long, tid long, d double")


def _reached(tiles: DataFrame, pivots: np.ndarray, sizes: np.ndarray, radii: np.ndarray, keep: int) -> DataFrame:
    """Every tile of queries with the other cells that may hold one of the ``keep`` nearest of some of them.

    ``q_known``: the distance of the keep-th candidate of the own cell, infinite if that has fewer points.
    """
    apart = np.sqrt(squared(pivots, pivots))

    def run(frames):
        for f in frames:
            for own, ids, all_x, all_r, all_known in zip(f["q_own"], f["q_id"], f["q_x"], f["q_r"], f["q_known"], strict=True):
                all_x, reached, bounds = all_x.reshape(len(ids), -1), np.zeros(len(pivots), bool), np.empty(len(ids))
                for at in range(0, len(ids), STEP):
                    here = slice(at, at + STEP)
                    x, r, home = all_x[here], all_r[here], own[here]
                    to = np.sqrt(squared(x, pivots))
                    reach = np.where(sizes > 0, to + radii, np.inf)  # no point of the cell is farther
                    order = np.argsort(reach, axis=1)
                    enough = (np.cumsum(sizes[order], axis=1) >= keep).argmax(axis=1)
                    bound = reach[np.arange(len(x)), order[np.arange(len(x)), enough]]
                    if sizes.sum() < keep:
                        bound[:] = np.inf
                    bounds[here] = bound = np.fmin(bound, all_known[here].astype(float))
                    bound = bound[:, None]
                    slack = SLACK * (1 + to + radii)
                    near = (to - radii <= bound + slack) & (sizes > 0)
                    gap = np.where(apart[home] > 0, (to**2 - r[:, None] ** 2) / np.maximum(2 * apart[home], 1e-300), 0.0)
                    near &= gap <= bound + slack * (1 + to / np.maximum(apart[home], 1e-300))
                    near[np.arange(len(x)), home] = False
                    reached |= near.any(axis=0)
                if reached.any():
                    yield pd.DataFrame({"q_id": [ids], "q_x": [all_x.ravel()], "q_bound": [bounds], "q_own": [own], "near": [np.flatnonzero(reached).astype(np.int32)]})

    return tiles.mapInPandas(run, "q_id array<long>, q_x array<double>, q_bound array<double>, q_own array<int>, near array<int>")


def _filed(tiles: DataFrame, rows: int, cells: int) -> DataFrame:
    """Tiles of so many rows in so many cells, written down in files of some ``HELD`` tiles."""
    return materialize(tiles.repartition(max(1, -(-(rows // TILE + cells) // HELD))))


def _first(rows: DataFrame, by: str, keep: int) -> DataFrame:
    best = Window.partitionBy(by).orderBy("d", "tid")
    return rows.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= keep).drop("_r")


def nearest(train: DataFrame, queries: DataFrame, keep: int, tile: int = TILE, pivots: int | None = None) -> DataFrame:
    """(qid, tid, d): the ``keep`` nearest points of each query by (squared distance, id).

    ``train``: distinct points (id, x); ``queries``: distinct points (id, x).
    """
    n = train.count()
    centred = pivots or min(PIVOTS, max(1, math.isqrt(n) // 4))
    chosen = train.orderBy(F.xxhash64("id"), "id").limit(centred).select("x").collect()  # at most PIVOTS rows
    if not chosen:
        return train.sparkSession.createDataFrame([], "qid long, tid long, d double")
    centres = np.array([r.x for r in chosen], float)
    cells = materialize(_placed(train, centres))
    facts = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r")).collect()  # a row per pivot
    sizes, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for f in facts:
        sizes[f.cell], radii[f.cell] = f.n, f.r
    packed = materialize(_tiles(cells, ["id", "x"], tile, "t_"))
    asked = materialize(_placed(queries, centres))

    tiles = _tiles(asked.withColumns({"bound": F.lit(math.inf), "own": F.lit(-1)}), ["id", "x", "bound", "own"], tile, "q_")
    own = materialize(_first(_compared(tiles.join(packed, "cell"), keep), "qid", keep))
    known = own.groupBy(F.col("qid").alias("id")).agg(F.when(F.count(F.lit(1)) >= keep, F.sqrt(F.max("d"))).alias("known"))
    # queries of so many cells share a tile as make it as large as a cell's points
    many = asked.count()
    wide = max(1, n // max(1, many))
    bounded = match(asked, known, ["id"], "left").select("id", "x", "r", F.coalesce("known", F.lit(math.inf)).alias("known"), F.col("cell").alias("own"), F.floor(F.col("cell") / wide).alias("cell"))
    # every tile of queries goes past the files of points: neither is copied for the cells it reaches
    tiles = _tiles(bounded, ["id", "x", "r", "known", "own"], max(tile, TILE), "q_")
    others = _filed(_reached(tiles, centres, sizes, radii, keep), many, -(-len(centres) // wide))
    points = _filed(packed if tile >= TILE else _tiles(cells, ["id", "x"], TILE, "t_"), n, len(centres))
    met = others.hint("shuffle_replicate_nl").join(points, F.array_contains("near", F.col("cell"))).drop("near")
    return _first(own.unionByName(_compared(met, keep)), "qid", keep)


def _vector(features) -> Column:
    return col(features).cast("array<double>") if isinstance(features, str) else F.array(*[col(c).cast("double") for c in features])


def knn(
    train_df: DataFrame, query_df: DataFrame, features, target: str, key: str, k: int = 5, problem: str = "classification",
    skip_self: bool = False, tile: int = TILE, pivots: int | None = None,
) -> DataFrame:
    """(key, prediction): majority label (smallest of tied ones) or mean of the k nearest training rows.

    Rows are ordered by (distance, key); keys are distinct. A training row or query with a missing feature is left out. ``skip_self`` leaves a
    row with the query's own key out of its neighbours.
    """
    whole = F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))
    kind = "string" if dict(train_df.dtypes)[target] == "string" else "double"
    t = train_df.select(col(key).cast("long").alias("tid"), _vector(features).alias("x"), col(target).cast(kind).alias("label")).where(whole)
    q = query_df.select(col(key).cast("long").alias("qid"), _vector(features).alias("x")).where(whole)
    keep = k + int(skip_self)
    first = Window.partitionBy("x").orderBy("tid")
    held = t.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= keep).groupBy("x").agg(F.min("tid").alias("id"), F.collect_list(F.struct("tid", "label")).alias("held"))
    points = materialize(held)
    asked = materialize(q.groupBy("x").agg(F.min("qid").alias("id"), F.count(F.lit(1)).alias("n")))
    near = nearest(points.select("id", "x"), asked.select("id", "x"), keep, tile, pivots)
    rows = match(near.withColumnRenamed("tid", "id"), points.select("id", "held"), ["id"])
    rows = rows.select("qid", "d", F.explode("held").alias("h")).select("qid", "d", F.col("h.tid").alias("tid"), F.col("h.label").alias("label"))
    few = materialize(_first(rows, "qid", keep))
    # every query gets the neighbours of its point
    same = match(q, asked.select("x", F.col("id").alias("_point")), ["x"]).select("qid", "_point")
    every = same.join(few.withColumnRenamed("qid", "_point"), "_point").drop("_point")
    if skip_self:
        every = every.where("tid <> qid")
    top = _first(every, "qid", k) if skip_self else every
    if problem == "regression":
        return top.groupBy(F.col("qid").alias(key)).agg(F.avg("label").alias("prediction"))
    votes = top.groupBy("qid", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(F.col("qid").alias(key)).agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("prediction"))
