"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed single words, word pairs and skip-grams (pairs with one and two words
between), each kind in a range of hash buckets of its own. FTRL-proximal gives every coordinate its own learning rate.
Its L1 bar is at least ``l1`` and at least ``noise`` times the root of the coordinate's summed squared gradients, so a
weight leaves zero only when its gradients point one way more than chance would; few weights remain, and the model is a
short sorted table that travels with the task. Two last parameters, fitted with balanced classes, put the margins on the
0 to 1 scale.

Training is bounded: at most ``max_rows`` labelled texts, those with the smallest hash of their id, are fitted in one
task. Features in fewer than ``min_rows`` of them are not admitted. Scoring is one pass over all rows without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import bytetext as bt
from lumenframe.plans.storage import give_back

WORD_BITS, PAIR_BITS = 23, 22
KINDS = (((0,), WORD_BITS), ((0, 1), PAIR_BITS), ((0, 2), PAIR_BITS), ((0, 3), PAIR_BITS))


def features(w: bt.Words) -> Iterator[np.ndarray]:
    """Sorted distinct buckets (uint32) of each row."""
    base, kinds = 0, []
    for k, (gaps, bits) in enumerate(KINDS):
        kinds.append(((bt.chain(w.hash, gaps, salt=k + 1) >> np.uint64(64 - bits)).astype(np.uint32) + np.uint32(base), max(gaps)))
        base += 1 << bits
    for i in range(w.rows):
        a, b = w.first[i], w.first[i + 1]
        part = np.sort(np.concatenate([buckets[a : max(a, b - gap)] for buckets, gap in kinds]))
        yield part[np.concatenate(([True], part[1:] != part[:-1]))] if len(part) else part


@dataclass
class Weights:
    """``score = 1 / (1 + exp(-(bias + sum of the weights of the buckets present)))``."""

    bias: float
    buckets: np.ndarray
    values: np.ndarray

    def margins(self, w: bt.Words) -> np.ndarray:
        """One margin per row: only occurrences of weighted buckets are kept, then made distinct within the row."""
        out = np.full(w.rows, self.bias)
        if not len(self.buckets) or not len(w.hash):
            return out
        present = np.zeros(sum(1 << bits for _, bits in KINDS) >> 3, bool)  # a coarse screen before the exact lookup
        present[self.buckets >> 3] = True
        row_of = np.repeat(np.arange(w.rows), np.diff(w.first))
        last = w.first[1:][row_of]
        rows, slots, base = [], [], 0
        for k, (gaps, bits) in enumerate(KINDS):
            bucket = (bt.chain(w.hash, gaps, salt=k + 1) >> np.uint64(64 - bits)).astype(np.int64) + base
            base += 1 << bits
            at = np.flatnonzero(present[bucket >> 3])
            at = at[at + max(gaps) < last[at]]
            slot = np.minimum(np.searchsorted(self.buckets, bucket[at]), len(self.buckets) - 1)
            hit = self.buckets[slot] == bucket[at]
            rows.append(row_of[at[hit]])
            slots.append(slot[hit])
        pairs = np.unique(np.concatenate(rows) * len(self.buckets) + np.concatenate(slots))
        np.add.at(out, pairs // len(self.buckets), self.values[pairs % len(self.buckets)])
        return out


def admitted(rows: list[np.ndarray], min_rows: int) -> np.ndarray:
    """Sorted buckets that at least ``min_rows`` of the rows of distinct buckets hold; a small counter per bucket."""
    times = np.zeros(sum(1 << bits for _, bits in KINDS), np.uint8 if min_rows < 0xFF else np.uint16)
    for r in rows:
        times[r] += times[r] < min_rows  # counted no further
    return np.flatnonzero(times >= min_rows)


def places(rows: list[np.ndarray], seen: np.ndarray) -> list[np.ndarray]:
    """Each row as places (from 1) in ``seen``, other buckets left out."""
    out = []
    for r in rows:
        at = np.searchsorted(seen, r).astype(np.int32)
        at[at == len(seen)] = 0
        out.append(at[seen[at] == r] + 1 if len(seen) else np.empty(0, np.int32))
    return out


def ftrl(dense: list[np.ndarray], size: int, labels: np.ndarray, alpha: float, beta: float, l1: float, l2: float, noise: float, epochs: int) -> np.ndarray:
    """Weights of ``size`` features, the bias first. ``dense``: the features of each row, from 1. The bias has no L1."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def current(i):
        zi, root = z[i], np.sqrt(n[i])
        bar = np.where(i == 0, 0.0, np.maximum(l1, noise * root))
        return np.where(np.abs(zi) <= bar, 0.0, -(zi - np.sign(zi) * bar) / ((beta + root) / alpha + l2))

    order = np.arange(len(dense))
    for _ in range(epochs):
        for r in order:
            i = np.concatenate(([0], dense[r]))
            w = current(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[r]
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
        order = order[::-1]
    return current(np.arange(size + 1))


def scale(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of balanced labels on the margins (Newton steps, pulled towards 1 and 0)."""
    weight = np.where(labels > 0.5, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    slope, shift = 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -35, 35)))
        g, h = weight * (p - labels), weight * p * (1 - p)
        step = np.linalg.solve([[(h * margin**2).sum() + 1, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1]], [(g * margin).sum() + slope - 1, g.sum() + shift])
        slope, shift = slope - step[0], shift - step[1]
    return max(slope, 0.1), shift


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 16_000, alpha: float = 5.0, beta: float = 1.0,
    l1: float = 1.0, l2: float = 0.1, noise: float = 3.0, epochs: int = 6, min_rows: int = 5,
) -> Weights:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, <label> 0/1); other columns are not read.

    Rows with a null id or label are left out and several labels of one id count as their largest. Without labelled texts
    of both kinds there are no weights and every text scores 0. ``max_rows`` bounds the training sample at any input size.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_rows narrow rows

    def encode(batches):
        for b in batches:
            out = [f.tobytes() for w in bt.words(b.column("text"), bt.LETTERS) for f in features(w)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("y"), pa.array(out, pa.binary())], ["doc_id", "y", "x"])
            del out
        give_back()

    def fit(batches):
        """The one task that sees the sample: its rows stay Arrow buffers until they are short lists of places."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        ids, y = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("doc_id", "y"))
        if not 0 < y.mean() < 1:
            yield pa.RecordBatch.from_pydict({"bucket": [-1], "w": [-35.0]})
            return
        buckets = [np.frombuffer(x.as_buffer() or b"", np.uint32) for b in held for x in b.column("x")]
        seen, key = admitted(buckets, min_rows), pd.util.hash_array(ids)
        # by the hash of the id; rows that share it by their features
        twice = pd.Series(key).duplicated(keep=False).to_numpy()
        order = sorted(range(len(key)), key=lambda i: (key[i], buckets[i].tobytes() if twice[i] else b""))
        del buckets, key
        dense = []
        for at in range(len(held)):
            # features are freed as they become places
            b, held[at] = held[at], None
            dense += places([np.frombuffer(x.as_buffer() or b"", np.uint32) for x in b.column("x")], seen)
            del b
        dense, y = [dense[i] for i in order], y[order]
        w = ftrl(dense, len(seen), y, alpha, beta, l1, l2, noise, epochs)
        slope, shift = scale(np.array([w[0] + w[r].sum() for r in dense]), y)
        keep = np.flatnonzero(w[1:])
        del dense
        give_back()
        yield pa.RecordBatch.from_pydict({"bucket": np.append(seen[keep], -1), "w": np.append(w[1:][keep] * slope, w[0] * slope + shift)})

    encoded = sample.mapInArrow(encode, "doc_id long, y double, x binary")
    fitted = encoded.repartition(1).mapInArrow(fit, "bucket long, w double")
    table = fitted.toPandas().sort_values("bucket")  # bounded by the sample
    if not len(table):
        return Weights(-35.0, np.empty(0, np.int64), np.empty(0))
    return Weights(float(table["w"].iloc[0]), table["bucket"].to_numpy(np.int64)[1:], table["w"].to_numpy(float)[1:])


def score(docs: DataFrame, model: Weights) -> DataFrame:
    """(doc_id, score) of every row; an empty or null text has the score of the bias alone, a null id stays null."""

    def run(batches):
        for b in batches:
            parts = [model.margins(w) for w in bt.words(b.column("text"), bt.LETTERS)]
            margin = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(margin, -35, 35))))], ["doc_id", "score"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id, folds: int, fold: int):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; learns only from ids outside the held-out third."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"), 3, 1)))
    return score(docs, model).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id"), 3, 1), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
