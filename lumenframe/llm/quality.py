"""Quality classifier: a sparse rule ensemble compiled to Spark column expressions.

1. Each text gets statistics of its characters, words and lines, whole texts in one pass.
2. Shallow trees of a random forest are grown on the labelled rows' statistics; every path from a root becomes a rule, a
   conjunction of bounds on statistics.
3. Rules become 0/1 columns of the labelled rows, and a logistic regression with an L1 penalty weighs them; most weights
   are zero.
4. The remaining rules are Spark column expressions over the statistics, and the score is the logistic function of the
   sum of the weights of the rules that hold.

Training is bounded: at most ``max_rows`` labelled texts, those with the smallest hash of their id.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import bytetext as bt
from lumenframe.llm.toxicity import held_out
from lumenframe.plans.storage import materialize

STATS = (
    "chars words lines word_length longest_word upper digits marks spaces wide mark_ended upper_words digit_words "
    "distinct_words top_word distinct_pairs line_length distinct_lines short_words mark_kinds"
).split()

_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_WIDE_LEAD = np.arange(256) >= 0xC0
_CONTINUES = (np.arange(256) & 0xC0) == 0x80
_MARK = ~(bt.LETTERS | bt.SPACES)
# marks that end ordinary sentences and clauses do not count as odd endings
_ODD_END = _MARK.copy()
_ODD_END[[ord(c) for c in ".,;:?)\"'"]] = False


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets]).astype(float)


def _distinct(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the count of the most frequent one, by row."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    edge = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])))) if len(rows) else np.empty(0, np.int64)
    length = np.diff(np.append(edge, len(rows)))
    distinct, top = np.zeros(len(first) - 1), np.zeros(len(first) - 1)
    np.add.at(distinct, rows[edge], 1)
    np.maximum.at(top, rows[edge], length)
    return distinct, top


def _chunk_stats(data: np.ndarray, offsets: np.ndarray, words: bt.Words, lines: bt.Words) -> np.ndarray:
    n = len(offsets) - 1
    start, end = bt.word_bounds(data, offsets)
    first = np.searchsorted(start, offsets)
    chars = _sums(~_CONTINUES[data], offsets)
    count = np.diff(first).astype(float)
    per = lambda x, y: x / np.maximum(y, 1)
    length = (end - start).astype(float)
    longest = np.zeros(n)
    rows = np.repeat(np.arange(n), np.diff(first))
    np.maximum.at(longest, rows, length)
    upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
    digit = np.concatenate(([0], np.cumsum(_DIGIT[data])))
    letters = np.concatenate(([0], np.cumsum(bt.LETTERS[data])))
    ups, digs, lets = upper[end] - upper[start], digit[end] - digit[start], letters[end] - letters[start]
    word_sum = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[first]).astype(float)
    distinct, top = _distinct(words.hash, first)
    pairs = words.hash.copy()
    pairs[:-1] = bt.mix(words.hash[:-1] * np.uint64(0x2545F4914F6CDD1D) + words.hash[1:])
    distinct_pairs, _ = _distinct(pairs, first)
    line_count = np.diff(lines.first).astype(float)
    distinct_lines, _ = _distinct(lines.hash, lines.first)
    odd = _ODD_END[data[end - 1]] if len(end) else np.empty(0, bool)
    kinds, _ = _distinct(data[end - 1][odd].astype(np.uint64) if len(end) else np.empty(0, np.uint64), np.concatenate(([0], np.cumsum(word_sum(odd)))).astype(int))
    marks = _sums(_MARK[data], offsets)
    return np.column_stack(
        [
            chars, count, line_count, per(word_sum(length), count), longest, per(_sums(_UPPER[data], offsets), chars), per(_sums(_DIGIT[data], offsets), chars),
            per(marks, chars), per(_sums(bt.SPACES[data], offsets), chars), per(_sums(_WIDE_LEAD[data], offsets), chars), per(word_sum(odd), count),
            per(word_sum((ups > 1) & (ups * 10 >= lets * 6)), count), per(word_sum(digs > 0), count), per(distinct, count), per(top, count), per(distinct_pairs, count),
            per(chars, line_count), per(distinct_lines, line_count), per(word_sum(length <= 2), count), kinds,
        ]
    )


_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and ``STATS`` of every row; a null text is empty and has zeros."""

    def run(batches):
        for b in batches:
            parts = []
            column = b.column("text")
            for (_, _, data, offsets), words, lines in zip(bt.text_chunks(column), bt.words(column), bt.words(column, _LINE), strict=True):
                parts.append(_chunk_stats(data, offsets, words, lines))
            stats = np.concatenate(parts) if parts else np.empty((0, len(STATS)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *(pa.array(stats[:, i]) for i in range(len(STATS)))], [*keep, *STATS])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keep] + [f"{s} double" for s in STATS])
    return docs.select(*keep, "text").mapInArrow(run, schema)


Rule = tuple[tuple[str, str, float], ...]


def tree_rules(debug: str, names: list[str]) -> list[Rule]:
    """The paths (also inner ones) of the trees in a forest's printed form, each a sorted tuple of (statistic, sign, bound)."""
    rules, path = set(), []
    for line in debug.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-0-9.eE]+)\)", line)
        if line.strip().startswith("Tree"):
            path = []
        elif m:
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (names[int(m[3])], m[4], float(m[5])))]
            rules.add(_tightest([p[1] for p in path]))
    return sorted(rules)


def _tightest(terms) -> Rule:
    best: dict[tuple[str, str], float] = {}
    for name, sign, bound in terms:
        had = best.get((name, sign))
        best[name, sign] = bound if had is None else (min if sign == "<=" else max)(had, bound)
    return tuple(sorted((name, sign, bound) for (name, sign), bound in best.items()))


def compiled(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [F.col(name) <= bound if sign == "<=" else F.col(name) > bound for name, sign, bound in rule])


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 16_000, trees: int = 12, depth: int = 3, penalty: float = 0.002, seed: int = 7
) -> tuple[float, list[tuple[float, Rule]]]:
    """(intercept, weighted rules). Rows with a null id or label are left out; without both labels there are no rules."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    rows = materialize(statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), keep=("doc_id", "y"))).coalesce(4)
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(counts) < 2:
        return (30.0 if 1.0 in counts else -30.0 if counts else 0.0), []
    total = sum(counts.values())
    weight = F.when(F.col("y") > 0.5, total / 2 / counts[1.0]).otherwise(total / 2 / counts[0.0])
    rows = rows.withColumn("weight", weight)
    dense = VectorAssembler(inputCols=list(STATS), outputCol="x").transform(rows).select("doc_id", "x", "y", "weight").orderBy("doc_id").coalesce(1)  # bounded
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="weight", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=seed).fit(dense)
    rules = tree_rules(forest.toDebugString, list(STATS))
    if not rules:
        return float(np.log(counts[1.0] / counts[0.0])), []
    flags = rows.select("y", "weight", F.array(*[compiled(r).cast("double") for r in rules]).alias("f"))
    from pyspark.ml.functions import array_to_vector

    vectors = materialize(flags.select("y", "weight", array_to_vector("f").alias("x")).coalesce(1))
    fit = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", regParam=penalty, elasticNetParam=1.0, standardization=False, maxIter=60).fit(vectors)
    return float(fit.intercept), [(float(w), r) for w, r in zip(fit.coefficients.toArray(), rules, strict=True) if w]


def score(docs: DataFrame, intercept: float, rules: list[tuple[float, Rule]]) -> DataFrame:
    """doc_id and score of every row of ``docs``."""
    total = reduce(lambda a, b: a + b, [F.when(compiled(r), F.lit(w)).otherwise(0.0) for w, r in rules], F.lit(intercept))
    return statistics(docs).select("doc_id", (1 / (1 + F.exp(-total))).alias("score"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text); learns only outside the held-out quarter.

    Empty and null texts are scored by their statistics, which are zeros. A null id is kept, with held_out false.
    """
    model = train(docs, labels.where(~held_out(F.col("doc_id"), 4, 2)))
    return score(docs, *model).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id"), 4, 2), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
