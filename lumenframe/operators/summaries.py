"""LexRank summaries (Erkan and Radev, 2004): the sentences most central in the graph of similar sentences of a text.

A text of at most ``LONG`` sentences is ranked where it lies, with a bit for every pair of sentences. The sentences of a longer one are rows of their own: weights
come from counts by (text, term), and two sentences are compared only if they share one of the terms that could make them
similar. Terms are taken from the rarest on until what is left of a sentence's unit vector is no longer than the threshold;
the rarest term that two similar sentences share is among those of both. The ranks are power iterations as joins of the edges
with the ranks, each text until its own ranks settle.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenframe.functions.columns import col
from lumenframe.plans.spread import spread
from lumenframe.plans.storage import materialize, scratch_path

SIMILAR, SETTLED, ROUNDS = 0.1, 0.1, 100
LONG = 20_000  # sentences of a text in one task: their bits take 50 MB
PRODUCTS = 1 << 18  # of weights, and similarities, held at a time
PAIRS = 4_000_000  # of similar sentences held as numbers
DIGITS = 12  # of a rank: equal ranks are in text order


def split_sentences(text: str | None) -> list[str]:
    return [s.strip() for s in re.findall(r"[^.!?\n]+[.!?]*", text or "") if re.search(r"\w", s)]


def term_shares(sentence: str) -> dict[str, float]:
    """Count of each term over the largest count in the sentence."""
    counts = Counter(re.findall(r"\w+", sentence.lower()))
    most = max(counts.values())
    return {t: k / most for t, k in counts.items()}


def _similar(shares: list[dict[str, float]]) -> list[np.ndarray]:
    """Which sentences are more similar than the threshold: a bit for every pair, in blocks of rows whose products are held at a time."""
    n, index = len(shares), {}
    sizes = np.array([len(s) for s in shares])
    term = np.array([index.setdefault(t, len(index)) for s in shares for t in s], np.int64)
    at = np.repeat(np.arange(n), sizes)
    held = np.bincount(term, minlength=len(index))
    logs = np.array([math.log(n / (1 + k)) for k in range(int(held.max()) + 1)])
    weight = np.array([x for s in shares for x in s.values()]) * logs[held[term]]
    size = np.sqrt(np.bincount(at, weight * weight, n))
    weight /= np.where(size > 0, size, 1.0)[at]
    some = weight != 0
    at, term, weight = at[some], term[some], weight[some]
    by_term = np.argsort(term, kind="stable")
    other, other_weight = at[by_term], weight[by_term]
    meet = np.bincount(term, minlength=len(index))  # sentences that an entry meets
    first = np.cumsum(meet) - meet
    products = np.concatenate(([0], np.cumsum(meet[term])))  # before each entry
    entries = np.searchsorted(at, np.arange(n + 1))
    found, low = [], 0
    while low < n:
        high = min(n, low + max(1, PRODUCTS // n), max(low + 1, int(np.searchsorted(products[entries], products[entries[low]] + PRODUCTS, "right")) - 1))
        e = slice(entries[low], entries[high])
        many, ends = meet[term[e]], products[entries[low] + 1 : entries[high] + 1] - products[entries[low]]
        place = np.arange(int(many.sum())) + np.repeat(first[term[e]] - (ends - many), many)
        cell = np.repeat((at[e] - low) * n, many) + other[place]
        dots = np.bincount(cell, np.repeat(weight[e], many) * other_weight[place], (high - low) * n)
        found.append(np.packbits((dots > SIMILAR).reshape(-1, n), axis=1))
        low = high
    return found


def _pairs(similar: list[np.ndarray], n: int):
    """(source, target) of the bits, in order, a block at a time."""
    low = 0
    for bits in similar:
        source, target = np.nonzero(np.unpackbits(bits, axis=1, count=n))
        yield source + low, target
        low += len(bits)


def ranks(sentences: list[str]) -> np.ndarray:
    """Rank of every sentence of one text."""
    n = len(sentences)
    if not n:
        return np.empty(0)
    similar = _similar([term_shares(s) for s in sentences])
    pairs = list(_pairs(similar, n)) if n * n <= PAIRS else None  # else made anew from the bits
    degree = np.maximum(1, np.concatenate([np.bitwise_count(b).sum(axis=1, dtype=np.int64) for b in similar]))
    rank = np.full(n, 1.0 / n)
    for _ in range(ROUNDS):
        fresh, sent = np.zeros(n), rank / degree
        for source, target in pairs or _pairs(similar, n):
            fresh += np.bincount(target, sent[source], n)
        moved = float(np.linalg.norm(fresh - rank))
        rank = fresh
        if moved < SETTLED:
            break
    return rank


def summary(sentences: list[str], keep: int) -> str:
    if len(sentences) > keep:
        best = np.argsort(-np.round(ranks(sentences), DIGITS), kind="stable")[:keep]
        sentences = [sentences[i] for i in sorted(best)]
    return " ".join(sentences)


def _sentence_rows(texts: DataFrame) -> DataFrame:
    """(id, i, n, sentence, terms, shares) of texts (id, text)."""

    def run(frames):
        for f in frames:
            for doc, text in zip(f["id"], f["text"], strict=True):
                found = split_sentences(text)
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    shares = [term_shares(s) for s in part]
                    yield pd.DataFrame(
                        {"id": doc, "i": range(at, at + len(part)), "n": len(found), "sentence": part, "terms": [list(s) for s in shares], "shares": [list(s.values()) for s in shares]}
                    )

    return materialize(texts.mapInPandas(run, "id long, i long, n long, sentence string, terms array<string>, shares array<double>"))


def similar_sentences(rows: DataFrame) -> DataFrame:
    """(id, i, j): both directions of every pair more similar than the threshold, each sentence with itself included."""
    entries = rows.select("id", "i", "n", F.explode(F.arrays_zip("terms", "shares")).alias("t")).select("id", "i", "n", "t.terms", "t.shares")
    held = entries.groupBy("id", "terms").agg(F.count(F.lit(1)).alias("df"))
    weighed = entries.join(held, ["id", "terms"]).withColumn("w", F.col("shares") * F.log(F.col("n") / (1 + F.col("df")))).where("w <> 0")
    # rarest terms first
    lists = weighed.groupBy("id", "i").agg(F.sort_array(F.collect_list(F.struct("df", "terms", "w"))).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    unit = lists.select("id", "i", F.col("v.terms").alias("terms"), F.expr("transform(v, x -> x.w / size)").alias("ws"))
    left = "aggregate(slice(ws, p + 1, size(ws)), 0D, (s, x) -> s + x * x)"  # squared length from place p on
    unit = materialize(unit.withColumn("first", F.expr(f"transform(filter(sequence(0, size(ws) - 1), p -> {left} > {SIMILAR * SIMILAR * (1 - 1e-9)}), p -> terms[p])")))
    prefix = unit.select("id", F.explode("first").alias("term"), "i")
    pairs = prefix.join(prefix.withColumnRenamed("i", "j"), ["id", "term"]).where("i < j").select("id", "i", "j").distinct()
    a = unit.select("id", "i", F.col("terms").alias("ta"), F.col("ws").alias("wa"))
    b = unit.select("id", F.col("i").alias("j"), F.map_from_arrays("terms", "ws").alias("mb"))
    dot = F.expr("aggregate(arrays_zip(ta, wa), 0D, (s, x) -> s + x.wa * coalesce(mb[x.ta], 0D))")
    near = materialize(pairs.join(a, ["id", "i"]).join(b, ["id", "j"]).where(dot > SIMILAR).select("id", "i", "j"))
    return near.unionByName(near.select("id", F.col("j").alias("i"), F.col("i").alias("j"))).unionByName(unit.select("id", "i", F.col("i").alias("j")))


def settled_ranks(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, i, rank) of every sentence."""
    spark, schema = rows.sparkSession, "id long, i long, rank double"
    path = scratch_path(spark)
    shares = materialize(edges.join(edges.groupBy("id", "i").agg(F.count(F.lit(1)).alias("degree")), ["id", "i"]))
    rank = materialize(rows.select("id", "i", (1.0 / F.col("n")).alias("rank")))
    for turn in range(ROUNDS):
        sent = shares.join(rank, ["id", "i"]).groupBy("id", F.col("j").alias("i")).agg(F.sum(F.col("rank") / F.col("degree")).alias("fresh"))
        after = rank.join(sent, ["id", "i"], "left").select("id", "i", "rank", F.coalesce("fresh", F.lit(0.0)).alias("fresh"))
        after = materialize(after)
        moved = after.groupBy("id").agg((F.sqrt(F.sum((F.col("fresh") - F.col("rank")) ** 2)) < SETTLED).alias("done"))
        marked = after.join(moved, "id").select("id", "i", F.col("fresh").alias("rank"), (F.col("done") | F.lit(turn == ROUNDS - 1)).alias("done"))
        marked = materialize(marked)
        marked.where("done").drop("done").write.mode("append").parquet(path)
        rank = marked.where("not done").drop("done")
        if rank.isEmpty():
            break
    return spark.read.schema(schema).parquet(path)


def long_summaries(texts: DataFrame, keep: int) -> DataFrame:
    """(id, summary) of texts (id, text) whose sentences are rows of their own."""
    rows = _sentence_rows(texts)
    ranked = settled_ranks(rows.select("id", "i", "n"), similar_sentences(rows))
    best = W.partitionBy("id").orderBy(F.round("rank", DIGITS).desc(), "i")
    top = ranked.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= keep).select("id", "i")
    chosen = rows.select("id", "i", "sentence").join(top, ["id", "i"])
    listed = F.sort_array(F.collect_list(F.struct("i", "sentence")))
    return chosen.groupBy("id").agg(F.array_join(listed["sentence"], " ").alias("summary"))


def summarize(df: DataFrame, key: str, column: str, sentences: int = 3, long: int = LONG) -> DataFrame:
    """(key, summary): the ``sentences`` most central sentences of each text, in text order; '' for a null or empty text."""
    rows = df.select(col(key), col(column).cast("string").alias("text"))
    ends = F.length(F.col("text")) - F.length(F.regexp_replace("text", r"[.!?\n]", "")) + 1  # no fewer than the sentences
    short = spread(rows.where(F.coalesce(ends, F.lit(0)) <= long))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([summary(split_sentences(t), sentences) for t in texts], index=texts.index, dtype=object)

    done = short.select(col(key), run(F.col("text")).alias("summary"))
    rest = rows.where(ends > long)
    if rest.isEmpty():
        return done
    rest = materialize(rest.withColumn("id", F.monotonically_increasing_id()))
    made = long_summaries(rest.select("id", "text"), sentences)
    return done.unionByName(rest.join(made, "id", "left").select(col(key), F.coalesce("summary", F.lit("")).alias("summary")))
