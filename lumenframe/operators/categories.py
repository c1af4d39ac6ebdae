"""Near-equal category names, merged in the order of a sequential scan but found in parallel rounds.

The leaders of the scan (a value that resembles no earlier leader) are the lexicographically first maximal independent set
of the similarity graph. The graph is never built whole. Each round takes a prefix of the open values, as long as its
candidate pairs stay within ``PAIRS`` per open value (counted before any pair is made), finds the prefix's leaders by letting
every value without an open earlier neighbour lead, and lets all later values that resemble one of them join the first.

Candidates come from a length bound and segments: names whose ratio exceeds the threshold differ by at most d insertions and
deletions, so if the shorter is cut into d + 1 segments, one of them stands unchanged in the longer, shifted by few places.
Both sides write the hashes of their segments, and an equi-join finds the pairs. Beyond ``LONG`` characters segments would be
too many for a filter that weak, and only the length bound is used.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.columns import col
from lumenframe.functions.similarity import ratio_above
from lumenframe.plans.joins import match
from lumenframe.plans.ordering import with_position
from lumenframe.plans.storage import materialize, scratch_path

PAIRS = 50  # candidate pairs per open value in one step
LEAST = 4_000_000  # candidate pairs a step may have in any case
LONG = 48


def sort_key(value: Column) -> Column:
    """ASCII letters, digits and underscores in lower case, words in order."""
    kept = F.regexp_replace(F.regexp_replace(value, r"[^\x00-\x7F]", ""), r"[^A-Za-z0-9_]", " ")
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(kept), " "), lambda w: w != "")), " ")


def _signatures(threshold: int, shorter: bool) -> str:
    """SQL for the hashes that a key writes as the shorter or the longer side of a pair.

    For lengths x <= y, d is the largest number of insertions and deletions at which the rounded ratio can still exceed the
    threshold; it has the parity of x + y. Segment i of the shorter lies at ``i * x div (d + 1)``. Let i be the first segment
    up to which there are at most i changes: it is unchanged and has exactly i changes before it and at most d - i after it,
    so its shift has the parity of i, is at most i, and differs from y - x by at most d - i.
    """
    gap, more, less = 199 - 2 * threshold, 399 - 2 * threshold, 1 + 2 * threshold
    d = f"({gap} * (x + y) div 200 - ({gap} * (x + y) div 200 + x + y) % 2)"
    low, high = f"(i * x div ({d} + 1))", f"((i + 1) * x div ({d} + 1))"
    step = math.log(more / less) * 1.0001  # lengths that fit are in one class or in neighbours
    if shorter:
        lengths = f"sequence(n, least({LONG}L, n * {more} div {less}))"
        sides, wanted = "struct(n AS x, v AS y)", f"n <= {LONG}"
        parts = f"transform(sequence(0L, {d}), i -> xxhash64(x, y, i, substring(key, int({low} + 1), int({high} - {low}))))"
        classes = f"transform(sequence(0L, 1L), c -> xxhash64(-1L, bigint(ln(n) / {step}), c))"
        classed = f"n * {more} div {less} > {LONG}"
    else:
        lengths = f"sequence(greatest(1L, n * {less} div {more}), n)"
        sides, wanted = "struct(v AS x, n AS y)", f"n <= {LONG}"
        shift = "(2 * k - i)"
        fits = f"abs(y - x - {shift}) <= {d} - i AND {low} + {shift} >= 0 AND {high} + {shift} <= y"
        parts = f"transform(filter(sequence(0L, i), k -> {fits}), k -> xxhash64(x, y, i, substring(key, int({low} + {shift} + 1), int({high} - {low}))))"
        parts = f"flatten(transform(sequence(0L, {d}), i -> {parts}))"
        classes = f"transform(sequence(0L, 1L), c -> xxhash64(-1L, bigint(ln(n) / {step}) - c, c))"
        classed = f"n > {LONG}"
    none = "CAST(array() AS array<bigint>)"
    close = f"filter(transform({lengths}, v -> {sides}), p -> p.y - p.x <= {_of(d)})"
    segmented = f"CASE WHEN {wanted} THEN flatten(transform({close}, p -> {_of(parts)})) ELSE {none} END"
    return f"array_distinct(concat({segmented}, CASE WHEN {classed} THEN {classes} ELSE {none} END))"


def _of(sql: str) -> str:
    """The same expression over the fields of ``p``."""
    return re.sub(r"\b([xy])\b", r"p.\1", sql)


def segments(names: DataFrame, threshold: int) -> DataFrame:
    """(rank, long, sig) of every name (rank, key): its hashes as the shorter and as the longer side."""
    sized = names.selectExpr("rank", "key", "bigint(length(key)) AS n")
    sides = [sized.selectExpr("rank", f"{str(longer).lower()} AS long", f"explode({_signatures(threshold, not longer)}) AS sig") for longer in (False, True)]
    return sides[0].unionByName(sides[1])


def _pair_counts(marked: DataFrame, bounds: list[int], among: bool) -> list[float]:
    """Candidate pairs for each bound: among the names before it, or between leaders before it and all other names."""
    products = []
    for i, b in enumerate(bounds):
        before = F.col("rank") < b
        first, second = (before, before) if among else (before & F.col("leads"), ~F.col("leads"))
        short, longer = ([F.count_if(side & (F.col("long") == F.lit(side_long))) for side_long in (False, True)] for side in (first, second))
        pairs = short[0] * longer[1] + (F.lit(0) if among else short[1] * longer[0])
        products.append(pairs.cast("double").alias(f"c{i}"))
    sums = marked.groupBy("sig").agg(*products)
    return [x or 0.0 for x in sums.agg(*[F.sum(f"c{i}") for i in range(len(bounds))]).first()]


def _bounds(ranks: DataFrame, rows: int) -> list[int]:
    """Ranks that cut off everything, a quarter, a sixteenth and so on, at least one name; longest first."""
    shares = [4.0**-i for i in range(1, 1 + max(1, rows.bit_length() // 2))]
    row = ranks.agg(F.max("rank"), F.min("rank"), F.percentile_approx("rank", F.array(*map(F.lit, shares)), F.lit(10_000))).first()
    return sorted({row[0] + 1, row[1] + 1, *(r + 1 for r in row[2])}, reverse=True)


def _longest(marked: DataFrame, ranks: DataFrame, rows: int, limit: float, among: bool) -> int:
    bounds = _bounds(ranks, rows)
    return next((b for b, n in zip(bounds, _pair_counts(marked, bounds, among), strict=True) if n <= limit), bounds[-1])


def _alike(pairs: DataFrame, names: DataFrame, threshold: int) -> DataFrame:
    """The pairs (later, earlier) that resemble each other."""

    @F.pandas_udf("boolean")
    def above(later: pd.Series, earlier: pd.Series) -> pd.Series:
        return pd.Series([ratio_above(a, b, threshold) for a, b in zip(later, earlier, strict=True)])

    later = names.select(F.col("rank").alias("later"), F.col("key").alias("_later"))
    earlier = names.select(F.col("rank").alias("earlier"), F.col("key").alias("_earlier"))
    named = pairs.distinct().join(later, "later").join(earlier, "earlier")
    return materialize(named.where(above("_later", "_earlier")).select("later", "earlier"))


def first_independent_set(names: DataFrame, edges: DataFrame) -> DataFrame:
    """Ranks of the names that no earlier member of the set resembles; ``edges``: (later, earlier).

    In each round every open name without an open earlier neighbour joins the set, and its later neighbours are out. The
    smallest open rank always joins, and for an order unrelated to the graph the rounds grow with the logarithm of the names.
    """
    spark = names.sparkSession
    path = scratch_path(spark)

    def as_(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(F.col("rank").alias(name))

    open_ = materialize(edges.select(F.col("later").alias("rank")).distinct())
    fresh = materialize(names.select("rank").join(open_, "rank", "left_anti"))
    fresh.write.parquet(path)
    while not open_.isEmpty():
        out = materialize(edges.join(as_(fresh, "earlier"), "earlier", "left_semi").select(F.col("later").alias("rank")).distinct())
        edges = materialize(edges.join(as_(out, "later"), "later", "left_anti").join(as_(out, "earlier"), "earlier", "left_anti"))
        left = open_.join(out, "rank", "left_anti")
        fresh = materialize(left.join(edges.select(F.col("later").alias("rank")).distinct(), "rank", "left_anti"))
        open_ = materialize(left.join(fresh, "rank", "left_anti"))
        fresh.write.mode("append").parquet(path)
    return spark.read.schema("rank long").parquet(path)


def _decide(names: DataFrame, threshold: int, pairs: int) -> DataFrame:
    """(rank, leader) of every name (rank, key), leaders named by rank."""
    spark = names.sparkSession
    path, schema = scratch_path(spark), "rank long, leader long"
    open_, rows = names, names.count()
    if not rows:
        return spark.createDataFrame([], schema)
    while rows:
        limit = max(LEAST, pairs * rows)
        entries, bound = segments(open_, threshold), None
        if rows * rows > limit:  # else all pairs would be within the limit
            entries = materialize(entries)
            bound = _longest(entries, open_, rows, limit, True)
        prefix, near = (open_, entries) if bound is None else (open_.where(F.col("rank") < bound), entries.where(F.col("rank") < bound))
        short = near.where(~F.col("long")).select("sig", F.col("rank").alias("a"))
        longer = near.where("long").select("sig", F.col("rank").alias("b"))
        met = short.join(longer, "sig").where("a <> b").select(F.greatest("a", "b").alias("later"), F.least("a", "b").alias("earlier"))
        edges = _alike(met, prefix, threshold)
        leaders = first_independent_set(prefix, edges)
        led = edges.join(leaders.withColumnRenamed("rank", "earlier"), "earlier", "left_semi")
        joined = led.groupBy(F.col("later").alias("rank")).agg(F.min("earlier").alias("leader"))
        joined.unionByName(leaders.select("rank", F.col("rank").alias("leader"))).write.mode("append").parquet(path)
        if bound is None:
            break
        rest = materialize(open_.where(F.col("rank") >= bound))
        while (rows := rest.count()) and (n := leaders.count()):
            who = leaders.select("rank", F.lit(True).alias("leads")).unionByName(rest.select("rank", F.lit(False).alias("leads")))
            marked = materialize(entries.join(who, "rank"))
            upto = _longest(marked, leaders, n, limit, False)
            first = marked.where(F.col("leads") & (F.col("rank") < upto)).select("sig", F.col("rank").alias("earlier"), F.col("long").alias("_long"))
            other = marked.where(~F.col("leads")).select("sig", F.col("rank").alias("later"), "long")
            met = first.join(other, "sig").where("_long <> long").select("later", "earlier")
            found = materialize(_alike(met, open_, threshold).groupBy(F.col("later").alias("rank")).agg(F.min("earlier").alias("leader")))
            found.write.mode("append").parquet(path)
            rest = materialize(rest.join(found, "rank", "left_anti"))
            leaders = materialize(leaders.where(F.col("rank") >= upto))
        open_ = rest
    return spark.read.schema(schema).parquet(path)


def category_leaders(df: DataFrame, column: str, threshold: int = 85, pairs: int = PAIRS) -> DataFrame:
    """(value, leader) for every distinct value, in the order frequency descending, then value.

    A value joins the first earlier leader it resembles, or becomes a leader, as a sequential scan would decide. Values that
    differ only in case, marks or the order of words are one name; a value without an ASCII letter or digit leads itself.
    """
    counts = df.filter(col(column).isNotNull()).groupBy(col(column).cast("string").alias("value")).count()
    ranked = with_position(counts, [F.desc("count"), F.col("value")], name="rank")
    ranked = materialize(ranked.select("value", "rank", sort_key(F.col("value")).alias("key")))
    if threshold >= 100:
        return ranked.select("value", F.col("value").alias("leader"))
    names = materialize(ranked.where("key <> ''").groupBy("key").agg(F.min("rank").alias("rank")))
    decided = match(names, _decide(names, threshold, pairs), ["rank"])
    by_key = match(decided.select("key", F.col("leader").alias("rank")), ranked.select("rank", F.col("value").alias("leader")), ["rank"])
    named = match(ranked.select("value", "key"), by_key.select("key", "leader"), ["key"], "left")
    return named.select("value", F.coalesce("leader", "value").alias("leader"))
