"""Profiling: what is in each column, what is missing, which values dominate."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.columns import all_columns, classify_columns, col, numeric_columns, text_columns
from lumenframe.plans.comoments import flag_products
from lumenframe.plans.onepass import long_aggregate, smallest_values, value_counts
from lumenframe.plans.quantiles import quantiles


def _first_values(counts: DataFrame, k: int, *order) -> DataFrame:
    # row_number() <= k is pushed below the shuffle as a per-partition group limit.
    ranked = counts.withColumn("_rank", F.row_number().over(Window.partitionBy("column").orderBy(*order)))
    return ranked.filter(F.col("_rank") <= k)


def _labels(df: DataFrame, cols, fields) -> DataFrame:
    """A one-row-per-column table of schema facts, built without a driver-side data set."""
    rows = [F.struct(F.lit(c).alias("column"), *[F.lit(v).alias(n) for n, v in fields(c).items()]) for c in cols]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def profile_columns(df: DataFrame, cols=None, samples: int = 5, exact: bool = True) -> DataFrame:
    """Per column: type, distinct values, missing cells, percent missing (2 dp), smallest sample values."""
    cols = all_columns(df, cols)
    types = dict(df.dtypes)
    facts = _labels(df, cols, lambda c: {"type": types[c]})
    if exact:
        counts = value_counts(df, cols)
        # Nulls are ranked last rather than filtered, and both branches keep the same columns, so that the
        # exchange of the distinct values is computed once and reused.
        known = F.col("value").isNotNull()
        totals = counts.groupBy("column").agg(
            F.count("value").alias("unique"),
            F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing"),
            F.sum("n").alias("_rows"),
        )
        shown = (
            _first_values(counts, samples, F.asc_nulls_last("value"), "n")
            .filter(known)
            .groupBy("column")
            .agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("_s"))
            .select("column", F.array_join(F.transform("_s", lambda s: s["value"]), ", ").alias("samples"))
        )
        out = facts.join(totals, "column", "left").join(shown, "column", "left")
    else:
        totals = long_aggregate(
            df,
            cols,
            {
                "unique": lambda c: F.approx_count_distinct(col(c)),
                "missing": lambda c: F.count_if(col(c).isNull()),
                "_rows": lambda c: F.count(F.lit(1)),
            },
        )
        least = smallest_values(df, cols, samples)
        shown = _labels(df, cols, lambda c: {"samples": ", ".join(least[c]) if least[c] else None})
        out = facts.join(totals, "column", "left").join(shown, "column", "left")
    percent = F.round(100.0 * F.col("missing") / F.col("_rows"), 2)
    return out.select(
        "column",
        "type",
        F.coalesce("unique", F.lit(0)).alias("unique"),
        F.coalesce("missing", F.lit(0)).alias("missing"),
        percent.alias("missing_pct"),
        "samples",
    )


def describe_all(df: DataFrame, cols=None, exact: bool = True) -> DataFrame:
    """Numeric: count, mean, std, min, quartiles, max. All others: count, unique, top, freq."""
    kinds = classify_columns(df.select(*[col(c) for c in all_columns(df, cols)]))
    parts = []
    numbers = kinds["numeric"]
    texts = [c for c in all_columns(df, cols) if c not in numbers]
    absent = lambda t: F.lit(None).cast(t)
    if numbers:
        q = quantiles(df, numbers, [0.25, 0.5, 0.75], exact)
        parts.append(
            long_aggregate(
                df,
                numbers,
                {
                    "count": lambda c: F.count(col(c)),
                    "mean": lambda c: F.avg(col(c)),
                    "std": lambda c: F.stddev_samp(col(c)),
                    "min": lambda c: F.min(col(c)).cast("double"),
                    "q25": lambda c: F.max(F.lit(q[c][0]).cast("double")),
                    "q50": lambda c: F.max(F.lit(q[c][1]).cast("double")),
                    "q75": lambda c: F.max(F.lit(q[c][2]).cast("double")),
                    "max": lambda c: F.max(col(c)).cast("double"),
                },
            ).select(
                "*", absent("bigint").alias("unique"), absent("string").alias("top"), absent("bigint").alias("freq")
            )
        )
    if texts:
        counts = value_counts(df, texts)
        totals = counts.groupBy("column").agg(
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("count"),
            F.count("value").alias("unique"),
        )
        ranked = _first_values(counts, 1, F.col("value").isNull(), F.desc("n"), F.col("value"))
        top = ranked.filter(F.col("value").isNotNull()).select(
            "column", F.col("value").alias("top"), F.col("n").alias("freq")
        )
        parts.append(
            totals.join(top, "column", "left").select(
                "column",
                "count",
                *[absent("double").alias(n) for n in ("mean", "std", "min", "q25", "q50", "q75", "max")],
                "unique",
                "top",
                "freq",
            )
        )
    if not parts:
        raise ValueError("a table without columns cannot be described")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_locations(df: DataFrame, key, cols=None) -> DataFrame:
    """(key…, column) of every null cell; one scan, no shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    cols = [c for c in all_columns(df, cols) if c not in keys]
    holes = F.filter(F.array(*[F.when(col(c).isNull(), F.lit(c)) for c in cols]), lambda c: c.isNotNull())
    return df.select(*[col(k) for k in keys], F.explode(holes).alias("column"))


def missing_counts(df: DataFrame, cols=None) -> DataFrame:
    """Columns with nulls, most first."""
    counts = long_aggregate(df, all_columns(df, cols), {"missing": lambda c: F.count_if(col(c).isNull())})
    return counts.filter(F.col("missing") > 0).orderBy(F.desc("missing"), "column")


def missing_total(df: DataFrame) -> DataFrame:
    """Null cells in the table and the number of columns that have any."""
    return missing_counts(df).agg(
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_cells"), F.count(F.lit(1)).alias("affected_columns")
    )


def missing_correlation(df: DataFrame, cols=None) -> DataFrame:
    """Correlation of null indicators; constant indicators are left out."""
    cols = all_columns(df, cols)
    found = flag_products(df, [col(c).isNull() for c in cols]) if cols else None
    rows = []
    if found is not None:
        both, n = found[0], int(found[1][0, 0])
        share = both / n
        for i, j in combinations(range(len(cols)), 2):
            a, b = share[i, i], share[j, j]
            if 0 < both[i, i] < n and 0 < both[j, j] < n:
                rows.append((cols[i], cols[j], float((share[i, j] - a * b) / math.sqrt(a * (1 - a) * b * (1 - b)))))
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def missing_pattern(df: DataFrame, cols=None) -> DataFrame:
    """Null pattern ('1' = present, '0' = null, in column order) with the number of rows that show it."""
    cols = all_columns(df, cols)
    pattern = F.concat(*[F.when(col(c).isNull(), "0").otherwise("1") for c in cols])
    return df.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("rows"))


def quality_report(df: DataFrame, cols=None, exact: bool = True) -> DataFrame:
    """Missing cells, unique values and numeric range per column."""
    cols = all_columns(df, cols)
    numeric = set(numeric_columns(df))
    empty = lambda c: F.max(F.lit(None).cast("double"))
    ranges = long_aggregate(
        df,
        cols,
        {
            "missing": lambda c: F.count_if(col(c).isNull()),
            "min": lambda c: F.min(col(c)).cast("double") if c in numeric else empty(c),
            "max": lambda c: F.max(col(c)).cast("double") if c in numeric else empty(c),
        },
    )
    return ranges.join(_distinct_counts(df, cols, exact), "column").select("column", "missing", "unique", "min", "max")


def _distinct_counts(df: DataFrame, cols, exact: bool) -> DataFrame:
    if not exact:
        return long_aggregate(df, cols, {"unique": lambda c: F.approx_count_distinct(col(c))})
    return value_counts(df, cols).groupBy("column").agg(F.count("value").alias("unique"))


def before_after(df: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Missing cells and duplicate rows before and after cleaning."""

    def report(frame: DataFrame, stage: str) -> DataFrame:
        distinct = frame.groupBy(*[col(c) for c in frame.columns]).agg(F.count(F.lit(1)).alias("_copies"))
        holes = sum((col(c).isNull().cast("long") for c in frame.columns), F.lit(0).cast("long"))
        return distinct.agg(
            F.lit(stage).alias("stage"),
            F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(holes * F.col("_copies")), F.lit(0)).alias("missing_cells"),
            F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"),
        )

    return report(df, "before").unionByName(report(cleaned, "after"))


def table_info(df: DataFrame, cols=None, exact: bool = True) -> DataFrame:
    """Row count and distinct values of each column."""
    cols = all_columns(df, cols)
    if exact:
        counts = value_counts(df, cols)
        return counts.groupBy("column").agg(F.sum("n").alias("rows"), F.count("value").alias("unique"))
    return long_aggregate(
        df, cols, {"rows": lambda c: F.count(F.lit(1)), "unique": lambda c: F.approx_count_distinct(col(c))}
    )


def numeric_summary(df: DataFrame, cols=None) -> DataFrame:
    return long_aggregate(
        df,
        numeric_columns(df, cols),
        {
            "min": lambda c: F.min(col(c)).cast("double"),
            "max": lambda c: F.max(col(c)).cast("double"),
            "avg": lambda c: F.avg(col(c)),
            "std": lambda c: F.stddev_samp(col(c)),
        },
    )


def top_values(df: DataFrame, cols, k: int = 10) -> DataFrame:
    """The k most frequent values (or value tuples); ties go to the smaller value."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    known = df.dropna("any", subset=cols)
    counts = known.groupBy(*[col(c) for c in cols]).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), *[col(c) for c in cols]).limit(k)


def dataset_context(df: DataFrame) -> DataFrame:
    """Shape, types, missing total, description and correlations as one JSON record."""
    from lumenframe.operators.stats import correlation_matrix

    numbers = numeric_columns(df)
    # 'describe' and 'correlation' have one row per column (pair): schema-sized, not data-sized.
    described = describe_all(df).agg(
        F.map_from_entries(
            F.collect_list(F.struct("column", F.struct("count", "mean", "std", "min", "q25", "q50", "q75", "max")))
        ).alias("describe")
    )
    rows = df.agg(
        F.count(F.lit(1)).alias("rows"),
        sum((F.count_if(col(c).isNull()) for c in df.columns), F.lit(0)).alias("missing_values"),
    )
    parts = [rows, described]
    if len(numbers) > 1:
        parts.append(
            correlation_matrix(df).agg(
                F.map_from_entries(F.collect_list(F.struct(F.concat_ws("~", "a", "b"), "r"))).alias("correlation")
            )
        )
    # Each part is one row; stacking them and taking the only known value of each field joins them.
    names = [c for p in parts for c in p.columns]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    whole = stacked.agg(*[F.first(c, True).alias(c) for c in names])
    types = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    return whole.select(
        F.to_json(F.struct(F.lit(len(df.columns)).alias("columns"), types.alias("dtypes"), *names)).alias("context")
    )


def encoding_suggestions(df: DataFrame, target: str | None = None, exact: bool = True) -> DataFrame:
    """Encoding advice per categorical column by its number of distinct values."""
    cols = [c for c in classify_columns(df)["categorical"] if c != target]
    counts = _distinct_counts(df, cols, exact)
    n = F.col("unique")
    if target:
        high = ("Target Encoding", "Frequency Encoding, Leave-One-Out Encoding",
                "High cardinality - One-Hot Encoding may create too many features")
    else:
        high = ("Frequency Encoding", "Hash Encoding, Embedding",
                "High cardinality - Consider dimensionality reduction")
    return counts.select(
        "column",
        "unique",
        F.when(n > 50, high[0]).otherwise("One-Hot Encoding").alias("recommended"),
        F.when(n > 50, high[1])
        .when(n > 10, "Target Encoding, Label Encoding")
        .otherwise("Label Encoding, Binary Encoding")
        .alias("alternatives"),
        F.when(n > 50, high[2]).alias("warning"),
    )
