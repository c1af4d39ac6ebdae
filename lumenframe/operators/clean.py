"""Cleaning: gaps, duplicates, outliers, strings, dates, scaling, encoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.columns import all_columns, col, numeric_columns, replace_columns, text_columns
from lumenframe.functions.words import WORD_CHARS
from lumenframe.operators.categories import category_leaders
from lumenframe.operators.schema import convert_column
from lumenframe.plans.joins import lookup
from lumenframe.plans.onepass import one_row, value_counts
from lumenframe.plans.ordering import with_position
from lumenframe.plans.quantiles import quantiles
from lumenframe.plans.storage import materialize


# ---- missing cells and duplicates ---------------------------------------------------------

def drop_missing(df: DataFrame, axis: str = "rows") -> DataFrame:
    if axis == "rows":
        return df.dropna("any")
    holes = one_row(df, {c: F.count_if(col(c).isNull()) for c in df.columns})
    return df.select(*[col(c) for c in df.columns if not holes[c]])


def fill_missing(df: DataFrame, how: str, value=None, cols=None, exact: bool = True) -> DataFrame:
    """Fill nulls by ``value``, ``mean``, ``median`` (numeric columns) or ``mode`` (every column)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    if how == "value":
        new = {}
        for c in all_columns(df, cols):
            text = isinstance(types[c], T.StringType)
            fill = F.lit(str(value)) if text else F.lit(value).cast("string").try_cast(types[c])
            new[c] = F.coalesce(col(c), fill)
        return replace_columns(df, new)
    if how == "mean":
        cols = numeric_columns(df, cols)
        found = one_row(df, {c: F.avg(col(c)) for c in cols})
    elif how == "median":
        cols = numeric_columns(df, cols)
        found = {c: q[0] for c, q in quantiles(df, cols, [0.5], exact).items()}
    elif how == "mode":
        cols = all_columns(df, cols)
        found = modes(df, cols)
    else:
        raise ValueError(f"unknown way to fill: {how!r}")
    new = {}
    for c in cols:
        if found.get(c) is None:
            continue
        keep_type = how == "mode"
        fill = F.lit(found[c]).cast(types[c]) if keep_type else F.lit(float(found[c]))
        new[c] = F.coalesce(col(c), fill) if keep_type else F.coalesce(col(c).cast("double"), fill)
    return replace_columns(df, new)


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value of each column as text, the smallest of tied ones (numbers as numbers)."""
    counts = value_counts(df, cols).filter(F.col("value").isNotNull())
    best = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_last("number"), "value")
    top = counts.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1")
    return {r["column"]: r["value"] for r in top.select("column", "value").collect()}  # one row per column


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


# ---- outliers ------------------------------------------------------------------------------

def iqr_fences(df: DataFrame, cols: Sequence[str], k: float = 1.5, exact: bool = True) -> dict[str, tuple]:
    fences = {}
    for c, (q1, q3) in quantiles(df, cols, [0.25, 0.75], exact).items():
        fences[c] = (None, None) if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return fences


def remove_outliers_iqr(df: DataFrame, column: str, k: float = 1.5, exact: bool = True) -> DataFrame:
    """Keep rows inside the fences, ends included; null rows go. The fences reach the scan as literals."""
    low, high = iqr_fences(df, [column], k, exact)[column]
    if low is None:
        return df.filter(F.lit(False))
    return df.filter((col(column) >= F.lit(low)) & (col(column) <= F.lit(high)))


# ---- strings -------------------------------------------------------------------------------

def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def titled(c: Column) -> Column:
    """Capital after anything that is not a letter, the rest lower case."""
    pieces = F.regexp_extract_all(c, F.lit(r"([\p{L}]+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(pieces, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))), "")


_CASES = {"lower": F.lower, "upper": F.upper, "title": titled}
_STRING_OPS = {
    "remove_special_chars": lambda c: F.regexp_replace(c, rf"[^{WORD_CHARS}\s]", ""),
    "remove_numbers": lambda c: F.regexp_replace(c, r"\p{Nd}+", ""),
    "remove_extra_spaces": lambda c: trimmed(F.regexp_replace(c, r"(?U)\s+", " ")),
}


def trim(df: DataFrame, cols=None) -> DataFrame:
    return replace_columns(df, {c: trimmed(col(c)) for c in text_columns(df, cols)})


def text_case(df: DataFrame, case: str, cols=None) -> DataFrame:
    return replace_columns(df, {c: _CASES[case](col(c)) for c in text_columns(df, cols)})


def string_ops(df: DataFrame, ops: Sequence[str], cols=None) -> DataFrame:
    """Applied in the fixed order special characters, numbers, spaces."""
    new = {}
    for c in text_columns(df, cols):
        made = col(c)
        for name, fn in _STRING_OPS.items():
            if name in ops:
                made = fn(made)
        new[c] = made
    return replace_columns(df, new)


# ---- near-equal categories -----------------------------------------------------------------

def merge_similar_categories(df: DataFrame, column: str, threshold: int = 85) -> DataFrame:
    changes = category_leaders(df, column, threshold).filter(F.col("value") != F.col("leader"))
    # Only values that change are looked up.
    names = changes.select(F.col("value").alias("_value"), F.col("leader").alias("_leader"))
    joined = lookup(df.withColumn("_value", col(column).cast("string")), names, ["_value"], "left")
    merged = F.coalesce(F.col("_leader"), col(column))
    return joined.select(*[merged.alias(c) if c == column else col(c) for c in df.columns])


# ---- dates ---------------------------------------------------------------------------------

def as_timestamp(df: DataFrame, column: str) -> Column:
    return col(column) if dict(df.dtypes)[column] in ("timestamp", "timestamp_ntz") else col(column).try_cast("timestamp_ntz")


def date_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Parse the named columns (bad values become null) and add their calendar parts."""
    parsed = replace_columns(df, {c: as_timestamp(df, c) for c in cols})
    parts = []
    for c in cols:
        t = col(c)
        parts += [
            F.year(t).alias(f"{c}_year"),
            F.month(t).alias(f"{c}_month"),
            F.dayofmonth(t).alias(f"{c}_day"),
            F.hour(t).alias(f"{c}_hour"),
            F.minute(t).alias(f"{c}_minute"),
            F.weekday(t).alias(f"{c}_dayofweek"),
            F.quarter(t).alias(f"{c}_quarter"),
        ]
    return parsed.select("*", *parts)


# ---- scaling and encoding ------------------------------------------------------------------

def scale(df: DataFrame, how: str, cols=None) -> DataFrame:
    """``standard``: (x - mean) / population std. ``minmax``: (x - min) / range. A constant column gives 0."""
    cols = numeric_columns(df, cols)
    if how == "standard":
        shift, width = F.avg, F.stddev_pop
        row = one_row(df, {(c, k): f(col(c)) for c in cols for k, f in (("at", shift), ("by", width))})
    elif how == "minmax":
        row = one_row(df, {(c, k): f(col(c).cast("double")) for c in cols for k, f in (("at", F.min), ("top", F.max))})
        for c in cols:
            row[(c, "by")] = None if row[(c, "at")] is None else row[(c, "top")] - row[(c, "at")]
    else:
        raise ValueError(f"unknown scaling {how!r}")
    new = {}
    for c in cols:
        at, by = row[(c, "at")], row[(c, "by")]
        if at is None:
            new[c] = col(c).cast("double")
        else:
            new[c] = (col(c).cast("double") - F.lit(float(at))) / F.lit(float(by) or 1.0)
    return replace_columns(df, new)


def one_hot(df: DataFrame, cols=None, max_values: int = 1000) -> DataFrame:
    """Boolean columns ``col_value`` for every sorted value but the first; null is false everywhere.

    Each value is a column, so the width is checked: more than ``max_values`` values is an error.
    """
    cols = text_columns(df, cols)
    keep = [col(c) for c in df.columns if c not in cols]
    made = []
    for c in cols:
        values = [r[0] for r in df.filter(col(c).isNotNull()).select(col(c)).distinct().limit(max_values + 1).collect()]
        if len(values) > max_values:
            raise ValueError(f"column {c!r} has more than {max_values} values; use label_encode or raise max_values")
        made += [F.coalesce(col(c) == F.lit(v), F.lit(False)).alias(f"{c}_{v}") for v in sorted(values)[1:]]
    return df.select(*keep, *made)


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): 0-based rank among the sorted distinct strings; null counts as the string 'nan'."""
    values = df.select(F.coalesce(col(column).cast("string"), F.lit("nan")).alias("value")).distinct()
    return with_position(values, "value", name="code")


def label_encode(df: DataFrame, cols=None) -> DataFrame:
    out = df
    for c in text_columns(df, cols):
        codes = label_codes(df, c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        named = out.withColumn("_value", F.coalesce(col(c).cast("string"), F.lit("nan")))
        joined = lookup(named, codes, ["_value"])
        out = joined.select(*[F.col("_code").alias(k) if k == c else col(k) for k in out.columns])
    return out


# ---- the whole chain -----------------------------------------------------------------------

def clean_data(df: DataFrame, spec: Mapping) -> DataFrame:
    """Options in ``spec``, always applied in this order: missing, duplicates, outliers, type, trim,
    case, categories, strings, dates, scaling, encoding."""
    missing = spec.get("missing")
    if missing in ("drop_rows", "drop_columns"):
        df = drop_missing(df, missing.removeprefix("drop_"))
    elif missing:
        df = fill_missing(df, missing, spec.get("fill_value"))
    if spec.get("drop_duplicates"):
        df = drop_duplicates(df)
    if spec.get("remove_outliers") in numeric_columns(df):
        df = remove_outliers_iqr(df, spec["remove_outliers"])
    for column, target in (spec.get("convert") or {}).items():
        df = convert_column(df, column, target)
    if spec.get("trim"):
        df = trim(df)
    if spec.get("case"):
        df = text_case(df, spec["case"])
    if spec.get("merge_categories"):
        for c in text_columns(df):
            df = merge_similar_categories(df, c)
    if spec.get("string_ops"):
        df = string_ops(df, spec["string_ops"])
    if spec.get("dates"):
        df = date_features(df, spec["dates"])
    if spec.get("scale"):
        df = scale(df, spec["scale"])
    if spec.get("encode") == "one_hot":
        df = one_hot(df)
    elif spec.get("encode") == "label":
        df = label_encode(df)
    return df
