"""Structure checks, column names and column types."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.columns import FLOATING, INTEGRAL, all_columns, col, replace_columns, text_columns
from lumenframe.plans.onepass import long_aggregate, one_row, value_counts


def is_structured(df: DataFrame) -> DataFrame:
    """One row of checks: rows, columns, share of filled cells, verdict."""
    cols = df.columns
    named = [c for c in cols if not re.fullmatch(r"_c\d+|\d+", c)]
    filled = sum((F.count(col(c)) for c in cols), F.lit(0))
    facts = df.agg(F.count(F.lit(1)).alias("rows"), filled.cast("long").alias("filled_cells"))
    share = F.col("filled_cells") / (F.col("rows") * len(cols)) if cols else F.lit(None).cast("double")
    share = F.when(F.col("rows") > 0, F.try_divide(F.col("filled_cells"), F.col("rows") * max(1, len(cols))))
    return facts.select(
        "rows",
        F.lit(len(cols)).cast("long").alias("columns"),
        "filled_cells",
        F.coalesce(
            (F.lit(len(cols)) >= 1)
            & (F.lit(len(named)) >= 0.8 * len(cols))
            & (F.col("filled_cells") > 0)
            & (share >= 0.1),
            F.lit(False),
        ).alias("structured"),
    )


def restructure(df: DataFrame, order) -> DataFrame:
    """Drop empty rows and columns, mark gaps, promote the fullest row to header, clean the names.

    ``order`` names the column(s) that put the rows in sequence; it is not part of the table.
    """
    order = [order] if isinstance(order, str) else list(order)
    body = [c for c in df.columns if c not in order]
    kept_rows = df.dropna("all", subset=body)
    filled = one_row(kept_rows, {c: F.count(col(c)) for c in body})
    body = [c for c in body if filled[c]]
    text = kept_rows.select(
        *[col(o) for o in order],
        *[F.coalesce(col(c).cast("string"), F.lit("MISSING_VALUE")).alias(c) for c in body],
    )
    # Every gap is now a marker, so a cell is empty only if it is the empty string.
    fullness = sum((F.when(col(c) != "", 1).otherwise(0) for c in body), F.lit(0))
    pick = text.orderBy(F.desc(fullness), *[col(o) for o in order]).limit(1)
    header = pick.select(fullness.alias("_full"), *[col(o) for o in order], *[col(c) for c in body]).first()
    if header is None or header["_full"] <= 1:
        return text.toDF(*order, *[_clean_name(c) for c in body])
    taken: dict[str, int] = {}
    names = []
    for c in body:
        name = _clean_name(header[c]) or "column"
        taken[name] = taken.get(name, 0) + 1
        names.append(name if taken[name] == 1 else f"{name}_{taken[name]}")
    is_header = F.lit(True)
    for o in order:
        is_header = is_header & (col(o) == F.lit(header[o]))
    return text.filter(~is_header).toDF(*order, *names)


def _clean_name(name) -> str:
    return re.sub(r"\W+", "_", str(name)).strip("_")


def sanitize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[re.sub(r"""["'\\/{}\[\]:,]""", "_", c) for c in df.columns])


def table_name(file_name: str) -> str:
    """Table name for a file: stem, non-word characters to '_', 't_' before a leading digit."""
    stem = re.sub(r"\.[^.]*$", "", file_name.rsplit("/", 1)[-1])
    name = re.sub(r"\W", "_", stem)
    return f"t_{name}" if name[:1].isdigit() else name


_INT_STEPS = (("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31))


def narrow_types_report(df: DataFrame, cols=None, exact: bool = True) -> DataFrame:
    """Recommended type per integer, double and string column, from one aggregate.

    A double fits float when every value survives the round trip at six decimals.
    """
    cols = all_columns(df, cols)
    types = {f.name: f.dataType for f in df.schema.fields}
    ints = [c for c in cols if isinstance(types[c], INTEGRAL)]
    doubles = [c for c in cols if isinstance(types[c], T.DoubleType)]
    texts = [c for c in cols if isinstance(types[c], T.StringType)]
    parts = []
    if ints:
        best = F.lit("bigint")
        for name, bound in reversed(_INT_STEPS):
            best = F.when((F.col("low") >= -bound) & (F.col("high") <= bound - 1), name).otherwise(best)
        parts.append(
            long_aggregate(df, ints, {"low": lambda c: F.min(col(c)).cast("long"), "high": lambda c: F.max(col(c)).cast("long")})
            .withColumn("recommended", best)
        )
    if doubles:
        same = lambda c: F.abs(col(c) - col(c).cast("float").cast("double")) < 5e-7
        parts.append(
            long_aggregate(df, doubles, {"_safe": lambda c: F.coalesce(F.bool_and(same(c)), F.lit(True))})
            .withColumn("recommended", F.when(F.col("_safe"), "float").otherwise("double"))
        )
    if texts:
        if exact:
            facts = value_counts(df, texts).groupBy("column").agg(F.count("value").alias("u"), F.sum("n").alias("r"))
        else:
            facts = long_aggregate(
                df, texts, {"u": lambda c: F.approx_count_distinct(col(c)), "r": lambda c: F.count(F.lit(1))}
            )
        parts.append(facts.withColumn("recommended", F.when(F.col("u") < 0.5 * F.col("r"), "category").otherwise("string")))
    out = None
    for p in parts:
        p = p.select("column", "recommended")
        out = p if out is None else out.unionByName(p)
    current = F.create_map(*[F.lit(x) for c in ints + doubles + texts for x in (c, types[c].simpleString())])
    return out.select("column", current[F.col("column")].alias("type"), "recommended")


def narrow_types(df: DataFrame, cols=None) -> DataFrame:
    """Cast to the recommended types; 'category' only marks a low-cardinality string and changes nothing."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, INTEGRAL + (T.DoubleType,))]
    wanted = [c for c in all_columns(df, cols) if c in numeric]
    if not wanted:
        return df
    advice = {r["column"]: r["recommended"] for r in narrow_types_report(df, wanted).collect()}  # one row per column
    return replace_columns(df, {c: col(c).cast(t) for c, t in advice.items()})


def infer_types_report(df: DataFrame, cols=None) -> DataFrame:
    """Type each string column could take without losing a value, from one pass."""
    cols = text_columns(df, cols)
    facts = long_aggregate(
        df,
        cols,
        {
            "known": lambda c: F.count(col(c)),
            "numbers": lambda c: F.count(col(c).try_cast("double")),
            "times": lambda c: F.count(col(c).try_cast("timestamp_ntz")),
        },
    )
    return facts.withColumn(
        "inferred",
        F.when(F.col("known") == 0, "string")
        .when(F.col("numbers") == F.col("known"), "double")
        .when(F.col("times") == F.col("known"), "timestamp_ntz")
        .otherwise("string"),
    )


def infer_types(df: DataFrame, cols=None) -> DataFrame:
    cols = text_columns(df, cols)
    if not cols:
        return df
    found = {r["column"]: r["inferred"] for r in infer_types_report(df, cols).collect()}  # one row per column
    return replace_columns(df, {c: col(c).cast(t) for c, t in found.items() if t != "string"})


def converted(c: Column, target: str) -> Column:
    """Value of a column as int / float / str / category; what does not parse becomes null."""
    if target == "int":
        return c.try_cast("double").try_cast("bigint")
    if target == "float":
        return c.try_cast("double")
    if target in ("str", "category"):
        return c.cast("string")
    raise ValueError(f"unknown target type {target!r}")


def convert_column(df: DataFrame, column: str, target: str) -> DataFrame:
    return replace_columns(df, {column: converted(col(column), target)})


def schema_counts(df: DataFrame) -> DataFrame:
    """Number of columns per type."""
    names = [F.struct(F.lit(t).alias("type")) for _, t in df.dtypes]
    return df.sparkSession.range(1).select(F.inline(F.array(*names))).groupBy("type").agg(F.count(F.lit(1)).alias("columns"))


def column_case_fix(df: DataFrame, names) -> DataFrame:
    """Select columns by case-insensitive name and return them under their real names."""
    real = {c.lower(): c for c in df.columns}
    return df.select(*[col(real[n.lower()]) for n in names])
