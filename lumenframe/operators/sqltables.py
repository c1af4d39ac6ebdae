"""SQL over named tables, a query builder without SQL text, and table maintenance."""

from __future__ import annotations

import re
import time
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.columns import col
from lumenframe.plans.ordering import with_position


def run_sql(spark: SparkSession, text: str, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Register the tables as views, run the ';'-separated statements in order, return the last result."""
    for name, frame in (tables or {}).items():
        frame.createOrReplaceTempView(name)
    result = None
    for statement in split_statements(text):
        result = spark.sql(statement)
    if result is None:
        raise ValueError("no SQL statement given")
    return result


def split_statements(text: str) -> list[str]:
    """Split at ';' outside quotes and comments."""
    pieces = re.findall(r"(?:'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|[^;])+", text, flags=re.S)
    return [p.strip() for p in pieces if re.sub(r"--[^\n]*|/\*.*?\*/", "", p, flags=re.S).strip()]


def run_sql_timed(spark: SparkSession, text: str, tables: Mapping[str, DataFrame] | None = None):
    """(result, record): the record holds query, seconds, rows and columns for the history table."""
    start = time.time()
    result = run_sql(spark, text, tables)
    rows = result.count()
    record = {
        "query": text, "seconds": time.time() - start, "rows": rows, "columns": len(result.columns),
    }
    return result, record


# ---- builder -------------------------------------------------------------------------------

_COMPARE = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "LIKE": lambda c, v: c.like(v),
    "IN": lambda c, v: c.isin(list(v)),
    "IS NULL": lambda c, v: c.isNull(),
    "IS NOT NULL": lambda c, v: c.isNotNull(),
    "BETWEEN": lambda c, v: c.between(*v),
}
_AGGREGATES = {
    "COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max,
    "STDDEV": F.stddev_samp, "VARIANCE": F.var_samp,
}


def condition(filters: Sequence[tuple]) -> Column:
    """``(column, operator, value)`` triples joined by AND."""
    tests = [_COMPARE[op.upper()](col(c), value[0] if value else None) for c, op, *value in filters]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def build_query(tables: Mapping[str, DataFrame], spec: Mapping) -> DataFrame:
    """``spec`` keys: table, joins, filters, columns, aggregates, group_by, order_by, limit (default none)."""
    df = tables[spec["table"]]
    for j in spec.get("joins") or []:
        df = join_tables(df, tables[j["table"]], j["left"], j["right"], j.get("how", "inner"), j.get("term"))
    if spec.get("filters"):
        df = df.filter(condition(spec["filters"]))
    if spec.get("aggregates"):
        made = [_AGGREGATES[f.upper()](col(c)).alias(f"{f.lower()}_{c}") for f, c in spec["aggregates"]]
        df = df.groupBy(*[col(c) for c in spec.get("group_by") or []]).agg(*made)
    elif spec.get("columns"):
        df = df.select(*[col(c) for c in spec["columns"]])
    for c, direction in [spec["order_by"]] if spec.get("order_by") else []:
        df = df.orderBy(col(c).desc() if direction.upper() == "DESC" else col(c).asc())
    return df.limit(spec["limit"]) if spec.get("limit") is not None else df


_HOW = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full"}


def join_tables(left: DataFrame, right: DataFrame, left_on, right_on, how: str = "inner", term: str | None = None) -> DataFrame:
    """Equi-join; right columns whose names are taken get the suffix ``_right``.

    ``term`` is one more condition over the result's column names, joined by AND. Sides are
    broadcast only when Spark measures them to be small; a skewed key is split by AQE.
    """
    left_on = [left_on] if isinstance(left_on, str) else list(left_on)
    right_on = [right_on] if isinstance(right_on, str) else list(right_on)
    names = {c: (f"{c}_right" if c in left.columns else c) for c in right.columns}
    renamed = right.toDF(*[names[c] for c in right.columns])
    on = reduce(lambda a, b: a & b, [left[a] == renamed[names[b]] for a, b in zip(left_on, right_on)])
    if term:
        on = on & F.expr(term)
    return left.join(renamed, on, _HOW.get(how.upper(), how))


def daily_totals(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Sum and average per calendar day, in order."""
    day = F.to_date(col(ts)).alias("day")
    return df.groupBy(day).agg(F.sum(col(value)).alias("total"), F.avg(col(value)).alias("average")).orderBy("day")


def subset(df: DataFrame, cols: Sequence[str], n: int, key) -> DataFrame:
    """Chosen columns of the first n rows in key order."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*[col(k) for k in keys]).limit(n).select(*[col(c) for c in cols])


# ---- maintenance ---------------------------------------------------------------------------
# Files are immutable, so every change is a new version of the table: a projection or a filter.

_CONSTRAINT_KINDS = ("primary_key", "unique", "not_null", "check")


def create_table(spark: SparkSession, name: str, columns: Mapping[str, str], defaults: Mapping[str, str] | None = None, path: str | None = None) -> DataFrame:
    """``columns``: name to SQL type; ``defaults``: name to SQL literal; ``path``: where the rows go if not in the warehouse.
    Constraints are checked by :func:`check_constraints` before rows are written."""
    parts = [f"`{c}` {t}" + (f" DEFAULT {defaults[c]}" if defaults and c in defaults else "") for c, t in columns.items()]
    spark.sql(f"CREATE TABLE `{name}` ({', '.join(parts)}) USING parquet" + (f" LOCATION '{path}'" if path else ""))
    return spark.table(name)


def insert_rows(df: DataFrame, rows: DataFrame, id_col: str | None = None, order=None) -> DataFrame:
    """Table with the rows appended; ``id_col`` continues from the largest id in the given order."""
    if id_col:
        last = df.agg(F.max(col(id_col))).first()[0] or 0
        numbered = with_position(rows, order or list(rows.columns), name="_at")
        rows = numbered.withColumn(id_col, (F.lit(last) + 1 + F.col("_at")).cast(df.schema[id_col].dataType)).drop("_at")
    return df.unionByName(rows, allowMissingColumns=True)


def check_constraints(df: DataFrame, constraints: Sequence[tuple]) -> DataFrame:
    """Violations per constraint: (kind, target, violations).

    Constraints are ``("primary_key", cols)``, ``("unique", cols)``, ``("not_null", col)``, ``("check", expr)``.
    Row tests share one aggregate; each key test is one grouped count.
    """
    row_tests, parts = [], []
    for kind, target in constraints:
        if kind not in _CONSTRAINT_KINDS:
            raise ValueError(f"unknown constraint {kind!r}")
        names = [target] if isinstance(target, str) else list(target)
        label = ", ".join(names)
        if kind == "not_null":
            row_tests.append((kind, label, F.count_if(col(target).isNull())))
        elif kind == "check":
            # as in SQL, an unknown result does not violate
            row_tests.append((kind, label, F.count_if(~F.expr(target))))
        else:
            known = reduce(lambda a, b: a & b, [col(c).isNotNull() for c in names])
            copies = df.groupBy(*[col(c) for c in names]).agg(F.count(F.lit(1)).alias("_n"))
            repeated = F.sum(F.when(known & (F.col("_n") > 1), F.col("_n") - 1).otherwise(0))
            missing = F.sum(F.when(known, 0).otherwise(F.col("_n"))) if kind == "primary_key" else F.lit(0)
            parts.append(
                copies.agg(F.coalesce(repeated + missing, F.lit(0)).cast("long").alias("violations")).select(
                    F.lit(kind).alias("kind"), F.lit(label).alias("target"), "violations"
                )
            )
    if row_tests:
        wide = df.agg(*[test.alias(f"t{i}") for i, (_, _, test) in enumerate(row_tests)])
        rows = [
            F.struct(F.lit(k).alias("kind"), F.lit(t).alias("target"), F.col(f"t{i}").alias("violations"))
            for i, (k, t, _) in enumerate(row_tests)
        ]
        parts.append(wide.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


def update_where(df: DataFrame, cond: str, assignments: Mapping[str, str]) -> DataFrame:
    """UPDATE … SET … WHERE: new values see the old row."""
    types = {f.name: f.dataType for f in df.schema.fields}
    hit = F.coalesce(F.expr(cond), F.lit(False))
    return df.select(
        *[
            F.when(hit, F.expr(assignments[c]).cast(types[c])).otherwise(col(c)).alias(c) if c in assignments else col(c)
            for c in df.columns
        ]
    )


def delete_where(df: DataFrame, cond: str) -> DataFrame:
    return df.filter(F.coalesce(~F.expr(cond), F.lit(True)))


def alter_table(df: DataFrame, changes: Sequence[tuple]) -> DataFrame:
    """``("add", name, type[, default])``, ``("rename", old, new)``, ``("drop", name)``, ``("truncate",)``."""
    for kind, *args in changes:
        if kind == "add":
            name, type_, *default = args
            df = df.withColumn(name, F.lit(default[0] if default else None).cast(type_))
        elif kind == "rename":
            df = df.withColumnRenamed(*args)
        elif kind == "drop":
            df = df.drop(*args)
        elif kind == "truncate":
            df = df.filter(F.lit(False))
        else:
            raise ValueError(f"unknown change {kind!r}")
    return df
