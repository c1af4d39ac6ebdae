"""Statistical tests and correlation: one aggregate each, p-values from the aggregated row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.columns import TEMPORAL, col, numeric_columns, replace_columns
from lumenframe.functions.distributions import chi2_p_value, f_p_value, t_p_value
from lumenframe.plans.storage import materialize
from lumenframe.plans.comoments import pair_correlations


def t_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two-sample t-test with pooled variance over the non-null values of two columns."""
    s = df.agg(
        *[f(col(c)).alias(f"{n}{i}") for i, c in enumerate((a, b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    )
    dof = F.col("n0") + F.col("n1") - 2
    pooled = ((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / dof
    t = F.try_divide(F.col("m0") - F.col("m1"), F.sqrt(pooled * (1 / F.col("n0") + 1 / F.col("n1"))))
    return s.select(t.alias("t"), dof.cast("long").alias("dof")).withColumn(
        "p", t_p_value("t", F.col("dof").cast("double"))
    )


def anova(df: DataFrame, a: str, b: str) -> DataFrame:
    """One-way analysis of variance with the two columns as groups."""
    s = df.agg(
        *[
            f(col(c)).alias(f"{n}{i}")
            for i, c in enumerate((a, b))
            for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))
        ]
    )
    groups = [F.struct(F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v")) for i in range(2)]
    return _f_statistic(s.select(F.inline(F.array(*groups))))


def anova_by(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way analysis of variance of ``value`` over the values of ``group``."""
    known = df.filter(col(value).isNotNull() & col(group).isNotNull())
    return _f_statistic(
        known.groupBy(col(group)).agg(
            F.count(col(value)).alias("n"), F.avg(col(value)).alias("m"), F.var_pop(col(value)).alias("v")
        )
    )


def _f_statistic(groups: DataFrame) -> DataFrame:
    """``groups``: one row (n, m, v) per group. Deviations are taken from the grand mean, not from
    differences of large sums."""
    n, m, v = (F.col(c).cast("double") for c in ("n", "m", "v"))
    known = groups.filter(F.col("n") > 0)
    grand = known.agg((F.sum(n * m) / F.sum(n)).alias("g")).first()["g"]
    s = known.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum(n).alias("n"),
        F.sum(n * v).alias("within"),
        F.sum(n * (m - F.lit(grand)) * (m - F.lit(grand))).alias("between"),
    )
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    f = F.try_divide(F.try_divide(F.col("between"), d1), F.try_divide(F.col("within"), d2))
    return s.select(f.alias("f"), d1.cast("long").alias("dof_between"), d2.cast("long").alias("dof_within")).withColumn(
        "p", f_p_value("f", F.col("dof_between").cast("double"), F.col("dof_within").cast("double"))
    )


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency counts in long form; pairs with a null are left out."""
    known = df.filter(col(a).isNotNull() & col(b).isNotNull())
    return known.groupBy(col(a), col(b)).agg(F.count(F.lit(1)).alias("n"))


def crosstab_wide(df: DataFrame, a: str, b: str, max_values: int = 1000) -> DataFrame:
    known = df.filter(col(a).isNotNull() & col(b).isNotNull())
    values = [r[0] for r in known.select(col(b)).distinct().limit(max_values + 1).collect()]
    if len(values) > max_values:
        raise ValueError(f"column {b!r} has more than {max_values} values; use crosstab")
    return known.groupBy(col(a)).pivot(b, sorted(values)).count().na.fill(0)


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square test of independence; continuity correction for a 2x2 table.

    Empty cells enter through the margins, so the full table is never formed.
    """
    # The counts are read for both margins and for the sum, so they are written down once.
    cells = materialize(crosstab(df, a, b).select(col(a).alias("a"), col(b).alias("b"), "n"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("row_n"))
    columns = cells.groupBy("b").agg(F.sum("n").alias("col_n"))
    side = lambda t, name: t.agg(F.count(F.lit(1)).alias("k"), F.sum(1 / F.col(name)).alias("inv"), F.sum(name).alias("n"))
    r, c = side(rows, "row_n").first(), side(columns, "col_n").first()  # one row each
    total = r["n"] or 0
    joined = cells.join(rows, "a").join(columns, "b")
    product = F.col("row_n").cast("double") * F.col("col_n")
    s = joined.agg(
        F.sum(F.col("n").cast("double") * F.col("n") / product).alias("s"),
        F.max(F.abs(F.col("n") - product / F.lit(float(total or 1)))).alias("gap"),
    )
    dof = (r["k"] - 1) * (c["k"] - 1)
    if (r["k"], c["k"]) == (2, 2):
        # all four cells differ from expectation by the same amount
        gap = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
        chi2 = gap * gap * F.lit(float(total)) * F.lit(float(r["inv"]) * float(c["inv"]))
    else:
        chi2 = F.lit(float(total)) * (F.col("s") - 1)
    if dof == 0:
        chi2 = F.lit(0.0)
    return s.select(chi2.alias("chi2"), F.lit(dof).cast("long").alias("dof")).withColumn(
        "p", chi2_p_value("chi2", F.col("dof").cast("double"))
    )


def ts_to_epoch(df: DataFrame, cols=None) -> DataFrame:
    """Date and time columns as seconds since 1970; times without a zone do not depend on the session's."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, TEMPORAL)]
    types = dict(df.dtypes)

    def seconds(c: str):
        if types[c] == "timestamp":
            return F.unix_seconds(col(c))
        start = F.lit("1970-01-01").cast("timestamp_ntz")
        micros = F.timestamp_diff("MICROSECOND", start, col(c).cast("timestamp_ntz"))
        return F.floor(micros / F.lit(1_000_000))

    return replace_columns(df, {c: seconds(c) for c in cols})


PLAIN_PAIRS = 100  # pairs of columns in one aggregate


def correlation_matrix(df: DataFrame, cols=None) -> DataFrame:
    """Pearson correlation of every column pair over the rows where both are known.

    Few pairs are one aggregate; for many, whose expressions would outgrow a plan, batches are multiplied as matrices.
    """
    cols = numeric_columns(df, cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    if 0 < len(pairs) <= PLAIN_PAIRS:
        wide = df.agg(*[F.corr(col(a), col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
        return wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))
    r, n = pair_correlations(df, cols)
    rows = [(a, b, float(r[i, j]) if n[i, j] > 1 else None) for i, a in enumerate(cols) for j, b in enumerate(cols[i + 1 :], i + 1)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def correlation_edges(df: DataFrame, cols=None, threshold: float = 0.7) -> DataFrame:
    return correlation_matrix(df, cols).filter(F.abs("r") > threshold)


def pair_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x."""
    return df.agg(
        F.regr_slope(col(y), col(x)).alias("slope"),
        F.regr_intercept(col(y), col(x)).alias("intercept"),
        F.regr_r2(col(y), col(x)).alias("r2"),
    )
