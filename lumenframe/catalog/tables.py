"""Schema, profile, cleaning and anomaly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.catalog.inputs import GAPPY, MESSY, gappy, messy, rounded
from lumenframe.catalog.registry import query
from lumenframe.operators import clean, profile, schema

NUM = ["l_quantity", "l_extendedprice", "l_discount"]
FLAG = ["l_returnflag", "l_linestatus"]
GCOLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"]


def union(template: str, cols, sep: str = " UNION ALL ") -> str:
    return sep.join(template.replace("{c}", c) for c in cols)


# ---- schema --------------------------------------------------------------------------------

query("sch1_is_structured", f"""WITH {GAPPY} SELECT count(*) AS rows, CAST(8 AS BIGINT) AS columns,
  CAST({' + '.join(f'count({c})' for c in GCOLS)} AS BIGINT) AS filled_cells,
  ({' + '.join(f'count({c})' for c in GCOLS)}) / (count(*) * 8.0) >= 0.1 AS structured FROM gappy""")(
    lambda t: schema.is_structured(gappy(t))
)

query("sch2_restructure")(
    lambda t: schema.restructure(
        t.customer.select(
            "c_custkey",
            F.when(F.col("c_custkey") > 0, F.col("c_name")).alias("a"),
            F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("b"),
            F.lit(None).cast("string").alias("c"),
        ),
        "c_custkey",
    )
)

query("sch2_restructure_named", """SELECT c_custkey, c_name AS "Customer_000000000", CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE 'MISSING_VALUE' END AS "MISSING_VALUE" FROM customer WHERE c_custkey <> 0""")(
    lambda t: schema.restructure(
        t.customer.select("c_custkey", F.col("c_name").alias("a"), F.when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")).alias("b"), F.lit(None).cast("string").alias("c")), "c_custkey"
    )
)

query("sch3_sanitize_columns", """SELECT n_nationkey AS key_1_, n_name AS "name_text" FROM nation""")(
    lambda t: schema.sanitize_columns(t.nation.select(F.col("n_nationkey").alias("key[1]"), F.col("n_name").alias("name:text")))
)

_INTS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_DBLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
query("sch4_narrow_types_report", union("""SELECT '{c}' AS "column", CASE WHEN '{c}' = 'l_linenumber' THEN 'int' ELSE 'bigint' END AS type,
  CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint'
       WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END AS recommended FROM lineitem""", _INTS)
  + " UNION ALL " + union("""SELECT '{c}', 'double', CASE WHEN bool_and(abs({c} - CAST(CAST({c} AS FLOAT) AS DOUBLE)) < 5e-7) THEN 'float' ELSE 'double' END FROM lineitem""", _DBLS)
  + " UNION ALL " + union("""SELECT '{c}', 'string', CASE WHEN count(DISTINCT {c}) < 0.5 * count(*) THEN 'category' ELSE 'string' END FROM lineitem""", FLAG))(
    lambda t: schema.narrow_types_report(t.lineitem.drop("l_shipdate"))
)

_NARROW = "CASE WHEN max({c}) <= 127 THEN 'tinyint' WHEN max({c}) <= 32767 THEN 'smallint' WHEN max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END"
_NARROWED = ["p_partkey", "p_size"]
query("sch4_narrow_types", f"""WITH k AS (SELECT {', '.join(_NARROW.replace('{c}', c) + f' AS {c}_type' for c in _NARROWED)} FROM part)
  SELECT p_name, CAST(p_partkey AS BIGINT) AS p_partkey, CAST(p_size AS BIGINT) AS p_size, p_partkey_type, p_size_type FROM part, k""")(
    lambda t: (lambda made: made.select("p_name", *[F.col(c).cast("bigint").alias(c) for c in _NARROWED], *[F.lit(dict(made.dtypes)[c]).alias(f"{c}_type") for c in _NARROWED]))(
        schema.narrow_types(t.part.select("p_name", *_NARROWED))
    )
)

_NUM_OK = lambda c: f"count(TRY_CAST({c} AS DOUBLE))"
query("sch5_infer_types_report", f"WITH {MESSY}, texts AS (SELECT segment, amount, day, CAST(c_custkey AS VARCHAR) AS id FROM messy) " + union(
    """SELECT '{c}' AS "column", count({c}) AS known, count(TRY_CAST({c} AS DOUBLE)) AS numbers, count(TRY_CAST({c} AS TIMESTAMP)) AS times,
    CASE WHEN count(TRY_CAST({c} AS DOUBLE)) = count({c}) THEN 'double' WHEN count(TRY_CAST({c} AS TIMESTAMP)) = count({c}) THEN 'timestamp_ntz' ELSE 'string' END AS inferred FROM texts""",
    ["segment", "amount", "day"]))(
    lambda t: schema.infer_types_report(messy(t), ["segment", "amount", "day"])
)

query("sch5_infer_types", f"""WITH {MESSY} SELECT CAST(c_custkey AS DOUBLE) AS id, segment, CAST('2024-01-01' AS TIMESTAMP) AS seen FROM messy""")(
    lambda t: schema.infer_types(
        messy(t).select(F.col("c_custkey").cast("string").alias("id"), "segment", F.lit("2024-01-01 00:00:00").alias("seen"))
    )
)

query("sch6_convert_int", f"""WITH {MESSY} SELECT c_custkey, segment, CAST(trunc(TRY_CAST(amount AS DOUBLE)) AS BIGINT) AS amount, day FROM messy""")(
    lambda t: schema.convert_column(messy(t), "amount", "int")
)
query("sch6_convert_float", f"""WITH {MESSY} SELECT c_custkey, segment, TRY_CAST(amount AS DOUBLE) AS amount, day FROM messy""")(
    lambda t: schema.convert_column(messy(t), "amount", "float")
)
query("sch6_convert_str", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, n_regionkey FROM nation")(
    lambda t: schema.convert_column(t.nation, "n_nationkey", "str")
)
query("sch7_column_case_fix", "SELECT n_name, n_regionkey FROM nation")(
    lambda t: schema.column_case_fix(t.nation, ["N_NAME", "N_RegionKey"])
)
query("sch8_schema_counts", """SELECT * FROM (SELECT CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
  WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS type, count(*) AS columns FROM information_schema.columns WHERE table_name = 'lineitem' GROUP BY 1)""")(
    lambda t: schema.schema_counts(t.lineitem)
)

# ---- profile -------------------------------------------------------------------------------

_TYPES = {"l_orderkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
          "l_discount": "double", "l_returnflag": "string", "l_linestatus": "string"}
_PCOLS = list(_TYPES)
query("prf1_profile_columns", f"WITH {GAPPY} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{k}' AS type, count(DISTINCT {c}) AS "unique", count(*) - count({c}) AS missing,
    round(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE AS missing_pct,
    (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM gappy WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS samples
    FROM gappy""" for c, k in _TYPES.items()))(
    lambda t: profile.profile_columns(gappy(t), _PCOLS)
)

query("prf2_describe_all", f"WITH {GAPPY}, described AS (" + union(
    """SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min,
    round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max,
    CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq FROM gappy""", NUM)
    + " UNION ALL " + union(
    """SELECT '{c}', count({c}), NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(DISTINCT {c}),
    (SELECT {c} FROM gappy WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    (SELECT count(*) FROM gappy WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) FROM gappy""", FLAG)
    + ") SELECT * FROM described")(
    lambda t: rounded(profile.describe_all(gappy(t), NUM + FLAG))
)

query("prf3_missing_locations", f"WITH {GAPPY} " + union(
    """SELECT l_orderkey, l_linenumber, '{c}' AS "column" FROM gappy WHERE {c} IS NULL""", NUM + FLAG))(
    lambda t: profile.missing_locations(gappy(t), ["l_orderkey", "l_linenumber"])
)
_MISS = union("""SELECT '{c}' AS "column", count(*) - count({c}) AS missing FROM gappy""", GCOLS)
query("prf4_missing_counts", f"""WITH {GAPPY}, m AS ({_MISS}) SELECT * FROM m WHERE missing > 0""")(
    lambda t: profile.missing_counts(gappy(t))
)
query("prf4_missing_total", f"""WITH {GAPPY}, m AS ({_MISS}) SELECT CAST(sum(missing) AS BIGINT) AS missing_cells, count(*) AS affected_columns FROM m WHERE missing > 0""")(
    lambda t: profile.missing_total(gappy(t))
)
_MC = ["l_quantity", "l_discount", "l_returnflag"]
query("prf5_missing_correlation", f"WITH {GAPPY} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr(({a} IS NULL)::INT, ({b} IS NULL)::INT), 6) AS r FROM gappy"
    for i, a in enumerate(_MC) for b in _MC[i + 1:]))(
    lambda t: rounded(profile.missing_correlation(gappy(t)), 6)
)
query("prf6_missing_pattern", f"WITH {GAPPY} SELECT concat({', '.join(f'CASE WHEN {c} IS NULL THEN 0 ELSE 1 END' for c in GCOLS)}) AS pattern, count(*) AS rows FROM gappy GROUP BY 1")(
    lambda t: profile.missing_pattern(gappy(t))
)
query("prf7_quality_report", f"WITH {GAPPY} " + union(
    """SELECT '{c}' AS "column", count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "unique", min({c}) AS min, max({c}) AS max FROM gappy""", NUM)
    + " UNION ALL " + union("""SELECT '{c}', count(*) - count({c}), count(DISTINCT {c}), NULL, NULL FROM gappy""", FLAG))(
    lambda t: profile.quality_report(gappy(t), NUM + FLAG)
)
query("prf8_before_after", f"""WITH {GAPPY}, d AS (SELECT l_quantity, l_discount, l_returnflag FROM gappy), c AS (SELECT DISTINCT * FROM d WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_returnflag IS NOT NULL)
  SELECT 'before' AS stage, count(*) AS rows, 3 * count(*) - count(l_quantity) - count(l_discount) - count(l_returnflag) AS missing_cells,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicate_rows FROM d
  UNION ALL SELECT 'after', count(*), 0, 0 FROM c""")(
    lambda t: (lambda d: profile.before_after(d, clean.clean_data(d, {"missing": "drop_rows", "drop_duplicates": True})))(
        gappy(t).select("l_quantity", "l_discount", "l_returnflag")
    )
)
query("prf9_table_info", union("""SELECT '{c}' AS "column", count(*) AS rows, count(DISTINCT {c}) AS "unique" FROM orders""",
    ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]))(
    lambda t: profile.table_info(t.orders)
)
query("prf10_numeric_summary", union("""SELECT '{c}' AS "column", round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round(avg({c}), 4) AS avg, round(stddev_samp({c}), 4) AS std FROM lineitem""",
    ["l_linenumber"] + _DBLS))(
    lambda t: rounded(profile.numeric_summary(t.lineitem, ["l_linenumber"] + _DBLS))
)
query("prf11_top_values", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")(
    lambda t: profile.top_values(t.lineitem, "l_suppkey")
)
query("prf11_top_pairs", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20")(
    lambda t: profile.top_values(t.part, ["p_brand", "p_type"], 20)
)
query("prf12_dataset_context")(lambda t: profile.dataset_context(gappy(t)))
_FIELD = {"columns": "$.columns", "rows": "$.rows", "missing": "$.missing_values"}
query("prf12_dataset_context_fields", f"""WITH {GAPPY} SELECT CAST(8 AS DOUBLE) AS columns, CAST(count(*) AS DOUBLE) AS rows,
  CAST({' + '.join(f"count(*) FILTER ({c} IS NULL)" for c in ("l_quantity", "l_discount", "l_returnflag"))} AS DOUBLE) AS missing, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_discount), 6) AS std,
  round(quantile_cont(l_extendedprice, 0.75), 4) AS q75, round(corr(l_quantity, l_extendedprice), 6) AS r FROM gappy""")(
    lambda t: profile.dataset_context(gappy(t)).select(
        *[F.get_json_object("context", p).cast("double").alias(n) for n, p in _FIELD.items()],
        *[F.round(F.get_json_object("context", p).cast("double"), d).alias(n) for n, p, d in (
            ("mean", "$.describe.l_quantity.mean", 6), ("std", "$.describe.l_discount.std", 6), ("q75", "$.describe.l_extendedprice.q75", 4), ("r", "$.correlation.l_quantity~l_extendedprice", 6))],
    )
)
query("prf13_encoding_suggestions", union("""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "unique",
   CASE WHEN count(DISTINCT {c}) > 50 THEN 'Frequency Encoding' ELSE 'One-Hot Encoding' END AS recommended,
   CASE WHEN count(DISTINCT {c}) > 50 THEN 'Hash Encoding, Embedding' WHEN count(DISTINCT {c}) > 10 THEN 'Target Encoding, Label Encoding' ELSE 'Label Encoding, Binary Encoding' END AS alternatives,
   CASE WHEN count(DISTINCT {c}) > 50 THEN 'High cardinality - Consider dimensionality reduction' END AS warning FROM part""", ["p_name", "p_brand", "p_type"]))(
    lambda t: profile.encoding_suggestions(t.part)
)

# ---- cleaning ------------------------------------------------------------------------------

query("cln1_drop_missing_rows", f"WITH {GAPPY} SELECT * FROM gappy WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_returnflag IS NOT NULL")(
    lambda t: clean.drop_missing(gappy(t))
)
query("cln2_drop_missing_columns", f"WITH {GAPPY} SELECT l_orderkey, l_linenumber, l_extendedprice, l_linestatus, l_shipdate FROM gappy")(
    lambda t: clean.drop_missing(gappy(t), "columns")
)
_ID = "l_orderkey, l_linenumber"
query("cln3_fill_value", f"WITH {GAPPY} SELECT {_ID}, coalesce(l_quantity, -1.0) AS l_quantity, coalesce(l_returnflag, '-1') AS l_returnflag FROM gappy")(
    lambda t: clean.fill_missing(gappy(t).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), "value", -1)
)
query("cln4_fill_mean", f"WITH {GAPPY} SELECT {_ID}, round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM gappy)), 6) AS l_quantity, round(coalesce(l_discount, (SELECT avg(l_discount) FROM gappy)), 6) AS l_discount FROM gappy")(
    lambda t: rounded(clean.fill_missing(gappy(t), "mean", cols=["l_quantity", "l_discount"]).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), 6)
)
query("cln5_fill_median", f"WITH {GAPPY} SELECT {_ID}, coalesce(l_quantity, (SELECT median(l_quantity) FROM gappy)) AS l_quantity, coalesce(l_discount, (SELECT median(l_discount) FROM gappy)) AS l_discount FROM gappy")(
    lambda t: clean.fill_missing(gappy(t), "median", cols=["l_quantity", "l_discount"]).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
)
_MODE = "(SELECT {c} FROM gappy WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
query("cln6_fill_mode", f"WITH {GAPPY} SELECT {_ID}, " + ", ".join(f"coalesce({c}, {_MODE.replace('{c}', c)}) AS {c}" for c in _MC) + " FROM gappy")(
    lambda t: clean.fill_missing(gappy(t).select("l_orderkey", "l_linenumber", *_MC), "mode", cols=_MC)
)
query("cln7_drop_duplicates", "SELECT DISTINCT l_quantity, l_discount, l_returnflag FROM lineitem")(
    lambda t: clean.drop_duplicates(t.lineitem.select("l_quantity", "l_discount", "l_returnflag"))
)
query("cln8_remove_outliers_iqr", """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
  SELECT events.* FROM events, q WHERE value >= a - 1.5 * (b - a) AND value <= b + 1.5 * (b - a)""")(
    lambda t: clean.remove_outliers_iqr(t.events, "value")
)
query("cln9_trim", f"WITH {MESSY} SELECT c_custkey, trim(segment) AS segment, trim(amount) AS amount, trim(day) AS day FROM messy")(
    lambda t: clean.trim(messy(t))
)
for _case in ("lower", "upper"):
    query(f"cln10_text_case_{_case}", f"WITH {MESSY} SELECT c_custkey, {_case}(segment) AS segment, {_case}(amount) AS amount, {_case}(day) AS day FROM messy")(
        lambda t, _case=_case: clean.text_case(messy(t), _case)
    )
query("cln10_text_case_title", """SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(concat(p_name, '-', lower(p_brand)), '([A-Za-z]+|[^A-Za-z]+)'), lambda x: upper(x[1]) || lower(x[2:])), '') AS label FROM part""")(
    lambda t: clean.text_case(t.part.select("p_partkey", F.concat("p_name", F.lit("-"), F.lower("p_brand")).alias("label")), "title")
)
query("cln11_merge_similar_categories")(
    lambda t: clean.merge_similar_categories(messy(t), "segment")
)
_OPS = {
    "cln12_strip_special": (["remove_special_chars"], r"regexp_replace(segment, '[^A-Za-z0-9_\s]', '', 'g')"),
    "cln13_strip_digits": (["remove_numbers"], r"regexp_replace(segment, '[0-9]+', '', 'g')"),
    "cln14_squeeze_spaces": (["remove_extra_spaces"], r"trim(regexp_replace(segment, '\s+', ' ', 'g'))"),
}
for _name, (_ops, _sql) in _OPS.items():
    query(_name, f"WITH {MESSY} SELECT c_custkey, {_sql} AS segment FROM messy")(
        lambda t, _ops=_ops: clean.string_ops(messy(t).select("c_custkey", "segment"), _ops)
    )
query("cln15_date_features", f"""WITH {MESSY}, p AS (SELECT c_custkey, TRY_CAST(day AS TIMESTAMP) AS day FROM messy) SELECT c_custkey, day,
  CAST(year(day) AS INTEGER) AS day_year, CAST(month(day) AS INTEGER) AS day_month, CAST(day(day) AS INTEGER) AS day_day, CAST(hour(day) AS INTEGER) AS day_hour,
  CAST(minute(day) AS INTEGER) AS day_minute, CAST(isodow(day) - 1 AS INTEGER) AS day_dayofweek, CAST(quarter(day) AS INTEGER) AS day_quarter FROM p""")(
    lambda t: clean.date_features(messy(t).select("c_custkey", "day"), ["day"])
)
query("cln16_scale_standard", f"WITH {GAPPY} SELECT {_ID}, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity, round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) AS l_extendedprice FROM gappy")(
    lambda t: rounded(clean.scale(gappy(t), "standard", ["l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), 6)
)
query("cln17_scale_minmax", f"WITH {GAPPY} SELECT {_ID}, round((l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()), 6) AS l_quantity FROM gappy")(
    lambda t: rounded(clean.scale(gappy(t), "minmax", ["l_quantity"]).select("l_orderkey", "l_linenumber", "l_quantity"), 6)
)
query("cln18_one_hot", f"WITH {GAPPY} SELECT {_ID}, coalesce(l_returnflag = 'N', false) AS \"l_returnflag_N\", coalesce(l_returnflag = 'R', false) AS \"l_returnflag_R\", coalesce(l_linestatus = 'O', false) AS \"l_linestatus_O\" FROM gappy")(
    lambda t: clean.one_hot(gappy(t).select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"))
)
query("cln19_label_encode", f"WITH {GAPPY}, v AS (SELECT *, coalesce(l_returnflag, 'nan') AS f FROM gappy) SELECT {_ID}, dense_rank() OVER (ORDER BY f) - 1 AS l_returnflag FROM v")(
    lambda t: clean.label_encode(gappy(t).select("l_orderkey", "l_linenumber", "l_returnflag"))
)
query("cln20_clean_data", f"""WITH {MESSY}, u AS (SELECT DISTINCT c_custkey, segment, coalesce(day, '2000-01-01') AS day FROM messy),
  s AS (SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(upper(trim(segment)), '[^A-Za-z0-9_\\s]', '', 'g'), '[0-9]+', '', 'g'), '\\s+', ' ', 'g')) AS segment FROM u)
  SELECT round((c_custkey - min(c_custkey) OVER ()) / (max(c_custkey) OVER () - min(c_custkey) OVER ()), 6)::DOUBLE AS c_custkey, dense_rank() OVER (ORDER BY segment) - 1 AS segment FROM s""")(
    lambda t: rounded(clean.clean_data(
        messy(t).select("c_custkey", "segment"),
        {"missing": "value", "fill_value": "2000-01-01", "drop_duplicates": True, "trim": True, "case": "upper",
         "string_ops": ["remove_special_chars", "remove_numbers", "remove_extra_spaces"], "scale": "minmax", "encode": "label"},
    ), 6)
)
