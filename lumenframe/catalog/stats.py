"""Sources, sinks, SQL tables, tests, correlation, chart data and anomaly queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenframe.catalog.inputs import GAPPY, gappy, rounded
from lumenframe.catalog.registry import query
from lumenframe.operators import anomaly, charts, sqltables, stats
from lumenframe.plans.storage import shared_folder
from lumenframe.sources import readers, writers


def scratch(t) -> str:
    return f"{shared_folder(t.spark).rstrip('/')}/lumenframe/{uuid.uuid4().hex}"


# ---- sources and sinks: every one is exercised by a round trip of a whole table -------------

def _round_trip(t, df, write, read):
    path = scratch(t)
    write(df, path)
    return read(t.spark, path)


query("src1_read_table", "SELECT * FROM orders")(
    lambda t: _round_trip(t, t.orders, writers.write_csv, lambda s, p: readers.read_table(s, p, "csv")).select(
        F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus", "o_totalprice",
        F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "o_orderpriority")
)
query("src2_read_csv_strings", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer")(
    lambda t: _round_trip(t, t.customer, writers.write_csv, readers.read_csv_strings)
)
_LATIN = r"[^ !#-\[\]-~\x{A0}-\x{FF}]+"  # line ends, quotes and what the encoding lacks
query("src3_read_csv_encoded", f"SELECT doc_id, trim(regexp_replace(text, '{_LATIN}', ' ', 'g')) AS text FROM documents")(
    lambda t: _round_trip(
        t, t.documents.select("doc_id", F.trim(F.regexp_replace("text", _LATIN, " ")).alias("text")),
        lambda d, p: d.write.option("header", True).option("encoding", "ISO-8859-1").csv(p),
        lambda s, p: readers.read_csv_encoded(s, p),
    ).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
)
query("src4_read_sampled", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
  WHERE CAST('0x' || substr(md5('42|' || l_orderkey || '|' || l_linenumber), 1, 8) AS BIGINT) / 4294967296.0 < 0.1""")(
    lambda t: readers.read_sampled(t.spark, f"{t.folder}/lineitem.parquet", 0.1, key=["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_quantity")
)
query("src5_text_lines", "SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda l: trim(l, ' ') <> '')) AS text FROM documents")(
    lambda t: readers.text_lines(t.documents, "text", ["doc_id"])
)
query("src6_register_tables", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")(
    lambda t: sqltables.run_sql(
        t.spark,
        "SELECT n_name, r_name FROM {} JOIN {} ON n_regionkey = r_regionkey".format(
            *readers.register_tables(t.spark, [f"{t.folder}/nation.parquet", f"{t.folder}/region.parquet"])
        ),
    )
)
query("snk1_write_csv", "SELECT p_partkey, p_name, p_retailprice FROM part")(
    lambda t: _round_trip(t, t.part.select("p_partkey", "p_name", "p_retailprice"), writers.write_csv,
                          lambda s, p: s.read.schema("p_partkey long, p_name string, p_retailprice double").csv(p, header=True))
)
query("snk2_write_json", "SELECT p_partkey, p_name, p_retailprice FROM part")(
    lambda t: _round_trip(t, t.part.select("p_partkey", "p_name", "p_retailprice"), writers.write_json,
                          lambda s, p: s.read.schema("p_partkey long, p_name string, p_retailprice double").json(p))
)


@query("snk3_export_all_tables", "SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(t):
    for name in ("supplier", "nation"):
        writers.save_as_table(getattr(t, name), f"export_{name}")
    paths = writers.export_all_tables(t.spark, ["export_supplier", "export_nation"], scratch(t))
    supplier, nation = (t.spark.read.parquet(p) for p in paths)
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select("s_name", "n_name")


query("snk4_save_as_table", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")(
    lambda t: writers.save_as_table(
        sqltables.run_sql(t.spark, "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1", {"orders": t.orders}), "priority_counts")
)


@query("snk5_drop_tables", "SELECT 'nation_' || n_nationkey AS dropped FROM nation")
def _(t):
    # one view per nation, then all dropped again; the names that were really dropped come back
    names = [f"nation_{r.n_nationkey}" for r in t.nation.select("n_nationkey").collect()]
    for name in names:
        writers.save_as_table(t.nation.where(F.lit(name) == F.concat(F.lit("nation_"), "n_nationkey")), name)
    return t.spark.createDataFrame([(n,) for n in writers.drop_tables(t.spark, [*names, "never_made"])], "dropped string")


@query("snk6_history_table", """SELECT 'query' AS kind, CAST(count(*) AS DOUBLE) AS value FROM orders UNION ALL SELECT 'query', CAST(count(DISTINCT o_custkey) AS DOUBLE) FROM orders
  UNION ALL SELECT 'query', CAST(count(*) AS DOUBLE) FROM orders WHERE o_totalprice > 1000""")
def _(t):
    path = scratch(t)
    for text in ("SELECT * FROM orders", "SELECT DISTINCT o_custkey FROM orders", "SELECT * FROM orders WHERE o_totalprice > 1000"):
        _, rec = sqltables.run_sql_timed(t.spark, text, {"orders": t.orders})
        writers.append_history(t.spark, path, {"text": rec["query"], "metrics": {"rows": rec["rows"], "seconds": rec["seconds"]}})
    return writers.metric_over_time(writers.latest_runs(t.spark.read.parquet(path)), "rows").select("kind", "value")


# ---- SQL tables ------------------------------------------------------------------------------

_Q1 = """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
  round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-12-01 00:00:00' GROUP BY l_returnflag, l_linestatus"""
query("sql1_run_sql", _Q1)(lambda t: sqltables.run_sql(t.spark, _Q1.replace("TIMESTAMP ", "TIMESTAMP_NTZ ") + ";", {"lineitem": t.lineitem}))

query("sql2_build_query", """SELECT o_orderpriority, count(o_orderkey) AS count_o_orderkey, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders
  WHERE o_totalprice > 1000 AND o_orderstatus IN ('F', 'O') GROUP BY 1 ORDER BY 1 LIMIT 1000""")(
    lambda t: rounded(sqltables.build_query({"orders": t.orders}, {
        "table": "orders", "filters": [("o_totalprice", ">", 1000), ("o_orderstatus", "IN", ["F", "O"])],
        "aggregates": [("COUNT", "o_orderkey"), ("SUM", "o_totalprice")], "group_by": ["o_orderpriority"],
        "order_by": ("o_orderpriority", "ASC"), "limit": 1000}), 2)
)
_FILTERS = [("c_acctbal", ">", 0), ("c_acctbal", "<=", 9000), ("c_acctbal", "!=", 5), ("c_name", "LIKE", "Customer#%1%"), ("c_mktsegment", "IN", ["BUILDING", "MACHINERY"]),
            ("c_nationkey", "BETWEEN", (2, 20)), ("c_custkey", "IS NOT NULL"), ("c_nationkey", ">=", 3), ("c_nationkey", "<", 20)]
query("sql3_filters", """SELECT * FROM customer WHERE c_acctbal > 0 AND c_acctbal <= 9000 AND c_acctbal <> 5 AND c_name LIKE 'Customer#%1%' AND c_mktsegment IN ('BUILDING', 'MACHINERY')
  AND c_nationkey BETWEEN 2 AND 20 AND c_custkey IS NOT NULL AND c_nationkey >= 3 AND c_nationkey < 20""")(
    lambda t: sqltables.build_query({"customer": t.customer}, {"table": "customer", "filters": _FILTERS, "limit": None})
)
query("sql3_filter_null", f"WITH {GAPPY} SELECT l_orderkey, l_linenumber FROM gappy WHERE l_quantity IS NULL AND l_returnflag = 'R'")(
    lambda t: sqltables.build_query({"g": gappy(t)}, {"table": "g", "filters": [("l_quantity", "IS NULL"), ("l_returnflag", "=", "R")], "columns": ["l_orderkey", "l_linenumber"], "limit": None})
)
query("sql4_aggregates", """SELECT l_returnflag, count(l_quantity) AS count_l_quantity, sum(l_quantity) AS sum_l_quantity, round(avg(l_quantity), 4) AS avg_l_quantity, min(l_quantity) AS min_l_quantity,
  max(l_quantity) AS max_l_quantity, round(stddev(l_quantity), 4) AS stddev_l_quantity, round(variance(l_quantity), 4) AS variance_l_quantity FROM lineitem GROUP BY 1""")(
    lambda t: rounded(sqltables.build_query({"l": t.lineitem}, {"table": "l", "group_by": ["l_returnflag"],
        "aggregates": [(f, "l_quantity") for f in ("COUNT", "SUM", "AVG", "MIN", "MAX", "STDDEV", "VARIANCE")]}))
)
query("sql5_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 1000")(
    lambda t: sqltables.build_query({"o": t.orders}, {"table": "o", "columns": ["o_orderkey", "o_totalprice"], "order_by": ("o_orderkey", "DESC"), "limit": 1000})
)
for _how in ("INNER", "LEFT", "RIGHT", "FULL"):
    query(f"sql6_join_{_how.lower()}", f"""SELECT o_orderkey, o_custkey, o_totalprice, c_custkey, c_name FROM (SELECT * FROM orders WHERE o_totalprice > 100000) o
      {_how} JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey""")(
        lambda t, _how=_how: sqltables.join_tables(
            t.orders.filter("o_totalprice > 100000"), t.customer.filter("c_acctbal > 0"), "o_custkey", "c_custkey", _how
        ).select("o_orderkey", "o_custkey", "o_totalprice", "c_custkey", "c_name")
    )
query("sql7_theta_join", "SELECT l_orderkey, l_linenumber, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey AND l_extendedprice > 30 * p_retailprice")(
    lambda t: sqltables.join_tables(t.lineitem, t.part, "l_partkey", "p_partkey", "INNER", "l_extendedprice > 30 * p_retailprice").select("l_orderkey", "l_linenumber", "p_partkey")
)
query("sql8_daily_totals", "SELECT CAST(ts AS DATE) AS day, round(sum(value), 4) AS total, round(avg(value), 4) AS average FROM events GROUP BY 1")(
    lambda t: rounded(sqltables.daily_totals(t.events, "ts", "value"))
)
query("sql9_subset", "SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 500")(
    lambda t: sqltables.subset(t.events, ["event_id", "value"], 500, ["ts", "event_id"])
)


def both(name: str, text: str, *tables: str, spark_text: str | None = None):
    """The same SQL text on both engines."""
    query(name, text)(lambda t: sqltables.run_sql(t.spark, spark_text or text, {n: getattr(t, n) for n in tables}))


both("sql10_distinct_having_case", """SELECT DISTINCT seg, size_class FROM (SELECT c_mktsegment AS seg, CASE WHEN count(*) > 290 THEN 'large' ELSE 'small' END AS size_class
  FROM customer GROUP BY c_mktsegment HAVING count(*) > 10 UNION ALL SELECT 'ALL', 'large')""", "customer")
both("sql10_offset", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100 OFFSET 50", "customer")
both("sql11_union", "SELECT l_suppkey AS k FROM lineitem UNION SELECT s_suppkey FROM supplier", "lineitem", "supplier")
both("sql11_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0", "orders", "customer")
both("sql11_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000", "orders", "customer")
both("sql11_except_all", "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer", "orders", "customer")
both("sql12_windows", """SELECT o_custkey, o_orderkey, rank() OVER w AS price_rank, lag(o_orderkey) OVER w AS previous_order,
  round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running_total
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""", "orders",
  spark_text="""SELECT o_custkey, o_orderkey, CAST(rank() OVER w AS BIGINT) AS price_rank, lag(o_orderkey) OVER w AS previous_order,
  round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running_total
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""")
for _g in ("ROLLUP (l_returnflag, l_linestatus)", "CUBE (l_returnflag, l_linestatus)", "GROUPING SETS ((l_returnflag), (l_linestatus), ())"):
    both(f"sql13_{_g.split(' (')[0].lower().replace(' ', '_')}", f"SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty FROM lineitem GROUP BY {_g}", "lineitem")
both("sql14_exists_cte", """WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 10)
  SELECT c_custkey, c_name, (SELECT max(n) FROM big) AS most FROM customer WHERE EXISTS (SELECT 1 FROM big WHERE o_custkey = c_custkey)""", "orders", "customer")
query("sql14_semi_join", "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")(
    lambda t: t.customer.join(t.orders.filter("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
)
query("sql14_anti_join", "SELECT * FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")(
    lambda t: t.customer.join(t.orders.filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
)


@query("sql15_create_table", "SELECT r_regionkey AS id, r_name AS name, 'open' AS state FROM region")
def _(t):
    name = f"made_{uuid.uuid4().hex[:8]}"
    sqltables.create_table(t.spark, name, {"id": "INT", "name": "STRING", "state": "STRING"}, {"state": "'open'"}, path=scratch(t))
    t.region.createOrReplaceTempView("region_rows")
    t.spark.sql(f"INSERT INTO {name} (id, name) SELECT r_regionkey, r_name FROM region_rows")
    return t.spark.table(name)


query("sql16_insert_rows", """SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL
  SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY c_name), c_name FROM customer""")(
    lambda t: sqltables.insert_rows(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), t.customer.select(F.col("c_name").alias("name")), "id", "name")
)
query("sql17_check_constraints", f"""WITH {GAPPY} SELECT 'primary_key' AS kind, 'l_orderkey, l_linenumber' AS target, CAST(sum(n - 1) AS BIGINT) AS violations FROM (SELECT count(*) AS n FROM gappy GROUP BY l_orderkey, l_linenumber)
  UNION ALL SELECT 'unique', 'l_extendedprice', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM gappy GROUP BY l_extendedprice)
  UNION ALL SELECT 'not_null', 'l_discount', count(*) - count(l_discount) FROM gappy
  UNION ALL SELECT 'check', 'l_quantity <= 45', count(*) FROM gappy WHERE NOT (l_quantity <= 45)""")(
    lambda t: sqltables.check_constraints(gappy(t), [("primary_key", ["l_orderkey", "l_linenumber"]), ("unique", "l_extendedprice"), ("not_null", "l_discount"), ("check", "l_quantity <= 45")])
)
query("sql18_update_where", f"WITH {GAPPY} SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN l_quantity * 2 ELSE l_quantity END AS l_quantity FROM gappy")(
    lambda t: sqltables.update_where(gappy(t), "l_returnflag = 'R'", {"l_quantity": "l_quantity * 2"}).select("l_orderkey", "l_linenumber", "l_quantity")
)
query("sql19_delete_where", f"WITH {GAPPY} SELECT l_orderkey, l_linenumber FROM gappy WHERE (l_quantity > 25) IS NOT TRUE")(
    lambda t: sqltables.delete_where(gappy(t), "l_quantity > 25").select("l_orderkey", "l_linenumber")
)
query("sql20_alter_table", "SELECT n_nationkey, n_name AS name, 'x' AS note FROM nation")(
    lambda t: sqltables.alter_table(t.nation, [("add", "note", "string", "x"), ("rename", "n_name", "name"), ("drop", "n_regionkey")])
)

# ---- tests and correlation -------------------------------------------------------------------

_MOMENTS = "count({c}) AS n{i}, avg({c}) AS m{i}, var_samp({c}) AS v{i}"
_TWO = ", ".join(_MOMENTS.replace("{c}", c).replace("{i}", str(i)) for i, c in enumerate(("l_discount", "l_tax")))
def _with_p(sql: str, upper: str, log_density: str, digits: int) -> str:
    """The statistics of ``sql`` and their tail probability, by Simpson's rule on the density of the root of the statistic."""
    return f"""WITH base AS ({sql}), i AS (SELECT unnest(range(4001)) AS i), x AS (SELECT base.*, greatest(i * {upper} / 4000, 1e-300) AS w, {upper} / 4000 AS h,
  CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS c FROM base, i)
  SELECT * EXCLUDE (w, h, c, part), round(greatest(1 - sum(part), 0), {digits}) AS p FROM (SELECT *, c * exp({log_density}) * h / 3 AS part FROM x) GROUP BY ALL"""


def _f_root(d1: str, d2: str) -> str:
    return (f"ln(2) + {d1} / 2.0 * ln({d1} * 1.0 / {d2}) + lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0)"
            f" + ({d1} - 1) * ln(w) - ({d1} + {d2}) / 2.0 * ln(1 + {d1} * w * w / {d2})")


_CHI_ROOT = "(dof - 1) * ln(w) - w * w / 2 - (dof / 2.0 - 1) * ln(2) - lgamma(dof / 2.0)"
query("stt1_t_test", _with_p(f"""WITH s AS (SELECT {_TWO} FROM lineitem) SELECT round((m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)), 6) AS t, n0 + n1 - 2 AS dof FROM s""", "abs(t)", _f_root("1", "dof"), 4))(
    lambda t: rounded(stats.t_test(t.lineitem, "l_discount", "l_tax"), 6).withColumn("p", F.round("p", 4))
)
query("stt2_anova", _with_p(f"""WITH s AS (SELECT {_TWO} FROM lineitem), g AS (SELECT *, (n0 * m0 + n1 * m1) / (n0 + n1) AS gm FROM s)
  SELECT round((n0 * (m0 - gm) ** 2 + n1 * (m1 - gm) ** 2) / (((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 4) AS f, CAST(1 AS BIGINT) AS dof_between, n0 + n1 - 2 AS dof_within FROM g""", "sqrt(f)", _f_root("dof_between", "dof_within"), 4))(
    lambda t: rounded(stats.anova(t.lineitem, "l_discount", "l_tax"), 4)
)
query("stt2_anova_by", _with_p("""WITH g AS (SELECT l_suppkey, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v FROM lineitem GROUP BY 1), t AS (SELECT avg(l_extendedprice) AS gm FROM lineitem)
  SELECT round((sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 6) AS f, count(*) - 1 AS dof_between, CAST(sum(n) - count(*) AS BIGINT) AS dof_within FROM g, t""", "sqrt(f)", _f_root("dof_between", "dof_within"), 4))(
    lambda t: rounded(stats.anova_by(t.lineitem, "l_extendedprice", "l_suppkey"), 6).withColumn("p", F.round("p", 4))
)
query("stt3_chi_square", _with_p("""WITH o AS (SELECT a, b, (SELECT count(*) FROM part WHERE p_brand = a AND p_type = b) AS n FROM (SELECT DISTINCT p_brand AS a FROM part), (SELECT DISTINCT p_type AS b FROM part)),
  e AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / CAST(sum(n) OVER () AS DOUBLE) AS e, a, b FROM o)
  SELECT round(sum((n - e) ** 2 / e), 6) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof FROM e""", "sqrt(chi2)", _CHI_ROOT, 4))(
    lambda t: rounded(stats.chi_square(t.part, "p_brand", "p_type"), 6).withColumn("p", F.round("p", 4))
)
query("stt3_chi_square_2x2", _with_p("""WITH s AS (SELECT l_quantity > 25 AS a, l_tax > 0.04 AS b, count(*) AS n FROM lineitem GROUP BY 1, 2),
  e AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / CAST(sum(n) OVER () AS DOUBLE) AS e FROM s)
  SELECT round(sum((abs(n - e) - least(0.5, abs(n - e))) ** 2 / e), 6) AS chi2, CAST(1 AS BIGINT) AS dof FROM e""", "sqrt(chi2)", _CHI_ROOT, 4))(
    lambda t: rounded(stats.chi_square(t.lineitem.selectExpr("l_quantity > 25 AS a", "l_tax > 0.04D AS b"), "a", "b"), 6).withColumn("p", F.round("p", 4))
)
query("stt4_crosstab", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")(
    lambda t: stats.crosstab(t.orders, "o_orderstatus", "o_orderpriority")
)
query("stt4_crosstab_wide", """SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS "F", count(*) FILTER (l_linestatus = 'O') AS "O" FROM lineitem GROUP BY 1""")(
    lambda t: stats.crosstab_wide(t.lineitem, "l_returnflag", "l_linestatus")
)
query("stt5_ts_to_epoch", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events")(
    lambda t: stats.ts_to_epoch(t.events.select("event_id", "ts"))
)
_CC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM lineitem" for i, a in enumerate(_CC) for b in _CC[i + 1:])
query("cor1_correlation_matrix", _CORR)(lambda t: rounded(stats.correlation_matrix(t.lineitem, _CC), 8))
_EC = ["l_extendedprice", "net", "l_tax"]
query("cor2_correlation_edges", "WITH n AS (SELECT l_extendedprice, l_tax, l_extendedprice * (1 - l_discount) AS net FROM lineitem), e AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM n" for i, a in enumerate(_EC) for b in _EC[i + 1:]) + ") SELECT * FROM e WHERE abs(r) > 0.7")(
    lambda t: rounded(stats.correlation_edges(t.lineitem.selectExpr("l_extendedprice", "l_extendedprice * (1 - l_discount) AS net", "l_tax"), _EC), 8)
)
query("cor3_pair_trend", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem")(
    lambda t: stats.pair_trend(t.lineitem, "l_quantity", "l_extendedprice").select(F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 8).alias("r2"))
)

# ---- chart data ------------------------------------------------------------------------------

_HIST = """WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, lo, (hi - lo) / 50 AS w FROM events, s)
  SELECT bin, round(lo + bin * w, 6) AS low, round(lo + (bin + 1) * w, 6) AS high, count(*) AS n FROM b GROUP BY bin, lo, w"""
query("viz1_histogram", _HIST)(lambda t: rounded(charts.histogram(t.events, "value", 50), 6))
query("viz2_kde", """WITH s AS (SELECT count(*) AS n, min(p_retailprice) AS lo, max(p_retailprice) AS hi, stddev_samp(p_retailprice) * pow(count(*), -0.2) AS h FROM part),
  g AS (SELECT CAST(range AS INTEGER) AS point FROM range(100))
  SELECT point, round(lo + point * (hi - lo) / 99, 6) AS x, round(sum(exp(-0.5 * pow((p_retailprice - (lo + point * (hi - lo) / 99)) / h, 2))) / (n * h * sqrt(2 * pi())) * n * (hi - lo) / 50, 6) AS y
  FROM part, s, g GROUP BY point, lo, hi, n, h""")(lambda t: rounded(charts.kde(t.part, "p_retailprice"), 6))
query("viz3_qq_points", """WITH r AS (SELECT CAST(l_extendedprice AS DOUBLE) AS value, row_number() OVER (ORDER BY l_extendedprice) AS i, count(*) OVER () AS n FROM lineitem)
  SELECT value, round(CASE WHEN i = n THEN pow(0.5, 1.0 / n) WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n) ELSE (i - 0.3175) / (n + 0.365) END, 9) AS position FROM r""")(
    lambda t: charts.qq_points(t.lineitem, "l_extendedprice").select("value", F.round("position", 9).alias("position"))
)
query("viz4_box_stats", " UNION ALL ".join(f"""SELECT '{c}' AS "column", min({c}) AS min, round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS median, round(any_value(q3), 6) AS q3, max({c}) AS max, round(avg({c}), 6) AS mean,
  min({c}) FILTER ({c} >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max({c}) FILTER ({c} <= q3 + 1.5 * (q3 - q1)) AS whisker_high
  FROM {tab}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM {tab})""" for tab, c in (("events", "value"),)))(
    lambda t: rounded(charts.box_stats(t.events, ["value"]), 6)
)
_DRAW = "CAST(CAST('0x' || substr(md5(concat_ws('|', '42', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR))), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"
query("viz5_stratified_sample", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {_DRAW}, l_orderkey, l_linenumber, l_partkey) - 1 AS _rank,
  floor(count(*) OVER (PARTITION BY l_returnflag) * (CAST(1000 AS DOUBLE) / count(*) OVER ())) AS _take FROM lineitem) SELECT * EXCLUDE (_rank, _take) FROM r WHERE _rank < _take""")(lambda t: charts.stratified_sample(t.lineitem, "l_returnflag", 1000, ["l_orderkey", "l_linenumber", "l_partkey"]))
for _part, _i in (("A", 0), ("D", 3)):
    query(f"viz6_quarter_slice_{_part.lower()}", f"""WITH p AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)
      SELECT event_id FROM p WHERE i >= {_i} * (n // 4) AND i < {'n' if _i == 3 else f'{_i + 1} * (n // 4)'}""")(
        lambda t, _part=_part: charts.quarter_slice(t.events, ["ts", "event_id"], _part).select("event_id")
    )
query("viz7_radar_means", "WITH m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS m FROM lineitem" for c in _CC) + ") SELECT feature, round((m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()), 8) AS value FROM m")(
    lambda t: rounded(charts.radar_means(t.lineitem, _CC), 8)
)
query("viz8_hierarchy_counts", """WITH r AS (SELECT p_type, p_brand, count(*) AS n, CASE WHEN p_type IS NULL THEN 0 WHEN p_brand IS NULL THEN 1 ELSE 2 END AS level FROM part GROUP BY ROLLUP (p_type, p_brand))
  SELECT p_type, p_brand, level, n, round(CASE level WHEN 0 THEN 1.0 WHEN 1 THEN n / (SELECT count(*) FROM part) ELSE n / CAST(sum(n) OVER (PARTITION BY p_type, level) AS DOUBLE) END, 8)::DOUBLE AS share_of_parent FROM r""")(
    lambda t: rounded(charts.hierarchy_counts(t.part, ["p_type", "p_brand"]), 8)
)
query("viz9_bubble_scale", """WITH b AS (SELECT c_custkey, abs(c_acctbal) AS v FROM customer) SELECT c_custkey, round(10 + (v - min(v) OVER ()) * 50 / (max(v) OVER () - min(v) OVER ()), 6) AS bubble_size FROM b""")(
    lambda t: rounded(charts.bubble_scale(t.customer, "c_acctbal").select("c_custkey", "bubble_size"), 6)
)
query("viz10_colour_scale", """WITH b AS (SELECT c_custkey, CAST(floor((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) * 255) AS INTEGER) AS red FROM customer)
  SELECT c_custkey, red, 255 - red AS green FROM b""")(lambda t: charts.colour_scale(t.customer, "c_acctbal").select("c_custkey", "red", "green"))
query("viz10_colour_categories", """WITH b AS (SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS k FROM customer), c AS (SELECT c_custkey, CAST(floor(k / CAST(max(k) OVER () AS DOUBLE) * 255) AS INTEGER) AS red FROM b)
  SELECT c_custkey, red, 255 - red AS green FROM c""")(lambda t: charts.colour_scale(t.customer, "c_mktsegment").select("c_custkey", "red", "green"))
query("viz11_heatmap_grid", "SELECT l_returnflag, l_linenumber, round(avg(l_quantity), 6) AS z FROM lineitem GROUP BY 1, 2")(
    lambda t: rounded(charts.heatmap_grid(t.lineitem, "l_returnflag", "l_linenumber", "l_quantity"), 6)
)
query("viz12_share_of_total", """WITH t AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10) SELECT p_brand, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 8) AS share FROM t""")(
    lambda t: rounded(charts.share_of_total(t.part, "p_brand"), 8)
)
query("viz13_xy_aggregate", "SELECT l_shipdate, l_returnflag, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2")(
    lambda t: charts.xy_aggregate(t.lineitem, "l_shipdate", "l_quantity", "l_returnflag")
)

# ---- anomalies -------------------------------------------------------------------------------

_F = "(SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)"
query("anm1_anomalies_iqr", f"SELECT event_id, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS value_anomaly FROM events, {_F}")(
    lambda t: anomaly.anomalies(t.events, "iqr", ["value"]).select("event_id", "value_anomaly")
)
query("anm1_summary_iqr", f"""SELECT 'value' AS "column", count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS anomalies,
  round(100.0 * count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) / count(*), 2)::DOUBLE AS percent, round(any_value(a - 1.5 * (b - a)), 6) AS lower, round(any_value(b + 1.5 * (b - a)), 6) AS upper FROM events, {_F}""")(
    lambda t: rounded(anomaly.anomaly_summary(t.events, "iqr", ["value"]), 6)
)
_Z = "abs((value - avg(value) OVER ()) / stddev_samp(value) OVER ()) > 3"
query("anm2_anomalies_zscore", f"SELECT event_id, {_Z} AS value_anomaly FROM events")(
    lambda t: anomaly.anomalies(t.events, "zscore", ["value"]).select("event_id", "value_anomaly")
)
query("anm3_isolation_forest")(
    lambda t: anomaly.isolation_forest(t.lineitem, _CC, 0.05, ["l_orderkey", "l_linenumber", "l_partkey"]).groupBy("anomaly").count()
)
query("anm4_anomalies_moving_average", """WITH r AS (SELECT event_id, value, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, count(*) OVER w AS n FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
  SELECT event_id, round(CASE WHEN n = 7 THEN m END, 6) AS moving_avg, coalesce(n = 7 AND (value > m + 2 * s OR value < m - 2 * s), false) AS anomaly FROM r""")(
    lambda t: rounded(anomaly.anomalies_moving_average(t.events, ["ts", "event_id"], "value").select("event_id", "moving_avg", "anomaly"), 6)
)
query("anm5_anomaly_total", f"SELECT count(*) AS flagged_cells FROM (SELECT {_Z} AS f FROM events) WHERE f")(
    lambda t: anomaly.anomaly_total(t.events, "zscore", ["value"])
)
