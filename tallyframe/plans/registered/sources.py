"""Round trips through files, typing of text, and the stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.numeric import parse_numeric_text
from tallyframe.operators.forecast import select_model
from tallyframe.plans.registered.base import query, table
from tallyframe.plans.registered.forecasting import KEYS, SELECTED_SQL, baseline_scores
from tallyframe.plans.registered.profiling import of_table
from tallyframe.sources import readers, stores
from tallyframe.sources.shared import shared_folder

ORDERS = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM {source}"""
# Files hold times as text, and so they are read.
READ_SQL = f"SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') AS o_orderdate) FROM ({ORDERS.format(source='orders')})"


def some_orders(spark, sf):
    return spark.sql(ORDERS.format(source="{orders}"), orders=table(spark, sf, "orders"))


@query("read_csv_table", READ_SQL)
def read_csv_table(spark, sf):
    path = shared_folder(spark, "orders-csv")
    some_orders(spark, sf).write.option("header", True).csv(path)
    return readers.read_csv_table(spark, path)


NOTED = """SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN concat('first, "', o_orderpriority, '"', {end}, {end}, 'last of ', o_orderkey) ELSE o_orderpriority END AS note"""


@query("read_csv_line_ends", f"{NOTED.format(end='chr(10)')} FROM ({READ_SQL})")
def read_csv_line_ends(spark, sf):
    path = shared_folder(spark, "notes-csv")
    noted = spark.sql(NOTED.format(end="char(10)") + " FROM {orders}", orders=some_orders(spark, sf))
    noted.write.options(header=True, escape='"').csv(path)
    return readers.read_csv_table(spark, path)


@query("read_json_records", READ_SQL)
def read_json_records(spark, sf):
    path = shared_folder(spark, "orders-json")
    some_orders(spark, sf).write.json(path)
    return readers.read_json_records(spark, path, lines=True)


@query("read_json_list", READ_SQL)
def read_json_list(spark, sf):
    path = shared_folder(spark, "orders-lists")
    orders = some_orders(spark, sf).withColumn("list", F.col("o_orderkey") % 8)
    lists = orders.groupBy("list").agg(F.to_json(F.collect_list(F.struct(*orders.columns[:-1]))).alias("text"))
    lists.write.partitionBy("list").text(path)  # a file a list
    return readers.read_json_records(spark, path)


@query(
    "demote_integral",
    "SELECT * REPLACE (CAST(l_quantity AS BIGINT) AS l_quantity) FROM lineitem",
)
def demote_integral(spark, sf):
    return readers.demote_integral(table(spark, sf, "lineitem"))


TEXTED = """SELECT o_orderkey, CAST(o_custkey AS {t}) AS customer_text, ' ' || CAST(o_totalprice AS {t}) AS price_text,
  CASE WHEN o_orderkey % 4 = 0 THEN '  ' ELSE o_orderpriority END AS priority_text FROM {source}"""


@query(
    "coerce_text_columns",
    """SELECT o_orderkey, o_custkey AS customer_text, o_totalprice AS price_text,
              CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS priority_text FROM orders""",
)
def coerce_text_columns(spark, sf):
    text = spark.sql(TEXTED.format(t="STRING", source="{orders}"), orders=table(spark, sf, "orders"))
    return readers.coerce_text_columns(text)


@query(
    "parse_numeric_text",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN round(c_acctbal, 2) WHEN 2 THEN round(c_acctbal, 2)
              WHEN 3 THEN 0.0 ELSE CAST(c_custkey AS DOUBLE) END AS amount FROM customer""",
)
def parse_numeric_text_column(spark, sf):
    stated = F.expr("""CASE c_custkey % 5 WHEN 0 THEN element_at(array('n/a', '-', ' ', 'NULL', 'twelve'), CAST(c_custkey % 5 + 1 AS INT))
        WHEN 1 THEN concat(' $', format_number(c_acctbal, 2)) WHEN 2 THEN concat(format_number(c_acctbal, 2), ' %')
        WHEN 3 THEN '0' ELSE concat('€ ', CAST(c_custkey AS STRING)) END""")
    return table(spark, sf, "customer").select("c_custkey", parse_numeric_text(stated).alias("amount"))


STORED = "SELECT \"column\", row_count, unique_count, semantic_type, is_identifier FROM "


@query("write_profile_store", STORED + of_table("customer") + " UNION ALL " + STORED + of_table("orders"))
def write_profile_store(spark, sf):
    path = shared_folder(spark, "profiles")
    for name in ("customer", "orders", "customer"):
        stores.write_profile_store(table(spark, sf, name), path)
    return stores.read_profile_store(spark, path).select(
        "column", "row_count", "unique_count", "semantic_type", "is_identifier"
    )


@query("stored_metrics")
def stored_metrics(spark, sf):
    path = shared_folder(spark, "profiles")
    stores.write_profile_store(table(spark, sf, "lineitem"), path)
    return stores.stored_metrics(stores.read_profile_store(spark, path))


RUN_SQL = f"""SELECT 'lineitem' AS fingerprint, CAST(l_suppkey AS VARCHAR) AS metric_key, 'month' AS granularity, algorithm, mae, rmse, r2,
  n_folds FROM {SELECTED_SQL}"""


@query(
    "forecast_run_log",
    f"""SELECT *, 1 AS version FROM ({RUN_SQL})
        UNION ALL SELECT *, 2 AS version FROM ({RUN_SQL}) WHERE algorithm <> 'naive_last_value'""",
)
def forecast_run_log(spark, sf):
    path = shared_folder(spark, "runs")
    chosen = select_model(baseline_scores(spark, sf), KEYS)
    runs = chosen.select(
        F.lit("lineitem").alias("fingerprint"), F.col("l_suppkey").cast("string").alias("metric_key"),
        F.lit("month").alias("granularity"), "algorithm", "mae", "rmse", "r2", "n_folds",
    )
    stores.append_runs(runs, path)
    stores.append_runs(runs.where("algorithm <> 'naive_last_value'"), path)
    return stores.read_runs(spark, path)
