"""Totals, groups, shares and correlations over lineitem, orders and customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import aggregates as ops
from tallyframe.operators.metrics import Metric
from tallyframe.plans.registered.base import query, rounded, table

NULLED_SEGMENT = "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END"


def nulled_customers(spark, sf):
    return table(spark, sf, "customer").withColumn("segment", F.expr(NULLED_SEGMENT))


@query("record_count", "SELECT count(*) AS record_count FROM lineitem")
def record_count(spark, sf):
    return ops.record_count(table(spark, sf, "lineitem"))


@query("agg_total", "SELECT round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS mean_discount FROM lineitem")
def agg_total(spark, sf):
    result = ops.aggregate(
        table(spark, sf, "lineitem"), [Metric("l_quantity", name="quantity"), Metric("l_discount", "mean", "mean_discount")]
    )
    return rounded(rounded(result, 2, "quantity"), 6, "mean_discount")


@query("agg_average", "SELECT round(avg(c_acctbal), 4) AS c_acctbal FROM customer")
def agg_average(spark, sf):
    return rounded(ops.aggregate(table(spark, sf, "customer"), ["c_acctbal"], "average"), 4, "c_acctbal")


@query("agg_maximum", "SELECT max(o_totalprice) AS o_totalprice FROM orders")
def agg_maximum(spark, sf):
    return ops.aggregate(table(spark, sf, "orders"), ["o_totalprice"], "maximum")


@query("agg_minimum", "SELECT min(o_totalprice) AS o_totalprice FROM orders")
def agg_minimum(spark, sf):
    return ops.aggregate(table(spark, sf, "orders"), ["o_totalprice"], "minimum")


RECORD_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
  ORDER BY l_extendedprice {direction}, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1"""
RECORD_TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _record(spark, sf, highest):
    lines = table(spark, sf, "lineitem").select(*RECORD_TIES, "l_extendedprice")
    return ops.record_at_extreme(lines, "l_extendedprice", RECORD_TIES, highest)


@query("record_at_max", RECORD_SQL.format(direction="DESC"))
def record_at_max(spark, sf):
    return _record(spark, sf, True)


@query("record_at_min", RECORD_SQL.format(direction="ASC"))
def record_at_min(spark, sf):
    return _record(spark, sf, False)


@query("agg_count", f"SELECT count({NULLED_SEGMENT}) AS segments FROM customer")
def agg_count(spark, sf):
    return ops.aggregate(nulled_customers(spark, sf), [Metric("segment", "count", "segments")])


@query("agg_distinct", "SELECT count(DISTINCT l_partkey) AS distinct_count FROM lineitem")
def agg_distinct(spark, sf):
    return ops.distinct_count(table(spark, sf, "lineitem"), "l_partkey")


@query("unique_entities", "SELECT count(DISTINCT o_custkey) AS distinct_count FROM orders WHERE lower(o_orderpriority) = '2-high'")
def unique_entities(spark, sf):
    return ops.unique_entities(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", "2-High")


def _summary_sql(metric):
    return f"""SELECT '{metric}' AS metric, round(sum({metric}), 2) AS total, round(avg({metric}), 4) AS average,
      max({metric}) AS highest, min({metric}) AS lowest,
      (SELECT o_orderkey FROM orders ORDER BY {metric} DESC, o_orderkey LIMIT 1) AS highest_o_orderkey,
      (SELECT o_orderkey FROM orders ORDER BY {metric} ASC, o_orderkey LIMIT 1) AS lowest_o_orderkey
    FROM orders"""


@query("summarize_metrics", _summary_sql("o_totalprice") + " UNION ALL " + _summary_sql("o_custkey"))
def summarize_metrics(spark, sf):
    result = ops.summarize_metrics(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"], ["o_orderkey"])
    return rounded(rounded(result, 2, "total"), 4, "average")


@query("ratio_of_totals", "SELECT round(sum(l_tax) / nullif(sum(l_discount), 0) * 100, 2) AS tax_to_discount_pct FROM lineitem")
def ratio_of_totals(spark, sf):
    return ops.ratio_of_totals(table(spark, sf, "lineitem"), "l_tax", "l_discount", "tax_to_discount_pct")


@query(
    "group_by_dimension",
    f"""SELECT segment, round(sum(c_acctbal), 2) AS balance FROM (SELECT *, {NULLED_SEGMENT} AS segment FROM customer)
        WHERE segment IS NOT NULL GROUP BY segment HAVING sum(c_acctbal) IS NOT NULL""",
)
def group_by_dimension(spark, sf):
    grouped = ops.group_by_dimension(nulled_customers(spark, sf), Metric("c_acctbal", name="balance"), "segment")
    return rounded(grouped, 2, "balance")


@query(
    "group_by_many",
    f"""SELECT segment, c_nationkey, round(sum(c_acctbal), 2) AS balance, round(avg(c_acctbal), 6) AS mean_balance,
               count(DISTINCT c_custkey) AS customers
        FROM (SELECT *, {NULLED_SEGMENT} AS segment FROM customer) GROUP BY segment, c_nationkey""",
)
def group_by_many(spark, sf):
    grouped = ops.group_by_many(
        nulled_customers(spark, sf),
        [Metric("c_acctbal", name="balance"), Metric("c_acctbal", "mean", "mean_balance"),
         Metric("c_custkey", "nunique", "customers")],
        ["segment", "c_nationkey"],
    )
    return rounded(rounded(grouped, 2, "balance"), 6, "mean_balance")


@query(
    "group_by_dims_and_time",
    """SELECT o_orderpriority, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') || '/' ||
              strftime(CAST(date_trunc('week', o_orderdate) AS DATE) + 6, '%Y-%m-%d') AS week,
              round(sum(o_totalprice), 2) AS revenue, count(o_orderkey) AS orders
       FROM orders GROUP BY 1, 2""",
)
def group_by_dims_and_time(spark, sf):
    grouped = ops.group_by_many(
        table(spark, sf, "orders"),
        [Metric("o_totalprice", name="revenue"), Metric("o_orderkey", "count", "orders")],
        ["o_orderpriority"], date_column="o_orderdate", granularity="week",
    )
    return rounded(grouped, 2, "revenue")


@query("group_distinct_count", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def group_distinct_count(spark, sf):
    return ops.group_by_many(
        table(spark, sf, "lineitem"), [Metric("l_orderkey", name="orders")], ["l_returnflag"], "distinct_count"
    )


SHARE_SQL = """SELECT o_orderpriority, total, round(total / (SELECT sum(o_totalprice) FROM orders) * 100, 1) AS share_pct
  FROM (SELECT o_orderpriority, sum(o_totalprice) AS total FROM orders GROUP BY 1)"""


@query("breakdown_share", f"SELECT o_orderpriority, round(total, 2) AS total, share_pct FROM ({SHARE_SQL})")
def breakdown_share(spark, sf):
    return rounded(ops.breakdown_share(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority"), 2, "total")


@query(
    "breakdown_leaders",
    f"""WITH s AS ({SHARE_SQL}) SELECT
          (SELECT o_orderpriority FROM s ORDER BY total DESC, o_orderpriority LIMIT 1) AS leader,
          (SELECT round(total, 2) FROM s ORDER BY total DESC, o_orderpriority LIMIT 1) AS leader_total,
          (SELECT share_pct FROM s ORDER BY total DESC, o_orderpriority LIMIT 1) AS leader_share_pct,
          (SELECT o_orderpriority FROM s ORDER BY total, o_orderpriority DESC LIMIT 1) AS trailer,
          (SELECT round(total, 2) FROM s ORDER BY total, o_orderpriority DESC LIMIT 1) AS trailer_total""",
)
def breakdown_leaders(spark, sf):
    result = ops.breakdown_leaders(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority")
    return rounded(result, 2, "leader_total", "trailer_total")


@query(
    "leader_of_groups",
    """SELECT c_nationkey, round(avg(c_acctbal), 4) AS c_acctbal FROM customer GROUP BY 1
       ORDER BY avg(c_acctbal) DESC, 1 LIMIT 1""",
)
def leader_of_groups(spark, sf):
    result = ops.leader_of_groups(table(spark, sf, "customer"), "c_acctbal", "c_nationkey", "average")
    return rounded(result, 4, "c_acctbal")


def _r_sql(x, y, source, first, second):
    return f"""SELECT '{first}' AS first_metric, '{second}' AS second_metric, round(r, 4) AS correlation, observations,
      CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.3 THEN 'moderate' WHEN r IS NOT NULL THEN 'weak' END AS strength,
      CASE WHEN r > 0 THEN 'positive' WHEN r < 0 THEN 'negative' WHEN r IS NOT NULL THEN 'neutral' END AS direction
    FROM (SELECT corr({x}, {y}) AS r, count(*) FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL) AS observations
          FROM {source})"""


@query("correlation_rows", _r_sql("l_quantity", "l_extendedprice", "lineitem", "l_quantity", "l_extendedprice"))
def correlation_rows(spark, sf):
    return ops.correlation_rows(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


PER_MONTH = """(SELECT date_trunc('month', o_orderdate), sum(o_totalprice) AS revenue, count(DISTINCT o_custkey) AS customers
  FROM orders GROUP BY 1)"""


@query("correlation_grouped", _r_sql("revenue", "customers", PER_MONTH, "revenue", "customers"))
def correlation_grouped(spark, sf):
    return ops.correlation_grouped(
        table(spark, sf, "orders"), Metric("o_totalprice", name="revenue"), Metric("o_custkey", "nunique", "customers"),
        date_column="o_orderdate", granularity="month",
    )


PER_PART = """(SELECT l_suppkey, sum(l_quantity) AS quantity, sum(l_extendedprice) AS price
  FROM lineitem GROUP BY 1)"""


@query("correlation_strength", _r_sql("quantity", "price", PER_PART, "quantity", "price"))
def correlation_strength(spark, sf):
    return ops.correlation_grouped(
        table(spark, sf, "lineitem"), Metric("l_quantity", name="quantity"), Metric("l_extendedprice", name="price"),
        ["l_suppkey"],
    )


@query(
    "align_metrics_by_group",
    """SELECT l_suppkey, round(sum(CASE WHEN l_tax > 0.03 THEN l_quantity END), 2) AS taxed_quantity,
              round(avg(l_discount), 6) AS mean_discount
       FROM lineitem GROUP BY 1
       HAVING sum(CASE WHEN l_tax > 0.03 THEN l_quantity END) IS NOT NULL AND avg(l_discount) IS NOT NULL""",
)
def align_metrics_by_group(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("taxed_quantity", F.expr("CASE WHEN l_tax > 0.03 THEN l_quantity END"))
    aligned = ops.align_metrics_by_group(
        lines, ["taxed_quantity", Metric("l_discount", "mean", "mean_discount")], ["l_suppkey"]
    )
    return rounded(rounded(aligned, 2, "taxed_quantity"), 6, "mean_discount")
