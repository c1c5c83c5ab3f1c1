"""Rankings over lineitem, orders and events."""

from __future__ import annotations


from tallyframe.operators import ranking as ops
from tallyframe.operators.filters import Condition, filter_rows
from tallyframe.operators.metrics import Metric
from tallyframe.operators.timegroups import metric_over_time
from tallyframe.plans.registered.base import query, rounded, table


@query("top_n", "SELECT o_custkey, round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 10")
def top_n(spark, sf):
    return rounded(ops.top_n(table(spark, sf, "orders"), Metric("o_totalprice", name="spend"), "o_custkey", 10), 2, "spend")


@query("bottom_n", "SELECT l_partkey, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1 ORDER BY sum(l_quantity), 1 LIMIT 5")
def bottom_n(spark, sf):
    return rounded(ops.bottom_n(table(spark, sf, "lineitem"), Metric("l_quantity", name="quantity"), "l_partkey"), 2, "quantity")


@query(
    "top_n_filtered",
    """SELECT l_suppkey, round(sum(l_extendedprice), 2) AS price FROM lineitem
       WHERE lower(l_returnflag) = 'r' AND l_quantity > 25 GROUP BY 1 ORDER BY sum(l_extendedprice) DESC, 1 LIMIT 5""",
)
def top_n_filtered(spark, sf):
    kept = filter_rows(table(spark, sf, "lineitem"), [
        Condition("l_returnflag", "equals", "r"), Condition("l_quantity", "greater_than", 25),
    ])
    return rounded(ops.top_n(kept, Metric("l_extendedprice", name="price"), "l_suppkey"), 2, "price")


@query(
    "top_n_distinct",
    "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
)
def top_n_distinct(spark, sf):
    return ops.top_n(table(spark, sf, "events"), Metric("user_id", "nunique", "users"), "event_type", 3)


def nested_sql(direction, outer_n, inner_n):
    return f"""WITH o AS (
        SELECT l_suppkey, outer_value, row_number() OVER (ORDER BY outer_value {direction}, l_suppkey) AS outer_rank
        FROM (SELECT l_suppkey, sum(l_extendedprice) AS outer_value FROM lineitem GROUP BY 1)),
      i AS (
        SELECT l_suppkey, l_partkey, inner_value,
               row_number() OVER (PARTITION BY l_suppkey ORDER BY inner_value {direction}, l_partkey) AS inner_rank
        FROM (SELECT l_suppkey, l_partkey, sum(l_extendedprice) AS inner_value FROM lineitem GROUP BY 1, 2))
      SELECT outer_rank, l_suppkey, round(outer_value, 2) AS outer_value, inner_rank, l_partkey,
             round(inner_value, 2) AS inner_value
      FROM o JOIN i USING (l_suppkey) WHERE outer_rank <= {outer_n} AND inner_rank <= {inner_n}"""


def nested(spark, sf, descending, outer_n, inner_n):
    result = ops.nested_ranking(
        table(spark, sf, "lineitem"), "l_extendedprice", [("l_suppkey", outer_n), ("l_partkey", inner_n)], descending
    )
    return rounded(result, 2, "outer_value", "inner_value")


@query("nested_top_n", nested_sql("DESC", 5, 3))
def nested_top_n(spark, sf):
    return nested(spark, sf, True, 5, 3)


@query("nested_bottom_n", nested_sql("ASC", 4, 2))
def nested_bottom_n(spark, sf):
    return nested(spark, sf, False, 4, 2)


@query(
    "nested_rank_restrict",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice FROM lineitem WHERE l_suppkey IN (
         SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY sum(l_extendedprice) DESC, 1 LIMIT 3)""",
)
def nested_rank_restrict(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    chosen = ops.top_n(lines, "l_extendedprice", "l_suppkey", 3).select("l_suppkey")
    return ops.restrict_to(lines, chosen, "l_suppkey")


@query(
    "top_n_per_group",
    """SELECT l_returnflag, rank, l_partkey, round(q, 2) AS quantity FROM (
         SELECT l_returnflag, l_partkey, q, row_number() OVER (PARTITION BY l_returnflag ORDER BY q DESC, l_partkey) AS rank
         FROM (SELECT l_returnflag, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)) WHERE rank <= 4""",
)
def top_n_per_group(spark, sf):
    result = ops.top_n_per_group(
        table(spark, sf, "lineitem"), Metric("l_quantity", name="quantity"), "l_returnflag", "l_partkey", 4
    )
    return rounded(result, 2, "quantity")


@query(
    "recent_history",
    """SELECT o_orderpriority, period, round(v, 2) AS revenue FROM (
         SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY period DESC) AS rk FROM (
           SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS period, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2))
       WHERE rk <= 12""",
)
def recent_history(spark, sf):
    series = metric_over_time(
        table(spark, sf, "orders"), Metric("o_totalprice", name="revenue"), "o_orderdate", "month", keys=["o_orderpriority"]
    )
    return rounded(ops.recent_history(series, "month", ["o_orderpriority"]), 2, "revenue")
