"""Filters over orders, customer, labels, lineitem and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import filters as ops
from tallyframe.operators.filters import Condition, filter_rows
from tallyframe.plans.registered.base import query, table

ORDER_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
NULLED = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END"
NULLED_SQL = f"""SELECT o_orderkey, {NULLED} AS status FROM orders"""


def nulled_orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.expr(NULLED).alias("status"))


@query("filter_equals", "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'")
def filter_equals(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return filter_rows(customers, [Condition("c_mktsegment", "equals", "Building")])


@query("filter_not_equals", f"SELECT * FROM ({NULLED_SQL}) WHERE status IS NULL OR lower(status) <> 'o'")
def filter_not_equals(spark, sf):
    return filter_rows(nulled_orders(spark, sf), [Condition("status", "not_equals", "O")])


@query("filter_in", "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')")
def filter_in(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return filter_rows(customers, [Condition("c_mktsegment", "in", ["building", "Machinery"])])


@query("filter_not_in", f"SELECT * FROM ({NULLED_SQL}) WHERE status IS NULL OR lower(status) NOT IN ('o', 'p')")
def filter_not_in(spark, sf):
    return filter_rows(nulled_orders(spark, sf), [Condition("status", "not_in", ["O", "p"])])


@query("filter_contains", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def filter_contains(spark, sf):
    return filter_rows(table(spark, sf, "part").select("p_partkey", "p_name"), [Condition("p_name", "contains", "RING")])


def _number_filter(name, operator, symbol, bound):
    sql = f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice {symbol} {bound}"

    @query(name, sql)
    def run(spark, sf):
        orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
        return filter_rows(orders, [Condition("o_totalprice", operator, str(bound))])


_number_filter("filter_greater_than", "greater_than", ">", 250000.5)
_number_filter("filter_greater_than_or_equal", "greater_than_or_equal", ">=", 473274.17)
_number_filter("filter_less_than", "less_than", "<", 20000)
_number_filter("filter_less_than_or_equal", "less_than_or_equal", "<=", 112946.26)


@query("filter_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def filter_between(spark, sf):
    return filter_rows(table(spark, sf, "part").select("p_partkey", "p_size"), [Condition("p_size", "between", [10, 20])])


@query("filter_date_from", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-15 00:00:00'")
def filter_date_from(spark, sf):
    kept = filter_rows(table(spark, sf, "orders"), [Condition("o_orderdate", "date_from", "1998-06-15")])
    return kept.select("o_orderkey", "o_totalprice")


@query(
    "filter_date_to",
    """SELECT event_id, 'whole day' AS bound FROM events WHERE ts < TIMESTAMP '2024-01-11 00:00:00'
       UNION ALL
       SELECT event_id, 'moment' AS bound FROM events WHERE ts <= TIMESTAMP '2024-01-10 12:30:00'""",
)
def filter_date_to(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts")
    day = filter_rows(events, [Condition("ts", "date_to", "2024-01-10")])
    moment = filter_rows(events, [Condition("ts", "date_to", "2024-01-10 12:30")])
    return day.select("event_id", F.lit("whole day").alias("bound")).union(
        moment.select("event_id", F.lit("moment").alias("bound"))
    )


@query(
    "filter_any_of",
    """SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
       WHERE lower(o_orderpriority) = '1-urgent' OR o_totalprice > 400000 OR lower(o_orderstatus) IN ('f')""",
)
def filter_any_of(spark, sf):
    conditions = [
        Condition("o_orderpriority", "equals", "1-URGENT"),
        Condition("o_totalprice", "greater_than", 400000),
        Condition("o_orderstatus", "in", ["F"]),
    ]
    return filter_rows(table(spark, sf, "orders"), conditions, logic="or").select(*ORDER_COLUMNS)


@query(
    "filter_mapping",
    """SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
       WHERE lower(o_orderstatus) = 'o' AND lower(o_orderpriority) IN ('1-urgent', '5-low')
         AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00'""",
)
def filter_mapping(spark, sf):
    request = {
        "o_orderstatus": "o", "o_orderpriority": ["1-URGENT", "5-LOW"],
        "date_from": "1996-01-01", "date_to": "1996-12-31",
    }
    return filter_rows(table(spark, sf, "orders"), request, date_column="o_orderdate").select(*ORDER_COLUMNS)


@query(
    "filter_coercion",
    """SELECT l.doc_id, l.quality, l.toxic = 1 AS is_toxic FROM labels l
       WHERE l.quality = 1 AND NOT (l.toxic = 1) AND l.doc_id IN (0, 1, 2, 4, 8, 16, 32, 64)""",
)
def filter_coercion(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality", (F.col("toxic") == 1).alias("is_toxic"))
    return filter_rows(labels, [
        Condition("quality", "equals", "1.0"), Condition("is_toxic", "equals", "No"),
        Condition("doc_id", "in", ["0", "1", 2, 4.0, "8", "16", "32", "64", "none"]),
    ])


@query(
    "filter_months",
    """SELECT o_orderkey, o_totalprice, CAST(month(o_orderdate) AS BIGINT) AS month_number
       FROM orders WHERE month(o_orderdate) IN (2, 3, 4, 5)""",
)
def filter_months(spark, sf):
    kept = ops.filter_months(table(spark, sf, "orders"), "o_orderdate", ["May", "february"], through=True)
    return kept.select("o_orderkey", "o_totalprice", F.month("o_orderdate").cast("bigint").alias("month_number"))


@query("filter_valid_flag", "SELECT doc_id, toxic FROM labels WHERE quality = 1")
def filter_valid_flag(spark, sf):
    return ops.filter_valid_flag(table(spark, sf, "labels"), "quality").select("doc_id", "toxic")


@query(
    "filter_active_on",
    """SELECT * FROM (
         SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
         FROM lineitem GROUP BY l_orderkey)
       WHERE first_ship <= TIMESTAMP '1998-03-01 00:00:00' AND last_ship >= TIMESTAMP '1998-03-01 00:00:00'""",
)
def filter_active_on(spark, sf):
    spans = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship")
    )
    return ops.filter_active_on(spans, "first_ship", "last_ship", "1998-03-01")


@query("filter_area", "SELECT n_nationkey, n_name FROM nation WHERE lower(trim(n_name)) = 'nation_7'")
def filter_area(spark, sf):
    return ops.filter_area(table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_name", " Nation_7 ")
