"""Time grouping, trend and growth over orders and events."""

from __future__ import annotations


from tallyframe.functions.periods import as_timestamp, period_label, period_range_label
from tallyframe.operators import timegroups as ops
from tallyframe.operators.metrics import Metric
from tallyframe.plans.registered.base import query, rounded, table

# SQL label of a timestamp, per granularity.
LABEL = {
    "day": "strftime({c}, '%Y-%m-%d')",
    "week": "strftime({c}, '%G-W%V')",
    "month": "strftime({c}, '%Y-%m')",
    "quarter": "year({c}) || 'Q' || quarter({c})",
    "year": "strftime({c}, '%Y')",
}


def label(granularity, column="o_orderdate"):
    return LABEL[granularity].format(c=column)


@query(
    "period_label",
    "SELECT o_orderkey, " + ", ".join(f"{label(g)} AS {g}_label" for g in LABEL) + " FROM orders",
)
def period_labels(spark, sf):
    orders = table(spark, sf, "orders")
    stamp = as_timestamp(orders, "o_orderdate")
    return orders.select("o_orderkey", *[period_label(stamp, g).alias(f"{g}_label") for g in LABEL])


@query(
    "period_range_label",
    """SELECT o_orderkey, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') || '/' ||
              strftime(CAST(date_trunc('week', o_orderdate) AS DATE) + 6, '%Y-%m-%d') AS week FROM orders""",
)
def period_range_labels(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select("o_orderkey", period_range_label(as_timestamp(orders, "o_orderdate"), "week").alias("week"))


@query(
    "metric_over_time",
    f"SELECT {label('week', 'ts')} AS period, round(avg(value), 4) AS value FROM events GROUP BY 1",
)
def metric_over_time(spark, sf):
    return rounded(ops.metric_over_time(table(spark, sf, "events"), Metric("value", "mean"), "ts", "week"), 4, "value")


MONTHLY = f"SELECT {label('month')} AS period, sum(o_totalprice) AS v FROM orders GROUP BY 1"


@query(
    "trend_change",
    f"""WITH s AS ({MONTHLY}), e AS (SELECT count(*) AS periods, min(period) AS first_period, max(period) AS last_period,
          arg_min(v, period) AS a, arg_max(v, period) AS b FROM s)
        SELECT periods, first_period, last_period, round(a, 2) AS first_value, round(b, 2) AS last_value,
          round((b - a) / abs(a) * 100, 1) + 0 AS change_pct,
          CASE WHEN b > a THEN 'increased' WHEN b < a THEN 'decreased' ELSE 'stayed flat' END AS direction FROM e""",
)
def trend_change(spark, sf):
    result = ops.trend_change(table(spark, sf, "orders"), "o_totalprice", "o_orderdate", "month")
    return rounded(result, 2, "first_value", "last_value")


@query(
    "compare_metrics",
    f"""SELECT {label('quarter')} AS period, round(sum(o_totalprice), 2) AS revenue, count(DISTINCT o_custkey) AS customers
        FROM orders GROUP BY 1""",
)
def compare_metrics(spark, sf):
    result = ops.compare_metrics(
        table(spark, sf, "orders"),
        [Metric("o_totalprice", name="revenue"), Metric("o_custkey", "nunique", "customers")], "o_orderdate", "quarter",
    )
    return rounded(result, 2, "revenue")


@query(
    "align_series_by_period",
    f"""SELECT period, round(ordered, 2) AS ordered, round(shipped, 2) AS shipped FROM
          (SELECT {label('day')} AS period, sum(o_totalprice) AS ordered FROM orders GROUP BY 1)
          FULL OUTER JOIN
          (SELECT {label('day', 'l_shipdate')} AS period, sum(l_extendedprice) AS shipped FROM lineitem GROUP BY 1)
          USING (period)""",
)
def align_series_by_period(spark, sf):
    ordered = ops.metric_over_time(table(spark, sf, "orders"), Metric("o_totalprice", name="ordered"), "o_orderdate", "day")
    shipped = ops.metric_over_time(table(spark, sf, "lineitem"), Metric("l_extendedprice", name="shipped"), "l_shipdate", "day")
    return rounded(ops.align_series_by_period(ordered, shipped), 2, "ordered", "shipped")


def growth_sql(granularity, dimension=None):
    part, keys = (f"PARTITION BY {dimension} ", f"{dimension}, ") if dimension else ("", "")
    start = f"date_trunc('{granularity}', o_orderdate)"
    return f"""SELECT {keys}{label(granularity, 's')} AS period, round(total, 2) AS total,
        round((total - previous) / nullif(previous, 0) * 100, 2) + 0 AS growth_pct
      FROM (SELECT *, lag(total) OVER ({part}ORDER BY s) AS previous FROM (
        SELECT {keys}CAST({start} AS TIMESTAMP) AS s, sum(o_totalprice) AS total FROM orders GROUP BY ALL))
      WHERE previous IS NOT NULL"""


def _growth(name, granularity):
    @query(name, growth_sql(granularity))
    def run(spark, sf):
        return rounded(ops.growth(table(spark, sf, "orders"), "o_totalprice", "o_orderdate", granularity), 2, "total")


for _granularity in LABEL:
    _growth(f"growth_{_granularity}", _granularity)


@query("growth_by_key", growth_sql("month", "o_orderpriority"))
def growth_by_key(spark, sf):
    orders = table(spark, sf, "orders")
    return rounded(ops.growth(orders, "o_totalprice", "o_orderdate", "month", ["o_orderpriority"]), 2, "total")


@query(
    "growth_records",
    """SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS period, o_totalprice AS total,
              round((o_totalprice - previous) / nullif(previous, 0) * 100, 2) + 0 AS growth_pct
       FROM (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS previous
             FROM orders) WHERE previous IS NOT NULL""",
)
def growth_records(spark, sf):
    return ops.growth_records(table(spark, sf, "orders"), "o_totalprice", "o_orderdate", ["o_custkey"], ["o_orderkey"])


@query(
    "growth_summary",
    f"""WITH g AS ({growth_sql('month')})
        SELECT round(avg(growth_pct), 2) AS average_growth_pct,
          (SELECT period FROM g ORDER BY growth_pct DESC, period LIMIT 1) AS best_period, max(growth_pct) AS best_growth_pct,
          (SELECT period FROM g ORDER BY growth_pct, period LIMIT 1) AS worst_period, min(growth_pct) AS worst_growth_pct FROM g""",
)
def growth_summary(spark, sf):
    return ops.growth_summary(ops.growth(table(spark, sf, "orders"), "o_totalprice", "o_orderdate", "month"))


@query(
    "quarter_measures_growth",
    f"""SELECT {label('quarter', 's')} AS quarter, round(p, 2) AS l_extendedprice, round(q, 2) AS l_quantity, round(d, 2) AS l_discount,
          round((p - lag(p) OVER (ORDER BY s)) / nullif(lag(p) OVER (ORDER BY s), 0) * 100, 2) + 0 AS quarterly_growth_pct
        FROM (SELECT date_trunc('quarter', l_shipdate) AS s, sum(l_extendedprice) AS p, sum(l_quantity) AS q, sum(l_discount) AS d
              FROM lineitem GROUP BY 1)""",
)
def quarter_measures_growth(spark, sf):
    measures = ["l_extendedprice", "l_quantity", "l_discount"]
    return rounded(ops.quarter_measures_growth(table(spark, sf, "lineitem"), measures, "l_shipdate"), 2, *measures)


@query(
    "rollup_monthly",
    """SELECT CAST(year(s) AS BIGINT) AS year, lower(strftime(s, '%B')) AS month, 'Q' || quarter(s) AS quarter,
              round(revenue, 2) AS revenue, round(units_sold, 2) AS units_sold, lines
       FROM (SELECT date_trunc('month', l_shipdate) AS s, sum(l_extendedprice) AS revenue, sum(l_quantity) AS units_sold,
                    count(l_orderkey) AS lines FROM lineitem GROUP BY 1)""",
)
def rollup_monthly(spark, sf):
    result = ops.rollup_monthly(
        table(spark, sf, "lineitem"), "l_shipdate",
        {"revenue": "l_extendedprice", "units_sold": "l_quantity"}, {"lines": "l_orderkey"},
    )
    return rounded(result, 2, "revenue", "units_sold")
