"""Insights over monthly supplier series: all their history, and the library's own baseline forecast of it.

The last value is carried on for six months, between bounds that widen with the square root of the step.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.operators import insights as ops
from tallyframe.operators.forecast import prediction_interval
from tallyframe.plans.registered.base import query
from tallyframe.plans.registered.forecasting import KEYS, MONTHLY_SQL, monthly

STEPS = 6
PAST_SQL = MONTHLY_SQL
# The baseline has a closed form: the last value, and bounds from the mean squared step of the history.
AHEAD_SQL = f"""(SELECT l_suppkey, (last + to_months(CAST(h AS INT)))::DATE AS period, predicted_value, greatest(predicted_value - 1.2816 * rmse * sqrt(h), 0) AS lower_bound,
    predicted_value + 1.2816 * rmse * sqrt(h) AS upper_bound
  FROM (SELECT l_suppkey, max(period) AS last, arg_max(value, period) AS predicted_value, sqrt(avg(d * d)) AS rmse FROM (
      SELECT l_suppkey, period, value, value - lag(value) OVER (PARTITION BY l_suppkey ORDER BY period) AS d FROM {MONTHLY_SQL}) GROUP BY 1),
    (SELECT unnest(generate_series(1, {STEPS})) AS h) WHERE rmse IS NOT NULL)"""


def past(spark, sf):
    return monthly(spark, sf)


def ahead(spark, sf):
    steps = monthly(spark, sf).withColumn("_d", F.col("value") - F.lag("value").over(Window.partitionBy(*KEYS).orderBy("period")))
    fitted = steps.groupBy(*KEYS).agg(
        F.max("period").alias("_last"), F.max_by("value", "period").alias("predicted_value"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("_rmse")
    ).where("_rmse IS NOT NULL").withColumn("_h", F.explode(F.sequence(F.lit(1), F.lit(STEPS))))
    low, high = prediction_interval(F.col("predicted_value"), F.col("_rmse"), F.col("_h"), F.lit(True))
    return fitted.select(*KEYS, F.add_months("_last", F.col("_h")).alias("period"), "predicted_value", low.alias("lower_bound"), high.alias("upper_bound"))


RECENT_SQL = f"""(SELECT l_suppkey, CASE WHEN max(w) >= 2 THEN round((avg(value) FILTER (WHERE rk <= w) - avg(value) FILTER (WHERE rk > w AND rk <= 2 * w))
      / nullif(abs(avg(value) FILTER (WHERE rk > w AND rk <= 2 * w)), 0) * 100, 2) + 0 END AS recent_change_pct
  FROM (SELECT *, least(5, n // 2) AS w FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY period DESC) AS rk,
          count(*) OVER (PARTITION BY l_suppkey) AS n FROM {PAST_SQL})) GROUP BY 1)"""
CHANGE_SQL = f"""(SELECT l_suppkey, CASE WHEN count(*) >= 2 THEN round((arg_max(predicted_value, period) - arg_min(predicted_value, period))
      / nullif(abs(arg_min(predicted_value, period)), 0) * 100, 2) + 0 END AS forecast_change_pct FROM {AHEAD_SQL} GROUP BY 1)"""
DIRECTION_SQL = f"""(SELECT l_suppkey, forecast_change_pct, recent_change_pct,
    CASE WHEN c > 3 THEN 'increasing' WHEN c < -3 THEN 'decreasing' WHEN c IS NOT NULL THEN 'stable' ELSE 'mixed' END AS direction
  FROM (SELECT *, coalesce(forecast_change_pct, recent_change_pct) AS c FROM {RECENT_SQL} LEFT JOIN {CHANGE_SQL} USING (l_suppkey)))"""


@query("recent_change", f"SELECT * FROM {RECENT_SQL}")
def recent_change(spark, sf):
    return ops.recent_change(past(spark, sf), KEYS)


@query("series_direction", f"SELECT * FROM {DIRECTION_SQL}")
def series_direction(spark, sf):
    return ops.series_direction(past(spark, sf), ahead(spark, sf), KEYS)


@query(
    "peak_and_low",
    f"""SELECT l_suppkey, (arg_min(period, (-predicted_value, period))) AS peak_period, max(predicted_value) AS peak_value,
          arg_min(period, (predicted_value, period)) AS lowest_period, min(predicted_value) AS lowest_value FROM {AHEAD_SQL} GROUP BY 1""",
)
def peak_and_low(spark, sf):
    return ops.peak_and_low(ahead(spark, sf), KEYS)


@query(
    "volatility",
    f"""SELECT *, CASE WHEN volatility_cv >= 0.5 THEN 'high' WHEN volatility_cv >= 0.2 THEN 'moderate' ELSE 'low' END AS volatility_level
        FROM (SELECT l_suppkey, round(stddev_pop(value) / nullif(abs(avg(value)), 0), 3) AS volatility_cv FROM {PAST_SQL} GROUP BY 1)""",
)
def volatility(spark, sf):
    return ops.volatility(past(spark, sf), KEYS)


LAG_SQL = f"""(SELECT a.l_suppkey, k, max(a.n) AS n, sum(a.c * b.c) / nullif(max(a.d), 0) AS r
  FROM (SELECT unnest(generate_series(2, 12)) AS k) JOIN
    (SELECT *, count(*) OVER w AS n, sum(c * c) OVER w AS d FROM (SELECT l_suppkey, period, value - avg(value) OVER (PARTITION BY l_suppkey) AS c,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY period) AS i FROM {PAST_SQL}) WINDOW w AS (PARTITION BY l_suppkey)) a ON k <= a.n // 2
  JOIN (SELECT l_suppkey, value - avg(value) OVER (PARTITION BY l_suppkey) AS c,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY period) AS i FROM {PAST_SQL}) b ON a.l_suppkey = b.l_suppkey AND b.i = a.i - k
  GROUP BY 1, 2)"""


@query(
    "seasonality",
    f"""SELECT l_suppkey, coalesce(r >= 0.4, false) AS is_seasonal, CASE WHEN r >= 0.4 THEN CAST(k AS DOUBLE) END AS season_periods,
          CASE WHEN n >= 8 THEN round(greatest(r, 0), 3) + 0 END AS season_strength
        FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY r DESC, k) AS rk FROM {LAG_SQL}) WHERE rk = 1""",
)
def seasonality(spark, sf):
    return ops.seasonality(past(spark, sf), KEYS)


@query(
    "anomalies",
    f"""SELECT l_suppkey, period, round(value, 2) AS value, round(z, 2) AS z_score FROM (
          SELECT *, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z, count(*) OVER w AS n FROM {PAST_SQL}
          WINDOW w AS (PARTITION BY l_suppkey)) WHERE n >= 4 AND abs(z) >= 2.5""",
)
def anomalies(spark, sf):
    return ops.anomalies(past(spark, sf), KEYS)


@query(
    "interval_widening",
    f"""SELECT l_suppkey, count(*) >= 2 AND arg_max(upper_bound - lower_bound, period) > arg_min(upper_bound - lower_bound, period) * 1.05 AS interval_widens
        FROM {AHEAD_SQL} GROUP BY 1""",
)
def interval_widening(spark, sf):
    return ops.interval_widening(ahead(spark, sf), KEYS)


@query(
    "history_vs_forecast",
    f"""SELECT l_suppkey, round(p, 2) AS historical_average, round(f, 2) AS forecast_average,
          CASE WHEN f > p THEN 'above' WHEN f < p THEN 'below' ELSE 'in line with' END AS forecast_is
        FROM (SELECT l_suppkey, avg(value) AS p FROM {PAST_SQL} GROUP BY 1)
        JOIN (SELECT l_suppkey, avg(predicted_value) AS f FROM {AHEAD_SQL} GROUP BY 1) USING (l_suppkey)""",
)
def history_vs_forecast(spark, sf):
    return ops.history_vs_forecast(past(spark, sf), ahead(spark, sf), KEYS)


FIELDS = ("total_revenue", "unit_cost", "machine_downtime", "power", "churn_rate", "stock_value", "open_tickets", "score", "temperature")
LEVELS = ("high", "moderate", "low", "unreliable")
FIELD_CASE = "CASE l_suppkey % 9 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FIELDS)) + " END"
LEVEL_CASE = "CASE l_suppkey % 4 " + " ".join(f"WHEN {i} THEN '{q}'" for i, q in enumerate(LEVELS)) + " END"


@query(
    "recommendation_rules",
    f"""WITH f AS (SELECT l_suppkey, {FIELD_CASE} AS field, direction, forecast_change_pct, {LEVEL_CASE} AS quality_level FROM {DIRECTION_SQL}),
          r AS (SELECT *, direction IN ('increasing', 'decreasing') AS moving, direction = 'increasing' AS up,
                quality_level IN ('low', 'unreliable') AS review, field NOT IN ('score', 'temperature') AS known FROM f)
        SELECT l_suppkey, field, direction, forecast_change_pct, quality_level, 'business' AS kind,
          CASE WHEN NOT moving THEN 'no_action_monitoring' WHEN NOT known THEN 'data_collection'
            WHEN field = 'total_revenue' THEN CASE WHEN up THEN 'cash_flow_preparation' ELSE 'budget_review' END
            WHEN field = 'stock_value' THEN 'inventory_planning' WHEN field = 'open_tickets' THEN 'staffing' WHEN NOT up THEN 'no_action'
            WHEN field = 'unit_cost' THEN 'cost_control' WHEN field = 'machine_downtime' THEN 'preventive_maintenance'
            WHEN field = 'power' THEN 'demand_planning' ELSE 'customer_retention' END AS category,
          CASE WHEN NOT moving OR NOT known THEN 'low' WHEN NOT review AND abs(forecast_change_pct) > 10 THEN 'high' ELSE 'medium' END AS priority,
          CASE WHEN moving AND known THEN review ELSE moving END AS needs_review FROM r
        UNION ALL
        SELECT l_suppkey, field, direction, forecast_change_pct, quality_level, 'data quality', 'data_collection',
          CASE WHEN quality_level = 'unreliable' THEN 'high' ELSE 'medium' END, true FROM r WHERE review""",
)
def recommendation_rules(spark, sf):
    findings = ops.series_direction(past(spark, sf), ahead(spark, sf), KEYS).select(
        *KEYS, F.expr(FIELD_CASE).alias("field"), "direction", "forecast_change_pct", F.expr(LEVEL_CASE).alias("quality_level")
    )
    return ops.recommendation_rules(findings)
