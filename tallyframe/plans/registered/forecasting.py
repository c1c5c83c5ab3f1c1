"""Forecasts of monthly supplier series (lineitem), daily event series and orders by priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import fixed_values as fixed
from tallyframe.operators import forecast as ops
from tallyframe.operators import series as prep
from tallyframe.operators.metrics import Metric
from tallyframe.plans.registered.series import ASSESSED_SQL
from tallyframe.plans.registered.base import query, rounded, table

KEYS = ["l_suppkey"]
MONTHLY_SQL = """(SELECT l_suppkey, CAST(period AS DATE) AS period, coalesce(v, 0.0) AS value FROM (
    SELECT l_suppkey, unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS period FROM
      (SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS m FROM lineitem) GROUP BY 1) s
  LEFT JOIN (SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS period, sum(l_quantity) AS v
             FROM lineitem GROUP BY 1, 2) t USING (l_suppkey, period))"""
# Feature rows in SQL, as far as folds and baselines need them.
ROWS_SQL = f"""(SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY period) - 1 AS i,
    count(*) OVER (PARTITION BY l_suppkey) AS n FROM (
      SELECT l_suppkey, period, value, lag(value) OVER (PARTITION BY l_suppkey ORDER BY period) AS lag_1,
             lag(value, 3) OVER (PARTITION BY l_suppkey ORDER BY period) AS lag_3 FROM {MONTHLY_SQL}) WHERE lag_3 IS NOT NULL)"""
FOLDS_SQL = f"""(SELECT *, i < start AS is_train FROM (
    SELECT *, n - (k - fold + 1) * (n // (k + 1)) AS start, n // (k + 1) AS size FROM (
      SELECT *, unnest(generate_series(1, k)) AS fold FROM (
        SELECT *, CAST(least(5, greatest(2, n // 6), n - 1) AS BIGINT) AS k FROM {ROWS_SQL} WHERE n >= 3)))
  WHERE i < start + size)"""
TESTED_SQL = f"""(SELECT l_suppkey, fold, period, value AS actual, algorithm,
    CASE algorithm WHEN 'naive_last_value' THEN last_train ELSE lag_1 END AS predicted
  FROM (SELECT *, max(CASE WHEN i = start - 1 THEN value END) OVER (PARTITION BY l_suppkey, fold) AS last_train FROM {FOLDS_SQL})
  JOIN (SELECT unnest(['naive_last_value', 'seasonal_naive']) AS algorithm) ON NOT is_train)"""
ERRORS = """avg(abs(predicted - actual)) AS mae, sqrt(avg((predicted - actual) ** 2)) AS rmse,
  CASE WHEN min(actual) <> max(actual) THEN 1 - sum((predicted - actual) ** 2) / (var_pop(actual) * count(*)) END AS r2,
  avg(CASE WHEN abs(actual) + abs(predicted) <> 0 THEN 2 * abs(predicted - actual) / (abs(actual) + abs(predicted)) END) * 100 AS smape"""
SCORES_SQL = f"""(SELECT l_suppkey, algorithm, round(avg(mae), 4) AS mae, round(avg(rmse), 4) AS rmse, round(avg(r2), 4) + 0 AS r2,
    round(avg(smape), 2) AS smape, count(*) AS n_folds
  FROM (SELECT l_suppkey, algorithm, fold, {ERRORS} FROM {TESTED_SQL} GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
SELECTED_SQL = f"""(SELECT l_suppkey, algorithm, mae, rmse, r2, smape, n_folds, baseline_mae,
    round((baseline_mae - mae) / nullif(baseline_mae, 0) * 100, 2) + 0 AS improvement_pct
  FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN algorithm <> 'naive_last_value' AND mae < baseline_mae * 0.97
          THEN 0 WHEN algorithm = 'naive_last_value' THEN 1 ELSE 2 END, mae) AS rk
        FROM (SELECT *, min(CASE WHEN algorithm = 'naive_last_value' THEN mae END) OVER (PARTITION BY l_suppkey) AS baseline_mae
              FROM {SCORES_SQL})) WHERE rk = 1)"""


def monthly(spark, sf):
    return prep.resample(table(spark, sf, "lineitem"), Metric("l_quantity"), "l_shipdate", "month", KEYS)


def monthly_features(spark, sf):
    return prep.make_features(monthly(spark, sf), KEYS)


def baselines(spark, sf):
    return ops.baseline_predictions(ops.time_folds(monthly_features(spark, sf), KEYS), KEYS)


def baseline_scores(spark, sf):
    return ops.cv_scores(baselines(spark, sf), KEYS)


@query("forecast_naive", f"SELECT l_suppkey, max(period) AS last_period, arg_max(value, period) AS predicted FROM {MONTHLY_SQL} GROUP BY 1")
def forecast_naive(spark, sf):
    return ops.forecast_naive(monthly(spark, sf), KEYS)


@query(
    "forecast_lag1",
    f"""SELECT * FROM (SELECT l_suppkey, period, value, lag(value) OVER (PARTITION BY l_suppkey ORDER BY period) AS predicted
        FROM {MONTHLY_SQL}) WHERE predicted IS NOT NULL""",
)
def forecast_lag1(spark, sf):
    return ops.forecast_lag1(monthly(spark, sf), KEYS)


@query("time_folds", f"SELECT l_suppkey, period, CAST(fold AS BIGINT) AS fold, is_train FROM {FOLDS_SQL}")
def time_folds(spark, sf):
    return ops.time_folds(monthly_features(spark, sf), KEYS).select(*KEYS, "period", "fold", "is_train")


@query(
    "error_metrics",
    f"""SELECT algorithm, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(r2, 4) + 0 AS r2, round(smape, 4) AS smape,
          round(wape, 4) AS wape, n FROM (SELECT algorithm, {ERRORS}, sum(abs(predicted - actual)) / nullif(sum(abs(actual)), 0) * 100 AS wape,
          count(*) AS n FROM {TESTED_SQL} GROUP BY 1)""",
)
def error_metrics(spark, sf):
    return rounded(ops.error_metrics(baselines(spark, sf), ["algorithm"]), 4, "mae", "rmse", "r2", "smape", "wape")


@query("cv_scores", f"SELECT * FROM {SCORES_SQL}")
def cv_scores(spark, sf):
    return baseline_scores(spark, sf)


@query("select_model", f"SELECT * FROM {SELECTED_SQL}")
def select_model(spark, sf):
    return ops.select_model(baseline_scores(spark, sf), KEYS)


@query("fit_linear")
def fit_linear(spark, sf):
    return ops.model_predictions(monthly_features(spark, sf), KEYS, [fixed.LINEAR])


# All features in SQL, the folds over them, and ridge by elimination on the moments of each fold's training rows.
EARLIER = "OVER (PARTITION BY l_suppkey ORDER BY period ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
WIDE_SQL = f"""(SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY period) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n,
    [t, lag_1, lag_2, lag_3, rolling_mean_3, rolling_mean_7, rolling_std_3, coalesce((lag_1 - lag_2) / nullif(lag_2, 0), 0) * 100,
     coalesce((lag_2 - lag_3) / nullif(lag_3, 0), 0) * 100, cumulative_trend, month(period), quarter(period), isodow(period) - 1, week(period),
     year(period)]::DOUBLE[] AS x
  FROM (SELECT l_suppkey, period, value, row_number() OVER s - 1 AS t, lag(value) OVER s AS lag_1, lag(value, 2) OVER s AS lag_2, lag(value, 3) OVER s AS lag_3,
          avg(value) {EARLIER.format(n=3)} AS rolling_mean_3, avg(value) {EARLIER.format(n=7)} AS rolling_mean_7,
          coalesce(stddev_samp(value) {EARLIER.format(n=3)}, 0) AS rolling_std_3, avg(value) {EARLIER.format(n='UNBOUNDED')} AS cumulative_trend
        FROM {MONTHLY_SQL} WINDOW s AS (PARTITION BY l_suppkey ORDER BY period)) WHERE lag_3 IS NOT NULL)"""
RIDGE_SQL = f"""WITH RECURSIVE wide AS {WIDE_SQL}, folded AS (
    SELECT *, n - (k - fold + 1) * (n // (k + 1)) AS start, n // (k + 1) AS size FROM (
      SELECT *, unnest(generate_series(1, k)) AS fold FROM (
        SELECT *, CAST(least(5, greatest(2, n // 6), n - 1) AS BIGINT) AS k FROM wide WHERE n >= 3))
), train AS (
    SELECT l_suppkey, fold, list_append(x, value) AS z, value FROM folded WHERE i < start
), places AS (SELECT unnest(generate_series(1, 16)) AS a), means AS (
    SELECT l_suppkey, fold, list(m ORDER BY a) AS m FROM (
      SELECT l_suppkey, fold, a, avg(z[a]) AS m FROM train, places GROUP BY ALL) GROUP BY ALL
), varied AS (
    SELECT l_suppkey, fold FROM train GROUP BY ALL HAVING min(value) <> max(value)
), apart AS (
    SELECT l_suppkey, fold, list_transform(list_zip(z, m), lambda p: p[1] - p[2]) AS z FROM train JOIN means USING (l_suppkey, fold)
), products AS (
    SELECT l_suppkey, fold, list(r ORDER BY a) AS g FROM (
      SELECT l_suppkey, fold, a, list(v ORDER BY b) AS r FROM (
        SELECT l_suppkey, fold, p.a AS a, q.a AS b, sum(z[p.a] * z[q.a]) + CASE WHEN p.a = q.a THEN 1.0 ELSE 0.0 END AS v
        FROM apart, places p, places q WHERE p.a <= 15 GROUP BY l_suppkey, fold, p.a, q.a) GROUP BY ALL) GROUP BY ALL
), solved AS (
    SELECT l_suppkey, fold, 1 AS step, g FROM products
    UNION ALL
    SELECT l_suppkey, fold, step + 1, list_transform(g, lambda r, i: CASE
        WHEN i = step THEN list_transform(r, lambda v: v / g[step][step])
        ELSE list_transform(r, lambda v, j: v - r[step] * g[step][j] / g[step][step]) END)
    FROM solved WHERE step <= 15
)
SELECT l_suppkey, fold, period, value AS actual, 'ridge' AS algorithm, round(m[16] + list_sum(list_transform(g, lambda r, i: r[16] * (x[i] - m[i]))), 3) AS predicted
FROM folded JOIN means USING (l_suppkey, fold) JOIN solved USING (l_suppkey, fold) JOIN varied USING (l_suppkey, fold)
WHERE step = 16 AND i >= start AND i < start + size"""


@query("fit_ridge", RIDGE_SQL)
def fit_ridge(spark, sf):
    return rounded(ops.model_predictions(monthly_features(spark, sf), KEYS, [fixed.RIDGE]), 3, "predicted")


@query("fit_boosted_trees")
def fit_boosted_trees(spark, sf):
    return ops.fit_boosted_trees(monthly_features(spark, sf), KEYS)


@query("validate_models")
def validate_models(spark, sf):
    return ops.validate_models(monthly_features(spark, sf), KEYS)


@query("forecast_recursive")
def forecast_recursive(spark, sf):
    return ops.forecast(
        table(spark, sf, "lineitem"), "l_quantity", "l_shipdate", "month", KEYS, horizon=6, non_negative=True
    )


def planned(spark, sf):
    """Baseline choice per series with horizon 5."""
    features = monthly_features(spark, sf)
    return ops.plan_forecasts(features, ops.select_model(baseline_scores(spark, sf), KEYS), "month", KEYS, 5, True)


def baseline_forecast(spark, sf):
    return ops.forecast_recursive(monthly_features(spark, sf), planned(spark, sf), "month", KEYS)


# Either baseline repeats the last value, so the recursion has a closed form.
FORECAST_SQL = f"""(SELECT l_suppkey, CAST(last_period + to_months(CAST(step AS INT)) AS DATE) AS period, step, algorithm,
    round(v, 4) AS predicted_value, round(greatest(0, v - 1.2816 * rmse * sqrt(step)), 4) AS lower_bound,
    round(v + 1.2816 * rmse * sqrt(step), 4) AS upper_bound
  FROM (SELECT s.*, v, last_period, unnest(generate_series(1, 5)) AS step FROM {SELECTED_SQL} s
        JOIN (SELECT l_suppkey, max(period) AS last_period, arg_max(value, period) AS v FROM {MONTHLY_SQL} GROUP BY 1) USING (l_suppkey)))"""


@query("prediction_interval", f"SELECT * FROM {FORECAST_SQL}")
def prediction_interval(spark, sf):
    return baseline_forecast(spark, sf)


@query(
    "forecast_totals",
    f"""SELECT l_suppkey, round(sum(predicted_value), 2) AS total, round(round(sum(predicted_value), 2) / count(*), 2) AS average
        FROM {FORECAST_SQL} GROUP BY 1""",
)
def forecast_totals(spark, sf):
    return ops.forecast_totals(baseline_forecast(spark, sf), KEYS)


@query(
    "forecast_quality",
    f"""WITH q AS (SELECT l_suppkey, greatest(0, least(1, round(0.5
          + CASE WHEN improvement_pct > 10 THEN 0.2 WHEN improvement_pct > 0 THEN 0.05 WHEN improvement_pct IS NOT NULL THEN -0.15 ELSE -0.1 END
          + CASE WHEN h >= 60 THEN 0.15 WHEN h >= 20 THEN 0.05 ELSE -0.15 END + CASE WHEN 5 > h * 0.5 THEN -0.15 ELSE 0 END
          + CASE WHEN cv >= 0.5 THEN -0.1 WHEN cv < 0.2 THEN 0.05 ELSE 0 END + CASE WHEN missing > 0.2 THEN -0.1 ELSE 0 END
          + CASE WHEN n_folds BETWEEN 1 AND 2 THEN -0.05 ELSE 0 END, 3))) AS score
        FROM {SELECTED_SQL} JOIN (SELECT l_suppkey, count(*) AS h, stddev_pop(value) / abs(avg(value)) AS cv FROM {ROWS_SQL} GROUP BY 1) USING (l_suppkey)
        JOIN (SELECT l_suppkey, avg(CAST(value = 0 AS INT)) AS missing FROM {MONTHLY_SQL} GROUP BY 1) USING (l_suppkey))
        SELECT l_suppkey, CAST(score AS DOUBLE) AS quality_score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.45 THEN 'moderate'
          WHEN score >= 0.25 THEN 'low' ELSE 'unreliable' END AS quality_level, score >= 0.45 AS safe_to_act_on FROM q""",
)
def forecast_quality(spark, sf):
    history = monthly_features(spark, sf).groupBy(*KEYS).agg(
        F.try_divide(F.stddev_pop("value"), F.abs(F.avg("value"))).alias("volatility_cv")
    )
    gaps = monthly(spark, sf).groupBy(*KEYS).agg(F.avg((F.col("value") == 0).cast("double")).alias("missing_ratio"))
    plan = planned(spark, sf).join(history, KEYS).join(gaps, KEYS)
    return ops.forecast_quality(plan).select(*KEYS, "quality_score", "quality_level", "safe_to_act_on")


def _run_sql(where):
    return f"""SELECT o_orderpriority AS metric_key, o_orderstatus AS granularity, 'v1' AS fingerprint, count(*) AS row_count,
      max(o_orderdate) AS newest_ts FROM {{source}} WHERE {where} GROUP BY 1, 2"""


CURRENT = _run_sql("true")
RUNS = f"""SELECT *, 2 AS version, TIMESTAMP '2001-07-20 00:00:00' AS trained_at FROM ({_run_sql("o_orderpriority <> '5-LOW' AND (o_orderpriority <> '1-URGENT' OR o_custkey % 10 <> 1) AND (o_orderpriority <> '2-HIGH' OR o_orderdate < TIMESTAMP '2001-06-01 00:00:00')")})
  UNION ALL SELECT *, 1 AS version, TIMESTAMP '2001-07-20 00:00:00' AS trained_at FROM ({_run_sql("o_custkey % 2 = 0")})"""


@query(
    "retrain_needed",
    f"""WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric_key, granularity ORDER BY version DESC) AS rk
            FROM ({RUNS.format(source="orders")})) WHERE rk = 1),
          j AS (SELECT c.metric_key, c.granularity, CASE WHEN l.version IS NULL THEN 'no existing model'
              WHEN l.newest_ts <> c.newest_ts THEN 'newest timestamp moved' WHEN (c.row_count - l.row_count) / l.row_count > 0.01 THEN 'row count grew'
              WHEN c.row_count - l.row_count > 500 THEN 'new rows added'
              WHEN c.granularity = 'F' THEN 'model too old' ELSE 'up to date' END AS reason
            FROM ({CURRENT.format(source="orders")}) c LEFT JOIN l USING (metric_key, granularity))
        SELECT metric_key, granularity, reason <> 'up to date' AS retrain, reason FROM j""",
)
def retrain_needed(spark, sf):
    orders = table(spark, sf, "orders")
    current = spark.sql(CURRENT.format(source="{orders}"), orders=orders)
    runs = spark.sql(RUNS.format(source="{orders}"), orders=orders).withColumn(
        "trained_at", F.expr("CASE WHEN granularity = 'F' THEN trained_at - INTERVAL 10 DAYS ELSE trained_at END")
    )
    return ops.retrain_needed(current, runs, F.lit("2001-08-01").cast("timestamp"))


@query(
    "champion_challenger",
    f"""SELECT s.l_suppkey, s.r2 AS challenger_r2, n.r2 AS champion_r2, coalesce(s.r2 >= n.r2, n.r2 IS NULL) AS replaces,
          coalesce(n.r2 > 0 AND (n.r2 - s.r2) / abs(n.r2) > 0.15, false) AS r2_dropped
        FROM (SELECT * FROM {SCORES_SQL} WHERE algorithm = 'seasonal_naive') s
        LEFT JOIN (SELECT * FROM {SCORES_SQL} WHERE algorithm = 'naive_last_value' AND l_suppkey % 3 <> 0) n USING (l_suppkey)""",
)
def champion_challenger(spark, sf):
    scores = baseline_scores(spark, sf)
    return ops.champion_challenger(
        scores.where(F.col("algorithm") == fixed.SEASONAL),
        scores.where((F.col("algorithm") == fixed.NAIVE) & (F.col("l_suppkey") % 3 != 0)), KEYS,
    )


BATCH = [Metric("o_totalprice", name="revenue"), Metric("o_custkey", "nunique", "customers"), Metric("o_orderkey", "count", "orders")]


@query("forecast_batch")
def forecast_batch(spark, sf):
    return ops.forecast_batch(table(spark, sf, "orders"), BATCH, "o_orderdate")


@query(
    "forecast_batch_statuses",
    """SELECT metric_key, granularity, CASE WHEN periods >= need AND periods - 3 >= 5 THEN 'updated' ELSE 'skipped' END AS status, periods FROM (
         SELECT 'day' AS granularity, 14 AS need, CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) + 1 AS BIGINT) AS periods FROM orders
         UNION ALL SELECT 'week', 8, date_diff('day', date_trunc('week', min(o_orderdate)), date_trunc('week', max(o_orderdate))) // 7 + 1 FROM orders
         UNION ALL SELECT 'month', 6, date_diff('month', date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate))) + 1 FROM orders)
       CROSS JOIN (SELECT unnest(['revenue', 'customers', 'orders']) AS metric_key)""",
)
def forecast_batch_statuses(spark, sf):
    return ops.forecast_batch(table(spark, sf, "orders"), BATCH, "o_orderdate").select("metric_key", "granularity", "status", "periods")


STATUS_SQL = ASSESSED_SQL.replace("o_orderpriority", "o_custkey")


@query(
    "forecast_statuses",
    f"""WITH sparse_orders AS (SELECT * FROM orders), s AS (
          SELECT *, coalesce(CASE WHEN brief THEN 'span under one day' END, reason, CASE WHEN periods - 3 < 5 THEN 'too few periods to fit a model' END, 'forecast') AS status
          FROM {STATUS_SQL} JOIN (SELECT o_custkey, max(o_orderdate) - min(o_orderdate) < INTERVAL 1 DAY AS brief FROM orders GROUP BY 1) USING (o_custkey)
          WHERE granularity = 'month')
        SELECT o_custkey, granularity, status, periods, CASE WHEN status = 'forecast' THEN CAST(least(6, max_horizon) AS BIGINT) END AS horizon,
          CASE WHEN status = 'forecast' THEN 6 > max_horizon END AS is_capped FROM s""",
)
def forecast_statuses(spark, sf):
    return ops.series_statuses(table(spark, sf, "orders"), "o_totalprice", "o_orderdate", "month", ["o_custkey"], horizon=6)
