"""Series preparation over events (30 days by type), orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import fixed_values as fixed
from tallyframe.operators import series as ops
from tallyframe.operators.metrics import Metric
from tallyframe.plans.registered.base import query, rounded, table

KEY = ["event_type"]
DAILY_SQL = """(SELECT event_type, CAST(period AS DATE) AS period, coalesce(v, 0.0) AS value FROM (
    SELECT event_type, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS period FROM
      (SELECT event_type, CAST(ts AS DATE) AS d FROM events) GROUP BY 1) s
  LEFT JOIN (SELECT event_type, CAST(ts AS DATE) AS period, sum(value) AS v FROM events GROUP BY 1, 2) t USING (event_type, period))"""
OVER = "OVER (PARTITION BY event_type ORDER BY period{frame})"
EARLIER = OVER.format(frame=" ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING")


def daily(spark, sf):
    return ops.resample(table(spark, sf, "events"), "value", "ts", "day", KEY)


# One copy of every row in ten, so that there is something to drop.
COPIED = "SELECT * FROM labels UNION ALL SELECT * FROM labels WHERE doc_id % 10 = 0"


@query("drop_exact_duplicates", f"SELECT DISTINCT * FROM ({COPIED})")
def drop_exact_duplicates(spark, sf):
    labels = table(spark, sf, "labels")
    return ops.drop_exact_duplicates(labels.union(labels.where("doc_id % 10 = 0")))


GAPPED = """SELECT event_id, ts, event_type, CASE WHEN event_id % 5 = 2 OR event_id < 40 THEN NULL ELSE value END AS value
  FROM {source}"""
FILLED_SQL = f"""SELECT event_id, ts, event_type, coalesce(value,
      last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    ) AS value FROM ({GAPPED.format(source='events')})"""


def gapped(spark, sf):
    return spark.sql(GAPPED.format(source="{events}"), events=table(spark, sf, "events"))


@query("forward_back_fill", f"SELECT event_id, value FROM ({FILLED_SQL})")
def forward_back_fill(spark, sf):
    return ops.forward_back_fill(gapped(spark, sf), "ts", ["value"], KEY, ["event_id"]).select("event_id", "value")


DIRTY = """SELECT event_id, CAST(ts AS STRING) AS noted, event_type,
  CASE WHEN event_id % 13 = 0 THEN -value WHEN event_id % 5 = 2 THEN NULL ELSE value END AS value FROM {events}"""


@query(
    "clean_series_input",
    f"""WITH d AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts END AS ts, event_type,
           CASE WHEN event_id % 13 = 0 THEN -value WHEN event_id % 5 = 2 THEN NULL ELSE value END AS value FROM events),
        f AS (SELECT event_type, ts, coalesce(value,
            last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            first_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
          ) AS value FROM d WHERE ts IS NOT NULL)
        SELECT * FROM f WHERE value >= 0""",
)
def clean_series_input(spark, sf):
    dirty = spark.sql(DIRTY, events=table(spark, sf, "events"))
    dirty = dirty.withColumn("noted", F.when(F.col("event_id") % 17 == 0, "not a date").otherwise(F.col("noted")))
    doubled = dirty.union(dirty.where("event_id % 3 = 0"))
    return ops.clean_series_input(doubled, "value", "noted", KEY, non_negative=True, tie_break=["event_id"])


def _resampled_sql(granularity, start, step, aggregate, empty):
    return f"""SELECT o_orderpriority, '{granularity}' AS granularity, CAST(period AS DATE) AS period, {empty} AS value FROM (
        SELECT o_orderpriority, unnest(generate_series(min({start}), max({start}), INTERVAL {step})) AS period FROM orders GROUP BY 1)
      LEFT JOIN (SELECT o_orderpriority, CAST({start} AS TIMESTAMP) AS period, {aggregate} AS v FROM orders GROUP BY 1, 2)
        USING (o_orderpriority, period)"""


STARTS = {
    "day": ("CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)", "1 DAY"),
    "week": ("CAST(date_trunc('week', o_orderdate) + INTERVAL 6 DAY AS TIMESTAMP)", "7 DAY"),
    "month": ("CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)", "1 MONTH"),
}


def _panel_sql(aggregate, empty):
    return " UNION ALL ".join(
        _resampled_sql(g, s, step, aggregate, empty) for g, (s, step) in STARTS.items()
    )


@query("resample", _panel_sql("sum(o_totalprice)", "round(coalesce(v, 0.0), 2)"))
def resample(spark, sf):
    return rounded(ops.resample_many(table(spark, sf, "orders"), "o_totalprice", "o_orderdate", keys=["o_orderpriority"]), 2, "value")


@query("resample_maximum", _panel_sql("max(o_totalprice)", "v"))
def resample_maximum(spark, sf):
    return ops.resample_many(table(spark, sf, "orders"), Metric("o_totalprice", "max"), "o_orderdate", keys=["o_orderpriority"])


@query(
    "lag_features",
    "SELECT event_type, period, " + ", ".join(
        f"round(lag(value, {k}) {OVER.format(frame='')}, 4) AS lag_{k}" for k in (1, 2, 3)) + f" FROM {DAILY_SQL}",
)
def lag_features(spark, sf):
    return rounded(ops.lag_features(daily(spark, sf), KEY), 4, "lag_1", "lag_2", "lag_3").drop("value")


@query(
    "rolling_features",
    f"""SELECT event_type, period, round(avg(value) {EARLIER.format(n=3)}, 4) AS rolling_mean_3,
          round(avg(value) {EARLIER.format(n=7)}, 4) AS rolling_mean_7,
          round(coalesce(stddev_samp(value) {EARLIER.format(n=3)}, 0), 4) AS rolling_std_3 FROM {DAILY_SQL}""",
)
def rolling_features(spark, sf):
    rolled = ops.rolling_features(daily(spark, sf), KEY)
    return rounded(rolled, 4, "rolling_mean_3", "rolling_mean_7", "rolling_std_3").drop("value")


@query(
    "expanding_mean",
    f"SELECT event_type, period, round(avg(value) {EARLIER.format(n='UNBOUNDED')}, 6) AS cumulative_trend FROM {DAILY_SQL}",
)
def expanding_mean(spark, sf):
    return rounded(ops.expanding_mean(daily(spark, sf), KEY), 6, "cumulative_trend").drop("value")


def _growth_sql(new, old):
    return f"round(coalesce(({new} - {old}) / nullif({old}, 0), 0) * 100, 4) + 0"


LAGGED_SQL = f"""(SELECT *, {', '.join(f"lag(value, {k}) {OVER.format(frame='')} AS lag_{k}" for k in (1, 2, 3))} FROM {DAILY_SQL})"""


@query(
    "momentum_features",
    f"""SELECT event_type, period, {_growth_sql('lag_1', 'lag_2')} AS pct_growth, {_growth_sql('lag_2', 'lag_3')} AS prev_growth
        FROM {LAGGED_SQL}""",
)
def momentum_features(spark, sf):
    moving = ops.momentum_features(ops.lag_features(daily(spark, sf), KEY))
    return rounded(moving, 4, "pct_growth", "prev_growth").select(*KEY, "period", "pct_growth", "prev_growth")


CALENDAR = f"""row_number() {OVER.format(frame='')} - 1 AS t, month(period) AS month, quarter(period) AS quarter,
  isodow(period) - 1 AS weekday, weekofyear(period) AS week_of_year, year(period) AS year"""


@query("calendar_features", f"SELECT event_type, period, {CALENDAR} FROM {DAILY_SQL}")
def calendar_features(spark, sf):
    return ops.calendar_features(daily(spark, sf), KEY).drop("value")


FEATURES_SQL = f"""(SELECT event_type, period, value, t, lag_1, lag_2, lag_3, rolling_mean_3, rolling_mean_7, rolling_std_3,
    coalesce((lag_1 - lag_2) / nullif(lag_2, 0), 0) * 100 AS pct_growth,
    coalesce((lag_2 - lag_3) / nullif(lag_3, 0), 0) * 100 AS prev_growth,
    cumulative_trend, month, quarter, weekday, week_of_year, year
  FROM (SELECT *, {CALENDAR}, avg(value) {EARLIER.format(n=3)} AS rolling_mean_3, avg(value) {EARLIER.format(n=7)} AS rolling_mean_7,
          coalesce(stddev_samp(value) {EARLIER.format(n=3)}, 0) AS rolling_std_3,
          avg(value) {EARLIER.format(n='UNBOUNDED')} AS cumulative_trend FROM {LAGGED_SQL})
  WHERE lag_3 IS NOT NULL)"""
REAL_FEATURES = [c for c in fixed.FEATURE_COLUMNS if c not in ("t", "month", "quarter", "weekday", "week_of_year", "year")]


@query(
    "make_features",
    f"""SELECT event_type, period, round(value, 4) AS value, t, month, quarter, weekday, week_of_year, year,
          {', '.join(f'round({c}, 4) + 0 AS {c}' for c in REAL_FEATURES)} FROM {FEATURES_SQL}""",
)
def make_features(spark, sf):
    return rounded(ops.make_features(daily(spark, sf), KEY), 4, "value", *REAL_FEATURES)


ASSESSED_SQL = f"""(SELECT o_orderpriority, granularity, periods, missing_ratio, distinct_values, zero_ratio, reason IS NULL AS supported, reason,
    CASE WHEN reason IS NULL THEN round(0.4 * least(periods / (need * 3), 1) + 0.35 * (1 - missing_ratio)
         + 0.25 * least(distinct_values / greatest(periods * 0.3, 1), 1), 3) ELSE 0.0 END AS score,
    CASE WHEN reason IS NULL THEN greatest(1, least(periods // 2, cap)) ELSE 0 END AS max_horizon
  FROM (SELECT *, CASE WHEN periods < need THEN 'too few periods' WHEN missing_ratio > 0.4 THEN 'too many missing periods'
                       WHEN distinct_values < 3 THEN 'flat series' WHEN zero_ratio > 0.7 THEN 'mostly zero' END AS reason
    FROM (SELECT o_orderpriority, granularity, count(*) AS periods, avg(CAST(value IS NULL AS INT)) AS missing_ratio,
            count(DISTINCT coalesce(value, 0)) AS distinct_values, avg(CAST(coalesce(value, 0) = 0 AS INT)) AS zero_ratio,
            CASE granularity WHEN 'day' THEN 14 WHEN 'week' THEN 8 ELSE 6 END AS need,
            CASE granularity WHEN 'day' THEN 90 WHEN 'week' THEN 26 ELSE 24 END AS cap
          FROM ({_panel_sql("sum(o_totalprice)", "coalesce(v, 0.0)").replace("FROM orders", "FROM sparse_orders")}) GROUP BY 1, 2)))"""
SPARSE = """SELECT o_orderpriority, o_orderdate,
  CASE WHEN o_orderpriority <> '5-LOW' OR day(o_orderdate) = 1 THEN o_totalprice END AS o_totalprice FROM orders"""
SPARSE_SQL = f"WITH sparse_orders AS ({SPARSE})"


def sparse_orders(spark, sf):
    sparse = "CASE WHEN o_orderpriority <> '5-LOW' OR day(o_orderdate) = 1 THEN o_totalprice END"
    return table(spark, sf, "orders").withColumn("o_totalprice", F.expr(sparse))


@query(
    "forecastability",
    f"""{SPARSE_SQL} SELECT o_orderpriority, granularity, periods, round(missing_ratio, 6) AS missing_ratio, distinct_values,
          round(zero_ratio, 6) AS zero_ratio, supported, reason, CAST(score AS DOUBLE) AS score, CAST(max_horizon AS BIGINT) AS max_horizon FROM {ASSESSED_SQL}""",
)
def forecastability(spark, sf):
    assessed = ops.forecastability(sparse_orders(spark, sf), "o_totalprice", "o_orderdate", ["o_orderpriority"])
    return rounded(assessed, 6, "missing_ratio", "zero_ratio")


@query(
    "recommend_granularity",
    f"""{SPARSE_SQL} SELECT o_orderpriority, granularity AS recommended_granularity, CAST(score AS DOUBLE) AS score, CAST(max_horizon AS BIGINT) AS max_horizon FROM (
          SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY score DESC,
            CASE granularity WHEN 'day' THEN 0 WHEN 'week' THEN 1 ELSE 2 END) AS rk FROM {ASSESSED_SQL} WHERE supported) WHERE rk = 1""",
)
def recommend_granularity(spark, sf):
    assessed = ops.forecastability(sparse_orders(spark, sf), "o_totalprice", "o_orderdate", ["o_orderpriority"])
    return ops.recommend_granularity(assessed, ["o_orderpriority"])


@query(
    "max_horizon",
    f"""{SPARSE_SQL} SELECT o_orderpriority, granularity, CAST(least(max_horizon, 30) AS BIGINT) AS horizon,
          max_horizon < 30 AS is_capped FROM {ASSESSED_SQL} WHERE supported""",
)
def max_horizon(spark, sf):
    assessed = ops.forecastability(sparse_orders(spark, sf), "o_totalprice", "o_orderdate", ["o_orderpriority"])
    by_granularity = F.coalesce(*[
        F.when(F.col("granularity") == g, ops.planned_horizon(g, F.col("max_horizon"), 30)) for g in ("day", "week", "month")
    ])
    return assessed.where("supported").select(
        "o_orderpriority", "granularity", by_granularity.alias("horizon"), (F.col("max_horizon") < 30).alias("is_capped"),
    )
