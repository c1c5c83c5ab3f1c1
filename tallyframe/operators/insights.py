"""What a series and its forecast show: direction, extremes, volatility, seasonality, anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import fixed_values as fixed


def _by_series(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*(keys or [F.lit(0)]))


def _direction(change: Column) -> Column:
    return (
        F.when(change > fixed.DIRECTION_PERCENT, "increasing").when(change < -fixed.DIRECTION_PERCENT, "decreasing")
        .when(change.isNotNull(), "stable").otherwise("mixed")
    )


def forecast_change(forecasts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Change from the first to the last forecast value, in percent of the first."""
    first, last = F.min_by("predicted_value", "period"), F.max_by("predicted_value", "period")
    change = F.round(F.try_divide(last - first, F.abs(first)) * 100, 2)
    return forecasts.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) >= 2, change).alias("forecast_change_pct"),
        F.round(F.avg("predicted_value"), 2).alias("forecast_average"),
    )


def recent_change(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of the last w periods against the w before them, w = min(5, n // 2) and at least 2."""
    w = _by_series(keys)
    ranked = series.withColumns({
        "_rank": F.row_number().over(w.orderBy(F.col("period").desc())), "_n": F.count(F.lit(1)).over(w),
    }).withColumn("_w", F.least(F.lit(5), F.floor(F.col("_n") / 2)))
    recent = F.avg(F.when(F.col("_rank") <= F.col("_w"), F.col("value")))
    older = F.avg(F.when((F.col("_rank") > F.col("_w")) & (F.col("_rank") <= 2 * F.col("_w")), F.col("value")))
    change = F.round(F.try_divide(recent - older, F.abs(older)) * 100, 2)
    return ranked.groupBy(*keys).agg(F.when(F.max("_w") >= 2, change).alias("recent_change_pct"))


def series_direction(series: DataFrame, forecasts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Direction of the forecast; of the recent history where the forecast gives none."""
    ahead = forecast_change(forecasts, keys).withColumn("_all", F.lit(0))
    behind = recent_change(series, keys).withColumn("_all", F.lit(0))
    joined = behind.join(ahead, [*keys, "_all"], "left")
    change = F.coalesce("forecast_change_pct", "recent_change_pct")
    return joined.select(*keys, "forecast_change_pct", "recent_change_pct", _direction(change).alias("direction"))


def peak_and_low(forecasts: DataFrame, keys: Sequence[str] = (), value: str = "predicted_value") -> DataFrame:
    """Highest and lowest value with their periods; the earliest period wins ties."""
    v, period = F.col(value), F.col("period")
    return forecasts.groupBy(*keys).agg(
        F.min_by(period, F.struct((-v).alias("v"), period)).alias("peak_period"), F.max(v).alias("peak_value"),
        F.min_by(period, F.struct(v.alias("v"), period)).alias("lowest_period"), F.min(v).alias("lowest_value"),
    )


def volatility(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Coefficient of variation and its level."""
    cv = F.round(F.try_divide(F.stddev_pop("value"), F.abs(F.avg("value"))), 3)
    level = (
        F.when(F.col("volatility_cv") >= fixed.HIGH_VOLATILITY, "high")
        .when(F.col("volatility_cv") >= fixed.MODERATE_VOLATILITY, "moderate").otherwise("low")
    )
    return series.groupBy(*keys).agg(cv.alias("volatility_cv")).withColumn("volatility_level", level)


def seasonality(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Strongest autocorrelation at lag 2 to 12; a pattern is detected from 0.4 on, with 8 periods."""
    w = _by_series(keys)
    lags = range(2, fixed.SEASONAL_MAX_LAG + 1)
    centred = series.withColumns({"_c": F.col("value") - F.avg("value").over(w), "_n": F.count(F.lit(1)).over(w)})
    lagged = centred.withColumns({f"_l{k}": F.lag("_c", k).over(w.orderBy("period")) for k in lags})
    sums = lagged.groupBy(*keys).agg(
        F.max("_n").alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("d"),
        *[F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"s{k}") for k in lags],
    )
    usable = F.col("n") >= fixed.SEASONAL_MIN_PERIODS
    # Only positive correlations compete; the shortest lag wins ties.
    entries = F.array(*[
        F.when(usable & (F.lit(k) <= F.floor(F.col("n") / 2)) & (F.try_divide(f"s{k}", "d") > 0),
               F.struct(F.try_divide(f"s{k}", "d").alias("r"), F.lit(-k).alias("k")))
        for k in lags
    ])
    best = sums.withColumn("b", F.array_max(entries))
    defined = usable & (F.col("d") != 0)
    detected = F.coalesce(F.col("b.r") >= fixed.SEASONAL_STRENGTH, F.lit(False))
    return best.select(
        *keys, detected.alias("is_seasonal"), F.when(detected, -F.col("b.k")).cast("double").alias("season_periods"),
        F.when(defined, F.round(F.coalesce(F.col("b.r"), F.lit(0.0)), 3)).alias("season_strength"),
    )


def anomalies(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Periods at least 2.5 population standard deviations from the mean of their series."""
    w = _by_series(keys)
    scored = series.withColumns({
        "_z": F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_pop("value").over(w)),
        "_n": F.count(F.lit(1)).over(w),
    })
    return scored.where((F.col("_n") >= fixed.ANOMALY_MIN_PERIODS) & (F.abs("_z") >= fixed.ANOMALY_Z)).select(
        *keys, "period", F.round("value", 2).alias("value"), F.round("_z", 2).alias("z_score")
    )


def interval_widening(forecasts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Whether the last interval is more than 5 % wider than the first."""
    width = F.col("upper_bound") - F.col("lower_bound")
    bounded = forecasts.where(width.isNotNull())
    first, last = F.min_by(width, "period"), F.max_by(width, "period")
    return bounded.groupBy(*keys).agg(
        ((F.count(F.lit(1)) >= 2) & (last > first * fixed.WIDENING_FACTOR)).alias("interval_widens")
    )


def history_vs_forecast(series: DataFrame, forecasts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Both averages per series and how the forecast compares."""
    past = series.groupBy(*keys).agg(F.avg("value").alias("_past")).withColumn("_all", F.lit(0))
    future = forecasts.groupBy(*keys).agg(F.avg("predicted_value").alias("_future")).withColumn("_all", F.lit(0))
    past_mean, future_mean = F.col("_past"), F.col("_future")
    compared = F.when(future_mean > past_mean, "above").when(future_mean < past_mean, "below").otherwise("in line with")
    return past.join(future, [*keys, "_all"]).select(
        *keys, F.round(past_mean, 2).alias("historical_average"), F.round(future_mean, 2).alias("forecast_average"),
        compared.alias("forecast_is"),
    )


def recommendation_rules(findings: DataFrame) -> DataFrame:
    """Category, priority and review flag for each finding, with an extra row on low quality.

    ``findings``: field, direction, forecast_change_pct and quality_level, and any other columns.
    The rules are a short fixed list, so they become one expression and nothing is joined.
    """
    name = F.lower("field")
    rising, falling = F.col("direction") == "increasing", F.col("direction") == "decreasing"
    category = F.lit(None).cast("string")
    for keywords, up, down in reversed(fixed.RECOMMENDATION_RULES):
        hit = name.rlike("|".join(keywords))
        category = F.when(hit, F.when(rising, up).otherwise(down)).otherwise(category)
    has_context = category.isNotNull() & ~name.rlike("|".join(fixed.NO_CONTEXT_HINTS))
    moving = rising | falling
    review = F.col("quality_level").isin("low", "unreliable")
    urgent = ~review & (F.abs("forecast_change_pct") > fixed.HIGH_PRIORITY_CHANGE_PERCENT)
    main = F.struct(
        F.lit("business").alias("kind"),
        F.when(moving & has_context, category).when(moving, "data_collection").otherwise("no_action_monitoring").alias("category"),
        F.when(moving & has_context, F.when(urgent, "high").otherwise("medium")).otherwise("low").alias("priority"),
        F.when(moving & has_context, review).otherwise(moving).alias("needs_review"),
    )
    quality = F.struct(
        F.lit("data quality").alias("kind"), F.lit("data_collection").alias("category"),
        F.when(F.col("quality_level") == "unreliable", "high").otherwise("medium").alias("priority"),
        F.lit(True).alias("needs_review"),
    )
    return findings.select("*", F.inline(F.when(review, F.array(main, quality)).otherwise(F.array(main))))
