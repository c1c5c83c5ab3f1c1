"""From raw rows to clean, gap-free series and their features.

Raw rows are aggregated per series and period with partial results first. Every window below runs
over calendar units of one series, and the calendar bounds their number (see LONGEST_GAP_DAYS),
so no task ever holds an unbounded series.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import fixed_values as fixed
from tallyframe.functions.numeric import as_number, column, column_type, is_numeric, present
from tallyframe.functions.periods import as_timestamp, resample_start
from tallyframe.operators.metrics import Metric, as_metric, metric_aggregate

ZERO_WHEN_EMPTY = ("sum", "count", "nunique")


# Gaps up to this are filled with empty periods, some six centuries. A stray far date, such as the
# 9999-12-31 of an open end, stays in the series without millions of days before it.
LONGEST_GAP_DAYS = 213_503


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def forward_back_fill(
    df: DataFrame, date_column: str, columns: Sequence[str], keys: Sequence[str], tie_break: Sequence[str],
    guard: Column | None = None,
) -> DataFrame:
    """Numeric nulls take the last earlier value of their series in time order, else the next later.

    Rows of one timestamp count as: those with a value by tie-break, then those without. The carry
    runs over timestamps within a second, seconds within a day and days, so each window is bounded
    even where one series, or one moment, holds a large part of the rows. Rows without a usable
    date stay as they are.

    The rows are read three times. Where they come out of an aggregation, a ``guard`` that is true
    and depends on its result keeps the filters above it, so that its shuffle is made only once.
    """
    if not tie_break:
        raise ValueError("tie_break columns are required: rows of one timestamp have no order of their own")
    stamp = as_timestamp(df, date_column)
    series = [*keys, "_all"]
    rows = df.withColumns({
        "_all": F.lit(0), "_ts": stamp, **{c: as_number(df, c) for c in columns},
    })
    needs = F.col("_ts").isNotNull() & reduce(or_, [F.col(c).isNull() for c in columns])
    order = [F.col(c) for c in tie_break]

    def entry(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(c).alias("v")))

    kept = guard if guard is not None else F.lit(True)
    dated = rows.where(F.when(kept, F.col("_ts").isNotNull()))
    moments = dated.groupBy(*series, "_ts").agg(
        *[F.max(entry(c))["v"].alias(f"_last_{c}") for c in columns],
        *[F.min(entry(c))["v"].alias(f"_first_{c}") for c in columns],
    ).withColumns({"_second": F.date_trunc("second", "_ts"), "_day": F.to_date("_ts")})

    def latest(c: str, by: str) -> Column:
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(by)))

    def carry(frame: DataFrame, within: list[str], by: str, last: int, names: dict[str, str]) -> DataFrame:
        window = Window.partitionBy(*series, *within).orderBy(by).rowsBetween(Window.unboundedPreceding, last)
        return frame.withColumns({new: F.last(old, ignorenulls=True).over(window) for old, new in names.items()})

    lasts = [f"_last_{c}" for c in columns]
    seconds = moments.groupBy(*series, "_day", "_second").agg(*[latest(c, "_ts").alias(c) for c in lasts])
    days = seconds.groupBy(*series, "_day").agg(*[latest(c, "_second").alias(c) for c in lasts])
    in_second = carry(moments, ["_second"], "_ts", 0, {c: f"{c}_0" for c in lasts})
    in_day = carry(seconds, ["_day"], "_second", -1, {c: f"{c}_1" for c in lasts}).drop("_day", *lasts)
    over_days = carry(days, [], "_day", -1, {c: f"{c}_2" for c in lasts}).drop(*lasts)
    starts = moments.groupBy(*series).agg(
        *[F.min_by(f"_first_{c}", F.when(F.col(f"_first_{c}").isNotNull(), F.col("_ts"))).alias(f"_start_{c}") for c in columns]
    )
    filled = (
        in_second.join(in_day, [*series, "_second"], "left").join(over_days, [*series, "_day"], "left")
        .select(*series, "_ts", *[F.coalesce(f"_last_{c}_0", f"_last_{c}_1", f"_last_{c}_2").alias(f"_fill_{c}") for c in columns])
    )
    # Only rows that miss a value travel to the filled moments.
    missing = rows.where(F.when(kept, needs)).join(filled, [*series, "_ts"], "left").join(starts, series, "left")
    completed = missing.withColumns({c: F.coalesce(c, f"_fill_{c}", f"_start_{c}") for c in columns})
    return rows.where(F.when(kept, ~needs)).select(*df.columns).union(completed.select(*df.columns))


def clean_series_input(
    df: DataFrame,
    metric: Metric | str,
    date_column: str,
    keys: Sequence[str] = (),
    non_negative: bool = False,
    tie_break: Sequence[str] | None = None,
) -> DataFrame:
    """Rows fit for a series: (keys, ts, value), duplicates gone, gaps filled, bad values dropped.

    Filling happens before impossible values are dropped, so a gap takes the last stated value.
    Values to be counted keep their type; text in them is left alone.
    """
    metric = as_metric(metric)
    counted = metric.aggregation in ("count", "nunique")
    value_type = column_type(df, metric.field)
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    if is_numeric(value_type):
        order = list(tie_break or [c for c in df.columns if c not in (metric.field, date_column, *keys)] or [metric.field])
        rows = forward_back_fill(rows, date_column, [metric.field], keys, order, guard=F.col("_copies") > 0)
    value = present(rows, metric.field) if counted else as_number(rows, metric.field)
    cleaned = rows.select(*keys, as_timestamp(rows, date_column).alias("ts"), value.alias("value"))
    if non_negative and not counted:
        cleaned = cleaned.where(F.col("value") >= 0)
    return cleaned.dropna(subset=["ts", "value"])


def _day_states(df: DataFrame, metrics: dict[str, Metric], date_column: str, keys: Sequence[str]) -> list[tuple[DataFrame, dict[str, Column]]]:
    """Raw rows reduced to one row a series and day, and for each metric how days merge into longer periods.

    Sums, counts and extremes merge as they are, means as sum and count. Distinct values have no such
    state: they keep a row a series, day and value. Every frame has the first and last moment of its rows.
    """
    rows = df.withColumn("_ts", as_timestamp(df, date_column)).where(F.col("_ts").isNotNull()).withColumn("_day", F.to_date("_ts"))
    ends = F.min("_ts").alias("_first"), F.max("_ts").alias("_last")
    frames: list[tuple[DataFrame, dict[str, Column]]] = []
    states, merged = [], {}
    for alias, metric in metrics.items():
        one = Metric(metric.field, metric.aggregation, f"{alias}_s")
        if metric.aggregation == "nunique":
            value = present(rows, metric.field).alias("_value")
            values = rows.select(*[column(k) for k in keys], "_day", "_ts", value).groupBy(*keys, "_day", "_value").agg(*ends)
            frames.append((values, {alias: F.count_distinct("_value")}))
        elif metric.aggregation == "mean":
            states += [F.sum(as_number(rows, metric.field)).alias(f"{alias}_s"), F.count(as_number(rows, metric.field)).alias(f"{alias}_n")]
            merged[alias] = F.try_divide(F.sum(f"{alias}_s"), F.sum(f"{alias}_n"))
        else:
            states.append(metric_aggregate(rows, one))
            merged[alias] = {"min": F.min, "max": F.max}.get(metric.aggregation, F.sum)(f"{alias}_s")
    if states:
        frames.append((rows.groupBy(*keys, "_day").agg(*states, *ends), merged))
    return frames


def series_panel(
    df: DataFrame, metrics: Sequence[Metric | str], date_column: str, granularities: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """The series of `resample_metrics`, and _first and _last, the first and last moment of a period's rows."""
    unknown = [g for g in granularities if g not in fixed.GRANULARITIES]
    if unknown:
        raise ValueError(f"series granularities are {fixed.GRANULARITIES}, not {unknown}")
    # Metric results are named apart from the keys, which may share their names.
    named = {f"_m{i}": as_metric(m) for i, m in enumerate(metrics)}
    day = F.col("_day").cast("timestamp_ntz")
    periods = F.array(*[F.struct(F.lit(g).alias("granularity"), resample_start(day, g).alias("period")) for g in granularities])
    ids = [*keys, "granularity", "period", "_first", "_last"]
    parts = []
    for states, merged in _day_states(df, named, date_column, keys):
        spread = states.select("*", F.inline(periods)).groupBy(*keys, "granularity", "period")
        totals = spread.agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"), *[c.cast("double").alias(a) for a, c in merged.items()])
        parts.append(totals.unpivot(ids, list(merged), "_alias", "value"))
    long = reduce(DataFrame.unionByName, parts)
    # The gap up to the next period with data is laid out from the earlier side; no join needed.
    following = F.lead("period").over(Window.partitionBy(*keys, "granularity", "_alias").orderBy("period"))
    days = F.sequence(F.col("period"), F.date_sub("_next", 1), F.expr("interval 1 day"))
    weeks = F.sequence(F.col("period"), F.date_sub("_next", 7), F.expr("interval 7 days"))
    months = F.sequence(F.col("period"), F.add_months("_next", -1), F.expr("interval 1 month"))
    spine = (
        F.when(F.col("_next").isNull() | (F.datediff("_next", "period") > LONGEST_GAP_DAYS), F.array("period"))
        .when(F.col("granularity") == "day", days).when(F.col("granularity") == "week", weeks).otherwise(months)
    )
    filled = long.withColumn("_next", following).select(
        *keys, "_alias", "granularity", "value", "_first", "_last", F.posexplode(spine).alias("_gap", "period")
    )
    zero = [alias for alias, m in named.items() if m.aggregation in ZERO_WHEN_EMPTY]
    stated = F.when(F.col("_gap") == 0, F.col("value"))
    value = F.when(F.col("_alias").isin(*zero), F.coalesce(stated, F.lit(0.0))).otherwise(stated) if zero else stated
    key = F.create_map(*[F.lit(x) for alias, m in named.items() for x in (alias, m.alias)])[F.col("_alias")]
    return filled.select(*keys, key.alias("metric_key"), "granularity", "period", value.alias("value"), "_first", "_last")


def resample_metrics(
    df: DataFrame,
    metrics: Sequence[Metric | str],
    date_column: str,
    granularities: Sequence[str] = fixed.GRANULARITIES,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Gap-free (keys, metric_key, granularity, period, value) series of all metrics.

    Raw rows are reduced to days first, once for all metrics and granularities (distinct counts each read
    them once more); weeks and months come from the days. An empty period is 0 for sums and counts, null
    for means and extremes.
    """
    return series_panel(df, metrics, date_column, granularities, keys).drop("_first", "_last")


def resample_many(
    df: DataFrame, metric: Metric | str, date_column: str,
    granularities: Sequence[str] = fixed.GRANULARITIES, keys: Sequence[str] = (),
) -> DataFrame:
    """Gap-free (keys, granularity, period, value) series of one metric at several granularities."""
    return resample_metrics(df, [metric], date_column, granularities, keys).drop("metric_key")


def resample(
    df: DataFrame, metric: Metric | str, date_column: str, granularity: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Gap-free (keys, period, value) series; weeks carry their closing Sunday, months their first day."""
    return resample_many(df, metric, date_column, [granularity], keys).drop("granularity")


def series_window(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy("period")


def lag_features(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    w = series_window(keys)
    return series.withColumns({f"lag_{k}": F.lag("value", k).over(w) for k in (1, 2, 3)})


def rolling_features(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Moving statistics of strictly earlier periods."""
    w = series_window(keys)
    return series.withColumns({
        "rolling_mean_3": F.avg("value").over(w.rowsBetween(-3, -1)),
        "rolling_mean_7": F.avg("value").over(w.rowsBetween(-7, -1)),
        "rolling_std_3": F.coalesce(F.stddev_samp("value").over(w.rowsBetween(-3, -1)), F.lit(0.0)),
    })


def expanding_mean(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    w = series_window(keys).rowsBetween(Window.unboundedPreceding, -1)
    return series.withColumn("cumulative_trend", F.avg("value").over(w))


def momentum_features(lagged: DataFrame) -> DataFrame:
    """Growth of each lag against the one before, in percent; 0 where undefined."""

    def growth(new: str, old: str) -> Column:
        return F.coalesce(F.try_divide(F.col(new) - F.col(old), F.col(old)), F.lit(0.0)) * 100

    return lagged.withColumns({"pct_growth": growth("lag_1", "lag_2"), "prev_growth": growth("lag_2", "lag_3")})


def calendar_features(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return series.withColumns({
        "t": (F.row_number().over(series_window(keys)) - 1).cast("bigint"),
        "month": F.month("period").cast("bigint"), "quarter": F.quarter("period").cast("bigint"),
        "weekday": F.weekday("period").cast("bigint"), "week_of_year": F.weekofyear("period").cast("bigint"),
        "year": F.year("period").cast("bigint"),
    })


def make_features(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Value with its 15 features; periods without a value or without three lags are left out."""
    features = momentum_features(
        expanding_mean(rolling_features(lag_features(calendar_features(series, keys), keys), keys), keys)
    )
    return features.dropna(subset=["value", "lag_1", "lag_2", "lag_3"]).select(
        *keys, "period", "value", *fixed.FEATURE_COLUMNS
    )


def _by_granularity(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("granularity")]


def max_horizon(periods: Column) -> Column:
    """Half the observed periods, at least one, at most the cap of the granularity."""
    half = F.floor(periods / 2).cast("bigint")
    return F.greatest(F.lit(1), F.least(half, _by_granularity(fixed.MAX_HORIZON))).cast("bigint")


def planned_horizon(granularity: str, limit: Column, requested: int | None = None) -> Column:
    """Requested or default number of periods, never more than the limit."""
    return F.least(F.lit(requested or fixed.DEFAULT_HORIZON[granularity]), limit).cast("bigint")


def forecastability(
    df: DataFrame, metric: Metric | str, date_column: str, keys: Sequence[str] = (),
    granularities: Sequence[str] = fixed.GRANULARITIES,
) -> DataFrame:
    """Per series and granularity: whether it can be forecast, why not, its score and horizon cap."""
    return panel_forecastability(series_panel(df, [metric], date_column, granularities, keys), keys)


def panel_forecastability(panel: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The same from the rows of `series_panel` for one metric."""
    filled = F.coalesce("value", F.lit(0.0))
    micros = F.unix_micros(F.max("_last").cast("timestamp")) - F.unix_micros(F.min("_first").cast("timestamp"))
    stats = panel.groupBy(*keys, "granularity").agg(
        (micros / 86_400_000_000).alias("span_days"),
        F.count(F.lit(1)).alias("periods"), F.avg(F.col("value").isNull().cast("double")).alias("missing_ratio"),
        F.count_distinct(filled).alias("distinct_values"), F.avg((filled == 0).cast("double")).alias("zero_ratio"),
    )
    needed = _by_granularity(fixed.MIN_PERIODS)
    reason = (
        F.when(F.col("span_days") < 1, "span under one day")
        .when(F.col("periods") < needed, "too few periods")
        .when(F.col("missing_ratio") > fixed.MAX_MISSING_RATIO, "too many missing periods")
        .when(F.col("distinct_values") < fixed.MIN_SERIES_DISTINCT, "flat series")
        .when(F.col("zero_ratio") > fixed.MAX_ZERO_RATIO, "mostly zero")
    )
    weight = fixed.FORECASTABILITY_WEIGHTS
    density = F.least(F.col("periods") / (needed * 3), F.lit(1.0))
    variability = F.least(F.col("distinct_values") / F.greatest(F.col("periods") * 0.3, F.lit(1.0)), F.lit(1.0))
    score = F.round(
        weight["density"] * density + weight["completeness"] * (1 - F.col("missing_ratio"))
        + weight["variability"] * variability, 3,
    )
    supported = F.col("reason").isNull()
    return (
        stats.withColumn("reason", reason)
        .select(
            *keys, "granularity", "periods", "missing_ratio", "distinct_values", "zero_ratio",
            supported.alias("supported"), "reason", F.when(supported, score).otherwise(0.0).alias("score"),
            F.when(supported, max_horizon(F.col("periods"))).otherwise(F.lit(0)).cast("bigint").alias("max_horizon"),
        )
    )


def recommend_granularity(assessed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Best-scoring supported granularity per series; day, week, month order settles ties."""
    rank = _by_granularity({g: i for i, g in enumerate(fixed.GRANULARITIES)})
    best = F.min(F.struct((-F.col("score")).alias("s"), rank.alias("o"), F.col("granularity").alias("g"), F.col("max_horizon").alias("h")))
    return (
        assessed.where("supported").groupBy(*keys).agg(best.alias("b"))
        .select(*keys, F.col("b.g").alias("recommended_granularity"), (-F.col("b.s")).alias("score"),
                F.col("b.h").alias("max_horizon"))
        .where(F.col("recommended_granularity").isNotNull())
    )
