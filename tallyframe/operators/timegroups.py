"""Metrics over time: series, trends, growth and comparisons.

Everything is aggregated to one row per period (and key) before any window runs, so a window over
periods sees at most the calendar's number of periods per key, however many raw rows there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.numeric import as_number, change_percent
from tallyframe.functions.periods import as_timestamp, period_label, period_start
from tallyframe.operators.metrics import Metric, as_metric, metric_aggregate


def metric_over_time(
    df: DataFrame,
    metric: Metric | str,
    date_column: str,
    granularity: str = "month",
    operation: str = "total",
    keys: Sequence[str] = (),
) -> DataFrame:
    """One value per period label; rows without a date and periods without a value are dropped."""
    return compare_metrics(df, [metric], date_column, granularity, operation, keys).dropna(
        subset=[as_metric(metric).alias]
    )


def compare_metrics(
    df: DataFrame,
    metrics: Sequence[Metric | str],
    date_column: str | None,
    granularity: str = "month",
    operation: str = "total",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Several metrics on one time axis; plain totals when there is no date column."""
    aggregates = [metric_aggregate(df, m, operation) for m in metrics]
    if date_column is None:
        return df.groupBy(*keys).agg(*aggregates)
    stamp = as_timestamp(df, date_column)
    return (
        df.where(stamp.isNotNull())
        .groupBy(*keys, period_label(stamp, granularity).alias("period"))
        .agg(*aggregates)
    )


def align_series_by_period(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = (), period: str = "period"
) -> DataFrame:
    """Union of the periods of two separate series, null where one has none."""
    return left.join(right, [*keys, period], "full_outer")


def trend_change(
    df: DataFrame,
    metric: Metric | str,
    date_column: str,
    granularity: str = "month",
    keys: Sequence[str] = (),
) -> DataFrame:
    """First and last value of the series, the change between them in percent, and its direction."""
    name = as_metric(metric).alias
    series = metric_over_time(df, metric, date_column, granularity, keys=keys)
    ends = series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("periods"),
        F.min("period").alias("first_period"), F.max("period").alias("last_period"),
        F.min_by(name, "period").alias("first_value"), F.max_by(name, "period").alias("last_value"),
    )
    first, last = F.col("first_value"), F.col("last_value")
    change = F.round(F.try_divide(last - first, F.abs(first)) * 100, 1)
    return ends.where(F.col("periods") >= 2).select(
        *keys, "periods", "first_period", "last_period", "first_value", "last_value",
        change.alias("change_pct"),
        F.when(change > 0, "increased").when(change < 0, "decreased").otherwise("stayed flat").alias("direction"),
    )


def _period_window(keys: Sequence[str]) -> Window:
    # Without keys the whole calendar is one group, which is bounded.
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_start")


def growth(
    df: DataFrame, value: str, date_column: str, granularity: str = "month", keys: Sequence[str] = ()
) -> DataFrame:
    """Total per period and its change against the previous period that has data.

    The first period of each series has no predecessor and is left out.
    """
    number, stamp = as_number(df, value), as_timestamp(df, date_column)
    totals = (
        df.where(number.isNotNull() & stamp.isNotNull())
        .groupBy(*keys, period_start(stamp, granularity).alias("_start"))
        .agg(F.sum(number).alias("total"))
    )
    window = _period_window(keys)
    return (
        totals.withColumn("_previous", F.lag("total").over(window))
        .where(F.col("_previous").isNotNull())
        .select(
            *keys, period_label(F.col("_start").cast("timestamp_ntz"), granularity).alias("period"), "total",
            change_percent(F.col("total"), F.col("_previous")).alias("growth_pct"),
        )
    )


def growth_records(
    df: DataFrame, value: str, date_column: str, keys: Sequence[str], tie_break: Sequence[str]
) -> DataFrame:
    """Change between consecutive dated records of each key.

    Records are not summed per day, so keys and a tie-break are required: they split the work
    and give equal dates an order.
    """
    if not keys or not tie_break:
        raise ValueError("record-level growth needs partition keys and tie_break columns")
    number, stamp = as_number(df, value), as_timestamp(df, date_column)
    window = Window.partitionBy(*keys).orderBy(F.to_date("_stamp"), *tie_break)
    return (
        df.withColumn("_number", number).withColumn("_stamp", stamp)
        .where(F.col("_number").isNotNull() & F.col("_stamp").isNotNull())
        .withColumn("_previous", F.lag("_number").over(window))
        .where(F.col("_previous").isNotNull())
        .select(
            *keys, *[c for c in tie_break if c not in keys],
            period_label(F.col("_stamp"), "day").alias("period"), F.col("_number").alias("total"),
            change_percent(F.col("_number"), F.col("_previous")).alias("growth_pct"),
        )
    )


def growth_summary(growth_frame: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean growth with the best and worst period; the earliest period wins ties."""
    pct = F.col("growth_pct")
    return growth_frame.where(pct.isNotNull()).groupBy(*keys).agg(
        F.round(F.avg(pct), 2).alias("average_growth_pct"),
        F.min_by("period", F.struct((-pct).alias("p"), F.col("period"))).alias("best_period"),
        F.max(pct).alias("best_growth_pct"),
        F.min_by("period", F.struct(pct.alias("p"), F.col("period"))).alias("worst_period"),
        F.min(pct).alias("worst_growth_pct"),
    )


def quarter_measures_growth(df: DataFrame, measures: Sequence[str], date_column: str) -> DataFrame:
    """Several summed measures per quarter, with the growth of the first one."""
    stamp = as_timestamp(df, date_column)
    totals = (
        df.where(stamp.isNotNull())
        .groupBy(period_start(stamp, "quarter").alias("_start"))
        .agg(*[F.coalesce(F.sum(as_number(df, m)), F.lit(0.0)).alias(m) for m in measures])
    )
    lead = F.col(measures[0])
    previous = F.lag(measures[0]).over(_period_window(()))
    return totals.select(
        period_label(F.col("_start").cast("timestamp_ntz"), "quarter").alias("quarter"), *measures,
        change_percent(lead, previous).alias("quarterly_growth_pct"),
    )


def rollup_monthly(
    df: DataFrame, date_column: str, sums: dict[str, str], counts: dict[str, str]
) -> DataFrame:
    """Raw rows to one row per year and month: sums and counts under the given names."""
    stamp = as_timestamp(df, date_column)
    aggregates: list[Column] = [F.sum(as_number(df, c)).alias(name) for name, c in sums.items()]
    aggregates += [F.count(c).alias(name) for name, c in counts.items()]
    return (
        df.where(stamp.isNotNull()).groupBy(period_start(stamp, "month").alias("_start")).agg(*aggregates)
        .select(
            F.year("_start").cast("bigint").alias("year"), F.lower(F.date_format("_start", "MMMM")).alias("month"),
            F.concat(F.lit("Q"), F.quarter("_start")).alias("quarter"), *sums, *counts,
        )
    )
