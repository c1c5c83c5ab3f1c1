"""Top and bottom entities, flat and nested.

Equal values rank in ascending key order, in both directions. A flat ranking is a bounded top-n
per task; a nested one prunes to the top rows of each group before its shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.fixed_values import HISTORY_WINDOW
from tallyframe.functions.numeric import column_type
from tallyframe.operators.aggregates import group_by_dimension
from tallyframe.operators.metrics import Metric, as_metric, metric_aggregate

DEFAULT_N = 5


def _check_n(n: int) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n <= 0:
        raise ValueError("top_n must be a positive integer")
    return n


def _order(value: str, key: str, descending: bool) -> list[Column]:
    return [F.col(value).desc() if descending else F.col(value).asc(), F.col(key).asc()]


def rank_entities(
    df: DataFrame, metric: Metric | str, dimension: str, n: int = DEFAULT_N, descending: bool = True
) -> DataFrame:
    """The n entities with the largest (or smallest) aggregated metric."""
    metric = as_metric(metric)
    grouped = group_by_dimension(df, metric, dimension)
    return grouped.orderBy(*_order(metric.alias, dimension, descending)).limit(_check_n(n))


def top_n(df: DataFrame, metric: Metric | str, dimension: str, n: int = DEFAULT_N) -> DataFrame:
    return rank_entities(df, metric, dimension, n, descending=True)


def bottom_n(df: DataFrame, metric: Metric | str, dimension: str, n: int = DEFAULT_N) -> DataFrame:
    return rank_entities(df, metric, dimension, n, descending=False)


def restrict_to(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the chosen ones; Spark picks the join by the size it finds."""
    return df.join(chosen, key)


def nested_ranking(
    df: DataFrame, metric: Metric | str, levels: Sequence[tuple[str, int]], descending: bool = True
) -> DataFrame:
    """Best outer entities and, within each, the best inner entities; both ranked from 1."""
    metric = as_metric(metric)
    if len(levels) != 2:
        raise ValueError("nested ranking requires exactly two ranking levels")
    (outer, outer_n), (inner, inner_n) = levels
    if outer == inner:
        raise ValueError("nested ranking levels must use different dimensions")
    column_type(df, inner)
    grouped = group_by_dimension(df, Metric(metric.field, metric.aggregation, "outer_value"), outer)
    best = grouped.orderBy(*_order("outer_value", outer, descending)).limit(_check_n(outer_n))
    # At most outer_n rows are left, so ranking them in one task is safe.
    ranked = best.withColumn(
        "outer_rank", F.row_number().over(Window.orderBy(*_order("outer_value", outer, descending)))
    )
    within = restrict_to(df, ranked, outer).where(F.col(inner).isNotNull())
    values = (
        within.groupBy(outer, "outer_rank", "outer_value", inner)
        .agg(metric_aggregate(df, Metric(metric.field, metric.aggregation, "inner_value")))
        .dropna(subset=["inner_value"])
    )
    window = Window.partitionBy(outer).orderBy(*_order("inner_value", inner, descending))
    return (
        values.withColumn("inner_rank", F.row_number().over(window))
        .where(F.col("inner_rank") <= _check_n(inner_n))
        .select(
            F.col("outer_rank").cast("bigint"), outer, "outer_value",
            F.col("inner_rank").cast("bigint"), inner, "inner_value",
        )
    )


def top_n_per_group(
    df: DataFrame, metric: Metric | str, outer: str, inner: str, n: int = DEFAULT_N, descending: bool = True
) -> DataFrame:
    """The n best inner entities of every outer value."""
    metric = as_metric(metric)
    column_type(df, outer)
    column_type(df, inner)
    values = (
        df.dropna(subset=[outer, inner]).groupBy(outer, inner)
        .agg(metric_aggregate(df, metric)).dropna(subset=[metric.alias])
    )
    window = Window.partitionBy(outer).orderBy(*_order(metric.alias, inner, descending))
    return (
        values.withColumn("rank", F.row_number().over(window).cast("bigint"))
        .where(F.col("rank") <= _check_n(n)).select(outer, "rank", inner, metric.alias)
    )


def recent_history(
    series: DataFrame, granularity: str, keys: Sequence[str] = (), period: str = "period", n: int | None = None
) -> DataFrame:
    """The latest periods of each series: 30 days, 20 weeks or 12 months unless n is given."""
    size = _check_n(n if n is not None else HISTORY_WINDOW.get(granularity, 20))
    if not keys:
        return series.orderBy(F.col(period).desc()).limit(size)
    window = Window.partitionBy(*keys).orderBy(F.col(period).desc())
    return series.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= size).drop("_rank")
