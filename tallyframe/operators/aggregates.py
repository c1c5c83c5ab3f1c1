"""Totals, grouped totals, shares and correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numeric import (
    as_number,
    column_type,
    complete_pairs,
    correlation_direction,
    correlation_strength,
    pearson,
    present,
)
from tallyframe.functions.periods import as_timestamp, period_label, period_range_label
from tallyframe.operators.filters import filter_area
from tallyframe.operators.metrics import Metric, as_metric, metric_aggregate


def record_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("record_count"))


def aggregate(df: DataFrame, metrics: Sequence[Metric | str], operation: str = "total") -> DataFrame:
    """One row with every metric aggregated."""
    return df.agg(*[metric_aggregate(df, m, operation) for m in metrics])


def distinct_count(df: DataFrame, field: str, approximate: bool = False) -> DataFrame:
    value = present(df, field)
    count = F.approx_count_distinct(value, 0.01) if approximate else F.count_distinct(value)
    return df.agg(count.alias("distinct_count"))


def unique_entities(
    df: DataFrame, entity: str, area_field: str | None = None, area_value: str | None = None
) -> DataFrame:
    return distinct_count(filter_area(df, area_field, area_value), entity)


def record_at_extreme(df: DataFrame, field: str, tie_break: Sequence[str], highest: bool = True) -> DataFrame:
    """The whole record with the largest or smallest value; the tie-break columns settle ties.

    Runs as a bounded top-1 per task, so no full sort takes place.
    """
    if not tie_break:
        raise ValueError("tie_break columns are required: row order has no meaning in a distributed table")
    number = as_number(df, field)
    order = number.desc() if highest else number.asc()
    return df.where(number.isNotNull()).orderBy(order, *[F.col(c).asc() for c in tie_break]).limit(1)


def summarize_metrics(df: DataFrame, fields: Sequence[str], record_columns: Sequence[str]) -> DataFrame:
    """Per metric: total, average, extremes and the record at either extreme, in one scan.

    ``record_columns`` identify the record; they also settle ties, smallest first.
    """
    columns, entries = [], []
    key = F.struct(*[F.col(c) for c in record_columns])
    for i, field in enumerate(fields):
        v = as_number(df, field)
        columns += [
            F.sum(v).alias(f"t{i}"), F.avg(v).alias(f"a{i}"), F.max(v).alias(f"h{i}"), F.min(v).alias(f"l{i}"),
            F.min(F.when(v.isNotNull(), F.struct((-v).alias("v"), key.alias("k")))).alias(f"hk{i}"),
            F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), key.alias("k")))).alias(f"lk{i}"),
        ]
        entries.append(
            F.struct(
                F.lit(field).alias("metric"), F.col(f"t{i}").alias("total"), F.col(f"a{i}").alias("average"),
                F.col(f"h{i}").alias("highest"), F.col(f"l{i}").alias("lowest"),
                *[F.col(f"hk{i}.k.{c}").alias(f"highest_{c}") for c in record_columns],
                *[F.col(f"lk{i}.k.{c}").alias(f"lowest_{c}") for c in record_columns],
            )
        )
    return df.agg(*columns).select(F.inline(F.array(*entries)))


def ratio_of_totals(df: DataFrame, numerator: str, denominator: str, name: str = "ratio_pct") -> DataFrame:
    """``sum(a) / sum(b) * 100`` to two places; null when a total is missing or the base is zero."""
    top, base = F.sum(as_number(df, numerator)), F.sum(as_number(df, denominator))
    return df.agg(F.round(F.try_divide(top, base) * 100, 2).alias(name))


def group_by_dimension(
    df: DataFrame, metric: Metric | str, dimension: str, operation: str = "total", keep_null_keys: bool = False
) -> DataFrame:
    """One metric by one dimension; groups without any value are left out."""
    metric = as_metric(metric)
    column_type(df, dimension)
    rows = df if keep_null_keys else df.where(present(df, dimension).isNotNull())
    return rows.groupBy(dimension).agg(metric_aggregate(df, metric, operation)).dropna(subset=[metric.alias])


def group_by_many(
    df: DataFrame,
    metrics: Sequence[Metric | str],
    dimensions: Sequence[str],
    operation: str = "total",
    date_column: str | None = None,
    granularity: str | None = None,
    week_ranges: bool = True,
    keep_null_keys: bool = True,
) -> DataFrame:
    """Several metrics by several dimensions and, with a granularity, by period as well.

    Rows without a date form the null period. The period column carries the granularity's name.
    """
    for dimension in dimensions:
        column_type(df, dimension)
    keys: list[Column] = [F.col(d) for d in dimensions]
    if granularity:
        if not date_column:
            raise ValueError("a date column is required for time grouping")
        label = period_range_label if week_ranges else period_label
        keys.append(label(as_timestamp(df, date_column), granularity).alias(granularity))
    if not keys:
        raise ValueError("grouping needs at least one dimension or a granularity")
    rows = df if keep_null_keys else df.dropna(subset=list(dimensions))
    return rows.groupBy(*keys).agg(*[metric_aggregate(df, m, operation) for m in metrics])


def breakdown_share(df: DataFrame, field: str, dimension: str) -> DataFrame:
    """Total per group and its share of the grand total in percent."""
    grouped = group_by_dimension(df, Metric(field, "sum", "total"), dimension)
    grand = (
        df.where(present(df, dimension).isNotNull()).agg(F.sum(as_number(df, field)).alias("grand_total"))
    )
    share = F.round(F.try_divide(F.col("total"), grand.scalar()) * 100, 1)
    return grouped.withColumn("share_pct", share)


def breakdown_leaders(df: DataFrame, field: str, dimension: str) -> DataFrame:
    """Leading and trailing group with their values and the leader's share; ties by smallest key.

    One aggregation over the grouped totals: no sort, and the groups never meet in one task.
    """
    grouped = group_by_dimension(df, Metric(field, "sum", "total"), dimension)
    key, total = F.col(dimension), F.col("total")
    first = F.min(F.struct((-total).alias("v"), key.alias("k")))
    # Rank order is value descending then key ascending, so the trailer has the largest key.
    last = F.max(F.struct((-total).alias("v"), key.alias("k")))
    return grouped.agg(first.alias("f"), last.alias("l"), F.sum(total).alias("s")).select(
        F.col("f.k").alias("leader"), (-F.col("f.v")).alias("leader_total"),
        F.round(F.try_divide(-F.col("f.v"), F.col("s")) * 100, 1).alias("leader_share_pct"),
        F.col("l.k").alias("trailer"), (-F.col("l.v")).alias("trailer_total"),
    )


def leader_of_groups(df: DataFrame, metric: Metric | str, dimension: str, operation: str = "total") -> DataFrame:
    metric = as_metric(metric)
    grouped = group_by_dimension(df, metric, dimension, operation)
    return grouped.orderBy(F.col(metric.alias).desc(), F.col(dimension).asc()).limit(1)


def align_metrics_by_group(
    df: DataFrame,
    metrics: Sequence[Metric | str],
    dimensions: Sequence[str] = (),
    date_column: str | None = None,
    granularity: str | None = None,
) -> DataFrame:
    """Metrics side by side per group; groups missing any of them are dropped."""
    aligned = group_by_many(df, metrics, dimensions, "total", date_column, granularity)
    return aligned.dropna(subset=[as_metric(m).alias for m in metrics])


def _correlation_result(df: DataFrame, x: Column, y: Column, first: str, second: str) -> DataFrame:
    return df.agg(pearson(x, y).alias("r"), complete_pairs(x, y).alias("observations")).select(
        F.lit(first).alias("first_metric"), F.lit(second).alias("second_metric"),
        F.round("r", 4).alias("correlation"), "observations",
        correlation_strength(F.col("r")).alias("strength"), correlation_direction(F.col("r")).alias("direction"),
    )


def correlation_rows(df: DataFrame, first: str, second: str) -> DataFrame:
    """Pearson r of two columns over the rows that have both; null when it is undefined."""
    return _correlation_result(df, as_number(df, first), as_number(df, second), first, second)


def correlation_grouped(
    df: DataFrame,
    first: Metric | str,
    second: Metric | str,
    dimensions: Sequence[str] = (),
    date_column: str | None = None,
    granularity: str | None = None,
) -> DataFrame:
    """Both metrics are aggregated per group or period first; r is taken across the groups."""
    first, second = as_metric(first), as_metric(second)
    if first.alias == second.alias:
        raise ValueError("correlation needs two different metrics")
    aligned = align_metrics_by_group(df, [first, second], dimensions, date_column, granularity)
    x, y = F.col(first.alias).cast("double"), F.col(second.alias).cast("double")
    return _correlation_result(aligned, x, y, first.alias, second.alias)
