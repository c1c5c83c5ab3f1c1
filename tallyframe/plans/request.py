"""One structured request to one operator call.

A request is a mapping with ``operation`` and, as the operation needs them, ``metrics``,
``group_by``, ``filters``, ``filter_logic``, ``top_n``, ``ranking_levels``, ``granularity``,
``horizon`` and ``field``. Fields that do not exist are errors; nothing is dropped in silence.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from tallyframe.operators import aggregates, forecast, ranking, timegroups
from tallyframe.operators.filters import filter_rows
from tallyframe.operators.metrics import Metric, as_metric

OPERATIONS = (
    "total", "average", "maximum", "minimum", "trend", "compare", "forecast", "top", "bottom",
    "distinct_count", "unique_entities", "correlation",
)
REQUEST_KEYS = (
    "operation", "metrics", "group_by", "filters", "filter_logic", "top_n", "ranking_levels",
    "granularity", "horizon", "field", "date_column", "non_negative",
)
SINGLE_METRIC = ("total", "average", "maximum", "minimum", "trend", "forecast", "top", "bottom")


def _level(level: Mapping[str, Any] | Sequence[Any]) -> tuple[str, int]:
    """A ranking level given as a pair, or as a mapping with dimension and perhaps top_n."""
    if isinstance(level, Mapping):
        if "dimension" not in level:
            raise ValueError(f"a ranking level needs a dimension; given {dict(level)}")
        return level["dimension"], level.get("top_n") or ranking.DEFAULT_N
    dimension, count = level
    return dimension, count


def _checked(df: DataFrame, request: Mapping[str, Any]) -> tuple[str, list[Metric], list[str]]:
    unknown = [k for k in request if k not in REQUEST_KEYS]
    if unknown:
        raise ValueError(f"unknown request keys {unknown}; known are {REQUEST_KEYS}")
    operation = request.get("operation")
    if operation not in OPERATIONS:
        raise ValueError(f"operation {operation!r} is not one of {OPERATIONS}")
    metrics = [as_metric(m) for m in request.get("metrics", [])]
    groups: Sequence[str] = request.get("group_by", [])
    levels = [_level(level) for level in request.get("ranking_levels") or []]
    for name in [*[m.field for m in metrics], *groups, *[level[0] for level in levels]]:
        if name not in df.columns:
            raise ValueError(f"the table has no column {name!r}")
    if operation in SINGLE_METRIC and not metrics:
        raise ValueError(f"give a metric for {operation!r}")
    if operation in ("compare", "correlation") and len(metrics) < 2:
        raise ValueError(f"give two metrics for {operation!r}")
    if levels and operation not in ("top", "bottom"):
        raise ValueError(f"levels are for top and bottom, not for {operation!r}")
    if operation in ("top", "bottom") and not levels and len(groups) != 1:
        raise ValueError(f"say by which one column {operation!r} ranks")
    if request.get("granularity") and not request.get("date_column"):
        raise ValueError("a granularity needs a date column")
    return operation, metrics, list(groups)


def analyze(df: DataFrame, request: Mapping[str, Any]) -> DataFrame:
    operation, metrics, groups = _checked(df, request)
    date_column, granularity = request.get("date_column"), request.get("granularity")
    rows = filter_rows(df, request.get("filters") or [], request.get("filter_logic", "and"), date_column)
    if operation in ("top", "bottom"):
        levels = request.get("ranking_levels")
        if levels:
            return ranking.nested_ranking(rows, metrics[0], [_level(level) for level in levels], operation == "top")
        return ranking.rank_entities(rows, metrics[0], groups[0], request.get("top_n") or ranking.DEFAULT_N, operation == "top")
    if operation == "correlation":
        if groups or granularity:
            return aggregates.correlation_grouped(rows, metrics[0], metrics[1], groups, date_column, granularity)
        return aggregates.correlation_rows(rows, metrics[0].field, metrics[1].field)
    if operation in ("distinct_count", "unique_entities") and not groups:
        field = request.get("field") or (metrics[0].field if metrics else None)
        if not field:
            raise ValueError(f"a field is required for {operation}")
        return aggregates.distinct_count(rows, field)
    if operation in ("distinct_count", "unique_entities"):
        field = request.get("field") or (metrics[0].field if metrics else None)
        if not field:
            raise ValueError(f"a field is required for {operation}")
        metrics, operation = [Metric(field, "nunique")], "total"
    if operation == "trend":
        if not date_column:
            raise ValueError("a trend needs a date column")
        return timegroups.metric_over_time(rows, metrics[0], date_column, granularity or "month", keys=groups)
    if operation == "compare":
        return timegroups.compare_metrics(rows, metrics, date_column, granularity or "month", keys=groups)
    if operation == "forecast":
        if not date_column or not granularity:
            raise ValueError("a forecast needs a date column and a granularity")
        return forecast.forecast(
            rows, metrics[0], date_column, granularity, groups, request.get("horizon"), request.get("non_negative", False)
        )
    if len(groups) == 1 and len(metrics) == 1 and not granularity:
        return aggregates.group_by_dimension(rows, metrics[0], groups[0], operation)
    if not groups and granularity:
        return timegroups.compare_metrics(rows, metrics, date_column, granularity, operation)
    if groups:
        return aggregates.group_by_many(rows, metrics, groups, operation, date_column, granularity)
    return aggregates.aggregate(rows, metrics, operation)
