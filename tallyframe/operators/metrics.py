"""What a metric is, and the aggregate expression it stands for."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numeric import as_number, present

AGGREGATIONS = ("sum", "mean", "count", "nunique", "min", "max")
OPERATIONS = ("total", "average", "maximum", "minimum", "distinct_count")


@dataclass(frozen=True)
class Metric:
    """A column with its default aggregation, and the name of the result."""

    field: str
    aggregation: str = "sum"
    name: str | None = None

    @property
    def alias(self) -> str:
        return self.name or self.field


def as_metric(metric: Metric | str | Mapping[str, str]) -> Metric:
    """A metric as it is, a column name, or a mapping with field and perhaps aggregation and name."""
    if isinstance(metric, Mapping):
        unknown = set(metric) - {"field", "aggregation", "name"}
        if unknown or not metric.get("field"):
            raise ValueError(f"a metric needs a field, and takes an aggregation and a name besides; given {dict(metric)}")
        return Metric(metric["field"], metric.get("aggregation") or "sum", metric.get("name"))
    return metric if isinstance(metric, Metric) else Metric(metric)


def metric_aggregate(df: DataFrame, metric: Metric | str, operation: str = "total") -> Column:
    """Aggregate column for a metric under an operation.

    Counts stay counts whatever the operation. ``total`` means the metric's own aggregation.
    Sums are null when a group holds no number.
    """
    metric = as_metric(metric)
    if metric.aggregation not in AGGREGATIONS:
        raise ValueError(f"aggregation {metric.aggregation!r} is not one of {AGGREGATIONS}")
    if operation not in OPERATIONS:
        raise ValueError(f"operation {operation!r} is not one of {OPERATIONS}")
    if metric.aggregation == "nunique" or operation == "distinct_count":
        return F.count_distinct(present(df, metric.field)).alias(metric.alias)
    if metric.aggregation == "count":
        return F.count(present(df, metric.field)).alias(metric.alias)
    number = as_number(df, metric.field)
    by_operation = {"average": F.avg, "maximum": F.max, "minimum": F.min}
    by_default = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}
    function = by_operation.get(operation) or by_default[metric.aggregation]
    return function(number).alias(metric.alias)
