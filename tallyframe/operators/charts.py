"""Frames shaped for charts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import fixed_values as fixed
from tallyframe.functions.numeric import column
from tallyframe.operators.metrics import Metric, metric_aggregate


def chart_series(
    df: DataFrame, x: str, metric: Metric | str, series: str, series_values: Sequence[str]
) -> DataFrame:
    """One row per x with a value column for each listed series value.

    Naming the values keeps the number of columns fixed and saves the job that would collect them.
    """
    aggregate = metric_aggregate(df, metric)
    return df.where(F.col(x).isNotNull()).groupBy(x).pivot(series, list(series_values)).agg(aggregate)


def scatter_sample(
    df: DataFrame, columns: Sequence[str], key: Sequence[str],
    points: int = fixed.SCATTER_POINTS, seed: int = fixed.SCATTER_SEED,
) -> DataFrame:
    """At most ``points`` complete rows, chosen by a seeded hash of their key: the same on every run.

    left_out is the number of complete rows that were not chosen.
    """
    chosen = [column(c) for c in dict.fromkeys([*key, *columns])]
    complete = df.where(reduce(and_, [column(c).isNotNull() for c in columns])).select(*chosen)
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[column(c).cast("string") for c in key]).cast("binary"))
    total = complete.agg(F.count(F.lit(1))).scalar()
    picked = complete.orderBy(order, *[column(c) for c in key]).limit(points)
    return picked.withColumn("left_out", F.greatest(total - points, F.lit(0).cast("bigint")))
