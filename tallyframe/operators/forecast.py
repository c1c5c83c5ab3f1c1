"""Forecasts of every series in a panel: folds, scores, model choice, prediction and quality.

Features, baselines, the choice and intervals are Spark expressions; only the fits run in Python, some
whole series at a time, whose rows pass once for all models and folds. The calendar bounds a series, so
what Python holds stays small however large the raw data is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import fitting
from tallyframe.functions import fixed_values as fixed
from tallyframe.functions.fitting import fold_predictions, fold_scores, forecast_rows, forecast_series, in_batches
from tallyframe.functions.numeric import column
from tallyframe.functions.periods import as_timestamp
from tallyframe.operators.metrics import Metric, as_metric
from tallyframe.operators.series import (
    clean_series_input,
    make_features,
    max_horizon,
    panel_forecastability,
    planned_horizon,
    resample_many,
    resample_metrics,
    series_panel,
)
from tallyframe.sources.shared import shared_folder

FEATURES = list(fixed.FEATURE_COLUMNS)

# The fitting functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(fitting)


def _keyed(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return list(keys) or ["_series"]


def _with_series(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A panel without keys is one series; it gets a constant key."""
    return df if keys or "_series" in df.columns else df.withColumn("_series", F.lit(0))


def apply_by_series(
    df: DataFrame, keys: Sequence[str], function: Callable[[pa.Table, list[int]], pa.Table], schema: T.StructType
) -> DataFrame:
    """The function applied to the rows of some whole keys at a time, in period order.

    Rows are hashed to the session's shuffle partitions and sorted there by Spark, and each task
    streams them through Python, holding some 16,000 rows, or one series, at a time. A panel is small in bytes but dear
    in Python time, so the number of partitions is stated, and the key hashed: else Spark would take
    the partitions of the windows before, which it merges by their size.
    """
    names = list(keys)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    arranged = df.repartition(partitions, F.xxhash64(*names)).sortWithinPartitions(*names, "period")
    return arranged.mapInArrow(lambda batches: in_batches(batches, names, function), schema)


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [df.schema[c] for c in names]


def forecast_naive(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The last value of each series, as the prediction for any later period."""
    return series.groupBy(*keys).agg(F.max("period").alias("last_period"), F.max_by("value", "period").alias("predicted"))


def forecast_lag1(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every period predicted by the one before."""
    window = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("period")
    return series.withColumn("predicted", F.lag("value").over(window)).where(F.col("predicted").isNotNull())


def time_folds(features: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Chronological, expanding folds: every row once per fold that uses it, as train or test.

    With n rows there are k = min(5, max(2, n // 6), n - 1) folds whose test blocks of
    n // (k + 1) rows end the series; fold 1 is the earliest.
    """
    keyed = _with_series(features, keys)
    by_series = Window.partitionBy(*_keyed(keyed, keys))
    n, position = F.col("_n"), F.col("_position")
    numbered = keyed.withColumns({
        "_position": (F.row_number().over(by_series.orderBy("period")) - 1).cast("bigint"),
        "_n": F.count(F.lit(1)).over(by_series),
    })
    folds = F.least(F.lit(5), F.greatest(F.lit(2), F.floor(n / 6)), n - 1).cast("int")
    sized = numbered.where(n >= 3).withColumns({"_k": folds}).withColumn("_size", F.floor(n / (F.col("_k") + 1)))
    exploded = sized.withColumn("fold", F.explode(F.sequence(F.lit(1), F.col("_k"))))
    start = n - (F.col("_k") - F.col("fold") + 1) * F.col("_size")
    placed = exploded.withColumn("_start", start).where(position < F.col("_start") + F.col("_size"))
    helpers = ["_position", "_n", "_k", "_size", "_start"]
    result = placed.withColumns({"fold": F.col("fold").cast("bigint"), "is_train": position < F.col("_start")})
    return result.drop(*helpers, *([] if keys else ["_series"]))


def baseline_predictions(folds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Test rows of every fold predicted by the last training value and by the previous period."""
    by_fold = Window.partitionBy(*keys, "fold")
    last = F.max(F.when(F.col("is_train"), F.struct("period", "value"))).over(by_fold)["value"]
    tested = folds.withColumn("_last", last).where(~F.col("is_train"))
    models = F.array(
        F.struct(F.lit(fixed.NAIVE).alias("algorithm"), F.col("_last").alias("predicted")),
        F.struct(F.lit(fixed.SEASONAL).alias("algorithm"), F.coalesce("lag_1", "_last").alias("predicted")),
    )
    return tested.select(*keys, "fold", "period", F.col("value").alias("actual"), F.inline(models))


def model_predictions(
    features: DataFrame, keys: Sequence[str] = (), algorithms: Sequence[str] = (fixed.LINEAR, fixed.RIDGE, fixed.BOOSTED)
) -> DataFrame:
    """Test rows of the folds of `time_folds` predicted by the models fitted on the rows before each.

    No row is copied for a fold: the regressions of all folds come from moments that are summed once, and
    the trees of many series and folds grow together. Folds whose training rows are constant have no
    fitted models, series of under 40 rows no trees.
    """
    unknown = [a for a in algorithms if a not in fixed.MODELS]
    if unknown:
        raise ValueError(f"models are {fixed.MODELS}, not {unknown}")
    keyed, chosen = _with_series(features, keys), list(algorithms)
    names = _keyed(keyed, keys)
    schema = T.StructType([
        *_fields(keyed, [*names, "period"]), T.StructField("fold", T.LongType()), T.StructField("actual", T.DoubleType()),
        T.StructField("algorithm", T.StringType()), T.StructField("predicted", T.DoubleType()),
    ])

    def fit(rows: pa.Table, starts: list[int]) -> pa.Table:
        return fold_predictions(rows, starts, [*names, "period"], chosen)

    return apply_by_series(keyed, names, fit, schema).select(*keys, "fold", "period", "actual", "algorithm", "predicted")


def error_metrics(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R², sMAPE and WAPE of (actual, predicted); undefined ones are null."""
    actual, predicted = F.col("actual"), F.col("predicted")
    error, size = F.abs(predicted - actual), F.abs(actual) + F.abs(predicted)
    squares = F.sum(error * error)
    return predictions.groupBy(*keys).agg(
        F.avg(error).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(
            F.min(actual) != F.max(actual), 1 - F.try_divide(squares, F.var_pop(actual) * F.count(actual))
        ).alias("r2"),
        (F.avg(F.when(size != 0, 2 * error / F.when(size != 0, size))) * 100).alias("smape"),
        (F.try_divide(F.sum(error), F.sum(F.abs(actual))) * 100).alias("wape"),
        F.count(F.lit(1)).alias("n"),
    )


def cv_scores(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over folds of each model's errors, with the number of folds used."""
    per_fold = error_metrics(predictions, [*keys, "algorithm", "fold"])
    return per_fold.groupBy(*keys, "algorithm").agg(
        F.round(F.avg("mae"), 4).alias("mae"), F.round(F.avg("rmse"), 4).alias("rmse"),
        F.round(F.avg("r2"), 4).alias("r2"), F.round(F.avg("smape"), 2).alias("smape"),
        F.count(F.lit(1)).alias("n_folds"),
    )


def select_model(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per series the lowest MAE that beats the naive baseline by more than 3 %, else the baseline.

    The states of `fitted_models` go along with their scores.
    """
    order = F.array_position(F.array(*[F.lit(m) for m in fixed.MODELS]), F.col("algorithm"))
    states = [c for c in _STATE if c in scores.columns]
    row = F.struct("mae", order.alias("o"), "algorithm", "rmse", "r2", "smape", "n_folds", *states)
    is_naive = F.col("algorithm") == fixed.NAIVE
    baseline = F.min(F.when(is_naive, F.col("mae"))).over(Window.partitionBy(*_keyed(scores, keys)))
    judged = _with_series(scores, keys).withColumn("baseline_mae", baseline)
    beats = ~is_naive & (F.col("mae") < F.col("baseline_mae") * (1 - fixed.MIN_IMPROVEMENT))
    best = judged.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(beats, row)), F.min(F.when(is_naive, row)), F.min(row)).alias("w"),
        F.first("baseline_mae").alias("baseline_mae"),
    )
    improvement = F.round(F.try_divide(F.col("baseline_mae") - F.col("w.mae"), F.col("baseline_mae")) * 100, 2)
    return best.select(
        *keys, "w.algorithm", "w.mae", "w.rmse", "w.r2", "w.smape", "w.n_folds", "baseline_mae",
        improvement.alias("improvement_pct"), *[f"w.{c}" for c in states],
    )


def validate_models(features: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cross-validated scores of every candidate model for every series, in one pass over its rows.

    The candidates are the two baselines, least squares, ridge and, from 40 rows on, boosted trees.
    """
    return _scored(features, keys, False)


#: What `fitted_models` gives beside the scores.
_STATE = ("periods", "history_periods", "state")


def fitted_models(features: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The scores of `validate_models`, with what a forecast needs: each model fitted on all rows of its series.

    periods and history_periods are the series' length and feature rows. The state of trees is null where
    another model has a lower error.
    """
    return _scored(features, keys, True)


def _scored(features: DataFrame, keys: Sequence[str], states: bool) -> DataFrame:
    keyed = _with_series(features, keys)
    names = _keyed(keyed, keys)
    digits = {"mae": 4, "rmse": 4, "r2": 4, "smape": 2}
    kinds = {"algorithm": T.StringType(), **{c: T.DoubleType() for c in digits}, "n_folds": T.LongType()}
    kinds |= dict(zip(_STATE, (T.LongType(), T.LongType(), T.BinaryType()))) if states else {}
    schema = T.StructType([*_fields(keyed, names), *[T.StructField(c, k) for c, k in kinds.items()]])
    scores = apply_by_series(keyed, names, lambda rows, starts: fold_scores(rows, starts, names, states=states), schema)
    return scores.select(*keys, *[F.round(c, digits[c]).alias(c) if c in digits else c for c in kinds])


def prediction_interval(predicted: Column, rmse: Column, step: Column, non_negative: Column) -> tuple[Column, Column]:
    """Lower and upper bound of the 80 % interval, widening with the square root of the step."""
    width = fixed.INTERVAL_Z * rmse * F.sqrt(step)
    lower = predicted - width
    return F.when(non_negative, F.greatest(F.lit(0.0), lower)).otherwise(lower), predicted + width


def forecast_recursive(
    features: DataFrame, chosen: DataFrame, granularity: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Forecast rows of every series with the model in ``chosen``.

    ``chosen`` has one row per series: algorithm, rmse, horizon and non_negative.
    """
    keyed, choice = _with_series(features, keys), _with_series(chosen, keys)
    names = _keyed(keyed, keys)
    extra = ["algorithm", "horizon", "non_negative"]
    joined = keyed.join(choice.select(*names, *extra, "rmse"), names)
    schema = T.StructType([
        *_fields(joined, [*names, "algorithm", "non_negative", "rmse"]), T.StructField("period", T.DateType()),
        T.StructField("step", T.LongType()), T.StructField("predicted", T.DoubleType()),
    ])
    constant = [*names, "algorithm", "non_negative", "rmse"]

    def run(rows: pa.Table, starts: list[int]) -> pa.Table:
        return forecast_series(rows, starts, granularity, constant)

    return _with_bounds(apply_by_series(joined, names, run, schema), keys)


def forecast_fitted(chosen: DataFrame, granularity: str, keys: Sequence[str] = ()) -> DataFrame:
    """The same from the states of `fitted_models`: one row a series, no feature rows are read again."""
    names = [*keys, "algorithm", "non_negative", "rmse"]
    schema = T.StructType([
        *_fields(chosen, names), T.StructField("period", T.DateType()), T.StructField("step", T.LongType()), T.StructField("predicted", T.DoubleType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from forecast_rows(pa.Table.from_batches([batch]), granularity, names).combine_chunks().to_batches()

    return _with_bounds(chosen.select(*names, "state", "horizon").mapInArrow(run, schema), keys)


def _with_bounds(forecasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    lower, upper = prediction_interval(F.col("predicted"), F.col("rmse"), F.col("step"), F.col("non_negative"))
    return forecasts.select(
        *keys, "period", "step", "algorithm", F.round("predicted", 4).alias("predicted_value"),
        F.round(lower, 4).alias("lower_bound"), F.round(upper, 4).alias("upper_bound"),
    )


def plan_forecasts(
    features: DataFrame | None, selected: DataFrame, granularity: str,
    keys: Sequence[str] = (), horizon: int | None = None, non_negative: bool = False,
) -> DataFrame:
    """Selected model, capped horizon and history length per series with enough feature rows.

    The lengths are those of the features, or come with the selected models of `fitted_models`.
    """
    named = lambda df: _with_series(df, keys)
    names = list(keys) or ["_series"]
    sized = named(selected)
    if "history_periods" not in selected.columns:
        lengths = named(features).groupBy(*names).agg((F.max("t") + 1).alias("periods"), F.count(F.lit(1)).alias("history_periods"))
        sized = sized.join(lengths, names)
    return (
        sized.where(F.col("history_periods") >= fixed.MIN_FEATURE_ROWS)
        .withColumn("granularity", F.lit(granularity))
        .withColumn("max_horizon", max_horizon(F.col("periods")))
        .withColumn("horizon", planned_horizon(granularity, F.col("max_horizon"), horizon))
        .withColumn("is_capped", F.lit(horizon or 0) > F.col("max_horizon"))
        .withColumn("non_negative", F.lit(non_negative))
        .drop(*([] if keys else ["_series"]))
    )


def _series_rows(
    df: DataFrame, metric: Metric | str, date_column: str, keys: Sequence[str], non_negative: bool, clean: bool
) -> tuple[DataFrame, Metric, list[str]]:
    """Rows (_keys, ts, value) for a series chain, the metric of `value`, and the key columns to use.

    The keys of a series become one text, so that a null among them is a key like any other.
    """
    metric = as_metric(metric)
    if clean:
        rows = clean_series_input(df, metric, date_column, keys, non_negative)
    else:
        rows = df.select(*keys, as_timestamp(df, date_column).alias("ts"), column(metric.field).alias("value"))
    coded = [F.to_json(F.struct(*[column(k) for k in keys])).alias("_keys")] if keys else []
    return rows.select(*coded, "ts", "value"), Metric("value", metric.aggregation), ["_keys"] if keys else []


def _with_keys(df: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The key columns in place of their text."""
    if not keys:
        return df
    shape = T.StructType([T.StructField(k, source.schema[k].dataType) for k in keys])
    back = df.withColumn("_keys", F.from_json("_keys", shape))
    return back.select(*[F.col("_keys")[k].alias(k) for k in keys], *[c for c in df.columns if c != "_keys"])


def _statuses(panel: DataFrame, granularity: str, keys: Sequence[str], horizon: int | None) -> DataFrame:
    assessed = panel_forecastability(panel, keys)
    lags = 3  # the first periods of a series serve as lags only
    reason = F.coalesce(
        "reason", F.when(F.col("periods") - lags < fixed.MIN_FEATURE_ROWS, "too few periods to fit a model")
    )
    ahead = planned_horizon(granularity, F.col("max_horizon"), horizon)
    ready = F.col("status") == "forecast"
    return assessed.withColumn("status", F.coalesce(reason, F.lit("forecast"))).select(
        *keys, "granularity", "status", "periods", F.when(ready, ahead).alias("horizon"),
        F.when(ready, F.lit(horizon or 0) > F.col("max_horizon")).alias("is_capped"),
    )


def series_statuses(
    df: DataFrame, metric: Metric | str, date_column: str, granularity: str, keys: Sequence[str] = (),
    horizon: int | None = None, non_negative: bool = False, clean: bool = True,
) -> DataFrame:
    """One row for every series with a usable value: what `forecast` does with it.

    status is "forecast", or the reason why there is none; with it come the periods, the horizon that
    is forecast, and whether that is shorter than the one asked for.
    """
    rows, value, names = _series_rows(df, metric, date_column, keys, non_negative, clean)
    return _with_keys(_statuses(series_panel(rows, [value], "ts", [granularity], names), granularity, names, horizon), df, keys)


def forecast(
    df: DataFrame,
    metric: Metric | str,
    date_column: str,
    granularity: str,
    keys: Sequence[str] = (),
    horizon: int | None = None,
    non_negative: bool = False,
    clean: bool = True,
) -> DataFrame:
    """Forecast of every series that can be forecast: clean, test, resample, validate, select, predict.

    Exact copies of rows count once, gaps take the last value and impossible values go, unless `clean`
    is false. A horizon beyond what the history supports is cut, and `is_capped` says so on each row;
    `series_statuses` has a row for the other series, too. A null among the keys is a key. The series, a row
    a period, are written to the shared folder, so that raw rows are cleaned once for the test and the fits.
    """
    if horizon is not None and horizon <= 0:
        raise ValueError("forecast horizon must be a positive integer")
    rows, value, names = _series_rows(df, metric, date_column, keys, non_negative, clean)
    panel, path = series_panel(rows, [value], "ts", [granularity], names), shared_folder(df.sparkSession, "series")
    panel.write.parquet(path)
    panel = df.sparkSession.read.schema(panel.schema).parquet(path)
    ready = _with_series(_statuses(panel, granularity, names, horizon).where("status = 'forecast'"), names)
    by = _keyed(ready, names)
    features = make_features(panel.select(*names, "period", "value"), names)
    features = _with_series(features, names).join(ready.select(*by), by, "left_semi").drop(*([] if names else ["_series"]))
    selected = select_model(fitted_models(features, names), names)
    plan = plan_forecasts(None, selected, granularity, names, horizon, non_negative)
    result = forecast_fitted(plan, granularity, names)
    # capped is every series whose last step comes before the horizon asked for
    steps = F.max("step").over(Window.partitionBy(*(names or [F.lit(0)])))
    return _with_keys(result.withColumn("is_capped", F.lit(horizon or 0) > steps), df, keys)


def forecast_totals(forecasts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    total = F.round(F.sum("predicted_value"), 2)
    return forecasts.groupBy(*keys).agg(
        total.alias("total"), F.round(total / F.count("predicted_value"), 2).alias("average")
    )


def forecast_quality(plan: DataFrame) -> DataFrame:
    """Score and level of a forecast from its validation and history.

    Reads improvement_pct, history_periods, horizon, volatility_cv, missing_ratio and n_folds, one
    row per series, and keeps the other columns.
    """
    improvement, history, horizon = F.col("improvement_pct"), F.col("history_periods"), F.col("horizon")
    cv = F.col("volatility_cv")
    points = (
        F.when(improvement > 10, 0.2).when(improvement > 0, 0.05).when(improvement.isNotNull(), -0.15).otherwise(-0.1)
        + F.when(history >= 60, 0.15).when(history >= 20, 0.05).otherwise(-0.15)
        + F.when(horizon > history * 0.5, -0.15).otherwise(0.0)
        + F.when(cv >= fixed.HIGH_VOLATILITY, -0.1).when(cv < fixed.MODERATE_VOLATILITY, 0.05).otherwise(0.0)
        + F.when(F.col("missing_ratio") > 0.2, -0.1).otherwise(0.0)
        + F.when(F.col("n_folds").between(1, 2), -0.05).otherwise(0.0)
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(0.5 + points, 3)))
    level = (
        F.when(F.col("quality_score") >= 0.7, "high").when(F.col("quality_score") >= 0.45, "moderate")
        .when(F.col("quality_score") >= 0.25, "low").otherwise("unreliable")
    )
    return plan.withColumn("quality_score", score).withColumn("quality_level", level).withColumn(
        "safe_to_act_on", F.col("quality_level").isin("high", "moderate")
    )


def retrain_needed(
    current: DataFrame, runs: DataFrame, as_of: Column, keys: Sequence[str] = ("metric_key", "granularity")
) -> DataFrame:
    """Whether each current series must be fitted again, and the first reason why.

    ``current``: keys, fingerprint, row_count, newest_ts. ``runs``: the same with version and
    trained_at; only the latest version per key counts.
    """
    latest = runs.groupBy(*keys).agg(
        F.max_by(F.struct(F.col("fingerprint").alias("f"), F.col("row_count").alias("r"), F.col("newest_ts").alias("t"),
                          F.col("trained_at").alias("at")), "version").alias("run")
    )
    rows, old = F.col("row_count"), F.col("run.r")
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("run.at").cast("timestamp"))
    reason = (
        F.when(F.col("run").isNull(), "no existing model")
        .when(~F.col("run.f").eqNullSafe(F.col("fingerprint")), "dataset fingerprint changed")
        .when(F.col("newest_ts").isNotNull() & (F.col("run.t") != F.col("newest_ts")), "newest timestamp moved")
        .when(F.coalesce(old, F.lit(0)) == 0, "trained on zero rows")
        .when((rows - old) / old > fixed.RETRAIN_ROW_GROWTH, "row count grew")
        .when(rows - old > fixed.RETRAIN_NEW_ROWS, "new rows added")
        .when(F.col("run.at").isNull(), "no training time on record")
        .when(age > fixed.RETRAIN_MAX_AGE_DAYS * 86_400_000_000, "model too old")
        .otherwise("up to date")
    )
    return current.join(latest, list(keys), "left").select(
        *keys, (reason != "up to date").alias("retrain"), reason.alias("reason")
    )


def champion_challenger(
    challengers: DataFrame, champions: DataFrame, keys: Sequence[str] = ("metric_key", "granularity")
) -> DataFrame:
    """The challenger replaces the champion when its R² is at least as good; big drops are flagged."""
    new, old = F.col("challenger_r2"), F.col("champion_r2")
    joined = challengers.select(*keys, F.col("r2").alias("challenger_r2")).join(
        champions.select(*keys, F.col("r2").alias("champion_r2")), list(keys), "left"
    )
    replace = F.when(old.isNull(), True).when(new.isNull(), False).otherwise(new >= old)
    drop = F.when(old > 0, F.try_divide(old - new, F.abs(old)))
    return joined.select(
        *keys, "challenger_r2", "champion_r2", replace.alias("replaces"),
        F.coalesce(drop > fixed.CHALLENGER_R2_DROP, F.lit(False)).alias("r2_dropped"),
    )


def forecast_batch(
    df: DataFrame, metrics: Sequence[Metric], date_column: str, granularities: Sequence[str] = fixed.GRANULARITIES,
    runs: DataFrame | None = None, non_negative: Sequence[str] = (), clean: bool = True,
) -> DataFrame:
    """Validate every metric at every granularity as one panel and report what became of each.

    Each metric's rows are cleaned as for a forecast, those named in ``non_negative`` of values below zero,
    too. Status is ``error`` (no usable values), ``skipped`` (too little history), ``updated`` or ``kept``
    (an earlier run scored better). The best model is scored per (metric, granularity).
    """
    keys = ["metric_key", "granularity"]
    metrics = [as_metric(m) for m in metrics]
    if clean:
        panel = reduce(DataFrame.unionByName, [
            resample_many(
                clean_series_input(df, m, date_column, (), m.alias in non_negative), Metric("value", m.aggregation), "ts", granularities
            ).withColumn("metric_key", F.lit(m.alias)) for m in metrics
        ])
    else:
        panel = resample_metrics(df, metrics, date_column, granularities)
    features = make_features(panel, keys)
    needed = F.create_map(*[F.lit(x) for pair in fixed.MIN_PERIODS.items() for x in pair])[F.col("granularity")]
    lengths = panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("periods"))
    usable = features.groupBy(*keys).agg(F.count(F.lit(1)).alias("feature_rows"))
    counted = lengths.join(usable, keys, "left").withColumn(
        "is_ready", (F.col("periods") >= needed) & (F.coalesce("feature_rows", F.lit(0)) >= fixed.MIN_FEATURE_ROWS)
    )
    ready = features.join(counted.where("is_ready").select(*keys), keys, "left_semi")
    selected = select_model(validate_models(ready, keys), keys)
    champions = (
        runs.groupBy(*keys).agg(F.max_by("r2", "version").alias("r2")) if runs is not None
        else selected.select(*keys, "r2").where(F.lit(False))
    )
    decided = champion_challenger(selected, champions, keys)
    status = (
        F.when(F.col("periods").isNull(), "error").when(~F.col("is_ready"), "skipped").when(F.col("replaces"), "updated").otherwise("kept")
    )
    asked = F.array(*[F.struct(F.lit(m.alias).alias("metric_key"), F.lit(g).alias("granularity")) for m in metrics for g in granularities])
    every = df.sparkSession.range(1).select(F.inline(asked)).join(counted, keys, "left")
    return every.join(selected.select(*keys, "algorithm", "mae"), keys, "left").join(decided, keys, "left").select(
        *keys, status.alias("status"), F.coalesce("periods", F.lit(0).cast("bigint")).alias("periods"), "algorithm", "mae",
        F.col("challenger_r2").alias("r2"),
        F.coalesce("r2_dropped", F.lit(False)).alias("r2_dropped"),
    )


def fit_boosted_trees(features: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Test rows of every fold predicted by boosted trees, for series with at least 40 rows."""
    return model_predictions(features, keys, [fixed.BOOSTED]).drop("algorithm")
