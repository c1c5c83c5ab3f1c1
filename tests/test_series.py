import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import fitting
from tallyframe.functions import fixed_values as fixed
from tallyframe.functions.fitting import coefficients
from tallyframe.operators import forecast, insights, series
from tallyframe.operators.metrics import Metric
from tallyframe.sources import stores
from tallyframe.sources.shared import shared_folder


def daily(spark, days, value):
    return spark.sql(f"SELECT date_add(DATE '2024-01-01', CAST(id AS INT)) AS date, {value} AS v FROM range({days})")


def test_gaps_by_aggregation(spark, rows):
    df = spark.sql("SELECT * FROM VALUES (DATE '2024-01-01', 1.0D), (DATE '2024-01-04', 2.0D) AS t(d, v)")
    total = rows(series.resample(df, "v", "d", "day"), "period")
    mean = rows(series.resample(df, Metric("v", "mean"), "d", "day"), "period")
    assert [r["value"] for r in total] == [1.0, 0.0, 0.0, 2.0]
    assert [r["value"] for r in mean] == [1.0, None, None, 2.0]
    week = rows(series.resample(df, "v", "d", "week"))
    assert week == [{"period": dt.date(2024, 1, 7), "value": 3.0}]


def test_month_gap_over_year_end(spark, rows):
    df = spark.sql("SELECT * FROM VALUES (DATE '2023-11-30', 1.0D), (DATE '2024-02-29', 2.0D) AS t(d, v)")
    got = rows(series.resample(df, "v", "d", "month"), "period")
    assert [r["period"].isoformat() for r in got] == ["2023-11-01", "2023-12-01", "2024-01-01", "2024-02-01"]


def brute_fill(data):
    """Forward then backward over (ts, empty last, id)."""
    out, last = {}, None
    order = sorted(data, key=lambda r: (r[1], r[2] is None, r[0]))
    for i, _, v in order:
        last = v if v is not None else last
        out[i] = last
    first = next((v for *_, v in order if v is not None), None)
    return {i: first if v is None else v for i, v in out.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fill_matches_a_plain_walk(spark, seed):
    rng = np.random.default_rng(seed)
    start = dt.datetime(2024, 1, 1)
    data = []
    for i in range(300):
        # Few distinct moments, one of them with a third of all rows.
        offset = 5000 if i % 3 == 0 else int(rng.integers(0, 400_000))
        micro = int(rng.integers(0, 3)) * 250_000
        value = None if rng.random() < 0.5 else float(rng.integers(0, 100))
        data.append((i, start + dt.timedelta(seconds=offset, microseconds=micro if i % 3 else 0), value))
    df = spark.createDataFrame(data, "id int, ts timestamp_ntz, v double")
    got = {r.id: r.v for r in series.forward_back_fill(df, "ts", ["v"], [], ["id"]).collect()}
    assert got == brute_fill(data)


def test_cleaning_drops_copies_bad_dates_and_negatives(spark, rows):
    df = spark.sql("""SELECT * FROM VALUES ('2024-01-01', 5.0D), ('2024-01-01', 5.0D), ('never', 9.0D), ('2024-01-02', NULL),
        ('2024-01-03', -4.0D), ('2024-01-04', CAST('Infinity' AS DOUBLE)) AS t(d, v)""")
    got = rows(series.clean_series_input(df, "v", "d", non_negative=True, tie_break=["v"]), "ts")
    assert [(r["ts"].day, r["value"]) for r in got] == [(1, 5.0), (2, 5.0)]
    texts = spark.sql("SELECT '2024-01-01' AS d, 'scan-1' AS v UNION ALL SELECT '2024-01-02', NULL")
    assert rows(series.clean_series_input(texts, Metric("v", "nunique"), "d"))[0]["value"] == "scan-1"


@pytest.mark.parametrize("days,value,expected", [
    (60, "id * 1.0D", {"day": None, "week": None, "month": "too few periods"}),
    (40, "7.0D", {"day": "flat series", "week": None, "month": "too few periods"}),
    (10, "id * 1.0D", {"day": "too few periods", "week": "too few periods", "month": "too few periods"}),
    (60, "IF(id % 10 = 0, id * 1.0D, 0D)", {"day": "mostly zero", "week": None, "month": "too few periods"}),
])
def test_forecastability(spark, rows, days, value, expected):
    got = rows(series.forecastability(daily(spark, days, value), "v", "date"))
    reasons = {r["granularity"]: r["reason"] for r in got}
    # A flat daily series still varies by week where the first or last week is cut.
    reasons = {g: r for g, r in reasons.items() if not (value == "7.0D" and g == "week")}
    assert reasons == {g: r for g, r in expected.items() if g in reasons}


def test_regressions_match_closed_forms():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(40, 3)), rng.normal(size=40)
    slope, intercept = coefficients(x, y, fixed.LINEAR)
    full = np.linalg.lstsq(np.column_stack([np.ones(40), x]), y, rcond=None)[0]
    assert np.allclose([intercept, *slope], full)
    slope, intercept = coefficients(x, y, fixed.RIDGE)
    c = x - x.mean(axis=0)
    want = np.linalg.inv(c.T @ c + np.eye(3)) @ c.T @ (y - y.mean())
    assert np.allclose(slope, want) and np.isclose(intercept, y.mean() - x.mean(axis=0) @ want)


def test_folds_end_the_series(spark, rows):
    features = series.make_features(series.resample(daily(spark, 33, "id * 1.0D"), "v", "date", "day"))
    got = rows(forecast.time_folds(features).groupBy("fold").agg(
        F.sum(F.col("is_train").cast("int")).alias("train"), F.sum((~F.col("is_train")).cast("int")).alias("test")), "fold")
    assert [(r["train"], r["test"]) for r in got] == [(5, 5), (10, 5), (15, 5), (20, 5), (25, 5)]


def test_linear_trend_is_continued(spark, rows):
    df = daily(spark, 80, "100 + 2.0D * id")
    got = rows(forecast.forecast(df, "v", "date", "day", horizon=4, non_negative=True), "step")
    assert [r["period"].isoformat() for r in got] == ["2024-03-21", "2024-03-22", "2024-03-23", "2024-03-24"]
    assert all(r["algorithm"] in (fixed.LINEAR, fixed.RIDGE) for r in got)
    assert [r["predicted_value"] for r in got] == pytest.approx([260, 262, 264, 266], abs=0.5)
    assert all(r["lower_bound"] <= r["predicted_value"] <= r["upper_bound"] for r in got)


def test_horizon_is_capped_and_checked(spark):
    df = daily(spark, 40, "pow(id % 7, 2) * 1.0D")
    assert forecast.forecast(df, "v", "date", "day", horizon=500).count() == 20
    with pytest.raises(ValueError):
        forecast.forecast(df, "v", "date", "day", horizon=0)


def test_forecast_of_many_series_and_clipping(spark, rows):
    df = spark.sql("""SELECT k, date_add(DATE '2024-01-01', CAST(id AS INT)) AS date, greatest(0D, 50 - id) * (k + 1) AS v
        FROM range(60) CROSS JOIN (SELECT explode(array(0, 1, 2)) AS k)""")
    got = rows(forecast.forecast(df, "v", "date", "day", ["k"], 3, non_negative=True))
    assert len(got) == 9 and all(r["predicted_value"] >= 0 and r["lower_bound"] >= 0 for r in got)


def test_error_metrics_by_hand(spark, rows):
    df = spark.sql("SELECT * FROM VALUES (0.0D, 0.0D), (2.0D, 1.0D), (4.0D, 6.0D) AS t(actual, predicted)")
    got = rows(forecast.error_metrics(df))[0]
    assert got["mae"] == 1.0 and got["rmse"] == pytest.approx((5 / 3) ** 0.5) and got["r2"] == pytest.approx(1 - 5 / 8)
    assert got["smape"] == pytest.approx((2 / 3 + 4 / 10) / 2 * 100) and got["wape"] == 50.0


def test_run_versions_grow(spark, rows):
    path = shared_folder(spark, "test-runs")
    runs = spark.sql("SELECT 'f' AS fingerprint, m AS metric_key, 'day' AS granularity, 0.5D AS r2 FROM VALUES ('a'), ('b') AS t(m)")
    stores.append_runs(runs, path)
    stores.append_runs(runs.where("metric_key = 'a'"), path)
    got = rows(stores.read_runs(spark, path), "metric_key", "version")
    assert [(r["metric_key"], r["version"]) for r in got] == [("a", 1), ("a", 2), ("b", 1)]


def test_seasonality_and_anomalies(spark, rows):
    wave = daily(spark, 48, "IF(id % 6 = 0, 10.0D, 1.0D)").select(F.col("date").alias("period"), F.col("v").alias("value"))
    found = rows(insights.seasonality(wave))[0]
    assert found["is_seasonal"] and found["season_periods"] == 6.0
    flat = wave.withColumn("value", F.lit(3.0))
    assert rows(insights.seasonality(flat))[0] == {"is_seasonal": False, "season_periods": None, "season_strength": None}
    assert rows(insights.anomalies(flat)) == []
    spike = wave.withColumn("value", F.when(F.col("period") == "2024-01-20", 500.0).otherwise(F.lit(3.0)))
    assert [r["period"].day for r in rows(insights.anomalies(spike))] == [20]


def test_recommendations(spark, rows):
    df = spark.sql("""SELECT * FROM VALUES (1, 'net_revenue', 'increasing', 20.0D, 'high'), (2, 'score_sold', 'decreasing', -20.0D, 'high'),
        (3, 'spend', 'stable', 0.0D, 'unreliable'), (4, 'downtime', 'decreasing', -5.0D, 'low') AS t(id, field, direction, forecast_change_pct, quality_level)""")
    got = [(r["id"], r["category"], r["priority"], r["needs_review"]) for r in rows(insights.recommendation_rules(df), "id", "kind")]
    assert got == [
        (1, "cash_flow_preparation", "high", False), (2, "data_collection", "low", True),
        (3, "no_action_monitoring", "low", False), (3, "data_collection", "high", True),
        (4, "no_action", "medium", True), (4, "data_collection", "medium", True),
    ]


def test_forecast_cleans_gates_and_reports(spark, rows):
    days = [(f"2024-01-{d:02d}", k, float(10 + d % 4)) for d in range(1, 29) for k in ("a", None)]
    flat = [(f"2024-01-{d:02d}", "flat", 5.0) for d in range(1, 29)]
    short = [(f"2024-01-{d:02d}", "short", float(d)) for d in range(1, 7)]
    df = spark.createDataFrame(days + flat + short, "date string, k string, v double")
    once = rows(forecast.forecast(df, "v", "date", "day", ["k"], 20), "k", "step")
    twice = rows(forecast.forecast(df.union(df), "v", "date", "day", ["k"], 20), "k", "step")
    assert once == twice and {r["k"] for r in once} == {"a", None}
    assert all(r["is_capped"] for r in once) and max(r["step"] for r in once) == 14
    status = {r["k"]: (r["status"], r["horizon"]) for r in rows(forecast.series_statuses(df, "v", "date", "day", ["k"], 20))}
    assert status == {"a": ("forecast", 14), None: ("forecast", 14), "flat": ("flat series", None), "short": ("too few periods", None)}


def test_moments_merge_and_solve_like_all_rows_at_once():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 6)) * [1, 1000, 1e6, 1e-3, 1, 1] + [0, 5e4, 1e7, 0, 2024, 3]
    x[:, 4] = 2024  # no spread
    x[:, 5] = 2 * x[:, 0] - x[:, 1] / 1000  # follows from others
    y = rng.normal(size=50) * 10 + x[:, 1] / 100
    parts = [fitting.Moments.of(x[a:b], y[a:b]) for a, b in ((0, 0), (0, 7), (7, 8), (8, 30), (30, 50))]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.merge(part)
    whole = fitting.Moments.of(x, y)
    assert merged.n == 50 and np.allclose(merged.mean, whole.mean, rtol=1e-12) and np.allclose(merged.products, whole.products, rtol=1e-9)
    centre = x.mean(axis=0)
    for moments in (merged, whole):
        slope, intercept = moments.solve(fixed.LINEAR)
        assert np.allclose(slope, np.linalg.lstsq(x - centre, y - y.mean(), rcond=1e-13)[0], rtol=1e-5, atol=1e-12)
        assert np.isclose(intercept, y.mean() - centre @ slope)
    few = fitting.Moments.of(x[:4], y[:4])  # fewer rows than features: the shortest slope
    assert np.allclose(x[:4] @ few.solve(fixed.LINEAR)[0] + few.solve(fixed.LINEAR)[1], y[:4])


def plain_boost(x, y, n, rounds=100):
    """Boosted trees of one fit, row by row and split by split."""
    raw = np.full(len(x), y[:n].mean())
    edges = [fitting.bin_edges(x[:n, f]) for f in range(x.shape[1])]

    def grow(rows, depth, gradient):
        total = gradient[rows].sum()
        best = (total * total / len(rows), None, None)
        if depth < 4 and len(rows) >= 40:
            for f in range(x.shape[1]):
                for edge in edges[f]:
                    left = rows[x[rows, f] <= edge]
                    if min(len(left), len(rows) - len(left)) < 20:
                        continue
                    a = gradient[left].sum()
                    gain = a * a / len(left) + (total - a) ** 2 / (len(rows) - len(left))
                    if gain > best[0] * (1 + 1e-12) + 1e-12:
                        best = (gain, f, edge)
        if best[1] is None:
            value = -0.1 * total / len(rows)
            return lambda row: value
        _, f, edge = best
        low, high = grow(rows[x[rows, f] <= edge], depth + 1, gradient), grow(rows[x[rows, f] > edge], depth + 1, gradient)
        return lambda row: low(row) if row[f] <= edge else high(row)

    for _ in range(rounds):
        tree = grow(np.arange(n), 0, (raw - y).astype(np.float32).astype(float))
        raw = raw + np.array([tree(row) for row in x])
    return raw


@pytest.mark.parametrize("seed", [0, 1])
def test_boosting_equals_a_plain_loop(seed):
    rng = np.random.default_rng(seed)
    fits = []
    for size, train in ((30, 25), (50, 40), (90, 75), (170, 150), (60, 60)):
        x = rng.normal(size=(size, 4))
        x[:, 1] = rng.integers(0, 5, size)
        x[:, 2] = 3.0
        fits.append((x, np.sin(3 * x[:, 0]) + x[:, 1] + rng.normal(size=size) / 5, train))
    predictions, trees = fitting.boost(fits, keep=True, rounds=12)
    for (x, y, n), got, tree in zip(fits, predictions, trees):
        assert np.allclose(got, plain_boost(x, y, n, 12), atol=1e-6)
        assert np.allclose([tree.predict(row) for row in x], got, atol=1e-9)
    alone = [fitting.boost([f], rounds=12)[0][0] for f in fits]
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(alone, predictions))
    assert np.abs(predictions[3] - fits[3][1])[:150].mean() < np.abs(fits[3][1] - fits[3][1][:150].mean())[:150].mean()


def test_many_values_are_binned_by_percentiles():
    values = np.random.default_rng(3).normal(size=5000)
    edges = fitting.bin_edges(values)
    assert len(edges) == fixed.BOOSTING_BINS - 1 and np.bincount(np.searchsorted(edges, values)).max() < 40
    assert fitting.bin_edges(np.array([1.0, 1.0, 2.0, 4.0])).tolist() == [1.5, 3.0]


@pytest.fixture(scope="module")
def panel(spark):
    """Series with steps, trends, a constant, and few rows."""
    return spark.sql("""SELECT k, date_add(DATE '2024-01-01', CAST(id AS INT)) AS date, CASE k WHEN 'step' THEN IF(id % 9 < 4, 50.0D, 10.0D) + id % 3
        WHEN 'trend' THEN 5.0D * id + id % 4 WHEN 'flat' THEN 7.0D WHEN 'wave' THEN 100 + 40 * sin(id / 3.0D) ELSE id * id % 17 * 1.0D END AS v
      FROM range(130) CROSS JOIN (SELECT explode(array('step', 'trend', 'flat', 'wave', 'short', CAST(NULL AS STRING))) AS k)
      WHERE coalesce(k, '') != 'short' OR id < 30""")


def test_one_pass_scores_equal_scores_by_copied_folds(spark, rows, panel):
    features = series.make_features(series.resample(panel, "v", "date", "day", ["k"]), ["k"])
    got = {(r["k"], r["algorithm"]): r for r in rows(forecast.validate_models(features, ["k"]))}
    folds = forecast.time_folds(features, ["k"])
    for r in rows(forecast.cv_scores(forecast.baseline_predictions(folds, ["k"]), ["k"])):
        assert got[r["k"], r["algorithm"]] == r
    predictions = forecast.model_predictions(features, ["k"], fixed.MODELS)
    for r in rows(forecast.cv_scores(predictions, ["k"])):
        assert {k: pytest.approx(v, abs=1e-3) if v is not None else None for k, v in r.items() if k not in ("k", "algorithm")} == {
            k: v for k, v in got[r["k"], r["algorithm"]].items() if k not in ("k", "algorithm")}
    assert {k for k, a in got if a == fixed.BOOSTED} == {"step", "trend", "wave", None}  # not short ones, not constant ones
    assert {a for k, a in got if k == "flat"} == {fixed.NAIVE, fixed.SEASONAL}
    with pytest.raises(ValueError):
        forecast.model_predictions(features, ["k"], ["magic"])
    # the regressions against least squares on the copied rows of each fold
    copied = folds.where("k = 'wave'").toPandas().sort_values(["fold", "period"])
    for algorithm in (fixed.LINEAR, fixed.RIDGE):
        found = predictions.where("k = 'wave'").where(F.col("algorithm") == algorithm).toPandas().sort_values(["fold", "period"])
        for fold, part in copied.groupby("fold"):
            x, y = part[list(fixed.FEATURE_COLUMNS)].to_numpy(float), part["value"].to_numpy(float)
            train = part["is_train"].to_numpy(bool)
            centre = x[train].mean(axis=0)
            if algorithm == fixed.LINEAR:
                slope = np.linalg.lstsq(x[train] - centre, y[train] - y[train].mean(), rcond=1e-12)[0]
            else:
                square = (x[train] - centre).T @ (x[train] - centre) + np.eye(x.shape[1])
                slope = np.linalg.solve(square, (x[train] - centre).T @ (y[train] - y[train].mean()))
            want = (x[~train] - centre) @ slope + y[train].mean()
            assert np.allclose(found.loc[found["fold"] == fold, "predicted"], want, rtol=1e-4, atol=1e-3)


def test_boosted_trees_are_chosen_and_forecast(spark, rows, panel):
    features = series.make_features(series.resample(panel, "v", "date", "day", ["k"]), ["k"])
    fitted = forecast.select_model(forecast.fitted_models(features, ["k"]), ["k"])
    plan = forecast.plan_forecasts(None, fitted, "day", ["k"], 5, True)
    again = forecast.plan_forecasts(features, forecast.select_model(forecast.validate_models(features, ["k"]), ["k"]), "day", ["k"], 5, True)
    chosen = {r["k"]: r for r in rows(plan)}
    assert chosen["step"]["algorithm"] == fixed.BOOSTED
    assert [{c: r[c] for c in ("k", "algorithm", "periods", "history_periods", "horizon")} for r in rows(plan.where("k IS NOT NULL"), "k")] == [
        {c: r[c] for c in ("k", "algorithm", "periods", "history_periods", "horizon")} for r in rows(again, "k")]
    got, want = rows(forecast.forecast_fitted(plan, "day", ["k"]), "k", "step"), rows(forecast.forecast_recursive(features, again, "day", ["k"]), "k", "step")
    assert len(got) == 30 and [r for r in got if r["k"]] == want
    ahead = [r["predicted_value"] for r in got if r["k"] == "step"]
    assert min(ahead) >= 0 and max(ahead) < 70, ahead
    whole = rows(forecast.forecast(panel, "v", "date", "day", ["k"], horizon=5, non_negative=True, clean=False).drop("is_capped"), "k", "step")
    assert whole == [r for r in got if r["k"] != "flat"]


def test_series_in_batches_of_any_size():
    import pyarrow as pa

    rows = pa.table({"k": pa.array(["a"] * 5 + [None] * 3 + ["b"] + ["c"] * 7), "v": list(range(16))})
    for size in range(1, 18):
        for limit in (1, 4, 100):
            seen = []

            def run(part, starts, seen=seen):
                assert starts[0] == 0 and starts[-1] == len(part)
                seen += [part.column("v").to_pylist()[a:b] for a, b in zip(starts, starts[1:])]
                return part

            out = list(fitting.in_batches(iter(rows.to_batches(max_chunksize=size)), ["k"], run, limit))
            assert seen == [[0, 1, 2, 3, 4], [5, 6, 7], [8], [9, 10, 11, 12, 13, 14, 15]]
            assert sum(map(len, out)) == 16


def test_periods_come_from_days_once(spark, rows):
    import re

    df = spark.sql("""SELECT CAST(id % 3 AS INT) AS k, timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS ts,
        IF(id % 11 = 0, NULL, id * 1.0D) AS v, IF(id % 13 = 0, NULL, concat('u', id % 29)) AS u FROM range(2000)""").cache()
    metrics = [Metric("v"), Metric("v", "mean", "mean"), Metric("v", "min", "low"), Metric("v", "max", "high"), Metric("u", "count", "n"), Metric("u", "nunique", "d")]
    panel = series.resample_metrics(df, metrics, "ts", keys=["k"])
    got = {(r["k"], r["metric_key"], r["granularity"], r["period"]): r["value"] for r in rows(panel)}
    frame = df.toPandas()
    starts = {"day": frame["ts"].dt.date, "week": (frame["ts"].dt.to_period("W-SUN").dt.end_time).dt.date, "month": frame["ts"].dt.to_period("M").dt.start_time.dt.date}
    for granularity, start in starts.items():
        for (k, period), part in frame.groupby([frame["k"], start]):
            want = {"v": part.v.sum(), "mean": part.v.mean(), "low": part.v.min(), "high": part.v.max(), "n": part.u.count(), "d": part.u.nunique()}
            for name, value in want.items():
                assert got[k, name, granularity, period] == pytest.approx(value), (k, name, granularity, period)
    plan = series.resample_metrics(df.select("*"), metrics[:5], "ts", keys=["k"])._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    generate = next(i for i, line in enumerate(lines) if "Generate inline" in line)
    assert any("Aggregate" in line for line in lines[generate:]) and len(re.findall("InMemoryRelation", plan)) == 1
    lone = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 05:00:00' + make_dt_interval(0, CAST(id AS INT)) AS d, id * 1.0D AS v FROM range(12)")
    assert {r["reason"] for r in rows(series.forecastability(lone, "v", "d"))} == {"span under one day"}


def test_batches_clean_and_report_every_metric(spark, rows, tmp_path):
    df = spark.sql("""SELECT date_add(DATE '2024-01-01', CAST(id AS INT)) AS d, IF(id % 9 = 0, -1.0D, id % 7 + 1.0D) AS v, CAST(NULL AS DOUBLE) AS none,
        concat('c', id % 5) AS who FROM range(80)""")
    metrics = [Metric("v"), Metric("none"), Metric("who", "nunique", "people")]
    once, twice = (forecast.forecast_batch(x, metrics, "d", ["day", "month"], non_negative=["v"]) for x in (df, df.union(df)))
    got = {(r["metric_key"], r["granularity"]): r for r in rows(once)}
    assert got == {(r["metric_key"], r["granularity"]): r for r in rows(twice)}  # exact copies count once
    assert {k: r["status"] for k, r in got.items()} == {
        ("v", "day"): "updated", ("v", "month"): "skipped", ("none", "day"): "error", ("none", "month"): "error",
        ("people", "day"): "updated", ("people", "month"): "skipped"}
    assert got["v", "day"]["periods"] == 79 and got["none", "day"]["periods"] == 0  # the first day is below zero and goes
    assert stores.append_batch(once, df, f"{tmp_path}/log") == 1
    logged = rows(stores.read_runs(spark, f"{tmp_path}/log"))
    assert {r["metric_key"] for r in logged} == {"v", "people"} and {r["rows"] for r in logged} == {80}


def test_trees_grow_in_groups_of_like_sizes():
    import numpy as np

    from tallyframe.functions import fitting

    sizes = [40, 300, 41, 55, 56, 900, 40, 81, 60]
    groups = list(fitting._alike(sizes, 130))
    assert sorted(i for group in groups for i in group) == list(range(len(sizes)))
    for group in groups:
        low, high = min(sizes[i] for i in group), max(sizes[i] for i in group)
        assert len(group) == 1 or (3 * high <= 4 * low and len(group) * high <= 130)
    rng = np.random.default_rng(8)
    fits = [(rng.integers(0, 30, (n + 5, len(fitting.FEATURES))).astype(float), rng.normal(9, 4, n + 5), n) for n in [*sizes, 12]]
    together, trees = fitting.boost(fits, keep=True, rounds=12)
    for fit, predicted, own in zip(fits, together, trees):
        (alone,), (tree,) = fitting.boost([fit], keep=True, rounds=12)
        assert np.array_equal(predicted, alone) and np.array_equal(own.feature, tree.feature) and np.array_equal(own.value, tree.value)


def test_forecast_cleans_raw_rows_once(spark):
    import datetime
    import os

    from tallyframe.operators.forecast import forecast
    from tallyframe.sources.shared import shared_root

    day = datetime.datetime(2020, 1, 1)
    frame = spark.createDataFrame([(k, day + datetime.timedelta(days=30 * i), float(i % 7 + k)) for k in (1, 2) for i in range(30)], "k int, at timestamp, v double")
    root = shared_root(spark).removeprefix("file:")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    result = forecast(frame, "v", "at", "month", ["k"], horizon=3)
    assert sum(name.startswith("series-") for name in set(os.listdir(root)) - before) == 1
    assert "Scan ExistingRDD" not in result._jdf.queryExecution().executedPlan().toString()
    assert {(r.k, r.step) for r in result.collect()} == {(k, s) for k in (1, 2) for s in (1, 2, 3)}
