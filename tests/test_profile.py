import statistics

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import catalogue, frequencies, profile
from tallyframe.sources import stores
from tallyframe.sources.shared import shared_folder


def profiled(df, rows, **options):
    return {r["column"]: r for r in rows(profile.profile_columns(df, **options))}


@pytest.fixture(scope="module")
def sales(spark):
    return spark.sql("""SELECT date_format(date_add(DATE '2023-01-01', CAST(id AS INT)), 'yyyy-MM-dd') AS date,
        CAST(id * 3 AS DOUBLE) + 0.25 AS revenue, CAST(id % 17 AS INT) AS units, element_at(array('north', 'south'), CAST(id % 2 AS INT) + 1) AS region,
        concat('o', id) AS order_id, id AS row_nr, id % 2 = 0 AS paid, CAST(id AS DECIMAL(10,2)) AS price, array(id) AS tags FROM range(150)""")


def test_types_of_a_sales_table(sales, rows):
    got = profiled(sales, rows)
    kinds = {c: r["semantic_type"] for c, r in got.items()}
    assert kinds == {
        "date": "datetime", "revenue": "monetary", "units": "discrete_numeric", "region": "geographic", "order_id": "identifier",
        "row_nr": "identifier", "paid": "boolean", "price": "monetary", "tags": "unknown",
    }
    assert got["revenue"]["median"] == statistics.median(i * 3 + 0.25 for i in range(150))
    assert got["revenue"]["std"] == pytest.approx(statistics.stdev(i * 3 + 0.25 for i in range(150)))
    assert got["paid"]["mean"] == 0.5 and got["tags"]["missing_count"] == 0


def test_dates_are_ranked(sales, rows):
    ranked = rows(profile.rank_date_columns(profile.profile_columns(sales)))
    assert [(r["column"], r["is_primary"]) for r in ranked] == [("date", True)]
    assert ranked[0]["score"] == round(0.45 + 0.2 + 0.2 * min(149 / 365, 1) + 0.15, 4)


def test_empty_and_null_tables(spark, rows):
    empty = spark.createDataFrame([], "a int, b string, d timestamp")
    assert rows(profile.profile_shape(empty))[0] == {"row_count": 0, "column_count": 0, "warning": "dataset is empty"}
    got = profiled(empty, rows)
    assert len(got) == 3 and all(r["unique_count"] == 0 and r["row_count"] == 0 for r in got.values())
    nulls = spark.sql("SELECT CAST(NULL AS INT) AS a, CAST(NULL AS STRING) AS b FROM range(4)")
    assert all(r["missing_ratio"] == 1.0 and r["is_constant"] for r in profiled(nulls, rows).values())


@pytest.mark.parametrize("size", [1, 2, 9, 1000, 1001])
def test_median_is_exact(spark, size):
    values = [((i * 7919) % 101) ** 2 / 8 for i in range(size)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    assert frequencies.medians(frequencies.value_frequencies(df)).first()["median"] == statistics.median(values)


def test_steady_metric_is_no_identifier(spark, rows):
    df = spark.sql("SELECT id * 2 AS level, id AS nr, id * 1.5D AS half FROM range(100)")
    got = profiled(df, rows, with_medians=False)
    assert [got[c]["is_identifier"] for c in ("level", "nr", "half")] == [False, True, False]


def test_short_codes_are_no_dates(spark, rows):
    df = spark.sql("SELECT concat('M', lpad(id, 2, '0')) AS machine FROM range(30)")
    assert rows(profile.date_parse_rate(df))[0]["date_parse_rate"] == 0.0


def test_long_texts_are_told_apart_by_their_ends(spark, rows):
    df = spark.sql("SELECT concat(repeat('a', 300), id % 2) AS t FROM range(10)")
    assert profiled(df, rows)["t"]["unique_count"] == 2
    assert [len(r["sample"]) for r in rows(profile.profile_samples(df))] == [301, 301]
    lookalike = spark.sql("SELECT concat('sha256:', repeat('b', 64)) AS t")
    assert rows(profile.profile_samples(lookalike))[0]["sample"] == "sha256:" + "b" * 64


def test_catalogue_rules(spark, rows):
    df = spark.sql("SELECT id % 50 - 2.0D AS quantity, id % 50 - 25.0D AS profit, (id % 10) / 10 AS rate, id % 7 AS level FROM range(500)")
    got = {r["metric_key"]: r for r in rows(catalogue.metric_catalogue(profile.profile_columns(df)))}
    assert got["quantity"]["non_negative"] and not got["profit"]["non_negative"]
    assert got["rate"]["semantic_type"] == "percentage" and got["rate"]["default_aggregation"] == "mean"
    assert got["level"]["needs_confirmation"] and got["level"]["additive"]


def test_fingerprint_ignores_row_order_and_sees_schema(spark):
    df = spark.sql("SELECT id, id * 1.5D AS v FROM range(100)")
    key = lambda d: catalogue.dataset_fingerprint(d).first().fingerprint
    assert key(df) == key(df.orderBy(F.col("id").desc()))
    assert len({key(df), key(df.withColumn("w", F.lit(1))), key(df.where("id > 3"))}) == 3
    assert key(df.where("id < 0")) == "empty"


def test_store_replaces_one_dataset_only(spark):
    path = shared_folder(spark, "test-profiles")
    first, second = spark.sql("SELECT id AS a FROM range(5)"), spark.sql("SELECT id AS a, 1 AS b FROM range(5)")
    for df in (first, second, first):
        stores.write_profile_store(df, path)
    assert stores.read_profile_store(spark, path).count() == 3
    key = catalogue.dataset_fingerprint(second).first().fingerprint
    assert stores.read_profile_store(spark, path, key).count() == 2


def test_find_value_counts_hot_values_once(spark, rows):
    df = spark.sql("SELECT CASE WHEN id % 3 = 0 THEN ' New  Delhi ' ELSE 'x' END AS city, 'new delhi' AS other FROM range(30)")
    terms = spark.createDataFrame([("NEW DELHI",), ("Rome",)], "term string")
    got = rows(catalogue.find_value_columns(df, terms), "column")
    assert [(r["column"], r["row_count"]) for r in got] == [("city", 10), ("other", 30)]


def test_top_values_of_any_column_and_whole_texts(spark):
    from tallyframe.operators import catalogue

    long = "x" * 300
    many = spark.createDataFrame([(i, long if i % 3 else "short") for i in range(150)], "k long, t string")
    found = catalogue.top_values(many, limit=4).collect()
    keys = [r for r in found if r["column"] == "k"]
    assert len(keys) == 4 and keys[0].unique_count == 150 and not keys[0].is_complete
    assert {(r.value, r.n) for r in found if r["column"] == "t"} == {(long, 100), ("short", 50)}
    values = {r["column"]: r.example_values for r in catalogue.dimension_values(many, ["t"]).collect()}
    assert values == {"t": ["short", long]}


def test_correlation_of_all_pairs(spark):
    from tallyframe.operators import catalogue

    wide = spark.range(50).select(*[((F.col("id") * (i + 3)) % (i + 7)).cast("double").alias(f"c.{i}") for i in range(9)])
    found = catalogue.correlation_matrix(wide).collect()
    assert len(found) == 36 and all(r.observations == 50 for r in found)


def test_correlations_of_many_columns_with_gaps(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(9)
    data = rng.normal(size=(400, 60))
    data[:, 1] = data[:, 0] * 3 + rng.normal(size=400) / 9
    data[:, 2] += 1e9  # large values with small differences
    data[:, 3] = 1e9 + data[:, 2] * 2 - 2e9
    data[:, 4] = 5.1  # no variance
    data[rng.random(data.shape) < 0.2] = np.nan
    data[:, 5] = np.where(np.arange(400) < 300, 7.7, np.nan)
    data[:, 6] = np.where(np.arange(400) < 300, np.nan, data[:, 7])  # never beside column 5
    frame = pd.DataFrame(data, columns=[f"c.{i}" for i in range(60)])
    df = spark.createDataFrame(frame).repartition(5)
    found = catalogue.correlation_matrix(df)
    got = {(r.first_column, r.second_column): (r.correlation, r.observations) for r in found.collect()}
    want, there = frame.corr(), frame.notna().astype(int)
    both = there.T @ there
    for i in range(60):
        for j in range(i + 1, 60):
            a, b = f"c.{i}", f"c.{j}"
            if i in (4, 5) or j in (4, 5) or both.loc[a, b] < 2:
                assert (a, b) not in got
            else:
                assert got[a, b] == (pytest.approx(want.loc[a, b], abs=2e-4), both.loc[a, b]), (a, b)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    with pytest.raises(ValueError):
        catalogue.correlation_matrix(df.select("`c.1`"))


def test_values_in_columns_with_dots(spark, rows):
    df = spark.createDataFrame([("Red", "x"), ("red ", "y")], "`a.b` string, c string")
    terms = spark.createDataFrame([("RED",)], "term string")
    assert rows(catalogue.find_value_columns(df, terms)) == [{"term": "RED", "column": "a.b", "row_count": 2}]


@pytest.mark.parametrize("values", [
    [1.0], [1.0, 2.0], [0.0, -0.0, 5.0], [-3.0, -1e300, 1e-310, 1e300], [1e9 + i for i in range(7)], [5.0] * 9 + [6.0], [-2.0, -1.0],
    [float(2**i) for i in range(-20, 21)], [0.1 + 0.2, 0.3], [1.0, 1.0000000000000002, 1.0000000000000004, 1.0000000000000007],
])
def test_medians_of_odd_values(spark, values):
    df = spark.createDataFrame([(v, float(i)) for i, v in enumerate(values)], "a double, b double")
    got = {r["column"]: r["median"] for r in profile.profile_columns(df).collect()}
    assert got["a"] == pytest.approx(statistics.median(values), rel=1e-15, abs=0) and got["b"] == statistics.median(range(len(values)))


def test_medians_of_a_million_values_need_no_large_task(spark):
    df = spark.sql("SELECT pow(id % 1000003 / 7.0D, 3) - 1e6 AS a, CAST(id % 3 AS DOUBLE) AS b FROM range(0, 1000003, 1, 4)")
    spark.sparkContext.setJobGroup("medians", "")
    found = frequencies.medians(frequencies.value_frequencies(df, ["a", "b"]))
    got = {r["column"]: r["median"] for r in found.collect()}
    assert got["a"] == pytest.approx((500001 / 7.0) ** 3 - 1e6, rel=1e-12) and got["b"] == 1.0
    # no sort of values: what windows see are counts of at most RANGES ranges
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" not in plan and "rangepartitioning" not in plan
    counted = found._jdf.queryExecution().optimizedPlan().toString()
    assert counted.count("Window") >= 5 and counted.count("Aggregate") >= 6


def test_sketched_medians(spark):
    df = spark.range(100_001).selectExpr("CAST(id AS DOUBLE) AS v", "CAST(NULL AS DOUBLE) AS w", "'x' AS t")
    got = {r["column"]: r["median"] for r in profile.profile_columns(df, median_accuracy=1000).collect()}
    assert abs(got["v"] - 50_000) <= 150 and got["w"] is None and got["t"] is None
