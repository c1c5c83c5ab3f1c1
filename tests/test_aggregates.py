import math

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.numeric import parse_numeric_text
from tallyframe.operators import aggregates, ranking, timegroups
from tallyframe.operators.metrics import Metric


@pytest.fixture(scope="module")
def sales(spark):
    return spark.sql("""SELECT * FROM VALUES
        ('a', 'x', 1.0D, 2.0D, DATE '2024-01-05'), ('a', 'y', 3.0D, 6.0D, DATE '2024-01-20'),
        ('b', 'x', 4.0D, 8.0D, DATE '2024-03-02'), ('b', 'x', CAST('NaN' AS DOUBLE), 1.0D, DATE '2024-03-05'),
        (NULL, 'y', 5.0D, 10.0D, NULL), ('c', 'z', NULL, 4.0D, DATE '2024-04-01')
        AS t(shop, item, qty, price, day)""")


def test_null_keys_and_empty_groups(sales, rows):
    got = rows(aggregates.group_by_dimension(sales, "qty", "shop"), "shop")
    assert got == [{"shop": "a", "qty": 4.0}, {"shop": "b", "qty": 4.0}]
    kept = rows(aggregates.group_by_many(sales, ["qty"], ["shop"]), "shop")
    assert [r["shop"] for r in kept] == [None, "a", "b", "c"] and kept[-1]["qty"] is None


def test_spec_is_honoured_in_both_groupings(sales, rows):
    mean = Metric("qty", "mean")
    assert rows(aggregates.group_by_dimension(sales, mean, "shop"), "shop")[0]["qty"] == 2.0
    assert rows(aggregates.group_by_many(sales, [mean], ["shop"]), "shop")[1]["qty"] == 2.0


def test_week_ranges(sales, rows):
    got = rows(aggregates.group_by_many(sales, ["price"], [], date_column="day", granularity="week"), "week")
    assert got[0]["week"] is None and got[1]["week"] == "2024-01-01/2024-01-07"


def test_ratio_and_zero_base(sales, rows):
    assert rows(aggregates.ratio_of_totals(sales, "qty", "price"))[0]["ratio_pct"] == round(13 / 31 * 100, 2)
    zero = sales.withColumn("price", F.lit(0.0))
    assert rows(aggregates.ratio_of_totals(zero, "qty", "price"))[0]["ratio_pct"] is None


def test_correlation_edges(spark, rows, sales):
    got = rows(aggregates.correlation_rows(sales, "qty", "price"))[0]
    assert got["correlation"] == 1.0 and got["observations"] == 4 and got["strength"] == "strong"
    flat = spark.sql("SELECT 1.0D AS a, id * 1.0D AS b FROM range(5)")
    assert rows(aggregates.correlation_rows(flat, "a", "b"))[0]["correlation"] is None
    assert rows(aggregates.correlation_rows(flat.limit(1), "a", "b"))[0]["correlation"] is None


def test_extreme_records_need_a_tie_break(sales, rows):
    with pytest.raises(ValueError):
        aggregates.record_at_extreme(sales, "qty", [])
    assert rows(aggregates.record_at_extreme(sales, "qty", ["item", "price"], highest=False))[0]["qty"] == 1.0


def test_ties_rank_by_key_in_both_directions(sales, rows):
    top = ranking.top_n(sales, "qty", "shop", 2).collect()
    bottom = ranking.bottom_n(sales, "qty", "shop", 2).collect()
    assert [r.shop for r in top] == ["a", "b"] == [r.shop for r in bottom]


def test_nested_ranking_against_plain_python(spark, rows):
    data = spark.sql("SELECT id % 7 AS o, id % 11 AS i, pow(id % 13, 2) AS v FROM range(3000)")
    got = rows(ranking.nested_ranking(data, "v", [("o", 3), ("i", 2)]), "outer_rank", "inner_rank")
    totals, inner = {}, {}
    for n in range(3000):
        v = float((n % 13) ** 2)
        totals[n % 7] = totals.get(n % 7, 0) + v
        inner[n % 7, n % 11] = inner.get((n % 7, n % 11), 0) + v
    want = []
    for r, o in enumerate(sorted(totals, key=lambda k: (-totals[k], k))[:3], 1):
        mine = sorted((k for k in inner if k[0] == o), key=lambda k: (-inner[k], k[1]))[:2]
        want += [(r, o, totals[o], q, k[1], inner[k]) for q, k in enumerate(mine, 1)]
    assert [tuple(r.values()) for r in got] == want


@pytest.mark.parametrize("levels", [[("o", 3)], [("o", 3), ("o", 2)], [("o", 0), ("i", 2)], [("o", 3), ("i", True)]])
def test_nested_ranking_refuses(spark, levels):
    data = spark.sql("SELECT id % 7 AS o, id % 11 AS i, id AS v FROM range(10)")
    with pytest.raises(ValueError):
        ranking.nested_ranking(data, "v", levels)


def test_growth_skips_absent_months_and_zero_bases(spark, rows):
    data = spark.sql("SELECT * FROM VALUES (DATE '2024-01-01', 10.0D), (DATE '2024-03-01', 0.0D), (DATE '2024-04-01', 5.0D) AS t(d, v)")
    got = rows(timegroups.growth(data, "v", "d", "month"), "period")
    assert [(r["period"], r["growth_pct"]) for r in got] == [("2024-03", -100.0), ("2024-04", None)]


def test_iso_year_differs_from_calendar_year(spark, rows):
    data = spark.sql("SELECT DATE '2024-12-30' AS d, 1.0D AS v")
    assert rows(timegroups.metric_over_time(data, "v", "d", "week"))[0]["period"] == "2025-W01"


@pytest.mark.parametrize("text,number", [
    ("$1,200.50", 1200.5), (" 12 %", 12.0), ("0", 0.0), ("N/A", None), ("--", None), ("", None), ("€ -3", -3.0),
    ("1e3", 1000.0), ("5d", None), ("abc", None), ("-.", None), (None, None), ("inf", None),
])
def test_numeric_text(spark, text, number):
    got = spark.createDataFrame([(text,)], "t string").select(parse_numeric_text(F.col("t")).alias("n")).first().n
    assert got == number and (got is None or math.isfinite(got))


def test_requests_take_mappings_and_grouped_distinct_counts(spark):
    from tallyframe.plans.request import analyze

    df = spark.createDataFrame([("a", "x", 1, 2.0), ("a", "y", 1, 5.0), ("b", "x", 2, 3.0), ("b", "x", 3, 1.0)], "g string, h string, k long, v double")
    levels = [{"dimension": "g", "top_n": 1}, {"dimension": "h"}]
    asked = {"operation": "top", "metrics": [{"field": "v", "aggregation": "sum"}]}
    as_pairs = analyze(df, {**asked, "ranking_levels": [("g", 1), ("h", 5)]}).collect()
    assert sorted(analyze(df, {**asked, "ranking_levels": levels}).collect()) == sorted(as_pairs) and len(as_pairs) == 2
    counts = analyze(df, {"operation": "distinct_count", "field": "k", "group_by": ["g"]}).collect()
    assert {r.g: r.k for r in counts} == {"a": 1, "b": 2}
    for wrong in ({**asked, "ranking_levels": [{"top_n": 1}, {"dimension": "h"}]}, {**asked, "metrics": [{"aggregation": "sum"}], "group_by": ["g"]}):
        with pytest.raises(ValueError):
            analyze(df, wrong)
