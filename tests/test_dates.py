"""Dates of many forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import dates


@pytest.mark.parametrize("text, day_first, want", [
    ("2024-01-31", False, dt.datetime(2024, 1, 31)), ("31/01/2024", False, dt.datetime(2024, 1, 31)), ("01/02/2024", False, dt.datetime(2024, 1, 2)),
    ("01/02/2024", True, dt.datetime(2024, 2, 1)), ("1.12.2024 7:05", True, dt.datetime(2024, 12, 1, 7, 5)), ("12-13-2024", True, dt.datetime(2024, 12, 13)),
    ("Jan 5, 2024", False, dt.datetime(2024, 1, 5)), ("5th September 2024", False, dt.datetime(2024, 9, 5)), ("5-Sept-2024 23:59:58", False, dt.datetime(2024, 9, 5, 23, 59, 58)),
    ("2024/3/9", False, dt.datetime(2024, 3, 9)), (" May 1 1999 ", True, dt.datetime(1999, 5, 1)), ("31/02/2024", True, None), ("13/13/2024", False, None),
    ("Jax 5, 2024", False, None), ("M01", False, None), ("", False, None), (None, False, None), ("Ma 5 2024", False, None),
])
def test_texts_and_what_they_mean(spark, text, day_first, want):
    row = spark.createDataFrame([(text,)], "t string").select(dates.parse_mixed(F.col("t"), F.lit(day_first)).alias("d")).first()
    assert row.d == want


def test_order_comes_from_values_that_only_one_allows(spark, rows):
    df = spark.createDataFrame([("31/01/2024", "01/31/2024", "x"), ("02/03/2024", "02/03/2024", None), (None, "2024-05-06", "Jan 5, 2024"), ("junk", "", "y")],
                               "`a.b` string, b string, c string")
    got = {r["column"]: r for r in rows(dates.mixed_date_rate(df))}
    assert (got["a.b"]["day_first"], got["b"]["day_first"]) == (True, False)
    assert got["a.b"]["date_parse_rate"] == pytest.approx(2 / 3) and got["b"]["date_parse_rate"] == 0.75 and not got["c"]["is_date_column"]
    assert got["a.b"]["last_date"] == dt.datetime(2024, 3, 2) and got["b"]["first_date"] == dt.datetime(2024, 1, 31)
    assert (got["a.b"]["forms"], got["b"]["forms"], got["c"]["forms"]) == ("parts", "cast, parts", "word and day")
    assert got["a.b"]["texts"] == 3
