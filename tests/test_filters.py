import pytest

from tallyframe.operators import filters as ops
from tallyframe.operators.filters import Condition, filter_rows


@pytest.fixture(scope="module")
def shop(spark):
    return spark.sql("""SELECT * FROM VALUES
        (1, 'Delhi', 10.0D, true, TIMESTAMP_NTZ '2024-01-10 00:00:00', '5'),
        (2, 'delhi', CAST('NaN' AS DOUBLE), false, TIMESTAMP_NTZ '2024-01-10 23:59:59', 'x'),
        (3, NULL, NULL, NULL, TIMESTAMP_NTZ '2024-01-11 00:00:00', NULL),
        (4, 'Goa (north)', -3.5D, true, NULL, ' 7 ')
        AS t(id, city, amount, ok, at, text_number)""")


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.mark.parametrize("field,operator,value,expected", [
    ("city", "equals", "DELHI", [1, 2]),
    ("city", "not_equals", "delhi", [3, 4]),
    ("city", "in", ["DELHI", "goa (north)"], [1, 2, 4]),
    ("city", "not_in", ["Delhi"], [3, 4]),
    ("city", "contains", "(NORTH", [4]),
    ("amount", "greater_than", -4, [1, 4]),
    ("amount", "less_than_or_equal", "10", [1, 4]),
    ("amount", "not_equals", 10, [2, 3, 4]),
    ("amount", "between", [-3.5, 9.99], [4]),
    ("amount", "equals", "no number", []),
    ("amount", "not_equals", "no number", [1, 2, 3, 4]),
    ("id", "equals", "2.0", [2]),
    ("id", "greater_than", 2.5, [3, 4]),
    ("id", "greater_than", 2, [3, 4]),
    ("id", "greater_than_or_equal", 1.2, [2, 3, 4]),
    ("id", "less_than", 2, [1]),
    ("id", "less_than", 2.5, [1, 2]),
    ("id", "less_than_or_equal", 2.9, [1, 2]),
    ("id", "between", [1.5, 1e30], [2, 3, 4]),
    ("id", "greater_than", 1e30, []),
    ("amount", "greater_than", "nan", []),
    ("ok", "equals", "valid", [1, 4]),
    ("ok", "equals", "Invalid", [2]),
    ("text_number", "greater_than_or_equal", 5, [1, 4]),
    ("at", "date_from", "2024-01-10 12:00", [2, 3]),
    ("at", "date_to", "2024-01-10", [1, 2]),
    ("at", "date_to", "2024-01-10 12:00", [1]),
])
def test_condition(shop, field, operator, value, expected):
    assert ids(filter_rows(shop, [Condition(field, operator, value)])) == expected


def test_logic(shop):
    either = [Condition("id", "equals", 1), Condition("city", "contains", "goa")]
    assert ids(filter_rows(shop, either, "or")) == [1, 4]
    assert ids(filter_rows(shop, either, "and")) == []
    assert ids(filter_rows(shop, [])) == [1, 2, 3, 4]


def test_mapping(shop):
    request = {"city": "delhi", "date_to": "2024-01-10"}
    assert ids(filter_rows(shop, request, date_column="at")) == [1, 2]


@pytest.mark.parametrize("condition", [
    Condition("nowhere", "equals", 1), Condition("id", "resembles", 1), Condition("id", "greater_than", "many"),
    Condition("id", "between", [1]), Condition("at", "date_from", "not a date"), Condition(None, "equals", 1),
])
def test_wrong_requests_raise(shop, condition):
    with pytest.raises(ValueError):
        filter_rows(shop, [condition])


def test_wrong_logic_raises(shop):
    with pytest.raises(ValueError):
        filter_rows(shop, [Condition("id", "equals", 1)], "xor")


def test_comparisons_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    kept = filter_rows(orders, [Condition("o_custkey", "greater_than", 5), Condition("o_orderdate", "date_from", "1999-01-01")])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_custkey,6)" in plan and "GreaterThanOrEqual(o_orderdate" in plan
    priced = filter_rows(orders, [Condition("o_totalprice", "less_than", 900.5)])
    assert "LessThan(o_totalprice,900.5)" in priced._jdf.queryExecution().executedPlan().toString()


def test_months(spark):
    days = spark.sql("SELECT explode(sequence(DATE '2023-01-15', DATE '2024-12-15', INTERVAL 1 MONTH)) AS d")
    assert ops.filter_months(days, "d", ["March", "january"]).count() == 4
    assert ops.filter_months(days, "d", ["January", "March"], through=True).count() == 6
    with pytest.raises(ValueError):
        ops.filter_months(days, "d", ["Smarch"])


def test_active_on(spark):
    spans = spark.sql("SELECT * FROM VALUES (1, '2024-01-01', '2024-02-01'), (2, '2024-01-20', '2024-01-25'), (3, 'soon', '2024-05-01') AS t(id, s, e)")
    assert ids(ops.filter_active_on(spans, "s", "e", "2024-01-10")) == [1]


@pytest.mark.parametrize("conditions, logic, pushed", [
    ([Condition("o_custkey", "equals", "5")], "and", "EqualTo(o_custkey,5)"),
    ([Condition("o_custkey", "in", [5, 6])], "and", "In(o_custkey, [5,6])"),
    ([Condition("o_totalprice", "equals", 900.5)], "and", "EqualTo(o_totalprice,900.5)"),
    ([Condition("o_orderdate", "equals", "1999-01-01")], "and", "EqualTo(o_orderdate,1999-01-01"),
    ([Condition("o_orderpriority", "equals", "5-LOW")], "and", "EqualTo(o_orderpriority,5-LOW)"),
    ([Condition("o_custkey", "equals", 5), Condition("o_totalprice", "less_than", 9)], "or", "Or(EqualTo(o_custkey,5)"),
])
def test_equality_reaches_the_scan(spark, conditions, logic, pushed):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = filter_rows(orders, conditions, logic, match_case=True)._jdf.queryExecution().executedPlan().toString()
    assert pushed in plan[plan.index("PushedFilters"):]


def test_intervals_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = ops.filter_active_on(orders, "o_orderdate", "o_orderdate", "1999-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(o_orderdate" in plan and "GreaterThanOrEqual(o_orderdate" in plan


def test_whole_numbers_are_exact(spark):
    big = spark.createDataFrame([(9007199254740992,), (9007199254740993,), (2,), (None,)], "k long")
    value = lambda op, v: [r.k for r in filter_rows(big, [Condition("k", op, v)]).collect()]
    assert value("equals", "9007199254740993") == value("greater_than", 9007199254740992) == [9007199254740993]
    assert value("equals", 2.7) == value("equals", 1 << 70) == []
    assert value("equals", "2.0") == [2]
    assert value("not_in", [2, 9007199254740992]) == [9007199254740993, None]
    floats = spark.createDataFrame([(float("nan"),), (1.5,), (None,)], "x double")
    assert filter_rows(floats, [Condition("x", "equals", float("nan"))]).count() == 0
    assert filter_rows(floats, [Condition("x", "not_equals", 1.5)]).count() == 2


def test_open_ends_and_dotted_names(spark):
    spans = spark.sql("SELECT 1 AS id, TIMESTAMP_NTZ '2024-01-01' AS s, TIMESTAMP_NTZ '9999-12-31' AS e")
    assert ids(ops.filter_active_on(spans, "s", "e", "2024-06-01")) == [1]
    dotted = spark.createDataFrame([(1, "x"), (2, "y")], "id int, `a.b` string")
    assert ids(filter_rows(dotted, [Condition("a.b", "equals", "X")])) == [1]
