"""Row filters built from field / operator / value conditions.

A list of conditions becomes one boolean expression, so a filter is a single pass whatever its
length, and plain comparisons reach the file scan. Wrong requests raise before a plan exists.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import timedelta
from functools import reduce
from operator import and_, or_
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import fixed_values as fixed
from tallyframe.functions.numeric import as_number, column, column_type, is_numeric, is_text, is_time
from tallyframe.functions.periods import as_timestamp


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: Any


NO_MATCH = object()


def _bool_literal(value: Any) -> bool:
    word = str(value).strip().casefold()
    if word in fixed.TRUE_WORDS:
        return True
    if word in fixed.FALSE_WORDS:
        return False
    return bool(value)


WHOLE_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _number_literal(value: Any) -> int | float | None:
    """Whole numbers exactly, however large; other numbers, and texts such as "1.0", as floats."""
    if isinstance(value, int):
        return int(value)
    if isinstance(value, str):
        try:
            return int(value.strip())
        except ValueError:
            pass
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def _timestamp_literal(value: Any) -> pd.Timestamp | None:
    stamp = pd.to_datetime(value, errors="coerce")
    return None if pd.isna(stamp) else stamp


def coerce_literal(value: Any, data_type: T.DataType) -> Any:
    """The value in the type of the column, or NO_MATCH when it can equal nothing there."""
    if isinstance(data_type, T.BooleanType):
        return _bool_literal(value)
    if is_numeric(data_type):
        number = _number_literal(value)
        if number is None or (isinstance(number, float) and not math.isfinite(number)):
            return NO_MATCH
        if not isinstance(data_type, WHOLE_TYPES):
            return float(number)
        return int(number) if number == int(number) else NO_MATCH
    if is_time(data_type):
        stamp = _timestamp_literal(value)
        return NO_MATCH if stamp is None else stamp
    return str(value)


def _literal(value: Any, data_type: T.DataType) -> Column:
    return F.lit(str(value)).cast(data_type) if is_time(data_type) else F.lit(value)


def _membership(df: DataFrame, field: str, values: Iterable[Any], match_case: bool) -> Column:
    """Equal to one of the values; null for rows without a value.

    The column stays bare, so that the scan gets the test: a literal is finite and thus no NaN equals
    it, and numbers beyond the range of a whole-number column equal nothing in it.
    """
    data_type = column_type(df, field)
    coerced = [v for v in (coerce_literal(v, data_type) for v in values) if v is not NO_MATCH]
    col = column(field)
    if isinstance(data_type, WHOLE_TYPES):
        bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}[type(data_type)]
        coerced = [v for v in coerced if -(1 << bits) <= v < 1 << bits]
    if not coerced:
        return F.lit(False)
    if is_text(data_type):
        col = col if match_case else F.lower(col)
        literals = [F.lit(v) for v in sorted(set(coerced if match_case else [v.lower() for v in coerced]))]
    else:
        literals = [_literal(v, data_type) for v in coerced]
    return col == literals[0] if len(literals) == 1 else col.isin(*literals)


def _no_member(df: DataFrame, field: str, values: Iterable[Any], match_case: bool) -> Column:
    """Rows without a value are kept."""
    return ~F.coalesce(_membership(df, field, values, match_case), F.lit(False))


def _as_list(value: Any) -> list[Any]:
    return list(value) if isinstance(value, (list, tuple, set, frozenset)) else [value]


def _bound(field: str, value: Any) -> int | float:
    number = _number_literal(value)
    if number is None:
        raise ValueError(f"filter value {value!r} for field {field!r} must be numeric")
    return number


WHOLE_LIMIT = 2**63 - 1


def _between(df: DataFrame, field: str, low: int | float, high: int | float, low_open: bool = False, high_open: bool = False) -> Column:
    """Finite values within the bounds, written so that the column stays bare and scans can skip.

    On whole-number columns the bounds become whole as well. On floats the infinities are open
    bounds; NaN sorts above all numbers and thus falls out with them.
    """
    if math.isnan(low) or math.isnan(high):
        return F.lit(False)
    data_type, col = column_type(df, field), column(field)
    if is_numeric(data_type) and not isinstance(data_type, (T.DoubleType, T.FloatType, T.DecimalType)):
        if low > WHOLE_LIMIT or high < -WHOLE_LIMIT:
            return F.lit(False)
        tests = [col.isNotNull()]
        if low > -WHOLE_LIMIT:
            tests.append(col >= (math.floor(low) + 1 if low_open else math.ceil(low)))
        if high < WHOLE_LIMIT:
            tests.append(col <= (math.ceil(high) - 1 if high_open else math.floor(high)))
        return reduce(and_, tests)
    low, high = float(low), float(high)
    if not isinstance(data_type, (T.DoubleType, T.FloatType)):
        col = as_number(df, field)
    infinity = float("inf")
    lower = col > low if low_open or low == -infinity else col >= low
    upper = col < high if high_open or high == infinity else col <= high
    return lower & upper


def _date_condition(df: DataFrame, field: str, operator: str, value: Any) -> Column:
    stamp = _timestamp_literal(value)
    if stamp is None:
        raise ValueError(f"invalid date filter value {value!r}")
    data_type = column_type(df, field)
    # A time column is compared as it is, so that the bound is pushed to the scan.
    native = is_time(data_type)
    col = column(field) if native else as_timestamp(df, field)

    def at(moment: pd.Timestamp) -> Column:
        target = data_type if native and not isinstance(data_type, T.DateType) else T.TimestampNTZType()
        return F.lit(str(moment)).cast(target)

    if operator == "date_from":
        return col >= at(stamp)
    if ":" not in str(value).strip():
        return col < at(stamp + timedelta(days=1))
    return col <= at(stamp)


def condition_column(df: DataFrame, condition: Condition, match_case: bool = False) -> Column:
    field, operator, value = condition.field, condition.operator, condition.value
    if not field:
        raise ValueError("a filter is missing its field")
    column_type(df, field)
    if operator == "equals":
        return _membership(df, field, [value], match_case)
    if operator == "not_equals":
        return _no_member(df, field, [value], match_case)
    if operator == "in":
        return _membership(df, field, _as_list(value), match_case)
    if operator == "not_in":
        return _no_member(df, field, _as_list(value), match_case)
    if operator == "contains":
        return F.lower(column(field).cast("string")).contains(str(value).lower())
    if operator in ("greater_than", "greater_than_or_equal", "less_than", "less_than_or_equal"):
        bound, infinity = _bound(field, value), float("inf")
        if operator.startswith("greater"):
            return _between(df, field, bound, infinity, low_open=operator == "greater_than")
        return _between(df, field, -infinity, bound, high_open=operator == "less_than")
    if operator == "between":
        if not isinstance(value, (list, tuple)) or len(value) != 2:
            raise ValueError("the between operator requires exactly two values")
        return _between(df, field, _bound(field, value[0]), _bound(field, value[1]))
    if operator in ("date_from", "date_to"):
        return _date_condition(df, field, operator, value)
    raise ValueError(f"unsupported filter operator {operator!r}; known are {fixed.FILTER_OPERATORS}")


def to_conditions(filters: Any, date_column: str | None = None) -> list[Condition]:
    """Accepts conditions, dicts with field/operator/value, or a mapping of field to value(s)."""
    if isinstance(filters, Mapping):
        conditions = []
        for field, value in filters.items():
            if field in ("date_from", "date_to"):
                if not date_column:
                    raise ValueError(f"{field} needs a date column")
                conditions.append(Condition(date_column, field, value))
            elif isinstance(value, (list, tuple, set, frozenset)):
                conditions.append(Condition(field, "in", list(value)))
            else:
                conditions.append(Condition(field, "equals", value))
        return conditions
    if isinstance(filters, Sequence) and not isinstance(filters, str):
        return [
            c if isinstance(c, Condition) else Condition(c.get("field"), c.get("operator", "equals"), c.get("value"))
            for c in filters
        ]
    raise ValueError(f"unsupported filters format: {type(filters).__name__}")


def filter_rows(
    df: DataFrame,
    filters: Any,
    logic: str = "and",
    date_column: str | None = None,
    match_case: bool = False,
) -> DataFrame:
    """Rows that meet all (``and``) or any (``or``) of the conditions.

    Text is compared without regard to case, which no scan can skip by; ``match_case=True`` compares
    it as stored, and is pushed to the scan like numbers and times are.
    """
    word = str(logic or "and").lower()
    if word not in ("and", "or"):
        raise ValueError(f"unsupported filter logic {word!r}")
    if not filters:
        return df
    columns = [condition_column(df, c, match_case) for c in to_conditions(filters, date_column)]
    return df.where(reduce(and_ if word == "and" else or_, columns))


def filter_months(df: DataFrame, date_column: str, months: Iterable[str], through: bool = False) -> DataFrame:
    """Rows dated in the named months of any year; ``through`` spans first to last named month."""
    names = [m.strip().lower() for m in months]
    unknown = [m for m in names if m not in fixed.MONTH_NAMES]
    if unknown:
        raise ValueError(f"unknown month names {unknown}")
    numbers = sorted({fixed.MONTH_NAMES.index(m) + 1 for m in names})
    if not numbers:
        return df
    if through:
        numbers = list(range(numbers[0], numbers[-1] + 1))
    return df.where(F.month(as_timestamp(df, date_column)).isin(*numbers))


def filter_valid_flag(df: DataFrame, flag_column: str) -> DataFrame:
    column_type(df, flag_column)
    return df.where(column(flag_column) == 1)


def filter_active_on(df: DataFrame, start_column: str, end_column: str, day: Any) -> DataFrame:
    """Rows whose interval covers the date."""
    stamp = _timestamp_literal(day)
    if stamp is None:
        raise ValueError(f"invalid date {day!r}")
    # Time columns are compared as they are, so that both bounds are pushed to the scan.
    native = {c: is_time(column_type(df, c)) for c in (start_column, end_column)}
    side = {c: column(c) if native[c] else as_timestamp(df, c) for c in native}
    kind = {c: column_type(df, c) if native[c] and not isinstance(column_type(df, c), T.DateType) else T.TimestampNTZType() for c in native}
    at = {c: F.lit(str(stamp)).cast(kind[c]) for c in native}
    return df.where((side[start_column] <= at[start_column]) & (side[end_column] >= at[end_column]))


def filter_area(df: DataFrame, area_field: str | None, area_value: str | None) -> DataFrame:
    """Trimmed, case-insensitive match on a place; no-op unless both are given."""
    if not area_field or not area_value:
        return df
    column_type(df, area_field)
    return df.where(F.lower(F.trim(column(area_field).cast("string"))) == area_value.strip().lower())
