"""Numbers out of columns: coercion, safe division, moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import fixed_values as fixed

FLOATING = (T.DoubleType, T.FloatType)
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def column_type(df: DataFrame, name: str) -> T.DataType:
    if name not in df.columns:
        raise ValueError(f"column {name!r} does not exist; columns are {df.columns}")
    return df.schema[name].dataType


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, NUMERIC)


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.VarcharType, T.CharType))


def is_time(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType))


def column(name: str) -> Column:
    """The column of that very name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def finite(col: Column) -> Column:
    """NaN and the infinities count as missing."""
    return F.when(F.isnan(col) | (F.abs(col) == float("inf")), F.lit(None)).otherwise(col)


NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def text_to_double(col: Column) -> Column:
    """Plain decimal text as a finite double, else null.

    The pattern goes first: it keeps out Java forms such as ``5d``, and a failing cast costs far
    more than a failing match.
    """
    return F.when(col.rlike(NUMBER_PATTERN), finite(col.try_cast("double")))


def as_number(df: DataFrame, name: str) -> Column:
    """The column as a finite double; values that are no number become null."""
    data_type = column_type(df, name)
    col = column(name)
    if isinstance(data_type, FLOATING):
        return finite(col.cast("double"))
    if is_numeric(data_type) or isinstance(data_type, T.BooleanType):
        return col.cast("double")
    if is_text(data_type):
        return text_to_double(col)
    return F.lit(None).cast("double")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null, type kept."""
    col = column(name)
    if isinstance(column_type(df, name), FLOATING):
        return F.when(~F.isnan(col), col)
    return col


def parse_numeric_text(col: Column) -> Column:
    """Formatted text such as ``$1,200.50`` or ``12%`` to a double; placeholders become null."""
    trimmed = F.trim(F.regexp_replace(col, r"^\s+|\s+$", ""))
    cleaned = F.regexp_replace(trimmed, fixed.CURRENCY_AND_SPACE_PATTERN, "")
    missing = F.lower(trimmed).isin(*fixed.MISSING_WORDS) | cleaned.isin("", "-", ".", "-.")
    return F.when(~missing, text_to_double(cleaned))


def change_percent(current: Column, previous: Column, digits: int = 2) -> Column:
    """Change against a base, in percent; null when the base is zero or missing."""
    return F.round(F.try_divide(current - previous, previous) * 100, digits)


def pearson(x: Column, y: Column) -> Column:
    """Pearson r over complete pairs as an aggregate; null without variance in both columns."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))


def complete_pairs(x: Column, y: Column) -> Column:
    return F.count(F.when(x.isNotNull() & y.isNotNull(), F.lit(1)))


def correlation_strength(r: Column) -> Column:
    size = F.abs(r)
    return (
        F.when(size >= fixed.STRONG_CORRELATION, "strong")
        .when(size >= fixed.MODERATE_CORRELATION, "moderate")
        .when(r.isNotNull(), "weak")
    )


def correlation_direction(r: Column) -> Column:
    return F.when(r > 0, "positive").when(r < 0, "negative").when(r.isNotNull(), "neutral")
