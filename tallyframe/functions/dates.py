"""Dates in texts of many forms: which forms a column holds, whether days come first, and the moments meant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import fixed_values as fixed
from tallyframe.functions.numeric import column, column_type, is_text

_TIME = r"(?:[ T]+(\d{1,2}:\d{2}(?::\d{2})?))?"
#: Forms besides those that Spark's own cast reads. Groups: three parts of the date, then the time of day.
FORMS = {
    "parts": rf"^(\d{{1,2}})[/.\-](\d{{1,2}})[/.\-](\d{{4}}){_TIME}$",
    "year first": rf"^(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}}){_TIME}$",
    "day and word": rf"^(\d{{1,2}})(?:st|nd|rd|th)?[ \-]+([A-Za-z]{{3,9}})\.?,?[ \-]+(\d{{4}}){_TIME}$",
    "word and day": rf"^([A-Za-z]{{3,9}})\.?[ \-]+(\d{{1,2}})(?:st|nd|rd|th)?,?[ \-]+(\d{{4}}){_TIME}$",
}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _month(word: Column) -> Column:
    """The number of a month from its name or the beginning of it; null for other words."""
    number = F.lit(None).cast("int")
    for i, name in enumerate(MONTHS, 1):
        number = F.when(F.lit(name).startswith(F.lower(word)), i).otherwise(number)
    return F.when(F.length(word) >= 3, number)


def form_of(text: Column) -> Column:
    """The form that a text has: one of FORMS, "cast" for what Spark's cast reads, or null."""
    found = F.when(F.try_to_timestamp(text).isNotNull(), "cast")
    for name, pattern in FORMS.items():
        found = found.when(text.rlike(pattern), name)
    return found


def parse_mixed(text: Column, day_first: Column) -> Column:
    """The moment that a text of any form means. Where a day and a month could be either, day_first decides;
    where only one order is possible, that one holds."""
    text = F.trim(text)
    part = lambda form, i: F.regexp_extract(text, FORMS[form], i)
    number = lambda form, i: part(form, i).try_cast("int")
    a, b = number("parts", 1), number("parts", 2)
    days_lead = (a > 12) | ((b <= 12) & day_first)
    orders = {  # year, month, day
        "parts": (part("parts", 3), F.when(days_lead, b).otherwise(a), F.when(days_lead, a).otherwise(b)),
        "year first": (part("year first", 1), number("year first", 2), number("year first", 3)),
        "day and word": (part("day and word", 3), _month(part("day and word", 2)), number("day and word", 1)),
        "word and day": (part("word and day", 3), _month(part("word and day", 1)), number("word and day", 2)),
    }
    found = [F.try_to_timestamp(text)]
    for form, (year, month, day) in orders.items():
        time = F.when(part(form, 4) != "", F.concat(F.lit(" "), F.regexp_replace(part(form, 4), r"^(\d:)", "0$1"))).otherwise(F.lit(""))
        stamp = F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day.cast("string"), 2, "0"), time)
        found.append(F.when(text.rlike(FORMS[form]), F.try_to_timestamp(stamp)))
    return F.coalesce(*found).cast("timestamp_ntz")


def date_forms(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per text column: rows with text, rows in each form, the share that has any, and whether days come first.

    Days come first if more values allow only that order than only the other. One scan with a few counts
    a column; the values of a column are not shuffled.
    """
    names = [c for c in (columns or df.columns) if is_text(column_type(df, c))]
    aggregates, rows = [], []
    for i, name in enumerate(names):
        text = F.trim(column(name))
        form = form_of(text)
        a, b = (F.regexp_extract(text, FORMS["parts"], g).try_cast("int") for g in (1, 2))
        kinds = ["cast", *FORMS]
        aggregates += [F.count(column(name)).alias(f"n{i}")]
        aggregates += [F.count_if(form == kind).alias(f"k{i}_{k}") for k, kind in enumerate(kinds)]
        aggregates += [F.count_if((a > 12) & (b <= 12)).alias(f"d{i}"), F.count_if((b > 12) & (a <= 12)).alias(f"m{i}")]
        counts = F.array(*[F.struct(F.lit(kind).alias("form"), F.col(f"k{i}_{k}").alias("rows")) for k, kind in enumerate(kinds)])
        held = F.filter(counts, lambda c: c["rows"] > 0)
        rows.append(F.struct(
            F.lit(name).alias("column"), F.col(f"n{i}").alias("texts"),
            F.array_join(F.transform(held, lambda c: c["form"]), ", ").alias("forms"),
            (F.col(f"d{i}") > F.col(f"m{i}")).alias("day_first"),
        ))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def mixed_date_rate(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per text column the share of its texts that mean a date from 1900 to 2100 in any form, the first and the last."""
    names = [c for c in (columns or df.columns) if is_text(column_type(df, c))]
    forms = date_forms(df, names)
    orders = forms.agg(F.map_from_entries(F.collect_list(F.struct("column", "day_first"))).alias("m")).scalar()  # an entry a column
    aggregates, rows = [], []
    for i, name in enumerate(names):
        stamp = parse_mixed(column(name), orders[name])
        stamp = F.when(F.year(stamp).between(fixed.DATE_FIRST_YEAR, fixed.DATE_LAST_YEAR), stamp)
        aggregates += [F.count(column(name)).alias(f"n{i}"), F.count(stamp).alias(f"d{i}"), F.min(stamp).alias(f"f{i}"), F.max(stamp).alias(f"l{i}")]
        rate = F.try_divide(F.col(f"d{i}"), F.col(f"n{i}"))
        rows.append(F.struct(
            F.lit(name).alias("column"), F.coalesce(rate, F.lit(0.0)).alias("date_parse_rate"),
            F.coalesce(rate >= fixed.DATE_PARSE_FLOOR, F.lit(False)).alias("is_date_column"), F.col(f"f{i}").alias("first_date"), F.col(f"l{i}").alias("last_date"),
        ))
    return df.agg(*aggregates).select(F.inline(F.array(*rows))).join(F.broadcast(forms), "column")
