"""Files to typed tables."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import fixed_values as fixed
from tallyframe.functions.numeric import FLOATING, column, column_type, is_text, parse_numeric_text, present, text_to_double
from tallyframe.sources.records import delimited_records, has_open_lines, listed_objects
from tallyframe.sources.shared import shared_folder


def demote_integral(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Float columns whose values are all whole become bigint.

    The type depends on the data, so this runs one aggregation of one row when it is called.
    """
    names = [c for c in (columns or df.columns) if isinstance(column_type(df, c), FLOATING)]
    if not names:
        return df
    tests = [F.bool_and((present(df, c) % 1 == 0) & (F.abs(present(df, c)) < 2.0**63)).alias(str(i)) for i, c in enumerate(names)]
    verdict = df.agg(*tests).first()
    whole = [c for i, c in enumerate(names) if verdict[str(i)]]
    return df.withColumns({c: present(df, c).cast("bigint") for c in whole})


def _whole(col: Column) -> Column:
    number = text_to_double(col)
    exact = F.when(col.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(col).try_cast("bigint"))
    return F.coalesce(exact, F.when(number % 1 == 0, number.try_cast("bigint")))


def coerce_text_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns become bigint, double or boolean where every value reads as such; blanks null.

    One aggregation counts, for all columns together, the values that fit each type.
    """
    names = [c for c in (columns or df.columns) if is_text(column_type(df, c))]
    if not names:
        return df
    cleaned = df.withColumns({c: F.when(F.trim(column(c)) != "", F.trim(column(c))) for c in names})
    col, chosen = F.col("value"), [column(c) for c in names]
    fits = cleaned.select(*chosen).unpivot([], chosen, "column", "value").where(col.isNotNull()).groupBy("column").agg(
        F.count(F.lit(1)).alias("all"), F.count(_whole(col)).alias("whole"), F.count(text_to_double(col)).alias("number"),
        F.count_if(F.lower(col).isin("true", "false")).alias("bool"),
    )
    # One row per column comes back, whatever the size of the table.
    found = {row["column"]: row for row in fits.collect()}
    casts = {}
    for c, row in found.items():
        if row["whole"] == row["all"]:
            casts[c] = _whole(column(c))
        elif row["number"] == row["all"]:
            casts[c] = text_to_double(column(c))
        elif row["bool"] == row["all"]:
            casts[c] = F.lower(column(c)) == "true"
    return cleaned.withColumns(casts) if casts else cleaned


def parse_numeric_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Formatted amounts in the given text columns to doubles."""
    return df.withColumns({c: parse_numeric_text(column(c).cast("string")) for c in columns})


def read_csv_table(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None = None
) -> DataFrame:
    """UTF-8 CSV with a header. Cells that mean missing are null; types follow the content.

    Quoted cells may hold line ends; files still split into ranges that many tasks read. A quote that is
    not closed, and files of different headers, are errors. A schema saves the pass that finds the types.
    """
    options = {"encoding": "UTF-8", "escape": '"', "multiLine": False}
    if has_open_lines(spark, path):
        text = _read_records(spark, path, schema, options)
    else:  # every line is a record, which Spark's own reader cuts the same way
        reader = spark.read.options(header=True, **options)
        text = (reader.schema(schema) if schema is not None else reader).csv(path)
    if schema is not None:
        return text
    missing = [m for m in fixed.MISSING_CELLS]
    nulled = text.select(*[F.when(~column(c).isin(*missing), column(c)).alias(c) for c in text.columns])
    return coerce_text_columns(nulled)


def _read_records(spark: SparkSession, path: str | list[str], schema: T.StructType | None, options: dict) -> DataFrame:
    records = delimited_records(spark, path)
    headers = records.where("first").select("text").distinct().limit(2).collect()
    if len(headers) > 1:
        raise ValueError("the files have different headers")
    if schema is None:
        names: list[str] = []
        for i, name in enumerate(next(csv.reader(io.StringIO(headers[0]["text"], newline=""))) if headers else []):
            name = name or f"_c{i}"
            names.append(name if name not in names else f"{name}{i}")
        schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    return records.where("NOT first").select(F.from_csv("text", ddl, {k: str(v) for k, v in options.items()}).alias("row")).select("row.*")


def read_json_records(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, lines: bool = False
) -> DataFrame:
    """Files holding a list of records each, or one record per line.

    Many tasks read ranges of a list, too. Without a schema its records are written as lines to the
    shared folder, from which Spark infers one. A file that is no list, or not closed, is an error.
    """
    if not lines:
        records = listed_objects(spark, path)
        if schema is not None:
            ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
            return records.select(F.from_json("text", ddl).alias("row")).select("row.*")
        path = shared_folder(spark, "records")
        records.write.text(path)
    reader = spark.read
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Table by file extension: .csv, .json, .jsonl, .parquet or .orc."""
    extension = path.rsplit(".", 1)[-1].lower()
    if extension == "csv":
        return read_csv_table(spark, path)
    if extension in ("json", "jsonl"):
        return read_json_records(spark, path, lines=extension == "jsonl")
    if extension in ("parquet", "orc"):
        return spark.read.format(extension).load(path)
    raise ValueError(f"unsupported data format: .{extension}")
