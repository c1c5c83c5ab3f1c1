"""Column profiles: one row per column, from one scan of measures and one value-frequency frame."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import fixed_values as fixed
from tallyframe.functions.numeric import as_number, column_type, is_numeric, is_text, is_time, present
from tallyframe.operators import frequencies as freq


@dataclass(frozen=True)
class NameHints:
    """Name fragments that steer the semantic type; pass others to suit another vocabulary."""

    date: tuple[str, ...] = fixed.DATE_NAME_HINTS
    identifier: tuple[str, ...] = fixed.IDENTIFIER_NAME_HINTS
    monetary: tuple[str, ...] = fixed.MONETARY_NAME_HINTS
    percentage: tuple[str, ...] = fixed.PERCENTAGE_NAME_HINTS
    geographic: tuple[str, ...] = fixed.GEOGRAPHIC_NAME_HINTS


def name_has(name: str, hints: Sequence[str]) -> bool:
    return any(hint in name.lower() for hint in hints)


def strong_identifier_name(name: str) -> bool:
    words = re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")
    return any(words == part or words.endswith(f"_{part}") for part in fixed.STRONG_IDENTIFIER_NAMES)


def column_kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if is_numeric(data_type):
        return "numeric"
    if is_time(data_type):
        return "datetime"
    return "text" if is_text(data_type) else "unknown"


def profile_shape(df: DataFrame) -> DataFrame:
    """Row and column count with the warning that an empty dataset gets."""
    width = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count",
        F.when(F.col("row_count") > 0, F.lit(width)).otherwise(F.lit(0)).cast("bigint").alias("column_count"),
        F.when(F.col("row_count") == 0, "dataset is empty").alias("warning"),
    )


def describe_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Position, name and type of every column, beside the number of rows in the table."""
    names = list(columns or df.columns)
    rows = [
        F.struct(
            F.lit(i).cast("bigint").alias("position"), F.lit(c).alias("column"),
            F.lit(column_type(df, c).simpleString()).alias("dtype"), F.lit(column_kind(column_type(df, c))).alias("kind"),
            F.col("row_count").alias("row_count"),
            # Nested values have no frequencies, so their nulls are counted here.
            (F.lit(None).cast("bigint") if freq.is_flat(column_type(df, c)) else F.col(f"c{i}")).alias("nested_non_null"),
        )
        for i, c in enumerate(names)
    ]
    nested = [F.count(c).alias(f"c{i}") for i, c in enumerate(names) if not freq.is_flat(column_type(df, c))]
    return df.agg(F.count(F.lit(1)).alias("row_count"), *nested).select(F.inline(F.array(*rows)))


def profile_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column, all columns in one aggregation."""
    names = list(columns or df.columns)
    counted = df.agg(F.count(F.lit(1)).alias("row_count"), *[F.count(present(df, c)).alias(f"c{i}") for i, c in enumerate(names)])
    rows = [F.struct(F.lit(c).alias("column"), "row_count", (F.col("row_count") - F.col(f"c{i}")).alias("missing_count"))
            for i, c in enumerate(names)]
    return counted.select(F.inline(F.array(*rows))).select(
        "column", "row_count", (F.col("missing_count") > 0).alias("nullable"), "missing_count",
        F.coalesce(F.try_divide("missing_count", "row_count"), F.lit(0.0)).alias("missing_ratio"),
    )


def plausible_date(value: Column) -> Column:
    """Text as a timestamp when it parses to a year from 1900 to 2100, else null."""
    stamp = F.try_to_timestamp(value).cast("timestamp_ntz")
    return F.when(F.year(stamp).between(fixed.DATE_FIRST_YEAR, fixed.DATE_LAST_YEAR), stamp)


def text_dates(df: DataFrame, frequencies: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share, number and range of plausible dates per text column, parsing distinct values only."""
    names = [c for c in columns if is_text(column_type(df, c))]
    values = freq.only(frequencies, F.col("column").isin(*names)).withColumn("_date", plausible_date(F.col("value")))
    dated = F.when(F.col("_date").isNotNull(), F.col("n")).otherwise(0)
    # First per parsed date, so that two spellings of one date count once.
    by_date = values.groupBy("column", "_date").agg(F.sum("n").alias("n"), F.sum(dated).alias("dated"))
    return by_date.groupBy("column").agg(
        F.try_divide(F.sum("dated"), F.sum("n")).alias("date_parse_rate"),
        F.sum("dated").alias("dated_rows"), F.count("_date").alias("distinct_dates"),
        F.min("_date").alias("first_date"), F.max("_date").alias("last_date"),
    )


def _name_flags(names: Sequence[str], hints: NameHints) -> dict[str, Column]:
    """Flag columns for what a column's name suggests; the names are few and known here."""
    tests = {
        "date_name": lambda c: name_has(c, hints.date),
        "id_name": lambda c: name_has(c, hints.identifier),
        "strong_id_name": strong_identifier_name,
        "monetary_name": lambda c: name_has(c, hints.monetary),
        "percentage_name": lambda c: name_has(c, hints.percentage),
        "geographic_name": lambda c: name_has(c, hints.geographic),
    }
    hits = {flag: [c for c in names if test(c)] for flag, test in tests.items()}
    return {flag: F.col("column").isin(*found) if found else F.lit(False) for flag, found in hits.items()}


def profile_columns(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    hints: NameHints = NameHints(),
    with_medians: bool = True,
    median_accuracy: int | None = None,
) -> DataFrame:
    """One row per column: counts, moments, semantic type and flags.

    Medians are exact; with a median_accuracy they come from a sketch instead, whose rank is off by at most
    one in so many.

    Distinct counts are exact, because the ratio rules cut at 0.9, 0.95 and 0.99, inside the error
    of a sketch. The joins below attach frames of one row per column, so they are broadcast.
    """
    names = list(columns or df.columns)
    types = {c: column_type(df, c) for c in names}
    flat = freq.flat_columns(df, names)
    described = describe_columns(df, names)
    empty = {
        "non_null": "bigint", "unique_count": "bigint", "whole_count": "bigint",
        **dict.fromkeys(("min", "max", "mean", "std", "negative", "zero", "bit", "unit", "boolean_share", "true_share"), "double"),
        "first_time": "timestamp_ntz", "last_time": "timestamp_ntz", "median": "double", "step_share": "double",
        "date_parse_rate": "double", "dated_rows": "bigint", "distinct_dates": "bigint",
        "first_date": "timestamp_ntz", "last_date": "timestamp_ntz",
    }
    if flat:
        frequencies = freq.value_frequencies(df, names)
        described = described.join(F.broadcast(freq.measures(frequencies)), "column", "left")
        if any(is_text(types[c]) for c in flat):
            described = described.join(F.broadcast(text_dates(df, frequencies, flat)), "column", "left")
        if with_medians and any(is_numeric(types[c]) for c in flat):
            numeric = [c for c in flat if is_numeric(types[c])]
            found = freq.approximate_medians(df, numeric, median_accuracy) if median_accuracy else freq.medians(frequencies)
            described = described.join(F.broadcast(found), "column", "left")
        # Only columns that the rule can still turn into an identifier enter the sequence test.
        open_names = [
            c for c in flat
            if is_numeric(types[c]) and not any(
                name_has(c, h) for h in (hints.identifier, hints.monetary, hints.percentage))
        ]
        if open_names:
            unique = freq.distinct_counts(frequencies).where(
                F.col("column").isin(*open_names) & (F.col("whole_count") == F.col("unique_count"))
                & (F.col("unique_count") >= fixed.SEQUENTIAL_MIN_VALUES)
                & (F.col("unique_count") >= fixed.UNNAMED_IDENTIFIER_UNIQUE_RATIO * F.col("non_null_count"))
            ).select("column")
            candidates = freq.only(frequencies, F.col("whole").isNotNull()).join(F.broadcast(unique), "column", "left_semi")
            shares = freq.sequential_shares(candidates).select("column", "step_share")
            described = described.join(F.broadcast(shares), "column", "left")
    found = set(described.columns)
    absent = [f"CAST(NULL AS {t}) AS {c}" for c, t in empty.items() if c not in found]
    return _with_rules(described.selectExpr("*", *absent), names, hints)


# The typing rules in SQL, each step over the columns of the one before. Thresholds come from the
# fixed values; measures that a column's kind does not have are null and fail every comparison.
MEASURE_RULES = {
    "unique_count": "CAST(coalesce(unique_count, 0) AS BIGINT)",
    "non_null": "coalesce(non_null, nested_non_null, 0)",
    "date_parse_rate": "CASE WHEN kind = 'datetime' THEN 1.0D ELSE coalesce(date_parse_rate, 0.0D) END",
}
STEP_RULES = (
    {
        "ratio": "CASE WHEN kind <> 'unknown' AND non_null > 0 THEN unique_count / non_null ELSE 0.0D END",
        "is_whole": "coalesce(whole_count = unique_count AND unique_count > 0, false)",
        "is_sequence": f"coalesce(unique_count >= {fixed.SEQUENTIAL_MIN_VALUES} AND step_share > {fixed.SEQUENTIAL_STEP_SHARE}, false)",
        "is_date": f"date_parse_rate >= {fixed.DATE_PARSE_FLOOR}",
    },
    {
        "is_identifier": f"""CASE kind
            WHEN 'numeric' THEN ratio >= {fixed.IDENTIFIER_UNIQUE_RATIO} AND (id_name OR (
                NOT (monetary_name OR percentage_name) AND is_whole AND is_sequence
                AND ratio >= {fixed.UNNAMED_IDENTIFIER_UNIQUE_RATIO}))
            WHEN 'text' THEN strong_id_name AND unique_count > 1 AND NOT is_date
            ELSE false END""",
        "is_constant": "unique_count <= 1 AND kind <> 'unknown'",
    },
    {
        "semantic_type": f"""CASE
            WHEN kind IN ('boolean', 'datetime', 'unknown') THEN kind
            WHEN is_identifier THEN 'identifier'
            WHEN kind = 'numeric' THEN CASE
                WHEN bit = 1 AND unique_count <= 2 THEN 'boolean'
                WHEN unit > {fixed.UNIT_INTERVAL_SHARE} AND percentage_name THEN 'percentage'
                WHEN monetary_name THEN 'monetary'
                WHEN is_whole THEN 'discrete_numeric' ELSE 'continuous_numeric' END
            WHEN is_date THEN 'datetime'
            WHEN boolean_share > {fixed.BOOLEAN_WORD_SHARE} THEN 'boolean'
            WHEN geographic_name THEN 'geographic'
            WHEN unique_count <= {fixed.MAX_CATEGORICAL_CARDINALITY} AND ratio <= {fixed.CATEGORICAL_UNIQUE_RATIO} THEN 'categorical'
            ELSE 'free_text' END""",
        "forecast_rejection_reasons": f"""CASE kind
            WHEN 'numeric' THEN concat_ws('; ', IF(is_identifier, 'identifier', NULL),
                IF(is_constant, 'constant', NULL),
                IF(unique_count < {fixed.MIN_FORECAST_DISTINCT}, 'too few values', NULL))
            WHEN 'datetime' THEN 'time' WHEN 'text' THEN 'text'
            WHEN 'boolean' THEN 'true or false' ELSE 'unsupported type' END""",
    },
)
PROFILE_FIELDS = (
    "position", "column", "dtype", "kind", "semantic_type", "row_count", "row_count > non_null AS nullable",
    "row_count - non_null AS missing_count", "coalesce(try_divide(row_count - non_null, row_count), 0.0D) AS missing_ratio",
    "unique_count", "round(ratio, 4) AS unique_ratio", "min AS min_value", "max AS max_value",
    "CASE WHEN kind = 'boolean' THEN true_share ELSE mean END AS mean", "median", "std",
    "round(coalesce(negative, 0.0D), 4) AS negative_ratio", "round(coalesce(zero, 0.0D), 4) AS zero_ratio",
    "first_time", "last_time", "is_identifier", "is_constant",
    f"""kind IN ('numeric', 'text') AND ratio >= {fixed.HIGH_CARDINALITY_RATIO}
        AND unique_count > {fixed.MAX_CATEGORICAL_CARDINALITY} AS is_high_cardinality""",
    "kind = 'numeric' AND forecast_rejection_reasons = '' AS is_forecast_candidate", "forecast_rejection_reasons",
    "date_parse_rate",
    # What the date score needs, for text and time columns alike.
    "CASE WHEN kind = 'datetime' THEN ratio ELSE coalesce(try_divide(distinct_dates, dated_rows), 0.0D) END AS date_unique_ratio",
    "coalesce(first_time, first_date) AS date_start", "coalesce(last_time, last_date) AS date_end", "date_name",
)


def _with_rules(measured: DataFrame, names: Sequence[str], hints: NameHints) -> DataFrame:
    frame = measured.withColumns({**_name_flags(names, hints), **{c: F.expr(rule) for c, rule in MEASURE_RULES.items()}})
    for rules in STEP_RULES:
        frame = frame.selectExpr("*", *[f"{rule} AS {c}" for c, rule in rules.items()])
    return frame.selectExpr(*PROFILE_FIELDS)


def profile_samples(df: DataFrame, columns: Sequence[str] | None = None, count: int = 3) -> DataFrame:
    """The smallest distinct values per column, as text; long texts come whole, after short ones."""
    names = freq.flat_columns(df, columns)
    frequencies = freq.value_frequencies(df, names)
    order = [freq.is_digest(F.col("value")), F.col("number"), F.col("value")]
    picked = (
        frequencies.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order)).cast("bigint"))
        .where(F.col("rank") <= count).select("column", "rank", "value")
    )
    return freq.with_whole_texts(df, picked, names).withColumnRenamed("value", "sample")


def sequential_key_test(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: distinct whole values, share of unit steps, and the verdict."""
    names = [c for c in (columns or df.columns) if is_numeric(column_type(df, c))]
    shares = freq.sequential_shares(freq.value_frequencies(df, names))
    passed = (F.col("values") >= fixed.SEQUENTIAL_MIN_VALUES) & (F.col("step_share") > fixed.SEQUENTIAL_STEP_SHARE)
    return shares.select("column", "values", "step_share", F.coalesce(passed, F.lit(False)).alias("is_sequential"))


def date_parse_rate(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of the non-null text of each column that reads as a date from 1900 to 2100."""
    names = [c for c in (columns or df.columns) if is_text(column_type(df, c))]
    texts = text_dates(df, freq.value_frequencies(df, names), names)
    return texts.select(
        "column", "date_parse_rate", (F.col("date_parse_rate") >= fixed.DATE_PARSE_FLOOR).alias("is_date_column")
    )


def rank_date_columns(profile: DataFrame) -> DataFrame:
    """Date columns of a profile by score, best first; the first one is primary at 0.5 or more."""
    span = F.coalesce(
        (F.unix_micros(F.col("date_end").cast("timestamp")) - F.unix_micros(F.col("date_start").cast("timestamp")))
        / 86_400_000_000,
        F.lit(0.0),
    )
    weight = fixed.DATE_SCORE_WEIGHTS
    score = F.round(
        weight["parse"] * F.col("date_parse_rate")
        + weight["unique"] * F.least(F.col("date_unique_ratio") * 2, F.lit(1.0))
        + weight["span"] * F.least(span / 365, F.lit(1.0))
        + weight["name"] * F.col("date_name").cast("double"),
        4,
    )
    # One row per column: the window is as small as the table is wide.
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "position")
    dated = (F.col("date_parse_rate") >= fixed.DATE_PARSE_FLOOR) & F.col("date_start").isNotNull()
    return (
        profile.where(dated).withColumn("score", score)
        .withColumn("rank", F.row_number().over(order).cast("bigint"))
        .select(
            "rank", "column", "score", F.round("date_parse_rate", 4).alias("parse_success_rate"),
            ((F.col("rank") == 1) & (F.col("score") >= fixed.DATE_MIN_SCORE)).alias("is_primary"),
        )
    )


def list_dimensions(profile: DataFrame) -> DataFrame:
    kinds = F.col("semantic_type").isin("categorical", "boolean", "geographic")
    return profile.where(kinds & ~F.col("is_identifier") & ~F.col("is_constant")).select(
        "position", "column", "semantic_type", "unique_count"
    )


def metric_columns(profile: DataFrame) -> DataFrame:
    kinds = F.col("semantic_type").isin("continuous_numeric", "discrete_numeric", "monetary", "percentage")
    return profile.where(kinds & ~F.col("is_identifier"))


def list_metrics(profile: DataFrame) -> DataFrame:
    return metric_columns(profile).select("position", "column", "semantic_type", "is_forecast_candidate")
