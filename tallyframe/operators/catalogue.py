"""What can be measured in a table: metric catalogue, statistics, dimension values, fingerprint."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import fixed_values as fixed
from tallyframe.functions.matrices import NO_SPREAD, PAIR_SUMS, pair_sums
from tallyframe.functions.numeric import as_number, column, column_type, is_numeric, is_text, present
from tallyframe.functions.periods import as_timestamp
from tallyframe.operators import frequencies as freq
from tallyframe.operators.profile import metric_columns, name_has


def _named(hints: Sequence[str]) -> Column:
    name = F.lower("column")
    return reduce(or_, [name.contains(h) for h in hints])


def _array(*words: str) -> Column:
    return F.array(*[F.lit(w) for w in words])


def metric_catalogue(
    profile: DataFrame,
    mean_hints: Sequence[str] = fixed.MEAN_NAME_HINTS,
    sum_hints: Sequence[str] = fixed.SUM_NAME_HINTS,
    signed_hints: Sequence[str] = fixed.SIGNED_NAME_HINTS,
) -> DataFrame:
    """One row per metric column of a profile: how to aggregate it and how sure that is."""
    kind = F.col("semantic_type")
    level = F.coalesce("zero_ratio", F.lit(0.0)) < fixed.MEAN_LIKE_ZERO_RATIO

    def choose(aggregation, allowed, confidence):
        return F.struct(
            F.lit(aggregation).alias("aggregation"), _array(*allowed).alias("allowed"),
            F.lit(confidence).alias("confidence"),
        )

    usual = ("sum", "mean", "min", "max")
    rule = (
        F.when(kind == "percentage", choose("mean", ("mean", "min", "max"), 0.9))
        .when(_named(mean_hints), choose("mean", ("mean", "min", "max", "median"), 0.85))
        .when(kind == "monetary", choose("sum", usual, 0.9))
        .when(_named(sum_hints), choose("sum", usual, 0.85))
        .when(kind == "discrete_numeric", choose("sum", usual, 0.55))
        .when(level, choose("mean", ("mean", "sum", "min", "max"), 0.4))
        .otherwise(choose("sum", usual, 0.4))
    )
    negative = F.coalesce("negative_ratio", F.lit(0.0))
    non_negative = (negative == 0) | (~_named(signed_hints) & (negative <= fixed.ERROR_NEGATIVE_RATIO))
    return metric_columns(profile).withColumn("rule", rule).select(
        F.col("column").alias("metric_key"), F.col("column").alias("field"), "semantic_type",
        F.col("rule.aggregation").alias("default_aggregation"), F.col("rule.allowed").alias("allowed_aggregations"),
        non_negative.alias("non_negative"),
        ((F.col("rule.aggregation") == "sum") & (kind != "percentage")).alias("additive"),
        F.col("is_forecast_candidate").alias("forecastable"),
        F.col("rule.confidence").alias("discovery_confidence"),
        (F.col("rule.confidence") < fixed.CONFIRM_BELOW_CONFIDENCE).alias("needs_confirmation"),
    )


def identifier_count_metrics(profile: DataFrame, has_date_column: bool) -> DataFrame:
    """Every identifier column yields a distinct-count metric, shaped like the catalogue."""
    return profile.where("is_identifier").select(
        F.concat("column", F.lit("_distinct_count")).alias("metric_key"), F.col("column").alias("field"),
        F.lit("count").alias("semantic_type"), F.lit("nunique").alias("default_aggregation"),
        _array("nunique").alias("allowed_aggregations"), F.lit(True).alias("non_negative"),
        F.lit(False).alias("additive"), F.lit(has_date_column).alias("forecastable"),
        F.lit(0.6).alias("discovery_confidence"), F.lit(True).alias("needs_confirmation"),
    )


def time_range(df: DataFrame, date_column: str, keys: Sequence[str] = ()) -> DataFrame:
    """First and last timestamp and the whole days between them."""
    stamp = as_timestamp(df, date_column)
    seconds = F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))
    return (
        df.groupBy(*keys).agg(F.min(stamp).alias("start"), F.max(stamp).alias("end"))
        .withColumn("days", F.floor(seconds / 86_400_000_000).cast("bigint"))
    )


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """Hash of columns, types, row count and numeric summaries; the order of rows has no part in it."""
    names = sorted(df.columns)
    aggregates, parts = [F.count(F.lit(1)).alias("row_count")], []
    for i, name in enumerate(names):
        if is_numeric(column_type(df, name)):
            v = as_number(df, name)
            aggregates += [F.avg(v).alias(f"a{i}"), F.stddev_pop(v).alias(f"s{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
            shown = F.format_string(name.replace("%", "%%") + ":%.3f:%.3f:%.3f:%.3f", f"a{i}", f"s{i}", f"l{i}", f"h{i}")
            parts.append(F.when(F.col(f"a{i}").isNotNull(), shown).otherwise(F.lit(f"{name}:empty")))
    types = ",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in names)
    signature = F.concat_ws(
        "|", F.lit(",".join(names)), F.lit(types), F.concat(F.lit("rows:"), F.col("row_count")),
        F.concat_ws(",", *parts) if parts else F.lit(""), F.lit(f"fe_v{fixed.FEATURE_VERSION}"),
    )
    key = F.when(F.col("row_count") == 0, F.lit("empty")).otherwise(F.substring(F.md5(signature), 1, 16))
    return df.agg(*aggregates).select(key.alias("fingerprint"), "row_count")


def column_statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: counts, type by content, and sum, mean and extremes where it is numeric.

    A column counts as numeric when at least 95 % of its non-null values read as numbers, text
    included; a date-like name with at least one readable date makes it a datetime.
    """
    names = list(columns or df.columns)
    aggregates, rows = [], []
    for i, name in enumerate(names):
        v = as_number(df, name)
        dated = name_has(name, fixed.STATISTICS_DATE_WORDS)
        holds_dates = dated and freq.is_flat(column_type(df, name)) and not is_numeric(column_type(df, name))
        stamp = as_timestamp(df, name) if holds_dates else F.lit(None).cast("timestamp_ntz")
        aggregates += [
            F.count(present(df, name)).alias(f"c{i}"), F.count(F.lit(1)).alias(f"r{i}"), F.count(v).alias(f"n{i}"),
            F.sum(v).alias(f"s{i}"), F.avg(v).alias(f"a{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}"),
            F.min(stamp).alias(f"f{i}"), F.max(stamp).alias(f"u{i}"),
        ]
        numeric = F.lit(not dated) & (F.col(f"n{i}") > 0) & (F.col(f"n{i}") >= fixed.NUMERIC_TEXT_SHARE * F.col(f"c{i}"))
        kind = (
            F.when(F.lit(dated) & F.col(f"f{i}").isNotNull(), "datetime")
            .when(numeric, "numeric").when(~F.lit(dated), "categorical")
        )
        rows.append(
            F.struct(
                F.lit(name).alias("column"), F.col(f"c{i}").alias("non_null_count"),
                (F.col(f"r{i}") - F.col(f"c{i}")).alias("null_count"), kind.alias("type"),
                *[F.when(numeric, F.col(f"{k}{i}")).alias(n)
                  for k, n in (("s", "sum"), ("a", "mean"), ("l", "minimum"), ("h", "maximum"))],
                F.col(f"f{i}").alias("first_date"), F.col(f"u{i}").alias("last_date"),
            )
        )
    measured = df.agg(*aggregates).select(F.inline(F.array(*rows)))
    counts = freq.distinct_counts(freq.value_frequencies(df, names)).select("column", "unique_count")
    return measured.join(F.broadcast(counts), "column", "left").withColumn(
        "unique_count", F.coalesce("unique_count", F.lit(0).cast("bigint"))
    )


def top_values(df: DataFrame, columns: Sequence[str] | None = None, limit: int = fixed.TOP_VALUES_LIMIT) -> DataFrame:
    """The most frequent values of every column, with its number of distinct values and whether these are all.

    Texts are given whole; among equally frequent ones those over 256 characters come last.
    """
    names = freq.flat_columns(df, columns)
    return freq.with_whole_texts(df, freq.top_values(freq.value_frequencies(df, names), limit), names)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson r of all column pairs; pairs without variance are left out.

    Two scans for any number of columns: one for each column's centre, one in which every task sums the
    products of all pairs as matrices. A task sends one row a pair, and these are added up.
    """
    names = [c for c in (columns or df.columns) if is_numeric(column_type(df, c))]
    if len(names) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    numbers = df.select(*[as_number(df, c).alias(f"c{i}") for i, c in enumerate(names)])
    ends = numbers.agg(*[f(f"c{i}") for i in range(len(names)) for f in (F.min, F.max, F.avg)]).first()
    # a value of the column where it has but one, so that its distances are exactly zero
    centres = [low if low == high else mean for low, high, mean in zip(ends[0::3], ends[1::3], ends[2::3])]
    sums = numbers.mapInArrow(pair_sums([c or 0.0 for c in centres]), PAIR_SUMS)
    total = sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    spread = lambda squares, plain: F.col(squares) - F.col(plain) * F.col(plain) / F.col("n")
    real = lambda squares, plain: F.when(spread(squares, plain) > NO_SPREAD * F.col(squares), spread(squares, plain))
    r = F.try_divide(F.col("xy") - F.col("x") * F.col("y") / F.col("n"), F.sqrt(real("xx", "x")) * F.sqrt(real("yy", "y")))
    named = F.array(*[F.lit(c) for c in names])
    found = total.where("n > 0").select(
        named[F.col("a")].alias("first_column"), named[F.col("b")].alias("second_column"),
        F.round(F.when(r.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r))), 4).alias("correlation"), F.col("n").alias("observations"),
    )
    return found.where(F.col("correlation").isNotNull())


def dimension_values(df: DataFrame, dimensions: Sequence[str], examples: int = fixed.DIMENSION_EXAMPLES) -> DataFrame:
    """Per dimension: number of distinct non-blank values and example values, in value order.

    Texts are given whole; those over 256 characters come after the others.
    """
    trimmed = df.select(*[
        F.when(F.trim(column(c).cast("string")) != "", F.trim(column(c).cast("string"))).alias(c) for c in dimensions
    ])
    frequencies = freq.value_frequencies(trimmed)
    order = (freq.is_digest(F.col("value")), F.col("value"))
    ranked = frequencies.withColumn(
        "rank", F.row_number().over(Window.partitionBy("column").orderBy(*order))
    ).where(F.col("rank") <= examples).select("column", "rank", "value")
    # Each list holds at most `examples` values.
    lists = freq.with_whole_texts(trimmed, ranked, list(dimensions)).groupBy("column").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda e: e["value"]).alias("example_values")
    )
    return freq.distinct_counts(frequencies).select("column", "unique_count").join(F.broadcast(lists), "column")


def normalised_value(col: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(col, r"\s+", " ")), r"^\s+|\s+$", ""))


def find_value_columns(df: DataFrame, terms: DataFrame, term: str = "term", columns: Sequence[str] | None = None) -> DataFrame:
    """Which text columns hold which of the searched values, and in how many rows.

    Values are trimmed, inner spaces collapsed and case ignored. Equal values are counted before
    the join, so a value that fills a third of the table joins as one row.
    """
    names = [c for c in (columns or df.columns) if is_text(column_type(df, c))]
    normalised = df.select(*[normalised_value(column(c)).alias(c) for c in names])
    frequencies = freq.value_frequencies(normalised, names).select("column", F.col("value").alias("_key"), "n")
    wanted = terms.select(F.col(term)).dropna().dropDuplicates().withColumn(
        "_key", freq.text_key(normalised_value(F.col(term)))
    )
    return frequencies.join(wanted, "_key").select(term, "column", F.col("n").alias("row_count"))
