"""The value-frequency frame: one row per column and distinct value, with its number of rows.

It is the shared base of profiling. One shuffle, with partial counts before it, gives distinct
counts, top values, medians and the sequential-key test of every column at once. Frequent values
collapse in the partial counts, so a value held by a third of all rows costs no more than a rare
one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import fixed_values as fixed
from tallyframe.functions.numeric import FLOATING, as_number, column, column_type, is_numeric, is_text, is_time, present

# Longer text is counted under the digest of the whole text: the shuffle then moves 71 characters
# instead of a document.
LONG_TEXT = 256
DIGEST_PREFIX = "sha256:"
DIGEST_LENGTH = len(DIGEST_PREFIX) + 64

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_flat(data_type: T.DataType) -> bool:
    return is_numeric(data_type) or is_text(data_type) or is_time(data_type) or isinstance(data_type, T.BooleanType)


def flat_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """The given columns, or all that hold plain values; nested ones have no frequencies."""
    return [c for c in (columns or df.columns) if is_flat(column_type(df, c))]


def text_key(col: Column) -> Column:
    digest = F.concat(F.lit(DIGEST_PREFIX), F.sha2(col.cast("binary"), 256))
    return F.when(F.length(col) > LONG_TEXT, digest).otherwise(col)


def _key_class(data_type: T.DataType) -> str:
    if isinstance(data_type, WHOLE):
        return "whole"
    if isinstance(data_type, FLOATING):
        return "number"
    if isinstance(data_type, T.DecimalType):
        return "decimal"
    if is_time(data_type):
        return "time"
    return "boolean" if isinstance(data_type, T.BooleanType) else "text"


def _key(df: DataFrame, name: str, key_class: str) -> Column:
    col = present(df, name)
    if key_class == "whole":
        return col.cast("bigint")
    if key_class == "number":
        return col.cast("double")
    if key_class == "time":
        return col.cast("timestamp_ntz")
    if key_class == "text":
        return text_key(col)
    return col if key_class == "boolean" else col.cast("string")


def value_frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, number, whole, stamp, n): non-null values of each column and their row counts.

    ``value`` is the value as text; ``number``, ``whole`` and ``stamp`` are set by type. Columns
    of one type are laid out together, so that keys keep their native, cheap form in the shuffle,
    and every column is still read once.
    """
    names = flat_columns(df, columns)
    if not names:
        raise ValueError("none of the columns holds plain values")
    by_class: dict[str, list[str]] = {}
    for name in names:
        by_class.setdefault(_key_class(column_type(df, name)), []).append(name)
    frames = []
    for key_class, members in by_class.items():
        counted = (
            df.select(*[_key(df, c, key_class).alias(c) for c in members])
            .unpivot([], [column(c) for c in members], "column", "key").where(F.col("key").isNotNull())
            .groupBy("column", "key").agg(F.count(F.lit(1)).alias("n"))
        )
        key, nothing = F.col("key"), F.lit(None)
        number = key.cast("double") if key_class in ("whole", "number", "decimal") else nothing.cast("double")
        whole = {
            "whole": key, "number": F.when(key % 1 == 0, key.try_cast("bigint")) if key_class == "number" else None,
            "decimal": F.when(number % 1 == 0, number.try_cast("bigint")) if key_class == "decimal" else None,
        }.get(key_class)
        frames.append(
            counted.select(
                "column", key.cast("string").alias("value"), number.alias("number"),
                (whole if whole is not None else nothing).cast("bigint").alias("whole"),
                (key if key_class == "time" else nothing).cast("timestamp_ntz").alias("stamp"), "n",
            )
        )
    return reduce(DataFrame.union, frames)


def only(frequencies: DataFrame, condition: Column) -> DataFrame:
    """Rows of the frame that meet the condition.

    The condition is tied to the count, so the filter stays above the aggregation. All readers of
    one frame then share a single scan and shuffle instead of repeating them with other filters.
    """
    return frequencies.where(F.when(F.col("n") > 0, condition))


def distinct_counts(frequencies: DataFrame) -> DataFrame:
    return frequencies.groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_count"), F.sum("n").alias("non_null_count"),
        F.count("whole").alias("whole_count"),
    )


def measures(frequencies: DataFrame) -> DataFrame:
    """Counts, extremes, shares and moments of every column, from its distinct values.

    The mean comes first and the squared deviations from it second, both over the counted values,
    so no precision is lost to large sums of squares.
    """
    v, n = F.col("number"), F.col("n")
    words = F.lower("value").isin(*fixed.BOOLEAN_WORDS)

    def share(condition: Column) -> Column:
        return F.try_divide(F.sum(F.when(condition, n).otherwise(0)), F.sum(F.when(v.isNotNull(), n)))

    first = frequencies.groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_count"), F.sum(n).alias("non_null"), F.count("whole").alias("whole_count"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        F.try_divide(F.sum(v * n), F.sum(F.when(v.isNotNull(), n))).alias("mean"),
        share(v < 0).alias("negative"), share(v == 0).alias("zero"), share(v.isin(0.0, 1.0)).alias("bit"),
        share(v.between(0.0, 1.0)).alias("unit"),
        F.try_divide(F.sum(F.when(words, n).otherwise(0)), F.sum(n)).alias("boolean_share"),
        F.try_divide(F.sum(F.when(F.col("value") == "true", n).otherwise(0)), F.sum(n)).alias("true_share"),
        F.min("stamp").alias("first_time"), F.max("stamp").alias("last_time"),
    )
    # One row per column, so this side is as small as the table is wide.
    deviation = v - F.col("mean")
    spread = (
        only(frequencies, v.isNotNull()).join(F.broadcast(first.select("column", "mean")), "column")
        .groupBy("column")
        .agg(F.sqrt(F.try_divide(F.sum(deviation * deviation * n), F.sum(n) - 1)).alias("std"))
    )
    return first.join(F.broadcast(spread), "column", "left")


#: Ranges that a column's values are counted in at a time.
RANGES = 1 << 16


def _holding(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of counted ranges the one of each key that holds its rank, and the rows before it.

    counts: keys, rows, low, high, rank and before; at most RANGES rows a key.
    """
    upto = F.col("before") + F.sum("rows").over(Window.partitionBy(*keys).orderBy("low"))
    found = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("rows") < F.col("rank")))
    return found.select(*keys, "rank", (F.col("upto") - F.col("rows")).alias("before"), "low", "high")


def medians(frequencies: DataFrame) -> DataFrame:
    """Exact median of every numeric column, by counting in narrowing ranges.

    Values are first counted by sign and power of two, then three times in 65,536 ranges between the
    lowest and highest value of the range that holds the middle rank; only counts are shuffled. What is
    left are values of at most a 2^48th of one power of two, so 16 distinct ones, and these are walked.
    An even number of values has two middle ranks, each with ranges of its own.
    """
    numbers = only(frequencies, F.col("number").isNotNull()).select("column", "number", "n")
    number, low, high = F.col("number"), F.col("low"), F.col("high")
    power = F.when(number == 0, 0).otherwise(F.signum(number) * (F.floor(F.log2(F.abs(number))) + 1100)).cast("int")
    ends = F.sum("n").alias("rows"), F.min("number").alias("low"), F.max("number").alias("high")
    powers = numbers.groupBy("column", power.alias("range")).agg(*ends)
    total = F.sum("rows").over(Window.partitionBy("column"))
    middle = F.array(*[
        F.struct(F.lit(side).alias("side"), rank.alias("rank"))
        for side, rank in ((0, F.floor((F.col("total") + 1) / 2)), (1, F.floor(F.col("total") / 2) + 1))
    ])
    asked = powers.withColumn("total", total).select("column", "rows", "low", "high", F.inline(middle)).withColumn("before", F.lit(0).cast("bigint"))
    keys = ["column", "side"]
    held = _holding(asked, keys)

    def near() -> DataFrame:
        # Two rows per column of the profiled table, so the broadcast is bounded by its width.
        return numbers.join(F.broadcast(held), "column").where(number.between(low, high))

    for _ in range(3):
        place = F.coalesce(F.floor(F.try_divide(number - low, high - low) * RANGES), F.lit(0)).cast("int")
        counts = near().groupBy(*keys, "rank", "before", place.alias("range")).agg(*ends)
        held = _holding(counts, keys)
    walk = Window.partitionBy(*keys).orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    walked = near().withColumn("upto", F.col("before") + F.sum("n").over(walk)).where(F.col("upto") >= F.col("rank"))
    sides = walked.groupBy(*keys).agg(F.min("number").alias("value"))
    return sides.groupBy("column").agg((F.sum("value") / 2).alias("median"))


def approximate_medians(df: DataFrame, columns: Sequence[str], accuracy: int) -> DataFrame:
    """Medians from a sketch of each column, off by a rank of at most 1 / accuracy of the rows; one scan."""
    medians_ = [F.percentile_approx(as_number(df, c), 0.5, accuracy).alias(str(i)) for i, c in enumerate(columns)]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(str(i)).alias("median")) for i, c in enumerate(columns)])
    return df.agg(*medians_).select(F.inline(pairs))


def sequential_shares(frequencies: DataFrame) -> DataFrame:
    """Share of the steps between sorted distinct whole values that equal one.

    No sort is needed: with V the set of values, the values whose successor is also there number
    2·|V| − |V ∪ (V + 1)|, and both sizes are plain distinct counts.
    """
    values = only(frequencies, F.col("whole").isNotNull()).select("column", "whole")
    joined = values.select(
        "column", "whole", F.explode(F.array(F.lit(0), F.lit(1))).alias("step")
    ).select("column", "step", F.try_add(F.col("whole"), F.col("step")).alias("value"))
    return (
        joined.groupBy("column", "value").agg(F.count_if(F.col("step") == 0).alias("own"))
        .groupBy("column").agg(F.sum("own").alias("values"), F.count("value").alias("united"))
        .select(
            "column", "values",
            F.try_divide(2 * F.col("values") - F.col("united"), F.col("values") - 1).alias("step_share"),
        )
    )


def is_digest(value: Column) -> Column:
    return value.startswith(DIGEST_PREFIX) & (F.length(value) == DIGEST_LENGTH)


def with_whole_texts(df: DataFrame, picked: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The picked rows (column, value, ...), few for each column, with texts in place of their digests.

    The texts are looked up in the rows again. A short text that merely looks like a digest finds no
    long one and stays as it is.
    """
    texts = [c for c in columns if is_text(column_type(df, c))]
    if not texts:
        return picked
    wanted = F.broadcast(picked.where(is_digest(F.col("value"))).select("column", "value").distinct())  # a few per column
    long = (
        df.select(*[column(c).alias(c) for c in texts]).unpivot([], [column(c) for c in texts], "column", "_text")
        .where(F.length("_text") > LONG_TEXT).withColumn("value", text_key(F.col("_text")))
        .join(wanted, ["column", "value"]).groupBy("column", "value").agg(F.first("_text").alias("_text"))
    )
    found = picked.join(long, ["column", "value"], "left")
    return found.select(*[F.coalesce("_text", "value").alias("value") if c == "value" else F.col(c) for c in picked.columns])


def top_values(frequencies: DataFrame, limit: int) -> DataFrame:
    """The most frequent values of every column, smallest value first among equals.

    The rank filter is applied per task before the shuffle, so a wide column sends few rows.
    """
    counts = distinct_counts(frequencies)
    ranked = frequencies.withColumn(
        "rank", F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), is_digest(F.col("value")), "value")).cast("bigint")
    ).where(F.col("rank") <= limit)
    return ranked.join(F.broadcast(counts), "column").select(
        "column", "rank", "value", "n", "unique_count", (F.col("unique_count") <= limit).alias("is_complete")
    )
