"""Text tables: segments, conversation context and matching against a catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import fixed_values as fixed


def split_segments(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """One row per segment between semicolons and line breaks, list prefixes and spaces removed."""
    pieces = F.transform(
        F.split(F.col(text), fixed.SEGMENT_BOUNDARY_PATTERN),
        lambda p: F.trim(F.regexp_replace(F.trim(F.regexp_replace(p, r"\s+", " ")), fixed.LIST_PREFIX_PATTERN, "")),
    )
    kept = F.filter(pieces, lambda p: p != "")
    return df.select(*keys, F.posexplode(kept).alias("segment_number", "segment")).withColumn(
        "segment_number", F.col("segment_number").cast("bigint")
    )


def conversation_context(
    df: DataFrame,
    conversation: str,
    turn: str,
    succeeded: Column | None = None,
    same_scope: Column | None = None,
    kept: int = fixed.KEPT_TURNS,
    context: int = fixed.CONTEXT_TURNS,
) -> DataFrame:
    """The latest turns of each conversation that count as its context.

    Failed turns are skipped, the last ``kept`` remain, and of those the last ``context`` in scope
    are returned. Both limits are applied per task before the shuffle, so a conversation of any
    length sends few rows.
    """
    rows = df if succeeded is None else df.where(succeeded)
    latest = Window.partitionBy(conversation).orderBy(F.col(turn).desc())
    remembered = rows.withColumn("_rank", F.row_number().over(latest)).where(F.col("_rank") <= kept)
    if same_scope is not None:
        remembered = remembered.where(same_scope).withColumn("_rank", F.row_number().over(latest))
    return remembered.where(F.col("_rank") <= context).drop("_rank")


def match_tokens(text: Column) -> Column:
    """Distinct lower-case words of a text without stop words, in order."""
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.array_except(words, F.array(*[F.lit(w) for w in fixed.MATCH_STOP_WORDS]))))


def fuzzy_catalogue_match(
    df: DataFrame, text: str, keys: Sequence[str], catalogue: DataFrame, item: str, item_text: str
) -> DataFrame:
    """Catalogue items whose words overlap a text best, by Jaccard similarity; the best reaches 0.2.

    Items within 80 % of the best score are returned together and flagged as ambiguous.

    Equal word sets are matched once, so copies of a text cost nothing. A pair can only reach the
    least useful score when it shares one of the rarer words of both sides; each side therefore
    offers only that prefix of its words, and the most common words never meet in the join.
    """
    least = fixed.MATCH_MIN_SCORE * fixed.MATCH_NEAR_TIE - 1e-9
    tokens = match_tokens(F.col(text))
    texts = df.select(*keys, tokens.alias("_tokens")).where(F.size("_tokens") > 0).withColumn(
        "_set", F.sha2(F.concat_ws(" ", "_tokens"), 256)
    )
    sets = texts.groupBy("_set").agg(F.first("_tokens").alias("_tokens"))
    items = catalogue.select(F.col(item).alias("_item"), match_tokens(F.col(item_text)).alias("_tokens")).where(
        F.size("_tokens") > 0
    )
    # How many catalogue items hold a word; words unknown there sort first and never join.
    counts = items.select(F.explode("_tokens").alias("_word")).groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))

    def offered(frame: DataFrame, key: str) -> DataFrame:
        weighed = frame.select(key, F.explode("_tokens").alias("_word")).join(counts, "_word", "left")
        entry = F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_word").alias("w"))
        # The list is one text's own distinct words, so its length is the row's, not the table's.
        ordered = weighed.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("_order"))
        length = F.size("_order") - F.ceil(least * F.size("_order")).cast("int") + 1
        return ordered.select(key, F.explode(F.slice("_order", F.lit(1), length)).alias("_entry")).where(
            F.col("_entry.n") > 0
        ).select(key, F.col("_entry.w").alias("_word"))

    pairs = offered(sets, "_set").join(offered(items, "_item"), "_word").select("_set", "_item").dropDuplicates()
    shared = F.size(F.array_intersect("_tokens", "_item_tokens"))
    score = shared / (F.size("_tokens") + F.size("_item_tokens") - shared)
    scored = (
        pairs.join(sets, "_set").join(items.withColumnRenamed("_tokens", "_item_tokens"), "_item")
        .select("_set", "_item", score.alias("score"))
    )
    by_set = Window.partitionBy("_set")
    best = (
        scored.withColumn("_best", F.max("score").over(by_set))
        .where((F.col("_best") >= fixed.MATCH_MIN_SCORE) & (F.col("score") >= F.col("_best") * fixed.MATCH_NEAR_TIE))
        .withColumn("is_ambiguous", F.count(F.lit(1)).over(by_set) > 1)
    )
    return texts.select(*keys, "_set").join(best, "_set").select(
        *keys, F.col("_item").alias(item), "score", "is_ambiguous"
    )
