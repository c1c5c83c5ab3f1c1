"""Quality rules: rule failures of documents, and verdicts on whole hosts (native expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import WORD, let, materialize, named, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"


def _characters_left(text: Column, dropped: str) -> Column:
    return F.length(F.translate(text, dropped, ""))


def _repeated_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, from the hashes of all windows in order.

    Equal hashes meet by sorting (hash, position); the marked starts, back in order, each add the
    words up to the next marked start, at most one window.
    """

    def covered(starts: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(starts)), F.lit(0),
            lambda total, i: total + F.when(i == F.size(starts), WINDOW)
            .otherwise(F.least(F.lit(WINDOW), F.get(starts, i) - F.get(starts, i - 1))),
        )

    def marked(pairs: Column) -> Column:
        def twin(i: Column, other: Column) -> Column:
            return F.coalesce(F.get(pairs, i)["h"] == F.get(pairs, other)["h"], F.lit(False))

        index = F.sequence(F.lit(0), F.size(pairs) - 1)
        kept = F.filter(index, lambda i: twin(i, i - 1) | twin(i, i + 1))
        return F.sort_array(F.transform(kept, lambda i: F.get(pairs, i)["i"]))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
        let(let(pairs, marked), covered)
    )


def rule_measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per document: doc_id, host and the counts that the rules use.

    n_words, word_chars (characters in words), n_symbols, n_dup_lines (lines with a word that equal
    an earlier line) and n_repeat_words (words in 8-word windows found twice or more in the text).
    A null or empty text counts zero everywhere. One row per input row, repeated rows included;
    other columns are ignored. No shuffle; linear in the text, but for the sort of texts that repeat.
    """
    base = docs.select(
        named(doc_id).alias("doc_id"), named(host).alias("host"), F.coalesce(named(text), F.lit("")).alias("text")
    )
    words = base.select("doc_id", "host", "text", words_of(F.col("text")).alias("words"))
    windows = words.select(
        "doc_id", "host",
        F.size("words").cast("long").alias("n_words"),
        _characters_left(F.col("text"), " \t\n\x0b\x0c\r").cast("long").alias("word_chars"),
        (F.length("text") - _characters_left(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        let(
            F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD)),
            lambda lines: F.size(lines) - F.size(F.array_distinct(lines)),
        ).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("words") >= WINDOW,
            let(
                F.transform(
                    F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)),
                    lambda i: F.xxhash64(F.slice("words", i, F.lit(WINDOW))),
                ),
                _repeated_words,
            ),
        ).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return windows


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rule_failures() -> Column:
    """Any rule failed: the base rules, one symbol in ten characters, or half the words' lines repeated."""
    return base_failed() | (10 * F.col("n_symbols") > F.col("word_chars")) | (10 * F.col("n_dup_lines") > F.col("n_words"))


def host_verdicts(measures: DataFrame, max_rate: float = 0.5, sigmas: float = 2.0) -> DataFrame:
    """Per host: documents, failures, shrunk failure rate and verdict.

    The rates of all hosts give an empirical beta prior by moments: its mean is the overall rate, its
    strength follows from the variance between hosts beyond what sampling explains. A host is
    rejected if its posterior rate less `sigmas` posterior deviations exceeds `max_rate`, so hosts
    with few documents stay unless nearly all fail. Null is a host of its own; no rows, no hosts.
    """
    hosts = measures.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.when(rule_failures(), 1).otherwise(0)).alias("n_failed")
    )
    n, k = F.col("n_docs"), F.col("n_failed")
    prior = hosts.agg(F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(k * k / n).alias("kk"), F.count(F.lit(1)).alias("hosts"))
    rate = F.col("k") / F.col("n")
    sampling = rate * (1 - rate) * F.col("hosts") / F.col("n")
    between = F.col("kk") / F.col("n") - rate * rate - sampling
    prior = prior.where("n > 0").select(
        rate.alias("mean"),
        # between 1 and a million documents' worth of prior
        F.least(F.lit(1e6), F.greatest(F.lit(1.0), F.coalesce(
            F.when(between > 0, F.try_divide(rate * (1 - rate), between) - 1), F.lit(1e6)))).alias("strength"),
    )
    posterior = (k + F.col("mean") * F.col("strength")) / (n + F.col("strength"))
    shrunk = hosts.join(F.broadcast(prior)).withColumn("host_rate", posterior)  # one row
    deviation = F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (n + F.col("strength") + 1))
    return shrunk.select(
        "host", "n_docs", "n_failed", "host_rate", (F.col("host_rate") - sigmas * deviation > max_rate).alias("host_rejected")
    )


def apply_host_rules(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
    max_rate: float = 0.5, sigmas: float = 2.0,
) -> DataFrame:
    """The measures of every document with base_failed, the host's shrunk rate and kept.

    kept is false where a base rule fails, else true unless the host is rejected. The texts are read
    once: the measures, some numbers a document, are written and joined with the verdicts.
    """
    measures = materialize(rule_measures(docs, doc_id, text, host), "rule-measures")
    verdicts = host_verdicts(measures, max_rate, sigmas).select(F.col("host").alias("_host"), "host_rate", "host_rejected")
    return measures.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & ~F.col("host_rejected")).alias("kept"), "host_rate",
    )
