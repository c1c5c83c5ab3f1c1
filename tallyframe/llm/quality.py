"""Text quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import named, refuse_clash, release_memory, text_batches, tidy
from tallyframe.llm.crf import Crf, fit, marginals

#: The bounds of the training sample: labelled documents, and lines of each, chosen by a hash of their place.
TRAIN_DOCS = 4000
TRAIN_LINES = 300
#: Upper ends of the value ranges of each measure of a line; a feature is a measure in a range.
_RANGES = (
    (0.0, 0.01, 0.04, 0.1),  # symbols per character
    (0.0, 0.01, 0.04, 0.1),  # exclamation and question marks per character
    (0.02, 0.1, 0.3, 0.6),  # capitals per letter
    (0.0, 0.02, 0.06, 0.15),  # digits per character
    (0.0, 0.03, 0.1, 0.3),  # words equal to the one before, per word
    (0.3, 0.5, 0.7, 0.9),  # distinct words per word
    (1.0, 3.0, 8.0, 20.0),  # words
    (2.0, 4.0, 6.0, 9.0),  # bytes per word
    (0.0, 0.02, 0.08, 0.2),  # other punctuation per character
    (0.0,),  # equal to an earlier line of the text
)
_SIZES = np.array([len(r) + 1 for r in _RANGES])
_STARTS = np.cumsum(_SIZES) - _SIZES
_OWN = int(_SIZES.sum())
#: A line's own features, those of the line before and after, the missing neighbours and a constant.
N_FEATURES = 3 * (_OWN + 1) + 1
BAD, GOOD = 0, 1


def _classes() -> np.ndarray:
    kind = np.zeros((5, 256), np.float32)
    for i in range(256):
        c = chr(i)
        kind[0, i] = i < 128 and c in "#*$%&|<>{}[]~^=_\\@"
        kind[1, i] = i < 128 and c in "!?"
        kind[2, i] = 65 <= i <= 90
        kind[3, i] = 48 <= i <= 57
        kind[4, i] = i < 128 and c in ".,;:'\"()-/+"
    return kind


def line_measures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of every line with a word (whole texts), lines per text, and bytes of each line.

    A text without such a line has one line of zeros, of weight one.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])
    white = (data == 32) | ((data >= 9) & (data <= 13))
    word_start = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
    word_end = np.flatnonzero(~white & np.concatenate((white[1:], [True]))) + 1
    line_end = np.flatnonzero(data == 10) + 1
    line_of_word = np.searchsorted(line_end, word_start, side="right")
    keep, words = np.unique(line_of_word, return_counts=True)  # lines with a word
    starts = np.concatenate(([0], line_end[:-1]))[keep]
    ends = line_end[keep] - 1
    text_of_line = np.searchsorted(ends_of_text, starts, side="right")
    n_texts = len(texts)
    empty = np.setdiff1d(np.arange(n_texts), text_of_line)
    measures = np.zeros((len(keep), len(_RANGES)), np.float64)
    if len(keep):
        size = (ends - starts).astype(np.float64)
        cut = np.stack([starts, ends], axis=1).ravel()
        kinds = _classes()
        sums = [np.add.reduceat(kinds[k][data], cut)[::2] for k in range(5)]
        letters = np.maximum(1.0, np.add.reduceat(((data >= 65) & (data <= 90) | (data >= 97) & (data <= 122) | (data > 127)).astype(np.float32), cut)[::2])
        # a hash of each word: its bytes, weighted by their place in it
        width = word_end - word_start
        place = np.arange(len(data)) - np.repeat(word_start, np.diff(np.append(word_start, len(data)))) if word_start[0] == 0 else None
        if place is None:
            at = np.searchsorted(word_start, np.arange(len(data)), side="right") - 1
            place = np.arange(len(data)) - word_start[np.maximum(at, 0)]
        factor = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))
        mixed = (data.astype(np.uint64) + np.uint64(1)) * factor[np.clip(place, 0, 255)]
        mixed[white] = 0
        hashes = np.add.reduceat(mixed, word_start)
        n = words.astype(np.float64)
        first = np.cumsum(words) - words
        again = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (width[1:] == width[:-1])))
        again[first] = False
        line_no = np.repeat(np.arange(len(keep)), words)
        order = np.lexsort((hashes, line_no))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line_no[order][1:] != line_no[order][:-1])
        distinct = np.bincount(line_no[order], fresh, len(keep))
        spot = np.arange(len(hashes)) - first[line_no]
        whole = np.add.reduceat(hashes * factor[spot & 255] + (spot >> 8).astype(np.uint64), first)
        order = np.lexsort((np.arange(len(keep)), whole, text_of_line))
        repeated = np.zeros(len(keep), bool)
        repeated[order[1:]] = (whole[order][1:] == whole[order][:-1]) & (text_of_line[order][1:] == text_of_line[order][:-1])
        measures = np.stack([
            sums[0] / size, sums[1] / size, sums[2] / letters, sums[3] / size, np.add.reduceat(again.astype(np.float64), first) / n,
            distinct / n, n, np.add.reduceat(width.astype(np.float64), first) / n, sums[4] / size, repeated.astype(np.float64),
        ], axis=1)
    all_text = np.concatenate((text_of_line, empty))
    order = np.argsort(all_text, kind="stable")
    measures = np.concatenate((measures, np.zeros((len(empty), len(_RANGES)))))[order]
    weight = np.concatenate(((ends - starts).astype(np.float64), np.ones(len(empty))))[order]
    return measures, np.bincount(all_text, minlength=n_texts), weight


def line_features(measures: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The features of each line: its own, and those of the lines before and after it in its text."""
    own = np.stack([np.searchsorted(r, measures[:, i]) + _STARTS[i] for i, r in enumerate(_RANGES)], axis=1)
    n, blank = len(own), np.full(own.shape[1], _OWN)
    first = np.zeros(n, bool)
    last = np.zeros(n, bool)
    first[np.cumsum(lengths) - lengths] = True
    last[np.cumsum(lengths) - 1] = True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = blank, blank
    return np.hstack([own, before + (_OWN + 1), after + 2 * (_OWN + 1), np.full((n, 1), 3 * (_OWN + 1))])


def chosen_lines(doc_id: int, lines: int) -> np.ndarray:
    """The places, in order, of the lines of a text that training sees: all, or TRAIN_LINES of least hash."""
    if lines <= TRAIN_LINES:
        return np.arange(lines)
    mixed = (np.arange(lines, dtype=np.uint64) + np.uint64(doc_id % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.sort(np.argsort(mixed ^ (mixed >> np.uint64(32)), kind="stable")[:TRAIN_LINES])


def _bytes(column: pa.Array) -> list[bytes]:
    return [(v or "").encode("utf-8", "surrogatepass") for v in column.to_pylist()]


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> Crf:
    """A field fitted on a bounded sample: at most 4,000 labelled documents, and 300 lines of each.

    Documents are chosen by a hash of their id among `labels`, lines by a hash of their place in the whole
    text, with the features of their neighbours there. Every line takes its document's label, weighted by
    its share of the lines chosen. Of rows that share an id, one counts. Rows without label, id or text are left out; with none, all weights
    are zero. Only features reach the driver: some 40 small numbers a line.
    """
    text_batches(docs.sparkSession)
    wanted = labels.select(named(doc_id).cast("long").alias("_id"), named(quality).cast("int").alias("_label")).where("_id IS NOT NULL AND _label IN (0, 1)")
    sample = wanted.groupBy("_id").agg(F.min("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_DOCS)
    chosen = docs.select(named(doc_id).cast("long").alias("_id"), named(text).alias("text")).where("text IS NOT NULL").join(F.broadcast(sample), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            measures, lengths, weights = line_measures(_bytes(batch.column(1))) if len(batch) else (None, [], None)
            if not len(batch):
                continue
            features, ends = line_features(measures, lengths), np.cumsum(lengths)
            rows = []
            for i, (end, length) in enumerate(zip(ends, lengths)):
                doc = batch.column(0)[i].as_py()
                part = end - length + chosen_lines(doc, int(length))
                rows.append({"id": doc, "label": batch.column(2)[i].as_py(), "lines": len(part),
                             "features": features[part].astype("<i2").tobytes(), "weights": (weights[part] / weights[part].sum()).astype("<f4").tobytes()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("id", pa.int64()), ("label", pa.int32()), ("lines", pa.int32()), ("features", pa.binary()), ("weights", pa.binary())]))

    found = chosen.select("_id", "text", "_label").mapInArrow(tidy(run), "id long, label int, lines int, features binary, weights binary")
    ones = found.groupBy("id").agg(F.min(F.struct("lines", "features", "weights", "label")).alias("row")).select("id", "row.*")
    rows = ones.toArrow().sort_by("id").to_pylist()
    if not rows:
        return Crf(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    lengths = np.array([r["lines"] for r in rows])
    width = 3 * len(_RANGES) + 1
    features = np.concatenate([np.frombuffer(r["features"], "<i2").reshape(-1, width) for r in rows]).astype(np.int32)
    weights = np.concatenate([np.frombuffer(r["weights"], "<f4") * r["lines"] for r in rows]).astype(np.float64)
    model = fit(features, np.repeat([r["label"] for r in rows], lengths), lengths, N_FEATURES, 2, row_weights=weights)
    del rows, features, weights
    release_memory()
    return model


def scored_rows(docs: DataFrame, model: Crf, text: str = "text") -> DataFrame:
    """row (all columns of a document) and the score of its text, 0 to 1: the length-weighted mean of
    its lines' probabilities of being good. Null and empty texts are scored as one empty line."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), named(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            measures, lengths, weights = line_measures(_bytes(batch.column(1)))
            good = marginals(model, line_features(measures, lengths), lengths)[:, GOOD]
            first = np.cumsum(lengths) - lengths
            values = np.add.reduceat(good * weights, first) / np.add.reduceat(weights, first)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(np.clip(values, 0.0, 1.0), 12))], ["row", "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    shape = StructType([StructField("row", rows.schema["row"].dataType), StructField("score", DoubleType())])
    return rows.mapInArrow(tidy(run), shape)


def with_scores(docs: DataFrame, model: Crf, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of the documents and the score of `scored_rows`; a document column of that name is an error."""
    refuse_clash(docs, score)
    return scored_rows(docs, model, text).select("row.*", F.col("score").alias(score))


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row; the model learns from rows not held out.

    Held out are the ids whose crc32 (of their decimal text) leaves 1 when divided by 3. A null id is
    not held out; repeated rows are scored each; no rows give no rows.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    known = labels.select(named(doc_id).alias("doc_id"), "quality").where(~held)
    model = train(docs, known, doc_id, text)
    chosen = docs.select(named(doc_id).alias("doc_id"), named(text).alias("text"))
    scored = with_scores(chosen, model)
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
