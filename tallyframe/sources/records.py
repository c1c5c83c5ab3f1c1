"""Records that go over line ends, from files that many tasks read.

A task that begins in the middle of a file cannot tell whether it is inside a quoted text. Each range of a
file therefore reports what it does to either state; a running composition over the ranges, one row each,
settles in which state every range begins. Ranges then cut their own records, and the pieces that cross
the ends of ranges, two a range at most, are put together.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.sources.shared import shared_folder

#: A field of a line that is whole: quoted, or begun without a quote, or empty. A quote inside a plain field is a character.
FIELD = r'(?:"(?:[^"]++|"")*+"[^",]*+|[^",][^,]*+|)'
WHOLE_LINE = rf"^{FIELD}(?:,{FIELD})*+$"
_CLOSED = re.compile(FIELD + r"(?:,|\Z)")
_STRING = re.compile(r'"(?:[^"\\]++|\\.)*+"')
_TO_QUOTE = re.compile(r'(?:[^"\\]++|\\.)*+"')


def line_state(line: str, inside: bool) -> bool:
    """Whether a line of delimited text ends inside quotes, given whether it begins there."""
    if '"' not in line:
        return inside
    at = 0
    if inside:
        end = re.match(r'(?:[^"]++|"")*+"', line)
        if not end:
            return True
        rest = line.find(",", end.end())
        if rest < 0:
            return False
        at = rest + 1
    while at < len(line):
        field = _CLOSED.match(line, at)
        if not field:
            return True
        at = field.end()
    return False


def brace_state(piece: str, inside: bool) -> tuple[bool, int]:
    """For a piece of JSON between closing braces: whether it ends inside a string, and how the depth of lists and objects changes."""
    if inside:
        end = _TO_QUOTE.match(piece)
        if not end:
            return True, 0
        piece = piece[end.end() :]
    bare = _STRING.sub("", piece)
    at = bare.find('"')
    if at >= 0:
        bare = bare[:at]
    return at >= 0, bare.count("{") + bare.count("[") - bare.count("]")


class _Lines:
    """Delimited text: pieces are lines; a record ends with a line that ends outside quotes."""

    separator = "\n"
    plain_keeps = True  # a piece without a quote changes no state

    def move(self, piece: str, inside: bool, depth: int) -> tuple[bool, int, bool]:
        inside = line_state(piece, inside)
        return inside, 0, not inside


class _Objects:
    """A list of JSON objects: pieces end with a closing brace; a record ends where the depth is that of the list again."""

    separator = "}"
    plain_keeps = False

    def move(self, piece: str, inside: bool, depth: int) -> tuple[bool, int, bool]:
        inside, change = brace_state(piece, inside)
        depth += change - (not inside)  # the brace that ended the piece is text if inside a string
        return inside, depth, not inside and depth == 1


_RANGE = "file string, at long, out0 boolean, out1 boolean, depth0 long, depth1 long"
_PIECE = "file string, at long, seq long, kind string, first boolean, text string"


def _pieces(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """file, at (the start of the range that a task reads) and value, in the order of the file within each range."""
    text = spark.read.option("lineSep", separator).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        file = batch.column(0).dictionary_encode()  # a name is decoded once a batch, not once a piece
        names = file.dictionary.to_pylist()
        yield from zip(map(names.__getitem__, file.indices.to_pylist()), *(c.to_pylist() for c in batch.columns[1:]))


def _effects(kind):
    """What each range does: the state it ends in, and the change of depth, from outside and from inside quotes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}
        for file, at, value in _by_range(batches):
            own = found.setdefault((file, at), [False, True, 0, 0])
            if kind.plain_keeps and '"' not in value:
                continue
            for begun in (0, 1):
                inside, depth, _ = kind.move(value, own[begun], own[2 + begun])
                own[begun], own[2 + begun] = inside, depth
        rows = [(*key, *own) for key, own in found.items()]
        if rows:
            names = [c.split()[0] for c in _RANGE.split(", ")]
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))))

    return run


def _states(effects: DataFrame) -> DataFrame:
    """file, at, inside and depth: how each range begins, and the same behind it.

    A range keeps the state, turns it round, or settles it whatever it was. The state is that of the last
    one that settles it, turned round as often as ranges since then do.
    """
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    settles, turns = F.col("out0") == F.col("out1"), F.col("out0") & ~F.col("out1")
    turned = F.coalesce(F.sum(turns.cast("int")).over(before), F.lit(0))
    marked = effects.withColumns({"turned": turned})
    last = F.last(F.when(settles, F.struct(F.col("out0").cast("int").alias("state"), F.col("turned").alias("then"))), ignorenulls=True).over(before)
    state = (F.coalesce(F.col("last.state"), F.lit(0)) + F.col("turned") - F.coalesce(F.col("last.then"), F.lit(0))) % 2
    begun = marked.withColumn("last", last).withColumn("inside", state == 1)
    deeper = F.when(F.col("inside"), F.col("depth1")).otherwise(F.col("depth0"))
    return begun.withColumns({
        "depth": F.coalesce(F.sum(deeper).over(before), F.lit(0)).cast("long"),
        "ends_inside": F.when(F.col("inside"), F.col("out1")).otherwise(F.col("out0")),
    }).withColumn("ends_depth", F.col("depth") + deeper).select("file", "at", "inside", "depth", "ends_inside", "ends_depth")


def _cut(kind):
    """Pieces with the state of their range to whole records, and to what begins or ends outside the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        names = [c.split()[0] for c in _PIECE.split(", ")]

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))))
            out.clear()
            return batch

        key, held, inside, depth, open_, seq = None, [], False, 0, False, 0
        for file, at, value, begun_inside, begun_depth in _by_range(batches):
            if (file, at) != key:
                if held:
                    out.append((*key, seq, "middle" if open_ else "tail", key[1] == 0 and seq == 0, kind.separator.join(held)))
                key, held, inside, depth, seq = (file, at), [], begun_inside, begun_depth, 0
                open_ = inside or depth > 1  # a record that began before
            held.append(value)
            inside, depth, ended = kind.move(value, inside, depth)
            if ended:
                out.append((file, at, seq, "head" if open_ else "whole", at == 0 and seq == 0, kind.separator.join(held)))
                held, open_, seq = [], False, seq + 1
                if len(out) >= 2000:
                    yield flushed()
        if held:
            out.append((*key, seq, "middle" if open_ else "tail", key[1] == 0 and seq == 0, kind.separator.join(held)))
        if out:
            yield flushed()

    return run


def _records(spark: SparkSession, path: str | list[str], kind) -> tuple[DataFrame, DataFrame]:
    """(file, first, text) of all records, and the states; first marks the first record of a file."""
    pieces = _pieces(spark, path, kind.separator)
    states = _states(pieces.mapInArrow(_effects(kind), _RANGE))
    folder = shared_folder(spark, "ranges")
    states.write.parquet(folder)
    states = spark.read.parquet(folder)
    # one row a range of the files, so the broadcast is about a millionth of what is read
    placed = pieces.join(F.broadcast(states.select("file", "at", "inside", "depth")), ["file", "at"]).select("file", "at", "value", "inside", "depth")
    # cut once and written, as whole records and pieces, and then the header, the types and the rows, are read in turn
    folder = shared_folder(spark, "records")
    placed.mapInArrow(_cut(kind), _PIECE).write.parquet(folder)
    cut = spark.read.schema(_PIECE).parquet(folder)
    whole = cut.where("kind = 'whole'").select("file", "first", "text")
    order = Window.partitionBy("file").orderBy("at", "seq")
    parts = cut.where("kind != 'whole'").withColumn("record", F.sum((F.col("kind") == "tail").cast("int")).over(order))
    joined = parts.groupBy("file", "record").agg(
        F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("at", "seq", "text"))).alias("parts"),
    ).select("file", "first", F.array_join(F.transform("parts", lambda p: p["text"]), kind.separator).alias("text"))
    return whole.unionByName(joined), states


def _ends(states: DataFrame) -> DataFrame:
    return states.groupBy("file").agg(F.max_by(F.struct("ends_inside", "ends_depth"), "at").alias("end")).select("file", "end.*")


def has_open_lines(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether any line of delimited text ends inside a quoted field; one scan, without shuffling."""
    text = spark.read.option("lineSep", "\n").text(path)
    return not text.where(F.col("value").contains('"') & ~F.regexp_replace("value", "\r$", "").rlike(WHOLE_LINE)).isEmpty()


def delimited_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, first, text) of every record of delimited text files; quoted fields may hold line ends.

    Text without a closing quote is an error. Blank records are left out, a byte order mark and the
    carriage return of a line end go.
    """
    records, states = _records(spark, path, _Lines())
    unclosed = _ends(states).where("ends_inside").first()
    if unclosed:
        raise ValueError(f"{unclosed['file']}: a quote is not closed")
    text = F.regexp_replace("text", "\r$", "")
    text = F.when(F.col("first"), F.regexp_replace(text, "^﻿", "")).otherwise(text)
    return records.withColumn("text", text).where("text != ''")


def listed_objects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(text) of every object in files that hold one JSON list each, as one line each."""
    records, states = _records(spark, path, _Objects())
    unclosed = _ends(states).where("ends_inside OR ends_depth != -1").first()
    if unclosed:
        raise ValueError(f"{unclosed['file']}: not a list of records, or it is not closed")
    start = F.when(F.col("first"), r"^﻿?\s*\[\s*").otherwise(r"^\s*,\s*")
    line = F.regexp_replace(F.regexp_replace("text", start, ""), r"[\r\n]+", " ")
    objects = records.withColumn("line", F.trim(line)).where(~F.trim("text").rlike(r"^(﻿?\s*\[)?\s*\]?\s*$"))
    wrong = F.raise_error(F.concat(F.lit("not a record: "), F.substring("line", 1, 80)))
    return objects.select(F.when(F.col("line").startswith("{"), F.concat("line", F.lit("}"))).otherwise(wrong).alias("text"))


# The functions that run in tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
