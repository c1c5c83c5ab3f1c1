"""Byte-level BPE: ranked merges of the distinct words of a task, a step of all words at once."""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import named, release_memory, text_batches, tidy

#: Splits text into the words within which bytes merge. White space is spelled out, since the
#: engines differ in what they call so.
_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Places of the rank map, some five times as many as entries, so that rows of entries fit in quickly.
PLACES = 1 << 19
_IDS = 1 << 16
#: Words gathered by one task before their distinct forms are encoded.
PACK_WORDS = 500_000
#: Bytes of one Arrow batch, so that packs go on two at a time at most; Spark's own 64 MB hold some ten and more.
BATCH_BYTES = "4m"
#: Frequent words whose ids every task is given, and the documents, chosen by a hash of their text, in
#: which they are counted. They spare merging the same words in every pack; any list gives the same ids.
#: Words seen once are listed, too, while there is room: rare words are most of what packs merge.
FREQUENT_WORDS = 1 << 19
FREQUENT_DOCS = 20_000
#: Words of more bytes, long runs without a break, are merged with a heap.
LONG_WORD = 64


def spark_pattern(pattern: str) -> str:
    """A pattern with \\s as Spark's expressions read it: \\s spelled out, so that it means Unicode white space."""
    return pattern.replace(r"[^\s", "[^" + _SPACE).replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines: base64 of the bytes, a space, the rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, dict[int, int]]:
    """By first token and second token: the rank of what the two make together."""
    pairs: dict[int, dict[int, int]] = {}
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            if (a := ranks.get(piece[:cut])) is not None and (b := ranks.get(piece[cut:])) is not None:
                pairs.setdefault(a, {})[b] = rank
    return pairs


def rank_map(spark: SparkSession, ranks: dict[bytes, int]) -> Broadcast:
    """The ranks of pairs, which executors get once: two arrays that work as a sparse table.

    `at` says where the row of a first token begins in `of`; the second token is the place from there.
    Rows lie over each other where their entries leave room, so an entry repeats its first token, in
    its upper 16 bits. A lookup reads one entry.
    """
    if max(ranks.values(), default=0) >= _IDS - 1:
        raise ValueError("ids need to fit in 16 bits")
    rng = np.random.default_rng(1)
    taken, of, at = np.zeros(PLACES + _IDS, bool), np.full(PLACES + _IDS, 0xFFFFFFFF, np.uint32), np.zeros(_IDS, np.int32)
    for a, row in sorted(pair_ranks(ranks).items(), key=lambda item: (-len(item[1]), item[0])):
        places = np.fromiter(row, np.int64, len(row))
        start = int(rng.integers(PLACES))
        while taken[start + places].any():
            start = int(rng.integers(PLACES))
        taken[start + places], at[a] = True, start
        of[start + places] = np.uint32(a << 16) | np.fromiter(row.values(), np.uint32, len(row))
    return spark.sparkContext.broadcast((at, of))


def merged_ids(pieces: np.ndarray, sizes: np.ndarray, at: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words, joined, and how many each has; words come as the ids of their bytes, joined, and their sizes.

    Each step merges in every word the leftmost pair of the lowest rank, which is the id of what the
    two make; only pairs beside a merge are ranked anew, and words that have no such pair leave the steps.
    """
    nothing = _IDS - 1

    def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        entry = of[at[a] + b]
        return np.where(entry >> 16 == a, entry & nothing, nothing).astype(np.int32)

    out, sizes, starts = np.array(pieces, np.int32), np.array(sizes, np.int64), np.cumsum(sizes) - sizes
    words = np.flatnonzero(sizes)
    word, ids, ranks = np.repeat(np.arange(len(sizes)), sizes), out.copy(), np.full(len(out), nothing, np.int32)
    ranks[:-1] = np.where(word[1:] == word[:-1], rank(ids[:-1], ids[1:]), nothing)
    while len(words):
        lengths = sizes[words]
        lowest = np.minimum.reduceat(ranks, np.cumsum(lengths) - lengths)
        goes_on = lowest < nothing
        if not goes_on.all():
            stays = np.repeat(goes_on, lengths)
            ended = words[~goes_on]
            counts = sizes[ended]
            out[np.repeat(starts[ended] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())] = ids[~stays]
            words, lengths, lowest, word, ids, ranks = words[goes_on], lengths[goes_on], lowest[goes_on], word[stays], ids[stays], ranks[stays]
        found = np.flatnonzero(ranks == np.repeat(lowest, lengths))
        found = found[np.flatnonzero(np.diff(word[found], prepend=-1))]  # the first of each word
        ids[found] = lowest
        sizes[words] -= 1
        ranks[found] = ranks[found + 1]  # nothing where the word ends here
        kept = np.ones(len(ids), bool)
        kept[found + 1] = False
        word, ids, ranks = word[kept], ids[kept], ranks[kept]
        found -= np.arange(len(found))
        before = found[np.flatnonzero(word[found] == word[found - 1])] - 1
        before = before[before >= 0]
        after = found[:-1] if len(found) and found[-1] == len(ids) - 1 else found
        after = after[np.flatnonzero(word[after] == word[after + 1])]
        ranks[before], ranks[after] = rank(ids[before], ids[before + 1]), rank(ids[after], ids[after + 1])
    return out[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())], sizes


def heap_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for one long word, in n log n steps: pairs wait in a heap, ordered by rank and place."""
    if word in ranks:
        return [ranks[word]]
    end = list(range(1, len(word) + 1))  # where the piece that starts here ends; 0 once it is merged
    before = list(range(-1, len(word) - 1))
    waiting: list[tuple[int, int, int, int]] = []

    def offer(a: int) -> None:
        b = end[a]
        if b < len(word) and (rank := ranks.get(word[a : end[b]])) is not None:
            heapq.heappush(waiting, (rank, a, b, end[b]))

    for a in range(len(word) - 1):
        offer(a)
    while waiting:
        _, a, b, c = heapq.heappop(waiting)
        if end[a] != b or end[b] != c:
            continue
        end[a], end[b] = c, 0
        if c < len(word):
            before[c] = a
        if before[a] >= 0:
            offer(before[a])
        offer(a)
    out, a = [], 0
    while a < len(word):
        out.append(ranks[word[a : end[a]]])
        a = end[a]
    return out


def _letters(ranks: dict[bytes, int]) -> np.ndarray:
    return np.array([ranks.get(bytes([i]), 0) for i in range(256)], np.int32)


def _spelled(ranks_path: str, table: Broadcast):
    """Rows (word) to one row a batch: the words that are no tokens, and the ids of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(ranks_path)
        letters, vocabulary = _letters(ranks), pa.array(list(ranks), pa.binary())
        del ranks
        for batch in batches:
            words = batch.column(0).filter(pc.invert(pc.is_in(batch.column(0), vocabulary)))
            widths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, sizes = merged_ids(letters[np.frombuffer(b"".join(words.to_pylist()), np.uint8)], widths, *table.value)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat))
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            yield pa.RecordBatch.from_arrays([one(words), one(ids)], ["words", "ids"])

    return run


def frequent_words(words: DataFrame, ranks_path: str, table: Broadcast) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words most frequent in the given rows that are neither tokens nor long, bounded; their ids, joined; how many each has."""
    counted = words.select(F.explode("words").alias("w")).groupBy("w").count()
    top = counted.where(F.octet_length("w") <= LONG_WORD).orderBy(F.desc("count"), "w").limit(FREQUENT_WORDS)
    shape = "words array<binary>, ids array<array<int>>"
    found = top.select(F.col("w").cast("binary").alias("word")).repartition(12).mapInArrow(tidy(_spelled(ranks_path, table)), shape).toArrow()
    lists = [pa.concat_arrays([chunk.flatten() for chunk in found.column(i).chunks] or [pa.array([], kind)]) for i, kind in ((0, pa.binary()), (1, pa.list_(pa.int32())))]
    return lists[0], lists[1].flatten().to_numpy(), pc.list_value_length(lists[1]).to_numpy(zero_copy_only=False).astype(np.int64)


def _pack(ranks_path: str, frequent: Broadcast, table: Broadcast):
    """Rows (doc_id, words) to packs: doc_ids, words per document, a code per word, and the ids of the distinct words.

    A distinct word has no ids here if it is a frequent one, whose number is in `known`, or a long
    one, which `_unpack` merges.
    """

    def packed(parts: list[pa.RecordBatch], vocabulary: pa.Array, own: np.ndarray, letters: np.ndarray) -> pa.RecordBatch:
        sizes = np.concatenate([np.diff(p.column(1).offsets.to_numpy()) for p in parts]).astype("<i4")
        doc_ids = pa.chunked_array([p.column(0) for p in parts]).combine_chunks()
        coded = pa.chunked_array([p.column(1).flatten().cast(pa.binary()) for p in parts]).dictionary_encode()
        parts.clear()
        words = coded.chunk(coded.num_chunks - 1).dictionary if coded.num_chunks else pa.array([], pa.binary())  # one for all chunks
        codes = np.concatenate([np.empty(0, np.int32), *(chunk.indices.to_numpy() for chunk in coded.chunks)]).astype("<i4")
        del coded
        widths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = letters[np.frombuffer(words.buffers()[2] or b"", np.uint8)[: int(widths.sum())]]
        number = lambda of, among: pc.index_in(of, among).fill_null(-1).to_numpy(zero_copy_only=False)
        # the longer list is looked up among the words: only what is looked up in has to be hashed
        token, listed = number(words, vocabulary), number(frequent.value[0], words)
        known = np.full(len(words), -1, np.int32)
        known[listed[listed >= 0]] = np.flatnonzero(listed >= 0)
        long = (widths > LONG_WORD) & (token < 0)
        starts = np.cumsum(widths) - widths
        flat[starts[token >= 0]] = own[token[token >= 0]]
        kept = np.where(token >= 0, 1, np.where(long | (known >= 0), 0, widths))
        ends = np.cumsum(kept)
        flat = flat[np.repeat(starts - (ends - kept), kept) + np.arange(int(ends[-1]) if len(ends) else 0)]
        flat, kept = merged_ids(flat, kept, *table.value)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        raw = lambda values: pa.array([values.astype("<i4").tobytes()], pa.binary())
        at = np.flatnonzero(long)
        return pa.RecordBatch.from_arrays(
            [one(doc_ids), raw(sizes), raw(codes), raw(known), raw(flat), raw(kept), raw(at), one(words.take(pa.array(at)))],
            ["doc_ids", "sizes", "codes", "known", "ids", "counts", "long", "long_words"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(ranks_path)
        vocabulary, own = pa.array(list(ranks), pa.binary()), np.array(list(ranks.values()), np.int32)
        letters = _letters(ranks)
        del ranks
        parts, held = [], 0
        for batch in batches:
            n = len(batch.column(1).flatten())
            if held and held + n > PACK_WORDS:
                yield packed(parts, vocabulary, own, letters)
                release_memory()  # the other worker of the task needs room
                parts, held = [], 0
            parts.append(batch)
            held += n
        if parts:
            yield packed(parts, vocabulary, own, letters)

    return run


def _unpack(ranks_path: str, frequent: Broadcast):
    """Packs with the ids of their words to rows (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks: dict[bytes, int] = {}
        ints = lambda value: np.frombuffer(value.as_py(), "<i4").astype(np.int64)
        known_flat, known_sizes = frequent.value[1:]
        known_starts = np.cumsum(known_sizes) - known_sizes
        for batch in batches:
            for row in range(len(batch)):
                per_doc, codes, known, sizes, long = (ints(batch.column(c)[row]) for c in (1, 2, 3, 5, 6))
                doc_ids, own = batch.column(0)[row].values, np.frombuffer(batch.column(4)[row].as_py(), "<i4")
                starts = np.cumsum(sizes) - sizes + len(known_flat)
                listed = known >= 0
                starts[listed], sizes[listed] = known_starts[known[listed]], known_sizes[known[listed]]
                extra: list[np.ndarray] = []
                if len(long):
                    ranks = ranks or read_ranks(ranks_path)
                    extra = [np.array(heap_ids(word, ranks), np.int32) for word in batch.column(7)[row].values.to_pylist()]
                    sizes[long] = list(map(len, extra))
                    starts[long] = len(known_flat) + len(own) + np.cumsum(sizes[long]) - sizes[long]
                flat = np.concatenate([known_flat, own, *extra])
                ends = np.cumsum(per_doc)
                at = 0
                while at < len(per_doc):  # some documents at a time, about a quarter of a million words
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 250_000)))
                    mine = codes[ends[at] - per_doc[at] : ends[to - 1]]
                    lengths = sizes[mine]
                    stops = np.cumsum(lengths)
                    tokens = flat[np.repeat(starts[mine] - (stops - lengths), lengths) + np.arange(int(stops[-1]) if len(stops) else 0)]
                    cuts = np.concatenate(([0], stops))[np.concatenate(([0], ends[at:to] - (ends[at] - per_doc[at])))]
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids.slice(at, to - at), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(tokens, pa.int32()))],
                        ["doc_id", "ids"],
                    )
                    at = to
                flat = own = starts = sizes = codes = tokens = None
            del batch
            release_memory()

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row: the whole text encoded, without special tokens.

    Each match of the pattern is a word. A task gathers some half a million words and merges the distinct
    ones; their ids then stand for every place of theirs. Words that are frequent in a sample are merged
    once beforehand, and every task is given their ids, some 25 MB at most. Texts are never shuffled.
    Words of more than 64 bytes, which would take too many steps, are merged with a heap instead.
    Null and empty texts have no ids; a null doc_id is kept; repeated rows each give a row; no rows
    give no rows; other columns are ignored.
    """
    spark = text_batches(docs.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    table = rank_map(spark, read_ranks(ranks_path))
    release_memory()

    def split(rows: DataFrame) -> DataFrame:
        found = F.regexp_extract_all(F.coalesce(named(text), F.lit("")), F.lit(spark_pattern(pattern)), F.lit(0))
        return rows.select(named(doc_id).cast("long").alias("doc_id"), found.alias("words"))

    every = max(1, -(-docs.count() // FREQUENT_DOCS))
    some = docs.where(F.pmod(F.xxhash64(named(text)), F.lit(every)) == 0) if every > 1 else docs
    frequent = spark.sparkContext.broadcast(frequent_words(split(some), ranks_path, table))  # at most 524,288 short words
    release_memory()
    shape = "doc_ids array<bigint>, sizes binary, codes binary, known binary, ids binary, counts binary, long binary, long_words array<binary>"
    packs = split(docs).mapInArrow(tidy(_pack(ranks_path, frequent, table)), shape)
    return packs.mapInArrow(tidy(_unpack(ranks_path, frequent)), "doc_id long, ids array<int>")


def ids_digest(ids: Column) -> Column:
    """The SHA-256 of the decimal ids joined by commas, lowercase hex; written by Spark's JSON writer, without its brackets."""
    listed = F.to_json(ids).cast("binary")
    return F.sha2(F.substring(listed, F.lit(2), F.octet_length(listed) - 2), 256)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids and decoded (binary): the pieces of the ids, concatenated; null ids give no bytes.

    Spark's own expressions join the pieces, one character a byte, so a task needs no Python worker for them.
    """
    ranks = read_ranks(ranks_path)
    table = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        table[rank] = piece.decode("latin-1")
    pieces = F.from_json(F.lit(json.dumps(table)), "array<string>")  # folded to a literal
    del ranks, table
    release_memory()
    filled = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    joined = F.array_join(F.transform("ids", lambda i: pieces[i]), "")
    return filled.select("doc_id", "ids", F.encode(joined, "ISO-8859-1").alias("decoded"))
