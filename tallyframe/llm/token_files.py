"""Token ids as flat binary files with document offsets, and reading them back."""

from __future__ import annotations

import itertools
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import materialize, named, text_batches, tidy, worker_state
from tallyframe.sources.shared import shared_folder

#: Units of text whose ids a worker keeps, about 100 MB of them, and bytes of texts encoded together.
CACHE_UNITS = 2_000_000
PACK_BYTES = 8 << 20
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WORD_AND_SIGNS = "^[A-Za-z]+[" + "".join("\\" + c for c in _SIGNS) + "]*$"


class _Units:
    """A tokenizer, and the units of text that it has encoded in this worker: their ids, one after the other."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.units, self.sizes, self.flat = pa.array([], pa.large_string()), np.empty(0, np.int64), np.empty(0, np.uint32)

    def ids(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct units: where the ids of each start in the returned array, and how many there are."""
        if len(self.units) + len(units) > max(CACHE_UNITS, len(units)):
            self.clear()
        found = pc.index_in(units, self.units)
        missing = units.filter(found.is_null())
        sizes, flats = [self.sizes], [self.flat]
        for at in range(0, len(missing), 20_000):
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(missing.slice(at, 20_000).to_pylist(), add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, coded), np.int64, len(coded)))
            flats.append(np.fromiter(itertools.chain.from_iterable(coded), np.uint32, int(sizes[-1].sum())))
        place = found.to_numpy(zero_copy_only=False).astype(float)
        place[np.isnan(place)] = len(self.units) + np.arange(len(missing))
        self.units = pa.concat_arrays([self.units, missing])
        self.sizes, self.flat = np.concatenate(sizes), np.concatenate(flats)
        place = place.astype(np.int64)
        return (np.cumsum(self.sizes) - self.sizes)[place], self.sizes[place], self.flat


def _open(path: str) -> _Units:
    opened = worker_state("tokenizers")
    if path not in opened:
        opened[path] = _Units(path)
    return opened[path]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its size says, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, one after the other, and the number of ids of each.

    For tokenizers that drop white space, treat what it separates alone, and letters and signs alone
    within that, in lower case, as word-level BPE does: the library encodes each distinct unit once in a
    worker, and its ids stand for every place where the unit occurs. Units are the pieces between ASCII
    white space; a piece of ASCII letters and then signs is two, the letters in lower case. Null is empty.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    coded = lists.flatten().dictionary_encode()
    pieces, codes = coded.dictionary, coded.indices.to_numpy()
    plain = pc.match_substring_regex(pieces, _WORD_AND_SIGNS)
    first = pc.if_else(plain, pc.ascii_lower(pc.ascii_rtrim(pieces, _SIGNS)), pieces)
    signs = pc.if_else(plain, pc.ascii_ltrim(pieces, _LETTERS), "")
    units = pa.chunked_array([first, signs.cast(pa.large_string())]).combine_chunks().dictionary_encode()
    starts, sizes, flat = _open(path).ids(units.dictionary)
    pair = units.indices.to_numpy().reshape(2, -1)  # the units of each piece; no signs are a unit without ids
    both = pair[:, codes].T.ravel()
    ids = flat[_ranges(starts[both], sizes[both])]
    ends = np.concatenate(([0], np.cumsum(sizes[pair[0]][codes] + sizes[pair[1]][codes])))
    bounds = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return ids, np.diff(bounds)


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of some megabytes in the same order, so that a unit is looked up once for many texts."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= PACK_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def with_ends(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id after each document."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


def id_type(vocabulary: int) -> np.dtype:
    """The smallest little-endian unsigned type that holds every id."""
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


def _store(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if ":/" in root else (fs.LocalFileSystem(), root)


def _mapped(root: str, name: str, kind: np.dtype) -> np.ndarray:
    """A flat file as an array: mapped from a local or mounted disk, read from any other store."""
    store, path = _store(root)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", kind, "r") if os.path.getsize(f"{path}/{name}") else np.empty(0, kind)
    with store.open_input_file(f"{path}/{name}") as file:
        return np.frombuffer(file.read(), kind)


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", folder: str | None = None,
) -> DataFrame:
    """Encode whole texts and write them, in ascending doc_id order, as shards; returns the manifest.

    Shard n is `ids` (flat unsigned integers: two bytes where the vocabulary allows, else four) with
    `offsets` (64-bit: the place in the shard where each document starts, and the shard's end) and
    `docs` (64-bit doc_ids). The manifest has a row a shard: shard, files (their common name), n_docs,
    n_tokens, bytes_each and base, the number of ids in all shards before it, a prefix sum. It is
    written as `manifest` into the folder, too.

    Rows are dealt by ranges of doc_id, so shards follow each other; a repeated doc_id keeps all its
    rows, in order of their texts; null doc_ids come first and are stored as the smallest 64-bit
    number; null texts are empty; every document has at least its end id. A task may run again: each
    attempt writes files of its own name, and the manifest names those of the attempt that counted.
    """
    spark = text_batches(docs.sparkSession)
    folder = folder or shared_folder(spark, "token-files")
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    kind = id_type(max(_open(tokenizer).tokenizer.get_vocab_size(), end_id + 1))
    chosen = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = chosen.repartitionByRange(parts, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    shape = "shard int, files string, n_docs long, n_tokens long, bytes_each int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        store, path = _store(folder)
        docs_out, starts, total = [], [np.zeros(1, np.int64)], 0
        with store.open_output_stream(f"{path}/{name}.ids") as out:
            for batch in _packs(batches):
                ids, counts = with_ends(*encode_texts(batch.column(1), tokenizer), end_id)
                out.write(ids.astype(kind).tobytes())
                docs_out.append(pc.fill_null(batch.column(0), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False))
                starts.append(total + np.cumsum(counts))
                total += len(ids)
        ids_of = np.concatenate(docs_out) if docs_out else np.empty(0, np.int64)
        for kind_of, values in (("offsets", np.concatenate(starts)), ("docs", ids_of)):
            with store.open_output_stream(f"{path}/{name}.{kind_of}") as out:
                out.write(values.astype("<i8").tobytes())
        yield pa.RecordBatch.from_pylist(
            [{"shard": shard, "files": name, "n_docs": len(ids_of), "n_tokens": total, "bytes_each": kind.itemsize}],
            pa.schema([("shard", pa.int32()), ("files", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("bytes_each", pa.int32())]),
        )

    shards = materialize(ordered.mapInArrow(tidy(run), shape), "token-shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    manifest = shards.select(
        "*", F.lit(folder).alias("folder"), F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("base")
    )
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The checksum is CRC-32 of the ids as little-endian 32-bit integers, whatever their width in the
    files. One task a shard or more; a shard is mapped, and its documents pass one at a time.
    """
    rows = 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                root, name = shard["folder"], shard["files"]
                ids = _mapped(root, f"{name}.ids", np.dtype(f"<u{shard['bytes_each']}"))
                offsets, docs = _mapped(root, f"{name}.offsets", np.dtype("<i8")), _mapped(root, f"{name}.docs", np.dtype("<i8"))
                for at in range(0, shard["n_docs"], rows):
                    cuts = np.asarray(offsets[at : at + rows + 1])
                    own = np.asarray(docs[at : at + rows])
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cuts, cuts[1:])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(own, mask=own == np.iinfo(np.int64).min), pa.array(cuts[:-1] + shard["base"]),
                        pa.array(np.diff(cuts)), pa.array(sums, pa.int64()),
                    ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = max(1, manifest.count())
    dealt = manifest.select("shard", "folder", "files", "n_docs", "bytes_each", "base").repartition(shards, "shard")
    return dealt.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
