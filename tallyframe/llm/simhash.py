"""Near duplicates by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import materialize, named, tidy
from tallyframe.llm.components import components

BITS = 64
SEED = 42
#: Fingerprints that share a block and are compared with each other in one task; fuller blocks are
#: split by longer keys.
BLOCK_ROWS = 2048
#: Numbers of blocks to choose from; more blocks give longer shared keys, and more of them.
BLOCKS = (6, 7, 8, 10, 12, 16)
_WHITE = b" \t\n\x0b\x0c\r"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SLICE = 1 << 16


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The SimHash of a text: bit i is set if it is set in over half of the hashes of its shingles.

    Shingles are runs of `shingle` words (the whole sequence if shorter), space-joined, repeats
    included, A-Z lower-cased; no words give 0.
    """
    import xxhash

    # bytes.split() splits at exactly the white space of the word pattern
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :][:n].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, _SLICE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + _SLICE], last[at : at + _SLICE])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every row, computed from whole texts."""
    chosen = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return chosen.mapInArrow(tidy(run), "doc_id long, fp long")


def _bounds(blocks: int) -> list[tuple[int, int]]:
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    return list(zip(cuts, cuts[1:]))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def block_masks(blocks: int, distance: int) -> list[int]:
    """One mask for each choice of `blocks - distance` blocks.

    Fingerprints that differ in at most `distance` bits differ in at most that many blocks, so they
    agree under at least one of the masks.
    """
    parts = [sum(1 << bit for bit in range(a, b)) for a, b in _bounds(blocks)]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def _keys(fp: Column, masks: list[int]) -> Column:
    return F.explode(F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)]))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _block_links(fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links from the first member of each component of one block to its others: no more than members."""
    left = np.ones(len(fps), bool)
    for i in range(len(fps)):
        if not left[i]:
            continue
        left[i] = False
        edge, found = [i], []
        while edge:
            near = np.flatnonzero(left & (_popcount(fps ^ fps[edge.pop()]) <= distance))
            left[near] = False
            edge += near.tolist()
            found.append(near)
        members = np.concatenate(found)
        if len(members):
            yield np.full(len(members), fps[i]), fps[members]


def _links(distance: int):
    """Rows (key, fp) sorted by key to links between the fingerprints of a key."""

    def of(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
        found = []
        same = keys[1:] == keys[:-1]
        # Pairs are blocks of two; larger blocks, which are few, are walked.
        starts = np.flatnonzero(np.concatenate(([True], ~same)))
        sizes = np.diff(np.append(starts, len(keys)))
        two = starts[sizes == 2]
        two = two[_popcount(fps[two] ^ fps[two + 1]) <= distance]
        found.append((fps[two], fps[two + 1]))
        for at, size in zip(starts[sizes > 2], sizes[sizes > 2]):
            found.extend(_block_links(fps[at : at + size], distance))
        a, b = (np.concatenate([x[k] for x in found]).view(np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]) if len(a) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            fps = np.concatenate((fps, batch.column(1).to_numpy().view(np.uint64)))
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last key may go on
            if cut:
                if (out := of(keys[:cut], fps[:cut])) is not None:
                    yield out
                keys, fps = keys[cut:], fps[cut:]
        if len(keys) and (out := of(keys, fps)) is not None:
            yield out

    return run


def fingerprint_links(fps: DataFrame, distance: int = 4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links a, b that connect all fingerprints at `distance` or fewer bits from each other.

    fps: column fp, distinct. Only fingerprints that share a block key meet; in a block, links go from
    one member of each component to the others, never from all to all. The number of blocks is chosen
    so that keys outnumber fingerprints. Blocks fuller than `block_rows` are counted beforehand and
    left to a further pass over their members with longer keys; under the longest, 48 bits, a block
    holds at most 65,536 fingerprints and is compared whatever its size. Exact in every case: a close
    pair shares a key in each pass in which both take part, and leaves a pass only for the next.
    """
    spark = fps.sparkSession
    count = max(2, fps.count())
    choices = [b for b in BLOCKS if b > distance]
    first = next((i for i, b in enumerate(choices) if BITS * (b - distance) // b >= log2(count) + 1), len(choices) - 1)
    found, rest = [], fps.select("fp")
    for at in range(first, len(choices)):
        masks = block_masks(choices[at], distance)
        keyed = rest.select("fp", _keys(F.col("fp"), masks).alias("key")).select("key", "fp")
        full = None
        if at < len(choices) - 1:
            full = materialize(keyed.groupBy("key").count().where(F.col("count") > block_rows).select("key"), "full-blocks")
            if full.isEmpty():
                full = None
        fit = keyed if full is None else keyed.join(full, "key", "left_anti").select("key", "fp")
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        found.append(fit.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(tidy(_links(distance)), "a long, b long").distinct())
        if full is None:
            break
        rest = materialize(keyed.join(full, "key", "left_semi").select("fp").distinct(), "full-members")
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row.

    Equal fingerprints are one node, so copies meet in an aggregation and never in pairs. Null and
    empty texts have fingerprint zero and are linked like any other; a null doc_id takes part but is
    never a component's id, unless all its members are null; repeated rows are kept; no rows give no
    rows; other columns are ignored.
    """
    prints = materialize(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    roots = components(fingerprint_links(nodes.select("fp"), distance, block_rows))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        F.col("fp"), "least", F.coalesce("root", "fp").alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    named_nodes = materialize(
        rooted.join(ids, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id"), "fingerprint-components"
    )
    return prints.join(named_nodes, F.col("fp") == F.col("f"), "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
