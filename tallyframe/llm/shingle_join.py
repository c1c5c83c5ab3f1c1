"""Near duplicates by the Jaccard similarity of word shingles: candidates from SimHash classes and MinHash bands, each verified.

SimHash puts texts whose fingerprints are few bits apart into classes, and every member is compared with
one of its class. Texts at 0.8 are some ten of 64 bits apart, more than blocks of fingerprints can find,
so bands of minima bring together what the fingerprints leave apart. Texts of similarity s agree in a band of ROWS minima with probability s ** ROWS, so a pair at 0.8 meets
in none of the BANDS bands with probability (1 - 0.8 ** 4) ** 32, or 5e-8, and is then not found. What
meets is compared by its whole sets of shingles before it is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import has_repeats, materialize, named, text_batches, tidy
from tallyframe.llm.components import components
from tallyframe.llm.simhash import _LOWER, SEED, fingerprint, fingerprint_links

ROWS, BANDS = 4, 32
MINIMA = ROWS * BANDS
#: Minima in which candidates of the second round agree: six standard deviations under those of a pair at the threshold.
_DEVIATIONS = 6
#: Rows of one block whose sets meet in one task; of larger blocks every two parts of half as many meet.
CELL_ROWS = 2048
_STEP = 1024
_ODD = np.random.default_rng(SEED).integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(SEED + 1).integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def shingles(text: str | None, shingle: int = 5) -> tuple[bytes, np.ndarray]:
    """A digest of the lower-cased words in order, and the sorted distinct 64-bit hashes of their shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    joined = b" ".join(words)
    if not words:
        return xxhash.xxh128_digest(joined, SEED), np.empty(0, np.uint64)
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    first = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    last = ends[min(shingle, len(words)) - 1 :][:n].tolist()
    hashes = np.fromiter((digest(view[a:b], SEED) for a, b in zip(first, last)), np.uint64, n)
    return xxhash.xxh128_digest(joined, SEED), np.unique(hashes)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of MINIMA hash functions over a set."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), _STEP):
        h = hashes[at : at + _STEP, None] * _ODD + _ADD
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, h.min(axis=0), out=least)
    return least


def _sketches(shingle: int):
    """Rows (d, t, text) to (d, t, digest, fp, bands, sketch); a sketch has a byte of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            digests, prints, bands, sketches = [], [], [], []
            for text in batch.column(2).to_pylist():
                digest, hashes = shingles(text, shingle)
                least = minima(hashes)
                digests.append(digest)
                prints.append(fingerprint(text))
                bands.append([xxhash.xxh64_intdigest(least[i : i + ROWS].tobytes(), i) - (1 << 63) for i in range(0, MINIMA, ROWS)])
                sketches.append((least & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["d", "t", "digest", "fp", "bands", "sketch"],
            )

    return run


def _sets(shingle: int):
    """Rows (node, text) to (node, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text.as_py(), shingle)[1].tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "set"])

    return run


def alike(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least the threshold."""
    if min(len(x), len(y)) < threshold * max(len(x), len(y)) - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= threshold * (len(x) + len(y) - both) - 1e-9


def _similar(threshold: float):
    """Rows (a, b, set of a, set of b) to the links of at least the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = ((np.frombuffer(v.as_py(), np.uint64) for v in both) for both in zip(batch.column(2), batch.column(3)))
            fine = [alike(x, y, threshold) for x, y in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(fine, pa.bool_()))

    return run


def _block_pairs(key: int, root: np.ndarray, sketch: np.ndarray, bands: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """A row of one block and rows of other components that agree with it in enough minima, likeliest first.

    Only rows outside the largest component are compared with the others. Rows that share an earlier
    band meet there.
    """
    _, which, count = np.unique(root, return_inverse=True, return_counts=True)
    outside = which != count.argmax()
    band = int((bands[0] == key).argmax())
    for i in np.flatnonzero(outside):
        others = np.flatnonzero((root != root[i]) & (~outside | (np.arange(len(root)) > i)))
        agree = (sketch[others] == sketch[i]).sum(axis=1)
        order = np.argsort(-agree, kind="stable")[: int((agree >= least).sum())]
        near = others[order]
        near = near[(bands[near] == bands[i]).argmax(axis=1) == band]
        if len(near):
            yield i, near


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by their first column, in pieces that cut no group of equal values, with the bounds of the groups."""

    def bounded(rows: pa.Table) -> tuple[pa.RecordBatch, np.ndarray]:
        groups = rows.column(0).to_numpy()
        return rows.combine_chunks().to_batches()[0], np.concatenate(([0], np.flatnonzero(groups[1:] != groups[:-1]) + 1, [len(groups)]))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if held[0].column(0)[0] == batch.column(0)[-1]:  # the last group may go on
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        cut = int(np.searchsorted(rows.column(0).to_numpy(), rows.column(0)[-1].as_py()))
        yield bounded(rows.slice(0, cut))
        held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        yield bounded(pa.Table.from_batches(held))


def _sketched(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The minima and the bands of rows, a line each."""
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, MINIMA)
    return sketch, rows.column("bands").flatten().to_numpy().reshape(-1, BANDS)


def _candidates(least: int, cell_rows: int = CELL_ROWS):
    """Rows (key, node, root, sketch, bands) sorted by key to those that may be alike to one of another component.

    What meets has one cell: all these rows of a block, or, of more than cell_rows, every two parts of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for rows, bounds in _whole_groups(batches):
            keys, roots = rows.column("key").to_numpy(), rows.column("root").to_numpy()
            sketch, bands = _sketched(rows)
            places, cells, held = [], [], 0

            def taken() -> pa.RecordBatch:
                cell = pa.array(np.concatenate(cells).astype(np.int64))
                return pa.RecordBatch.from_arrays([cell, *rows.take(pa.array(np.concatenate(places))).columns], ["cell", *rows.schema.names])

            for at, end in zip(bounds, bounds[1:]):
                marked = np.zeros(end - at, bool)
                for i, near in _block_pairs(keys[at], roots[at:end], sketch[at:end], bands[at:end], least):
                    marked[i] = marked[near] = True
                found = np.flatnonzero(marked) + at
                n = -(-len(found) // (cell_rows // 2)) if len(found) > cell_rows else 1
                part = np.arange(len(found)) * n // max(1, len(found))
                for x, y in ((x, y) for x in range(n) for y in range(x + (n > 1), n)):
                    mine = (part == x) | (part == y)
                    cell = keys[at] if n == 1 else xxhash.xxh64_intdigest(f"{keys[at]}:{x}:{y}") - (1 << 63)
                    places.append(found[mine])
                    cells.append(np.full(int(mine.sum()), cell))
                    held += int(mine.sum())
                    if held >= cell_rows:
                        yield taken()
                        places, cells, held = [], [], 0
            if held:
                yield taken()

    return run


def _forest(threshold: float, least: int):
    """Rows (cell, key, node, root, sketch, bands, set) sorted by cell to links that join all its components that are alike.

    Whole sets decide. Components that a cell has joined are not compared again, so it has fewer links than rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _whole_groups(batches):
            keys, nodes, roots = (rows.column(name).to_numpy() for name in ("key", "node", "root"))
            sketch, bands = _sketched(rows)
            sets, links = rows.column("set"), []
            for at, end in zip(bounds, bounds[1:]):
                root, above = roots[at:end], {}

                def top(r: int) -> int:
                    while r in above:
                        r = above[r]
                    return r

                for i, near in _block_pairs(keys[at], root, sketch[at:end], bands[at:end], least):
                    x = np.frombuffer(sets[int(at + i)].as_buffer(), np.uint64)
                    for j in near:
                        a, b = top(root[i]), top(root[j])
                        if a != b and alike(x, np.frombuffer(sets[int(at + j)].as_buffer(), np.uint64), threshold):
                            above[max(a, b)] = min(a, b)
                            links.append(sorted((nodes[at + i], nodes[at + j])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(list(column), pa.int64()) for column in zip(*links)], ["a", "b"])

    return run


def class_pairs(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """a, b: every node (columns node, fp) but the first of its SimHash class, with that first one.

    Fingerprints at `distance` or fewer bits from each other are linked, and what is linked is a class.
    """
    classes = components(fingerprint_links(nodes.select("fp").distinct(), distance)).select(F.col("node").alias("linked"), "root")
    joined = nodes.select("node", "fp").join(classes, F.col("fp") == F.col("linked"), "left")
    placed = joined.select("node", F.coalesce("root", "fp").alias("class"))
    firsts = placed.groupBy("class").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return placed.join(firsts, "class").where("node != a").select("a", F.col("node").alias("b"))


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """d (the id), t (a hash of the text, 0 where no id repeats) and component_id of every row.

    Texts whose sets of shingles have a Jaccard similarity of at least the threshold are linked, and
    linked texts are a component; its id is the smallest id in it, null only if all are null. Shingles
    are runs of `shingle` words (the whole sequence if shorter), A-Z lower-cased. Equal word sequences are
    one node; texts without words are equal. Nodes are first compared with one member of their SimHash
    class (the fingerprints and blocks of `near_duplicates`) and with one member of a band; then, where a band still holds several components, all pairs across these whose
    sketches do not rule out the threshold are compared, each in the first band where it meets. The sets go to the band's
    task, which returns the links of a forest, so rows grow with the members of a band, only comparisons with their square.
    """
    text_batches(docs.sparkSession)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    t = F.xxhash64(named(text)) if has_repeats(docs, doc_id) else F.lit(0).cast("long")
    chosen = docs.select(named(doc_id).cast("long").alias("d"), t.alias("t"), named(text).alias("text"))
    prints = materialize(chosen.mapInArrow(tidy(_sketches(shingle)), "d long, t long, digest binary, fp long, bands array<long>, sketch binary"), "shingle-sketches")
    nodes = prints.groupBy("digest").agg(
        F.min("d").alias("least"), F.min(F.struct("d", "t")).alias("row"), F.first("fp").alias("fp"), F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch"),
    )
    # written once, so that the numbers stay
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "shingle-nodes")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    firsts = keyed.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = materialize(keyed.join(firsts, "key").select("key", "node", "first"), "shingle-met")
    # of the first members that a node meets, the one it meets most often
    banded = met.where("node != first").groupBy("node", "first").count().groupBy("node").agg(
        F.max(F.struct("count", "first")).alias("best")
    ).select(F.col("best.first").alias("a"), F.col("node").alias("b"))
    classed = materialize(class_pairs(nodes), "shingle-classes")
    pairs = classed.unionByName(banded).distinct()
    involved = met.select("node").unionByName(classed.select(F.explode(F.array("a", "b")).alias("node"))).distinct().join(nodes.select("node", "row.d", "row.t"), "node")
    own = chosen.select(F.col("d").alias("d_"), F.col("t").alias("t_"), "text").dropDuplicates(["d_", "t_"])
    texts = involved.join(own, F.col("d").eqNullSafe(F.col("d_")) & (F.col("t") == F.col("t_"))).select("node", "text")
    sets = materialize(texts.mapInArrow(tidy(_sets(shingle)), "node long, set binary"), "shingle-sets")
    one, other = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")

    joined = pairs.join(one, "a").join(other, "b").select("a", "b", "set_a", "set_b")
    links = materialize(joined.mapInArrow(tidy(_similar(threshold)), "a long, b long"), "shingle-links")
    roots = materialize(components(links), "shingle-roots")
    labelled = met.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    several = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    rows = labelled.join(several, "key").join(nodes.select("node", "sketch", "bands"), "node").select("key", "node", "root", "sketch", "bands")
    least = int(MINIMA * threshold - _DEVIATIONS * (MINIMA * threshold * (1 - threshold)) ** 0.5)
    shape = "cell long, key long, node long, root long, sketch binary, bands array<long>"
    near = rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(tidy(_candidates(least)), shape)
    near = materialize(near, "shingle-candidates").join(sets, "node").select("cell", "key", "node", "root", "sketch", "bands", "set")
    forest = near.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(tidy(_forest(threshold, least)), "a long, b long")
    links = links.unionByName(materialize(forest, "shingle-links"))
    rooted = nodes.select("digest", "node", "least").join(components(links), "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(ids, "root").select("digest", "component_id")
    return prints.select("d", "t", "digest").join(found, "digest").select("d", "t", "component_id")
