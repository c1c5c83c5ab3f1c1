"""Ranked lexical search: an item's documents are grouped by which of its terms they hold.

Documents are read once for a block of items. What they share with the items' terms is kept as short
postings; document frequencies, total lengths and each term's best contribution are aggregated from them.
A task then packs, for each item, one bit a term and document into presence masks. Documents of one mask
share a highest possible score, the sum of the best contributions of the mask's terms. Distinct masks are
evaluated in descending order of it until the next one cannot reach the item's last place any more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import materialize, named, text_batches, tidy

#: Entries (item, term) that one block of items may hold; it bounds what a task is given.
BLOCK_TERMS = 1 << 18
#: Documents whose masks a task holds at a time.
BLOCK_DOCS = 8192
#: Documents evaluated before the last place is looked at again.
_STEP = 128

_POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"
_FOUND = "item int, doc_id long, score long"
#: Bytes of terms stay, A-Z in lower case; every other byte separates.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, one after the other, and the text each is of; null has none.

    A term is a longest run of ASCII digits, ASCII letters (A-Z in lower case) and characters beyond ASCII.
    """
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    folded = pa.py_buffer((data.to_pybytes() if data else b"").translate(_FOLD))
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, folded], offset=texts.offset))
    flat, of = lists.flatten(), np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    real = pc.greater(pc.binary_length(flat), 0)  # white space at either end gives an empty piece
    return flat.filter(real), of[real.to_numpy(zero_copy_only=False)]


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id and terms: the distinct terms of each item, those of all its rows together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, of = split_terms(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), flat.cast(pa.string())], ["item_id", "term"])

    chosen = items.select(named(item_id).cast("long").alias("item_id"), named(text).alias("text"))
    return chosen.mapInArrow(tidy(run), "item_id long, term string").distinct().groupBy("item_id").agg(F.collect_list("term").alias("terms"))


def _postings(vocabulary):
    """Rows (doc_id, text) to the number of terms, and the vocabulary's terms among them with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        for batch in batches:
            flat, of = split_terms(batch.column(1))
            code = pc.index_in(flat.cast(pa.string()) if len(flat) else pa.array([], pa.string()), words).fill_null(-1)
            code = code.to_numpy(zero_copy_only=False).astype(np.int64)
            pair, tf = np.unique((of * len(words) + code)[code >= 0], return_counts=True)
            ends = np.cumsum(np.bincount(pair // len(words), minlength=len(batch)))
            cuts = pa.array(np.concatenate(([0], ends)), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (pair % len(words), tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(of, minlength=len(batch))), *lists], ["doc_id", "n", "terms", "tfs"])

    return run


def impact(tf: Column, m: Column) -> Column:
    """What occurrences of a term are worth in a document of the length measure m, before the term's weight."""
    return F.call_function("div", F.lit(1_000_000_000) * tf.cast("long"), F.lit(1000) * tf.cast("long") + F.lit(8) * m)


class _Best:
    """The k best documents of an item so far: highest score first, then smallest id, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.none, self.doc = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    def offer(self, score: np.ndarray, none: np.ndarray, doc: np.ndarray) -> None:
        real = score > 0
        score, none, doc = (np.concatenate((a, b[real])) for a, b in ((self.score, score), (self.none, none), (self.doc, doc)))
        order = np.lexsort((doc, none, -score))[: self.k]
        self.score, self.none, self.doc = score[order], none[order], doc[order]

    def least(self) -> int:
        """A score below this finds no place any more; equal ones may, by a smaller id."""
        return int(self.score[-1]) if len(self.score) == self.k else 1


def presence_masks(columns: list[np.ndarray], rows: int) -> np.ndarray:
    """A row a document, as many 64-bit words as the terms need: bit j is set where the document is in columns[j]."""
    masks = np.zeros((rows, max(1, -(-len(columns) // 64))), np.uint64)
    for j, docs in enumerate(columns):
        masks[docs, j // 64] |= np.uint64(1 << (j % 64))
    return masks


def grouped_by_mask(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct masks and, for each document, which of them it has."""
    if masks.shape[1] == 1:
        distinct, of = np.unique(masks[:, 0], return_inverse=True)
        return distinct[:, None], of.ravel()
    rows = np.ascontiguousarray(masks).view(np.dtype((np.void, masks.shape[1] * 8))).ravel()
    _, first, of = np.unique(rows, return_index=True, return_inverse=True)
    return masks[first], of.ravel()


def _highest(distinct: np.ndarray, best: np.ndarray) -> np.ndarray:
    """The highest possible score of each mask: the sum of the best contributions of its terms."""
    bits = np.unpackbits(distinct.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, : len(best)]
    return bits.astype(np.int64) @ best


def _search(given, k: int):
    """Rows (doc_id, m, terms, tfs) to the k best documents of each item among those of the task."""

    def block(parts: list[pa.RecordBatch], found: list[_Best], items: list[np.ndarray], weight: np.ndarray, best: np.ndarray) -> None:
        ids = pa.chunked_array([p.column(0) for p in parts]).combine_chunks()
        none, doc = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        m = np.concatenate([p.column(1).to_numpy() for p in parts])
        size = np.concatenate([np.diff(p.column(2).offsets.to_numpy()) for p in parts]).astype(np.int64)
        term = np.concatenate([p.column(2).flatten().to_numpy() for p in parts])
        tf = np.concatenate([p.column(3).flatten().to_numpy() for p in parts]).astype(np.int64)
        start = np.cumsum(size) - size
        row = np.repeat(np.arange(len(size)), size)
        value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
        by_term = np.argsort(term, kind="stable")
        rows_of, bounds = row[by_term], np.searchsorted(term[by_term], np.arange(len(weight) + 1))
        wanted = np.zeros(len(weight), bool)
        for terms, top in zip(items, found):
            held = terms[(bounds[terms + 1] > bounds[terms]) & (best[terms] > 0)]
            if not len(held):
                continue
            distinct, of = grouped_by_mask(presence_masks([rows_of[bounds[t] : bounds[t + 1]] for t in held], len(size)))
            highest = _highest(distinct, best[held])
            order = np.argsort(-highest, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            docs = np.argsort(place[of], kind="stable")  # documents by descending highest score of their mask
            ends = np.cumsum(np.bincount(place[of], minlength=len(order)))
            wanted[terms] = True
            at = 0
            while at < len(order) and highest[order[at]] >= top.least():
                begin = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, begin + _STEP, "right")))
                reach = int(np.searchsorted(-highest[order], -top.least(), "right"))
                to = min(to, reach)
                mine = docs[begin : ends[to - 1]]
                lengths = size[mine]
                stops = np.cumsum(lengths)
                place_of = np.repeat(start[mine] - (stops - lengths), lengths) + np.arange(int(stops[-1]))
                sums = np.where(wanted[term[place_of]], value[place_of], 0)
                scores = np.add.reduceat(sums, stops - lengths)  # every document here holds a term
                top.offer(scores, none[mine], doc[mine])
                at = to
            wanted[terms] = False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, best = given.value
        found = [_Best(k) for _ in items]
        parts, held = [], 0
        for batch in batches:
            parts.append(batch)
            held += len(batch)
            if held >= BLOCK_DOCS:
                block(parts, found, items, weight, best)
                parts, held = [], 0
        if held:
            block(parts, found, items, weight, best)
        for at in range(0, len(found), 1024):
            some = found[at : at + 1024]
            item = np.repeat(np.arange(at, at + len(some)), [len(b.score) for b in some])
            doc = pa.array(np.concatenate([b.doc for b in some]), mask=np.concatenate([b.none for b in some]))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), doc, pa.array(np.concatenate([b.score for b in some]))], ["item", "doc_id", "score"])

    return run


def _search_block(docs: DataFrame, block: pa.Table, k: int) -> DataFrame:
    spark = docs.sparkSession
    flat = block.column("terms").combine_chunks()
    coded = flat.flatten().dictionary_encode()
    code, cuts = coded.indices.to_numpy(), flat.offsets.to_numpy() - flat.offsets[0].as_py()
    items = [np.sort(code[a:b]).astype(np.int64) for a, b in zip(cuts, cuts[1:])]
    vocabulary = spark.sparkContext.broadcast(coded.dictionary)  # at most BLOCK_TERMS terms, or those of one item
    postings = materialize(docs.mapInArrow(tidy(_postings(vocabulary)), _POSTINGS), "postings")
    total = postings.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    weight, best = np.zeros(len(coded.dictionary), np.int64), np.zeros(len(coded.dictionary), np.int64)
    many = F.call_function("div", (F.lit(90) * F.col("n")).cast("decimal(20,0)") * F.lit(total["docs"]), F.lit(max(1, total["terms"] or 0)))
    measured = postings.where(F.size("terms") > 0).withColumn("m", F.lit(10) + many)
    entries = measured.select("m", F.explode(F.arrays_zip("terms", "tfs")).alias("e")).select(F.col("e.terms").alias("term"), impact(F.col("e.tfs"), F.col("m")).alias("v"))
    for row in entries.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("v").alias("v")).toLocalIterator():  # a row a term of the block
        weight[row["term"]] = math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * row["df"] + 1)))
        best[row["term"]] = weight[row["term"]] * row["v"]
    given = spark.sparkContext.broadcast((items, weight, best))
    found = measured.select("doc_id", "m", "terms", "tfs").mapInArrow(tidy(_search(given, k)), _FOUND)
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    ids = spark.createDataFrame([(i, v) for i, v in enumerate(block.column("item_id").to_pylist())], "item int, item_id long")
    return ranked.join(ids, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents among all rows; scores are above 0.

    A term's weight is w = floor(1000 * ln((2N + 2) / (2df + 1))), a document's measure m = 10 + 90nN div L,
    its score the sum over the item's distinct terms of w * (10^9 tf div (1000 tf + 8m)). N counts the
    documents with a term, L their terms, n one document's, df those that hold the term, tf its occurrences.

    Rows of one item_id are one item with the terms of all of them; a null item_id is one item, too.
    Every row of docs is a document of its own, so repeated rows have a place each; equal scores go by
    ascending doc_id, null ids last. Null and empty texts have no terms. An item without a term that any
    document holds, no items or no documents give no rows. Other columns are ignored. Items pass in blocks
    of at most block_terms terms (an item of more is a block by itself), each of which reads the documents
    once; a task keeps k documents an item.
    """
    spark = text_batches(docs.sparkSession)
    chosen = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).alias("text"))
    terms = materialize(item_terms(items), "item-terms").withColumn("size", F.size("terms"))
    total = terms.agg(F.sum("size")).first()[0]
    if not total:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    blocks = -(-total // block_terms)
    out = None
    for b in range(blocks):
        block = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "terms").toArrow()
        if len(block):
            part = _search_block(chosen, block, k)
            out = part if out is None else out.unionByName(part)
    return out
