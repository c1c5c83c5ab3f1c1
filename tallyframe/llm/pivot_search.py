"""Exact top-k search by inner product, with a pivot table to leave candidates out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import materialize, named, tidy

PIVOTS = 32
#: Distinct vectors, those of smallest hash, among which pivots are chosen on the driver.
PIVOT_SAMPLE = 2048
#: Candidates and distinct queries that meet in one task.
BLOCK_ROWS = 8192
QUERY_ROWS = 16384
#: Candidates evaluated at once, in bound order.
_STEP = 256
#: Queries whose bounds are computed together.
_QUERIES = 32
_EXACT = float(1 << 53)


def quantized(embedding: Column, factor: float = 64.0) -> Column:
    """floor(factor * x) of each component as long; null if the vector, or a component, is null or not finite."""
    whole = F.transform(embedding, lambda x: F.floor(F.lit(factor) * x.cast("double")).cast("long"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(embedding.isNotNull() & F.forall(embedding, finite), whole)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; shorter vectors are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _lifted(rows: np.ndarray, most: float) -> np.ndarray:
    """Candidates with one more component, so that all have length sqrt(most).

    The distance to a query lifted by zero then falls as the inner product rises:
    distance^2 = |query|^2 + most - 2 * score.
    """
    x = rows.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))[:, None]])


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squared = (rows * rows).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(0.0, squared))


def choose_pivots(rows: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: each next one is the farthest from those chosen."""
    chosen = [0]
    gap = _distances(rows, rows[:1])[:, 0]
    while len(chosen) < min(count, len(rows)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen]


def _exact(queries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles, if these hold every partial sum of their products, which then are exact."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    return (queries.astype(np.float64), rows.astype(np.float64)) if bound < _EXACT else (queries, rows)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search_block(queries: np.ndarray, known: np.ndarray, rows: np.ndarray, ids: list[np.ndarray], table: np.ndarray,
                 pivots: np.ndarray, most: float, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query its k best (scores, ids) of the block, without those that cannot reach `known`.

    known: a score that at least k candidates reach, elsewhere or here; -inf if there is none yet.
    Candidates are taken in order of the largest lower bound that any pivot gives for their distance,
    and the walk stops at the first whose bound allows only scores under the k-th best so far.
    """
    lifted = np.hstack([queries.astype(np.float64), np.zeros((len(queries), 1))])
    own = _distances(lifted, pivots)
    norms = (lifted * lifted).sum(axis=1)
    found = []
    by_pivot = np.ascontiguousarray(table.T)
    factors, terms = _exact(queries, rows)
    for q in range(len(queries)):
        if q % _QUERIES == 0:  # bounds of some queries at once, pivot by pivot
            some = slice(q, q + _QUERIES)
            near = own[some].astype(np.float32)
            low, gap = np.zeros((len(near), len(rows)), np.float32), np.empty((len(near), len(rows)), np.float32)
            for p in range(len(by_pivot)):
                np.subtract(by_pivot[p], near[:, p : p + 1], out=gap)
                np.maximum(low, np.abs(gap, out=gap), out=low)
            ends = norms[some, None] + most
            bounds = (ends - low.astype(np.float64) ** 2) / 2 + 1e-6 * (ends + 1)  # the most a score can be
        high = bounds[q % _QUERIES]
        top_s, top_i, floor = np.empty(0, np.int64), np.empty(0, np.int64), known[q]
        order = np.flatnonzero(high >= floor)
        order = order[np.argsort(-high[order], kind="stable")]
        at, step = 0, _STEP
        while at < len(order):
            take = order[at : at + step]
            at, step = at + step, 2 * step  # the last place moves less and less
            if high[take[0]] < floor:
                break
            take = take[high[take] >= floor]
            scores = (terms[take] @ factors[q]).astype(np.int64)
            good = scores >= floor
            take, scores = take[good], scores[good]
            if not len(take):
                continue
            sizes = [len(ids[i]) for i in take]
            top_s = np.concatenate((top_s, np.repeat(scores, sizes)))
            top_i = np.concatenate((top_i, *[ids[i] for i in take]))
            best = _best(top_s, top_i, k)
            top_s, top_i = top_s[best], top_i[best]
            if len(top_s) >= k:
                floor = max(floor, top_s[-1])
        found.append((top_s, top_i))
    return found


def top_k(
    vectors: DataFrame, query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20, factor: float = 64.0,
) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k highest inner products with all other rows.

    vectors: ids and arrays of numbers; `query` is a condition on the column vec_id. Components are
    floored after multiplication, so scores are exact whole numbers; ties go to the smaller vec_id.
    Rows without an id, and vectors that are null or hold null or non-finite components, take no part.
    An id given several times counts once, with its smallest vector. Shorter vectors are filled with
    zeros. With fewer candidates than k all are returned; no rows give no rows.

    Equal vectors are one candidate that carries its k + 1 smallest ids, and one query, so copies cost
    nothing. Candidates are grouped by their nearest pivot, large groups dealt into blocks. Each query
    first meets one block of its own group, which bounds its k-th score, then only those groups whose
    ranges of pivot distances allow that score.
    """
    spark = vectors.sparkSession
    ints = vectors.select(named(vec_id).cast("long").alias("vec_id"), quantized(named(embedding), factor).alias("v"))
    rows = materialize(ints.where("vec_id IS NOT NULL AND v IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    distinct = rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = materialize(distinct, "distinct-vectors")
    queries = rows.where(query)
    result = "query_id long, rank int, vec_id long, score long"
    norm = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    most, width = distinct.agg(F.max(norm), F.max(F.size("v"))).first()
    if most is None:
        return spark.createDataFrame([], result)
    sample = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(PIVOT_SAMPLE).toArrow()
    pivots = choose_pivots(_lifted(_matrix(sample.column("v"), width), most), PIVOTS)
    count = len(pivots)

    def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = _distances(_lifted(_matrix(batch.column(0), width), most), pivots).astype(np.float32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(table.ravel()), count).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(table.argmin(axis=1), pa.int32())], ["v", "ids", "d", "home"])

    placed = materialize(distinct.mapInArrow(tidy(place_rows), "v array<bigint>, ids array<bigint>, d array<float>, home int"), "pivot-table")
    ranges = placed.groupBy("home").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.min(F.col("d")[i]) for i in range(count)]).alias("low"),
        F.array(*[F.max(F.col("d")[i]) for i in range(count)]).alias("high"),
    ).collect()  # at most one row a pivot
    blocks = {r.home: -(-r.n // BLOCK_ROWS) for r in ranges}
    homes = np.array([r.home for r in ranges])
    low, high = np.array([r.low for r in ranges], np.float64), np.array([r.high for r in ranges], np.float64)
    sub = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])[F.col("home")]
    distinct_queries = queries.select(F.col("v").alias("q")).distinct()
    asked = materialize(distinct_queries, "distinct-queries")
    chunks = -(-max(1, asked.count()) // QUERY_ROWS)
    chunk = lambda c: F.pmod(F.xxhash64(c), F.lit(chunks)).cast("int")
    candidates = placed.select("home", F.pmod(F.xxhash64("v"), sub).cast("int").alias("block"), "v", "ids", "d")
    dealt = candidates.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def own_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The group of the nearest pivot that has one."""
        for batch in batches:
            x = _matrix(batch.column(0), width).astype(np.float64)
            own = _distances(np.hstack([x, np.zeros((len(x), 1))]), pivots)
            near = homes[own[:, homes].argmin(axis=1)] if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int32())], ["q", "chunk", "home"])

    def wanted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each group that may hold a score as high as the query's known one."""
        for batch in batches:
            x = _matrix(batch.column(0), width).astype(np.float64)
            own = _distances(np.hstack([x, np.zeros((len(x), 1))]), pivots)
            known = batch.column(2).to_numpy(zero_copy_only=False)
            gap = np.maximum(0.0, np.maximum(low[None] - own[:, None], own[:, None] - high[None]).max(axis=2))
            gap = np.maximum(0.0, gap - 1e-3)  # the ranges are single precision
            norms = (x * x).sum(axis=1)[:, None]
            allowed = (norms + most - gap * gap) / 2 + 1e-6 * (norms + most + 1) >= np.where(np.isnan(known), -np.inf, known)[:, None]
            q, g = np.nonzero(allowed)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(q)), batch.column(1).take(pa.array(q)), batch.column(2).take(pa.array(q)), pa.array(homes[g], pa.int32())], ["q", "chunk", "known", "home"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        q = left.column("q").combine_chunks()
        if not len(q) or not right.num_rows:
            return pa.table({"q": pa.array([], q.type), "score": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64())})
        known = left.column("known").to_numpy().astype(np.float64)
        ids = right.column("ids").combine_chunks()
        cuts, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        table = np.stack(right.column("d").combine_chunks().flatten().to_numpy().reshape(-1, count))
        found = search_block(
            _matrix(q, width), np.where(np.isnan(known), -np.inf, known), _matrix(right.column("v"), width),
            [flat[a:b] for a, b in zip(cuts, cuts[1:])], table, pivots, most, k + 1,
        )
        sizes = [len(s) for s, _ in found]
        index = pa.array(np.repeat(np.arange(len(q)), sizes))
        return pa.table({"q": q.take(index), "score": np.concatenate([s for s, _ in found]), "vec_id": np.concatenate([i for _, i in found])})

    keyed = asked.select("q", chunk("q").alias("chunk"))
    first = keyed.mapInArrow(tidy(own_group), "q array<bigint>, chunk int, home int").select("q", "chunk", F.lit(None).cast("double").alias("known"), "home")
    shape = "q array<bigint>, score long, vec_id long"
    seeds = first.groupBy("home", "chunk").cogroup(dealt.where("block = 0").groupBy("home", "chunk")).applyInArrow(meet, shape)
    floors = seeds.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).select(
        "q", F.when(F.col("n") > k, F.col("s").cast("double")).alias("known")
    )
    known = materialize(keyed.join(floors, "q", "left").select("q", "chunk", "known"), "known-scores")
    spread = known.mapInArrow(tidy(wanted_groups), "q array<bigint>, chunk int, known double, home int").select(
        "q", "chunk", "known", "home", F.explode(F.sequence(F.lit(0), (sub - 1).cast("int"))).alias("block")
    )
    met = spread.groupBy("home", "block", "chunk").cogroup(dealt.groupBy("home", "block", "chunk")).applyInArrow(meet, shape)
    order = (F.col("score").desc(), F.col("vec_id"))
    best = met.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k + 1)
    pairs = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).join(best.drop("rank"), "q").where("query_id != vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
