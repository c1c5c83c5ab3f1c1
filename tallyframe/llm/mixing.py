"""Mixing sources to target weights by entropy balancing (native expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import WORD, materialize, named

#: Weights by the rank of a source, repeating.
WEIGHTS = (5, 2, 1)
MOST = 3
#: Documents of one (source, size) cell that are ranked together when copies are rounded.
CELL_ROWS = 1024
UNIT = 1_000_000
STEPS = 60


def document_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source and size (words of the text, 0 for null) of every row."""
    return docs.select(
        named(doc_id).alias("doc_id"), named(source).alias("source"),
        F.coalesce(F.regexp_count(named(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: its size and its target.

    Sources in code-point order, null last, weigh the given weights in turn and share the whole size.
    Where a share is above `most` times the source's size, the target stops there and the excess is
    shared by weight among the others, until none is above. That fixed point is a water level: with
    sources in order of cap / weight, the level is the first at which the rest absorb what remains.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights))
    ranked = totals.select("source", "source_size", weight.alias("weight")).withColumn("cap", most * F.col("source_size").cast("double"))
    rows = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(rows), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rows), F.lit(0.0))
    )
    levels = ranked.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
    first = F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.col("cap") / F.col("weight"))).over(everything)
    return levels.withColumn("first", first).select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("first") * F.col("weight"), F.col("cap"))).alias("target")
    )


def _rate(tilt: Column, size: Column, scale: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(F.lit(50.0), tilt * size / scale)))


def _exact_sum(value: Column) -> Column:
    """A sum that does not depend on the order of its parts."""
    return F.sum(F.round(value * UNIT).cast("decimal(38,0)")).cast("double") / UNIT


def balanced_tilts(cells: DataFrame, targets: DataFrame, most: int = MOST, tolerance: float = 1e-9) -> DataFrame:
    """Per source the tilt that makes rate = min(most, exp(tilt * size / scale)) meet its target.

    Minimising the entropy of the rates against one, under a token constraint for each source and a
    bound on each rate, has a convex dual with one multiplier a source. Newton steps on the logarithm
    of the constraint solve it, each an aggregation of all cells; steps out of the bracket, where the
    bound makes a kink, are halved instead. Sources whose target is their bound or zero need no step.
    `scale` is the source's mean size. Fewer than ten steps are usual;
    not to settle in 60 is an error.
    """
    sized = cells.where("size > 0")
    ends = sized.groupBy("source").agg(
        F.min("size").alias("least"), (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale")
    ).withColumnRenamed("source", "_source")
    start = targets.join(ends, F.col("source").eqNullSafe(F.col("_source"))).select(
        "source", "target", "source_size", "scale",
        (F.log(F.col("target") / F.col("source_size")) * F.col("scale") / F.col("least")).alias("end"),
    )
    state = materialize(start.select(
        "source", "target", "scale", F.lit(0.0).alias("tilt"), F.least(F.lit(0.0), F.col("end")).alias("low"),
        F.greatest(F.lit(0.0), F.col("end")).alias("high"), F.lit(False).alias("done"),
    ), "mix-tilts")
    bars = sized.withColumnRenamed("source", "_source")
    rate = _rate(F.col("tilt"), F.col("size"), F.col("scale"), most)
    mass = F.col("size") * F.col("n") * rate
    for _ in range(STEPS):
        sums = state.where("NOT done").join(bars, F.col("source").eqNullSafe(F.col("_source"))).groupBy("source").agg(
            _exact_sum(mass).alias("got"),
            _exact_sum(F.when(rate < most, mass * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"),
        ).withColumnRenamed("source", "_source")
        low = F.when(F.col("got") < F.col("target"), F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("got") > F.col("target"), F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.try_divide((F.log("got") - F.log("target")) * F.col("got"), F.col("slope"))
        stepped = state.join(sums, F.col("source").eqNullSafe(F.col("_source")), "left").withColumns(
            {"low": low, "high": high, "newton": newton}
        )
        near = F.abs(F.col("got") - F.col("target")) <= tolerance * F.col("target")
        ended = F.col("done") | near | (F.col("high") - F.col("low") <= 1e-12 * F.greatest(F.abs(F.col("low")), F.abs(F.col("high"))))
        state = materialize(stepped.select(
            "source", "target", "scale",
            F.when(ended, F.col("tilt")).when((F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high")), F.col("newton"))
            .otherwise((F.col("low") + F.col("high")) / 2).alias("tilt"),
            "low", "high", ended.alias("done"),
        ), "mix-tilts")
        if state.where("NOT done").isEmpty():
            break
    else:
        raise RuntimeError("the tilts of the mix did not settle")
    return state.select("source", "scale", "tilt")


def _settled(rated: DataFrame, most: int, rounds: int = 4) -> DataFrame:
    """Moves single copies until a source's words are as near its target as its document sizes allow.

    In each round every source adds or takes back one copy of a document whose size is nearest to
    what it lacks or has too much, if that helps. One aggregation of the cells a round.
    """
    rated = materialize(rated, "mix-copies")
    words = F.col("size") * (F.col("n") * F.col("whole") + F.col("extra"))
    for _ in range(rounds):
        lacks = rated.groupBy("source").agg(F.first("target").alias("aim"), F.sum(words).alias("has"))
        lacks = lacks.select(F.col("source").alias("_l"), (F.col("aim") - F.col("has")).alias("lack"))
        sided = rated.join(lacks, F.col("source").eqNullSafe(F.col("_l")))
        can = F.when(F.col("lack") > 0, (F.col("extra") < F.col("n")) & (F.col("whole") < most)).otherwise(F.col("extra") > 0)
        left = F.abs(F.abs(F.col("lack")) - F.col("size"))
        moves = sided.where(can & (F.col("size") > 0) & (left < F.abs(F.col("lack")))).groupBy("source").agg(
            F.min_by("size", F.struct(left, F.col("size"))).alias("_z"), F.first(F.signum("lack")).cast("long").alias("move")
        ).withColumnRenamed("source", "_m")
        moved = rated.join(moves, F.col("source").eqNullSafe(F.col("_m")) & (F.col("size") == F.col("_z")), "left")
        rated = materialize(moved.withColumn("extra", F.col("extra") + F.coalesce("move", F.lit(0))).select(rated.columns), "mix-copies")
    return rated


def mix_sources(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST,
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, rate, copies and taken.

    Rates come from `balanced_tilts`; copies are a rate's whole part plus one for some documents,
    chosen so that a source's words stay within one document of its target: along rising sizes the
    parts left over are summed, and each whole passed gives one document of that size a copy; a few
    single copies are then moved to meet the target closely. Within a size, documents are taken in order of a hash of their id; large cells are dealt into buckets of
    about a thousand, so no task ranks a whole source. No document gets more than `most` copies.

    Null and empty texts have size 0 and take nothing; a null source is a source of its own, the
    last; repeated rows count each; no rows give no rows. Sums are exact, so reruns agree.
    """
    sizes = materialize(document_sizes(docs, doc_id, text, source), "mix-sizes")
    cells = materialize(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    totals = cells.select("source", (F.col("size") * F.col("n")).alias("size"))
    targets = materialize(source_targets(totals, weights, most), "mix-targets")
    tilts = balanced_tilts(cells, targets.where("target > 0"), most).withColumnsRenamed({"source": "_s"})
    rated = cells.join(targets.withColumnRenamed("source", "_t"), F.col("source").eqNullSafe(F.col("_t"))).join(
        tilts, F.col("source").eqNullSafe(F.col("_s")), "left"
    ).select(
        "source", "size", "n", "source_size", "target",
        F.round(F.coalesce(F.when(F.col("size") > 0, _rate(F.col("tilt"), F.col("size"), F.col("scale"), most)), F.lit(0.0)), 9).alias("rate"),
    ).withColumns({
        "whole": F.floor("rate").cast("long"),
        "part": F.round((F.col("rate") - F.floor("rate")) * UNIT).cast("long") * F.col("n"),
        "buckets": F.ceil(F.col("n") / CELL_ROWS).cast("long"),
    })
    by_size = Window.partitionBy("source").orderBy("size")
    after = F.sum("part").over(by_size)
    passed = lambda total: F.floor((total + UNIT // 2) / UNIT)
    rated = _settled(rated.withColumn("extra", (passed(after) - passed(after - F.col("part"))).cast("long")), most)

    mixed = F.abs(F.xxhash64(F.col("doc_id"), F.lit(7)) % F.col("buckets"))
    keyed = sizes.join(
        rated.withColumnsRenamed({"source": "_source", "size": "_size"}),
        F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")),
    ).withColumn("bucket", mixed)
    # The extra copies of a cell, spread over its buckets in proportion to their documents.
    filled = keyed.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("held"), F.first("extra").alias("e"), F.first("n").alias("m"))
    up_to = F.sum("held").over(Window.partitionBy("source", "size").orderBy("bucket"))
    quota = filled.select(
        F.col("source").alias("_qs"), F.col("size").alias("_qz"), F.col("bucket").alias("_qb"),
        (F.floor(F.col("e") * up_to / F.col("m")) - F.floor(F.col("e") * (up_to - F.col("held")) / F.col("m"))).alias("quota"),
    )
    place = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id"))
    copies = F.col("whole") + F.when(place <= F.col("quota"), 1).otherwise(0)
    return keyed.join(
        quota, F.col("source").eqNullSafe(F.col("_qs")) & (F.col("size") == F.col("_qz")) & (F.col("bucket") == F.col("_qb"))
    ).select(
        "doc_id", "source", "size", "source_size", "target", "rate",
        F.when(F.col("size") > 0, copies).otherwise(0).cast("long").alias("copies"),
    ).withColumn("taken", F.col("copies") * F.col("size"))
