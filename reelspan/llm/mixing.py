"""Source mixing by entropy balancing: exponentially tilted document rates, rounded into copies."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import keep, word_count

#: Most copies of a document, and most times its own size that a source's target may be.
MOST = 3
#: Cells with more than 1/HOT of all rows are split by document hash.
HOT = 2048
STEPS_A_JOB, TOLERANCE, MOST_JOBS = 5, 1e-9, 60


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = MOST) -> DataFrame:
    """source, source_size -> also target: all sizes shared by weight, none above ``most`` times its own.

    Sources rank by code point, null last, and take the weights in turn. Sharing the excess again until no source is above its
    cap ends at one level t with target = min(cap, weight * t): sorted by cap / weight, a source is capped just when its ratio
    is at most the level that remains once all before it are capped. The windows see one row per source.
    """
    ranked = sizes.select(
        "source", "source_size",
        (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("nth"),
    ).select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("double").alias("weight"), "nth")
    cap = F.col("source_size") * F.lit(float(most))
    order = Window.orderBy(cap / F.col("weight"), "nth")
    all_rows = Window.partitionBy()
    level = ranked.select(
        "*", cap.alias("cap"),
        (F.sum("source_size").over(all_rows) - F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).alias("left"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("weight_left"),
    ).withColumn("open_level", F.when(F.col("cap") * F.col("weight_left") > F.col("left") * F.col("weight"), F.col("left") / F.col("weight_left")))
    found = F.min(F.when(F.col("open_level").isNotNull(), F.struct(F.col("cap") / F.col("weight"), "nth", "open_level"))).over(all_rows)["open_level"]
    return level.select("source", "source_size", F.when(found.isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * found)).alias("target"))


def _newton(cells: DataFrame, state: DataFrame) -> DataFrame:
    """One step for every source: state holds source, target, scale, tilt, low, high, gap."""
    z = F.col("size") / F.col("scale")
    free = F.col("tilt") * z < math.log(MOST)
    rate = F.when(free, F.exp(F.col("tilt") * z)).otherwise(F.lit(float(MOST)))
    sums = cells.alias("c").join(state.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).groupBy("s.source", "target", "scale", "tilt", "low", "high").agg(
        F.sum(F.col("n") * F.col("size") * rate).alias("g"), F.sum(F.when(free, F.col("n") * F.col("size") * z * rate).otherwise(0.0)).alias("c")
    )
    gap = F.col("g") - F.col("target")
    step = F.when(F.col("c") > 0, F.col("tilt") - gap / F.col("c"))
    moved = sums.select(
        "source", "target", "scale", "tilt", step.alias("step"), (F.abs(gap) / F.col("target")).alias("gap"),
        F.when(gap < 0, F.greatest("low", "tilt")).otherwise(F.col("low")).alias("low"), F.when(gap > 0, F.least("high", "tilt")).otherwise(F.col("high")).alias("high"),
    )
    inside = (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
    tilt = F.when(F.col("gap") <= TOLERANCE, F.col("tilt")).when(inside, F.col("step")).otherwise((F.col("low") + F.col("high")) / 2)
    return moved.select("source", "target", "scale", tilt.alias("tilt"), "low", "high", "gap")


def tilts(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """source, scale and the tilt whose rates min(3, exp(tilt * size / scale)) meet the source's target.

    The rates are the ones nearest to 1 in relative entropy among those that meet the token constraint and the cap; tilt is
    the constraint's multiplier. The dual is convex and splits by source, so every step is one aggregation of the cells, for all
    sources together; a step that would leave the bracket is replaced by its middle. Steps go on until every source meets its target or its bracket is
    as narrow as numbers are; else it is an error.
    """
    lengths = cells.where("size > 0").groupBy("source").agg(
        (F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("scale"), F.min("size").alias("least")
    )
    open_ = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * F.lit(MOST * (1 - 1e-12)))
    reach = F.col("scale") / F.col("least")
    state = keep(lengths.alias("l").join(targets.alias("t"), F.col("l.source").eqNullSafe(F.col("t.source"))).where(open_).select(
        F.col("t.source").alias("source"), "target", "scale", F.lit(0.0).alias("tilt"), (-reach * 60.0).alias("low"), (reach * math.log(MOST) + 1e-6).alias("high"), F.lit(1.0).alias("gap")
    ))
    for _ in range(MOST_JOBS):
        for _ in range(STEPS_A_JOB):
            state = _newton(cells, state)
        state = keep(state)
        # a bracket that no double lies in is as near as a tilt can be
        if not state.where((F.col("gap") > TOLERANCE) & (F.col("high") - F.col("low") > 1e-14 * F.greatest(F.abs("low"), F.abs("high")))).take(1):
            return state.select("source", "scale", "tilt")
    raise ArithmeticError("the tilts of some sources do not meet their targets")


def _settle(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Moves one copy of one document size per source so that the taken words come as near the target as a single move can."""
    taken = cells.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
    off = taken.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select(F.col("b.source").alias("source"), (F.col("target") - F.col("taken")).alias("off"))
    can = F.when(F.col("off") > 0, F.col("copies") < F.col("n") * MOST).otherwise(F.col("copies") > 0)
    pick = cells.alias("c").join(off.alias("o"), F.col("c.source").eqNullSafe(F.col("o.source"))).where(can & (F.abs(F.abs("off") - F.col("size")) < F.abs("off"))).groupBy(F.col("c.source").alias("source")).agg(
        F.min(F.struct(F.abs(F.abs("off") - F.col("size")).alias("rest"), F.col("size").alias("size"), F.col("part").alias("part"), F.signum("off").cast("long").alias("move"))).alias("p")
    ).select("source", "p.size", "p.part", "p.move")
    return cells.alias("c").join(
        pick.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source")) & (F.col("c.size") == F.col("p.size")) & (F.col("c.part") == F.col("p.part")), "left"
    ).select("c.source", "c.size", "c.part", "c.n", (F.col("copies") + F.coalesce("move", F.lit(0))).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, rate and whole ``copies`` from 0 to 3, and the ``carry`` columns.

    size is the number of words. Documents of one source and size share a rate, so Newton's steps run over counted cells
    (source, size), not over documents. Copies come from the running sum of rates in order of size, rounded: the words taken are
    then off the target by half the largest document at most, and three single moves of a copy take off nearly all of that.
    Within a cell the first documents in order of a hash take the extra copies, so reruns agree.

    Null texts and texts without words have size 0, rate 1 and one copy (they add no words). A null source is a source of its
    own, last in order. Equal rows are separate documents. An empty table gives an empty result. A cell with over 1/2048 of all
    rows is split by document hash; the list of such cells has under 2048 rows, which bounds its broadcast.
    """
    base = keep(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.struct(F.lit(0), *carry).alias("carried")))
    pairs = keep(base.groupBy("source", "size").agg(F.count("*").alias("n")))
    n_rows, words = pairs.agg(F.sum("n"), F.sum(F.col("n") * F.col("size"))).first()
    targets = keep(source_targets(pairs.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights))
    tilt = tilts(pairs.where("size > 0"), targets) if words else None
    hot = pairs.where(F.col("n") * HOT > (n_rows or 1)).select("source", "size", F.ceil(F.col("n") * HOT / F.lit(n_rows or 1)).alias("parts"))
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id", F.lit(2)), F.col("parts"))).cast("long")
    dealt = base.alias("b").join(F.broadcast(hot.alias("h")), F.col("b.source").eqNullSafe(F.col("h.source")) & (F.col("b.size") == F.col("h.size")), "left").select(
        "id", "b.source", "b.size", part.alias("part"), "carried"
    )
    cells = dealt.groupBy("source", "size", "part").agg(F.count("*").alias("n"))
    full = F.when(F.col("target") > 0, F.lit(float(MOST))).otherwise(0.0)
    joined = cells.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "size", "part", "n", "target")
    if tilt is None:
        rated = joined.withColumn("rate", F.lit(1.0))
    else:
        rated = joined.alias("c").join(tilt.alias("l"), F.col("c.source").eqNullSafe(F.col("l.source")), "left").select(
            "c.source", "size", "part", "n",
            F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("tilt").isNull(), full).otherwise(F.least(F.lit(float(MOST)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(2.0))))).alias("rate"),
        )
    # running sums in two levels, so that no window holds all sizes of a source
    band = F.floor(F.log2(F.col("size") + 1) * 4).cast("int")
    rated = keep(rated.select("source", "size", "part", "n", "rate", band.alias("band")))
    bands = rated.groupBy("source", "band").agg(F.sum(F.col("n") * F.col("rate")).alias("mass"))
    bands = bands.select("source", "band", F.coalesce(F.sum("mass").over(Window.partitionBy("source").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("mass_before"))
    own = F.sum(F.col("n") * F.col("rate")).over(Window.partitionBy("source", "band").orderBy("size", "part").rowsBetween(Window.unboundedPreceding, 0))
    summed = rated.withColumn("own", own).alias("r").join(bands.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.band") == F.col("b.band")))
    end = F.col("mass_before") + F.col("own")
    exact = (F.col("rate") == F.floor("rate"))
    counted = summed.select(
        "r.source", "size", "part", "n",
        F.when(exact, F.col("n") * F.col("rate")).otherwise(F.greatest(F.lit(0.0), F.least(F.col("n") * F.lit(float(MOST)), F.floor(end + 0.5) - F.floor(end - F.col("n") * F.col("rate") + 0.5)))).cast("long").alias("copies"),
    )
    counted = keep(counted)
    for _ in range(3):
        counted = keep(_settle(counted, targets))
    nth = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy(F.xxhash64("id", F.lit(3)), "id"))
    plan = counted.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "size", "part", "n", "copies", "source_size", "target")
    ranked = dealt.select("id", "source", "size", "part", nth.alias("nth"), "carried")
    return ranked.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size")) & (F.col("d.part") == F.col("p.part"))).select(
        F.col("d.id").alias(id_col), F.col("d.source").alias(source_col), F.col("d.size").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("copies") / F.col("n")).alias("rate"),
        (F.floor(F.col("copies") / F.col("n")) + (F.col("nth") <= F.col("copies") % F.col("n")).cast("long")).cast("long").alias("copies"),
        *(F.col("carried")[c].alias(c) for c in carry),
    )
