"""Mixing sources to target weights, by entropy balancing.

Targets. Sources in code point order (null last) have the weights 5, 2, 1, repeating, and share all words. A target
stops at CAP times its source's size; what is above is shared again by weight until no target is above: all sources
that are not capped get level * weight, and the level is found by sums over the table of sources.

Rates. A document of s words gets the rate r = min(CAP, exp(l * s / mean)), with one dual variable l for each source: the
tilt of least relative entropy (against one copy of each document) that meets the source's constraint sum(r * s) = target.
The dual is convex, so that its gradient grows with l, and Newton steps inside a bracket solve all sources at once. An
iteration is an aggregation over the histogram of (source, size), which holds the same sums as the documents.

Copies. Within a source, running sums of rates by size are rounded, which leaves less than the largest size of a
source; up to three single copies then close most of that gap. Within a group of equal source and size, copies are dealt
evenly by rank; ranks are made in SALTS parts with offsets, so that no group meets in one task.

Cases: a null or blank text has size 0 and one copy at most takes no words; a null source is a source, the last one; equal
rows are dealt copies each on its own; a table without words has targets of 0; other columns don't matter.
Reruns agree: nothing depends on the order of rows, as ties are broken by id and row contents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, hashable, spread, table, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
SALTS = 256
MAX_STEPS = 80


def ordered_index(scratch: Scratch, rows: DataFrame, key: str) -> DataFrame:
    """rows with idx, their place by key (null last), from 0: sorted ranges and the counts of the ranges before."""
    order = F.col(key).asc_nulls_last()
    ranged = scratch.keep(rows.repartitionByRange(spread(scratch.spark), order).withColumn("part", F.spark_partition_id()), "ranged")
    # a row for each range, not for each key
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy("part").count().select("part", before.alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return ranged.withColumn("place", place).join(F.broadcast(starts), "part").withColumn("idx", (F.col("start") + F.col("place") - 1).cast("long")).drop("part", "start", "place")


def targets(scratch: Scratch, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, idx, n_docs, source_size, least, target): a row for each source."""
    sums = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    sources = scratch.keep(ordered_index(scratch, sums, "source").withColumn("weight", weight), "sources")
    most = F.col("source_size") * float(cap)
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > most
        r = sources.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(above, most).otherwise(0.0)).alias("held"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"), F.count_if(above).alias("n")
        ).first()
        if not r["total"] or not r["open"] or r["n"] == capped:
            break
        capped, level = r["n"], (r["total"] - r["held"]) / r["open"]
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), most)).drop("weight")


def rates(scratch: Scratch, groups: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """groups (idx, size, n) with the rate of their documents, by Newton steps on the dual variables of all sources."""
    top = math.log(cap) * F.col("scale") / F.col("least")
    share = F.col("target") / F.col("source_size")
    none = (F.col("source_size") == 0) | (F.col("target") <= 0)
    state = sources.withColumn("scale", F.when(F.col("source_size") > 0, F.col("source_size") / F.col("n_docs")).otherwise(1.0))
    state = state.select(
        "idx", "target", "scale",
        F.when(none, -1e300).when(share >= cap * (1 - 1e-12), top).otherwise(0.0).alias("dual"),
        F.when(none, -1e300).when(share < 1, F.log(share) * F.col("scale") / F.col("least")).otherwise(0.0).alias("lo"),
        F.when(none, -1e300).when(share < 1, 0.0).otherwise(top).alias("hi"),
        (none | (share >= cap * (1 - 1e-12))).alias("done"),
    )
    state = scratch.keep(state, "dual-0")
    x = F.col("dual") * F.col("size") / F.col("scale")
    rate = F.when(F.col("size") == 0, 1.0).when(x >= math.log(cap), float(cap)).otherwise(F.exp(x))
    for step in range(1, MAX_STEPS + 1):
        words = F.col("n") * F.col("size") * rate
        slope = F.when(x >= math.log(cap), 0.0).otherwise(words * F.col("size") / F.col("scale"))
        sums = groups.join(state.filter(~F.col("done")).select("idx", "dual", "scale"), "idx").groupBy("idx").agg(F.sum(words).alias("got"), F.sum(slope).alias("slope"))
        moved = state.join(sums, "idx", "left").withColumn("over", F.col("got") - F.col("target"))
        lo = F.when(F.col("over") < 0, F.col("dual")).otherwise(F.col("lo"))
        hi = F.when(F.col("over") > 0, F.col("dual")).otherwise(F.col("hi"))
        newton = F.when(F.col("slope") > 0, F.col("dual") - F.col("over") / F.col("slope"))
        near = F.col("done") | F.col("over").isNull() | (F.abs("over") <= F.greatest(F.lit(0.01), F.col("target") * 1e-9)) | (F.col("hi") <= F.col("lo"))
        moved = moved.select("idx", "target", "scale", lo.alias("lo"), hi.alias("hi"), "dual", newton.alias("newton"), near.alias("done"))
        inside = (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi"))
        dual = F.when(F.col("done"), F.col("dual")).when(inside, F.col("newton")).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = scratch.keep(moved.select("idx", "target", "scale", dual.alias("dual"), "lo", "hi", "done"), f"dual-{step}")
        if state.filter(~F.col("done")).isEmpty():
            break
    return groups.join(state.select("idx", "target", "dual", "scale"), "idx").withColumn("rate", rate).drop("dual", "scale")


def rounded(scratch: Scratch, groups: DataFrame, cap: int = CAP, repairs: int = 3) -> DataFrame:
    """(idx, size, n, copies): whole copies for each group of equal source and size."""
    by_size = Window.partitionBy("idx").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    up_to = F.sum(F.col("n") * F.col("rate")).over(by_size)
    out = groups.withColumn("upto", F.floor(up_to + 0.5)).withColumn("copies", F.col("upto") - F.coalesce(F.lag("upto").over(Window.partitionBy("idx").orderBy("size")), F.lit(0)))
    # running sums may be off in the last bits
    out = out.select("idx", "size", "n", "target", F.least(F.greatest(F.col("copies"), F.lit(0)), F.col("n") * cap).cast("long").alias("copies"))
    out = scratch.keep(out, "copies-0")
    for k in range(1, repairs + 1):
        left = out.groupBy("idx").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("left"))
        gaps = out.join(left, "idx")
        better = F.abs(F.abs("left") - F.col("size")) < F.abs("left")
        room = F.when(F.col("left") > 0, F.col("copies") < F.col("n") * cap).otherwise(F.col("copies") > 0)
        pick = gaps.filter(better & room).groupBy("idx").agg(
            F.min_by("size", F.struct(F.abs(F.abs("left") - F.col("size")), F.col("size"))).alias("size"), F.signum(F.first("left")).cast("long").alias("more")
        )
        out = out.join(pick, ["idx", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more")
        out = scratch.keep(out, f"copies-{k}")
    return out.drop("target")


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False, salts: int = SALTS) -> DataFrame:
    """Each document with size, source_size, target and copies; with `carry` also its row, as a struct."""
    scratch = Scratch(df.sparkSession, "mix")
    names = [F.col(f"`{c}`") for c in df.columns]
    whole = [F.struct(*names).alias("row")] if carry else []
    base = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(id_col, text_col, *hashable(df)).alias("tie"), *whole)
    base = base.withColumn("salt", F.pmod("tie", F.lit(salts)).cast("int"))  # by contents as well: rows of one id are spread
    # texts aren't written again: their sizes are counted once more where rows are carried
    sizes = scratch.keep(base.drop("row"), "sizes")
    rows = base if carry else sizes
    sources = targets(scratch, sizes)
    sources = scratch.keep(sources, "targets")
    index = sources.select(F.col("source").alias("of"), "idx", "source_size", "target")
    same = F.col("source").eqNullSafe(F.col("of"))
    parts = scratch.keep(sizes.groupBy("source", "size", "salt").count().join(index, same).select("idx", "size", "salt", "count"), "parts")
    groups = scratch.keep(parts.groupBy("idx", "size").agg(F.sum("count").alias("n")), "groups")
    plan = rounded(scratch, rates(scratch, groups, sources))
    earlier = Window.partitionBy("idx", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0))).join(plan, ["idx", "size"])
    placed = rows.join(index, same).drop("of")
    inside = Window.partitionBy("idx", "size", "salt").orderBy(F.col("id").asc_nulls_last(), "tie")
    placed = placed.withColumn("place", F.row_number().over(inside) - 1)
    out = placed.join(offsets.select("idx", "size", "salt", "before", "n", "copies"), ["idx", "size", "salt"])
    exact = F.expr("((before + place + 1) * copies) div n - ((before + place) * copies) div n")
    return out.select("id", *(["row"] if carry else []), "size", "source_size", "target", exact.cast("long").alias("n_copies"))


def mix_copies(df: DataFrame, **columns: str) -> DataFrame:
    """The mix itself: df's rows, each as often as the mix takes it."""
    out = mixed(df, carry=True, **columns).filter("n_copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies")))).select("row.*")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"), F.col("n_copies"))
