"""Joins of intervals (chrom, start, end; half-open, from 0) by hierarchical bins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: Bins of a level are eight times as wide as those of the one below; level 0 has bins of 64.
LOWEST, STEP, LEVELS = 6, 3, 19


def level(start: Column, end: Column) -> Column:
    """The lowest level whose bins are as wide as the interval, which so lies in two of them at most."""
    wide = lambda i: F.lit(1 << (LOWEST + STEP * i)).cast("long")
    return reduce(lambda found, i: F.when(end - start <= wide(i), F.lit(i)).otherwise(found), range(LEVELS - 2, -1, -1), F.lit(LEVELS - 1))


def _entries(rows: DataFrame, side: str, levels: Column) -> DataFrame:
    """An entry for each bin that an interval meets, on its own level and on those above that the other side's intervals have."""
    home = level(F.col("start"), F.col("end"))
    named = rows.filter("end > start").select(*(F.col(c).alias(f"{side}_{c}") for c in rows.columns), home.alias(f"{side}_home"))
    named = named.withColumn("level", F.explode(F.filter(F.array_distinct(F.concat(F.array(F.col(f"{side}_home")), levels)), lambda i: i >= F.col(f"{side}_home"))))
    shift = F.lit(LOWEST) + F.col("level") * STEP
    first, last = (F.call_function("shiftright", c.cast("long"), shift) for c in (F.col(f"{side}_start"), F.col(f"{side}_end") - 1))
    return named.withColumn("bin", F.explode(F.sequence(first, last)))


def _levels(rows: DataFrame) -> Column:
    """The levels that a side's intervals have, at most LEVELS of them."""
    found = rows.filter("end > start").select(level(F.col("start"), F.col("end")).alias("l")).distinct().collect()
    return F.array(*(F.lit(x) for x in sorted(r.l for r in found))).cast("array<int>")


def interval_join(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("left", "right"), dense: int = 10_000) -> DataFrame:
    """Pairs of intervals of both sides that overlap, once each; columns are named after the side that they are from.

    An interval has at most two entries on each level that there is, however long it is. Two intervals meet on the higher one of their
    levels, in the bin in which the later of them starts. A bin in which the left side has more than `dense` entries is cut into slots: its left entries
    are dealt to them, the right ones are sent to each.
    """
    a, b = names
    one, two = _entries(left, a, _levels(right)), _entries(right, b, _levels(left))
    key = [F.col(f"{a}_chrom").alias("chrom"), "level", "bin"]
    crowd = one.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / dense).cast("int").alias("slots")).filter("slots > 1")
    crowd = written(crowd, "crowd")  # one row for `dense` entries at most, small enough to be sent to each task
    on = ["chrom", "level", "bin"]
    slots = lambda rows, side: rows.withColumn("chrom", F.col(f"{side}_chrom")).join(crowd, on, "left").withColumn("slots", F.coalesce("slots", F.lit(1)))
    one = slots(one, a).withColumn("slot", F.pmod(F.xxhash64(*(F.col(f"{a}_{c}") for c in left.columns if not _nested(left, c))), F.col("slots")).cast("int")).drop("slots")
    two = slots(two, b).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")
    both = one.join(two, [*on, "slot"])
    starts = F.greatest(f"{a}_start", f"{b}_start").cast("long")
    meet = (F.col("level") == F.greatest(f"{a}_home", f"{b}_home")) & (F.col("bin") == F.call_function("shiftright", starts, F.lit(LOWEST) + F.col("level") * STEP))
    over = (F.col(f"{a}_start") < F.col(f"{b}_end")) & (F.col(f"{b}_start") < F.col(f"{a}_end"))
    return both.filter(meet & over).select(*(f"{a}_{c}" for c in left.columns), *(f"{b}_{c}" for c in right.columns))


def overlap_totals(left: DataFrame, right: DataFrame, values: Sequence[str], width: int = 1 << 12) -> DataFrame:
    """The intervals of `left` that overlap any of `right`, with `n`, how many those are, and the sums of their `values` (columns of whole numbers).

    No pair is made, so the work grows with both sides, not with how much they overlap: an interval overlaps those that start before its end,
    less those that end at its start or before. Starts and ends are counted by place; running sums are taken within stretches of `width` places, and over
    one row a stretch.
    """
    right, left = right.filter("end > start"), left.filter("end > start")
    zero = F.lit(0).cast("long")
    whole = {"n": F.lit(1).cast("long")} | {f"has{i}": F.col(v).isNotNull().cast("long") for i, v in enumerate(values)} | {f"sum{i}": F.coalesce(F.col(v).cast("long"), zero) for i, v in enumerate(values)}
    side = lambda place, kind: right.select("chrom", F.col(place).cast("long").alias("_at"), *((x if k == kind else zero).alias(f"_{k}_{c}") for k in ("start", "end") for c, x in whole.items()))
    sums = [f"_{k}_{c}" for k in ("start", "end") for c in whole]
    asked = left.select("chrom", F.explode(F.array(F.col("start").cast("long"), F.col("end").cast("long") - 1)).alias("_at"), *(zero.alias(c) for c in sums))
    places = side("start", "start").unionByName(side("end", "end")).unionByName(asked).filter("chrom is not null")
    places = written(places.groupBy("chrom", "_at").agg(*(F.sum(c).alias(c) for c in sums)).withColumn("_cut", F.floor(F.col("_at") / width)), "places")
    earlier = Window.partitionBy("chrom").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    before = places.groupBy("chrom", "_cut").agg(*(F.sum(c).alias(c) for c in sums)).select("chrom", "_cut", *(F.coalesce(F.sum(c).over(earlier), zero).alias(f"_before{c}") for c in sums))
    upto = Window.partitionBy("chrom", "_cut").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    run = places.join(before, ["chrom", "_cut"]).select("chrom", "_at", *((F.sum(c).over(upto) + F.col(f"_before{c}")).alias(c) for c in sums))
    started = run.select("chrom", (F.col("_at") + 1).alias("_end"), *(F.col(f"_start_{c}").alias(f"_s_{c}") for c in whole))
    ended = run.select("chrom", F.col("_at").alias("_start"), *(F.col(f"_end_{c}").alias(f"_e_{c}") for c in whole))
    both = left.withColumns({"_start": F.col("start").cast("long"), "_end": F.col("end").cast("long")}).join(started, ["chrom", "_end"]).join(ended, ["chrom", "_start"])
    got = lambda c: F.col(f"_s_{c}") - F.col(f"_e_{c}")
    return both.filter(got("n") > 0).select(*left.columns, got("n").alias("n"), *(F.when(got(f"has{i}") > 0, got(f"sum{i}")).alias(v) for i, v in enumerate(values)))


def _nested(rows: DataFrame, column: str) -> bool:
    return dict(rows.dtypes)[column].startswith("map")


def carried(points: DataFrame, intervals: DataFrame, key: list[str], at: str, begin: str, length: str, take: list[str], width: int = 1 << 16) -> DataFrame:
    """Points (key, at) with the columns `take` of the interval of their key that holds them; points in none go.

    Intervals of a key (begin, length) don't overlap. Points and intervals are merged in the order of their places, and each point takes the last
    interval that began. Both are cut into stretches of `width` places first, an interval beginning anew in each, so one key with all points
    is many groups.
    """
    cut = lambda c: F.floor(c / width)
    inner = intervals.filter(F.col(length) > 0).select(*key, F.col(begin).cast("long").alias("_begin"), (F.col(begin) + F.col(length)).cast("long").alias("_stop"), F.struct(*take).alias("_take"))
    inner = inner.withColumn("_cut", F.explode(F.sequence(cut(F.col("_begin")), cut(F.col("_stop") - 1))))
    inner = inner.select(*key, "_cut", F.greatest("_begin", F.col("_cut") * width).alias("_at"), F.lit(0).alias("_kind"), F.struct("_stop", "_take").alias("_of"))
    points = points.withColumn("_row", F.struct(*points.columns)).select(*key, cut(F.col(at)).alias("_cut"), F.col(at).cast("long").alias("_at"), F.lit(1).alias("_kind"), "_row")
    merged = inner.withColumn("_row", F.lit(None).cast(points.schema["_row"].dataType)).unionByName(points.withColumn("_of", F.lit(None).cast(inner.schema["_of"].dataType)))
    w = Window.partitionBy(*key, "_cut").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = merged.withColumn("_of", F.last("_of", ignorenulls=True).over(w)).filter("_kind = 1 and _of._stop > _at")
    return found.select("_row.*", "_of._take.*")
