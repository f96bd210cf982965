"""Sets of time intervals per key: union, intersection, difference, cuts, and what they cover.

Intervals are rows of key columns, ``lo`` and ``hi`` (long), half open: [lo, hi). A set is combined with others by a sweep over all
ends: how many intervals of each set are open at a time is a running sum. Time is cut in blocks, each begun with the sums of the
blocks before it, so that neither a busy key nor a set without keys is one task's work; only a row per block is ordered as a whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on equal keys, of which nulls are equal too; the keys are the left ones."""
    right = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys))
    return left.join(right, on, how).drop(*(f"__r_{k}" for k in keys))


def combine(sets: dict[str, DataFrame], by: list[str], rule: Callable[[dict[str, Column]], Column], block: int) -> DataFrame:
    """The times for which ``rule`` holds, as the fewest intervals: (by, lo, hi). ``rule`` gets, by the sets' names, how many of their
    intervals are open. The ends and the turns are written between the steps. Empty intervals, and ones without an end, count as none; where nothing is open, ``rule`` must be false."""
    names, ends = list(sets), None
    for name, rows in sets.items():
        rows = rows.where(F.col("lo") < F.col("hi"))
        for at, sign in (("lo", 1), ("hi", -1)):
            one = rows.select(*by, F.col(at).alias("t"), *(F.lit(sign if n == name else 0).cast("long").alias(n) for n in names))
            ends = one if ends is None else ends.unionByName(one)
    ends = ends.groupBy(*by, "t").agg(*(F.sum(n).alias(n) for n in names)).withColumn("blk", F.floor(F.col("t") / block))
    ends = written(ends, "interval-ends")
    blocks = Window.partitionBy(*by).orderBy("blk")
    inside = Window.partitionBy(*by, "blk").orderBy("t")
    carried = ends.groupBy(*by, "blk").agg(*(F.sum(n).alias(n) for n in names))
    carried = carried.select(*by, "blk", *(F.coalesce(F.sum(n).over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"__c_{n}") for n in names))
    rows = same_keys(ends, carried, [*by, "blk"])
    first = {n: F.col(f"__c_{n}") for n in names}
    now = {n: F.sum(n).over(inside.rowsBetween(Window.unboundedPreceding, 0)) + c for n, c in first.items()}
    rows = rows.select(*by, "t", "blk", rule(now).alias("__on"), rule(first).alias("__first"))
    flips = rows.withColumn("__was", F.coalesce(F.lag("__on").over(inside), F.col("__first"))).where("__on <> __was").select(*by, "t", "blk", "__on")
    flips = written(flips, "interval-flips")
    heads = flips.groupBy(*by, "blk").agg(F.min("t").alias("__head")).withColumn("__next", F.lead("__head").over(blocks)).drop("__head")
    flips = same_keys(flips.withColumn("hi", F.lead("t").over(inside)), heads, [*by, "blk"])
    return flips.where("__on").select(*by, F.col("t").alias("lo"), F.coalesce("hi", "__next").alias("hi"))


def union(a: DataFrame, b: DataFrame, by: list[str], block: int) -> DataFrame:
    """What either covers; intervals that meet become one."""
    return combine({"a": a, "b": b}, by, lambda n: (n["a"] > 0) | (n["b"] > 0), block)


def intersection(a: DataFrame, b: DataFrame, by: list[str], block: int) -> DataFrame:
    """What both cover."""
    return combine({"a": a, "b": b}, by, lambda n: (n["a"] > 0) & (n["b"] > 0), block)


def difference(a: DataFrame, b: DataFrame, by: list[str], block: int) -> DataFrame:
    """What ``a`` covers and ``b`` does not; the complement of ``b`` within bounds is their difference."""
    return combine({"a": a, "b": b}, by, lambda n: (n["a"] > 0) & (n["b"] == 0), block)


def cut(rows: DataFrame, cells: dict[str, tuple[int, int]], label: str) -> DataFrame:
    """Intervals cut at the bounds of a few labelled cells; what lies in none goes."""
    table = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for n, (a, b) in cells.items()))
    met = F.filter(table, lambda c: (c["a"] < F.col("hi")) & (c["b"] > F.col("lo")))
    rest = [c for c in rows.columns if c not in ("lo", "hi")]
    return rows.withColumn("__c", F.explode(met)).select(*rest, F.greatest("lo", "__c.a").alias("lo"), F.least("hi", "__c.b").alias("hi"), F.col("__c.n").alias(label))


def segments(points: DataFrame, by: list[str], at: str, gap: int, block: int) -> DataFrame:
    """What a record of points covers: from a point to the next one if that is at most ``gap`` later, and each point itself. As
    intervals of points that reach as far as the gap, less what they reach beyond the last one."""
    reach = points.where(F.col(at).isNotNull()).select(*by, F.col(at).alias("lo"), (F.col(at) + gap + 1).alias("hi"))
    whole = combine({"a": reach}, by, lambda n: n["a"] > 0, block)
    return whole.withColumn("hi", F.col("hi") - gap)


def covered_cells(rows: DataFrame, by: list[str], cell: int, holes: int) -> DataFrame:
    """(by, cell start, covered): the cells of a grid that the disjoint intervals leave open for at most ``holes``."""
    cells = F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell)))
    part = rows.where(F.col("lo") < F.col("hi")).withColumn("start", cells).withColumn("start", F.col("start") * cell)
    part = part.withColumn("covered", F.least("hi", F.col("start") + cell) - F.greatest("lo", "start"))
    return part.groupBy(*by, "start").agg(F.sum("covered").alias("covered")).where(F.col("covered") >= cell - holes)
