"""As-of and range joins by bucketed keys and ordered windows; both shuffle on the key only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], forward: bool = False, strict: bool = False, tolerance: int | None = None, order: list[str] | None = None, block: int | None = None) -> DataFrame:
    """``left`` with the ``values`` of the last ``right`` row at or before its time (``forward``: the first at or after).

    ``strict`` leaves out equal times; ``tolerance`` nulls matches further away; ``order`` breaks ties of ``right`` (the last
    in this order counts as latest). Rows without a match get nulls. One union, one shuffle by key, one ordered window: the
    cost does not depend on how many rows match. The time of the match comes as ``<at>_right``.

    With ``block``, keys are cut in blocks of time of that length, so that a busy key goes to many tasks; where a block has no
    match of its own, the nearest end of the blocks before it (``forward``: after it) counts, from a line of their ends.
    """
    order = order or []
    fields = F.struct(F.col(at).alias("__t"), *(F.col(c).alias(c) for c in values))
    names = left.columns
    seen = right.select(*by, F.col(at).alias("__at"), fields.alias("__right"), F.lit(None).cast(left.select(F.struct(*names)).schema[0].dataType).alias("__left"), *(F.col(c).alias(f"__o{k}") for k, c in enumerate(order)))
    asked = left.select(*by, F.col(at).alias("__at"), F.lit(None).cast(seen.schema["__right"].dataType).alias("__right"), F.struct(*names).alias("__left"), *(F.lit(None).cast(right.schema[c].dataType).alias(f"__o{k}") for k, c in enumerate(order)))
    is_left = F.col("__left").isNotNull().cast("int")
    side = -is_left if strict else is_left  # where equal times count, they must be read before the row that asks
    ordered = (lambda c: c.desc()) if forward else (lambda c: c.asc())
    keys = [ordered(F.col("__at")), side.asc(), *(ordered(F.col(f"__o{k}")) for k in range(len(order)))]
    line = seen.unionByName(asked)
    if block:
        line = line.withColumn("__block", F.floor(F.col("__at") / block))
    window = Window.partitionBy(*by, *["__block"] * bool(block)).orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = line.withColumn("__hit", F.last("__right", ignorenulls=True).over(window)).where("__left IS NOT NULL")
    if block:
        at_end = F.struct("__at", *(f"__o{k}" for k in range(len(order))))
        nearest = (F.min_by if forward else F.max_by)("__right", F.when(F.col("__right").isNotNull(), at_end))
        ends = line.groupBy(*by, "__block").agg(nearest.alias("__end"))
        before = Window.partitionBy(*by).orderBy(ordered(F.col("__block"))).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("__far", F.last("__end", ignorenulls=True).over(before)).where("__far IS NOT NULL").select(*(F.col(c).alias(f"__k_{c}") for c in by), F.col("__block").alias("__k_block"), "__far")
        same = F.col("__block") == F.col("__k_block")
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        found = found.join(ends, same, "left").withColumn("__hit", F.coalesce("__hit", "__far"))
    near = F.lit(True) if tolerance is None else F.abs(F.col("__hit.__t") - F.col("__at")) <= tolerance
    return found.select("__left.*", F.when(near, F.col("__hit.__t")).alias(f"{at}_right"), *(F.when(near, F.col(f"__hit.{c}")).alias(c) for c in values))


def range_join(left: DataFrame, right: DataFrame, by: list[str], at: str, right_at: str, low: int, high: int, how: str = "inner", condition: Column | None = None) -> DataFrame:
    """Pairs with ``low <= right_at - at <= high`` on equal ``by`` keys; ``how`` is inner or left.

    Times are cut in buckets as wide as the range. A left row stays in its bucket, a right row goes to the two or three whose
    left rows it can meet, so the join is an equi-join on (by, bucket) that shuffles and splits like any other, and a left
    outer join needs no row ids. ``right`` must not share column names with ``left`` but the keys.
    """
    width = max(1, high - low)
    bucket = lambda c: F.floor(c / width).cast("long")
    probe = left.withColumn("__bucket", bucket(F.col(at)))
    build = right.select(*(F.col(c).alias(f"__{c}") for c in by), *(c for c in right.columns if c not in by))
    build = build.withColumn("__rbucket", F.explode(F.sequence(bucket(F.col(right_at) - high), bucket(F.col(right_at) - low))))
    on = (F.col("__bucket") == F.col("__rbucket")) & F.col(right_at).between(F.col(at) + low, F.col(at) + high)
    for c in by:
        on = on & (F.col(c) == F.col(f"__{c}"))
    if condition is not None:
        on = on & condition
    return probe.join(build, on, how).drop("__bucket", "__rbucket", *(f"__{c}" for c in by))
