"""Grids of threshold rules, and frames whose length is data: both by sums that are made once and read off."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rule_grid(rows: DataFrame, thresholds: dict[str, list[float]], measures: dict[str, Column]) -> DataFrame:
    """For every combination of one threshold per column, the sums of ``measures`` over the rows that reach all of them: a row per rule,
    with the threshold under the column's name. Thresholds rise; a row with a null column reaches none of its thresholds.

    A summed-area table: rows are counted once, by how many thresholds of each column they reach, and the counts are summed up
    column by column. The rows are read once whatever the number of rules, and the table is as large as the grid.
    """
    reached = {c: sum((F.coalesce((F.col(c) >= t).cast("int"), F.lit(0)) for t in ts), F.lit(0)) for c, ts in thresholds.items()}
    cells = rows.select(*(n.alias(f"__{c}") for c, n in reached.items()), *(m.alias(k) for k, m in measures.items())).groupBy(*(f"__{c}" for c in thresholds)).agg(*(F.sum(k).alias(k) for k in measures))
    grid = rows.sparkSession.createDataFrame(list(product(*(range(1, len(ts) + 1) for ts in thresholds.values()))), ", ".join(f"`__{c}` int" for c in thresholds))
    table = grid.join(cells, list(grid.columns), "left").unionByName(cells.join(grid, list(grid.columns), "left_anti"))
    for c in thresholds:
        down = Window.partitionBy(*(f"__{o}" for o in thresholds if o != c)).orderBy(F.desc(f"__{c}"))
        table = table.withColumns({k: F.sum(k).over(down) for k in measures})
    at = lambda c: F.element_at(F.array(*(F.lit(float(t)) for t in thresholds[c])), F.col(f"__{c}"))
    inside = table.join(grid, list(grid.columns), "left_semi")
    return inside.select(*(at(c).alias(c) for c in thresholds), *(F.coalesce(k, F.lit(0)).alias(k) for k in measures))


def variable_frames(rows: DataFrame, by: list[str], order: list[str], value: str, length: str) -> DataFrame:
    """``rows`` with ``mean``, ``std`` (of a sample) and ``n`` of the last ``length`` rows of their group, their own included, where
    ``length`` is a column of one value per group; null where the group has not had so many yet.

    Sums from the group's beginning, of differences from its mean, at a row less those ``length`` rows before, which are found by
    row number: no frame is read twice, however long it is.
    """
    line = Window.partitionBy(*by).orderBy(*order)
    x = F.col(value) - F.avg(value).over(Window.partitionBy(*by))
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({"__i": F.row_number().over(line), "__x": x}).withColumns({"__s": F.sum("__x").over(upto), "__q": F.sum(F.col("__x") * F.col("__x")).over(upto)})
    back = summed.select(*(F.col(c).alias(f"__b_{c}") for c in by), (F.col("__i") + F.col(length)).alias("__j"), F.col("__s").alias("__s0"), F.col("__q").alias("__q0"))
    on = F.col("__i") == F.col("__j")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    n = F.col(length)
    s, q = (F.col(f"__{k}") - F.coalesce(f"__{k}0", F.lit(0.0)) for k in "sq")
    full = F.col("__i") >= n
    var = (q - s * s / n) / (n - 1)
    out = summed.join(back, on, "left").withColumns({"mean": F.when(full, s / n + F.col(value) - F.col("__x")), "std": F.when(full & (n > 1), F.sqrt(F.greatest(var, F.lit(0.0)))), "n": F.when(full, n)})
    return out.select(*rows.columns, "mean", "std", "n")
