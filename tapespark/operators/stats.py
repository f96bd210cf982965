"""Statistics as aggregates: sums over the data in Spark, small solves on the sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zscore(x: str, by: list[str], order: list[str], n: int, least: int) -> Column:
    """(x - mean) / sample deviation of the n rows before; null with fewer than ``least``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-n, -1)
    sd = F.stddev_samp(x).over(w)
    return F.when(F.count(x).over(w) >= least, (F.col(x) - F.avg(x).over(w)) / F.nullif(sd, F.lit(0.0)))


def trailing_rank(x: str, by: list[str], order: list[str], n: int) -> Column:
    """Mid-rank percentile of x among the n values before it; null without any."""
    past = F.collect_list(x).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-n, -1))
    below = F.aggregate(past, F.lit(0.0), lambda a, v: a + F.when(v < F.col(x), 1.0).when(v == F.col(x), 0.5).otherwise(0.0))
    return F.when(F.size(past) > 0, below / F.size(past))


def rank_bucket(rank: Column, n: Column, k: int) -> Column:
    """Equal-count bucket from 0 of a rank from 1, as quantile cuts give it."""
    return F.greatest(F.ceil((rank - 1) * k / F.greatest(n - 1, F.lit(1))) - 1, F.lit(0)).cast("long")


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Share of (positive, negative) pairs in which the positive scores higher, ties half: from rank sums of distinct scores.

    Rows are first added up by score; the running total over scores goes through range-partitioned blocks, so nothing is
    ordered in one task but the blocks' sums.
    """
    by = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("double")).alias("p"), F.sum(1 - F.col(label).cast("double")).alias("n"))
    cut = by.agg(F.percentile_approx("s", [k / 32 for k in range(1, 32)]).alias("q"))
    by = by.crossJoin(F.broadcast(cut)).withColumn("block", F.size(F.filter("q", lambda q: q < F.col("s")))).drop("q")
    sums = by.groupBy("block").agg(F.sum("n").alias("bn")).withColumn("before", F.coalesce(F.sum("bn").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    won = by.withColumn("lower", inside).join(F.broadcast(sums), "block").select("p", "n", (F.col("lower") + F.col("before")).alias("lower"))
    return won.agg((F.sum(F.col("p") * (F.col("lower") + F.col("n") / 2)) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0.0))).alias("auc"))


def counts_up_to(asked: DataFrame, at: str, series: dict[str, DataFrame], windows: dict[str, tuple[str, int]], block: int) -> DataFrame:
    """``asked`` with, for each of ``windows`` (name: series, width), how many ``x`` of the series lie in (at - width, at].

    Time is cut in blocks, of ``block`` or four times the longest width, whichever is more. Series shrink to counts by time before they
    move; a count also goes to the blocks that a window ending there begins before, so that each block is a line by itself, on
    which a count is the difference of two running sums.
    """
    reach = max(width for _, width in windows.values())
    size = max(block, 4 * reach)
    of = lambda x: F.floor(x / size)
    line = asked.select(F.struct(*asked.columns).alias("row"), F.col(at).alias("x"), of(F.col(at)).alias("block"), *(F.lit(0).cast("long").alias(f"n_{which}") for which in series))
    for which, df in series.items():
        part = df.where("x IS NOT NULL").groupBy("x").agg(F.count("*").alias("n"))
        blocks = F.explode(F.sequence(of(F.col("x")), of(F.col("x") + (reach - 1))))
        line = line.unionByName(part.select(F.lit(None).cast(line.schema["row"].dataType).alias("row"), "x", blocks.alias("block"), *(F.col("n") if k == which else F.lit(0).cast("long") for k in series)).toDF(*line.columns))
    ordered = Window.partitionBy("block").orderBy("x")
    up_to = lambda which, back: F.coalesce(F.sum(f"n_{which}").over(ordered.rangeBetween(Window.unboundedPreceding, -back)), F.lit(0))
    counts = [(up_to(which, 0) - up_to(which, width)).alias(f"c{k}") for k, (which, width) in enumerate(windows.values())]
    return line.select("row", *counts).where("row IS NOT NULL").select("row.*", *(F.col(f"c{k}").alias(name) for k, name in enumerate(windows)))


def levels(asked: DataFrame, at: str, changes: DataFrame, block: int) -> DataFrame:
    """``asked`` with ``level``, the sum of ``d`` of the changes with ``x`` at or before its time. Time is cut in blocks; a block adds up its own
    changes and begins with the sum over the blocks before it."""
    names = asked.columns
    moves = changes.groupBy("x").agg(F.sum("d").alias("d"))
    line = asked.select(F.struct(*names).alias("row"), F.col(at).alias("x"), F.lit(0).cast("long").alias("d"))
    line = line.unionByName(moves.select(F.lit(None).cast(line.schema["row"].dataType).alias("row"), "x", F.col("d").cast("long").alias("d"))).withColumn("block", F.floor(F.col("x") / block))
    sums = line.groupBy("block").agg(F.sum("d").alias("d"))
    sums = sums.select("block", F.coalesce(F.sum("d").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("d").over(Window.partitionBy("block").orderBy("x").rangeBetween(Window.unboundedPreceding, 0))
    found = line.withColumn("inside", inside).where("row IS NOT NULL").join(sums, "block", "left")
    return found.select("row.*", (F.col("inside") + F.coalesce("before", F.lit(0))).alias("level"))


def placed(rows: DataFrame, value: str, order: list[str], by: list[str] | None = None, ties: bool = False, blocks: int = 64) -> DataFrame:
    """``rows`` with ``place``, from 1 by rising value, then ``order``, and ``of``, the number of rows; per group of ``by``, of
    which there are few. With ``ties`` equal values have the place of the first.

    Values are cut in blocks at quantiles; a block is numbered by itself, and what lies below it is added. Rows without a value
    come first.
    """
    by = by or []
    cuts = rows.groupBy(*by).agg(F.percentile_approx(value, [k / blocks for k in range(1, blocks)], 100 * blocks).alias("__q"))
    cut = rows.join(F.broadcast(cuts), by) if by else rows.crossJoin(F.broadcast(cuts))
    cut = cut.withColumn("__b", F.when(F.col(value).isNull(), -1).otherwise(F.size(F.filter("__q", lambda q: q < F.col(value))))).drop("__q")
    sizes = cut.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy("__b")
    sizes = sizes.select(*by, "__b", F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("of"))
    inside = Window.partitionBy(*by, "__b").orderBy(value, *([] if ties else order))
    number = (F.rank() if ties else F.row_number()).over(inside)
    return cut.withColumn("__r", number).join(F.broadcast(sizes), [*by, "__b"]).withColumn("place", F.col("__r") + F.col("__before")).drop("__b", "__r", "__before")


def sign_test(k: Column, n: Column) -> Column:
    """Exact two-sided sign test of k of n, in logs, so it does not underflow."""
    log_factorial = lambda m: F.aggregate(F.sequence(F.lit(1), F.greatest(m.cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    low = F.least(k, n - k).cast("int")
    total = log_factorial(n)
    tail = F.aggregate(F.sequence(F.lit(0), low), F.lit(0.0), lambda a, i: a + F.exp(total - log_factorial(i) - log_factorial(n - i) - n * F.log(F.lit(2.0))))
    return F.when(n > 0, F.least(2 * tail, F.lit(1.0)))


def binomial_tail(k: Column, n: Column) -> Column:
    """The chance of ``k`` or more of ``n`` at even odds, exactly, in logs."""
    log_factorial = lambda m: F.aggregate(F.sequence(F.lit(1), F.greatest(m.cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    total = log_factorial(n)
    tail = F.aggregate(F.sequence(k.cast("int"), n.cast("int")), F.lit(0.0), lambda a, i: a + F.exp(total - log_factorial(i) - log_factorial(n - i) - n * F.log(F.lit(2.0))))
    return F.when((n > 0) & (k >= 0) & (k <= n), F.least(tail, F.lit(1.0)))


def quartiles(rows: DataFrame, value: str, order: list[str]) -> DataFrame:
    """One row: n, q1, median, q3 of the rows with a value; the quarters by the exclusive rule, from two rows on. Ranks are found by
    blocks, so no task holds all values."""
    ranked = placed(rows.where(F.col(value).isNotNull()), value, order)
    n = F.col("of")
    at = lambda k: F.least(F.greatest(F.floor(k * (n + 1) / 4), F.lit(1)), n - 1)
    part = lambda k: k * (n + 1) - 4 * at(k)
    near = [(k, F.when(F.col("place") == at(k), F.col(value)), F.when(F.col("place") == at(k) + 1, F.col(value))) for k in (1, 2, 3)]
    one = ranked.agg(F.count("*").alias("n"), F.max("of").alias("of"), F.max(value).alias("only"), *(F.max(x).alias(f"{side}{k}") for k, a, b in near for side, x in (("a", a), ("b", b))))
    q = {k: (F.col(f"a{k}") * (4 - part(k)) + F.col(f"b{k}") * part(k)) / 4 for k in (1, 2, 3)}
    return one.select("n", F.when(n > 1, q[1]).alias("q1"), F.when(n > 1, q[2]).otherwise(F.col("only").cast("double")).alias("median"), F.when(n > 1, q[3]).alias("q3"))


def quantiles(rows: DataFrame, value: str, points: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles per group of ``by``, of which there are few: a column for each of ``points``, between the two nearest values in
    proportion.

    Values are cut just below and just above each point, by an approximation; values that equal a cut are a block of their own. The
    blocks are counted, and only those that hold the ranks asked for are added up by value and ordered. However far the cuts are
    off, the ranks are exact.
    """
    by = by or []
    rows = rows.where(F.col(value).isNotNull()).select(*by, value)
    near = sorted({min(max(p + d, 0.0), 1.0) for p in points.values() for d in (-0.001, 0.001)})
    cuts = rows.groupBy(*by).agg(F.percentile_approx(value, near, 20_000).alias("__q"))
    cut = rows.join(F.broadcast(cuts), by) if by else rows.crossJoin(F.broadcast(cuts))
    cut = cut.select(*by, value, sum((F.when(F.col("__q")[k] < F.col(value), 2).when(F.col("__q")[k] == F.col(value), 1).otherwise(0) for k in range(len(near))), F.lit(0)).alias("__b"))
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy("__b")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = cut.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    sizes = sizes.select(*by, "__b", "__n", (F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"), F.sum("__n").over(whole).alias("of"))
    spot = {n: (F.col("of") - 1) * p for n, p in points.items()}
    low = {n: F.floor(x) for n, x in spot.items()}
    holds = lambda place: (F.col("__before") < place) & (place <= F.col("__before") + F.col("__n"))
    asked = F.lit(False)
    for n in points:
        asked = asked | holds(low[n] + 1) | holds(low[n] + 2)
    found = cut.join(F.broadcast(sizes.where(asked)), [*by, "__b"]).groupBy(*by, "__b", value, "__before", "of").agg(F.count("*").alias("__n"))
    inside = Window.partitionBy(*by, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("__before", F.col("__before") + F.sum("__n").over(inside) - F.col("__n"))
    ends = [F.max(F.when(holds(low[n] + k), F.col(value))).alias(f"__{n}{k}") for n in points for k in (1, 2)]
    found = found.groupBy(*by).agg(F.max("of").alias("of"), *ends)
    between = lambda n: F.col(f"__{n}1") + F.coalesce((F.col(f"__{n}2") - F.col(f"__{n}1")) * (spot[n] - low[n]), F.lit(0.0))
    return found.select(*by, *(between(n).alias(n) for n in points))


def confusion(rows: DataFrame, human: str, model: str) -> DataFrame:
    """(human, model, n) for every pair of labels that either has, zeros included; labels are few."""
    seen = rows.groupBy(F.col(human).alias("human"), F.col(model).alias("model")).agg(F.count("*").alias("n"))
    labels = seen.select(F.explode(F.array("human", "model")).alias("x")).distinct()
    pairs = labels.select(F.col("x").alias("human")).join(labels.select(F.col("x").alias("model")), F.lit(True))
    return pairs.join(seen, ["human", "model"], "left").select("human", "model", F.coalesce("n", F.lit(0)).alias("n"))


def gram(rows: DataFrame, y: str, xs: list[str], by: list[str] | None = None) -> DataFrame:
    """Per group: n, y'y, X'y and X'X with a constant first, as one aggregate."""
    cols = {"one": F.lit(1.0)} | {x: F.col(x).cast("double") for x in xs}
    names = list(cols)
    aggs = [F.count("*").alias("n"), F.sum(F.col(y) * F.col(y)).alias("yy")]
    aggs += [F.sum(cols[a] * F.col(y)).alias(f"xy_{i}") for i, a in enumerate(names)]
    aggs += [F.sum(cols[a] * cols[b]).alias(f"xx_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    return rows.groupBy(*(by or [])).agg(*aggs)


def _solve(row: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
    xx = np.array([[row[f"xx_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return np.linalg.pinv(xx), np.array([row[f"xy_{i}"] for i in range(k)])


def ols(rows: DataFrame, y: str, xs: list[str], cluster: str | None = None, lags: int | None = None, order: list[str] | None = None) -> DataFrame:
    """A row per coefficient (name, coef, se, t): plain, clustered by a column, or Newey-West errors over ordered rows.

    Data stay in Spark: the solve sees the k x k sums, then scores are summed by cluster, or multiplied with their lags.
    """
    spark = rows.sparkSession
    names = ["const", *xs]
    k = len(names)
    first = gram(rows, y, xs).first().asDict()
    inverse, xy = _solve(first, k)
    beta = inverse @ xy
    fitted = F.lit(float(beta[0])) + sum((float(b) * F.col(x) for b, x in zip(beta[1:], xs, strict=True)), F.lit(0.0))
    e = F.col(y) - fitted
    scores = rows.select(*([cluster] if cluster else []), *(order or []), e.alias("__s0"), *((e * F.col(x)).alias(f"__s{i + 1}") for i, x in enumerate(xs)), e.alias("__e"))
    pairs = [(i, j) for i in range(k) for j in range(k)]
    if cluster:
        groups = scores.groupBy(cluster).agg(*(F.sum(f"__s{i}").alias(f"__s{i}") for i in range(k)))
        meat_row = groups.agg(F.count("*").alias("g"), *(F.sum(F.col(f"__s{i}") * F.col(f"__s{j}")).alias(f"m_{i}_{j}") for i, j in pairs)).first()
        meat = np.array([[meat_row[f"m_{i}_{j}"] for j in range(k)] for i in range(k)])
        g, n = meat_row["g"], first["n"]
        cov = inverse @ meat @ inverse * (g / (g - 1)) * ((n - 1) / (n - k)) if g > 1 else np.full((k, k), np.nan)
    elif lags is not None:
        w = Window.orderBy(*order)
        lagged = scores.select("*", *(F.lag(f"__s{i}", lag).over(w).alias(f"__l{lag}_{i}") for lag in range(1, lags + 1) for i in range(k)))
        aggs = [F.sum(F.col(f"__s{i}") * F.col(f"__s{j}")).alias(f"m0_{i}_{j}") for i, j in pairs] + [F.sum(F.col(f"__s{i}") * F.col(f"__l{lag}_{j}")).alias(f"m{lag}_{i}_{j}") for lag in range(1, lags + 1) for i, j in pairs]
        row = lagged.agg(*aggs).first()
        of = lambda lag: np.array([[row[f"m{lag}_{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)])
        meat = of(0) + sum((1 - lag / (lags + 1)) * (of(lag) + of(lag).T) for lag in range(1, lags + 1))
        cov = inverse @ meat @ inverse
    else:
        residual = first["yy"] - beta @ xy
        cov = inverse * residual / max(first["n"] - k, 1)
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    return spark.createDataFrame([(m, float(b), float(s), float(b / s) if s else None) for m, b, s in zip(names, beta, se, strict=True)], "name string, coef double, se double, t double")


def agreement(rows: DataFrame, human: str, model: str, positive: object) -> DataFrame:
    """n, agreement, precision, recall, F1 and base rate of two labels."""
    h, m = F.col(human) == F.lit(positive), F.col(model) == F.lit(positive)
    s = rows.agg(F.count("*").alias("n"), F.count_if(F.col(human) == F.col(model)).alias("same"), F.count_if(h & m).alias("tp"), F.count_if(m).alias("mp"), F.count_if(h).alias("hp"))
    p, r = F.col("tp") / F.nullif(F.col("mp"), F.lit(0)), F.col("tp") / F.nullif(F.col("hp"), F.lit(0))
    return s.select("n", (F.col("same") / F.nullif(F.col("n"), F.lit(0))).alias("agreement"), p.alias("precision"), r.alias("recall"), (2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f1"), (F.col("hp") / F.nullif(F.col("n"), F.lit(0))).alias("base_rate"))


def lift(rows: DataFrame, outcome: str, groups: dict[str, Column]) -> DataFrame:
    """Per named condition: n, rate of the outcome, lift over the base rate; one pass over the data."""
    y = F.col(outcome).cast("double")
    flags = F.array(*(F.struct(F.lit(k).alias("name"), c.alias("on")) for k, c in (groups | {"all": F.lit(True)}).items()))
    by = rows.select(y.alias("y"), F.inline(flags)).where("on").groupBy("name").agg(F.count("*").alias("n"), F.avg("y").alias("rate"))
    base = by.where("name = 'all'").select(F.col("rate").alias("base"))
    return by.crossJoin(F.broadcast(base)).select("name", "n", "rate", (F.col("rate") / F.nullif(F.col("base"), F.lit(0.0))).alias("lift"))


#: The modulus of keyed draws.
_PRIME = 1_000_003


def poisson_limits() -> list[float]:
    """The chances of 0, of up to 1, ... up to 6 of a count whose mean is 1."""
    return np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720)]).tolist()


def bootstrap_difference(rows: DataFrame, value: str, arm: str, cluster: str, draws: int, seed: int) -> DataFrame:
    """Difference in means of the two arms and its 5% and 95% points over Poisson resamples of clusters. Draws are whole-number
    arithmetic on the draw's number and the cluster's, so that they are the same everywhere; clusters without a number are hashed."""
    c = rows.groupBy(cluster).agg(*(f(F.when(F.col(arm) == a, F.col(value))).alias(f"{n}{a}") for a in (0, 1) for n, f in (("s", F.sum), ("c", F.count))))
    c = c.select(cluster, *(F.coalesce(F.col(k).cast("double"), F.lit(0.0)).alias(k) for k in ("s0", "c0", "s1", "c1")))
    draw = c.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    whole = c.schema[cluster].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    key = F.pmod(F.col(cluster).cast("long") if whole else F.xxhash64(cluster), F.lit(_PRIME))
    x = F.pmod(key * 104_729 + F.col("draw") * 7_919 + seed, F.lit(_PRIME))
    for step in (1, 2, 3):
        x = F.pmod(x * x + F.col("draw") * (15_487 * step) + key, F.lit(_PRIME))
    u = (x + 0.5) / _PRIME
    k = F.lit(7)
    for i, edge in reversed(list(enumerate(poisson_limits()))):
        k = F.when(u < float(edge), i).otherwise(k)
    diff = lambda d: F.sum("s1w") / F.nullif(F.sum("c1w"), F.lit(0.0)) - F.sum("s0w") / F.nullif(F.sum("c0w"), F.lit(0.0))
    w = draw.withColumn("k", k).select("draw", *((F.col(x) * F.col("k")).alias(f"{x}w") for x in ("s0", "c0", "s1", "c1")))
    spread = w.groupBy("draw").agg(diff(None).alias("d")).agg(F.percentile("d", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    point = c.agg((F.sum("s1") / F.nullif(F.sum("c1"), F.lit(0.0)) - F.sum("s0") / F.nullif(F.sum("c0"), F.lit(0.0))).alias("difference"))
    return point.crossJoin(F.broadcast(spread)).select("difference", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
