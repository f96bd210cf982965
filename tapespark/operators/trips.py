"""Round trips of wallets, their summaries, and performance tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .folds import sweep

#: A trip is over when at most this share of its largest position is left.
DUST = 0.01

_TRIP = "usr long, mint long, opened long, closed long, sol_in double, sol_out double, bought double, sold double, n_buys int, n_sells int"
_PRINT = ("usr", "mint", "recv", "buy", "sol", "tok")


def _alone(batch: pa.RecordBatch) -> pa.BooleanArray:
    """Rows that are surely the only ones of their (usr, mint): other keys stand before and after them in the batch."""
    n = batch.num_rows
    if n < 3:
        return pa.array(np.zeros(n, bool))
    usr, mint = batch.column("usr"), batch.column("mint")
    other = pc.or_kleene(*(pc.not_equal(c.slice(1), c.slice(0, n - 1)) for c in (usr, mint))).fill_null(False).to_numpy(zero_copy_only=False)
    alone = np.zeros(n, bool)
    alone[1:-1] = other[:-1] & other[1:]
    return pa.array(alone)


def _values(column: pa.Array) -> list:
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def round_trips(prints: DataFrame, with_state: bool = False, keep: str | None = None) -> DataFrame:
    """One row per trip of (usr, mint): it opens at the first buy when flat, and closes when the position falls to 1% of its peak.

    Sells when flat are left out; a trip that is not over has a null ``closed``. Prints are walked in order of (recv, seq), so
    equal times have a fixed order; the state is one open trip, however many prints a wallet has. Prints without a time, side
    or amount are not counted. ``with_state``: also ``pos`` and ``peak``, what is held at the trip's end and was held at most. ``keep``:
    also ``entry``, what this column (double) has at the print that opens the trip.
    """
    schema = StructType.fromDDL(_TRIP + ", pos double, peak double" * (with_state or keep is not None) + ", entry double" * (keep is not None))
    read = [*_PRINT, *([keep] if keep else [])]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pos, peak, trip, entry = None, 0.0, 0.0, None, None
        for batch in batches:
            done = []
            single = _alone(batch)
            bought = batch.filter(pc.and_(single, batch.column("buy")))
            if bought.num_rows:
                yield _opened(bought)
            batch = batch.filter(pc.invert(single))
            for usr, mint, recv, buy, sol, tok, *has in zip(*map(_values, (batch.column(c) for c in read)), strict=True):
                if (usr, mint) != key:
                    if trip:
                        done.append([*trip, pos, peak, entry])
                    key, pos, peak, trip = (usr, mint), 0.0, 0.0, None
                if buy:
                    pos += tok
                    if trip:
                        trip[4] += sol
                        trip[6] += tok
                        trip[8] += 1
                        peak = max(peak, pos)
                    else:
                        pos = peak = tok
                        trip, entry = [usr, mint, recv, None, sol, 0.0, tok, 0.0, 1, 0], has[0] if has else None
                elif trip:
                    trip[5] += sol
                    trip[7] += tok
                    trip[9] += 1
                    if pos - tok <= DUST * peak:
                        trip[3] = recv
                        done.append([*trip, pos - tok, peak, entry])
                        pos, peak, trip = 0.0, 0.0, None
                    else:
                        pos -= tok
            if done:
                yield _batch(done)
        if trip:
            yield _batch([[*trip, pos, peak, entry]])

    def _opened(rows: pa.RecordBatch) -> pa.RecordBatch:
        """The open trips of keys whose only print is a buy."""
        n = rows.num_rows
        usr, mint, recv, sol, tok = (rows.column(c) for c in ("usr", "mint", "recv", "sol", "tok"))
        zero, one, none = pa.array(np.zeros(n)), pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64())
        made = [usr, mint, recv, none, sol, zero, tok, zero, one, pa.array(np.zeros(n, np.int32)), tok, tok, *([rows.column(keep)] if keep else [])]
        return pa.RecordBatch.from_arrays([c.cast(kind) for c, kind in zip(made, types, strict=False)][: len(names)], names)

    types = [pa.int64()] * 4 + [pa.float64()] * 4 + [pa.int32()] * 2 + [pa.float64()] * 3

    def _batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind, _ in zip(zip(*rows, strict=True), types, names, strict=False)], names)

    rows = prints.select(*read, "seq").dropna(subset=list(_PRINT[2:]))
    return sweep(rows, ["usr", "mint"], ["recv", "seq"], run, schema)


def summarize(trips: DataFrame, by: str = "usr") -> DataFrame:
    """Per wallet: trips, open ones, win rate, profit and its median, holding time, turnover."""
    closed = F.col("closed").isNotNull()
    pnl = F.when(closed, F.col("sol_out") - F.col("sol_in"))
    held = F.when(closed, (F.col("closed") - F.col("opened")) / 1e6)
    return trips.groupBy(by).agg(
        F.count("*").alias("trips"),
        F.count_if(~closed).alias("open_trips"),
        F.round(F.sum(pnl), 2).alias("pnl"),
        F.round(F.percentile(pnl, 0.5), 4).alias("median_pnl"),
        F.round(F.avg((pnl > 0).cast("double")), 6).alias("win_rate"),
        F.round(F.percentile(held, 0.5), 3).alias("median_hold_s"),
        F.round(F.sum(F.when(closed, F.col("sol_in"))), 2).alias("sol_in"),
        F.round(F.max(pnl), 2).alias("best"),
        F.round(F.min(pnl), 2).alias("worst"),
    )


def wallet_summary(trips: DataFrame, born: DataFrame, slot: int, near: int, by: str = "usr") -> DataFrame:
    """The full summary per wallet, of trips with ``entry`` (their price at entry): counts, profit and its parts, medians of holding
    time, size, entry price and the token's age at entry, shares of trips with several buys or sells, of the best trade in the
    profit, and of entries in the token's first slot and up to ``near`` slots after it. All but the counts are of closed trips.

    ``born``: (mint, born), the tokens whose creation is known; a slot is ``slot`` long.
    """
    rows = trips.join(born, "mint", "left").withColumn("slots", F.floor(F.col("opened") / slot) - F.floor(F.col("born") / slot))
    closed = F.col("closed").isNotNull()
    pnl = F.when(closed, F.col("sol_out") - F.col("sol_in"))
    of = lambda x: F.when(closed, x)
    share = lambda c: F.round(F.avg(of(F.coalesce(c, F.lit(False)).cast("double"))), 6)
    median = lambda x, n: F.round(F.percentile(of(x), 0.5), n)
    won, lost = F.sum(F.when(pnl > 0, pnl)), F.sum(F.when(pnl <= 0, -pnl))
    return rows.groupBy(by).agg(
        F.count_if(closed).alias("closed_trips"),
        F.count_if(~closed).alias("open_trips"),
        F.round(F.sum(pnl), 2).alias("pnl"),
        F.round(F.avg((pnl > 0).cast("double")), 6).alias("win_rate"),
        F.round(F.avg(F.when(pnl > 0, pnl)), 7).alias("avg_win"),
        F.round(F.avg(F.when(pnl <= 0, pnl)), 7).alias("avg_loss"),
        F.round(F.when(lost > 0, F.coalesce(won, F.lit(0.0)) / lost), 6).alias("profit_factor"),
        median((F.col("closed") - F.col("opened")) / 1e6, 3).alias("median_hold_s"),
        median(F.col("sol_in"), 4).alias("median_size"),
        median(F.col("entry"), 6).alias("median_entry"),
        median((F.col("opened") - F.col("born")) / 1e6, 3).alias("median_age_s"),
        share(F.col("n_buys") > 1).alias("share_multi_buy"),
        share(F.col("n_sells") > 1).alias("share_multi_sell"),
        F.round(F.when(F.sum(pnl) > 0, F.max(pnl) / F.sum(pnl)), 6).alias("best_share"),
        share(F.col("slots") == 0).alias("share_first_slot"),
        share(F.col("slots") <= near).alias("share_near_slots"),
        F.round(F.coalesce(F.sum(F.when(F.col("slots") == 0, pnl)), F.lit(0.0)), 2).alias("pnl_first_slot"),
        share(F.col("slots").isNotNull()).alias("share_known"),
    )


def leaderboard(summary: DataFrame, least: int) -> DataFrame:
    """Wallets with at least so many closed trips, best profit first."""
    return summary.where(F.col("trips") - F.col("open_trips") >= least).orderBy(F.col("pnl").desc(), F.col("usr"))


def max_drawdown(rows: DataFrame, by: list[str], order: list[str], pnl: str = "pnl", from_zero: bool = True) -> DataFrame:
    """Largest fall of the running sum from its running peak, per group; the peak starts at 0 if ``from_zero``."""
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = rows.withColumn("__cum", F.sum(pnl).over(run))
    peak = F.max("__cum").over(run)
    peak = F.greatest(peak, F.lit(0.0)) if from_zero else peak
    return cum.withColumn("__dd", peak - F.col("__cum")).groupBy(*by).agg(F.max("__dd").alias("max_drawdown"))


def performance(rows: DataFrame, by: str, order: list[str], pnl: str = "pnl") -> DataFrame:
    """Trade table per group: n, total, mean, median, win rate, average win and loss, profit factor, drawdown, without the best
    trade and without the best 5% (at least one, half to even). Wins are over 0, losses under 0."""
    x = F.col(pnl)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(x.desc(), *order))
    n = F.count("*").over(Window.partitionBy(by))
    ranked = rows.withColumn("__r", rank).withColumn("__k", F.greatest(F.lit(1), F.bround(n * 0.05).cast("int")))
    out = ranked.groupBy(by).agg(
        F.count("*").alias("n"),
        F.round(F.sum(x), 2).alias("total"),
        F.round(F.avg(x), 7).alias("mean"),
        F.round(F.percentile(x, 0.5), 4).alias("median"),
        F.round(F.avg((x > 0).cast("double")), 6).alias("win_rate"),
        F.round(F.avg(F.when(x > 0, x)), 7).alias("avg_win"),
        F.round(F.avg(F.when(x < 0, x)), 7).alias("avg_loss"),
        F.round(F.sum(F.when(x > 0, x)) / F.abs(F.nullif(F.sum(F.when(x < 0, x)), F.lit(0.0))), 4).alias("profit_factor"),
        F.round(F.sum(F.when(F.col("__r") > 1, x).otherwise(0.0)), 2).alias("without_best"),
        F.round(F.sum(F.when(F.col("__r") > F.col("__k"), x).otherwise(0.0)), 2).alias("without_top"),
    )
    fall = max_drawdown(rows, [by], order, pnl).select(by, F.round("max_drawdown", 2).alias("max_drawdown"))
    return out.join(fall, by)


def verdict(rows: DataFrame, by: str, pnl: str = "pnl", least: int = 50, factor: float = 1.2, best: int = 3) -> DataFrame:
    """The pass bar per group: enough trades, profit, profit factor, and profit without the best trades. Losses are 0 or less."""
    x = F.col(pnl)
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(x.desc())))
    out = ranked.groupBy(by).agg(F.count("*").alias("n"), F.sum(x).alias("net"), F.sum(F.when(x > 0, x).otherwise(0.0)).alias("won"), (-F.sum(F.when(x <= 0, x).otherwise(0.0))).alias("lost"), F.sum(F.when(F.col("__r") > best, x).otherwise(0.0)).alias("rest"))
    good = (F.col("n") >= least) & (F.col("net") > 0) & (F.col("won") > factor * F.col("lost")) & (F.col("rest") > 0)
    return out.select(by, "n", F.round("net", 2).alias("net"), F.round(F.when(F.col("lost") > 0, F.col("won") / F.col("lost")), 4).alias("profit_factor"), F.round("rest", 2).alias("without_best"), good.alias("passes"))
