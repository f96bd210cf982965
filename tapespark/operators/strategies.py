"""Code that users plug in: strategies as table functions over ordered tapes, window functions as aggregates in SQL.

A strategy is an object with ``on_event(row)``, made anew for every key. It sees its key's rows one after the other, in order, and
keeps what it needs; no key is held in memory. It may set ``wake`` to a time: before the first row at or after that time,
``on_tick(now)`` is called with it. Both return the rows that the strategy gives out, tuples of the registered columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F


class Strategy:
    """What a strategy has to offer; ``wake`` is null or when ``on_tick`` is wanted next."""

    wake: int | None = None

    def on_event(self, row: Row) -> Iterable[tuple]:
        return ()

    def on_tick(self, now: int) -> Iterable[tuple]:
        return ()


def register_strategy(spark: SparkSession, name: str, make: Callable[[], Strategy], schema: str, at: str) -> None:
    """Make a strategy a table function of the session: ``SELECT * FROM name(TABLE(tape) PARTITION BY mint ORDER BY (recv, seq))``.

    ``schema``: the columns of its rows; ``at``: the column of the input that holds its time. Each partition has a strategy of its
    own. The order of rows within a partition, and with it the result, is what ORDER BY says; rows without a time come to
    ``on_event`` without waking it.
    """

    class Runs:
        def __init__(self) -> None:
            self.strategy = make()

        def eval(self, row: Row):
            now, strategy = row[at], self.strategy
            while now is not None and strategy.wake is not None and strategy.wake <= now:
                due, strategy.wake = strategy.wake, None
                yield from strategy.on_tick(due)
            yield from strategy.on_event(row)

    spark.udtf.register(name, F.udtf(Runs, returnType=schema))


def register_window_function(spark: SparkSession, name: str, fn: Callable[[dict[str, np.ndarray]], float], columns: list[str]) -> None:
    """Make a function of the events of a window, an array for each of ``columns``, an aggregate of the session that gives a double:
    ``SELECT name(recv, buy) OVER (PARTITION BY mint ORDER BY recv RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)``.

    The frame's rows come in their order. A frame is held in memory by its task, so it should be bounded.
    """
    if not 1 <= len(columns) <= 6:
        raise ValueError("columns: 1 to 6")
    s = pa.Array

    def run(*parts: pa.Array) -> float:
        return float(fn({c: p.to_numpy(zero_copy_only=False) for c, p in zip(columns, parts, strict=True)}))

    by_number = [
        lambda a: run(a), lambda a, b: run(a, b), lambda a, b, c: run(a, b, c), lambda a, b, c, d: run(a, b, c, d),
        lambda a, b, c, d, e: run(a, b, c, d, e), lambda a, b, c, d, e, f: run(a, b, c, d, e, f),
    ]
    of = by_number[len(columns) - 1]
    of.__annotations__ = {**dict.fromkeys(of.__code__.co_varnames, s), "return": float}
    spark.udf.register(name, F.arrow_udf(of, "double"))


class FirstExit(Strategy):
    """Enters when the creator, the wallet of a key's first print, has put in ``put`` or more and taken out more than that, ``since`` or
    less after its first sell and ``age`` or less after the first print; once per key. Leaves at a print at or below ``1 - stop``
    times the entry's price, or after ``hold``.

    Rows need mint, usr, recv, buy, sol and px. Gives mint, what ('enter', 'stop', 'hold'), t and px (null at 'hold').
    """

    SCHEMA = "mint long, what string, t long, px double"

    def __init__(self, put: float, since: int, age: int, stop: float, hold: int) -> None:
        self.put, self.since, self.age, self.stop, self.hold = put, since, age, stop, hold
        self.creator = self.born = self.first_sell = self.ref = self.mint = None
        self.spent = self.got = 0.0
        self.done = False

    def on_event(self, row: Row) -> Iterable[tuple]:
        now, px = row["recv"], row["px"]
        if self.creator is None:
            self.creator, self.born, self.mint = row["usr"], now, row["mint"]
        if row["usr"] == self.creator:
            if row["buy"]:
                self.spent += row["sol"]
            else:
                self.got += row["sol"]
                self.first_sell = now if self.first_sell is None else self.first_sell
        if self.ref is not None:
            if px <= self.ref * (1 - self.stop):
                self.ref = self.wake = None
                return [(row["mint"], "stop", now, px)]
            return []
        if self.done or self.first_sell is None or now - self.born > self.age or now - self.first_sell > self.since or self.spent < self.put or self.got <= self.spent:
            return []
        self.done, self.ref, self.wake = True, px, now + self.hold
        return [(row["mint"], "enter", now, px)]

    def on_tick(self, now: int) -> Iterable[tuple]:
        self.ref = None
        return [(self.mint, "hold", now, None)]
