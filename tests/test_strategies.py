import sys

import numpy as np
import pytest

from tapespark.operators import strategies

TAPE = "mint long, usr long, recv long, seq long, buy boolean, sol double, px double"


def dump(mint, prices=(), creator=7, sold=4):
    """The creator buys 3 and sells all at ``sold``; a crowd buys 0.5 each second."""
    rows = [(mint, creator, 0, 0, True, 3.0, 1.0)]
    for k in range(1, 60):
        rows.append((mint, creator, k, k, False, 3.5, 1.0) if k == sold else (mint, 100 + k, k, k, True, 0.5, dict(prices).get(k, 1.0)))
    return rows


def run(spark, rows, name="exit", order="recv, seq", **rules):
    rules = {"put": 2.9, "since": 20, "age": 30, "stop": 0.5, "hold": 10} | rules
    strategies.register_strategy(spark, name, lambda: strategies.FirstExit(**rules), strategies.FirstExit.SCHEMA, "recv")
    out = spark.sql(f"SELECT * FROM {name}(TABLE({{tape}}) PARTITION BY mint ORDER BY ({order}))", tape=spark.createDataFrame(rows, TAPE).repartition(4))
    return sorted(map(tuple, out.collect()), key=str)


def test_strategy_enters_once_and_leaves(spark):
    """At the creator's exit; by the stop, by time, or not at all; each key has a strategy of its own."""
    assert run(spark, dump(1)) == [(1, "enter", 4, 1.0), (1, "hold", 14, None)]
    assert run(spark, dump(1, [(9, 0.4), (10, 0.3)])) == [(1, "enter", 4, 1.0), (1, "stop", 9, 0.4)]
    assert run(spark, dump(1, sold=31)) == [] and run(spark, dump(1), put=3.1) == []
    both = run(spark, dump(1) + dump(2, [(12, 0.1)], creator=9) + dump(3, sold=40))
    assert both == [(1, "enter", 4, 1.0), (1, "hold", 14, None), (2, "enter", 4, 1.0), (2, "stop", 12, 0.1)]
    assert run(spark, []) == []


def test_strategy_sees_nothing_ahead(spark):
    """What a strategy does up to a time does not change when the tape is cut there."""
    tape = dump(1, [(9, 0.4)]) + dump(2, creator=9)
    whole = run(spark, tape)
    for cut in (3, 4, 8, 9, 13, 14, 40):
        assert run(spark, [r for r in tape if r[2] <= cut]) == [r for r in whole if r[2] <= cut]


def test_wakes_in_order(spark):
    class Clock(strategies.Strategy):
        def __init__(self):
            self.wake = 3

        def on_event(self, row):
            return [("event", row["recv"])]

        def on_tick(self, now):
            self.wake = now + 4 if now < 12 else None
            return [("tick", now)]

    strategies.register_strategy(spark, "clock", Clock, "what string, t long", "recv")
    tape = spark.createDataFrame([(1, 1), (1, 8), (1, None), (1, 7)], "mint long, recv long")
    got = spark.sql("SELECT * FROM clock(TABLE({tape}) PARTITION BY mint ORDER BY recv)", tape=tape).collect()
    assert [tuple(r) for r in got] == [("event", None), ("event", 1), ("tick", 3), ("tick", 7), ("event", 7), ("event", 8)]


def test_window_function(spark):
    strategies.register_window_function(spark, "spread", lambda w: np.ptp(w["x"]) + w["y"][-1], ["x", "y"])
    rows = spark.createDataFrame([(k, t, float(t * t % 7), t) for k in range(2) for t in range(20)], "k long, t long, x double, y long")
    rows.createOrReplaceTempView("spread_rows")
    got = spark.sql("SELECT k, t, spread(x, y) OVER (PARTITION BY k ORDER BY t RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS s FROM spread_rows").collect()
    for r in got:
        xs = [float(t * t % 7) for t in range(max(0, r["t"] - 3), r["t"] + 1)]
        assert r["s"] == max(xs) - min(xs) + r["t"]
    with pytest.raises(ValueError):
        strategies.register_window_function(spark, "none", len, [])


def test_window_function_takes_arrow(spark):
    """A frame is a slice of Arrow arrays: making pandas series of every frame took longer than the function."""
    strategies.register_window_function(spark, "from_arrow", lambda w: float(type(sys._getframe(1).f_locals["parts"][0]).__module__.startswith("pyarrow")), ["x"])
    rows = spark.createDataFrame([(k, float(k)) for k in range(3)], "k long, x double")
    rows.createOrReplaceTempView("arrow_rows")
    got = spark.sql("SELECT from_arrow(x) OVER (ORDER BY k RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS a FROM arrow_rows").collect()
    assert [r["a"] for r in got] == [1.0, 1.0, 1.0]
