import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapespark.functions import text
from tapespark.operators import stats, trips


def test_quartiles_and_quantiles(spark):
    rnd = random.Random(1)
    for n in (0, 1, 2, 3, 4, 7, 50, 501):
        xs = [rnd.choice([rnd.random() * 100, 5.0, None]) for _ in range(n)]
        df = spark.createDataFrame(list(enumerate(xs)), "i long, x double")
        real = [x for x in xs if x is not None]
        r = stats.quartiles(df, "x", ["i"]).first()
        assert r["n"] == len(real)
        if len(real) > 1:
            assert [r["q1"], r["median"], r["q3"]] == pytest.approx(statistics.quantiles(real, n=4))
        else:
            assert (r["q1"], r["q3"]) == (None, None) and r["median"] == (real[0] if real else None)
    rows = [(g, rnd.random() if rnd.random() < 0.8 else 0.5) for g in "aab" for _ in range(300)] + [("c", 1.0), ("d", None)]
    got = {r["g"]: r for r in stats.quantiles(spark.createDataFrame(rows, "g string, x double"), "x", {"low": 0.05, "mid": 0.5, "top": 1.0}, ["g"]).collect()}
    assert set(got) == {"a", "b", "c"}
    for g in got:
        assert [got[g][c] for c in ("low", "mid", "top")] == pytest.approx(np.quantile([x for k, x in rows if k == g], [0.05, 0.5, 1.0]).tolist())


def test_binomial_tail_and_confusion(spark):
    pairs = [(0, 1), (1, 1), (3, 5), (50, 100), (0, 0), (9, 8), (1200, 2400)]
    df = spark.createDataFrame(pairs, "k long, n long")
    for r in df.select("k", "n", stats.binomial_tail(F.col("k"), F.col("n")).alias("p")).collect():
        k, n = r["k"], r["n"]
        want = None if not n or k > n else sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n
        assert r["p"] == (want if want is None else pytest.approx(want))
    rows = spark.createDataFrame([("BUY", "BUY"), ("BUY", "SKIP"), ("SELL", "BUY"), ("BUY", "BUY")], "h string, m string")
    got = {(r["human"], r["model"]): r["n"] for r in stats.confusion(rows, "h", "m").collect()}
    assert got == {(h, m): 0 for h in ("BUY", "SELL", "SKIP") for m in ("BUY", "SELL", "SKIP")} | {("BUY", "BUY"): 2, ("BUY", "SKIP"): 1, ("SELL", "BUY"): 1}


def test_durations(spark):
    shown = {"12s": 12, "3m": 180, "1h 5m": 3900, "2d": 172_800, "500ms": 0.5, "1mo": 2_592_000, "2m 30ms": 120.03, "soon": None, "": None, None: None}
    df = spark.createDataFrame([(x,) for x in shown], "x string")
    assert {r["x"]: r["s"] for r in df.select("x", text.display_duration(F.col("x")).alias("s")).collect()} == shown


def test_wallet_summary(spark):
    """Two closed trips, one open; one token's creation is known."""
    rows = [(1, 1, 100, None, 5.0, 0.0, 1, 0, 2.0), (1, 1, 100, 400, 2.0, 5.0, 2, 1, 3.0), (1, 2, 900, 1000, 4.0, 3.0, 1, 3, 5.0), (2, 2, 1, None, 1.0, 1.0, 1, 0, 1.0)]
    df = spark.createDataFrame(rows, "usr long, mint long, opened long, closed long, sol_in double, sol_out double, n_buys int, n_sells int, entry double")
    born = spark.createDataFrame([(1, 95)], "mint long, born long")
    got = {r["usr"]: r.asDict() for r in trips.wallet_summary(df, born, 10, 5).collect()}
    one = got[1]
    assert (one["closed_trips"], one["open_trips"], one["pnl"], one["win_rate"], one["avg_win"], one["avg_loss"], one["profit_factor"]) == (2, 1, 2.0, 0.5, 3.0, -1.0, 3.0)
    assert (one["median_size"], one["median_entry"], one["share_multi_buy"], one["share_multi_sell"], one["best_share"]) == (3.0, 4.0, 0.5, 0.5, 1.5)
    assert (one["share_first_slot"], one["share_near_slots"], one["pnl_first_slot"], one["share_known"]) == (0.0, 0.5, 0.0, 0.5)
    assert got[2]["closed_trips"] == 0 and got[2]["win_rate"] is None and got[2]["pnl_first_slot"] == 0.0
