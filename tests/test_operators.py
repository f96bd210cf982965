"""Operators on hand-made rows: as-of and range joins, performance, statistics, functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapespark.functions import columns as C
from tapespark.functions import text as X
from tapespark.operators import evidence, folds, joins, stats, trips


def test_asof_join(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (1, 0), (2, 7), (None, 5)], "k long, t long")
    right = spark.createDataFrame([(1, 3, 1, "a"), (1, 5, 2, "b"), (1, 5, 3, "c"), (1, 12, 4, "d")], "k long, t long, o long, v string")
    get = lambda **kw: {(r["k"], r["t"]): r["v"] for r in joins.asof_join(left, right, ["k"], "t", ["v"], order=["o"], **kw).collect()}
    assert get() == {(1, 5): "c", (1, 10): "c", (1, 0): None, (2, 7): None, (None, 5): None}
    assert get(strict=True) == {(1, 5): "a", (1, 10): "c", (1, 0): None, (2, 7): None, (None, 5): None}
    assert get(forward=True) == {(1, 5): "b", (1, 10): "d", (1, 0): "a", (2, 7): None, (None, 5): None}
    assert get(tolerance=2) == {(1, 5): "c", (1, 10): None, (1, 0): None, (2, 7): None, (None, 5): None}


def test_asof_does_not_see_later_rows(spark):
    left = spark.range(50).select((F.col("id") % 3).alias("k"), (F.col("id") * 7).alias("t"))
    right = spark.range(90).select((F.col("id") % 3).alias("k"), (F.col("id") * 4).alias("t"), F.col("id").alias("v"))
    full = set(joins.asof_join(left.where("t < 200"), right, ["k"], "t", ["v"]).collect())
    assert full == set(joins.asof_join(left.where("t < 200"), right.where("t < 200"), ["k"], "t", ["v"]).collect())


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_asof_in_blocks(spark, block):
    rng = np.random.default_rng(8)
    left = spark.createDataFrame([(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 80), rng.integers(-40, 60, 80), strict=True))], "k long, t long, i long")
    right = spark.createDataFrame([(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 4, 40), rng.integers(-40, 60, 40), strict=True))], "k long, t long, v long")
    for kw in ({}, {"strict": True}, {"forward": True}, {"tolerance": 5}):
        args = (left, right, ["k"], "t", ["v"])
        want = sorted(map(str, joins.asof_join(*args, order=["v"], **kw).collect()))
        assert sorted(map(str, joins.asof_join(*args, order=["v"], block=block, **kw).collect())) == want


@pytest.mark.parametrize("how", ["inner", "left"])
def test_range_join(spark, how):
    rng = np.random.default_rng(2)
    a = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 4, 60), rng.integers(-50, 50, 60)))]
    b = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 4, 80), rng.integers(-50, 50, 80)))]
    left, right = spark.createDataFrame(a, "k long, t long, i long"), spark.createDataFrame(b, "k long, u long, j long")
    for low, high in ((-7, 3), (0, 0), (5, 30)):
        want = {(x[2], y[2]) for x in a for y in b if x[0] == y[0] and low <= y[1] - x[1] <= high}
        if how == "left":
            want |= {(x[2], None) for x in a if x[2] not in {i for i, _ in want}}
        got = joins.range_join(left, right, ["k"], "t", "u", low, high, how=how).select("i", "j").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_performance_by_hand(spark):
    """Wins 3, 1.5 and 0.25, losses 1 and 0.75, one trade of nothing; the running sum falls from 3 to 1.25."""
    df = spark.createDataFrame([("s", k, x) for k, x in enumerate((3.0, -1.0, 0.0, -0.75, 0.25, 1.5))], "g string, t int, pnl double")
    r = trips.performance(df, "g", ["t"]).first()
    assert (r["n"], r["total"], r["win_rate"], r["profit_factor"], r["max_drawdown"], r["without_best"]) == (6, 3.0, 0.5, round(4.75 / 1.75, 4), 1.75, 0.0)
    assert trips.verdict(df, "g").first()["passes"] is False


def test_round_trips_by_hand(spark):
    rows = [(1, 1, 0, 0, False, 5.0, 1.0), (1, 1, 1, 1, True, 10.0, 4.0), (1, 1, 2, 2, False, 6.0, 2.0), (1, 1, 3, 3, False, 7.0, 2.0), (1, 1, 4, 4, True, 3.0, 1.0)]
    got = trips.round_trips(spark.createDataFrame(rows, "usr long, mint long, recv long, seq long, buy boolean, sol double, tok double")).orderBy("opened").collect()
    assert [(r["opened"], r["closed"], r["sol_in"], r["sol_out"], r["n_sells"]) for r in got] == [(1, 3, 10.0, 13.0, 2), (4, None, 3.0, 0.0, 0)]


def test_agreement_by_hand(spark):
    """Of 8 rows 3 are taken by both, 1 by the first alone, 2 by the second alone, 2 by neither."""
    rows = [("in", "in")] * 3 + [("in", "out")] + [("out", "in")] * 2 + [("out", "out")] * 2
    r = stats.agreement(spark.createDataFrame(rows, "h string, m string"), "h", "m", "in").first()
    assert r["agreement"] == 5 / 8 and r["precision"] == pytest.approx(3 / 5) and r["recall"] == pytest.approx(3 / 4)


def test_sign_test_and_auc(spark):
    df = spark.createDataFrame([(k, n) for n in (0, 1, 5, 40) for k in range(n + 1)], "k int, n int")
    for r in df.select("k", "n", stats.sign_test(F.col("k"), F.col("n")).alias("p")).collect():
        want = None if r["n"] == 0 else min(1.0, 2 * sum(math.comb(r["n"], i) for i in range(min(r["k"], r["n"] - r["k"]) + 1)) / 2 ** r["n"])
        assert r["p"] == (None if want is None else pytest.approx(want))
    rng = np.random.default_rng(1)
    rows = [(float(rng.integers(0, 12)), int(rng.integers(0, 2))) for _ in range(200)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert stats.auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()["auc"] == pytest.approx(want)


def test_least_squares(spark):
    rng = np.random.default_rng(3)
    n = 120
    x, g = rng.normal(size=n), np.arange(n) % 12
    y = 1 + 2 * x + rng.normal(size=n)
    df = spark.createDataFrame([(int(i), float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(y, x, g))], "i int, y double, x double, g int").cache()
    z = np.column_stack([np.ones(n), x])
    beta = np.linalg.solve(z.T @ z, z.T @ y)
    e, inv = y - z @ beta, np.linalg.inv(z.T @ z)
    plain = np.sqrt(np.diag(inv) * (e @ e) / (n - 2))
    sums = np.array([(z[g == k] * e[g == k, None]).sum(axis=0) for k in range(12)])
    clustered = np.sqrt(np.diag(inv @ (sums.T @ sums) @ inv) * 12 / 11 * (n - 1) / (n - 2))
    s = z * e[:, None]
    meat = s.T @ s + sum((1 - k / 4) * (s[k:].T @ s[:-k] + s[:-k].T @ s[k:]) for k in (1, 2, 3))
    newey = np.sqrt(np.diag(inv @ meat @ inv))
    for got, se in ((stats.ols(df, "y", ["x"]), plain), (stats.ols(df, "y", ["x"], cluster="g"), clustered), (stats.ols(df, "y", ["x"], lags=3, order=["i"]), newey)):
        rows = got.collect()
        assert [r["coef"] for r in rows] == pytest.approx(beta.tolist()) and [r["se"] for r in rows] == pytest.approx(se.tolist())


def test_bootstrap_interval_holds_the_difference(spark):
    df = spark.range(400).select((F.col("id") % 40).alias("c"), (F.col("id") % 2).cast("int").alias("arm"), (F.col("id") % 2 * 3.0 + F.col("id") % 7).alias("v"))
    r = stats.bootstrap_difference(df, "v", "arm", "c", 200, 5).first()
    assert r["low"] < r["difference"] < r["high"]
    assert r == stats.bootstrap_difference(df.repartition(3), "v", "arm", "c", 200, 5).first()


@pytest.mark.parametrize(("text", "number"), [("$7.25k", 7250.0), ("~3B", 3e9), ("0.5%", 0.5), ("98,765,432", 98765432.0), ("-.75", -0.75), ("<2m", 2e6), ("12 apples", None), ("K", None), (" ", None), (None, None)])
def test_display_number(spark, text, number):
    got = spark.createDataFrame([(text,)], "t string").select(X.display_number(F.col("t")).alias("n")).first()["n"]
    assert got == (number if number is None else pytest.approx(number))


@pytest.mark.parametrize(("text", "seconds"), [("2h 30m", 9000.0), ("1w", 604800.0), ("1.5D", 129600.0), ("4mo, 2d", 10540800.0), ("45s", 45.0), ("7 pm", None), ("soon", None), (" ", None), (None, None)])
def test_display_duration(spark, text, seconds):
    assert spark.createDataFrame([(text,)], "t string").select(X.display_duration(F.col("t")).alias("n")).first()["n"] == seconds


def test_pool_maths(spark):
    one = spark.range(1)
    q = lambda c: one.select(c.alias("x")).first()["x"]
    f = lambda x: F.lit(float(x))
    got = q(C.quote_buy(f(30), f(1e9), f(1), f(0.0125)))
    assert got == pytest.approx(1e9 * (1 / 1.0125) / (30 + 1 / 1.0125))
    assert q(C.round_trip(f(30), f(1e9), f(30), f(1e9), f(1), f(0.0))) < 0
    assert q(C.book_vwap(F.array(F.struct(f(10).alias("price"), f(1).alias("size")), F.struct(f(20).alias("price"), f(1).alias("size"))), 20)) == pytest.approx(20 / 1.5)
    assert q(C.book_vwap(F.array(F.struct(f(10).alias("price"), f(1).alias("size"))), 20)) is None


def test_evidence(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, seq long")
    new = spark.createDataFrame([(2, "c", 1, True)], "k long, v string, seq long, extra boolean")
    assert sorted((r["k"], r["v"], r["extra"]) for r in evidence.upsert(old, new, ["k"], "seq").collect()) == [(1, "a", None), (2, "c", True)]
    tables = {"p": spark.createDataFrame([(1, True), (2, False)], "id long, syn boolean"), "c": spark.createDataFrame([(10, 1), (11, 2)], "cid long, pid long"), "g": spark.createDataFrame([(10,), (11,)], "cid long")}
    kept = evidence.purge(tables, [("c", "pid", "p", "id"), ("g", "cid", "c", "cid")], "syn")
    assert [r["cid"] for r in kept["g"].collect()] == [11]
    df = spark.createDataFrame([("A \\n b", "x a B y"), ("zz", "x"), (None, "x"), ("q", None)], "q string, t string")
    assert [r["f"] for r in df.select(evidence.quote_found(F.col("q"), F.col("t")).alias("f")).collect()] == [True, False, None, None]


def test_lineage(spark):
    nodes = [(k, k - 1) for k in range(2, 101)] + [(1, None), (200, 3), (201, 999)]
    df = spark.createDataFrame(nodes, "k long, p long")
    got = sorted((r["start"], r["depth"], r["k"]) for r in evidence.lineage(df, "k", "p", spark.createDataFrame([(100,), (200,), (201,), (1,)], "k long")).collect())
    want = [(100, d, 100 - d) for d in range(100)] + [(200, 0, 200), (200, 1, 3), (200, 2, 2), (200, 3, 1), (201, 0, 201), (201, 1, 999), (1, 0, 1)]
    assert got == sorted(want)
    with pytest.raises(ValueError):
        evidence.lineage(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "k long, p long"), "k", "p", df.select("k").limit(1))


def test_quote_holders(spark):
    texts = [(1, "the quick brown fox jumps over it"), (2, "a thequick brown foxes den"), (3, "quick"), (4, None), (5, "unquickly brown"), (6, "")]
    quotes = [(1, "quick brown fox"), (2, "quick brown"), (3, "uick"), (4, "brown fox jumps over it"), (5, ""), (6, None), (7, "fox jumps over it all"), (8, "he qu")]
    q, d = spark.createDataFrame(quotes, "item long, quote string"), spark.createDataFrame(texts, "doc long, body string")
    want = {(i, k) for i, x in quotes for k, t in texts if x and t is not None and x in t}
    assert {tuple(r) for r in evidence.quote_holders(q, d, "item", "quote", "doc", "body").collect()} == want
    assert evidence.quote_holders(q.limit(0), d, "item", "quote", "doc", "body").collect() == []


def test_first_touch_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k), int(t), float(p), bool(e)) for k, t, p, e in zip(rng.integers(0, 3, 400), rng.integers(-300, 300, 400), rng.integers(1, 30, 400), rng.integers(0, 2, 400), strict=True)]
    df = spark.createDataFrame(rows, "k long, t long, p double, e boolean")
    want = []
    for k, t, p, e in rows:
        if e:
            later = [(u, q) for x, u, q, _ in rows if x == k and t < u <= t + 25]
            want.append((k, t, p, min((u for u, q in later if q >= 1.5 * p), default=None), min((u for u, q in later if q <= 0.7 * p), default=None)))
    got = [(r["k"], r["t"], r["p"], r["tp"], r["sl"]) for r in folds.first_touch(df, "k", "t", "p", "e", 1.5, 0.7, 25).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_cooldown_and_counts(spark):
    rng = np.random.default_rng(7)
    rows = sorted((int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 4, 200), rng.integers(0, 500, 200), strict=True)))
    want, last = set(), {}
    for k, t, i in rows:
        if k not in last or t - last[k] >= 17:
            last[k] = t
            want.add(i)
    df = spark.createDataFrame(rows, "k long, t long, i long")
    assert {r["i"] for r in folds.cooldown(df, ["k"], "t", 17, ["i"]).collect()} == want
    a, b = [t for _, t, _ in rows], [int(x) for x in rng.integers(0, 500, 50)]
    series = {"a": df.selectExpr("t AS x"), "b": spark.createDataFrame([(x,) for x in b], "x long")}
    asked = spark.createDataFrame([(i, i * 9) for i in range(60)], "q long, t long")
    for r in stats.counts_up_to(asked, "t", series, {"n": ("a", 30), "m": ("b", 100)}, 40).collect():
        assert (r["n"], r["m"]) == (sum(r["t"] - 30 < x <= r["t"] for x in a), sum(r["t"] - 100 < x <= r["t"] for x in b))
