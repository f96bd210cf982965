import random
import statistics

import pytest
from pyspark.sql import functions as F

from tapespark.operators import grids, sweeps

TAPE = "mint long, usr long, t long, seq long, buy boolean, sol double, px double"


def tape(seed, n=400, mints=4, users=6, span=300):
    rnd = random.Random(seed)
    return [(rnd.randrange(mints), rnd.randrange(users), rnd.randrange(-50, span), k, rnd.random() < 0.6, float(rnd.randrange(1, 5)), float(rnd.randrange(1, 12))) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, TAPE).repartition(3)


@pytest.mark.parametrize(("block", "fresh", "grid"), [(20, 7, 5), (1000, 30, 10), (5, 12, 5)])
def test_leaders_against_every_point(spark, block, fresh, grid):
    """Ties of value, keys that get too old, times on grid points, negative times."""
    rows = tape(block, n=60)
    want, before = [], None
    for g in range(-100, 500, grid):
        last = {}
        for m, _, t, s, _, _, px in sorted(rows, key=lambda r: (r[2], r[3])):
            if t <= g:
                last[m] = (t, px)
        held = {m: px for m, (t, px) in last.items() if g - t <= fresh}
        top = max(held, key=lambda m: (held[m], -m), default=None)
        if top != before:
            want.append((g, top, held.get(top)))
        before = top
    got = sweeps.leaders(frame(spark, rows), "mint", "t", ["seq"], "px", grid, fresh, block)
    assert sorted(map(tuple, got.collect())) == want
    assert sweeps.leaders(frame(spark, []), "mint", "t", ["seq"], "px", grid, fresh, block).collect() == []


@pytest.mark.parametrize(("block", "window", "confirm"), [(10, 25, 15), (1000, 40, 10), (60, 5, 90)])
def test_crashes_against_brute_force(spark, block, window, confirm):
    rows = tape(window)
    want = []
    for m in range(4):
        own = sorted((r for r in rows if r[0] == m), key=lambda r: (r[2], r[3]))
        for i, (_, _, t, s, buy, _, px) in enumerate(own):
            near = [k for k in range(i + 1) if own[k][2] >= t - window]
            high = max(near, key=lambda k: (own[k][6], k))
            if buy or px > 0.4 * own[high][6]:
                continue
            sold = {}
            for r in own[high + 1 : i + 1]:
                if not r[4]:
                    sold[r[1]] = sold.get(r[1], 0) + r[5]
            top = min(sold, key=lambda u: (-sold[u], u))
            buyers = len({r[1] for r in own[i + 1 :] if r[4] and r[2] <= t + confirm})
            want.append((m, t, s, round(1 - px / own[high][6], 9), t - own[high][2], top, sold[top], buyers))
    got = sweeps.crashes(frame(spark, [*rows, (1, 1, None, 9999, True, 1.0, 1.0), (1, 1, 5, 9999, None, 1.0, 1.0)]), "mint", "t", ["seq"], "px", "usr", "buy", "sol", window, 0.6, confirm, block)
    assert got.columns == ["mint", "t", "seq", "fall", "since", "top", "top_sold", "buyers"]
    assert sorted((*r[:3], round(r[3], 9), *r[4:]) for r in map(tuple, got.collect())) == sorted(want) and len(want) > 20


def test_crashes_see_nothing_ahead(spark):
    """What is known at a crash does not change when the tape is cut there; buyers after it are known ``confirm`` later."""
    rows = tape(1)
    run = lambda r: {(c["mint"], c["t"], c["seq"]): tuple(c)[3:] for c in sweeps.crashes(frame(spark, r), "mint", "t", ["seq"], "px", "usr", "buy", "sol", 30, 0.6, 20, 50).collect()}
    whole = run(rows)
    part = run([r for r in rows if r[2] <= 120])
    assert {k: v[:-1] for k, v in part.items()} == {k: v[:-1] for k, v in whole.items() if k[1] <= 120}
    assert all(part[k] == whole[k] for k in part if k[1] + 20 <= 120)


def test_clusters_against_brute_force(spark):
    """A creator counts once; items leave after the window; the cooldown runs from the last cluster, not from the last hit."""
    rnd = random.Random(6)
    rows = [(rnd.choice("abc"), rnd.randrange(0, 400), rnd.randrange(9), k) for k in range(300)]
    want = []
    for word in "abc":
        own, last = sorted((r for r in rows if r[0] == word), key=lambda r: (r[1], r[3])), None
        for i, (_, t, _, _) in enumerate(own):
            near = [r for r in own[: i + 1] if r[1] >= t - 15]
            n = len({r[2] for r in near})
            if n >= 4 and (last is None or t - last >= 60):
                last = t
                want.append((word, t, n, [r[3] for r in near]))
    df = spark.createDataFrame(rows, "word string, t long, creator long, item long").repartition(3)
    got = sweeps.clusters(df, "word", "t", ["item"], "creator", "item", 15, 4, 60)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 5


@pytest.mark.parametrize(("hold", "wait"), [(12, 8), (60, 30)])
def test_hand_over_against_brute_force(spark, hold, wait):
    """Levels on both venues, on one time, the wait, no second venue, no completion, no later print."""
    rows = tape(hold, n=250, mints=5) + [(9, 0, 0, 900, True, 1.0, 5.0), (8, 0, 0, 901, True, 1.0, 5.0), (8, 0, 5, 902, False, 1.0, 5.0)]
    done = {0: 100, 1: 130, 2: 1000, 3: -200, 8: 3}
    want = []
    for m, _, t, s, buy, _, px in rows:
        tc = done.get(m)
        if not buy or (tc is not None and t >= tc):
            continue
        first = [r for r in rows if r[0] == m and (tc is None or r[2] < tc) and t < r[2] <= t + hold]
        pool = [r for r in rows if r[0] == m and tc is not None and r[2] >= tc]
        pool = [r for r in pool if r[2] <= min(x[2] for x in pool) + wait]
        touch = lambda own: (min((r[2] for r in own if r[6] >= 2 * px), default=None), min((r[2] for r in own if r[6] <= 0.5 * px), default=None))
        end = lambda own: max((r[2], r[6]) for r in own)
        up, down = touch(first)
        says = ("profit", "stop")
        if up is None and down is None and tc is not None and tc <= t + hold:
            up, down = touch(pool)
            says = ("pool profit", "pool stop")
        if down is not None and (up is None or down <= up):
            found = (says[1], down, None)
        elif up is not None:
            found = (says[0], up, None)
        elif tc is not None and tc <= t + hold:
            found = ("wait", *end(pool)) if pool else ("no pool", None, None)
        else:
            found = ("timeout", *(end(first) if first else (t, px)))
        want.append((m, s, *found))
    completions = spark.createDataFrame([*done.items()], "mint long, completed long")
    got = sweeps.hand_over(frame(spark, rows), completions, "mint", "t", "px", "buy", 2.0, 0.5, hold, wait)
    assert sorted(map(tuple, got.select("mint", "seq", "outcome", "exit_at", "exit_price").collect()), key=str) == sorted(want, key=str)
    assert len({w[2] for w in want}) >= 5


def test_rule_grid_against_every_rule(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, *range(10)]), rnd.random() * 4, rnd.random() < 0.3, float(rnd.randrange(100))) for _ in range(500)]
    thresholds = {"a": [0, 3, 7, 9.5], "b": [1.0, 2.0], "c": [0, 1]}
    df = spark.createDataFrame([(a, b, int(c), x) for a, b, c, x in rows], "a int, b double, c int, x double")
    got = {(r["a"], r["b"], r["c"]): (r["n"], r["s"]) for r in grids.rule_grid(df, thresholds, {"n": F.lit(1), "s": F.col("x")}).collect()}
    assert len(got) == 16
    for (a, b, c), (n, s) in got.items():
        own = [r for r in rows if r[0] is not None and r[0] >= a and r[1] >= b and int(r[2]) >= c]
        assert n == len(own) and s == sum(r[3] for r in own)


def test_variable_frames(spark):
    rnd = random.Random(3)
    rows = [(k, t, 1e6 + rnd.random(), w) for k, w in ((1, 1), (2, 4), (3, 30), (4, 50), (None, 3)) for t in range(40)]
    df = spark.createDataFrame(rows, "k long, t long, x double, w long")
    for r in grids.variable_frames(df, ["k"], ["t"], "x", "w").collect():
        own = [x for k, t, x, _ in rows if k == r["k"] and r["t"] - r["w"] < t <= r["t"]]
        if r["t"] + 1 < r["w"]:
            assert (r["mean"], r["std"], r["n"]) == (None, None, None)
        else:
            assert r["n"] == len(own) and r["mean"] == pytest.approx(statistics.mean(own), rel=1e-12)
            assert r["std"] is None if r["w"] == 1 else r["std"] == pytest.approx(statistics.stdev(own), rel=1e-6)


@pytest.mark.parametrize("seed", range(3))
def test_first_hits_against_all_rows(spark, seed):
    r = random.Random(seed)
    rows = [(k, r.randrange(-400, 900), i, r.choice([1.0, 2.0, 5.0, 9.0, 20.0, 60.0, None]), r.random() < 0.4, r.random() < 0.05) for i, k in enumerate(r.choices([1, 2, 3, 7, -4, None], k=300))]
    window, grid, fresh = 60, 10, 35
    want = {}
    hit = lambda variant, k, t: want.update({(variant, k): min(t, want.get((variant, k), t))})
    line = sorted(rows, key=lambda x: (x[1], x[2]))
    for n, (k, t, _, px, sell, flag) in enumerate(line):
        if flag:
            hit("mark", k, t)
        before = [(q[3], i) for i, q in enumerate(line[: n + 1]) if q[0] == k and q[3] is not None and q[1] >= t - window]
        if sell and k is not None and px is not None and px <= 0.1 * max(before)[0] and max(before)[1] < n:
            hit("crash", k, t)
    for g in range(-400, 1000, grid):
        last = {q[0]: q[3] for q in line if q[0] is not None and q[3] is not None and g - fresh <= q[1] <= g}
        if last:
            hit("leader", min(last, key=lambda k: (-last[k], k)), g)
    df = spark.createDataFrame(rows, "mint long, recv long, seq long, px double, sell boolean, mark boolean").repartition(4, "mint")
    with_batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sweeps.first_hits(df, "mint", "recv", ["seq"], "px", "sell", ["mark"], window, 0.1, grid, fresh).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_batches)
    assert {(x.variant, x.key): x["at"] for x in got} == want and len(got) == len(want)
