"""What grows with the tables: times the tape is made, sorts of one task, states in Python."""

import pyarrow as pa
from pyspark.sql import functions as F

from tapespark import plans
from tapespark.functions import text
from tapespark.operators import evidence, scratch, stats, trips
from tapespark.operators.sweeps import Board
from tapespark.sources import feeds

SMALL = "/root/testdata/sf0.001"


def _plan(spark, name: str) -> str:
    return plans.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_tape_is_made_once_for_triggers(spark):
    assert "l_suppkey" not in _plan(spark, "w29_silence_then_burst")


def test_tape_is_made_once_for_snapshots_and_structure(spark):
    for name in ("c7_structure", "c13_fixed_age_snapshots"):
        assert "l_suppkey" not in _plan(spark, name)


def test_one_order_for_a_wallets_windows(spark):
    assert sum("Window [" in line and "usr" in line.split("], [")[1] for line in _plan(spark, "c8_hot_trigger").splitlines() if "Window [" in line) == 1


def test_board_forgets_what_no_longer_holds():
    board = Board(fresh=100)
    for t in range(50_000):
        board.put(t % 7, float(-t % 1013), t)
    assert len(board.heap) < 3_000
    last = {k: (float(-t % 1013), t) for t in range(49_900, 50_000) for k in [t % 7]}
    key, (value, t) = min(last.items(), key=lambda x: (-x[1][0], x[0]))
    assert board.top(50_000) == (key, value, t)
    for t in range(50_000, 90_000):
        board.put(t, 1.0, t)
    assert len(board.now) < 3_000


def test_quantiles_order_only_what_is_near(spark):
    rows = spark.range(50_000).selectExpr("id % 2 AS g", "CASE WHEN id % 3 = 0 THEN 7.0D ELSE CAST(id % 9973 AS DOUBLE) END AS x")
    df = stats.quantiles(rows, "x", {"low": 0.05, "mid": 0.5, "top": 1.0}, ["g"])
    got = {r["g"]: (r["low"], r["mid"], r["top"]) for r in df.collect()}
    want = {r["g"]: tuple(r["q"]) for r in rows.groupBy("g").agg(F.percentile("x", F.array(F.lit(0.05), F.lit(0.5), F.lit(1.0))).alias("q")).collect()}
    assert got == want
    assert "row_number" not in df._jdf.queryExecution().optimizedPlan().toString()  # of all rows, that is


def test_horizons_are_frames_of_one_line(spark, monkeypatch):
    monkeypatch.setattr(scratch, "written", lambda rows, label: rows)
    plan = _plan(spark, "c17_path_after_entry")
    assert "__left" not in plan and "Union" not in plan


def test_event_study_has_a_row_an_entry(spark):
    plan = _plan(spark, "c3_event_study")
    assert "l_suppkey" not in plan and "explode" not in plan


def test_trips_of_single_prints_are_not_walked(spark):
    prints = [(u, m, 100 * u + m, 7 * u + m, (u + m) % 3 != 0, 1.5 * m, 2.0 * u, 0.25 * u) for u in range(60) for m in range(20) for _ in range(1 + (u * m) % 17 // 16)]
    prints += [(None, 1, 5, 1, True, 1.0, 2.0, 3.0), (None, 1, 6, 2, False, 4.0, 2.0, 3.0), (None, None, 7, 3, True, 8.0, 1.0, 9.0)]
    rows = spark.createDataFrame(prints, "usr long, mint long, recv long, seq long, buy boolean, sol double, tok double, px double")
    got = {tuple(r) for r in trips.round_trips(rows, keep="px").where("closed IS NULL AND n_buys = 1").collect()}
    alone = [p for p in prints if sum(q[:2] == p[:2] for q in prints) == 1 and p[4]]
    assert got == {(u, m, at, None, sol, 0.0, tok, 0.0, 1, 0, tok, tok, px) for u, m, at, _, _, sol, tok, px in alone}
    batch = pa.RecordBatch.from_pydict({"usr": [1, 2, 2, 3, 4, None, 5], "mint": [1] * 7})
    assert trips._alone(batch).to_pylist() == [False, False, False, True, False, False, False]


def test_swaps_shuffle_transactions_once(spark):
    bal = "array<struct<owner:string,mint:string,amount:double>>"
    rows = [("a", "w", 0.0, 5.0, 4.0, None, [("w", "T", 1.0), ("z", "U", 1.0)]), ("b", "w", None, 1.0, 1.0, [("w", "T", 5.0)], []), ("c", "w", 0.0, 3.0, 1.0, [("w", None, 2.0)], [("w", "T", 2.0)]), (None, "w", 0.0, 3.0, 1.0, [], [("w", "T", 2.0)])]
    df = feeds.swaps(spark.createDataFrame(rows, f"sig string, wallet string, fee double, sol_pre double, sol_post double, pre {bal}, post {bal}"))
    assert sorted(map(tuple, df.collect())) == [("a", "w", "T", 1.0, -1.0), ("b", "w", "T", -5.0, None), ("c", "w", "T", 2.0, -2.0)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1


def test_counts_up_to_are_one_line_of_blocks(spark):
    asked = spark.createDataFrame([(1, 100), (2, 100), (2, 100), (3, -7), (4, None)], "q long, t long")
    series = {"a": spark.createDataFrame([(x,) for x in (-107, -106, -7, 0, 1, 99, 100, 101, None)], "x long")}
    df = stats.counts_up_to(asked, "t", series, {"n": ("a", 100), "m": ("a", 1)}, 10)
    assert sorted(map(tuple, df.collect()), key=str) == [(1, 100, 3, 1), (2, 100, 3, 1), (2, 100, 3, 1), (3, -7, 2, 1), (4, None, 0, 0)]
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_funding_reads_lines_once(spark):
    assert "l_suppkey" not in _plan(spark, "c37_funding_features")


def test_hand_over_shuffles_prints_for_the_walk_only(spark):
    plan = plans.QUERIES["c19_level_reach"](spark, SMALL)._jdf.queryExecution()
    assert "l_suppkey" not in plan.optimizedPlan().toString()
    assert plan.executedPlan().toString().count("Exchange hashpartitioning(") == 1


def test_last_values_are_looked_up_not_sorted(spark):
    assert "strategy=shuffle_hash" in _plan(spark, "j9_values_at_horizons")


def test_quotes_are_compared_where_they_meet(spark, monkeypatch):
    monkeypatch.setattr(evidence, "_QUOTES", 40)
    texts = [(1, "so a b c d x a b c d e f"), (2, "a b c d e f"), (2, "oo a b c d e"), (3, "o a b c d e f"), (4, "zz a b cc"), (5, None), (6, "")]
    quotes = [(1, "o a b c d e"), (2, "x a b c d e f"), (3, "z a b c"), (4, "a b c d e"), (5, "b c d x a b c d e f g"), (6, " "), (7, "d e f")]
    q, d = spark.createDataFrame(quotes, "item long, quote string"), spark.createDataFrame(texts, "doc long, body string")
    df = evidence.quote_holders(q, d, "item", "quote", "doc", "body")
    assert sorted(map(tuple, df.collect())) == sorted((i, k) for i, x in quotes for k, t in texts if x.strip() and t and x in t)
    assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    plan = _plan(spark, "e4_quote_check")
    assert not any("Join" in line and "doc_id" in line for line in plan.splitlines())


def test_white_space_is_collapsed_as_before(spark):
    raw = [" A\\nb\t c  D ", "\n\nx\x0b\x0cy \r z", 'q\\"r\\ts', "\\\\n", "   ", "", None, "a b"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i long, x string").select("i", text.normal(F.col("x")).alias("x"))
    assert [r["x"] for r in df.orderBy("i").collect()] == ["a b c d", "x y z", 'q"r s', "\\", "", "", None, "a b"]
    assert r"\\n" not in df._jdf.queryExecution().analyzed().toString()


def test_first_triggers_shuffle_prints_once_by_token(spark):
    plan = plans.QUERIES["c26_first_trigger_per_variant"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange " in line]
    assert sum("hashpartitioning(bucket" in line for line in dealt) == 1 and sum("hashpartitioning(mint" in line for line in dealt) == 1
    assert len(dealt) == 4, dealt  # and hits, by point or token, then by variant
