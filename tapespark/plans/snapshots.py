"""Point-in-time features of tokens: snapshots of the whole market, structure at an age, snapshots at fixed ages with outcomes.

The tape is slow: a second of a live market is two days here, so that ten seconds are twenty days. A snapshot uses prints before
its time only; a token's creator is the wallet of its first print.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import joins, scratch
from ..sources import tape
from ..sources.tape import DAY, LAUNCHES, SECOND, TAPE
from .registry import Tables, query

_HOUR = 3600 * SECOND
#: The look-back of a market snapshot and its parts of a half, a third and a sixth.
WEEK, HALF, THIRD, SIXTH = 7 * DAY, 84 * _HOUR, 56 * _HOUR, 28 * _HOUR


def _priced(t: Tables) -> DataFrame:
    return tape.prints(t("lineitem"), t("orders")).withColumn("px", F.col("vsol") / F.col("vtok"))


def _kept(t: Tables) -> DataFrame:
    """The tape with prices, written once for queries that go through it several times: each time would join lines and orders anew."""
    columns = ("mint", "usr", "recv", "seq", "buy", "sol", "tok", "vsol", "vtok")
    return scratch.written(tape.prints(t("lineitem"), t("orders")).select(*columns), "tape").withColumn("px", F.col("vsol") / F.col("vtok"))


def _sum(condition: Column, x: Column | str) -> Column:
    return F.sum(F.when(condition, F.col(x) if isinstance(x, str) else x).otherwise(0.0))


def creators(rows: DataFrame) -> DataFrame:
    """mint, its creator (dev), and when its first print was (born)."""
    return rows.groupBy("mint").agg(F.min(F.struct("recv", "seq", "usr")).alias("x")).select("mint", F.col("x.usr").alias("dev"), F.col("x.recv").alias("born"))


_BORN = "born AS (SELECT mint, arg_min(usr, (recv, seq)) AS dev, min(recv) AS born FROM tape GROUP BY mint)"

_ANCHORS = f"""anchors AS (SELECT unnest(generate_series(first, last, {30 * DAY})) AS t FROM
 (SELECT epoch_us(CAST(CAST(min(l_shipdate) AS DATE) AS TIMESTAMP)) + {30 * DAY} AS first, epoch_us(CAST(CAST(max(l_shipdate) AS DATE) AS TIMESTAMP)) + {30 * DAY} AS last FROM lineitem))"""


def anchors(t: Tables, step: int) -> DataFrame:
    """Times a step apart over the whole tape, the first a step after its beginning."""
    day = tape.day_of(F.col("l_shipdate"))
    return t("lineitem").agg(F.min(day).alias("first"), F.max(day).alias("last")).select(F.explode(F.sequence(F.col("first") + step, F.col("last") + step, F.lit(step))).alias("t"))


@query(
    "c5_snapshot_features",
    f"""WITH {TAPE}, {_ANCHORS}, {_BORN}, w AS (SELECT a.t, p.*, vsol / vtok AS px, a.t - p.recv AS ago FROM anchors a JOIN tape p ON p.recv >= a.t - {WEEK} AND p.recv < a.t)
SELECT t, mint, round((t - any_value(born)) / 1e6, 3) AS age_s, arg_max(px, (recv, seq)) * 1e9 AS mcap_sol, arg_max(vsol, (recv, seq)) - 30 AS rsol,
 count(*) FILTER (buy AND ago <= {SIXTH}) AS buys_sixth, count(*) FILTER (NOT buy AND ago <= {SIXTH}) AS sells_sixth,
 count(DISTINCT usr) FILTER (buy AND ago <= {SIXTH}) AS buyers_sixth, count(DISTINCT usr) FILTER (buy AND ago <= {HALF}) AS buyers_half, count(DISTINCT usr) FILTER (buy AND ago > {SIXTH} AND ago <= {THIRD}) AS buyers_before,
 count(DISTINCT usr) FILTER (buy AND ago <= {SIXTH}) - count(DISTINCT usr) FILTER (buy AND ago > {SIXTH} AND ago <= {THIRD}) AS buyer_accel,
 round(coalesce(sum(CASE WHEN buy THEN sol ELSE -sol END) FILTER (ago <= {SIXTH}), 0), 2) AS net_flow_sixth, round(coalesce(sum(CASE WHEN buy THEN sol ELSE -sol END) FILTER (ago <= {HALF}), 0), 2) AS net_flow_half,
 round(sum(sol), 2) AS volume, count(*) AS prints, round(1 - arg_max(px, (recv, seq)) / max(px), 6) AS drawdown, count(DISTINCT usr) FILTER (buy AND usr % 3 = 0) AS tracked_in,
 coalesce(max(sol) FILTER (buy AND ago <= {HALF}), 0) AS largest_buy FROM w JOIN born USING (mint) GROUP BY t, mint""",
)
def c5_snapshot_features(t: Tables) -> DataFrame:
    """Sixteen features of every token active in [t - week, t), at times thirty days apart over the whole tape.

    Wallets are counted by a group-by of (t, token, wallet) before that of (t, token), so no print is copied for a distinct count.
    """
    rows = _priced(t)
    w = joins.range_join(anchors(t, 30 * DAY), rows, [], "t", "recv", -WEEK, -1).withColumn("ago", F.col("t") - F.col("recv"))
    buy, within = F.col("buy"), lambda span: F.col("ago") <= span
    signed = F.when(buy, F.col("sol")).otherwise(-F.col("sol"))
    before = buy & (F.col("ago") > SIXTH) & within(THIRD)
    wallets = w.groupBy("t", "mint", "usr").agg(
        F.max(F.struct("recv", "seq", "px", "vsol")).alias("last"), F.max("px").alias("high"), F.count("*").alias("n"), F.sum("sol").alias("volume"),
        F.count_if(buy).alias("b"), F.count_if(buy & within(SIXTH)).alias("b6"), F.count_if(~buy & within(SIXTH)).alias("s6"), F.count_if(buy & within(HALF)).alias("b2"), F.count_if(before).alias("b3"),
        _sum(within(SIXTH), signed).alias("f6"), _sum(within(HALF), signed).alias("f2"), F.max(F.when(buy & within(HALF), F.col("sol"))).alias("largest"),
    )
    some = lambda c: F.count_if(F.col(c) > 0)
    f = wallets.groupBy("t", "mint").agg(
        F.max("last").alias("last"), F.max("high").alias("high"), F.sum("n").alias("prints"), F.round(F.sum("volume"), 2).alias("volume"),
        F.sum("b6").alias("buys_sixth"), F.sum("s6").alias("sells_sixth"), some("b6").alias("buyers_sixth"), some("b2").alias("buyers_half"), some("b3").alias("buyers_before"),
        F.round(F.sum("f6"), 2).alias("net_flow_sixth"), F.round(F.sum("f2"), 2).alias("net_flow_half"),
        F.count_if((F.col("b") > 0) & (F.col("usr") % 3 == 0)).alias("tracked_in"), F.coalesce(F.max("largest"), F.lit(0.0)).alias("largest_buy"),
    )
    born = rows.groupBy("mint").agg(F.min("recv").alias("born"))
    return f.join(born, "mint").select(
        "t", "mint", F.round((F.col("t") - F.col("born")) / 1e6, 3).alias("age_s"), (F.col("last.px") * C.SUPPLY).alias("mcap_sol"), (F.col("last.vsol") - 30).alias("rsol"), "buys_sixth", "sells_sixth", "buyers_sixth", "buyers_half", "buyers_before",
        (F.col("buyers_sixth") - F.col("buyers_before")).alias("buyer_accel"), "net_flow_sixth", "net_flow_half", "volume", "prints", F.round(1 - F.col("last.px") / F.col("high"), 6).alias("drawdown"), "tracked_in", "largest_buy",
    )


_AGE, _SLOT = 1000 * DAY, 10 * DAY


@query(
    "c7_structure",
    f"""WITH {TAPE}, {LAUNCHES}, {_BORN}, p AS (SELECT tape.*, dev, born, (recv - born) // {_SLOT} AS slot FROM tape JOIN born USING (mint) WHERE recv < born + {_AGE}),
b AS (SELECT mint, usr, usr = dev AS own, sum(CASE WHEN buy THEN tok ELSE -tok END) AS pos, coalesce(bool_or(NOT buy), false) AS sold, coalesce(sum(sol) FILTER (buy AND slot = 0), 0) AS put, count(*) FILTER (buy AND slot = 0) > 0 AS at_first, count(*) FILTER (buy AND slot <= 5) > 0 AS early FROM p GROUP BY ALL),
h AS (SELECT mint, sum(pos) AS top FROM (SELECT mint, pos, row_number() OVER (PARTITION BY mint ORDER BY pos DESC) AS r FROM b WHERE pos > 1) WHERE r <= 10 GROUP BY mint),
s AS (SELECT mint, round(coalesce(sum(put) FILTER (own), 0), 2) AS dev_buy_sol, coalesce(sum(greatest(pos, 0)) FILTER (own), 0) AS dev_pos, bool_or(own AND sold) AS dev_sold, count(*) FILTER (NOT own AND at_first) AS first_slot_buyers, round(coalesce(sum(put) FILTER (NOT own), 0), 2) AS first_slot_sol,
 count(*) FILTER (NOT own AND early) AS snipers, coalesce(sum(greatest(pos, 0)) FILTER (NOT own AND early), 0) AS sniper_pos, count(*) FILTER (pos > 1) AS holders, sum(greatest(pos, 0)) AS held FROM b GROUP BY mint)
SELECT s.mint, dev_buy_sol, round(dev_pos / nullif(held, 0) * 100, 4) AS dev_pct, dev_sold, first_slot_buyers, first_slot_sol, snipers, round(sniper_pos / nullif(held, 0) * 100, 4) AS snipers_pct, holders, round(coalesce(top, 0) / nullif(held, 0) * 100, 4) AS top10_pct,
 (SELECT count(*) FROM launches l WHERE l.creator // 10 = born.dev AND l.born >= born.born - {90 * DAY} AND l.born < born.born) AS dev_launches FROM s JOIN born ON born.mint = s.mint LEFT JOIN h ON h.mint = s.mint""",
)
def c7_structure(t: Tables) -> DataFrame:
    """Who holds a token at an age of 1,000 days: its creator, buyers of the first slot, snipers of the first six, the ten largest.

    A slot is ten days from the first print; shares are percentages of what all wallets hold net, and the launches of the creator's
    accounts are those of the ninety days before. The ten largest come by a ranked window that Spark limits before its shuffle.
    """
    rows = _kept(t)
    born = creators(rows)
    p = rows.join(born, "mint").where(F.col("recv") < F.col("born") + _AGE).withColumn("slot", F.floor((F.col("recv") - F.col("born")) / _SLOT))
    buy = F.col("buy")
    b = p.groupBy("mint", "usr", (F.col("usr") == F.col("dev")).alias("own")).agg(
        F.sum(F.when(buy, F.col("tok")).otherwise(-F.col("tok"))).alias("pos"), F.bool_or(~buy).alias("sold"), _sum(buy & (F.col("slot") == 0), "sol").alias("put"),
        F.bool_or(buy & (F.col("slot") == 0)).alias("at_first"), F.bool_or(buy & (F.col("slot") <= 5)).alias("early"),
    )
    own, up = F.col("own"), F.greatest("pos", F.lit(0.0))
    s = b.groupBy("mint").agg(
        F.round(_sum(own, "put"), 2).alias("dev_buy_sol"), _sum(own, up).alias("dev_pos"), F.bool_or(own & F.col("sold")).alias("dev_sold"), F.count_if(~own & F.col("at_first")).alias("first_slot_buyers"), F.round(_sum(~own, "put"), 2).alias("first_slot_sol"),
        F.count_if(~own & F.col("early")).alias("snipers"), _sum(~own & F.col("early"), up).alias("sniper_pos"), F.count_if(F.col("pos") > 1).alias("holders"), F.sum(up).alias("held"),
    )
    ranked = b.where("pos > 1").withColumn("r", F.row_number().over(Window.partitionBy("mint").orderBy(F.col("pos").desc())))
    top = ranked.where("r <= 10").groupBy("mint").agg(F.sum("pos").alias("top"))
    made = tape.launches(t("orders")).select(F.floor(F.col("creator") / 10).alias("dev"), F.col("born").alias("made"))
    before = joins.range_join(born.withColumnRenamed("mint", "of"), made, ["dev"], "born", "made", -90 * DAY, -1).groupBy(F.col("of").alias("mint")).agg(F.count("*").alias("dev_launches"))
    share = lambda c: F.round(F.col(c) / F.nullif("held", F.lit(0.0)) * 100, 4)
    every = s.join(top, "mint", "left").join(before, "mint", "left").fillna(0, ["top", "dev_launches"])
    return every.select("mint", "dev_buy_sol", share("dev_pos").alias("dev_pct"), "dev_sold", "first_slot_buyers", "first_slot_sol", "snipers", share("sniper_pos").alias("snipers_pct"), "holders", share("top").alias("top10_pct"), "dev_launches")


#: Days; seconds of a live market are doubled.
AGES, WINDOWS, RETURNS, LATENCY, HORIZONS, HOLDS = (10, 20, 40, 60, 120, 240, 600), (20, 60), (10, 30, 120), 2, (60, 240, 1200), (240, 600)
#: Take-profit and stop-loss levels.
EXITS = ((0.2, 0.1), (0.3, 0.15), (0.5, 0.2), (1.0, 0.3))
SIZE, FEE = 100.0, 0.0125
_NAMES = [(f"g_tp{round(tp * 100)}_sl{round(sl * 100)}_{hold}", k, hold) for k, (tp, sl) in enumerate(EXITS) for hold in HOLDS]


def _net_sql(s1: str, k1: str) -> str:
    got = f"(vtok0 * ({SIZE} / {1 + FEE}) / (vsol0 + {SIZE} / {1 + FEE}))"
    return f"round({s1} * {got} / ({k1} + {got}) * (1 - {FEE}) - {SIZE}, 6)"


def _state_sql(column: str, at: str) -> str:
    return f"(SELECT arg_max({column}, (p.recv, p.seq)) FROM tape p WHERE p.mint = s.mint AND p.recv <= {at})"


_C13_SQL = f"""WITH {TAPE}, {LAUNCHES}, {_BORN}, tape_end AS (SELECT max(recv) AS last FROM tape),
done AS (SELECT b.mint, min(completed_at) AS tc FROM launches JOIN born b ON b.mint = creator % (SELECT max(s_suppkey) FROM supplier) + 1 WHERE completed_at >= b.born + {1000 * DAY} GROUP BY b.mint),
s AS (SELECT b.mint, dev, b.born, tc, CAST(age AS BIGINT) AS age, b.born + age * {DAY} AS t, b.born + (age + {LATENCY}) * {DAY} AS entered FROM born b LEFT JOIN done USING (mint), (VALUES {", ".join(f"({a})" for a in AGES)}) v(age), tape_end
 WHERE b.born + (age + {LATENCY + max(HORIZONS)}) * {DAY} <= last AND (tc IS NULL OR tc > b.born + age * {DAY})),
f AS (SELECT s.mint, s.age, count(*) AS prints, round((any_value(t) - max(recv)) / 1e6, 3) AS idle_s, {", ".join(f"count(*) FILTER (buy AND recv > t - {w * DAY}) AS buys_{w}, count(*) FILTER (NOT buy AND recv > t - {w * DAY}) AS sells_{w}, round(coalesce(sum(CASE WHEN buy THEN sol ELSE -sol END) FILTER (recv > t - {w * DAY}), 0), 2) AS net_flow_{w}, count(DISTINCT usr) FILTER (buy AND recv > t - {w * DAY}) AS buyers_{w}" for w in WINDOWS)},
 count(DISTINCT usr) FILTER (buy) AS buyers, coalesce(max(sol) FILTER (buy), 0) AS largest_buy, round(coalesce(sum(sol) FILTER (buy AND usr = dev), 0), 2) AS dev_in, round(coalesce(sum(sol) FILTER (NOT buy AND usr = dev), 0), 2) AS dev_out,
 count(*) FILTER (buy AND usr <> dev AND recv < s.born + {2 * DAY}) AS launch_buys, round(count(*) FILTER (NOT buy) / count(*), 6) AS sell_share FROM s JOIN tape p ON p.mint = s.mint AND p.recv <= s.t GROUP BY s.mint, s.age),
e AS (SELECT s.*, {_state_sql("vsol / vtok", "s.t")} AS px, {_state_sql("vsol", "s.t")} AS vsol, {_state_sql("vsol", "s.entered")} AS vsol0, {_state_sql("vtok", "s.entered")} AS vtok0, {", ".join(f"{_state_sql('vsol / vtok', f's.t - {w * DAY}')} AS px_{w}" for w in RETURNS)} FROM s),
x AS (SELECT e.mint, e.age, {", ".join(f"min(recv) FILTER (p.vsol / p.vtok >= {1 + tp} * (vsol0 / vtok0) OR p.vsol / p.vtok <= {1 - sl} * (vsol0 / vtok0)) AS hit_{k}" for k, (tp, sl) in enumerate(EXITS))} FROM e LEFT JOIN tape p ON p.mint = e.mint AND p.recv > entered AND p.recv <= entered + {max(HOLDS) * DAY} AND (tc IS NULL OR p.recv < tc) GROUP BY e.mint, e.age),
o AS (SELECT s.*, x.* EXCLUDE (mint, age), {", ".join(f"greatest(entered, least(entered + {h * DAY}, coalesce(tc - 1, entered + {h * DAY}))) AS at_pnl_{h}" for h in HORIZONS)},
 {", ".join(f"greatest(entered, least(CASE WHEN hit_{k} <= entered + {h * DAY} THEN hit_{k} + {LATENCY * DAY} ELSE entered + {h * DAY} END, coalesce(tc - 1, entered + {2 * max(HORIZONS) * DAY}))) AS at_{n}" for n, k, h in _NAMES)} FROM e s JOIN x ON x.mint = s.mint AND x.age = s.age)
SELECT s.mint, s.age, s.vsol, s.px * 1e9 AS mcap, f.* EXCLUDE (mint, age), {", ".join(f"round(s.px / s.px_{w} - 1, 6) AS ret_{w}" for w in RETURNS)},
 (SELECT count(*) FROM launches l WHERE l.creator // 10 = s.dev AND l.born < s.born) AS dev_launches, (SELECT count(*) FROM launches l WHERE l.creator // 10 = s.dev AND l.completed_at < s.born) AS dev_completions, tc IS NOT NULL AS completed,
 {", ".join(_net_sql(_state_sql("p.vsol", f"s.at_{n}"), _state_sql("p.vtok", f"s.at_{n}")) + f" AS {n}" for n in [*(f"pnl_{h}" for h in HORIZONS), *(n for n, _, _ in _NAMES)])}
FROM o s JOIN f ON f.mint = s.mint AND f.age = s.age"""


def _states(asks: DataFrame, rows: DataFrame) -> DataFrame:
    """``asks`` (mint, age, what, at) with the pool's state at that time."""
    known = rows.select("mint", F.col("recv").alias("at"), "seq", "vsol", "vtok")
    return joins.asof_join(asks, known, ["mint"], "at", ["vsol", "vtok"], order=["seq"], block=200 * DAY)


def _asks(rows: DataFrame, times: dict[str, Column]) -> DataFrame:
    every = F.explode(F.array(*(F.struct(F.lit(n).alias("what"), at.alias("at")) for n, at in times.items()))).alias("x")
    return rows.select("mint", "age", every).select("mint", "age", "x.what", "x.at")


@query("c13_fixed_age_snapshots", _C13_SQL)
def c13_fixed_age_snapshots(t: Tables) -> DataFrame:
    """Every token at seven ages: 24 features of what was known then, net results of a fixed size after three horizons, and those
    of eight exits by target, stop or time; entries and exits are filled at the state a latency after the decision. A token that has
    completed has no snapshot, and an exit after completion gets the last state before.

    A print goes to the ages that have seen it (seven at most) and is summed by wallet before shuffling; states are as-of joins
    in blocks of time; the prints at an exit's levels are reduced to the first one. The tape is written once.
    """
    rows = _kept(t)
    launched = tape.launches(t("orders")).withColumn("dev", F.floor(F.col("creator") / 10))
    last = rows.agg(F.max("recv").alias("last"))  # one row
    k = t("supplier").agg(F.max("s_suppkey").alias("k"))  # one row
    born = creators(rows)
    finished = launched.where("completed").crossJoin(F.broadcast(k)).select((F.col("creator") % F.col("k") + 1).alias("mint"), "completed_at").join(born, "mint")
    done = finished.where(F.col("completed_at") >= F.col("born") + 1000 * DAY).groupBy("mint").agg(F.min("completed_at").alias("tc"))
    steps = launched.select("dev", F.col("born").alias("at"), F.lit(1).alias("up"), F.lit(0).alias("won")).unionByName(launched.where("completed").select("dev", F.col("completed_at").alias("at"), F.lit(0).alias("up"), F.lit(1).alias("won")))
    so_far = Window.partitionBy("dev").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    record = steps.groupBy("dev", "at").agg(F.sum("up").alias("up"), F.sum("won").alias("won")).select("dev", F.col("at").alias("born"), F.sum("up").over(so_far).alias("dev_launches"), F.sum("won").over(so_far).alias("dev_completions"))
    tokens = joins.asof_join(born, record, ["dev"], "born", ["dev_launches", "dev_completions"], strict=True).drop("born_right").fillna(0, ["dev_launches", "dev_completions"])
    tokens = tokens.join(done, "mint", "left").crossJoin(F.broadcast(last))
    s = tokens.withColumn("age", F.explode(F.array(*(F.lit(a).cast("long") for a in AGES)))).withColumn("t", F.col("born") + F.col("age") * DAY).withColumn("entered", F.col("t") + LATENCY * DAY)
    s = s.where((F.col("entered") + max(HORIZONS) * DAY <= F.col("last")) & (F.col("tc").isNull() | (F.col("tc") > F.col("t")))).drop("last")
    s = scratch.written(s, "snapshots")

    p = rows.join(s.select("mint", "age", "t", "dev", "born"), "mint").where("recv <= t")
    buy, since = F.col("buy"), lambda w: F.col("recv") > F.col("t") - w * DAY
    signed, own = F.when(buy, F.col("sol")).otherwise(-F.col("sol")), F.col("usr") == F.col("dev")
    parts = [x for w in WINDOWS for x in (F.count_if(buy & since(w)).alias(f"buys_{w}"), F.count_if(~buy & since(w)).alias(f"sells_{w}"), _sum(since(w), signed).alias(f"flow_{w}"))]
    wallets = p.groupBy("mint", "age", "t", "usr").agg(
        F.count("*").alias("n"), F.count_if(buy).alias("b"), F.max("recv").alias("seen"), F.max(F.when(buy, F.col("sol"))).alias("largest"), _sum(own & buy, "sol").alias("dev_in"), _sum(own & ~buy, "sol").alias("dev_out"),
        F.count_if(buy & ~own & (F.col("recv") < F.col("born") + 2 * DAY)).alias("launch_buys"), *parts,
    )
    sums = [x for w in WINDOWS for x in (F.sum(f"buys_{w}").alias(f"buys_{w}"), F.sum(f"sells_{w}").alias(f"sells_{w}"), F.round(F.sum(f"flow_{w}"), 2).alias(f"net_flow_{w}"), F.count_if(F.col(f"buys_{w}") > 0).alias(f"buyers_{w}"))]
    f = wallets.groupBy("mint", "age").agg(
        F.sum("n").alias("prints"), F.round((F.any_value("t") - F.max("seen")) / 1e6, 3).alias("idle_s"), *sums, F.count_if(F.col("b") > 0).alias("buyers"), F.coalesce(F.max("largest"), F.lit(0.0)).alias("largest_buy"),
        F.round(F.sum("dev_in"), 2).alias("dev_in"), F.round(F.sum("dev_out"), 2).alias("dev_out"), F.sum("launch_buys").alias("launch_buys"), F.round((F.sum("n") - F.sum("b")) / F.sum("n"), 6).alias("sell_share"),
    )

    read = _states(_asks(s, {"now": F.col("t"), "entry": F.col("entered")} | {f"ago_{w}": F.col("t") - w * DAY for w in RETURNS}), rows)
    of = lambda what, c: F.max(F.when(F.col("what") == what, c))
    px = F.col("vsol") / F.col("vtok")
    seen = read.groupBy("mint", "age").agg(of("now", px).alias("px"), of("now", F.col("vsol")).alias("vsol"), of("entry", F.col("vsol")).alias("vsol0"), of("entry", F.col("vtok")).alias("vtok0"), *(of(f"ago_{w}", px).alias(f"px_{w}") for w in RETURNS))
    e = scratch.written(s.join(seen, ["mint", "age"]), "entries")

    open_at = e.select("mint", "age", "entered", "tc", (F.col("vsol0") / F.col("vtok0")).alias("p0"))
    later = joins.range_join(open_at, rows.select("mint", "recv", "px"), ["mint"], "entered", "recv", 1, max(HOLDS) * DAY).where("tc IS NULL OR recv < tc")
    touch = lambda tp, sl: (F.col("px") >= (1 + tp) * F.col("p0")) | (F.col("px") <= (1 - sl) * F.col("p0"))
    hits = later.groupBy("mint", "age").agg(*(F.min(F.when(touch(tp, sl), F.col("recv"))).alias(f"hit_{i}") for i, (tp, sl) in enumerate(EXITS)))
    o = e.join(hits, ["mint", "age"], "left")
    bounded = lambda at: F.greatest(F.col("entered"), F.least(at, F.col("tc") - 1))
    end = lambda h: F.col("entered") + h * DAY
    times = {f"pnl_{h}": bounded(end(h)) for h in HORIZONS}
    times |= {n: bounded(F.when(F.col(f"hit_{i}") <= end(h), F.col(f"hit_{i}") + LATENCY * DAY).otherwise(end(h))) for n, i, h in _NAMES}
    out = _states(_asks(o, times), rows).withColumnsRenamed({"vsol": "vsol1", "vtok": "vtok1"}).join(e.select("mint", "age", "vsol0", "vtok0"), ["mint", "age"])
    net = F.round(C.round_trip(F.col("vsol0"), F.col("vtok0"), F.col("vsol1"), F.col("vtok1"), F.lit(SIZE), F.lit(FEE)), 6)
    results = out.groupBy("mint", "age").agg(*(of(n, net).alias(n) for n in times))
    every = e.join(f, ["mint", "age"]).join(results, ["mint", "age"])
    return every.select("mint", "age", "vsol", (F.col("px") * C.SUPPLY).alias("mcap"), *(c for c in f.columns if c not in ("mint", "age")), *(F.round(F.col("px") / F.col(f"px_{w}") - 1, 6).alias(f"ret_{w}") for w in RETURNS), "dev_launches", "dev_completions", F.col("tc").isNotNull().alias("completed"), *times)
