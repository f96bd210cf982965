"""Queries over the tape: trips, leaderboards, as-of and range joins, point-in-time features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import crowds, folds, joins, scratch, stats, sweeps, trips
from ..sources import tape
from ..sources.tape import DAY, LAUNCHES, SECOND, TAPE, TICKS
from .registry import Tables, query


def prints(t: Tables) -> DataFrame:
    return tape.prints(t("lineitem"), t("orders"))


_TRIPS_SQL = f"""WITH RECURSIVE {TAPE},
numbered AS (SELECT *, row_number() OVER (PARTITION BY usr, mint ORDER BY recv, seq) AS rn FROM tape),
fold AS (
  SELECT usr, mint, 0::BIGINT AS rn, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS peak, NULL::BIGINT AS opened, 0.0::DOUBLE AS sol_in, 0.0::DOUBLE AS sol_out, 0.0::DOUBLE AS bought, 0.0::DOUBLE AS sold, 0 AS nb, 0 AS ns,
    NULL::BIGINT AS c_opened, NULL::BIGINT AS c_closed, 0.0::DOUBLE AS c_in, 0.0::DOUBLE AS c_out, 0.0::DOUBLE AS c_bought, 0.0::DOUBLE AS c_sold, 0 AS c_nb, 0 AS c_ns
  FROM (SELECT DISTINCT usr, mint FROM tape)
  UNION ALL
  SELECT f.usr, f.mint, n.rn,
    CASE WHEN n.buy THEN f.pos + n.tok WHEN f.opened IS NULL THEN 0.0 WHEN f.pos - n.tok <= 0.01 * f.peak THEN 0.0 ELSE f.pos - n.tok END,
    CASE WHEN n.buy THEN greatest(f.peak, f.pos + n.tok) WHEN f.opened IS NULL OR f.pos - n.tok <= 0.01 * f.peak THEN 0.0 ELSE f.peak END,
    CASE WHEN n.buy THEN coalesce(f.opened, n.recv) WHEN f.opened IS NULL OR f.pos - n.tok <= 0.01 * f.peak THEN NULL ELSE f.opened END,
    CASE WHEN n.buy AND f.opened IS NULL THEN n.sol WHEN n.buy THEN f.sol_in + n.sol ELSE f.sol_in END,
    CASE WHEN n.buy AND f.opened IS NULL THEN 0.0 WHEN n.buy THEN f.sol_out ELSE f.sol_out + n.sol END,
    CASE WHEN n.buy AND f.opened IS NULL THEN n.tok WHEN n.buy THEN f.bought + n.tok ELSE f.bought END,
    CASE WHEN n.buy AND f.opened IS NULL THEN 0.0 WHEN n.buy THEN f.sold ELSE f.sold + n.tok END,
    CASE WHEN n.buy AND f.opened IS NULL THEN 1 WHEN n.buy THEN f.nb + 1 ELSE f.nb END,
    CASE WHEN n.buy AND f.opened IS NULL THEN 0 WHEN n.buy THEN f.ns ELSE f.ns + 1 END,
    CASE WHEN NOT n.buy AND f.opened IS NOT NULL AND f.pos - n.tok <= 0.01 * f.peak THEN f.opened END,
    n.recv, f.sol_in, f.sol_out + n.sol, f.bought, f.sold + n.tok, f.nb, f.ns + 1
  FROM fold f JOIN numbered n ON n.usr = f.usr AND n.mint = f.mint AND n.rn = f.rn + 1),
trips AS (
  SELECT usr, mint, c_opened AS opened, c_closed AS closed, c_in AS sol_in, c_out AS sol_out, c_bought AS bought, c_sold AS sold, c_nb AS n_buys, c_ns AS n_sells FROM fold WHERE c_opened IS NOT NULL
  UNION ALL
  SELECT usr, mint, opened, NULL, sol_in, sol_out, bought, sold, nb, ns FROM fold f WHERE opened IS NOT NULL AND rn = (SELECT max(rn) FROM numbered n WHERE n.usr = f.usr AND n.mint = f.mint))"""


@query("c1_round_trips", f"{_TRIPS_SQL} SELECT usr, mint, opened, closed, round(sol_in, 2) AS sol_in, round(sol_out, 2) AS sol_out, bought, sold, n_buys, n_sells FROM trips")
def c1_round_trips(t: Tables) -> DataFrame:
    rows = trips.round_trips(prints(t))
    return rows.withColumns({c: F.round(c, 2) for c in ("sol_in", "sol_out")})


_SUMMARY_SQL = """SELECT usr, count(*) AS trips, count(*) FILTER (closed IS NULL) AS open_trips, round(sum(sol_out - sol_in) FILTER (closed IS NOT NULL), 2) AS pnl,
  round(quantile_cont(sol_out - sol_in, 0.5) FILTER (closed IS NOT NULL), 4) AS median_pnl, round(avg(CASE WHEN sol_out - sol_in > 0 THEN 1.0 ELSE 0.0 END) FILTER (closed IS NOT NULL), 6) AS win_rate,
  round(quantile_cont((closed - opened) / 1e6, 0.5) FILTER (closed IS NOT NULL), 3) AS median_hold_s, round(sum(sol_in) FILTER (closed IS NOT NULL), 2) AS sol_in,
  round(max(sol_out - sol_in) FILTER (closed IS NOT NULL), 2) AS best, round(min(sol_out - sol_in) FILTER (closed IS NOT NULL), 2) AS worst FROM trips GROUP BY usr"""


@query(
    "a13_trip_summary",
    f"""{_TRIPS_SQL}, born AS (SELECT mint, min(born) AS born FROM (SELECT o_custkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS mint, epoch_us(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS born FROM orders) GROUP BY mint),
x AS (SELECT t.*, born, t.opened // {30 * DAY} - born // {30 * DAY} AS slots, closed IS NOT NULL AS c, sol_out - sol_in AS pnl, (SELECT arg_min(vsol / vtok, seq) FROM tape p WHERE p.usr = t.usr AND p.mint = t.mint AND p.recv = t.opened AND buy) AS entry FROM trips t LEFT JOIN born ON born.mint = t.mint)
SELECT usr, count(*) FILTER (c) AS closed_trips, count(*) FILTER (NOT c) AS open_trips, round(sum(pnl) FILTER (c), 2) AS pnl, round(avg((pnl > 0)::INT) FILTER (c), 6) AS win_rate, round(avg(pnl) FILTER (c AND pnl > 0), 7) AS avg_win, round(avg(pnl) FILTER (c AND pnl <= 0), 7) AS avg_loss,
 round(CASE WHEN sum(-pnl) FILTER (c AND pnl <= 0) > 0 THEN coalesce(sum(pnl) FILTER (c AND pnl > 0), 0) / sum(-pnl) FILTER (c AND pnl <= 0) END, 6) AS profit_factor, round(quantile_cont((closed - opened) / 1e6, 0.5) FILTER (c), 3) AS median_hold_s, round(quantile_cont(sol_in, 0.5) FILTER (c), 4) AS median_size,
 round(quantile_cont(entry, 0.5) FILTER (c), 6) AS median_entry, round(quantile_cont((opened - born) / 1e6, 0.5) FILTER (c), 3) AS median_age_s, round(avg((n_buys > 1)::INT) FILTER (c), 6) AS share_multi_buy, round(avg((n_sells > 1)::INT) FILTER (c), 6) AS share_multi_sell,
 round(CASE WHEN sum(pnl) FILTER (c) > 0 THEN max(pnl) FILTER (c) / sum(pnl) FILTER (c) END, 6) AS best_share, round(avg(coalesce(slots = 0, false)::INT) FILTER (c), 6) AS share_first_slot, round(avg(coalesce(slots <= 5, false)::INT) FILTER (c), 6) AS share_near_slots,
 round(coalesce(sum(pnl) FILTER (c AND slots = 0), 0), 2) AS pnl_first_slot, round(avg((slots IS NOT NULL)::INT) FILTER (c), 6) AS share_known FROM x GROUP BY usr""",
)
def a13_trip_summary(t: Tables) -> DataFrame:
    """The full summary of every wallet. A token's creation is its first launch, its slots are months."""
    n = t("supplier").agg(F.max("s_suppkey").alias("k"))  # one row
    born = t("orders").crossJoin(F.broadcast(n)).groupBy((F.col("o_custkey") % F.col("k") + 1).alias("mint")).agg(F.min(tape.day_of(F.col("o_orderdate"))).alias("born"))
    rows = prints(t).withColumn("px", F.col("vsol") / F.col("vtok"))
    return trips.wallet_summary(trips.round_trips(rows, keep="px"), born, 30 * DAY, 5)


@query("a14_leaderboard", f"{_TRIPS_SQL} SELECT * FROM ({_SUMMARY_SQL}) WHERE trips - open_trips >= 3 ORDER BY pnl DESC, usr")
def a14_leaderboard(t: Tables) -> DataFrame:
    """Quarantine, trips, summary, leaderboard: the flagship query."""
    plausible = prints(t).where("sol > 0 AND tok > 0 AND recv IS NOT NULL")
    return trips.leaderboard(trips.summarize(trips.round_trips(plausible)), 3)


_PNL = "(SELECT usr AS grp, opened AS born, mint, sol_out - sol_in AS pnl FROM trips WHERE closed IS NOT NULL)"


def _pnl(t: Tables) -> DataFrame:
    closed = trips.round_trips(prints(t)).where("closed IS NOT NULL")
    return closed.select(F.col("usr").alias("grp"), F.col("opened").alias("born"), "mint", (F.col("sol_out") - F.col("sol_in")).alias("pnl"))


@query(
    "a11_performance",
    f"""{_TRIPS_SQL}, p AS {_PNL}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pnl DESC, born, mint) AS r, count(*) OVER (PARTITION BY grp) AS c, sum(pnl) OVER (PARTITION BY grp ORDER BY born, mint ROWS UNBOUNDED PRECEDING) AS cum FROM p),
d AS (SELECT grp, max(greatest(peak, 0) - cum) AS dd FROM (SELECT grp, cum, max(cum) OVER (PARTITION BY grp ORDER BY born, mint ROWS UNBOUNDED PRECEDING) AS peak FROM r) GROUP BY grp)
SELECT r.grp, count(*) AS n, round(sum(pnl), 2) AS total, round(avg(pnl), 7) AS mean, round(quantile_cont(pnl, 0.5), 4) AS median, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate,
  round(avg(pnl) FILTER (pnl > 0), 7) AS avg_win, round(avg(pnl) FILTER (pnl < 0), 7) AS avg_loss, round(sum(pnl) FILTER (pnl > 0) / abs(nullif(sum(pnl) FILTER (pnl < 0), 0)), 4) AS profit_factor,
  round(sum(CASE WHEN r > 1 THEN pnl ELSE 0 END), 2) AS without_best, round(sum(CASE WHEN r > greatest(1, CAST(round_even(c * 0.05, 0) AS INT)) THEN pnl ELSE 0 END), 2) AS without_top, round(any_value(dd), 2) AS max_drawdown
FROM r JOIN d ON d.grp = r.grp GROUP BY r.grp""",
)
def a11_performance(t: Tables) -> DataFrame:
    return trips.performance(_pnl(t), "grp", ["born", "mint"])


@query(
    "a12_verdict",
    f"""{_TRIPS_SQL}, p AS {_PNL}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pnl DESC) AS r FROM p),
s AS (SELECT grp, count(*) AS n, sum(pnl) AS net, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) AS won, -sum(CASE WHEN pnl <= 0 THEN pnl ELSE 0 END) AS lost, sum(CASE WHEN r > 3 THEN pnl ELSE 0 END) AS rest FROM r GROUP BY grp)
SELECT grp, n, round(net, 2) AS net, round(CASE WHEN lost > 0 THEN won / lost END, 4) AS profit_factor, round(rest, 2) AS without_best, n >= 50 AND net > 0 AND won > 1.2 * lost AND rest > 0 AS passes FROM s""",
)
def a12_verdict(t: Tables) -> DataFrame:
    return trips.verdict(_pnl(t), "grp")


@query(
    "w10_drawdown",
    f"""{_TRIPS_SQL}, p AS {_PNL}, r AS (SELECT grp, sum(pnl) OVER w AS cum, born, mint FROM p WINDOW w AS (PARTITION BY grp ORDER BY born, mint ROWS UNBOUNDED PRECEDING))
SELECT grp, round(max(greatest(peak, 0) - cum), 2) AS max_drawdown FROM (SELECT grp, cum, max(cum) OVER (PARTITION BY grp ORDER BY born, mint ROWS UNBOUNDED PRECEDING) AS peak FROM r) GROUP BY grp""",
)
def w10_drawdown(t: Tables) -> DataFrame:
    return trips.max_drawdown(_pnl(t), ["grp"], ["born", "mint"]).select("grp", F.round("max_drawdown", 2).alias("max_drawdown"))


@query(
    "a15_positions",
    f"""WITH {TAPE}, p AS (SELECT usr, mint, sum(CASE WHEN buy THEN tok ELSE 0 END) AS bought, sum(CASE WHEN NOT buy THEN tok ELSE 0 END) AS sold, sum(CASE WHEN buy THEN -sol ELSE sol END) AS net, count(*) AS n FROM tape GROUP BY ALL)
SELECT usr, mint, bought, sold, n, bought > 0 AND sold >= 0.99 * bought AS closed, round(net * (1 - 0.0125) - 0.001 * n, 7) AS pnl FROM p WHERE usr <> mint""",
)
def a15_positions(t: Tables) -> DataFrame:
    s = lambda c, x: F.sum(F.when(c, x).otherwise(0.0))
    p = prints(t).groupBy("usr", "mint").agg(s(F.col("buy"), F.col("tok")).alias("bought"), s(~F.col("buy"), F.col("tok")).alias("sold"), F.sum(F.when(F.col("buy"), -F.col("sol")).otherwise(F.col("sol"))).alias("net"), F.count("*").alias("n"))
    closed = (F.col("bought") > 0) & (F.col("sold") >= 0.99 * F.col("bought"))
    return p.where("usr <> mint").select("usr", "mint", "bought", "sold", "n", closed.alias("closed"), F.round(F.col("net") * (1 - 0.0125) - 0.001 * F.col("n"), 7).alias("pnl"))


_HALVES = f"""WITH {TAPE}, p AS (SELECT usr, mint, sum(CASE WHEN buy THEN -sol ELSE sol END) AS pnl, min(recv) AS first FROM tape GROUP BY ALL), h AS (SELECT *, CASE WHEN first < 852076800000000 THEN 1 ELSE 2 END AS half FROM p)"""


def _halves(t: Tables) -> DataFrame:
    p = prints(t).groupBy("usr", "mint").agg(F.sum(F.when(F.col("buy"), -F.col("sol")).otherwise(F.col("sol"))).alias("pnl"), F.min("recv").alias("first"))
    return p.withColumn("half", F.when(F.col("first") < 852_076_800_000_000, 1).otherwise(2))


@query(
    "a16_split_half",
    f"""{_HALVES} SELECT usr, count(*) FILTER (half = 1) AS n1, count(*) FILTER (half = 2) AS n2, round(sum(pnl) FILTER (half = 1), 2) AS pnl1, round(sum(pnl) FILTER (half = 2), 2) AS pnl2,
round(quantile_cont(pnl, 0.5) FILTER (half = 1), 4) AS median1, round(quantile_cont(pnl, 0.5) FILTER (half = 2), 4) AS median2, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM h GROUP BY usr""",
)
def a16_split_half(t: Tables) -> DataFrame:
    one, two, x = F.col("half") == 1, F.col("half") == 2, F.col("pnl")
    of = lambda c: F.when(c, x)
    return _halves(t).groupBy("usr").agg(F.count_if(one).alias("n1"), F.count_if(two).alias("n2"), F.round(F.sum(of(one)), 2).alias("pnl1"), F.round(F.sum(of(two)), 2).alias("pnl2"), F.round(F.percentile(of(one), 0.5), 4).alias("median1"), F.round(F.percentile(of(two), 0.5), 4).alias("median2"), F.round(F.avg((x > 0).cast("double")), 6).alias("win_rate"))


@query(
    "a17_persistence",
    f"""{_HALVES}, w AS (SELECT usr, sum(pnl) FILTER (half = 1) > 0 AS p1, sum(pnl) FILTER (half = 2) > 0 AS p2 FROM h GROUP BY usr HAVING count(*) FILTER (half = 1) > 0 AND count(*) FILTER (half = 2) > 0)
SELECT count(*) AS n, count(*) FILTER (p1) AS first, count(*) FILTER (p2) AS second, count(*) FILTER (p1 AND p2) AS both, round(count(*) FILTER (p1) * count(*) FILTER (p2) / nullif(count(*), 0), 4) AS expected FROM w""",
)
def a17_persistence(t: Tables) -> DataFrame:
    one, two = F.col("half") == 1, F.col("half") == 2
    w = _halves(t).groupBy("usr").agg((F.sum(F.when(one, F.col("pnl"))) > 0).alias("p1"), (F.sum(F.when(two, F.col("pnl"))) > 0).alias("p2"), F.count_if(one).alias("n1"), F.count_if(two).alias("n2")).where("n1 > 0 AND n2 > 0")
    return w.agg(F.count("*").alias("n"), F.count_if("p1").alias("first"), F.count_if("p2").alias("second"), F.count_if(F.col("p1") & F.col("p2")).alias("both"), F.round(F.count_if("p1") * F.count_if("p2") / F.nullif(F.count("*"), F.lit(0)), 4).alias("expected"))


@query("s24_bounded_tape", f"WITH {TAPE} SELECT * FROM tape WHERE recv >= 788918400000000 - 3600000000 AND recv < 820454400000000")
def s24_bounded_tape(t: Tables) -> DataFrame:
    """Rows in [start - 1 h, end): later data does not exist for what follows."""
    return prints(t).where(F.col("recv").between(788_918_400_000_000 - 3600 * SECOND, 820_454_400_000_000 - 1))


@query("s4_quarantine", f"WITH {TAPE} SELECT mint, seq, CASE WHEN coalesce(sol > 2000 AND tok < 45 AND discount IS NOT NULL, false) THEN 'kept' ELSE 'rejected' END AS target FROM tape")
def s4_quarantine(t: Tables) -> DataFrame:
    """Implausible rows, unknown ones included, go to a table of their own: the complement is null-safe."""
    ok = F.coalesce(F.expr("sol > 2000 AND tok < 45 AND discount IS NOT NULL"), F.lit(False))
    return prints(t).select("mint", "seq", F.when(ok, "kept").otherwise("rejected").alias("target"))


@query("s3_route_events", "SELECT event_id, event_type AS target, CASE WHEN event_type = 'purchase' THEN value END AS amount FROM events WHERE event_type IN ('click', 'view', 'purchase') AND value <> 0")
def s3_route_events(t: Tables) -> DataFrame:
    """One scan, a projection for each kind of event, rows without a truthy value dropped."""
    rows = t("events").where("value <> 0")
    kinds = [rows.where(F.col("event_type") == k).select("event_id", F.lit(k).alias("target"), (F.col("value") if k == "purchase" else F.lit(None).cast("double")).alias("amount")) for k in ("click", "view", "purchase")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


_LAST = f"WITH {TAPE}, {LAUNCHES}"


@query(
    "j2_asof_backward",
    f"""{_LAST}, a AS (SELECT launch, creator % (SELECT max(s_suppkey) FROM supplier) + 1 AS mint, born FROM launches)
SELECT launch, mint, born, (SELECT max(recv) FROM tape p WHERE p.mint = a.mint AND p.recv <= a.born) AS born_right,
 (SELECT arg_max(sol, (recv, seq)) FROM tape p WHERE p.mint = a.mint AND p.recv <= a.born) AS sol FROM a""",
)
def j2_asof_backward(t: Tables) -> DataFrame:
    """For every launch the last print of a token at or before it; null before the first."""
    n = t("supplier").agg(F.max("s_suppkey").alias("n"))
    asked = tape.launches(t("orders")).crossJoin(F.broadcast(n)).select("launch", (F.col("creator") % F.col("n") + 1).alias("mint"), "born")
    return joins.asof_join(asked, prints(t).withColumnRenamed("recv", "born"), ["mint"], "born", ["sol"], order=["seq"], block=200 * DAY)


@query(
    "j3_asof_forward",
    f"""{_LAST}, a AS (SELECT launch, creator % (SELECT max(s_suppkey) FROM supplier) + 1 AS mint, born + 400000 AS born FROM launches)
SELECT launch, mint, born, (SELECT min(recv) FROM tape p WHERE p.mint = a.mint AND p.recv >= a.born) AS born_right,
 (SELECT arg_min(sol, (recv, seq)) FROM tape p WHERE p.mint = a.mint AND p.recv >= a.born) AS sol FROM a""",
)
def j3_asof_forward(t: Tables) -> DataFrame:
    """The first print at or after a launch and a latency of 400 ms."""
    n = t("supplier").agg(F.max("s_suppkey").alias("n"))
    asked = tape.launches(t("orders")).crossJoin(F.broadcast(n)).select("launch", (F.col("creator") % F.col("n") + 1).alias("mint"), (F.col("born") + 400_000).alias("born"))
    return joins.asof_join(asked, prints(t).withColumnRenamed("recv", "born"), ["mint"], "born", ["sol"], forward=True, order=["seq"], block=200 * DAY)


@query(
    "j4_conservative_fill",
    f"""WITH {TICKS}, a AS (SELECT event_id, key, t + 1 AS t FROM ticks WHERE event_type = 'click'),
b AS (SELECT a.event_id, a.key, (SELECT arg_max(value, (q.t, q.event_id)) FROM ticks q WHERE q.key = a.key AND q.t <= a.t) AS before,
 (SELECT arg_min(value, (q.t, q.event_id)) FROM ticks q WHERE q.key = a.key AND q.t >= a.t AND q.t <= a.t + 3600000000) AS after FROM a)
SELECT event_id, key, greatest(before, coalesce(after, before)) AS buy_fill, least(before, coalesce(after, before)) AS sell_fill FROM b""",
)
def j4_conservative_fill(t: Tables) -> DataFrame:
    """The worse, for our side, of the last state before and the next within an hour."""
    ticks = tape.ticks(t("events"))
    asked = ticks.where("event_type = 'click'").select("event_id", "key", (F.col("t") + 1).alias("t"))
    states = ticks.select("key", "t", "value", F.col("event_id").alias("order"))
    both = joins.asof_join(asked, states, ["key"], "t", ["value"], order=["order"], block=7 * DAY).withColumnRenamed("value", "before").drop("t_right")
    both = joins.asof_join(both, states, ["key"], "t", ["value"], forward=True, tolerance=3600 * SECOND, order=["order"], block=7 * DAY)
    after = F.coalesce("value", "before")
    return both.select("event_id", "key", F.greatest("before", after).alias("buy_fill"), F.least("before", after).alias("sell_fill"))


_PEERS = f"""WITH {TAPE}, picks AS (SELECT mint, usr, recv, seq, sol FROM tape WHERE buy),
peers AS (SELECT p.seq, p.recv, p.mint, p.sol, q.mint AS peer, q.recv AS q_recv, q.seq AS q_seq, q.sol AS q_sol FROM picks p JOIN tape q ON q.recv > p.recv - 3600000000 AND q.recv < p.recv AND q.mint <> p.mint AND q.sol BETWEEN p.sol * 0.5 AND p.sol * 1.5)"""


def _asking(t: Tables, rows: DataFrame | None = None) -> DataFrame:
    """All prints; buys ask."""
    return (prints(t) if rows is None else rows).select(F.col("mint").alias("key"), F.col("recv").alias("t"), "seq", F.col("sol").alias("size"), F.coalesce("buy", F.lit(False)).alias("ask"))


@query("j5_range_candidates", f"{_PEERS} SELECT seq, count(*) AS candidates, count(DISTINCT peer) AS peers, round(avg(q_sol), 8) AS mean_sol FROM peers GROUP BY seq")
def j5_range_candidates(t: Tables) -> DataFrame:
    """Prints of other tokens in the hour before a pick and within half of its size: counted, not paired."""
    n = crowds.peer_counts(_asking(t), 3600 * SECOND, 0.5, 1.5)
    return n.select("seq", F.col("n").alias("candidates"), F.col("keys").alias("peers"), F.round(F.col("total") / F.col("n"), 8).alias("mean_sol"))


@query(
    "c4_matched_controls",
    f"{_PEERS}, one AS (SELECT seq, peer, max(q_recv) AS q_recv FROM peers GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY (peer * 7919 + seq * 104729) % 1000003, peer) AS r FROM one) SELECT seq, peer, q_recv FROM r WHERE r <= 3",
)
def c4_matched_controls(t: Tables) -> DataFrame:
    """Three control entries per pick, drawn by a keyed order of its candidates."""
    return drawn_controls(t).select("seq", "peer", F.col("at").alias("q_recv"))


#: What the order of a draw multiplies keys and questions by.
DRAW = (7_919, 104_729)


def drawn_controls(t: Tables) -> DataFrame:
    """Of every pick up to three tokens of the hour before (``peer``, last print ``at``) with the pick's time ``t``."""
    return crowds.peer_draws(_asking(t), 3600 * SECOND, 0.5, 1.5, 3, DRAW)


@query(
    "c3_event_study",
    f"""{_TRIPS_SQL}, e AS (SELECT DISTINCT usr, mint, opened FROM trips),
w AS (SELECT e.usr, e.mint, e.opened, p.recv - e.opened AS d, p.seq, CASE WHEN p.buy THEN p.sol ELSE -p.sol END AS flow, p.vsol / p.vtok AS px FROM e JOIN tape p ON p.mint = e.mint AND p.usr <> e.usr AND p.recv BETWEEN e.opened - 2592000000000 AND e.opened + 2592000000000)
SELECT usr, mint, opened, round(coalesce(sum(flow) FILTER (d < 0), 0), 2) AS flow_before, round(coalesce(sum(flow) FILTER (d >= 0 AND d <= 604800000000), 0), 2) AS flow_week, round(coalesce(sum(flow) FILTER (d >= 0), 0), 2) AS flow_month,
 round(arg_max(px, (d, seq)) FILTER (d <= 604800000000) / arg_max(px, (d, seq)) FILTER (d < 0) - 1, 6) AS ret_week, round(arg_max(px, (d, seq)) / arg_max(px, (d, seq)) FILTER (d < 0) - 1, 6) AS ret_month FROM w GROUP BY usr, mint, opened""",
)
def c3_event_study(t: Tables) -> DataFrame:
    """Others' net flow around entries and the return from the price before them at two horizons.

    The tape is written once. Entries stand in one line with the prints of their token, a row each: flows are differences of running
    sums at the ends of the windows, those of all prints less those of the wallet's own. The price is that of the last print, or where
    that is the wallet's own, of the last one by another wallet before it: one shuffle by token, no pairs.
    """
    month, week = 30 * DAY, 7 * DAY
    rows = scratch.written(prints(t).select("mint", "usr", "recv", "seq", "buy", "sol", "tok", "vsol", "vtok"), "tape")
    flow = F.when(F.col("buy"), F.col("sol")).otherwise(-F.col("sol"))
    none = lambda kind: F.lit(None).cast(kind)
    seen = rows.select("mint", "usr", F.col("recv").alias("at"), "seq", flow.alias("flow"), F.lit(1).alias("one"), (F.col("vsol") / F.col("vtok")).alias("px"))
    entries = trips.round_trips(rows).select("mint", "usr", F.col("opened").alias("at")).distinct()
    line = seen.unionByName(entries.select("mint", "usr", "at", none("long").alias("seq"), F.lit(0.0).alias("flow"), F.lit(0).alias("one"), none("double").alias("px"))).repartition("mint")
    # frames that end at a distance from the row; the row's own time is in those that end at 0 or later
    ends = {"start": -month - 1, "before": -1, "week": week, "month": month}
    of_token, own = Window.partitionBy("mint").orderBy("at"), Window.partitionBy("mint", "usr").orderBy("at")
    up_to = lambda w, k: w.rangeBetween(Window.unboundedPreceding, ends[k])
    line = line.select("*", *(F.sum(c).over(up_to(own, k)).alias(f"own_{c}_{k}") for c in ("flow", "one") for k in ends))
    is_print = F.col("one") == 1
    now = F.when(is_print, F.struct("usr", "at", "px"))
    run = Window.partitionBy("mint").orderBy("at", "seq")
    line = line.withColumn("prev", F.last(now, ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1)))
    line = line.withColumn("other", F.last(F.when(is_print & (F.col("prev.usr") != F.col("usr")), F.col("prev")), ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by(F.struct("usr", "at", "px", "other"), F.when(is_print, F.struct("at", "seq")))
    line = line.select("*", *(F.sum(c).over(up_to(of_token, k)).alias(f"{c}_{k}") for c in ("flow", "one") for k in ends), *(last.over(up_to(of_token, k)).alias(f"last_{k}") for k in ends if k != "start"))
    total = lambda c, a, b: sum(sign * (F.coalesce(f"{c}_{k}", F.lit(0)) - F.coalesce(f"own_{c}_{k}", F.lit(0))) for sign, k in ((1, b), (-1, a)))

    def price(k: str):
        by_other = F.when(F.col(f"last_{k}.usr") != F.col("usr"), F.struct(F.col(f"last_{k}.at").alias("at"), F.col(f"last_{k}.px").alias("px"))).otherwise(F.struct(F.col(f"last_{k}.other.at").alias("at"), F.col(f"last_{k}.other.px").alias("px")))
        return F.when(by_other["at"] >= F.col("at") - month, by_other["px"])

    w = line.where(~is_print & (total("one", "start", "month") > 0))
    ret = lambda k: F.round(price(k) / price("before") - 1, 6)
    return w.select("usr", "mint", F.col("at").alias("opened"), *(F.round(total("flow", a, b), 2).alias(f"flow_{n}") for n, a, b in (("before", "start", "before"), ("week", "before", "week"), ("month", "before", "month"))), ret("week").alias("ret_week"), ret("month").alias("ret_month"))


@query(
    "c6_choice_sets",
    f"""WITH {TAPE}, picks AS (SELECT seq AS pick, mint AS picked, recv - 1000000 AS t FROM tape WHERE buy),
w AS (SELECT k.pick, p.mint, count(*) AS prints, round(sum(p.sol), 2) AS volume, bool_or(p.mint = k.picked) AS is_pick FROM picks k JOIN tape p ON p.recv >= k.t - 21600000000 AND p.recv < k.t GROUP BY ALL)
SELECT * FROM (SELECT *, bool_or(is_pick) OVER (PARTITION BY pick) AS has FROM w) WHERE has""",
)
def c6_choice_sets(t: Tables) -> DataFrame:
    """The picked token and all alternatives active before each entry, a second apart; entries without activity dropped.

    The pairs are the result, so they grow with the square of a six hours' prints; they are made one entry at a time and not shuffled.
    Prints move as packs, both to their orders and to their block of time.
    """
    rows = tape.packed_prints(t("lineitem"), t("orders"), ["mint", "recv", "seq", "sol", "buy"])
    sets = crowds.choice_sets(_asking(t, rows), 6 * 3600 * SECOND, SECOND)
    return sets.select(F.col("seq").alias("pick"), F.col("key").alias("mint"), F.col("n").alias("prints"), F.round("total", 2).alias("volume"), F.col("own").alias("is_pick"), F.lit(True).alias("has"))


@query("f6_top_holders", f"WITH {TAPE}, b AS (SELECT mint, usr, sum(CASE WHEN buy THEN tok ELSE -tok END) AS pos FROM tape GROUP BY ALL) SELECT mint, usr, pos, r FROM (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY pos DESC, usr) AS r FROM b) WHERE r <= 10")
def f6_top_holders(t: Tables) -> DataFrame:
    b = prints(t).groupBy("mint", "usr").agg(F.sum(F.when(F.col("buy"), F.col("tok")).otherwise(-F.col("tok"))).alias("pos"))
    return b.withColumn("r", F.row_number().over(Window.partitionBy("mint").orderBy(F.col("pos").desc(), "usr"))).where("r <= 10")


@query(
    "w3_kth_member",
    f"WITH {TAPE}, e AS (SELECT mint, usr, min(recv) AS born FROM tape WHERE buy AND usr % 3 = 0 GROUP BY ALL) SELECT mint, usr, born FROM (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY born, usr) AS r FROM e) WHERE r = 3",
)
def w3_kth_member(t: Tables) -> DataFrame:
    """When the third member of a tracked set first bought."""
    e = prints(t).where("buy AND usr % 3 = 0").groupBy("mint", "usr").agg(F.min("recv").alias("born"))
    return e.withColumn("r", F.row_number().over(Window.partitionBy("mint").orderBy("born", "usr"))).where("r = 3").drop("r")


@query("w24_first_seen", f"WITH {TAPE} SELECT seq, usr, (recv - min(recv) OVER (PARTITION BY usr)) / 1000000 AS age_s, recv - min(recv) OVER (PARTITION BY usr) >= 86400000000 AS aged FROM tape")
def w24_first_seen(t: Tables) -> DataFrame:
    age = F.col("recv") - F.min("recv").over(Window.partitionBy("usr"))
    return prints(t).select("seq", "usr", (age / 1_000_000).alias("age_s"), (age >= DAY).alias("aged"))


@query(
    "w23_wash_flags",
    f"""WITH {TAPE}, m AS (SELECT mint, usr, recv, buy, max(CASE WHEN NOT buy THEN recv END) OVER w AS last_sell, max(CASE WHEN buy THEN recv END) OVER w AS last_buy FROM tape WINDOW w AS (PARTITION BY mint, usr ORDER BY recv, seq ROWS UNBOUNDED PRECEDING))
SELECT mint, usr, min(recv) FILTER (recv - CASE WHEN buy THEN last_sell ELSE last_buy END <= 604800000000) AS flagged_at FROM m GROUP BY ALL""",
)
def w23_wash_flags(t: Tables) -> DataFrame:
    """When a wallet first had a buy and a sell of a token within a week; null if never."""
    w = Window.partitionBy("mint", "usr").orderBy("recv", "seq").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(F.when(c, F.col("recv")), ignorenulls=True).over(w)
    other = F.when(F.col("buy"), last(~F.col("buy"))).otherwise(last(F.col("buy")))
    return prints(t).withColumn("other", other).groupBy("mint", "usr").agg(F.min(F.when(F.col("recv") - F.col("other") <= 7 * DAY, F.col("recv"))).alias("flagged_at"))


@query(
    "w11_buyers_since_sell",
    f"""WITH {TAPE}, g AS (SELECT *, sum(CASE WHEN buy THEN 0 ELSE 1 END) OVER (PARTITION BY mint ORDER BY recv, seq ROWS UNBOUNDED PRECEDING) AS run FROM tape)
SELECT seq, mint, (SELECT count(DISTINCT h.usr) FROM g h WHERE h.mint = g.mint AND h.run = g.run AND h.buy AND (h.recv, h.seq) <= (g.recv, g.seq)) AS streak FROM g""",
)
def w11_buyers_since_sell(t: Tables) -> DataFrame:
    """Distinct buyers since the last sell: a wallet counts at its first buy of the run."""
    order = Window.partitionBy("mint").orderBy("recv", "seq").rowsBetween(Window.unboundedPreceding, 0)
    g = prints(t).withColumn("run", F.sum(F.when(F.col("buy"), 0).otherwise(1)).over(order))
    first = F.row_number().over(Window.partitionBy("mint", "run", "usr", "buy").orderBy("recv", "seq")) == 1
    run = Window.partitionBy("mint", "run").orderBy("recv", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("new", (first & F.col("buy")).cast("long")).withColumn("streak", F.sum("new").over(run)).select("seq", "mint", "streak")


@query(
    "w5_track_record",
    f"""WITH {LAUNCHES} SELECT launch, creator, (SELECT count(*) FROM launches b WHERE b.creator = a.creator AND b.born < a.born) AS earlier,
 (SELECT count(*) FROM launches b WHERE b.creator = a.creator AND b.completed_at < a.born) AS completed_before FROM launches a""",
)
def w5_track_record(t: Tables) -> DataFrame:
    """Earlier launches of a creator and how many had completed before this one: launches and completions on one timeline."""
    rows = tape.launches(t("orders"))
    line = rows.select("creator", "born", "launch", F.lit(1).alias("l"), F.lit(0).alias("c")).union(rows.where("completed").select("creator", F.col("completed_at").alias("born"), F.lit(None).cast("long").alias("launch"), F.lit(0).alias("l"), F.lit(1).alias("c")))
    before = Window.partitionBy("creator").orderBy("born").rangeBetween(Window.unboundedPreceding, -1)
    n = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    return line.select("launch", "creator", n("l").alias("earlier"), n("c").alias("completed_before")).where("launch IS NOT NULL")


@query(
    "w28_copycat",
    f"WITH {LAUNCHES} SELECT launch, kind, coalesce(born - f <= 21600000000 AND born > f, false) AS copycat FROM (SELECT *, min(born) OVER (PARTITION BY kind) AS f FROM launches)",
)
def w28_copycat(t: Tables) -> DataFrame:
    """The same name was first seen within the six hours before."""
    rows = tape.launches(t("orders")).select("launch", "kind", "born")
    first = rows.groupBy("kind").agg(F.min("born").alias("first"))
    late = F.col("born") - F.col("first")
    return rows.join(first, "kind").select("launch", "kind", ((late <= 6 * 3600 * SECOND) & (late > 0)).alias("copycat"))


@query("w4_ordinal", f"WITH {LAUNCHES} SELECT launch, creator, row_number() OVER (PARTITION BY creator ORDER BY born, launch) - 1 AS ordinal FROM launches")
def w4_ordinal(t: Tables) -> DataFrame:
    return tape.launches(t("orders")).select("launch", "creator", (F.row_number().over(Window.partitionBy("creator").orderBy("born", "launch")) - 1).cast("long").alias("ordinal"))


_FIRST = "(PARTITION BY key ORDER BY t, event_id"


@query(
    "w13_window_flow",
    f"""WITH {TICKS} SELECT event_id, key, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS volume, count(*) FILTER (event_type = 'click') OVER w AS clicks FROM ticks
WINDOW w AS (PARTITION BY key ORDER BY t RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)""",
)
def w13_window_flow(t: Tables) -> DataFrame:
    """Counts and sums in (t - 1 h, t]: the half-open bound is one microsecond."""
    w = Window.partitionBy("key").orderBy("t").rangeBetween(-3600 * SECOND + 1, 0)
    return tape.ticks(t("events")).select("event_id", "key", F.count("*").over(w).alias("n"), F.round(F.sum("value").over(w), 4).alias("volume"), F.sum((F.col("event_type") == "click").cast("long")).over(w).alias("clicks"))


@query(
    "w14_velocity",
    f"""WITH {TICKS} SELECT event_id, round(count(*) OVER a / 3600.0, 6) AS velocity, count(*) OVER a - count(*) OVER b AS acceleration FROM ticks
WINDOW a AS (PARTITION BY key ORDER BY t RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW), b AS (PARTITION BY key ORDER BY t RANGE BETWEEN 7199999999 PRECEDING AND 3600000000 PRECEDING)""",
)
def w14_velocity(t: Tables) -> DataFrame:
    w = Window.partitionBy("key").orderBy("t")
    now, before = w.rangeBetween(-3600 * SECOND + 1, 0), w.rangeBetween(-7200 * SECOND + 1, -3600 * SECOND)
    return tape.ticks(t("events")).select("event_id", F.round(F.count("*").over(now) / 3600.0, 6).alias("velocity"), (F.count("*").over(now) - F.count("*").over(before)).alias("acceleration"))


@query(
    "w12_distinct_in_window",
    f"""WITH {TAPE} SELECT a.seq, (SELECT count(DISTINCT b.usr) FROM tape b WHERE a.mint = b.mint AND b.recv > a.recv - 864000000000 AND b.recv <= a.recv) AS users FROM tape a""",
)
def w12_distinct_in_window(t: Tables) -> DataFrame:
    """Distinct users of a token in the ten days up to every print.

    A user counts from a print until ten days after or until his next print, whichever is first: one more at the print, one
    less at that end, and a running sum of both.
    """
    rows = prints(t).select("mint", "usr", "recv", "seq").repartition("mint")
    following = F.lead("recv").over(Window.partitionBy("mint", "usr").orderBy("recv", "seq"))
    rows = rows.withColumn("until", F.least(following, F.col("recv") + 10 * DAY))
    ends = F.array(F.struct(F.col("recv").alias("at"), F.lit(1).alias("step"), F.col("seq").alias("print")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("step"), F.lit(None).cast("long").alias("print")))
    line = rows.select("mint", F.inline(ends))
    run = Window.partitionBy("mint").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    return line.withColumn("users", F.sum("step").over(run)).where("print IS NOT NULL").select(F.col("print").alias("seq"), "users")


_CRASHES = f"""n AS (SELECT mint, usr, recv, seq, buy, sol, vsol / vtok AS px, row_number() OVER (PARTITION BY mint ORDER BY recv, seq) AS i FROM tape),
hi AS (SELECT a.mint, a.i, max((b.px, b.i)) AS h FROM n a JOIN n b ON b.mint = a.mint AND b.recv >= a.recv - 5184000000000 AND b.i <= a.i WHERE NOT a.buy GROUP BY a.mint, a.i),
c AS (SELECT n.*, h[1] AS top_px, h[2] AS hi_at FROM n JOIN hi ON hi.mint = n.mint AND hi.i = n.i WHERE px <= 0.1 * h[1]),
s AS (SELECT c.mint, c.i, b.usr, sum(round(b.sol * 1000000000)::HUGEINT) AS sold FROM c JOIN n b ON b.mint = c.mint AND b.i > c.hi_at AND b.i <= c.i AND NOT b.buy GROUP BY ALL),
top AS (SELECT mint, i, usr AS top, sold / 1e9 AS top_sold FROM (SELECT *, row_number() OVER (PARTITION BY mint, i ORDER BY sold DESC, usr) AS r FROM s) WHERE r = 1),
crash AS (SELECT c.mint, c.recv, c.seq, 1 - c.px / top_px AS fall, c.recv - h.recv AS since, top, top_sold,
 (SELECT count(DISTINCT q.usr) FROM n q WHERE q.mint = c.mint AND q.buy AND q.i > c.i AND q.recv <= c.recv + 864000000000) AS buyers
 FROM c JOIN top ON top.mint = c.mint AND top.i = c.i JOIN n h ON h.mint = c.mint AND h.i = c.hi_at)"""


def crashes(t: Tables) -> DataFrame:
    """Sells at a tenth or less of the high of sixty days, with the top seller since and the buyers of the ten days after."""
    rows = prints(t).withColumn("px", F.col("vsol") / F.col("vtok"))
    return sweeps.crashes(rows, "mint", "recv", ["seq"], "px", "usr", "buy", "sol", 60 * DAY, 0.9, 10 * DAY, 360 * DAY)


@query(
    "w21_crash_trigger",
    f"""WITH {TAPE}, {_CRASHES}, d AS (SELECT mint, arg_min(usr, (recv, seq)) AS dev FROM tape GROUP BY mint), e AS (SELECT crash.*, dev FROM crash JOIN d ON d.mint = crash.mint)
SELECT mint, 'any' AS variant, min(recv) AS first, round(arg_min(fall, (recv, seq)), 9) AS fall, arg_min(since, (recv, seq)) AS since, arg_min(top, (recv, seq)) AS top, round(arg_min(top_sold, (recv, seq)), 4) AS top_sold, arg_min(buyers, (recv, seq)) AS buyers FROM e GROUP BY mint
UNION ALL SELECT mint, 'by others', min(recv), round(arg_min(fall, (recv, seq)), 9), arg_min(since, (recv, seq)), arg_min(top, (recv, seq)), round(arg_min(top_sold, (recv, seq)), 4), arg_min(buyers, (recv, seq)) FROM e WHERE top <> dev GROUP BY mint
UNION ALL SELECT mint, 'demand', min(recv) + 864000000000, round(arg_min(fall, (recv, seq)), 9), arg_min(since, (recv, seq)), arg_min(top, (recv, seq)), round(arg_min(top_sold, (recv, seq)), 4), arg_min(buyers, (recv, seq)) FROM e WHERE buyers >= 2 GROUP BY mint""",
)
def w21_crash_trigger(t: Tables) -> DataFrame:
    """A token's first crash, its first one with another top seller than its creator (the wallet of its first print), and its first one
    that two wallets or more bought after, which is known ten days later."""
    dev = prints(t).groupBy("mint").agg(F.min_by("usr", F.struct("recv", "seq")).alias("dev"))
    rows = crashes(t).join(dev, "mint")
    kinds = F.array(F.lit("any"), F.when(F.col("top") != F.col("dev"), F.lit("by others")), F.when(F.col("buyers") >= 2, F.lit("demand")))
    rows = rows.withColumn("variant", F.explode(F.array_compact(kinds)))
    at = F.struct("recv", "seq")
    first = F.min("recv") + F.when(F.first("variant") == "demand", 10 * DAY).otherwise(0)
    of = lambda c: F.min_by(c, at)
    return rows.groupBy("mint", "variant").agg(first.alias("first"), F.round(of("fall"), 9).alias("fall"), of("since").alias("since"), of("top").alias("top"), F.round(of("top_sold"), 4).alias("top_sold"), of("buyers").alias("buyers"))


_W, _QUIET = 30 * DAY, 15 * DAY


@query(
    "w29_silence_then_burst",
    f"""WITH {TAPE}, d AS (SELECT mint, arg_min(usr, (recv, seq)) AS dev, min(recv) AS born FROM tape GROUP BY mint),
p AS (SELECT tape.*, dev, recv - born AS age, vsol / vtok AS px, lag(vsol / vtok) OVER w AS pre, recv - lag(recv) OVER w AS gap, recv - min(recv) OVER (PARTITION BY usr) AS known, buy AND row_number() OVER (PARTITION BY tape.mint, usr, buy ORDER BY recv, seq) = 1 AS fresh,
 min(CASE WHEN NOT buy THEN (recv, seq) END) OVER (PARTITION BY tape.mint, usr) AS sold FROM tape JOIN d ON d.mint = tape.mint WINDOW w AS (PARTITION BY tape.mint ORDER BY recv, seq)),
q AS (SELECT *, min((recv, seq, gap)) OVER (PARTITION BY mint ORDER BY recv RANGE BETWEEN {_W} PRECEDING AND CURRENT ROW) AS head, count(*) FILTER (fresh) OVER (PARTITION BY mint ORDER BY recv RANGE BETWEEN {_W} PRECEDING AND CURRENT ROW) AS firsts,
 min(pre) FILTER (NOT buy AND usr <> dev AND sol >= 50000) OVER (PARTITION BY mint ORDER BY recv RANGE BETWEEN {_W} PRECEDING AND 1 PRECEDING) AS absorbed FROM p),
k AS (SELECT mint, usr, recv, row_number() OVER (PARTITION BY mint, usr ORDER BY recv) AS i FROM (SELECT mint, usr, recv // {DAY} AS day, min(recv) AS recv FROM p WHERE buy AND usr <> dev AND (sold IS NULL OR (recv, seq) < sold) GROUP BY ALL))
SELECT mint, 'burst' AS variant, min(recv) AS first FROM q WHERE fresh AND age > {_W} AND head[3] >= {_QUIET} AND firsts >= 2 GROUP BY mint
UNION ALL SELECT mint, 'whale', min(recv) FROM q WHERE buy AND usr <> dev AND known >= {365 * DAY} AND sol >= 80000 GROUP BY mint
UNION ALL SELECT mint, 'absorbed', min(recv) FROM q WHERE px > absorbed AND age >= {_W} GROUP BY mint UNION ALL SELECT mint, 'accumulated', min(recv) FROM k WHERE i = 3 GROUP BY mint""",
)
def w29_silence_then_burst(t: Tables) -> DataFrame:
    """A token's first trigger of each kind. Burst: two first-time buyers or more in the thirty days before which it was silent for
    fifteen. Whale: a large buy of a wallet known for a year. Absorbed: a price above that before a large sell of the thirty days
    before. Accumulated: a wallet's buys on a third day without a sell before. The creator's prints count for none but bursts."""
    columns = ("mint", "usr", "recv", "seq", "buy", "sol", "vsol", "vtok")
    rows = scratch.written(prints(t).select(*columns), "tape")  # gone through four times
    at, line, wallet = F.struct("recv", "seq"), Window.partitionBy("mint").orderBy("recv", "seq"), Window.partitionBy("mint", "usr")
    d = rows.groupBy("mint").agg(F.min_by("usr", at).alias("dev"), F.min("recv").alias("born"))
    other = F.col("usr") != F.col("dev")
    p = rows.withColumn("px", F.col("vsol") / F.col("vtok")).drop("vsol", "vtok").join(d, "mint").withColumns({"sold": F.min(F.when(~F.col("buy"), at)).over(wallet), "age": F.col("recv") - F.col("born")})
    p = p.withColumn("held", F.col("buy") & other & (F.col("sold").isNull() | (at < F.col("sold")))).drop("sold")
    p = p.withColumns({
        "fresh": F.col("buy") & (F.row_number().over(Window.partitionBy("mint", "usr", "buy").orderBy("recv", "seq")) == 1),
        "third": F.coalesce(F.col("held"), F.lit(False)) & (F.dense_rank().over(Window.partitionBy("mint", "usr", "held").orderBy(F.floor(F.col("recv") / DAY))) == 3),
    }).drop("held")
    p = p.withColumns({"pre": F.lag("px").over(line), "gap": F.col("recv") - F.lag("recv").over(line)})
    near = Window.partitionBy("mint").orderBy("recv").rangeBetween(-_W, 0)
    q = p.withColumns({
        "head": F.min(F.struct("recv", "seq", "gap")).over(near), "firsts": F.sum(F.col("fresh").cast("long")).over(near),
        "absorbed": F.min(F.when(~F.col("buy") & other & (F.col("sol") >= 50_000), F.col("pre"))).over(Window.partitionBy("mint").orderBy("recv").rangeBetween(-_W, -1)),
    })
    hits = {
        "burst": F.col("fresh") & (F.col("age") > _W) & (F.col("head.gap") >= _QUIET) & (F.col("firsts") >= 2),
        "absorbed": (F.col("px") > F.col("absorbed")) & (F.col("age") >= _W), "accumulated": F.col("third"),
    }
    found = q.select("mint", "recv", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(v)) for v, c in hits.items())))).alias("variant"))
    known = rows.groupBy("usr").agg((F.min("recv") + 365 * DAY).alias("known"))
    whales = rows.where("buy AND sol >= 80000").select("mint", "usr", "recv").join(d, "mint").where(other).join(known, "usr").where("recv >= known").select("mint", "recv", F.lit("whale").alias("variant"))
    return found.unionByName(whales).groupBy("mint", "variant").agg(F.min("recv").alias("first"))


@query(
    "w25_largest_sell",
    f"""WITH {TAPE}, p AS (SELECT *, vsol / vtok AS px, lag(vsol / vtok) OVER w AS before, lag(vsol) OVER w AS reserve FROM tape WINDOW w AS (PARTITION BY mint ORDER BY recv, seq)),
m AS (SELECT mint, seq, px, max(CASE WHEN NOT buy THEN (sol, -recv, -seq, sol / reserve, before, px) END) OVER (PARTITION BY mint ORDER BY recv RANGE BETWEEN 863999999999 PRECEDING AND CURRENT ROW) AS x FROM p)
SELECT seq, x[1] AS largest_sell, round(x[4], 6) AS share, round(CASE WHEN x[5] > x[6] THEN (px - x[6]) / (x[5] - x[6]) END, 6) AS recovered FROM m""",
)
def w25_largest_sell(t: Tables) -> DataFrame:
    """The largest sell of the last ten days (the first of equal ones), as a share of the reserve before it, and how much of its fall
    in price has been made good by now."""
    line = Window.partitionBy("mint").orderBy("recv", "seq")
    p = prints(t).withColumn("px", F.col("vsol") / F.col("vtok"))
    p = p.withColumns({"before": F.lag("px").over(line), "reserve": F.lag("vsol").over(line)})
    sell = F.struct("sol", (-F.col("recv")).alias("r"), (-F.col("seq")).alias("s"), (F.col("sol") / F.col("reserve")).alias("share"), "before", F.col("px").alias("after"))
    m = p.withColumn("x", F.max(F.when(~F.col("buy"), sell)).over(Window.partitionBy("mint").orderBy("recv").rangeBetween(-10 * DAY + 1, 0)))
    fall = F.col("x.before") - F.col("x.after")
    return m.select("seq", F.col("x.sol").alias("largest_sell"), F.round("x.share", 6).alias("share"), F.round(F.when(fall > 0, (F.col("px") - F.col("x.after")) / fall), 6).alias("recovered"))


@query(
    "w19_first_touch",
    f"""WITH {TAPE}, e AS (SELECT mint, seq, recv, vsol / vtok AS px FROM tape WHERE buy),
j AS (SELECT e.mint, e.seq, e.recv, min(p.recv) FILTER (p.vsol / p.vtok >= 1.5 * e.px) AS tp, min(p.recv) FILTER (p.vsol / p.vtok <= 0.7 * e.px) AS sl FROM e LEFT JOIN tape p ON p.mint = e.mint AND p.recv > e.recv AND p.recv <= e.recv + 864000000000 GROUP BY ALL)
SELECT mint, seq, CASE WHEN tp IS NULL AND sl IS NULL THEN 'time' WHEN sl IS NULL OR tp < sl THEN 'profit' ELSE 'stop' END AS outcome, coalesce(least(tp, sl), tp, sl, recv + 864000000000) AS exit_at FROM j""",
)
def w19_first_touch(t: Tables) -> DataFrame:
    """First print at the target or the stop inside the hold, else time: labels of every entry. A stop at the same time counts first."""
    hold = 10 * DAY
    rows = prints(t).select("mint", "seq", "recv", "buy", (F.col("vsol") / F.col("vtok")).alias("px"))
    j = folds.first_touch(rows, "mint", "recv", "px", "buy", 1.5, 0.7, hold)
    outcome = F.when(F.col("tp").isNull() & F.col("sl").isNull(), "time").when(F.col("sl").isNull() | (F.col("tp") < F.col("sl")), "profit").otherwise("stop")
    return j.select("mint", "seq", outcome.alias("outcome"), F.coalesce(F.least("tp", "sl"), F.col("recv") + hold).alias("exit_at"))


@query(
    "w20_cooldown",
    f"""WITH RECURSIVE {TICKS}, n AS (SELECT key, t, event_id, row_number() OVER {_FIRST}) AS rn FROM ticks WHERE event_type = 'purchase'),
k AS (SELECT key, t, event_id, rn, t AS last, true AS kept FROM n WHERE rn = 1 UNION ALL
 SELECT n.key, n.t, n.event_id, n.rn, CASE WHEN n.t - k.last >= 21600000000 THEN n.t ELSE k.last END, n.t - k.last >= 21600000000 FROM k JOIN n ON n.key = k.key AND n.rn = k.rn + 1)
SELECT key, event_id, t FROM k WHERE kept""",
)
def w20_cooldown(t: Tables) -> DataFrame:
    """Greedy: an event is kept if it comes six hours or more after the last kept one."""
    return folds.cooldown(tape.ticks(t("events")).where("event_type = 'purchase'").select("key", "t", "event_id"), ["key"], "t", 6 * 3600 * SECOND, ["event_id"]).select("key", "event_id", "t")


_CROSS, _RISE = (100, 200), ((50, 1.5), (100, 3.0))
_EVENTS_SQL = ", ".join([*(f"CASE WHEN value >= {c} AND coalesce(before < {c}, true) AND (low < {c} OR fresh) THEN 'cross_{c}' END" for c in _CROSS)])
_OTHERS_SQL = ", ".join([*(f"CASE WHEN value >= {c} AND value >= {x} * ref THEN 'rise_{c}' END" for c, x in _RISE), "CASE WHEN value >= 1 AND ref >= 1 AND abs(value / ref - 1) <= 0.1 THEN 'flat' END", "'sample'"])


@query(
    "w27_crossing",
    f"""WITH RECURSIVE {TICKS}, f AS (SELECT min(t) + 3600000000 AS start FROM ticks),
c AS (SELECT key, event_id, t, value, max(value) OVER w AS before, min(value) OVER w AS low, min(t) OVER (PARTITION BY key) > start AS fresh, min(value) OVER (PARTITION BY key ORDER BY t RANGE BETWEEN 129600000000 PRECEDING AND 43200000000 PRECEDING) AS ref FROM ticks, f WHERE value IS NOT NULL WINDOW w AS {_FIRST} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT key, event_id, t, ref, unnest([{_OTHERS_SQL}]) AS kind FROM c), n AS (SELECT *, CASE WHEN kind LIKE 'rise%' THEN 86400000000 ELSE 172800000000 END AS gap, row_number() OVER (PARTITION BY kind, key ORDER BY t, event_id) AS rn FROM x WHERE kind IS NOT NULL),
k AS (SELECT key, event_id, t, ref, kind, rn, t AS last, true AS kept FROM n WHERE rn = 1 UNION ALL SELECT n.key, n.event_id, n.t, n.ref, n.kind, n.rn, CASE WHEN n.t - k.last >= gap THEN n.t ELSE k.last END, n.t - k.last >= gap FROM k JOIN n ON n.key = k.key AND n.kind = k.kind AND n.rn = k.rn + 1)
SELECT key, event_id, t, kind, ref FROM k WHERE kept UNION ALL SELECT key, event_id, t, kind, ref FROM (SELECT key, event_id, t, ref, unnest([{_EVENTS_SQL}]) AS kind FROM c) WHERE kind IS NOT NULL""",
)
def w27_crossing(t: Tables) -> DataFrame:
    """First crossings of levels, rises against the least value of 12 to 36 hours before, and flat and plain samples as controls.

    A crossing counts only if a lower value was seen before, or the key came an hour or more after the data's beginning: one that is
    above the level when the data begin is censored. Rises keep a day between them, controls two.
    """
    ticks = tape.ticks(t("events")).where("value IS NOT NULL").select("key", "event_id", "t", "value")
    start = ticks.agg((F.min("t") + 3600 * SECOND).alias("start"))  # one row
    w, ago = Window.partitionBy("key").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("key").orderBy("t").rangeBetween(-36 * 3600 * SECOND, -12 * 3600 * SECOND)
    first = F.min("t").over(Window.partitionBy("key").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    v, ref = F.col("value"), F.col("ref")
    c = ticks.crossJoin(F.broadcast(start)).withColumns({"before": F.max("value").over(w), "low": F.min("value").over(w), "first": first, "ref": F.min("value").over(ago)})
    fresh = F.col("first") > F.col("start")
    of = lambda kinds: F.explode(F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in kinds.items())), lambda k: k.isNotNull())).alias("kind")
    crossed = c.select("key", "event_id", "t", "ref", of({f"cross_{x}": (v >= x) & F.coalesce(F.col("before") < x, F.lit(True)) & ((F.col("low") < x) | fresh) for x in _CROSS}))
    rises = c.select("key", "event_id", "t", "ref", of({f"rise_{x}": (v >= x) & (v >= by * ref) for x, by in _RISE}))
    controls = c.select("key", "event_id", "t", "ref", of({"flat": (v >= 1) & (ref >= 1) & (F.abs(v / ref - 1) <= 0.1), "sample": F.lit(True)}))
    kept = [folds.cooldown(rows, ["kind", "key"], "t", days * DAY, ["event_id"]) for rows, days in ((rises, 1), (controls, 2))]
    columns = ["key", "event_id", "t", "kind", "ref"]
    return crossed.select(*columns).unionByName(kept[0].select(*columns)).unionByName(kept[1].select(*columns))


_STEP, _SPANS = 30 * DAY, (4, 12, 20)
_FLOW_SQL = ", ".join(
    f"round(sum(sol) FILTER (ago < {k * _STEP}), 2) AS vol_{k}, round(coalesce(sum(CASE WHEN buy THEN sol ELSE -sol END) FILTER (ago < {k * _STEP}) / nullif(sum(sol) FILTER (ago < {k * _STEP}), 0), 0), 6) AS ofi_{k}, count(*) FILTER (ago < {k * _STEP}) AS n_{k}, count(*) FILTER (buy AND ago < {k * _STEP}) AS buys_{k}, round(arg_max(px, (recv, seq)) / arg_max(px, (recv, seq)) FILTER (ago >= {k * _STEP}) - 1, 6) AS ret_{k}"
    for k in _SPANS
)


@query(
    "w26_flow_imbalance",
    f"""WITH {TAPE}, b AS (SELECT mint, min(recv) AS born, (SELECT max(recv) FROM tape) AS last FROM tape GROUP BY mint), g AS (SELECT mint, born, unnest(generate_series((born + {_STEP - 1}) // {_STEP} * {_STEP}, last, {_STEP})) AS t FROM b),
w AS (SELECT g.mint, g.t, g.born, p.buy, p.sol, p.recv, p.seq, vsol / vtok AS px, g.t - p.recv AS ago FROM g JOIN tape p ON p.mint = g.mint AND p.recv <= g.t)
SELECT mint, t, round((t - any_value(born)) / 1e6, 3) AS age_s, arg_max(px, (recv, seq)) AS mid, {_FLOW_SQL} FROM w GROUP BY mint, t HAVING count(*) FILTER (ago < {4 * _STEP}) >= 3""",
)
def w26_flow_imbalance(t: Tables) -> DataFrame:
    """Imbalance, volume, counts and return over 4, 12 and 20 steps at the steps of a grid where a token has had three prints or more
    in the last four.

    Prints are summed by (token, step) before shuffling; a decision is a range of steps, so a busy key is its steps, not its prints.
    """
    step = F.ceil(F.col("recv") / _STEP).cast("long")  # the decision that first sees a print
    signed = F.when(F.col("buy"), F.col("sol")).otherwise(-F.col("sol"))
    rows = prints(t).withColumn("px", F.col("vsol") / F.col("vtok"))
    cells = rows.groupBy("mint", step.alias("k")).agg(F.sum("sol").alias("v"), F.sum(signed).alias("f"), F.count("*").alias("n"), F.count_if("buy").alias("b"), F.min("recv").alias("born"), F.max(F.struct("recv", "seq", "px")).alias("end"))
    every = cells.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("later"))  # steps without prints too
    own = lambda c: F.when(F.col("later") == 0, F.col(c))
    grid = every.groupBy("mint", (F.col("k") + F.col("later")).alias("k")).agg(*(F.max(own(c)).alias(c) for c in ("v", "f", "n", "b", "born")), F.max(own("end.px")).alias("px"))
    line = Window.partitionBy("mint").orderBy("k")
    within = lambda c, k: F.coalesce(F.sum(c).over(line.rangeBetween(1 - k, 0)), F.lit(0))
    now = F.last("px", ignorenulls=True).over(line.rangeBetween(Window.unboundedPreceding, 0))
    out = {"t": F.col("k") * _STEP, "age_s": F.round((F.col("k") * _STEP - F.min("born").over(line.rangeBetween(Window.unboundedPreceding, 0))) / 1e6, 3), "mid": now}
    for k in _SPANS:
        volume = within("v", k)
        then = F.last("px", ignorenulls=True).over(line.rangeBetween(Window.unboundedPreceding, -k))
        out |= {f"vol_{k}": F.round(volume, 2), f"ofi_{k}": F.round(F.coalesce(within("f", k) / F.nullif(volume, F.lit(0.0)), F.lit(0.0)), 6), f"n_{k}": within("n", k), f"buys_{k}": within("b", k), f"ret_{k}": F.round(now / then - 1, 6)}
    final = rows.agg(F.max("recv").alias("final"))  # one row: no decision after the tape's end
    return grid.select("mint", *(c.alias(name) for name, c in out.items())).crossJoin(F.broadcast(final)).where("n_4 >= 3 AND t <= final").drop("final")


@query(
    "w30_regime",
    f"""WITH {TAPE}, {LAUNCHES}, f AS (SELECT greatest((SELECT min(born) FROM launches), (SELECT min(recv) FROM tape)) AS first),
c AS (SELECT launch, born - 3600000000 >= first AS known, (SELECT count(*) FROM launches b WHERE b.born > a.born - 600000000 AND b.born <= a.born) AS l10, (SELECT count(*) FROM launches b WHERE b.born > a.born - 3600000000 AND b.born <= a.born) AS l60,
 (SELECT count(*) FROM launches b WHERE b.completed_at > a.born - 3600000000 AND b.completed_at <= a.born) AS c60, (SELECT count(*) FROM tape p WHERE p.recv > a.born - 600000000 AND p.recv <= a.born) AS t10 FROM launches a, f)
SELECT launch, CASE WHEN known THEN l10 END AS launches_10m, CASE WHEN known THEN l60 END AS launches_1h, CASE WHEN known THEN c60 END AS completions_1h, CASE WHEN known THEN round(c60 / greatest(l60, 1), 6) END AS completion_rate, CASE WHEN known THEN t10 END AS trades_10m FROM c""",
)
def w30_regime(t: Tables) -> DataFrame:
    """Market-wide counts up to every launch: launches, completions and their ratio, prints; null where the hour before is not covered.

    Every count is the difference of two running counts, read at the launch and at the window's start. The tape's times are written once.
    """
    rows, tape_rows = tape.launches(t("orders")), scratch.written(prints(t).select("recv"), "times")
    hour, some = 3600 * SECOND, 600 * SECOND
    series = {"l": rows.select(F.col("born").alias("x")), "c": rows.where("completed").select(F.col("completed_at").alias("x")), "t": tape_rows.select(F.col("recv").alias("x"))}
    counted = stats.counts_up_to(rows.select("launch", "born"), "born", series, {"launches_10m": ("l", some), "launches_1h": ("l", hour), "completions_1h": ("c", hour), "trades_10m": ("t", some)}, hour)
    first = rows.agg(F.min("born").alias("a")).crossJoin(tape_rows.agg(F.min("recv").alias("b"))).select(F.greatest("a", "b").alias("first"))
    known = lambda c: F.when(F.col("born") - hour >= F.col("first"), c)
    counted = counted.crossJoin(F.broadcast(first))
    ratio = F.round(F.col("completions_1h") / F.greatest("launches_1h", F.lit(1)), 6)
    return counted.select("launch", *(known(F.col(c)).alias(c) for c in ("launches_10m", "launches_1h", "completions_1h")), known(ratio).alias("completion_rate"), known(F.col("trades_10m")).alias("trades_10m"))


@query(
    "c15_detector_precision",
    f"""WITH {TAPE}, f AS (SELECT *, row_number() OVER (PARTITION BY mint, usr ORDER BY recv, seq) AS r, max(vsol / vtok) OVER (PARTITION BY mint ORDER BY recv RANGE BETWEEN 1 FOLLOWING AND 2592000000000 FOLLOWING) AS top FROM tape WHERE buy)
SELECT usr, count(*) AS n, round(avg(CASE WHEN top >= 1.3 * vsol / vtok THEN 1.0 ELSE 0.0 END), 6) AS precision FROM f WHERE r = 1 AND recv + 2592000000000 <= 893980800000000 GROUP BY usr HAVING count(*) >= 8""",
)
def c15_detector_precision(t: Tables) -> DataFrame:
    """Share of a wallet's first buys after which the price rose 30% within a month; censored buys left out."""
    px = F.col("vsol") / F.col("vtok")
    buys = prints(t).where("buy")
    f = buys.withColumn("r", F.row_number().over(Window.partitionBy("mint", "usr").orderBy("recv", "seq"))).withColumn("top", F.max(px).over(Window.partitionBy("mint").orderBy("recv").rangeBetween(1, 30 * DAY)))
    ran = F.when(F.col("top") >= 1.3 * px, 1.0).otherwise(0.0)
    return f.where(f"r = 1 AND recv + {30 * DAY} <= 893980800000000").groupBy("usr").agg(F.count("*").alias("n"), F.round(F.avg(ran), 6).alias("precision")).where("n >= 8")


@query(
    "c11_mirror",
    f"""WITH {TAPE}, p AS (SELECT mint, usr, recv, seq, buy, tok, coalesce(sum(CASE WHEN buy THEN tok ELSE -tok END) OVER (PARTITION BY mint, usr ORDER BY recv, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM tape)
SELECT mint, usr, seq, CASE WHEN buy AND pos <= 0 THEN 'open' WHEN NOT buy AND pos > 0 THEN 'exit' ELSE 'other' END AS action, round(CASE WHEN NOT buy AND pos > 0 THEN least(tok / pos, 1) END, 6) AS fraction FROM p""",
)
def c11_mirror(t: Tables) -> DataFrame:
    """What a mirror does at each print of a wallet, and the fraction it exits."""
    w = Window.partitionBy("mint", "usr").orderBy("recv", "seq").rowsBetween(Window.unboundedPreceding, -1)
    pos = F.coalesce(F.sum(F.when(F.col("buy"), F.col("tok")).otherwise(-F.col("tok"))).over(w), F.lit(0.0))
    p = prints(t).withColumn("pos", pos)
    sells = ~F.col("buy") & (F.col("pos") > 0)
    return p.select("mint", "usr", "seq", F.when(F.col("buy") & (F.col("pos") <= 0), "open").when(sells, "exit").otherwise("other").alias("action"), F.round(F.when(sells, F.least(F.col("tok") / F.col("pos"), F.lit(1.0))), 6).alias("fraction"))


@query(
    "c12_latency_sweep",
    f"""WITH {TAPE}, e AS (SELECT seq, mint, recv, d FROM tape, (VALUES (0), (3600), (86400)) x(d) WHERE buy),
f AS (SELECT e.*, (SELECT arg_min(vsol / vtok, (p.recv, p.seq)) FROM tape p WHERE p.mint = e.mint AND p.recv >= e.recv + d * 1000000::BIGINT) AS entry, (SELECT arg_min(vsol / vtok, (p.recv, p.seq)) FROM tape p WHERE p.mint = e.mint AND p.recv >= e.recv + d * 1000000::BIGINT + 864000000000) AS leave FROM e)
SELECT CAST(d AS BIGINT) AS delay_s, count(*) AS n, count(leave) AS filled, round(avg(leave / entry - 1), 6) AS mean_return FROM f GROUP BY d""",
)
def c12_latency_sweep(t: Tables) -> DataFrame:
    """The same signals priced at several delays: signals x delays, two forward as-of joins, one group-by."""
    rows = prints(t).withColumn("px", F.col("vsol") / F.col("vtok"))
    e = rows.where("buy").select("seq", "mint", "recv", F.explode(F.array(*map(F.lit, (0, 3600, 86_400)))).alias("d"))
    e = e.withColumn("t", F.col("recv") + F.col("d").cast("long") * SECOND)
    states = rows.select("mint", F.col("recv").alias("t"), "px", F.col("seq").alias("order"))
    one = joins.asof_join(e, states, ["mint"], "t", ["px"], forward=True, order=["order"]).withColumnRenamed("px", "entry").drop("t_right").withColumn("t", F.col("t") + 10 * DAY)
    two = joins.asof_join(one, states, ["mint"], "t", ["px"], forward=True, order=["order"])
    return two.groupBy(F.col("d").cast("long").alias("delay_s")).agg(F.count("*").alias("n"), F.count("px").alias("filled"), F.round(F.avg(F.col("px") / F.col("entry") - 1), 6).alias("mean_return"))
