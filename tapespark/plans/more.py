"""Further composites: decoded logs, leads, walk-forward fits, pairs, basis, funding, bar outcomes, quote checks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evidence, folds, grids, joins, scratch, stats
from ..sources import feeds, tape
from ..sources.tape import DAILY, DAY, LAUNCHES, SECOND, TAPE, TICKS
from ..streaming import live
from .composites import _VENUES, BASIS, hourly_basis, venues
from .panels import daily
from .registry import Tables, query
from .tape import prints


def _text(value: Column) -> Column:
    raw = value.cast("binary")
    return F.concat(feeds.little_endian(F.length(raw), 4), raw)


_BUY, _SELL, _MADE = "67f4521f2cf57777", "3e2f370aa503dc2a", "b1310cd2a076a774"


@query(
    "s6_decode_swaps",
    "SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, CASE WHEN l_linestatus = 'F' THEN 'buy' ELSE 'sell' END AS kind, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS tok, CAST(CAST(round(l_extendedprice) AS BIGINT) AS VARCHAR) AS sol FROM lineitem WHERE l_quantity >= 10",
)
def s6_decode_swaps(t: Tables) -> DataFrame:
    """Order lines written as two layouts of one log; events shorter than their layout are not decoded."""
    buy = F.col("l_linestatus") == "F"
    a, b = feeds.little_endian(F.col("l_quantity")), feeds.little_endian(F.round("l_extendedprice"))
    body = F.when(buy, F.concat(F.unhex(F.lit(_BUY)), a, b)).otherwise(F.concat(F.unhex(F.lit(_SELL)), b, a))
    logs = t("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.when(F.col("l_quantity") < 10, F.substring(body, 1, 20)).otherwise(body).alias("data"))
    kinds = {"buy": (_BUY, 24, {"tok": ("u64", 8), "sol": ("u64", 16)}), "sell": (_SELL, 24, {"sol": ("u64", 8), "tok": ("u64", 16)})}
    return feeds.decode_events(logs, "data", kinds).withColumns({c: F.col(c).cast("string") for c in ("tok", "sol")})


@query("s7_decode_creates", "SELECT p_partkey, p_name AS name, p_brand AS symbol, p_type AS uri, CAST(p_size AS VARCHAR) AS size FROM part")
def s7_decode_creates(t: Tables) -> DataFrame:
    """Events with three strings of any length before a number: offsets follow from the lengths."""
    data = F.concat(F.unhex(F.lit(_MADE)), _text(F.col("p_name")), _text(F.col("p_brand")), _text(F.col("p_type")), feeds.little_endian(F.col("p_size")))
    logs = t("part").select("p_partkey", data.alias("data"))
    name, symbol, uri = feeds.strings(F.col("data"), 8, 3)
    rows = logs.select("p_partkey", "data", name.alias("name"), symbol.alias("symbol"), uri.alias("uri"))
    end = F.lit(8 + 12) + F.length(F.col("name").cast("binary")) + F.length(F.col("symbol").cast("binary")) + F.length(F.col("uri").cast("binary"))
    return rows.select("p_partkey", "name", "symbol", "uri", feeds.u64(F.col("data"), end).cast("string").alias("size"))


@query("s8_known_pool_swaps", f"WITH {TAPE}, pools AS (SELECT s_suppkey AS mint, 700000000000000 + s_nationkey * 10000000000000 AS made FROM supplier WHERE s_acctbal > 0) SELECT seq, t.mint, round(sol / 100, 4) AS sol, CAST(round(discount * 1e4) AS BIGINT) AS fee_bps FROM tape t JOIN pools ON pools.mint = t.mint AND made <= recv")
def s8_known_pool_swaps(t: Tables) -> DataFrame:
    """Swaps of pools that were made before, scaled, with their fee."""
    pools = t("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("mint"), (F.lit(700_000_000_000_000) + F.col("s_nationkey").cast("long") * 10_000_000_000_000).alias("made"))
    rows = prints(t).join(pools, "mint").where("made <= recv")
    return rows.select("seq", "mint", F.round(F.col("sol") / 100, 4).alias("sol"), F.round(F.col("discount") * 1e4).cast("long").alias("fee_bps"))


@query(
    "s9_second_venue",
    "SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_suppkey AS pool, s_name AS name, l_linestatus = 'F' AS buy, CAST(l_linenumber AS BIGINT) AS status, l_extendedprice AS amount_in, l_quantity AS amount_out, l_extendedprice + 30 AS virtual_quote, l_quantity + 1 AS virtual_base, CAST(round(l_tax * 1e4) + round(l_discount * 1e4) AS DOUBLE) AS fees FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity >= 5",
)
def s9_second_venue(t: Tables) -> DataFrame:
    """The trades table of a second venue with its pools: both decoded from logs, the fee the sum of four parts; short logs go."""
    made = t("supplier").select(F.concat(F.unhex(F.lit(_MADE)), feeds.little_endian(F.col("s_suppkey")), _text(F.col("s_name"))).alias("data"))
    pools = feeds.decode_events(made, "data", {"create": (_MADE, 20, {"pool": ("u64", 8)})})
    pools = made.select(feeds.u64(F.col("data"), 8).cast("long").alias("pool"), feeds.strings(F.col("data"), 16, 1)[0].alias("name")).join(pools.select(F.col("pool").cast("long").alias("pool")), "pool", "left_semi")
    tax, off = F.round(F.col("l_tax") * 1e4), F.round(F.col("l_discount") * 1e4)
    fields = {"f0": F.col("l_suppkey"), "f1": F.col("l_linenumber"), "f2": F.round(F.col("l_extendedprice") * 100), "f3": F.col("l_quantity"), "f4": tax, "f5": off}
    lines = t("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_linestatus").alias("status"), *(c.cast("long").alias(n) for n, c in fields.items()))
    body = F.concat(F.unhex(F.lit(_BUY)), *(feeds.little_endian(F.col(c)) for c in fields), F.unhex(F.lit("00" * 16)), F.unhex(F.when(F.col("status") == "F", "01").otherwise("00")))
    logs = lines.select("id", "line", "part", F.substring(body, F.lit(1), F.when(F.col("f3") < 5, 60).otherwise(73)).alias("data"))
    names = ("pool", "status", "amount_in", "amount_out", "fee1", "fee2", "fee3", "fee4")
    trades = feeds.decode_events(logs, "data", {"trade": (_BUY, 73, {n: ("u64", 8 + 8 * k) for k, n in enumerate(names)} | {"buy": ("bool", 72)})})
    trades = trades.withColumns({n: F.col(n).cast("double") for n in names[2:]}).withColumns({n: F.col(n).cast("long") for n in names[:2]})
    money = F.col("amount_in") / 100
    fees = sum((F.col(f"fee{k}") for k in (2, 3, 4)), F.col("fee1"))
    return trades.join(pools, "pool").select("id", "line", "part", "pool", "name", "buy", "status", money.alias("amount_in"), "amount_out", (money + 30).alias("virtual_quote"), (F.col("amount_out") + 1).alias("virtual_base"), fees.alias("fees"))


@query("s27_list_offsets", "SELECT l_orderkey AS id, count(*) AS holders, CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS VARCHAR) AS claimed FROM lineitem GROUP BY l_orderkey")
def s27_list_offsets(t: Tables) -> DataFrame:
    """Distribution events whose amount stands behind a list of any length; repeats of an event count once."""
    g = t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), F.sum(F.round("l_extendedprice").cast("long")).alias("amount"))
    listed = F.unhex(F.repeat(F.lit("ab" * 34), F.col("n").cast("int")))
    data = F.concat(F.unhex(F.lit("a537817004b3ca28")), feeds.little_endian(F.col("n"), 4), listed, feeds.little_endian(F.col("amount")))
    logs = g.select("id", F.explode(F.array_repeat(data, 2)).alias("data"))
    # numbers and a digest are dealt out and sorted, not the lists, which may be long and shrink in the shuffle's compression
    lists = logs.select("id", "data", F.sha2(F.substring("data", 1, 120), 256).alias("lead"), feeds.u32(F.col("data"), 8).alias("holders"))
    events = lists.select("id", "lead", "holders", feeds.u64(F.col("data"), 12 + 34 * F.col("holders")).alias("claimed"))
    return events.dropDuplicates(["id", "lead"]).select("id", "holders", F.col("claimed").cast("string").alias("claimed"))


_HOST = "regexp_replace(lower(regexp_extract({0}, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '')"


@query(
    "j20_lead_tables",
    f"""WITH p AS (SELECT page_id, url, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, list_distinct(regexp_extract_all(html, '(?i)href=["'']([^"''#\\s]+)', 1)) AS links FROM pages), c AS (SELECT page_id, unnest(links) AS u FROM p)
SELECT 'identities' AS target, page_id, url AS value, {_HOST.format('url')} AS domain FROM p UNION ALL SELECT 'observations', page_id, title, {_HOST.format('url')} FROM p WHERE title IS NOT NULL
UNION ALL SELECT 'candidates', page_id, u, nullif({_HOST.format('u')}, '') FROM c UNION ALL SELECT 'gaps', page_id, url, NULL FROM p WHERE len(links) = 0""",
)
def j20_lead_tables(t: Tables) -> DataFrame:
    """Nested leads, one object per page, to the rows of four tables: identities, observations, candidates, and what is missing."""
    links = F.array_distinct(F.regexp_extract_all("html", F.lit(r"(?i)href=[\"']([^\"'#\s]+)"), F.lit(1)))
    title = F.nullif(F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    lead = t("pages").select("page_id", F.to_json(F.struct("url", title.alias("title"), links.alias("links"))).alias("lead"))
    x = F.from_json("lead", "url string, title string, links array<string>")
    p = lead.select("page_id", x.alias("x")).select("page_id", "x.*").withColumn("links", F.coalesce("links", F.array().cast("array<string>")))
    row = lambda target, value, host: F.struct(F.lit(target).alias("target"), value.alias("value"), host.alias("domain"))
    host, none = X.domain(F.col("url")), F.lit(None).cast("string")
    found = F.concat(
        F.array(row("identities", F.col("url"), host)),
        F.when(F.col("title").isNotNull(), F.array(row("observations", F.col("title"), host))).otherwise(F.array()),
        F.transform("links", lambda u: row("candidates", u, F.nullif(X.domain(u), F.lit("")))),
        F.when(F.size("links") == 0, F.array(row("gaps", F.col("url"), none))).otherwise(F.array()),
    )
    return p.select("page_id", F.explode(found).alias("r")).select("r.target", "page_id", "r.value", "r.domain")


def _fit_weeks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Coefficients per week from the sums of the weeks before: a solve of three numbers per row."""
    out = []
    for r in pdf.itertuples():
        xx = np.array([[r.n, r.sx, r.sz], [r.sx, r.sxx, r.sxz], [r.sz, r.sxz, r.szz]])
        beta = np.linalg.solve(xx + np.eye(3) * 1e-8 * max(np.trace(xx), 1e-12), np.array([r.sy, r.sxy, r.szy]))
        out.append((r.symbol, r.week, *beta))
    return pd.DataFrame(out, columns=["symbol", "week", "b0", "b1", "b2"])


_WALK = f"""WITH {DAILY}, y AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY day)) AS y FROM daily), d AS (SELECT *, day // 7 AS week FROM (SELECT day, symbol, y, lag(y, 1) OVER w AS x, lag(y, 2) OVER w AS z FROM y WINDOW w AS (PARTITION BY symbol ORDER BY day)) WHERE z IS NOT NULL),
g AS (SELECT symbol, week, count(*) AS n, sum(x) AS sx, sum(z) AS sz, sum(y) AS sy, sum(x * x) AS sxx, sum(x * z) AS sxz, sum(z * z) AS szz, sum(x * y) AS sxy, sum(z * y) AS szy FROM d GROUP BY ALL),
s AS (SELECT symbol, week, {', '.join(f'sum({c}) OVER w AS {c}' for c in ('n', 'sx', 'sz', 'sy', 'sxx', 'sxz', 'szz', 'sxy', 'szy'))} FROM g WINDOW w AS (PARTITION BY symbol ORDER BY week RANGE BETWEEN 13 PRECEDING AND 1 PRECEDING)),
r AS (SELECT symbol, week, n + l AS a, sx AS b, sz AS c, sxx + l AS d, sxz AS e, szz + l AS f, sy, sxy, szy FROM (SELECT *, 1e-8 * greatest(n + sxx + szz, 1e-12) AS l FROM s WHERE n >= 20)),
k AS (SELECT symbol, week, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det, sy * (d * f - e * e) - b * (sxy * f - e * szy) + c * (sxy * e - d * szy) AS d0, a * (sxy * f - e * szy) - sy * (b * f - e * c) + c * (b * szy - sxy * c) AS d1, a * (d * szy - sxy * e) - b * (b * szy - sxy * c) + sy * (b * e - d * c) AS d2 FROM r)
SELECT d.symbol, d.day, round((d0 + d1 * x + d2 * z) / det, 6) AS pred FROM d JOIN k ON k.symbol = d.symbol AND k.week = d.week"""


@query("a32_walk_forward", _WALK)
def a32_walk_forward(t: Tables) -> DataFrame:
    """Next change from the last two, refitted every week on the thirteen weeks before: weekly sums, a window, a small solve."""
    w = Window.partitionBy("symbol").orderBy("day")
    d = daily(t).withColumn("y", F.log(F.col("close") / F.lag("close").over(w))).withColumn("x", F.lag("y", 1).over(w)).withColumn("z", F.lag("y", 2).over(w)).withColumn("week", F.floor(F.col("day") / 7)).where("z IS NOT NULL")
    terms = {"n": F.lit(1.0), "sx": F.col("x"), "sz": F.col("z"), "sy": F.col("y"), "sxx": F.col("x") * F.col("x"), "sxz": F.col("x") * F.col("z"), "szz": F.col("z") * F.col("z"), "sxy": F.col("x") * F.col("y"), "szy": F.col("z") * F.col("y")}
    weekly = d.groupBy("symbol", "week").agg(*(F.sum(v).alias(k) for k, v in terms.items()))
    past = Window.partitionBy("symbol").orderBy("week").rangeBetween(-13, -1)
    sums = weekly.select("symbol", "week", *(F.sum(k).over(past).alias(k) for k in terms)).where("n >= 20")
    fit = sums.mapInPandas(lambda parts: (_fit_weeks(p) for p in parts), "symbol string, week long, b0 double, b1 double, b2 double")
    return d.join(fit, ["symbol", "week"]).select("symbol", "day", F.round(F.col("b0") + F.col("b1") * F.col("x") + F.col("b2") * F.col("z"), 6).alias("pred"))


_FORMED = f"""{DAILY}, j AS (SELECT a.day, a.symbol AS a, b.symbol AS b, ln(a.close) AS y, ln(b.close) AS x FROM daily a JOIN daily b ON b.day = a.day AND a.symbol < b.symbol), f AS (SELECT a, b, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha FROM j GROUP BY ALL HAVING count(*) >= 20),
e AS (SELECT a, b, day, y - alpha - beta * x AS e FROM j JOIN f USING (a, b)), l AS (SELECT a, b, l, e - l AS de FROM (SELECT a, b, e, lag(e) OVER (PARTITION BY a, b ORDER BY day) AS l FROM e) WHERE l IS NOT NULL),
s AS (SELECT a, b, sum(l * de) / sum(l * l) AS rho, sum(l * de) AS ld, sum(l * l) AS ll, sum(de * de) AS dd, count(*) AS m FROM l GROUP BY ALL), q AS (SELECT a, b, rho / sqrt((dd - rho * ld) / (m - 1) / ll) AS t, CASE WHEN rho < 0 AND rho > -1 THEN -ln(2) / ln(1 + rho) END AS half_life FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY t, a, b) AS i FROM q WHERE t < -3),
w(i, a, b, t, half_life, kept, used) AS (SELECT 0::BIGINT, '', '', 0.0::DOUBLE, 0.0::DOUBLE, false, []::VARCHAR[] UNION ALL SELECT i, a, b, t, half_life, ok, CASE WHEN ok THEN used || [a, b] ELSE used END FROM (
 SELECT r.i, r.a, r.b, r.t, r.half_life, w.used, len(list_filter(w.used, lambda s: s = r.a)) < 2 AND len(list_filter(w.used, lambda s: s = r.b)) < 2 AS ok FROM w JOIN r ON r.i = w.i + 1))"""


@query("a33_pair_formation", f"WITH RECURSIVE {_FORMED} SELECT a, b, round(t, 4) AS t, round(half_life, 4) AS half_life FROM w WHERE kept ORDER BY i LIMIT 30")
def a33_pair_formation(t: Tables) -> DataFrame:
    """Pairs by regression of log closes and the t-value of the residual's mean reversion, best first, two per symbol at most."""
    d = daily(t).select("day", "symbol", F.log("close").alias("p"))
    j = d.select("day", F.col("symbol").alias("a"), F.col("p").alias("y")).join(d.select("day", F.col("symbol").alias("b"), F.col("p").alias("x")), "day").where("a < b")
    fit = j.groupBy("a", "b").agg(F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("alpha"), F.count("*").alias("n")).where("n >= 20")
    e = j.join(fit, ["a", "b"]).withColumn("e", F.col("y") - F.col("alpha") - F.col("beta") * F.col("x"))
    w = Window.partitionBy("a", "b").orderBy("day")
    e = e.withColumn("l", F.lag("e").over(w)).withColumn("de", F.col("e") - F.col("l")).where("l IS NOT NULL")
    s = e.groupBy("a", "b").agg(F.sum(F.col("l") * F.col("de")).alias("ld"), F.sum(F.col("l") * F.col("l")).alias("ll"), F.sum(F.col("de") * F.col("de")).alias("dd"), F.count("*").alias("m"))
    rho = F.col("ld") / F.col("ll")
    s = s.withColumn("t", rho / F.sqrt((F.col("dd") - rho * F.col("ld")) / (F.col("m") - 1) / F.col("ll"))).withColumn("half_life", F.when((rho < 0) & (rho > -1), -F.log(F.lit(2.0)) / F.log(1 + rho))).where("t < -3")
    # one group, walked best first: the state is how often each symbol was taken, and pairs pass one by one
    pairs = s.select("a", "b", "t", "half_life", F.lit(1).alias("one"))
    return folds.sweep(pairs, ["one"], ["t", "a", "b"], _twice_at_most, pairs.schema).limit(30).select("a", "b", F.round("t", 4).alias("t"), F.round("half_life", 4).alias("half_life"))


def _twice_at_most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep a pair if both of its symbols were kept less than twice before."""
    used: Counter[str] = Counter()
    for batch in batches:
        kept = []
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            kept.append(used[a] < 2 and used[b] < 2)
            if kept[-1]:
                used.update((a, b))
        yield batch.filter(pa.array(kept, pa.bool_()))


@query(
    "c34_pair_spread",
    f"""WITH RECURSIVE {_FORMED}, k AS (SELECT a, b, greatest(20, least(576, round(2 * coalesce(round(half_life, 4), 0))))::BIGINT AS w FROM (SELECT * FROM w WHERE kept ORDER BY i LIMIT 30)),
x AS (SELECT day, a, b, k.w AS bars, y - beta * x AS s, row_number() OVER (PARTITION BY a, b ORDER BY day) AS i FROM j JOIN f USING (a, b) JOIN k USING (a, b)),
z AS (SELECT day, a, b, bars, i, (s - avg(s) OVER v) / nullif(stddev_samp(s) OVER v, 0) AS z FROM x WINDOW v AS (PARTITION BY a, b ORDER BY day ROWS BETWEEN (bars - 1) PRECEDING AND CURRENT ROW))
SELECT day, a, b, bars, CASE WHEN i >= bars THEN round(z, 6) END AS z FROM z""",
)
def c34_pair_spread(t: Tables) -> DataFrame:
    """Z-score of every formed pair's spread over a window of its own: twice its half-life, 20 to 576 bars (20 where it turns within a bar)."""
    pairs = scratch.written(a33_pair_formation(t), "pairs").select("a", "b", F.greatest(F.lit(20), F.least(F.lit(576), F.round(2 * F.coalesce("half_life", F.lit(0.0))))).cast("long").alias("bars"))
    d = daily(t).select("day", "symbol", F.log("close").alias("p"))
    x = d.select("day", F.col("symbol").alias("a"), F.col("p").alias("y")).join(pairs, "a").join(d.select("day", F.col("symbol").alias("b"), F.col("p").alias("x")), ["day", "b"])
    fit = x.groupBy("a", "b").agg(F.regr_slope("y", "x").alias("beta"))
    x = x.join(fit, ["a", "b"]).select("day", "a", "b", "bars", (F.col("y") - F.col("beta") * F.col("x")).alias("s"))
    z = grids.variable_frames(x, ["a", "b"], ["day"], "s", "bars")
    return z.select("day", "a", "b", "bars", F.round((F.col("s") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0)), 6).alias("z"))


@query(
    "c14_wallet_features",
    f"""WITH {TAPE}, f AS (SELECT *, recv - min(recv) OVER (PARTITION BY usr) >= 31536000000000 AS aged FROM tape), q AS (SELECT usr, avg(CASE WHEN discount > 0.05 THEN 1.0 ELSE 0 END) AS precision FROM tape WHERE buy AND recv < 788918400000000 GROUP BY usr HAVING count(*) >= 8)
SELECT mint, recv // 2592000000000 AS period, count(q.usr) AS detectors, round(max(precision), 6) AS best, round(avg(precision), 6) AS mean, round(avg(CASE WHEN aged THEN 1.0 ELSE 0 END), 6) AS aged_share FROM f LEFT JOIN q ON q.usr = f.usr WHERE buy AND recv >= 788918400000000 GROUP BY ALL""",
)
def c14_wallet_features(t: Tables) -> DataFrame:
    """Wallet features of a token's buys per month: detectors by earlier precision, and the share of aged wallets."""
    rows = prints(t)
    f = rows.withColumn("aged", F.col("recv") - F.min("recv").over(Window.partitionBy("usr")) >= 365 * DAY)
    q = rows.where("buy AND recv < 788918400000000").groupBy("usr").agg(F.avg((F.col("discount") > 0.05).cast("double")).alias("precision"), F.count("*").alias("n")).where("n >= 8").drop("n")
    j = f.where("buy AND recv >= 788918400000000").join(q, "usr", "left")
    return j.groupBy("mint", F.floor(F.col("recv") / (30 * DAY)).alias("period")).agg(F.count("precision").alias("detectors"), F.round(F.max("precision"), 6).alias("best"), F.round(F.avg("precision"), 6).alias("mean"), F.round(F.avg(F.col("aged").cast("double")), 6).alias("aged_share"))


@query(
    "c24_event_outcomes",
    f"""WITH {TICKS}, e AS (SELECT event_id, key, t, value FROM ticks WHERE event_type = 'purchase' AND value >= 100), c AS (SELECT event_id, key, t + 43200000000 AS t, value FROM e), a AS (SELECT 'event' AS arm, * FROM e UNION ALL SELECT 'control', * FROM c),
o AS (SELECT arm, (SELECT max(value) FROM ticks q WHERE q.key = a.key AND q.t > a.t AND q.t <= a.t + 21600000000) AS best FROM a) SELECT arm, count(*) AS n, count(best) AS seen, round(avg(best), 6) AS mean FROM o GROUP BY arm""",
)
def c24_event_outcomes(t: Tables) -> DataFrame:
    """Best value in the six hours after events, and after the same keys half a day later."""
    ticks = tape.ticks(t("events"))
    e = ticks.where("event_type = 'purchase' AND value >= 100").select("event_id", "key", "t")
    arms = e.withColumn("arm", F.lit("event")).union(e.withColumn("t", F.col("t") + DAY // 2).withColumn("arm", F.lit("control")))
    o = joins.range_join(arms, ticks.select("key", F.col("t").alias("u"), "value"), ["key"], "t", "u", 1, 6 * 3600 * SECOND, how="left").groupBy("arm", "event_id").agg(F.max("value").alias("best"))
    return o.groupBy("arm").agg(F.count("*").alias("n"), F.count("best").alias("seen"), F.round(F.avg("best"), 6).alias("mean"))


@query(
    "c32_leader_without_follower",
    f"WITH {DAILY}, m AS (SELECT day, symbol, close / lag(close, 2) OVER w - 1 AS move, lead(close) OVER w / close - 1 AS fwd FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY day)) SELECT l.day, f.symbol, round(l.move, 6) AS lead_move, round(f.fwd, 6) AS fwd FROM m l JOIN m f ON f.day = l.day AND l.symbol = 'BUILDING' AND f.symbol <> 'BUILDING' WHERE abs(l.move) > 0.2 AND abs(f.move) < 0.5 * abs(l.move)",
)
def c32_leader_without_follower(t: Tables) -> DataFrame:
    """A leader's move that a follower has not answered, and the follower's next return."""
    w = Window.partitionBy("symbol").orderBy("day")
    m = daily(t).withColumn("move", F.col("close") / F.lag("close", 2).over(w) - 1).withColumn("fwd", F.lead("close").over(w) / F.col("close") - 1)
    lead = m.where("symbol = 'BUILDING' AND abs(move) > 0.2").select("day", F.col("move").alias("lead"))
    j = m.where("symbol <> 'BUILDING'").join(lead, "day").where("abs(move) < 0.5 * abs(lead)")
    return j.select("day", "symbol", F.round("lead", 6).alias("lead_move"), F.round("fwd", 6).alias("fwd"))


@query("c33_basis", f"WITH {TICKS}, {_VENUES}, {BASIS} SELECT coin, hour, round(x, 6) AS basis, round(x - med, 6) AS deviation FROM basis")
def c33_basis(t: Tables) -> DataFrame:
    """Basis of a venue against the reference on a grid of hours, and its deviation from the median of the 24 before."""
    return hourly_basis(venues(t)).select("coin", "hour", F.round("x", 6).alias("basis"), F.round(F.col("x") - F.col("med"), 6).alias("deviation"))


_FUNDED = """lines AS (SELECT o_custkey AS creator, l_suppkey AS funder, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS day, l_orderkey, l_linenumber, l_partkey, l_extendedprice AS amount FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
funding AS (SELECT creator, arg_min(funder, (day, l_orderkey, l_linenumber, l_partkey)) AS funder, min(day) AS t, arg_min(amount, (day, l_orderkey, l_linenumber, l_partkey)) AS amount FROM lines GROUP BY creator)"""


@query(
    "c37_funding_features",
    f"""WITH {LAUNCHES}, {_FUNDED}, f AS (SELECT f.*, s_acctbal AS pre, s_nationkey, (SELECT count(*) FROM lines x WHERE x.funder = f.funder AND x.day >= f.t - 1 AND x.day <= f.t) AS f_24h, (SELECT count(*) FROM lines x WHERE x.funder = f.funder AND x.day <= f.t) AS f_n, (SELECT min(day) FROM lines x WHERE x.funder = f.funder) AS f_first FROM funding f JOIN supplier ON s_suppkey = f.funder),
l AS (SELECT launch, creator, born // 86400000000 AS day, row_number() OVER (PARTITION BY creator ORDER BY born, launch) - 1 AS before, born - min(born) OVER (PARTITION BY creator) AS age_us FROM launches),
j AS (SELECT l.*, f.funder, f.t, f.pre, f.s_nationkey, f.f_24h, f.f_n, f.f_first, (SELECT count(*) FROM funding g WHERE g.funder = f.funder AND g.creator <> l.creator AND g.t < l.day) AS others FROM l LEFT JOIN f ON f.creator = l.creator AND f.t < l.day)
SELECT launch, creator, CAST(age_us // 1000000 AS BIGINT) AS age_s, before, CASE WHEN before >= 8 THEN 'heavy' WHEN before = 0 THEN 'unknown' WHEN age_us < 86400000000 THEN 'fresh' WHEN age_us < 2592000000000 THEN 'young' ELSE 'aged' END AS creator_class, CASE WHEN funder IS NOT NULL THEN others END AS others, f_24h, f_n,
 CASE WHEN funder IS NULL THEN 'unknown' WHEN s_nationkey = 0 THEN 'listed' WHEN pre >= 9000 THEN 'whale' WHEN others >= 40 OR f_24h >= 8 THEN 'farm' WHEN f_n < 1000 AND t - f_first <= 7 THEN 'fresh' ELSE 'other' END AS funder_class FROM j""",
)
def c37_funding_features(t: Tables) -> DataFrame:
    """Account age, launches before, and the funder of a creator's first line: its counts up to the funding, other creators it had
    funded before the launch, and a class by the first rule of a ladder that holds. Counts are running ones, not pairs."""
    owners = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("creator"))
    day = F.unix_date(F.to_date("l_shipdate")).cast("long")
    lines = t("lineitem").select("l_orderkey", F.col("l_suppkey").alias("funder"), day.alias("day"), "l_linenumber", "l_partkey").join(owners, "l_orderkey")
    # a row an order has what both questions need: its first line, and its lines' funders and days
    first = F.min(F.struct("day", "l_orderkey", "l_linenumber", "l_partkey", "funder"))
    lines = scratch.written(lines.groupBy("l_orderkey", "creator").agg(first.alias("x"), F.collect_list(F.struct("funder", "day")).alias("of")), "funding-lines")
    daily_lines = lines.select(F.inline("of")).repartition("funder").groupBy("funder", "day").agg(F.count("*").alias("n"))
    w = Window.partitionBy("funder").orderBy("day")
    counts = daily_lines.select("funder", F.col("day").alias("t"), F.sum("n").over(w.rangeBetween(-1, 0)).alias("f_24h"), F.sum("n").over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("f_n"), F.min("day").over(Window.partitionBy("funder")).alias("f_first"))
    funding = lines.groupBy("creator").agg(F.min("x").alias("x")).select("creator", "x.funder", F.col("x.day").alias("t"))
    funds = funding.join(counts, ["funder", "t"]).join(t("supplier").select(F.col("s_suppkey").alias("funder"), F.col("s_acctbal").alias("pre"), "s_nationkey"), "funder")
    own = Window.partitionBy("creator")
    l = tape.launches(t("orders")).select("launch", "creator", F.floor(F.col("born") / DAY).alias("day"), (F.row_number().over(own.orderBy("born", "launch")) - 1).cast("long").alias("before"), (F.col("born") - F.min("born").over(own)).alias("age"))
    j = l.join(funds.withColumnRenamed("creator", "c"), (F.col("c") == F.col("creator")) & (F.col("t") < F.col("day")), "left").drop("c")
    # creators funded so far: one step for each at its funding, read at the launches; the launch's own creator is one of them
    step = funding.groupBy("funder", F.col("t").alias("day")).agg(F.count("*").alias("n")).withColumn("o", F.lit(0)).withColumn("n", F.sum("n").over(Window.partitionBy("funder").orderBy("day")))
    known = joins.asof_join(j.where("funder IS NOT NULL"), step, ["funder"], "day", ["n"], order=["o"], strict=True).withColumn("others", F.coalesce("n", F.lit(0)) - 1).drop("n", "day_right")
    every = known.unionByName(j.where("funder IS NULL").withColumn("others", F.lit(None).cast("long")))
    creator_class = F.when(F.col("before") >= 8, "heavy").when(F.col("before") == 0, "unknown").when(F.col("age") < DAY, "fresh").when(F.col("age") < 30 * DAY, "young").otherwise("aged")
    farm = (F.col("others") >= 40) | (F.col("f_24h") >= 8)
    funder_class = F.when(F.col("funder").isNull(), "unknown").when(F.col("s_nationkey") == 0, "listed").when(F.col("pre") >= 9000, "whale").when(farm, "farm").when((F.col("f_n") < 1000) & (F.col("t") - F.col("f_first") <= 7), "fresh").otherwise("other")
    return every.select("launch", "creator", F.floor(F.col("age") / SECOND).alias("age_s"), "before", creator_class.alias("creator_class"), "others", "f_24h", "f_n", funder_class.alias("funder_class"))


@query(
    "c39_bar_first_touch",
    f"""WITH {TICKS}, b AS (SELECT key, t // 3600000000 AS bar, arg_min(value, (t, event_id)) AS o, max(value) AS h, min(value) AS l FROM ticks GROUP BY ALL), e AS (SELECT key, bar, o FROM b WHERE o > 50),
x AS (SELECT e.key, e.bar, e.o, min(b.bar) FILTER (b.l <= e.o * 0.5 OR b.h >= e.o * 1.5) AS hit FROM e LEFT JOIN b ON b.key = e.key AND b.bar BETWEEN e.bar + 1 AND e.bar + 24 GROUP BY ALL)
SELECT x.key, x.bar, CASE WHEN hit IS NULL THEN 'time' WHEN b.l <= x.o * 0.5 THEN 'stop' ELSE 'target' END AS outcome, CASE WHEN hit IS NULL THEN NULL WHEN b.l <= x.o * 0.5 THEN least(b.o, x.o * 0.5) ELSE greatest(b.o, x.o * 1.5) END AS fill FROM x LEFT JOIN b ON b.key = x.key AND b.bar = x.hit""",
)
def c39_bar_first_touch(t: Tables) -> DataFrame:
    """First bar that touches stop or target: the stop counts first, a gap fills at the open."""
    b = tape.ticks(t("events")).groupBy("key", F.floor(F.col("t") / 3_600_000_000).alias("bar")).agg(F.min_by("value", F.struct("t", "event_id")).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"))
    e = b.where("o > 50").select("key", "bar", "o")
    later = b.select("key", F.col("bar").alias("b"), F.col("o").alias("bo"), "h", "l")
    j = joins.range_join(e, later, ["key"], "bar", "b", 1, 24, how="left")
    stop, hit = F.col("l") <= F.col("o") * 0.5, (F.col("l") <= F.col("o") * 0.5) | (F.col("h") >= F.col("o") * 1.5)
    fill = F.when(stop, F.least("bo", F.col("o") * 0.5)).otherwise(F.greatest("bo", F.col("o") * 1.5))
    x = j.groupBy("key", "bar").agg(F.min_by(F.struct(stop.alias("stop"), fill.alias("fill")), F.when(hit, F.col("b"))).alias("x"))
    return x.select("key", "bar", F.when(F.col("x").isNull(), "time").when(F.col("x.stop"), "stop").otherwise("target").alias("outcome"), F.col("x.fill").alias("fill"))


@query(
    "e5_reverify",
    """WITH q AS (SELECT item_id, item_id * 7919 % (SELECT count(*) FROM documents) AS doc_id, lower(trim(regexp_replace(substr(text, 11, 60), '\\s+', ' ', 'g'))) AS quote FROM benchmark),
h AS (SELECT q.item_id, q.doc_id AS cited, max(d.doc_id) AS latest FROM q JOIN documents d ON contains(lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))), q.quote) WHERE quote <> '' GROUP BY ALL)
SELECT q.item_id, q.doc_id AS cited, h.latest AS points_to, CASE WHEN h.latest IS NULL THEN 'lost' WHEN contains(lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))), q.quote) THEN 'verified' ELSE 'moved' END AS state FROM q LEFT JOIN h ON h.item_id = q.item_id LEFT JOIN documents d ON d.doc_id = q.doc_id""",
)
def e5_reverify(t: Tables) -> DataFrame:
    """Quotes from the middle of benchmark items, each citing some document: found again in the whole text of the one cited, or
    pointed to the latest document that holds them, or lost.

    Quotes and texts meet on four words of the quote, those from its second on (the first may begin inside a word).
    """
    n = t("documents").agg(F.count("*").alias("n"))
    quotes = t("benchmark").crossJoin(F.broadcast(n)).select("item_id", (F.col("item_id") * 7919 % F.col("n")).alias("cited"), X.normal(F.substring("text", 11, 60)).alias("quote"))
    holders = evidence.quote_holders(quotes, t("documents").select("doc_id", X.normal(F.col("text")).alias("body")), "item_id", "quote", "doc_id", "body")
    seen = holders.join(quotes.select("item_id", "cited"), "item_id").groupBy("item_id").agg(F.max("doc_id").alias("points_to"), F.bool_or(F.col("doc_id") == F.col("cited")).alias("same"))
    state = F.when(F.col("points_to").isNull(), "lost").when(F.col("same"), "verified").otherwise("moved")
    return quotes.join(seen, "item_id", "left").select("item_id", "cited", "points_to", state.alias("state"))


@query("t2_two_clocks", "SELECT event_id, (event_id % 40) * 30000000 AS lateness_us, (event_id % 40) * 30 > 600 AS late FROM events")
def t2_two_clocks(t: Tables) -> DataFrame:
    """Lateness of every row, and whether the watermark would miss it."""
    e = t("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    e = e.withColumn("recv", F.timestamp_micros(F.unix_micros("ts") + F.col("event_id") % 40 * 30 * SECOND))
    return live.two_clocks(e, "ts", "recv").select("event_id", "lateness_us", "late")


@query("t3_deduplicated", "SELECT user_id, event_type, CAST(ts AS DATE) AS day FROM events GROUP BY ALL")
def t3_deduplicated(t: Tables) -> DataFrame:
    """The batch result of dropping repeats."""
    return t("events").select("user_id", "event_type", F.to_date("ts").alias("day")).dropDuplicates()


@query("t10_creates_with_snapshots", "SELECT a.event_id, min(b.event_id) AS snapshot FROM events a LEFT JOIN events b ON b.user_id = a.user_id AND b.event_type = 'view' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'signup' GROUP BY a.event_id")
def t10_creates_with_snapshots(t: Tables) -> DataFrame:
    """The batch result of the stream-stream left outer join."""
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    made = e.where("event_type = 'signup'").select("event_id", F.col("user_id").alias("key"), F.col("ts").alias("made"))
    views = e.where("event_type = 'view'").select(F.col("user_id").alias("key"), F.col("ts").alias("taken"), F.col("event_id").alias("snap"))
    out = live.with_snapshots(made, views, "key", "made", "taken", "6 hours")
    return out.groupBy("event_id").agg(F.min("snap").alias("snapshot"))
