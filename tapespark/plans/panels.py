"""Panel, window and statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import grids, joins, scratch, stats
from ..sources import tape
from ..sources.tape import DAILY, DAY, SECOND, TAPE, TICKS
from .registry import Tables, query
from .tape import prints


def daily(t: Tables) -> DataFrame:
    return tape.daily(t("orders"), t("customer"))


_W = "(PARTITION BY symbol ORDER BY day"


@query("w6_zscore", f"WITH {DAILY} SELECT day, symbol, round(CASE WHEN count(close) OVER w >= 10 THEN (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) END, 6) AS z FROM daily WINDOW w AS {_W} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)")
def w6_zscore(t: Tables) -> DataFrame:
    return daily(t).select("day", "symbol", F.round(stats.zscore("close", ["symbol"], ["day"], 30, 10), 6).alias("z"))


@query("w7_trailing_rank", f"WITH {DAILY}, l AS (SELECT day, symbol, close, list(close) OVER ({_W[1:]} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS p FROM daily) SELECT day, symbol, round(CASE WHEN len(p) > 0 THEN (len(list_filter(p, lambda v: v < close)) + 0.5 * len(list_filter(p, lambda v: v = close))) / len(p) END, 6) AS pct FROM l".replace("OVER ((", "OVER (").replace("OVER (PARTITION", "OVER (PARTITION"))
def w7_trailing_rank(t: Tables) -> DataFrame:
    return daily(t).select("day", "symbol", F.round(stats.trailing_rank("close", ["symbol"], ["day"], 20), 6).alias("pct"))


@query("w8_trailing_median", f"WITH {DAILY} SELECT day, symbol, round(quantile_cont(close, 0.5) OVER {_W} ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), 6) AS med FROM daily")
def w8_trailing_median(t: Tables) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(-15, -1)
    return daily(t).select("day", "symbol", F.round(F.percentile("close", 0.5).over(w), 6).alias("med"))


@query("w9_contiguous_mean", f"WITH {DAILY} SELECT day, symbol, round(CASE WHEN day - lag(day, 4) OVER {_W}) = 4 THEN avg(close) OVER {_W} ROWS 4 PRECEDING) * 365 END, 3) AS yearly FROM daily")
def w9_contiguous_mean(t: Tables) -> DataFrame:
    """Mean of five days in a row, only if none is missing, times 365."""
    w = Window.partitionBy("symbol").orderBy("day")
    mean = F.when(F.col("day") - F.lag("day", 4).over(w) == 4, F.avg("close").over(w.rowsBetween(-4, 0)) * 365)
    return daily(t).select("day", "symbol", F.round(mean, 3).alias("yearly"))


@query("w16_forward_fill", f"WITH {TICKS}, g AS (SELECT k.key, d.day FROM (SELECT DISTINCT key FROM ticks) k, (SELECT DISTINCT t // 86400000000 AS day FROM ticks) d) SELECT g.key, g.day, (SELECT arg_max(value, (t, event_id)) FROM ticks q WHERE q.key = g.key AND q.t // 86400000000 <= g.day AND event_type = 'signup') AS last FROM g")
def w16_forward_fill(t: Tables) -> DataFrame:
    """Last known value of every day on a full grid of keys and days: a key's row grows into its days where it is."""
    rows = tape.ticks(t("events")).withColumn("day", F.floor(F.col("t") / DAY))
    days = rows.agg(F.array_sort(F.collect_set("day")).alias("days"))  # one row; a day is a number
    grid = rows.select("key").distinct().crossJoin(F.broadcast(days)).select("key", F.explode("days").alias("day"))
    known = rows.where("event_type = 'signup'").groupBy("key", "day").agg(F.max_by("value", F.struct("t", "event_id")).alias("v"))
    w = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(known, ["key", "day"], "left").select("key", "day", F.last("v", ignorenulls=True).over(w).alias("last"))


@query("w17_rank_buckets", "WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER w AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)) SELECT c_custkey, CAST(greatest(ceil((r - 1) * 5 / greatest(n - 1, 1)) - 1, 0) AS BIGINT) AS bucket FROM r")
def w17_rank_buckets(t: Tables) -> DataFrame:
    w = Window.partitionBy("c_nationkey")
    return t("customer").select("c_custkey", stats.rank_bucket(F.row_number().over(w.orderBy("c_acctbal", "c_custkey")), F.count("*").over(w), 5).alias("bucket"))


_MONTH = "year(DATE '1970-01-01' + CAST(day AS INTEGER)) * 12 + month(DATE '1970-01-01' + CAST(day AS INTEGER))"


@query(
    "w18_universe",
    f"""WITH {DAILY}, v AS (SELECT day, symbol, {_MONTH} AS m, sum(volume) OVER (PARTITION BY symbol ORDER BY day RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING) AS past_vol, count(*) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bars FROM daily),
r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY past_vol DESC, symbol) AS place FROM v WHERE bars >= 60 AND past_vol IS NOT NULL),
months AS (SELECT m, symbol, row_number() OVER (PARTITION BY m ORDER BY round(sum(volume), 2) DESC, symbol) <= 2 AS leads FROM (SELECT *, {_MONTH} AS m FROM daily) GROUP BY m, symbol)
SELECT r.day, r.symbol, place, CASE WHEN place = 1 THEN 'first' WHEN place <= 3 THEN 'second' ELSE 'third' END AS tier, coalesce(leads, false) AS leads_month FROM r LEFT JOIN months ON months.m = r.m - 1 AND months.symbol = r.symbol""",
)
def w18_universe(t: Tables) -> DataFrame:
    """Rank and tier by the volume of the thirty days that end the day before, among symbols with sixty bars before and one that
    day, and whether the symbol was one of the two largest of the month before."""
    own = Window.partitionBy("symbol").orderBy("day")
    date = F.date_from_unix_date(F.col("day").cast("int"))
    d = daily(t).withColumn("m", F.year(date) * 12 + F.month(date))
    v = d.withColumn("trailing", F.sum("volume").over(own.rangeBetween(-30, -1))).withColumn("bars", F.count("*").over(own.rowsBetween(Window.unboundedPreceding, -1))).where("bars >= 60 AND trailing IS NOT NULL")
    r = v.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(F.col("trailing").desc(), "symbol")))
    months = d.groupBy("m", "symbol").agg(F.round(F.sum("volume"), 2).alias("total"))
    months = months.select((F.col("m") + 1).alias("m"), "symbol", (F.row_number().over(Window.partitionBy("m").orderBy(F.col("total").desc(), "symbol")) <= 2).alias("leads"))
    tier = F.when(F.col("place") == 1, "first").when(F.col("place") <= 3, "second").otherwise("third")
    return r.join(months, ["m", "symbol"], "left").select("day", "symbol", "place", tier.alias("tier"), F.coalesce("leads", F.lit(False)).alias("leads_month"))


@query("w22_lag_matrix", f"WITH {DAILY} SELECT day, symbol, " + ", ".join(f"coalesce(lag(close, {k}) OVER {_W}), 0) AS l{k}" for k in (1, 2, 3)) + " FROM daily")
def w22_lag_matrix(t: Tables) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("day")
    return daily(t).select("day", "symbol", *(F.coalesce(F.lag("close", k).over(w), F.lit(0.0)).alias(f"l{k}") for k in (1, 2, 3)))


@query("w32_realised_volatility", f"WITH {DAILY}, r AS (SELECT day, symbol, ln(close / lag(close) OVER {_W})) AS ret FROM daily), v AS (SELECT day, symbol, CASE WHEN count(ret) OVER w >= 20 THEN stddev_samp(ret) OVER w * sqrt(365) END AS vol FROM r WINDOW w AS {_W} ROWS 29 PRECEDING)) SELECT day, symbol, round(vol, 6) AS vol, round((1 / vol) / sum(1 / vol) OVER (PARTITION BY day), 6) AS weight FROM v")
def w32_realised_volatility(t: Tables) -> DataFrame:
    """Yearly volatility of thirty returns and weights that are its inverse."""
    w = Window.partitionBy("symbol").orderBy("day")
    r = daily(t).withColumn("ret", F.log(F.col("close") / F.lag("close").over(w)))
    last = w.rowsBetween(-29, 0)
    v = r.withColumn("vol", F.when(F.count("ret").over(last) >= 20, F.stddev_samp("ret").over(last) * F.sqrt(F.lit(365.0))))
    return v.select("day", "symbol", F.round("vol", 6).alias("vol"), F.round((1 / F.col("vol")) / F.sum(1 / F.col("vol")).over(Window.partitionBy("day")), 6).alias("weight"))


@query("w33_breadth", f"WITH {TICKS} SELECT a.event_id, (SELECT count(DISTINCT key) FROM ticks b WHERE b.event_type = 'purchase' AND b.t > a.t - 3600000000 AND b.t <= a.t) AS breadth FROM ticks a WHERE a.event_type = 'purchase'")
def w33_breadth(t: Tables) -> DataFrame:
    """Distinct keys with an event in the hour up to each event: a key counts from an event until an hour later or its next one, so the
    number is a running sum."""
    e = tape.ticks(t("events")).where("event_type = 'purchase'").select("event_id", "t", "key")
    seen = e.where("key IS NOT NULL AND t IS NOT NULL").select("key", "t").distinct()
    seen = seen.withColumn("until", F.least(F.col("t") + 3600 * SECOND, F.lead("t").over(Window.partitionBy("key").orderBy("t"))))
    ends = F.array(F.struct(F.col("t").alias("x"), F.lit(1).alias("d")), F.struct(F.col("until").alias("x"), F.lit(-1).alias("d")))
    n = stats.levels(e.select("event_id", "t"), "t", seen.select(F.inline(ends)), 3600 * SECOND)
    return n.select("event_id", F.col("level").alias("breadth"))


_CLOCK = (("morning", 8, 12), ("afternoon", 12, 18), ("day", 8, 20))


@query(
    "w31_clock_windows",
    f"""WITH {TICKS}, bars AS (SELECT event_type AS symbol, t // 3600000000 AS h, arg_min(value, (t, event_id)) AS opened, arg_max(value, (t, event_id)) AS closed FROM ticks WHERE value > 0 GROUP BY ALL),
w AS (SELECT symbol, h // 24 AS day, spec, hi - lo AS expected, count(*) AS bars, arg_min(opened, h) AS a, arg_max(closed, h) AS b FROM bars JOIN (VALUES {", ".join(f"('{n}', {lo}, {hi})" for n, lo, hi in _CLOCK)}) v(spec, lo, hi) ON h % 24 >= lo AND h % 24 < hi GROUP BY ALL)
SELECT symbol, day, spec, bars, CASE WHEN bars = expected THEN round(b / a - 1, 6) END AS ret FROM w""",
)
def w31_clock_windows(t: Tables) -> DataFrame:
    """Return between two hours of the day over hourly bars, for three windows; null if any bar is missing."""
    at = F.struct("t", "event_id")
    ticks = tape.ticks(t("events")).where("value > 0")
    bars = ticks.groupBy(F.col("event_type").alias("symbol"), F.floor(F.col("t") / 3_600_000_000).alias("h")).agg(F.min_by("value", at).alias("opened"), F.max_by("value", at).alias("closed"))
    hour = F.col("h") % 24
    specs = F.filter(F.array(*(F.when((hour >= lo) & (hour < hi), F.struct(F.lit(n).alias("spec"), F.lit(hi - lo).alias("expected"))) for n, lo, hi in _CLOCK)), lambda x: x.isNotNull())
    w = bars.select("*", F.floor(F.col("h") / 24).alias("day"), F.explode(specs).alias("s"))
    found = w.groupBy("symbol", "day", "s.spec", "s.expected").agg(F.count("*").alias("bars"), F.min_by("opened", "h").alias("a"), F.max_by("closed", "h").alias("b"))
    return found.select("symbol", "day", "spec", "bars", F.when(F.col("bars") == F.col("expected"), F.round(F.col("b") / F.col("a") - 1, 6)).alias("ret"))


@query("w34_log_changes", f"WITH {DAILY}, c AS (SELECT day, symbol, ln(close / lag(close, 1) OVER {_W})) AS c1, ln(volume / lag(volume, 4) OVER {_W})) AS c4 FROM daily) SELECT day, symbol, " + ", ".join(f"round(CASE WHEN count({c}) OVER w >= 10 THEN ({c} - avg({c}) OVER w) / nullif(stddev_samp({c}) OVER w, 0) END, 6) AS z_{c}" for c in ("c1", "c4")) + f" FROM c WINDOW w AS {_W} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)")
def w34_log_changes(t: Tables) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("day")
    c = daily(t).withColumn("c1", F.log(F.col("close") / F.lag("close", 1).over(w))).withColumn("c4", F.log(F.col("volume") / F.lag("volume", 4).over(w)))
    return c.select("day", "symbol", *(F.round(stats.zscore(x, ["symbol"], ["day"], 30, 10), 6).alias(f"z_{x}") for x in ("c1", "c4")))


@query("w35_agreement_signal", f"WITH {DAILY}, c AS (SELECT day, symbol, close / lag(close, 1) OVER {_W}) - 1 AS a, close / lag(close, 5) OVER {_W}) - 1 AS b FROM daily), s AS (SELECT *, stddev_samp(a) OVER w AS sa, stddev_samp(b) OVER w AS sb, count(b) OVER w AS n FROM c WINDOW w AS {_W} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) SELECT day, symbol, CAST(sign(a) AS DOUBLE) AS side FROM s WHERE n >= 20 AND sign(a) = sign(b) AND abs(a) > 0.5 * sa AND abs(b) > 0.5 * sb")
def w35_agreement_signal(t: Tables) -> DataFrame:
    """All windows agree in sign and exceed half their own deviation."""
    w = Window.partitionBy("symbol").orderBy("day")
    c = daily(t).withColumn("a", F.col("close") / F.lag("close", 1).over(w) - 1).withColumn("b", F.col("close") / F.lag("close", 5).over(w) - 1)
    past = w.rowsBetween(-30, -1)
    s = c.withColumn("sa", F.stddev_samp("a").over(past)).withColumn("sb", F.stddev_samp("b").over(past)).withColumn("n", F.count("b").over(past))
    return s.where("n >= 20 AND sign(a) = sign(b) AND abs(a) > 0.5 * sa AND abs(b) > 0.5 * sb").select("day", "symbol", F.signum("a").alias("side"))


@query("w15_slot_clock", f"WITH {TICKS}, s AS (SELECT key, event_id AS slot, t / 1e6 - 1704067200 AS sec FROM ticks), r AS (SELECT *, regr_slope(sec, slot) OVER w AS b, regr_intercept(sec, slot) OVER w AS a, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY key ORDER BY slot ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING)) SELECT key, slot, round(a + b * slot + 0.5, 3) AS est FROM r WHERE n >= 3")
def w15_slot_clock(t: Tables) -> DataFrame:
    """Time of a slot from a local regression of time on slot, half a second added."""
    s = tape.ticks(t("events")).select("key", F.col("event_id").alias("slot"), (F.col("t") / 1e6 - 1_704_067_200).alias("sec"))
    w = Window.partitionBy("key").orderBy("slot").rowsBetween(-50, 50)
    est = F.regr_intercept("sec", "slot").over(w) + F.regr_slope("sec", "slot").over(w) * F.col("slot") + 0.5
    return s.withColumn("n", F.count("*").over(w)).withColumn("est", F.round(est, 3)).where("n >= 3").select("key", "slot", "est")


@query("a18_lift", f"WITH {TICKS}, g AS (SELECT event_type = 'purchase' AS y, value > 100 AS big, key % 2 = 0 AS even FROM ticks), b AS (SELECT avg(CASE WHEN y THEN 1.0 ELSE 0 END) AS base FROM g), r AS (SELECT 'big' AS name, y FROM g WHERE big UNION ALL SELECT 'even', y FROM g WHERE even UNION ALL SELECT 'all', y FROM g) SELECT name, count(*) AS n, round(avg(CASE WHEN y THEN 1.0 ELSE 0 END), 6) AS rate, round(avg(CASE WHEN y THEN 1.0 ELSE 0 END) / any_value(base), 6) AS lift FROM r, b GROUP BY name")
def a18_lift(t: Tables) -> DataFrame:
    rows = tape.ticks(t("events")).withColumn("y", F.col("event_type") == "purchase")
    out = stats.lift(rows, "y", {"big": F.col("value") > 100, "even": F.col("key") % 2 == 0})
    return out.withColumns({c: F.round(c, 6) for c in ("rate", "lift")})


@query(
    "a19_quantile_table",
    """WITH u AS (SELECT 'balance' AS feature, c_acctbal AS x, c_mktsegment = 'BUILDING' AS y, c_custkey AS id FROM customer UNION ALL SELECT 'nation', c_nationkey, c_mktsegment = 'BUILDING', c_custkey FROM customer UNION ALL SELECT 'rare', CASE WHEN c_custkey < 40 THEN c_acctbal END, c_mktsegment = 'BUILDING', c_custkey FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY x, id) AS r, count(*) OVER (PARTITION BY feature) AS n FROM u WHERE x IS NOT NULL),
b AS (SELECT *, CAST(greatest(ceil((r - 1) * 5 / greatest(n - 1, 1)) - 1, 0) AS BIGINT) AS bucket FROM r WHERE n >= 50)
SELECT feature, bucket, count(*) AS n, round(min(x), 4) AS low, round(max(x), 4) AS high, round(avg(CASE WHEN y THEN 1.0 ELSE 0 END), 6) AS rate, round(quantile_cont(x, 0.5), 4) AS median FROM b GROUP BY ALL""",
)
def a19_quantile_table(t: Tables) -> DataFrame:
    """Bounds, n, outcome rate and median per fifth of every feature with fifty values or more."""
    c = t("customer").select(F.col("c_custkey").alias("id"), (F.col("c_mktsegment") == "BUILDING").cast("double").alias("y"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"), F.when(F.col("c_custkey") < 40, F.col("c_acctbal")).alias("rare"))
    u = c.unpivot(["id", "y"], ["balance", "nation", "rare"], "feature", "x").where("x IS NOT NULL")
    r = scratch.written(stats.placed(u, "x", ["id"], ["feature"]).where("of >= 50").withColumn("bucket", stats.rank_bucket(F.col("place"), F.col("of"), 5)), "buckets")
    g = r.groupBy("feature", "bucket").agg(F.count("*").alias("n"), F.min("place").alias("p"), F.round(F.min("x"), 4).alias("low"), F.round(F.max("x"), 4).alias("high"), F.round(F.avg("y"), 6).alias("rate"))
    # a bucket is a run of places: its median is the mean of the one or two in the middle
    middle = r.join(F.broadcast(g.select("feature", "bucket", "n", "p")), ["feature", "bucket"]).where("2 * (place - p) BETWEEN n - 2 AND n")
    return g.drop("p").join(middle.groupBy("feature", "bucket").agg(F.round(F.avg("x"), 4).alias("median")), ["feature", "bucket"])




_TIMED = "WITH p AS (SELECT d.doc_id, quality AS human, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS model, CASE WHEN d.doc_id % 5 > 0 THEN d.doc_id % 60 END AS human_t, n_chars % 90 AS model_t FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _decisions(t: Tables) -> DataFrame:
    timed = [F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 60).alias("human_t"), (F.col("n_chars") % 90).alias("model_t")]
    return t("labels").join(t("documents"), "doc_id").select("doc_id", F.col("quality").alias("human"), F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("model"), *timed)


@query(
    "a20_agreement",
    f"""{_TIMED}, s AS (SELECT count(*) AS n, count(*) FILTER (human = model) AS same, count(*) FILTER (human = 1 AND model = 1) AS tp, count(*) FILTER (model = 1) AS mp, count(*) FILTER (human = 1) AS hp FROM p),
d AS (SELECT model_t - human_t AS x, row_number() OVER (ORDER BY model_t - human_t) AS i, count(*) OVER () AS m FROM p WHERE human = 1 AND model = 1 AND human_t IS NOT NULL),
q AS (SELECT k, m, least(greatest(k * (m + 1) // 4, 1), m - 1) AS j FROM (SELECT DISTINCT m FROM d), range(1, 4) r(k)),
v AS (SELECT k, (a.x * (4 - (k * (q.m + 1) - 4 * j)) + b.x * (k * (q.m + 1) - 4 * j)) / 4 AS q FROM q JOIN d a ON a.i = j JOIN d b ON b.i = j + 1)
SELECT n, round(same / n, 6) AS agreement, round(tp / mp, 6) AS precision, round(tp / hp, 6) AS recall, round(2 * (tp / mp) * (tp / hp) / (tp / mp + tp / hp), 6) AS f1, round(hp / n, 6) AS base_rate, (SELECT max(m) FROM d) AS timing_n, (SELECT q FROM v WHERE k = 2) AS timing_median, (SELECT max(q) - min(q) FROM v) AS timing_iqr FROM s""",
)
def a20_agreement(t: Tables) -> DataFrame:
    """Agreement of two labels, and how much later the model's choice comes where both are positive: median and quartile range."""
    rows = _decisions(t)
    out = stats.agreement(rows, "human", "model", 1).withColumns({c: F.round(c, 6) for c in ("agreement", "precision", "recall", "f1", "base_rate")})
    late = stats.quartiles(rows.where("human = 1 AND model = 1").withColumn("x", F.col("model_t") - F.col("human_t")), "x", ["doc_id"])
    return out.crossJoin(late.select(F.col("n").alias("timing_n"), F.col("median").alias("timing_median"), (F.col("q3") - F.col("q1")).alias("timing_iqr")))  # one row each


@query("a20_confusion", f"{_TIMED}, l AS (SELECT human AS x FROM p UNION SELECT model FROM p) SELECT a.x AS human, b.x AS model, count(p.human) AS n FROM l a CROSS JOIN l b LEFT JOIN p ON p.human = a.x AND p.model = b.x GROUP BY ALL")
def a20_confusion(t: Tables) -> DataFrame:
    """How often each label of one is which of the other."""
    return stats.confusion(_decisions(t), "human", "model")


@query("a21_auc", "WITH p AS (SELECT quality AS y, n_chars AS s FROM labels l JOIN documents d ON l.doc_id = d.doc_id) SELECT round(sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / count(*), 8) AS auc FROM p a JOIN p b ON a.y = 1 AND b.y = 0")
def a21_auc(t: Tables) -> DataFrame:
    rows = t("labels").join(t("documents"), "doc_id").select("quality", "n_chars")
    return stats.auc(rows, "n_chars", "quality").select(F.round("auc", 8).alias("auc"))


@query(
    "a22_sign_test",
    """WITH b AS (SELECT user_id, count(*) FILTER (value > 50) AS k, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, k, n, round(least(1.0, 2 * list_sum(list_transform(range(0, least(k, n - k) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))), 9) AS p, round(least(1.0, list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))), 9) AS p_more FROM b""",
)
def a22_sign_test(t: Tables) -> DataFrame:
    """Sign test of each user's values over 50, and the chance of as many or more."""
    by = t("events").groupBy("user_id").agg(F.count_if(F.col("value") > 50).alias("k"), F.count("*").alias("n"))
    return by.select("user_id", "k", "n", F.round(stats.sign_test(F.col("k"), F.col("n")), 9).alias("p"), F.round(stats.binomial_tail(F.col("k"), F.col("n")), 9).alias("p_more"))


_POISSON = " ".join(f"WHEN u < {edge!r}::DOUBLE THEN {k}" for k, edge in enumerate(float(x) for x in stats.poisson_limits()))


@query(
    "a23_bootstrap",
    f"""WITH c AS (SELECT user_id % 1000003 AS key, coalesce(sum(value) FILTER (event_type <> 'purchase'), 0) AS s0, count(value) FILTER (event_type <> 'purchase') AS c0, coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS s1, count(value) FILTER (event_type = 'purchase') AS c1 FROM events GROUP BY user_id),
x0 AS (SELECT *, (key * 104729 + draw * 7919 + 7) % 1000003 AS x FROM c, range(1, 501) d(draw)), x1 AS (SELECT * REPLACE ((x * x + draw * 15487 + key) % 1000003 AS x) FROM x0), x2 AS (SELECT * REPLACE ((x * x + draw * 30974 + key) % 1000003 AS x) FROM x1), x3 AS (SELECT *, ((x * x + draw * 46461 + key) % 1000003 + 0.5::DOUBLE) / 1000003 AS u FROM x2),
k AS (SELECT *, CASE {_POISSON} ELSE 7 END AS k FROM x3), d AS (SELECT draw, sum(s1 * k) / nullif(sum(c1 * k), 0) - sum(s0 * k) / nullif(sum(c0 * k), 0) AS d FROM k GROUP BY draw)
SELECT round((SELECT sum(s1) / sum(c1) - sum(s0) / sum(c0) FROM c), 8) AS difference, round(quantile_cont(d, 0.05), 8) AS low, round(quantile_cont(d, 0.95), 8) AS high FROM d""",
)
def a23_bootstrap(t: Tables) -> DataFrame:
    """Difference in means of two kinds of events and its interval over resampled users."""
    rows = t("events").select("value", F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("arm"), "user_id")
    return stats.bootstrap_difference(rows, "value", "arm", "user_id", 500, 7).select(*(F.round(c, 8).alias(c) for c in ("difference", "low", "high")))


@query("a24_imbalance", f"WITH {TICKS}, q AS (SELECT key, t // 21600000000 AS bar, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS b, sum(value) AS v FROM ticks GROUP BY ALL) SELECT key, bar, round(b / nullif(v, 0), 6) AS imb, round(CASE WHEN count(b / nullif(v, 0)) OVER w >= 3 THEN avg(b / nullif(v, 0)) OVER w END, 6) AS mean FROM q WINDOW w AS (PARTITION BY key ORDER BY bar ROWS 7 PRECEDING)")
def a24_imbalance(t: Tables) -> DataFrame:
    q = tape.ticks(t("events")).groupBy("key", F.floor(F.col("t") / 21_600_000_000).alias("bar")).agg(F.sum(F.when(F.col("event_type") == "click", F.col("value")).otherwise(0.0)).alias("b"), F.sum("value").alias("v"))
    x = F.col("b") / F.nullif(F.col("v"), F.lit(0.0))
    w = Window.partitionBy("key").orderBy("bar").rowsBetween(-7, 0)
    return q.select("key", "bar", F.round(x, 6).alias("imb"), F.round(F.when(F.count(x).over(w) >= 3, F.avg(x).over(w)), 6).alias("mean"))


@query("a25_minute_panel", f"WITH {TAPE} SELECT mint, recv // 86400000000 AS bar, arg_max(vsol / vtok, (recv, seq)) AS last, count(*) AS n, round(sum(sol), 2) AS volume FROM tape GROUP BY ALL")
def a25_minute_panel(t: Tables) -> DataFrame:
    return prints(t).groupBy("mint", F.floor(F.col("recv") / DAY).alias("bar")).agg(F.max_by(F.col("vsol") / F.col("vtok"), F.struct("recv", "seq")).alias("last"), F.count("*").alias("n"), F.round(F.sum("sol"), 2).alias("volume"))


@query("a26_index_returns", f"WITH {DAILY}, r AS (SELECT day, symbol, CASE WHEN day - lag(day) OVER w = 1 THEN greatest(least(ln(close / lag(close) OVER w), 0.5), -0.5) END AS ret FROM daily WINDOW w AS {_W})) SELECT day, round(avg(ret), 8) AS mean, round(quantile_cont(ret, 0.5), 8) AS median, count(ret) AS n FROM r WHERE ret IS NOT NULL GROUP BY day")
def a26_index_returns(t: Tables) -> DataFrame:
    """Equal-weight index of clipped log returns between adjacent days."""
    w = Window.partitionBy("symbol").orderBy("day")
    ret = F.when(F.col("day") - F.lag("day").over(w) == 1, F.greatest(F.least(F.log(F.col("close") / F.lag("close").over(w)), F.lit(0.5)), F.lit(-0.5)))
    return daily(t).withColumn("ret", ret).where("ret IS NOT NULL").groupBy("day").agg(F.round(F.avg("ret"), 8).alias("mean"), F.round(F.percentile("ret", 0.5), 8).alias("median"), F.count("ret").alias("n"))


@query("a27_cross_correlation", f"WITH {DAILY}, x AS (SELECT day, max(close) FILTER (symbol = 'BUILDING') AS a, max(close) FILTER (symbol = 'MACHINERY') AS b FROM daily GROUP BY day) SELECT k AS lag, round(corr(x.a, y.b), 6) AS r, count(*) AS n FROM range(-3, 4) g(k), x JOIN x y ON y.day = x.day + k WHERE x.a IS NOT NULL AND y.b IS NOT NULL GROUP BY k")
def a27_cross_correlation(t: Tables) -> DataFrame:
    """Correlation of two series at lags, on complete pairs: one equi-join per day and lag."""
    of = lambda s: F.max(F.when(F.col("symbol") == s, F.col("close")))
    x = daily(t).groupBy("day").agg(of("BUILDING").alias("a"), of("MACHINERY").alias("b"))
    left = x.select(F.explode(F.sequence(F.lit(-3).cast("long"), F.lit(3).cast("long"))).alias("lag"), "day", "a").withColumn("day", F.col("day") + F.col("lag"))
    j = left.join(x.select("day", "b"), "day").where("a IS NOT NULL AND b IS NOT NULL")
    return j.groupBy("lag").agg(F.round(F.corr("a", "b"), 6).alias("r"), F.count("*").alias("n"))


@query("a28_newey_west")
def a28_newey_west(t: Tables) -> DataFrame:
    """Order value on the last two days' values with Newey-West errors over three lags."""
    d = daily(t).groupBy("day").agg(F.sum("volume").alias("v"))
    w = Window.orderBy("day")
    d = d.select("day", "v", F.lag("v", 1).over(w).alias("v1"), F.lag("v", 2).over(w).alias("v2")).where("v2 IS NOT NULL")
    return stats.ols(d, "v", ["v1", "v2"], lags=3, order=["day"])


@query(
    "a29_cluster_ols",
    """WITH o AS (SELECT o_totalprice AS y, c_acctbal AS x, c_nationkey AS g FROM orders JOIN customer ON o_custkey = c_custkey), s AS (SELECT count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM o),
b AS (SELECT *, n * sxx - sx * sx AS det, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1, (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS b0 FROM s), c AS (SELECT g, sum(y - b0 - b1 * x) AS s0, sum((y - b0 - b1 * x) * x) AS s1 FROM o, b GROUP BY g), m AS (SELECT count(*) AS k, sum(s0 * s0) AS m00, sum(s0 * s1) AS m01, sum(s1 * s1) AS m11 FROM c),
v AS (SELECT b0, b1, k / (k - 1) * (n - 1) / (n - 2) * (sxx * sxx * m00 - 2 * sxx * sx * m01 + sx * sx * m11) / (det * det) AS v0, k / (k - 1) * (n - 1) / (n - 2) * (sx * sx * m00 - 2 * sx * n * m01 + n * n * m11) / (det * det) AS v1 FROM b, m)
SELECT 'const' AS name, round(b0, 3) AS coef, round(sqrt(v0), 3) AS se, round(b0 / sqrt(v0), 3) AS t FROM v UNION ALL SELECT 'c_acctbal', round(b1, 3), round(sqrt(v1), 3), round(b1 / sqrt(v1), 3) FROM v""",
)
def a29_cluster_ols(t: Tables) -> DataFrame:
    """Order value on the customer's balance, errors clustered by nation."""
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    fit = stats.ols(o.select("o_totalprice", "c_acctbal", "c_nationkey"), "o_totalprice", ["c_acctbal"], cluster="c_nationkey")
    return fit.select("name", *(F.round(c, 3).alias(c) for c in ("coef", "se", "t")))


@query("a30_simple_ols", "SELECT c_mktsegment, round(regr_slope(o_totalprice, c_acctbal), 8) AS beta, round(regr_intercept(o_totalprice, c_acctbal), 4) AS alpha, round(regr_r2(o_totalprice, c_acctbal), 8) AS r2, regr_count(o_totalprice, c_acctbal)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def a30_simple_ols(t: Tables) -> DataFrame:
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    y, x = "o_totalprice", "c_acctbal"
    return o.groupBy("c_mktsegment").agg(F.round(F.regr_slope(y, x), 8).alias("beta"), F.round(F.regr_intercept(y, x), 4).alias("alpha"), F.round(F.regr_r2(y, x), 8).alias("r2"), F.regr_count(y, x).alias("n"))


@query("a31_rolling_beta", f"WITH {DAILY}, x AS (SELECT day, avg(close) AS mkt FROM daily GROUP BY day), j AS (SELECT d.day, symbol, close, mkt FROM daily d JOIN x ON x.day = d.day) SELECT day, symbol, round(CASE WHEN count(*) OVER w >= 20 THEN covar_pop(close, mkt) OVER w / nullif(var_pop(mkt) OVER w, 0) END, 6) AS beta FROM j WINDOW w AS {_W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)")
def a31_rolling_beta(t: Tables) -> DataFrame:
    d = daily(t)
    j = d.join(d.groupBy("day").agg(F.avg("close").alias("mkt")), "day")
    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(-60, -1)
    beta = F.covar_pop("close", "mkt").over(w) / F.nullif(F.var_pop("mkt").over(w), F.lit(0.0))
    return j.select("day", "symbol", F.round(F.when(F.count("*").over(w) >= 20, beta), 6).alias("beta"))


@query("a34_clock_profile", f"WITH {TICKS}, c AS (SELECT (t // 3600000000) % 24 AS hour, (t // 900000000) % 4 AS quarter, count(*) AS n, sum(value) AS v FROM ticks GROUP BY ALL), g AS (SELECT h AS hour, q AS quarter, coalesce(n, 0) AS n, coalesce(v, 0) AS v FROM range(24) a(h), range(4) b(q) LEFT JOIN c ON c.hour = h AND c.quarter = q) SELECT hour, quarter, n, round(v / nullif(avg(v) OVER (PARTITION BY hour), 0), 6) AS ratio FROM g")
def a34_clock_profile(t: Tables) -> DataFrame:
    """Value by quarter of the hour over its hour's mean, on a full grid."""
    h, q = F.floor(F.col("t") / 3_600_000_000) % 24, F.floor(F.col("t") / 900_000_000) % 4
    c = tape.ticks(t("events")).groupBy(h.alias("hour"), q.alias("quarter")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    grid = t.spark.range(96).select(F.floor(F.col("id") / 4).alias("hour"), (F.col("id") % 4).alias("quarter"))
    g = grid.join(c, ["hour", "quarter"], "left").fillna(0, ["n", "v"])
    return g.select("hour", "quarter", "n", F.round(F.col("v") / F.nullif(F.avg("v").over(Window.partitionBy("hour")), F.lit(0.0)), 6).alias("ratio"))


@query("a35_placebo_rank", f"WITH {TICKS}, a AS (SELECT (t // 3600000000) % 24 AS arm, avg(value) AS m FROM ticks GROUP BY 1), s AS (SELECT sum(m) AS t, sum(m * m) AS tt, count(*) AS n FROM a) SELECT arm, round(m, 6) AS m, rank() OVER (ORDER BY m DESC) AS r, round((t - m) / (n - 1), 6) AS others FROM a, s")
def a35_placebo_rank(t: Tables) -> DataFrame:
    """Each hour ranked among the 24, with the mean of the others."""
    a = tape.ticks(t("events")).groupBy((F.floor(F.col("t") / 3_600_000_000) % 24).alias("arm")).agg(F.avg("value").alias("m"))
    w = Window.partitionBy()
    return a.select("arm", F.round("m", 6).alias("m"), F.rank().over(Window.orderBy(F.col("m").desc())).cast("long").alias("r"), F.round((F.sum("m").over(w) - F.col("m")) / (F.count("*").over(w) - 1), 6).alias("others"))


@query(
    "a37_poll_coverage",
    f"""WITH {TICKS}, g AS (SELECT key, t, value, (t - lag(t) OVER (PARTITION BY key ORDER BY t, event_id)) / 1e6 AS gap FROM ticks), h AS (SELECT key, avg(m) AS hourly FROM (SELECT key, t // 3600000000 AS hour, avg(value) AS m FROM g GROUP BY ALL) GROUP BY key)
SELECT g.key, round(quantile_cont(gap, 0.5), 4) AS median_gap, round(quantile_cont(gap, 0.95), 4) AS p95_gap, round(any_value(hourly), 7) AS hourly_mean, count(*) FILTER (value >= 50) AS over_50, count(*) FILTER (value >= 100) AS over_100, count(*) FILTER (value >= 200) AS over_200, (max(t) - min(t)) // 1000000 AS on_list_s FROM g JOIN h ON h.key = g.key GROUP BY g.key""",
)
def a37_poll_coverage(t: Tables) -> DataFrame:
    """Per key: gaps between polls, mean of the hourly means, how often the value was over levels, and for how long it was listed."""
    g = tape.ticks(t("events")).withColumn("gap", (F.col("t") - F.lag("t").over(Window.partitionBy("key").orderBy("t", "event_id"))) / 1e6)
    hourly = g.groupBy("key", F.floor(F.col("t") / 3_600_000_000).alias("hour")).agg(F.avg("value").alias("m")).groupBy("key").agg(F.round(F.avg("m"), 7).alias("hourly_mean"))
    levels = [F.count_if(F.col("value") >= v).alias(f"over_{v}") for v in (50, 100, 200)]
    out = g.groupBy("key").agg(F.round(F.percentile("gap", 0.5), 4).alias("median_gap"), F.round(F.percentile("gap", 0.95), 4).alias("p95_gap"), *levels, F.floor((F.max("t") - F.min("t")) / 1_000_000).alias("on_list_s"))
    return out.join(hourly, "key")


@query("a42_period_stats", "WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value - 50) AS x FROM events GROUP BY ALL) SELECT event_type, count(*) AS days, round(avg(x) / stddev_samp(x) * sqrt(count(*)), 6) AS t_stat, round(avg(x) / stddev_samp(x) * sqrt(52), 6) AS sharpe, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0 END), 6) AS up FROM d GROUP BY event_type")
def a42_period_stats(t: Tables) -> DataFrame:
    d = t("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum(F.col("value") - 50).alias("x"))
    ratio = F.avg("x") / F.stddev_samp("x")
    return d.groupBy("event_type").agg(F.count("*").alias("days"), F.round(ratio * F.sqrt(F.count("*")), 6).alias("t_stat"), F.round(ratio * F.sqrt(F.lit(52.0)), 6).alias("sharpe"), F.round(F.avg((F.col("x") > 0).cast("double")), 6).alias("up"))


@query("a48_information_coefficient", f"WITH {DAILY}, s AS (SELECT day, symbol, close / lag(close, 3) OVER w - 1 AS sig, lead(close) OVER w / close - 1 AS fwd, CASE WHEN day < 9500 THEN 1 ELSE 2 END AS half FROM daily WINDOW w AS {_W})) SELECT half, round(corr(sig, fwd), 6) AS ic, count(*) AS n FROM s WHERE sig IS NOT NULL AND fwd IS NOT NULL GROUP BY GROUPING SETS ((half), ())")
def a48_information_coefficient(t: Tables) -> DataFrame:
    """Correlation of a signal with the next return, by half and over all."""
    w = Window.partitionBy("symbol").orderBy("day")
    s = daily(t).withColumn("sig", F.col("close") / F.lag("close", 3).over(w) - 1).withColumn("fwd", F.lead("close").over(w) / F.col("close") - 1).withColumn("half", F.when(F.col("day") < 9500, 1).otherwise(2)).where("sig IS NOT NULL AND fwd IS NOT NULL")
    return s.groupingSets([["half"], []], "half").agg(F.round(F.corr("sig", "fwd"), 6).alias("ic"), F.count("*").alias("n"))


EVENTS = "events_of AS (SELECT day, symbol FROM (SELECT day, symbol, volume, max(volume) OVER w AS high, count(*) OVER w AS k FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) WHERE k = 20 AND volume > high)"


def event_days(d: DataFrame) -> DataFrame:
    """(symbol, day) where a symbol's volume is over that of each of the twenty days before: as rare at any amount of data."""
    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(-20, -1)
    return d.withColumn("high", F.max("volume").over(w)).withColumn("k", F.count("*").over(w)).where("k = 20 AND volume > high").select("symbol", "day")


@query("a49_placebo_draw", f"WITH {DAILY}, {EVENTS}, c AS (SELECT d.symbol, d.day, d.close, row_number() OVER (PARTITION BY d.symbol ORDER BY (d.day * 7919) % 10007, d.day) AS r FROM daily d WHERE NOT EXISTS (SELECT 1 FROM events_of e WHERE e.symbol = d.symbol AND e.day = d.day)) SELECT symbol, count(*) AS n, round(avg(close), 4) AS mean FROM c WHERE r <= 20 GROUP BY symbol")
def a49_placebo_draw(t: Tables) -> DataFrame:
    """Days without an event, drawn by a keyed order, and their mean."""
    d = daily(t)
    c = d.join(event_days(d), ["symbol", "day"], "left_anti").withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy((F.col("day") * 7919) % 10_007, "day")))
    return c.where("r <= 20").groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.avg("close"), 4).alias("mean"))


@query("s18_second_grid", f"WITH {TICKS}, s AS (SELECT key, (t // 3600000000) AS slot, arg_max(value, (t, event_id)) AS v, count(*) AS n FROM ticks GROUP BY ALL), g AS (SELECT k.key, x AS slot FROM (SELECT key, min(slot) AS a, max(slot) AS b FROM s GROUP BY key) k, LATERAL (SELECT unnest(generate_series(k.a, k.b)) AS x)) SELECT g.key, g.slot, (SELECT arg_max(v, slot) FROM s WHERE s.key = g.key AND s.slot <= g.slot) AS last, coalesce(s.n, 0) AS n FROM g LEFT JOIN s ON s.key = g.key AND s.slot = g.slot")
def s18_second_grid(t: Tables) -> DataFrame:
    """Last print of every slot on a full grid, filled forward, with counts."""
    s = tape.ticks(t("events")).groupBy("key", F.floor(F.col("t") / 3_600_000_000).alias("slot")).agg(F.max_by("value", F.struct("t", "event_id")).alias("v"), F.count("*").alias("n"))
    grid = s.groupBy("key").agg(F.min("slot").alias("a"), F.max("slot").alias("b")).select("key", F.explode(F.sequence("a", "b")).alias("slot"))
    w = Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(s, ["key", "slot"], "left").select("key", "slot", F.last("v", ignorenulls=True).over(w).alias("last"), F.coalesce("n", F.lit(0)).alias("n"))


@query("s19_quarter_rows", f"WITH {TICKS}, q AS (SELECT (t // 900000000) % 96 AS quarter, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS buys, sum(CASE WHEN event_type <> 'click' THEN value ELSE 0 END) AS sells, count(*) FILTER (t % 900000000 < 60000000) AS early FROM ticks GROUP BY 1) SELECT g.q AS quarter, round(coalesce(buys, 0), 4) AS buys, round(coalesce(sells, 0), 4) AS sells, coalesce(early, 0) AS early FROM range(96) g(q) LEFT JOIN q ON q.quarter = g.q")
def s19_quarter_rows(t: Tables) -> DataFrame:
    """96 quarter-hour rows, zero-filled."""
    x, click = F.col("value"), F.col("event_type") == "click"
    q = tape.ticks(t("events")).groupBy((F.floor(F.col("t") / 900_000_000) % 96).alias("quarter")).agg(F.sum(F.when(click, x).otherwise(0.0)).alias("buys"), F.sum(F.when(~click, x).otherwise(0.0)).alias("sells"), F.count_if(F.col("t") % 900_000_000 < 60 * SECOND).alias("early"))
    g = t.spark.range(96).withColumnRenamed("id", "quarter").join(q, "quarter", "left").fillna(0)
    return g.select("quarter", F.round("buys", 4).alias("buys"), F.round("sells", 4).alias("sells"), "early")


@query("s20_daily_panel", f"WITH {DAILY} SELECT day, symbol, close, volume FROM daily WHERE day <= 10400 AND symbol NOT IN ('HOUSEHOLD')")
def s20_daily_panel(t: Tables) -> DataFrame:
    """A long panel up to a last day, without excluded symbols."""
    return daily(t).where("day <= 10400 AND symbol <> 'HOUSEHOLD'").select("day", "symbol", "close", "volume")


@query("s21_settlement_windows", f"WITH {TICKS}, f AS (SELECT DISTINCT key, t AS at_t FROM ticks WHERE event_type = 'signup') SELECT event_id FROM ticks k WHERE EXISTS (SELECT 1 FROM f WHERE f.key = k.key AND k.t BETWEEN f.at_t - 3600000000 AND f.at_t + 3600000000)")
def s21_settlement_windows(t: Tables) -> DataFrame:
    """Rows within an hour of a settlement of their key."""
    ticks = tape.ticks(t("events"))
    f = ticks.where("event_type = 'signup'").select("key", F.col("t").alias("at_t")).distinct()
    rows = ticks.select("event_id", "key", "t")
    return joins.range_join(rows, f, ["key"], "t", "at_t", -3600 * SECOND, 3600 * SECOND).select("event_id").distinct()


@query("c29_period_returns", f"WITH {DAILY}, s AS (SELECT day, symbol, close / lag(close, 5) OVER w - 1 AS sig, lead(close) OVER w / close - 1 AS fwd FROM daily WINDOW w AS {_W})), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY sig DESC, symbol) AS hi, row_number() OVER (PARTITION BY day ORDER BY sig, symbol) AS lo FROM s WHERE sig IS NOT NULL AND fwd IS NOT NULL) SELECT day, round(avg(fwd) FILTER (hi <= 2) - avg(fwd) FILTER (lo <= 2), 8) AS spread FROM r GROUP BY day HAVING count(*) >= 4")
def c29_period_returns(t: Tables) -> DataFrame:
    """Next return of the two best less that of the two worst by a five-day signal."""
    w = Window.partitionBy("symbol").orderBy("day")
    s = daily(t).withColumn("sig", F.col("close") / F.lag("close", 5).over(w) - 1).withColumn("fwd", F.lead("close").over(w) / F.col("close") - 1).where("sig IS NOT NULL AND fwd IS NOT NULL")
    d = Window.partitionBy("day")
    r = s.withColumn("hi", F.row_number().over(d.orderBy(F.col("sig").desc(), "symbol"))).withColumn("lo", F.row_number().over(d.orderBy("sig", "symbol")))
    return r.groupBy("day").agg(F.round(F.avg(F.when(F.col("hi") <= 2, F.col("fwd"))) - F.avg(F.when(F.col("lo") <= 2, F.col("fwd"))), 8).alias("spread"), F.count("*").alias("n")).where("n >= 4").drop("n")


@query("c25_round_levels", f"WITH {TAPE}, l AS (SELECT mint, sol, lag(sol) OVER (PARTITION BY mint ORDER BY recv, seq) AS before, buy FROM tape) SELECT level, count(*) FILTER (before < level AND sol >= level) AS crossings, round(avg(CASE WHEN NOT buy THEN 1.0 ELSE 0 END) FILTER (sol BETWEEN level * 0.9 AND level), 6) AS sell_below, round(avg(CASE WHEN NOT buy THEN 1.0 ELSE 0 END) FILTER (sol BETWEEN level AND level * 1.1), 6) AS sell_above FROM l, (VALUES (20000), (40000), (60000)) v(level) GROUP BY level")
def c25_round_levels(t: Tables) -> DataFrame:
    """Crossings of round levels and the share of sells below and above them."""
    l = prints(t).withColumn("before", F.lag("sol").over(Window.partitionBy("mint").orderBy("recv", "seq"))).select("sol", "before", "buy", F.explode(F.array(*map(F.lit, (20_000, 40_000, 60_000)))).alias("level"))
    s, v = F.col("sol"), F.col("level")
    sell = (~F.col("buy")).cast("double")
    return l.groupBy("level").agg(F.count_if((F.col("before") < v) & (s >= v)).alias("crossings"), F.round(F.avg(F.when(s.between(v * 0.9, v), sell)), 6).alias("sell_below"), F.round(F.avg(F.when(s.between(v, v * 1.1), sell)), 6).alias("sell_above"))


_GRID = {"sol": [1000, 10_000, 25_000, 40_000, 55_000], "px": [0, 500, 1500, 3000], "margin": [0.0, 0.02, 0.05, 0.08], "bought": [0, 1]}
_RULES = ", ".join(f"(VALUES {', '.join(f'({v}::DOUBLE)' for v in values)}) r{k}({name}_at)" for k, (name, values) in enumerate(_GRID.items()))


@query(
    "m4_rule_grid",
    f"""WITH {TAPE}, c AS (SELECT sol, vsol / vtok AS px, 0.1 - discount AS margin, buy::INT AS bought, tok, recv < 820454400000000 AS train FROM tape),
g AS (SELECT sol_at AS sol, px_at AS px, margin_at AS margin, bought_at AS bought, count(*) FILTER (train) AS n_train, count(*) FILTER (NOT train) AS n_valid, avg(tok) FILTER (train) AS m, avg(tok) FILTER (NOT train) AS v FROM c, {_RULES} WHERE {" AND ".join(f"{n} >= {n}_at" for n in _GRID)} GROUP BY ALL HAVING count(*) FILTER (train) >= 15)
SELECT sol, px, margin, bought, n_train, n_valid, round(m, 6) AS train_mean, round(v, 6) AS valid_mean, rank() OVER (ORDER BY round(m, 6) DESC) AS place FROM g""",
)
def m4_rule_grid(t: Tables) -> DataFrame:
    """160 threshold rules, train and validation side by side, those of 15 rows or more by their mean in training. One pass over the
    rows; what is ordered is the rules."""
    c = prints(t).withColumns({"px": F.col("vsol") / F.col("vtok"), "margin": 0.1 - F.col("discount"), "bought": F.col("buy").cast("int")})
    train, x = F.col("recv") < 820_454_400_000_000, F.col("tok")
    of = lambda side, v: F.when(side, v).otherwise(v * 0)
    g = grids.rule_grid(c, _GRID, {"n_train": of(train, F.lit(1)), "n_valid": of(~train, F.lit(1)), "s": of(train, x), "z": of(~train, x)}).where("n_train >= 15")
    g = g.select(*_GRID, "n_train", "n_valid", F.round(F.col("s") / F.col("n_train"), 6).alias("train_mean"), F.round(F.col("z") / F.nullif(F.col("n_valid"), F.lit(0)), 6).alias("valid_mean"))
    return g.withColumn("place", F.rank().over(Window.orderBy(F.desc("train_mean"))))
