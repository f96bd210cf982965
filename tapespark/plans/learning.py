"""Queries that train models, stream over tables, or decode logs derived from tables; most have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import learning, stats
from ..sources import feeds
from ..streaming import live
from .registry import Tables, query
from .tape import prints


def _features(t: Tables) -> DataFrame:
    d = t("documents").join(t("labels"), "doc_id")
    text = F.col("text")
    count = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))).cast("double")
    return d.select("doc_id", "source", "lang", F.col("quality").cast("double").alias("y"), F.length(text).cast("double").alias("chars"), (count("[%*#&$]") / F.length(text)).alias("junk"), (count("[.]") / F.length(text)).alias("stops"), (count("[A-Z]") / F.length(text)).alias("upper"))


_X = ["chars", "junk", "stops", "upper"]


@query("m1_boosted_regression")
def m1_boosted_regression(t: Tables) -> DataFrame:
    """Out-of-fold predictions, then the first document per source over the 80% quantile."""
    pred = learning.out_of_fold(_features(t), _X, "y", "source")
    return learning.above_quantile(pred, "pred", 0.8, "source", ["doc_id"]).select("source", "doc_id", F.round("pred", 6).alias("pred"))


@query("m2_boosted_classifier")
def m2_boosted_classifier(t: Tables) -> DataFrame:
    """Out-of-fold probabilities and their area under the curve."""
    pred = learning.out_of_fold(_features(t), _X, "y", "source", classify=True)
    return stats.auc(pred, "pred", "y").crossJoin(pred.agg(F.count("*").alias("n")))  # one row each


@query("m3_balanced_logistic")
def m3_balanced_logistic(t: Tables) -> DataFrame:
    """Trained on two thirds of the documents by id, capture of the best two per source on the rest."""
    rows = _features(t)
    train, test = rows.where("doc_id % 3 <> 0"), rows.where("doc_id % 3 = 0")
    return learning.capture(learning.balanced_logistic(train, test, _X, "y"), "source", "pred", "y", 2, ["doc_id"])


@query("s5_decode_trades", "SELECT l_orderkey * 10 + l_linenumber AS id, 'trade' AS kind, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS sol, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS tok, l_linestatus = 'F' AS buy FROM lineitem")
def s5_decode_trades(t: Tables) -> DataFrame:
    """Order lines written as binary events in base64, then decoded."""
    raw = F.concat(F.unhex(F.lit("bddb7fd34ee661ee")), feeds.little_endian(F.round(F.col("l_extendedprice") * 100)), feeds.little_endian(F.col("l_quantity")), F.unhex(F.when(F.col("l_linestatus") == "F", "01").otherwise("00")))
    logs = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.base64(raw).alias("data"))
    kinds = {"trade": ("bddb7fd34ee661ee", 25, {"sol": ("u64", 8), "tok": ("u64", 16), "buy": ("bool", 24)})}
    return feeds.decode_events(logs, "data", kinds).withColumns({c: F.col(c).cast("string") for c in ("sol", "tok")})


@query(
    "s10_wallet_swaps",
    """WITH c AS (SELECT o_orderkey, l_suppkey, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE -l_quantity END) AS tok FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY o_orderkey) AS changed FROM c WHERE abs(tok) > 1e-12)
SELECT CAST(n.o_orderkey AS VARCHAR) AS sig, 'w' || o_custkey AS wallet, l_suppkey AS mint, round(tok, 4) AS tok, CASE WHEN changed = 1 AND sign(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END + o_totalprice * 0.5) = -sign(tok) THEN round(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END + o_totalprice * 0.5, 4) END AS sol FROM n JOIN orders o ON o.o_orderkey = n.o_orderkey""",
)
def s10_wallet_swaps(t: Tables) -> DataFrame:
    """Orders as transactions of several owners: balances before and after, a fee, and part of the money in wrapped form."""
    side = lambda flag: F.collect_list(F.when(F.col("l_linestatus") == flag, F.struct((F.col("l_returnflag") == "R").alias("pool"), F.col("l_suppkey").cast("string").alias("mint"), F.col("l_quantity").alias("amount"))))
    b = t("lineitem").groupBy("l_orderkey").agg(side("O").alias("pre"), side("F").alias("post"))
    owned = lambda name: F.transform(name, lambda x: F.struct(F.when(x["pool"], F.lit("pool")).otherwise(wallet).alias("owner"), x["mint"].alias("mint"), x["amount"].alias("amount")))
    price = F.col("o_totalprice")
    wallet = F.concat(F.lit("w"), F.col("o_custkey").cast("string"))
    wrapped = F.array(F.struct(wallet.alias("owner"), F.lit("WSOL").alias("mint"), (price * 0.25).alias("amount")))
    paid = F.when(F.col("o_orderstatus") == "F", -price).otherwise(price)
    tx = t("orders").join(b, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").cast("string").alias("sig"), wallet.alias("wallet"), (price * 0.25).alias("fee"), price.alias("sol_pre"), (price + paid).alias("sol_post"), owned("pre").alias("pre"), F.concat(owned("post"), wrapped).alias("post"))
    return feeds.swaps(tx).select("sig", "wallet", F.col("mint").cast("long").alias("mint"), F.round("tok", 4).alias("tok"), F.round("sol", 4).alias("sol"))


@query("s23_scaled_view", "SELECT l_orderkey, l_linenumber, l_partkey, ceil(l_extendedprice * 1.25) AS charged, l_quantity * 1000000 AS units FROM lineitem")
def s23_scaled_view(t: Tables) -> DataFrame:
    """A view that scales integers and rebuilds fees."""
    return t.spark.sql("SELECT l_orderkey, l_linenumber, l_partkey, CAST(ceil(l_extendedprice * CAST(1.25 AS DOUBLE)) AS DOUBLE) AS charged, l_quantity * 1000000 AS units FROM {lean_tape}", lean_tape=t("lineitem"))


@query("t4_bars", "SELECT user_id AS key, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total, arg_min(value, ts) AS first, arg_max(value, ts) AS last FROM events GROUP BY ALL")
def t4_bars(t: Tables) -> DataFrame:
    """The batch result of the streaming bars."""
    out = live.bars(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "value", "1 hour")
    return out.select(F.col("user_id").alias("key"), F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"), "first", "last")


@query("t5_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id AS key, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def t5_sessions(t: Tables) -> DataFrame:
    """The batch result of the streaming sessions."""
    out = live.sessions(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "2 hours")
    return out.select(F.col("user_id").alias("key"), F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("m5_config_grid", "WITH g AS (SELECT l_suppkey AS cfg, l_extendedprice - 30000 AS pnl, l_shipdate < TIMESTAMP '1996-01-01' AS train FROM lineitem), s AS (SELECT cfg, count(*) FILTER (train) AS n, sum(pnl) FILTER (train) AS net, count(*) FILTER (NOT train) AS vn, sum(pnl) FILTER (NOT train) AS vnet FROM g GROUP BY cfg) SELECT cfg, n, round(net, 2) AS net, CASE WHEN n >= 50 AND net > 0 THEN vn END AS valid_n, round(CASE WHEN n >= 50 AND net > 0 THEN vnet END, 2) AS valid_net FROM s")
def m5_config_grid(t: Tables) -> DataFrame:
    """Configurations with their pass on training data; validation only for those that pass."""
    train, x = F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz"), F.col("l_extendedprice") - 30_000
    s = t("lineitem").groupBy(F.col("l_suppkey").alias("cfg")).agg(F.count_if(train).alias("n"), F.sum(F.when(train, x)).alias("net"), F.count_if(~train).alias("vn"), F.sum(F.when(~train, x)).alias("vnet"))
    ok = (F.col("n") >= 50) & (F.col("net") > 0)
    return s.select("cfg", "n", F.round("net", 2).alias("net"), F.when(ok, F.col("vn")).alias("valid_n"), F.round(F.when(ok, F.col("vnet")), 2).alias("valid_net"))
