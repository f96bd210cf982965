"""The trade tape and its companions as projections of the driver's tables, and the same in SQL.

A print has mint, usr, recv (LONG microseconds), seq (stable order among equal times), buy, sol, tok, and the pool's state
(vsol, vtok). Launches come from orders, quotes and polls from events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import packs

DAY = 86_400_000_000
SECOND = 1_000_000


def micros(ts: Column) -> Column:
    """Microseconds of a wall-clock timestamp without zone, whatever the session's zone is."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def day_of(ts: Column) -> Column:
    """Microseconds of the day's beginning."""
    return F.unix_date(F.to_date(ts)).cast("long") * DAY


def prints(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """The tape: one print per order line, keyed by supplier (mint) and customer (usr, ten customer keys each)."""
    users = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.floor(F.col("o_custkey") / 10).alias("usr"))
    second = (F.col("l_orderkey") * 97 + F.col("l_linenumber") * 13) % 86_400
    return lineitem.join(users, "l_orderkey").select(
        F.col("l_suppkey").alias("mint"),
        "usr",
        (day_of(F.col("l_shipdate")) + second * SECOND).alias("recv"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("seq"),
        (F.col("l_linestatus") == "F").alias("buy"),
        F.col("l_extendedprice").alias("sol"),
        F.col("l_quantity").alias("tok"),
        (F.col("l_extendedprice") + 30).alias("vsol"),
        (F.col("l_quantity") + 1).alias("vtok"),
        F.col("l_discount").alias("discount"),
    )


def packed_prints(lineitem: DataFrame, orders: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of the tape, with lines and orders joined as packs: for tables whose join is too large for the disk as rows.
    ``twice``: whether another print has the same seq; lines have no key, so a few have."""
    second = (F.col("l_orderkey") * 97 + F.col("line") * 13) % 86_400
    found = {
        "mint": (F.col("l_suppkey"), {"l_suppkey"}),
        "usr": (F.col("usr"), {"usr"}),
        "recv": (F.col("day") * DAY + second * SECOND, {"day", "line"}),
        "seq": ((F.col("l_orderkey") * 10 + F.col("line")) * 1_000_000 + F.col("l_partkey"), {"line", "l_partkey"}),
        "buy": (F.col("buy"), {"buy"}),
        "sol": (F.col("l_extendedprice"), {"l_extendedprice"}),
        "tok": (F.col("l_quantity"), {"l_quantity"}),
        "twice": (F.col("twice"), {"line", "l_partkey"}),
    }
    asked = set().union(*(found[c][1] for c in columns))
    made = {"line": F.col("l_linenumber").cast("long"), "day": F.unix_date(F.to_date("l_shipdate")).cast("long"), "buy": F.col("l_linestatus") == "F"}
    lines = lineitem.select("l_orderkey", *(made.get(c, F.col(c)).alias(c) for c in sorted(asked - {"usr"})))
    users = orders.select(F.col("o_orderkey").alias("l_orderkey"), *([F.floor(F.col("o_custkey") / 10).alias("usr")] if "usr" in asked else []))
    twice = ["line", "l_partkey"] if "twice" in columns else None
    return packs.joined(lines, users, "l_orderkey", twice).select(*(found[c][0].alias(c) for c in columns))


TAPE = """tape AS (SELECT l_suppkey AS mint, o_custkey // 10 AS usr,
  epoch_us(CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP)) + ((l_orderkey * 97 + l_linenumber * 13) % 86400) * 1000000 AS recv,
  (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq, l_linestatus = 'F' AS buy, l_extendedprice AS sol, l_quantity AS tok,
  l_extendedprice + 30 AS vsol, l_quantity + 1 AS vtok, l_discount AS discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def launches(orders: DataFrame) -> DataFrame:
    """Launches: creator, launch id, time, name key, whether and when it completed (a day later)."""
    born = day_of(F.col("o_orderdate")) + (F.col("o_orderkey") * 97 % 86_400) * SECOND
    done = F.col("o_orderstatus") == "F"
    return orders.select(F.col("o_custkey").alias("creator"), F.col("o_orderkey").alias("launch"), born.alias("born"), done.alias("completed"), F.when(done, born + DAY).alias("completed_at"), F.col("o_totalprice").alias("size"), F.col("o_orderpriority").alias("kind"))


LAUNCHES = """launches AS (SELECT o_custkey AS creator, o_orderkey AS launch,
  epoch_us(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) + ((o_orderkey * 97) % 86400) * 1000000 AS born,
  o_orderstatus = 'F' AS completed,
  CASE WHEN o_orderstatus = 'F' THEN epoch_us(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) + ((o_orderkey * 97) % 86400) * 1000000 + 86400000000 END AS completed_at,
  o_totalprice AS size, o_orderpriority AS kind FROM orders)"""


def ticks(events: DataFrame) -> DataFrame:
    """Timed values by key, at microsecond resolution."""
    return events.select("event_id", F.col("user_id").alias("key"), micros(F.col("ts")).alias("t"), "event_type", "value", "props")


TICKS = "ticks AS (SELECT event_id, user_id AS key, epoch_us(ts) AS t, event_type, value, props FROM events)"


def daily(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """A long panel: day number, symbol (market segment), price, volume, number of orders."""
    seg = customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("symbol"))
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    return orders.join(seg, "o_custkey").groupBy(day.alias("day"), "symbol").agg(F.round(F.avg("o_totalprice"), 4).alias("close"), F.round(F.sum("o_totalprice"), 2).alias("volume"), F.count("*").alias("n"))


DAILY = """daily AS (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day, c_mktsegment AS symbol,
  round(avg(o_totalprice), 4) AS close, round(sum(o_totalprice), 2) AS volume, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
