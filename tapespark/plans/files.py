"""Queries that go through files or a running stream: what is written from the tables is read back, and compared as a table."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns
from ..operators import scratch, strategies, trips
from ..sources import feeds, growing, tape
from ..sources.tape import DAY, SECOND, TAPE, TICKS
from ..streaming import live
from .composites import _CREATOR
from .registry import Tables, query
from .tape import _TRIPS_SQL, prints

_EVENT = "event_id long, user_id long, event_type string, value double"


def _lines(t: Tables) -> DataFrame:
    """Events as JSON lines, and after every seventh one a line that was cut short."""
    row = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    return t("events").select(F.explode(F.when(F.col("event_id") % 7 == 0, F.array(row, F.substring(row, 1, 25))).otherwise(F.array(row))).alias("value"))


@query("s1_feed_scan", "SELECT event_id, user_id, event_type, value FROM events")
def s1_feed_scan(t: Tables) -> DataFrame:
    """Feed files, gzip JSON lines: all that parse."""
    path = scratch.folder(t.spark, "feed")
    _lines(t).write.option("compression", "gzip").text(path)
    return feeds.read_feed(t.spark, path, _EVENT).drop("src_file")


@query(
    "s2_incremental_load",
    "SELECT event_type AS src_file, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1",
)
def s2_incremental_load(t: Tables) -> DataFrame:
    """Half of every file's rows are loaded first, then the files as they have grown: each replaces its own rows."""
    path = scratch.folder(t.spark, "loaded")
    rows = t("events").select("event_id", F.col("event_type").alias("src_file"))
    feeds.load_incremental(rows.where("event_id % 2 = 0"), path)
    feeds.load_incremental(rows.where("src_file IN ('view', 'click')"), path)
    feeds.load_incremental(rows.where("src_file NOT IN ('view', 'click')"), path)
    return t.spark.read.parquet(path).groupBy("src_file").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("s11_snapshot", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE 0 END AS c_acctbal FROM customer UNION ALL SELECT -1 - c_custkey, c_name, 1.0 FROM customer")
def s11_snapshot(t: Tables) -> DataFrame:
    """Tables to zstd Parquet, and one back by name over older rows."""
    path = scratch.folder(t.spark, "snapshot")
    rows = t("customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).otherwise(0.0).alias("c_acctbal"))
    feeds.export_parquet({"customer": rows, "nation": t("nation")}, path)
    older = t("customer").select("c_custkey", "c_name", F.lit(5.0).alias("c_acctbal"))
    gone = t("customer").select((-1 - F.col("c_custkey")).alias("c_custkey"), "c_name", F.lit(1.0).alias("c_acctbal"))
    return feeds.import_parquet(t.spark, path, "customer", older.union(gone), ["c_custkey"])


_VIEWS = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "nation": "n_nationkey", "region": "r_regionkey"}


@query("s12_csv_views", " UNION ALL ".join(f"SELECT '{name}' AS view, count(*) AS n, sum({key})::BIGINT AS keys FROM {name} WHERE {key} % 10 <> 3" for name, key in _VIEWS.items()))
def s12_csv_views(t: Tables) -> DataFrame:
    """Seven ordered views as CSV without their synthetic rows."""
    path = scratch.folder(t.spark, "views")
    feeds.export_views({name: (t(name).select(key, (F.col(key) % 10 == 3).alias("is_synthetic")), [key]) for name, key in _VIEWS.items()}, path)
    out = None
    for name, key in _VIEWS.items():
        one = t.spark.read.schema(f"{key} long").option("header", True).csv(f"{path}/{name}").agg(F.lit(name).alias("view"), F.count("*").alias("n"), F.sum(key).alias("keys"))
        out = one if out is None else out.union(one)
    return out


@query("s13_line_import", "WITH n AS (SELECT event_type AS file, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS line, value FROM events) SELECT file, line, 'value over 150' AS problem FROM n WHERE value > 150 UNION ALL SELECT 'total', count(*), 'rows in' FROM events WHERE value <= 150")
def s13_line_import(t: Tables) -> DataFrame:
    """Lines that break a rule, by file and line, keep everything out; the others go in as a whole."""
    path = scratch.folder(t.spark, "imported")
    n = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    lines = t("events").select(F.col("event_type").alias("file"), n.alias("line"), F.to_json(F.struct("event_id", "value")).alias("value"))
    lines = scratch.written(lines, "lines")
    rules = {"value over 150": "value > 150"}
    problems = scratch.written(feeds.import_lines(lines, "event_id long, value double", rules, path), "problems")
    feeds.import_lines(lines.join(problems, ["file", "line"], "left_anti"), "event_id long, value double", rules, path)
    loaded = t.spark.read.schema("event_id long, value double").parquet(path).agg(F.lit("total").alias("file"), F.count("*").alias("line"), F.lit("rows in").alias("problem"))
    return problems.select("file", F.col("line").cast("long").alias("line"), "problem").union(loaded)


@query("s22_compacted", f"WITH {TICKS} SELECT t // 86400000000 AS day, count(*) AS n, 1::BIGINT AS files FROM ticks GROUP BY 1")
def s22_compacted(t: Tables) -> DataFrame:
    """Part files to one file a day, sorted; how many rows and files each day has then."""
    path = scratch.folder(t.spark, "compact")
    feeds.compact(tape.ticks(t("events")).select("key", "t", "value", F.floor(F.col("t") / tape.DAY).alias("day")), path, "day", ["key", "t"])
    rows = t.spark.read.parquet(path).withColumn("file", F.col("_metadata.file_path"))
    return rows.groupBy(F.col("day").cast("long").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))


_ROUTES = {
    "trade": ("event_type = 'purchase' AND value > 1 AND value < 300", ["event_id", "user_id", "value"]),
    "create": ("event_type = 'signup'", ["event_id", "user_id"]),
    "complete": ("event_type = 'click' AND value > 100", ["event_id", "user_id"]),
    "rejected": ("event_type = 'purchase'", ["event_id", "user_id", "value"]),
}


@query(
    "t1_ingest",
    """WITH e AS (SELECT event_id, user_id, value, CASE WHEN event_type = 'purchase' AND value > 1 AND value < 300 THEN 'trade' WHEN event_type = 'signup' THEN 'create' WHEN event_type = 'click' AND value > 100 THEN 'complete' WHEN event_type = 'purchase' THEN 'rejected' END AS target, (event_id % 40) * 30000000 AS lateness_us FROM events)
SELECT event_id, user_id, CASE WHEN target IN ('trade', 'rejected') THEN value END AS value, target, NULL::BIGINT AS lateness_us FROM e WHERE target IS NOT NULL UNION ALL SELECT event_id, user_id, value, 'late', lateness_us FROM e WHERE lateness_us > 600000000""",
)
def t1_ingest(t: Tables) -> DataFrame:
    """Gzip feeds that get more files, with lines cut short among theirs, through a stream to tables of trades, creates, completes and
    rejected trades, with rows later than ten minutes in a table besides; a last run with nothing new adds nothing."""
    path, sink, checkpoint = (scratch.folder(t.spark, x) for x in ("feed", "ingested", "checkpoint"))
    e = t("events").withColumn("ts", tape.micros(F.col("ts")))
    e = e.withColumn("recv", F.col("ts") + F.col("event_id") % 40 * 30 * SECOND)
    row = F.to_json(F.struct("event_id", "user_id", "event_type", "value", "ts", "recv"))
    lines = e.select("event_id", F.explode(F.when(F.col("event_id") % 7 == 0, F.array(row, F.substring(row, 1, 25))).otherwise(F.array(row))).alias("value"))
    for part in ("event_id % 2 = 0", "event_id % 2 = 1", None):
        if part:
            lines.where(part).select("value").write.mode("append").option("compression", "gzip").text(path)
        rows = growing.growing_feed(t.spark, path, f"{_EVENT}, ts long, recv long", stream=True)
        rows = live.two_clocks(rows.withColumns({c: F.timestamp_micros(c) for c in ("ts", "recv")}), "ts", "recv")
        live.routed(rows, sink, checkpoint, _ROUTES, {"late": ("late", ["event_id", "user_id", "value", "lateness_us"])}).awaitTermination()
    out = None
    for name in (*_ROUTES, "late"):
        one = live.fanned_out(t.spark, sink, name).withColumn("target", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


@query(
    "t6_coalesced",
    f"""WITH RECURSIVE {TICKS}, q AS (SELECT key, t, event_id, floor(value / 20) AS price, floor(value) AS size, row_number() OVER (PARTITION BY key ORDER BY t, event_id) AS i FROM ticks),
f AS (SELECT key, i, t AS t0, price AS p0, size AS s0, NULL::BIGINT AS due, price AS wp, size AS ws, t AS out_t, price AS out_p, size AS out_s, NULL::BIGINT AS early_t, price AS early_p, size AS early_s FROM q WHERE i = 1
 UNION ALL SELECT key, i, CASE WHEN emits THEN t ELSE t1 END, CASE WHEN emits THEN price ELSE p1 END, CASE WHEN emits THEN size ELSE s1 END, CASE WHEN NOT same AND NOT emits THEN due1 END, price, size, CASE WHEN emits THEN t END, price, size, early_t, wp, ws FROM (
  SELECT *, NOT same AND t >= due1 AS emits FROM (SELECT *, price = p1 AND size = s1 AS same, t1 + CASE WHEN price <> p1 THEN 3600000000 ELSE 21600000000 END AS due1 FROM (
   SELECT q.key, q.i, q.t, q.price, q.size, f.wp, f.ws, CASE WHEN f.due <= q.t THEN f.due ELSE f.t0 END AS t1, CASE WHEN f.due <= q.t THEN f.wp ELSE f.p0 END AS p1, CASE WHEN f.due <= q.t THEN f.ws ELSE f.s0 END AS s1, CASE WHEN f.due <= q.t THEN f.due END AS early_t
   FROM f JOIN q ON q.key = f.key AND q.i = f.i + 1)))),
l AS (SELECT key, due, wp, ws, row_number() OVER (PARTITION BY key ORDER BY i DESC) AS r FROM f)
SELECT key, out_t AS t, out_p AS price, out_s AS size FROM f WHERE out_t IS NOT NULL UNION ALL SELECT key, early_t, early_p, early_s FROM f WHERE early_t IS NOT NULL UNION ALL SELECT key, due, wp, ws FROM l WHERE r = 1 AND due IS NOT NULL""",
)
def t6_coalesced(t: Tables) -> DataFrame:
    """Quotes thinned: a changed price at most every hour, a changed size every six, a change back cancels what waits."""
    quotes = tape.ticks(t("events")).select("key", "t", "event_id", F.floor(F.col("value") / 20).cast("double").alias("price"), F.floor("value").cast("double").alias("size"))
    return live.coalesced(quotes, ["t", "event_id"], 3600 * SECOND, 6 * 3600 * SECOND)


@contextmanager
def _rocks(spark):
    """The state store that operators with state of their own need; it is the session's while streams are started and run here."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, live.ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _run(rows: DataFrame, sink: str, checkpoint: str) -> None:
    rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@query("t7_positions", f"{_TRIPS_SQL} SELECT usr, mint, opened, closed, round(sol_in, 2) AS sol_in, round(sol_out, 2) AS sol_out, bought, sold, n_buys, n_sells FROM trips WHERE closed IS NOT NULL")
def t7_positions(t: Tables) -> DataFrame:
    """Closed trips: those of the tape up to a day from a table, later ones from a stream that begins with what is open then. The
    stream is stopped and goes on from its checkpoint in between."""
    spark = t.spark
    path, sink, checkpoint = (scratch.folder(spark, x) for x in ("prints", "trips", "checkpoint"))
    rows, day = prints(t).select("usr", "mint", "recv", "seq", "buy", "sol", "tok"), 9_500 * DAY
    before = scratch.written(trips.round_trips(rows.where(F.col("recv") < day), with_state=True), "trips-before")
    with _rocks(spark):
        for part in (F.col("recv").between(day, day + 365 * DAY - 1), F.col("recv") >= day + 365 * DAY):
            rows.where(part).write.mode("append").parquet(path)
            _run(live.round_trips(spark.readStream.schema(rows.schema).parquet(path), before, buckets=1024), sink, checkpoint)
    after = spark.read.schema("usr long, mint long, opened long, closed long, sol_in double, sol_out double, bought double, sold double, n_buys int, n_sells int").parquet(sink)
    return before.where("closed IS NOT NULL").select(after.columns).union(after).withColumns({c: F.round(c, 2) for c in ("sol_in", "sol_out")})


@query(
    "t8_watched",
    """WITH e AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) // 1000 AS ms, event_type = 'signup' AS touch FROM events WHERE event_type IN ('signup', 'click')),
a AS (SELECT *, max(ms) FILTER (touch) OVER (PARTITION BY key ORDER BY ms, touch DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e),
b AS (SELECT *, last_value(CASE WHEN touch AND (last IS NULL OR ms - last > 21600000) THEN ms END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ms, touch DESC, id ROWS UNBOUNDED PRECEDING) AS since FROM a)
SELECT key, id, since, ms, row_number() OVER (PARTITION BY key, since ORDER BY ms, id) AS n FROM b WHERE NOT touch AND ms - last <= 21600000""",
)
def t8_watched(t: Tables) -> DataFrame:
    """Clicks of users who are watched: a signup watches its user for six hours, another one extends that. As a stream in two runs."""
    spark = t.spark
    path, sink, checkpoint = (scratch.folder(spark, x) for x in ("touches", "watched", "checkpoint"))
    rows = t("events").where("event_type IN ('signup', 'click')").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.floor(tape.micros(F.col("ts")) / 1000).alias("ms"), (F.col("event_type") == "signup").alias("touch"))
    half = 19_738 * 86_400_000
    with _rocks(spark):
        for part in (F.col("ms") < half, F.col("ms") >= half):
            rows.where(part).write.mode("append").parquet(path)
            _run(live.watched(spark.readStream.schema(rows.schema).parquet(path), 6 * 3_600_000), sink, checkpoint)
    return spark.read.schema("key long, id long, since long, ms long, n long").parquet(sink).where("id IS NOT NULL")


@query(
    "t9_triggers",
    f"""WITH RECURSIVE {TICKS}, n AS (SELECT key, t, row_number() OVER (PARTITION BY key ORDER BY t) AS rn FROM (SELECT DISTINCT key, t FROM ticks WHERE value > 100)),
k AS (SELECT key, t, rn, t AS last, true AS kept FROM n WHERE rn = 1 UNION ALL SELECT n.key, n.t, n.rn, CASE WHEN n.t - k.last >= 21600000000 THEN n.t ELSE k.last END, n.t - k.last >= 21600000000 FROM k JOIN n ON n.key = k.key AND n.rn = k.rn + 1)
SELECT key, t FROM k WHERE kept""",
)
def t9_triggers(t: Tables) -> DataFrame:
    """High values as a stream, of which each key's are kept at most every six hours."""
    spark = t.spark
    path, sink, checkpoint = (scratch.folder(spark, x) for x in ("hits", "triggers", "checkpoint"))
    tape.ticks(t("events")).where("value > 100").select("key", "t").distinct().write.parquet(path)
    with _rocks(spark):
        _run(live.triggers(spark.readStream.schema("key long, t long").parquet(path), 6 * 3600 * SECOND), sink, checkpoint)
    return spark.read.schema("key long, t long").parquet(sink)


@query("z1_sql_functions", f"WITH {TAPE} SELECT seq, round(vsol / vtok, 8) AS price, round(vtok * (100 / 1.0125) / (vsol + 100 / 1.0125), 9) AS bought, round(sign(sol - 30000) * ln(1 + abs(sol - 30000)), 9) AS signed FROM tape")
def z1_sql_functions(t: Tables) -> DataFrame:
    """The column functions as SQL functions of the session, called from SQL: price, quote and signed logarithm."""
    columns.register(t.spark)
    return t.spark.sql(
        "SELECT seq, round(tape_price(vsol, vtok), 8) AS price, round(tape_quote_buy(vsol, vtok, CAST(100 AS DOUBLE), CAST(0.0125 AS DOUBLE)), 9) AS bought, round(tape_signed_log(sol - 30000), 9) AS signed FROM {tape}",
        tape=prints(t),
    )


@query(
    "z1_strategies",
    f"""WITH {TAPE}, {_CREATOR}, s AS (SELECT h.mint, min((p.recv, p.seq)) AS at FROM hits h JOIN tape p ON p.mint = h.mint AND (p.recv, p.seq) > h.at AND p.recv < h.entered + 7776000000000 AND p.vsol / p.vtok <= h.px * 0.75 GROUP BY h.mint),
l AS (SELECT DISTINCT h.mint FROM hits h JOIN tape p ON p.mint = h.mint AND p.recv >= h.entered + 7776000000000)
SELECT mint, 'enter' AS what, entered AS t, round(px, 6) AS px FROM hits UNION ALL SELECT s.mint, 'stop', recv, round(vsol / vtok, 6) FROM s JOIN tape p ON p.mint = s.mint AND (p.recv, p.seq) = s.at
UNION ALL SELECT mint, 'hold', entered + 7776000000000, NULL FROM hits WHERE mint NOT IN (SELECT mint FROM s) AND mint IN (SELECT mint FROM l)""",
)
def z1_strategies(t: Tables) -> DataFrame:
    """The trigger of c9 as a strategy that is called from SQL: entries, and exits at a stop of a quarter or after ninety days."""
    strategies.register_strategy(t.spark, "first_exit", lambda: strategies.FirstExit(20_000, 730 * DAY, 1825 * DAY, 0.25, 90 * DAY), strategies.FirstExit.SCHEMA, "recv")
    return t.spark.sql("SELECT mint, what, t, round(px, 6) AS px FROM first_exit(TABLE(SELECT mint, usr, recv, seq, buy, sol, vsol / vtok AS px FROM {tape}) PARTITION BY mint ORDER BY (recv, seq))", tape=prints(t))


@query(
    "z1_window_functions",
    f"""WITH {TAPE} SELECT seq, (count(*) FILTER (buy) OVER near - (count(*) FILTER (buy) OVER far - count(*) FILTER (buy) OVER near))::DOUBLE AS acceleration FROM tape
WINDOW near AS (PARTITION BY mint ORDER BY recv RANGE BETWEEN 431999999999 PRECEDING AND CURRENT ROW), far AS (PARTITION BY mint ORDER BY recv RANGE BETWEEN 863999999999 PRECEDING AND CURRENT ROW)""",
)
def z1_window_functions(t: Tables) -> DataFrame:
    """A function of a window's events, called from SQL: buys of the last five days less those of the five before."""
    strategies.register_window_function(t.spark, "acceleration", lambda w: (w["buy"] * (1 - 2 * (w["recv"] <= w["recv"].max() - 5 * DAY))).sum(), ["recv", "buy"])
    frame = "PARTITION BY mint ORDER BY recv RANGE BETWEEN 863999999999 PRECEDING AND CURRENT ROW"
    return t.spark.sql(f"SELECT seq, acceleration(recv, int(buy)) OVER ({frame}) AS acceleration FROM {{tape}}", tape=prints(t))
