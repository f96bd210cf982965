"""The live side: ingest, bars, sessions, coalescing, positions, watches and triggers over streams.

Each function takes and gives a streaming (or, where the plan allows, a batch) DataFrame; sinks are the caller's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import sweep
from ..operators.trips import DUST
from ..sources import growing


def ingest(spark, path: str, schema: str, sink: str, checkpoint: str):
    """Rotating feed files to Parquet, lines as they come to be there; a restart goes on from the checkpoint. Runs what is there and
    stops."""
    rows = growing.growing_feed(spark, path, schema, stream=True)
    return rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Of ``fan_out``: the table of batches that are written whole.
WRITTEN = "_written"


def fan_out(batch: DataFrame, number: int, path: str, tables: dict[str, tuple[str, list[str]]], also: dict[str, tuple[str, list[str]]] | None = None) -> None:
    """One batch to several tables: a row goes to the first of ``tables`` (name: condition, columns) whose condition is true, to none
    if all are false or null, and to every one of ``also`` whose condition is.

    A batch has a folder of its own in each table, which it replaces if it comes again, and is listed as written at its end: a
    restart in the middle of a batch gives the same tables, and ``fanned_out`` never reads half of one.
    """
    names = list(tables)
    kind = F.coalesce(*(F.when(F.expr(condition), F.lit(k)) for k, (condition, _) in enumerate(tables.values())))
    rows = batch.withColumn("__table", kind).persist()
    try:
        for k, name in enumerate(names):
            rows.where(F.col("__table") == k).select(*tables[name][1]).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        for name, (condition, columns) in (also or {}).items():
            rows.where(condition).select(*columns).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.sparkSession.range(1).write.mode("overwrite").parquet(f"{path}/{WRITTEN}/batch={number}")
    finally:
        rows.unpersist()


def routed(rows: DataFrame, path: str, checkpoint: str, tables: dict[str, tuple[str, list[str]]], also: dict[str, tuple[str, list[str]]] | None = None):
    """A stream to several tables by ``fan_out``. Runs what is there and stops."""
    return rows.writeStream.foreachBatch(lambda batch, number: fan_out(batch, number, path, tables, also)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fanned_out(spark, path: str, name: str) -> DataFrame:
    """A table of ``fan_out``, without batches that are not yet whole."""
    done = spark.read.parquet(f"{path}/{WRITTEN}").agg(F.max("batch").alias("__last"))
    return spark.read.parquet(f"{path}/{name}").join(F.broadcast(done), F.col("batch") <= F.col("__last")).drop("batch", "__last")  # one row


def two_clocks(rows: DataFrame, event: str, received: str, late: str = "10 minutes") -> DataFrame:
    """Watermark on event time, with lateness as a column; what is later than the watermark allows is marked, not lost: it stays
    visible by its receive time, and ``fan_out`` can write it to a table of late rows besides its own."""
    lateness = F.unix_micros(received) - F.unix_micros(event)
    limit = F.expr(f"INTERVAL {late}")
    return rows.withWatermark(event, late).withColumn("lateness_us", lateness).withColumn("late", F.col(received) > F.col(event) + limit)


def deduplicate(rows: DataFrame, keys: list[str], event: str, late: str = "10 minutes") -> DataFrame:
    """Repeats within the watermark go."""
    return rows.withWatermark(event, late).dropDuplicatesWithinWatermark(keys)


def bars(rows: DataFrame, key: str, event: str, value: str, length: str, slide: str | None = None, late: str = "10 minutes", user: str | None = None) -> DataFrame:
    """Tumbling or sliding bars per key: n, sum, first and last by time, and with ``user`` about how many distinct ones (users)."""
    w = F.window(event, length, slide) if slide else F.window(event, length)
    return rows.withWatermark(event, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min_by(value, event).alias("first"), F.max_by(value, event).alias("last"), *([F.approx_count_distinct(user).alias("users")] if user else [])).select(key, F.col("w.start").alias("start"), "n", "total", "first", "last", *(["users"] if user else []))


def sessions(rows: DataFrame, key: str, event: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions that end after a gap."""
    return rows.withWatermark(event, late).groupBy(F.session_window(event, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


#: The state store that operators with state of their own need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Thinner:
    """One key's quotes: a changed price is written at most every ``price_us``, a changed size every ``size_us``; a change back
    cancels what waits. ``last`` is what was written last, ``waits`` what comes due, each (t, price, size) or None."""

    def __init__(self, price_us: int, size_us: int, last: tuple | None = None, waits: tuple | None = None) -> None:
        self.price_us, self.size_us, self.last, self.waits = price_us, size_us, last, waits

    def due(self, t: int) -> list[tuple]:
        """What waits, if it comes due by ``t``."""
        if self.waits is None or self.waits[0] > t:
            return []
        self.last, self.waits = self.waits, None
        return [self.last]

    def quote(self, t: int, price: float, size: float) -> list[tuple]:
        """What is written up to and with this quote."""
        out = self.due(t)
        if self.last is not None and (price, size) == self.last[1:]:
            self.waits = None
            return out
        at = t if self.last is None else self.last[0] + (self.price_us if price != self.last[1] else self.size_us)
        if t >= at:
            self.last, self.waits = (t, price, size), None
            return [*out, self.last]
        self.waits = (at, price, size)
        return out


class _Coalesce(StatefulProcessor):
    """What waits at the end of a batch stays in the state, with a timer for when it comes due: the output does not depend on
    where batches are cut."""

    def __init__(self, price_us: int, size_us: int) -> None:
        self.price_us, self.size_us = price_us, size_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t bigint, price double, size double")
        self.waits = handle.getValueState("waits", "t bigint, price double, size double")

    def _thinner(self) -> Thinner:
        held = lambda state: tuple(state.get()) if state.exists() else None
        return Thinner(self.price_us, self.size_us, held(self.last), held(self.waits))

    def _keep(self, thin: Thinner, old: tuple | None) -> None:
        if thin.last is not None:
            self.last.update(thin.last)
        if old is not None and thin.waits != old:
            self.handle.deleteTimer(_due_ms(old))
        if thin.waits is None:
            self.waits.clear()
        elif thin.waits != old:
            self.waits.update(thin.waits)
            self.handle.registerTimer(_due_ms(thin.waits))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        thin = self._thinner()
        old = thin.waits
        pdf = pd.concat(list(rows)).sort_values("t", kind="stable")
        out = [x for t, price, size in zip(pdf["t"], pdf["price"], pdf["size"], strict=True) for x in thin.quote(int(t), float(price), float(size))]
        self._keep(thin, old)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["key", "t", "price", "size"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        thin = self._thinner()
        old = thin.waits
        out = thin.due(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        if out:
            self.last.update(thin.last)
            self.waits.clear()
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["key", "t", "price", "size"])

    def close(self) -> None:
        pass


def _due_ms(waits: tuple) -> int:
    return -(-waits[0] // 1000)


def coalesce_quotes(quotes: DataFrame, price_us: int = 50_000, size_us: int = 500_000, late: str = "1 second") -> DataFrame:
    """A stream of quotes (key, t in microseconds, price, size) thinned per key; what waits comes out when the watermark, ``late``
    behind the newest quote, has passed its time. Quotes later than that are not taken."""
    timed = quotes.withColumn("at", F.timestamp_micros("t")).withWatermark("at", late)
    return timed.groupBy("key").transformWithStateInPandas(_Coalesce(price_us, size_us), "key bigint, t bigint, price double, size double", "Append", "eventTime")


def coalesced(quotes: DataFrame, order: list[str], price_us: int, size_us: int) -> DataFrame:
    """The same over a table: keys are walked in order, and what waits at a key's end comes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, thin = None, Thinner(price_us, size_us)
        for batch in batches:
            out = []
            for key, t, price, size in zip(*(batch.column(c).to_pylist() for c in ("key", "t", "price", "size")), strict=True):
                if key != now:
                    out += [(now, *x) for x in thin.due(1 << 62)]
                    now, thin = key, Thinner(price_us, size_us)
                out += [(key, *x) for x in thin.quote(t, price, size)]
            yield _quotes(out)
        yield _quotes([(now, *x) for x in thin.due(1 << 62)])

    def _quotes(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["key", "t", "price", "size"])

    return sweep(quotes, ["key"], order, run, "key long, t long, price double, size double")


_OPEN = "pos double, peak double, opened bigint, sol_in double, sol_out double, bought double, sold double, n_buys int, n_sells int"
_OPEN_NAMES = [x.split()[0] for x in _OPEN.split(", ")]
_CLOSED = ["usr", "mint", "opened", "closed", *_OPEN_NAMES[3:]]


def _trip(now: tuple | None, recv: int, buy: bool, sol: float, tok: float) -> tuple[tuple | None, tuple | None]:
    """The open trip after a print, and the trip that it closes."""
    if now is None:
        return ((float(tok), float(tok), int(recv), float(sol), 0.0, float(tok), 0.0, 1, 0) if buy else None), None
    pos, peak, opened, sol_in, sol_out, bought, sold, buys, sells = now
    if buy:
        return (pos + tok, max(peak, pos + tok), opened, sol_in + sol, sol_out, bought + tok, sold, buys + 1, sells), None
    now = (pos - tok, peak, opened, sol_in, sol_out + sol, bought, sold + tok, buys, sells + 1)
    return (None, (opened, int(recv), *now[3:])) if pos - tok <= DUST * peak else (now, None)


class _Trips(StatefulProcessor):
    """Round trips with the rules of the batch fold; state is one open trip per key, forgotten ``ttl_ms`` after its last print."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", _OPEN, self.ttl_ms)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.open.update(tuple(initialState[c] for c in _OPEN_NAMES))

    def handleInputRows(self, key, rows: Iterator[Row], timer) -> Iterator[Row]:
        now = self.open.get()
        for recv, _, buy, sol, tok in sorted((r["recv"], r["seq"], r["buy"], r["sol"], r["tok"]) for r in rows):
            now, closed = _trip(now, recv, buy, sol, tok)
            if closed:
                yield Row(**dict(zip(_CLOSED, (key[0], key[1], *closed), strict=True)))
        if now is None:
            self.open.clear()
        else:
            self.open.update(tuple(now))

    def close(self) -> None:
        pass


def _packed(state: dict, names: list[str]) -> bytes:
    """Tuples by key as an Arrow stream, the key's columns first."""
    cols = list(zip(*((*k, *v) for k, v in state.items()), strict=True))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes, key: int) -> dict:
    rows = zip(*(c.to_pylist() for c in pa.ipc.open_stream(data).read_all().columns), strict=True)
    return {r[:key]: r[key:] for r in rows}


class _Held(StatefulProcessor):
    """State of many keys as one value: a bucket's keys are read and written together, not with a call each."""

    NAMES: list[str]
    KEYS: int

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "data binary")

    def load(self) -> dict:
        return _unpacked(self.held.get()[0], self.KEYS) if self.held.exists() else {}

    def store(self, state: dict) -> None:
        if state:
            self.held.update((_packed(state, self.NAMES),))
        else:
            self.held.clear()

    def close(self) -> None:
        pass


class _TripBuckets(_Held):
    """The same trips; state is the open trips of a bucket of keys."""

    NAMES, KEYS = ["usr", "mint", *_OPEN_NAMES], 2

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        new = initialState[self.NAMES].astype(object)
        self.store(self.load() | {(int(r[0]), int(r[1])): (float(r[2]), float(r[3]), int(r[4]), *map(float, r[5:9]), int(r[9]), int(r[10])) for r in new.itertuples(index=False, name=None)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        held, out = self.load(), []
        pdf = pd.concat(list(rows)).sort_values(["recv", "seq"], kind="stable")
        for usr, mint, recv, buy, sol, tok in zip(*(pdf[c].tolist() for c in ("usr", "mint", "recv", "buy", "sol", "tok")), strict=True):
            k = (usr, mint)
            now, closed = _trip(held.pop(k, None), recv, buy, sol, tok)
            if closed:
                out.append((usr, mint, *closed))
            if now:
                held[k] = now
        self.store(held)
        yield pd.DataFrame(out, columns=_CLOSED).astype({c: "int64" if c in ("usr", "mint", "opened", "closed") else "int32" if c[:2] == "n_" else "float64" for c in _CLOSED})


def round_trips(prints: DataFrame, before: DataFrame | None = None, ttl_ms: int | None = None, buckets: int | None = None) -> DataFrame:
    """Closed trips of a stream of prints, as they close; batches must come in time order.

    ``before``: the trips that are open when the stream begins, as the batch ``round_trips(..., with_state=True)`` gives them, so that
    a stream goes on where a table ends; it counts in the first batch of a checkpoint only. With ``ttl_ms``, a trip without a
    print for so long (by the clock of the machines) is forgotten, so that the state does not grow for ever. With ``buckets``, state
    is kept by that many buckets of (usr, mint), for streams of many keys with few prints each; it cannot be forgotten then.
    """
    out = f"usr bigint, mint bigint, opened bigint, closed bigint, {_OPEN.split(', ', 3)[3]}"
    initial = None if before is None else before.where("closed IS NULL")
    if buckets is None:
        return prints.groupBy("usr", "mint").transformWithState(_Trips(ttl_ms), out, "Append", "None" if ttl_ms is None else "ProcessingTime", initial and initial.groupBy("usr", "mint"))
    if ttl_ms is not None:
        raise ValueError("a bucket's trips are not forgotten one by one")
    bucket = F.pmod(F.xxhash64("usr", "mint"), F.lit(buckets)).alias("bucket")
    prints = prints.select(bucket, "usr", "mint", "recv", "seq", "buy", "sol", "tok").dropna()
    return prints.groupBy("bucket").transformWithStateInPandas(_TripBuckets(), out, "Append", "None", initial and initial.select(bucket, *_TripBuckets.NAMES).groupBy("bucket"))


class _Trigger(StatefulProcessor):
    def __init__(self, cooldown_us: int, once: bool) -> None:
        self.cooldown_us, self.once = cooldown_us, once

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for t in sorted(int(x) for pdf in rows for x in pdf["t"]):
            if last is None or (not self.once and t - last >= self.cooldown_us):
                last = t
                out.append((key[0], t))
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["key", "t"])

    def close(self) -> None:
        pass


def triggers(hits: DataFrame, cooldown_us: int, once: bool = False) -> DataFrame:
    """Hits (key, t) kept with a cooldown per key, or once per key."""
    return hits.groupBy("key").transformWithStateInPandas(_Trigger(cooldown_us, once), "key bigint, t bigint", "Append", "None")


class _Watch(_Held):
    """Watches of a bucket of keys: since when, until when, and how many events they have seen. A timer stands at the earliest end."""

    NAMES, KEYS = ["key", "since", "until", "n"], 1

    def __init__(self, hold_ms: int) -> None:
        self.hold_ms = hold_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        held = self.load()
        old = min((w[1] for w in held.values()), default=None)
        pdf = pd.concat(list(rows))
        pdf = pdf.assign(late=~pdf["touch"]).sort_values(["ms", "late"], kind="stable")  # a touch counts for events of its time
        out = []
        for k, id_, ms, touch in zip(*(pdf[c].tolist() for c in ("key", "id", "ms", "touch")), strict=True):
            now = held.get((k,))
            if now is not None and now[1] < ms:
                out.append((k, None, *now))
                del held[(k,)]
                now = None
            if touch:
                held[(k,)] = (ms, ms + self.hold_ms, 0) if now is None else (now[0], max(now[1], ms + self.hold_ms), now[2])
            elif now is not None:
                held[(k,)] = now = (now[0], now[1], now[2] + 1)
                out.append((k, id_, now[0], ms, now[2]))
        self._keep(held, old)
        yield _watch_rows(out)

    def _keep(self, held: dict, old: int | None) -> None:
        end = min((w[1] for w in held.values()), default=None)
        if end != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if end is not None:
                self.handle.registerTimer(end)
        self.store(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, now = self.load(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        over = {k: w for k, w in held.items() if w[1] <= now}
        self._keep({k: w for k, w in held.items() if k not in over}, None)
        yield _watch_rows([(*k, None, *w) for k, w in over.items()])


def _watch_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "id", "since", "ms", "n"]).astype({"key": "int64", "id": "Int64", "since": "int64", "ms": "int64", "n": "int64"})


def watched(rows: DataFrame, hold_ms: int = 3_600_000, late: str = "10 minutes", buckets: int = 1024) -> DataFrame:
    """Events on watched keys, each once: a touch watches its key for ``hold_ms``, and a touch while it is watched extends that.

    Takes a stream of key (long), id (long), ms (long) and touch (boolean: a touch or an event). Gives key, id, since (when the watch
    began), ms and n (the watch's events so far) for every event from a touch to ``hold_ms`` after the last one, both included, and
    a row with a null id, the end as ms and all its events as n for every watch that is over; a watch ends when the watermark,
    ``late`` behind the newest row, passes it. Rows later than that are not taken; others must come in batches in time order. State is kept
    by ``buckets`` of keys.
    """
    timed = rows.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "id", "ms", "touch", F.timestamp_millis("ms").alias("at")).withWatermark("at", late)
    return timed.groupBy("bucket").transformWithStateInPandas(_Watch(hold_ms), "key bigint, id bigint, since bigint, ms bigint, n bigint", "Append", "eventTime")


def watched_in(rows: DataFrame, hold_ms: int = 3_600_000) -> DataFrame:
    """The same events over a table: key, id, since, ms, n. One ordered window: a watch begins at a touch that comes more than
    ``hold_ms`` after the one before."""
    order = Window.partitionBy("key").orderBy("ms", F.desc("touch"), "id").rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("touch"), F.col("ms"))).over(order)
    rows = rows.select("key", "id", "ms", "touch", last.alias("last"))
    begins = F.col("touch") & F.coalesce(F.col("ms") - F.col("last") > hold_ms, F.lit(True))
    rows = rows.withColumn("since", F.last(F.when(begins, F.col("ms")), ignorenulls=True).over(upto))
    seen = rows.where(~F.col("touch") & (F.col("ms") - F.col("last") <= hold_ms))
    return seen.select("key", "id", "since", "ms", F.row_number().over(Window.partitionBy("key", "since").orderBy("ms", "id")).cast("long").alias("n"))


def with_snapshots(creates: DataFrame, snapshots: DataFrame, key: str, created: str, taken: str, within: str = "120 seconds") -> DataFrame:
    """Creates with the snapshots of their key within a bound; a create without one comes out once the watermark has passed."""
    a = creates.withWatermark(created, within)
    b = snapshots.withWatermark(taken, within).withColumnRenamed(key, "__key")
    return a.join(b, (F.col(key) == F.col("__key")) & (F.col(taken) >= F.col(created)) & (F.col(taken) <= F.col(created) + F.expr(f"INTERVAL {within}")), "leftOuter").drop("__key")
