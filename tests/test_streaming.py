import gzip
import json
import os
import random
import zlib

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tapespark.operators import folds, trips
from tapespark.sources import feeds, growing
from tapespark.streaming import live

DAY = 86_400  # times before the epoch's first moment count as late


@pytest.fixture
def rocks(spark):
    """The state store that stateful operators need; one partition, as every one of a batch starts workers of its own."""
    conf = {"spark.sql.streaming.stateStore.providerClass": live.ROCKS, "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(spark, df, mode="append"):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table("out")


def stream(spark, tmp_path, rows, parts=3):
    """Rows as a stream of files in time order."""
    path = str(tmp_path / "in")
    n = rows.count()
    ordered = rows.toPandas()
    for k in range(parts):
        part = ordered.iloc[n * k // parts : n * (k + 1) // parts]
        spark.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_feed_and_ingest(spark, tmp_path):
    path = tmp_path / "feed"
    path.mkdir()
    (path / "a.jsonl").write_text('{"e":"trade","t":1,"v":2.5}\nnot json\n{"e":"create","t":2}\n')
    schema = "e string, t long, v double"
    assert feeds.read_feed(spark, str(path), schema).select("e", "t").orderBy("t").collect() == [("trade", 1), ("create", 2)]
    sink, mark = str(tmp_path / "sink"), str(tmp_path / "mark")
    live.ingest(spark, str(path), schema, sink, mark).awaitTermination(120)
    (path / "b.jsonl").write_text(json.dumps({"e": "trade", "t": 3, "v": 1.0}) + "\n")
    live.ingest(spark, str(path), schema, sink, mark).awaitTermination(120)
    assert spark.read.parquet(sink).count() == 3


def rows_of(df):
    return sorted((r["src_file"], r["t"]) for r in df.collect())


def test_growing_gzip_feed(spark, tmp_path):
    """A gzip file that is cut inside a line and inside its packed data, then grown, twice; a plain one; a damaged one; new files.
    After each run the stream's rows are the whole lines that can be read, each once, and in the end those of the batch read."""
    rnd = random.Random(3)
    text = "".join(json.dumps({"e": "trade", "t": k, "v": rnd.random()}) + "\n" for k in range(3000)).encode()
    packed = gzip.compress(text[:60_000]) + gzip.compress(text[60_000:])
    feed, sink, mark = tmp_path / "feed", str(tmp_path / "sink"), str(tmp_path / "mark")
    feed.mkdir()
    schema = "e string, t long, v double"
    (feed / "_work").write_text("no row\n")
    (feed / "c_bad.jsonl.gz").write_bytes(packed[:5000] + b"damage" * 50 + packed[5400:])
    cuts = (20, 30_000, 30_001, len(packed) - 5, len(packed))
    plain = (10, 30, len(text) // 2, len(text) // 2, len(text))
    before = 0
    for k, (a, b) in enumerate(zip(cuts, plain)):
        (feed / "a.jsonl.gz").write_bytes(packed[:a])
        (feed / "b.jsonl").write_bytes(text[:b])
        if k == 2:
            (feed / "d.jsonl").write_bytes(b'{"e":"create","t":-1}\r\nnot json\n{"e":"cr')
        live.ingest(spark, str(feed), schema, sink, mark).awaitTermination(120)
        got = rows_of(spark.read.parquet(sink))
        assert len(got) == len(set(got)) >= before
        assert [t for f, t in got if f == "b.jsonl"] == list(range(text[:b].count(b"\n")))
        first = zlib.decompressobj(31)
        there = first.decompress(packed[:a])
        there += zlib.decompressobj(31).decompress(first.unused_data)
        assert [t for f, t in got if f == "a.jsonl.gz"] == list(range(there.count(b"\n")))
        before = len(got)
    assert [t for f, t in got if f == "a.jsonl.gz"] == list(range(3000))
    assert 0 < sum(f == "c_bad.jsonl.gz" for f, _ in got) < 3000
    assert got == rows_of(growing.growing_feed(spark, str(feed), schema))


def test_parts_of_plain_files(spark, tmp_path, monkeypatch):
    """Parts and chunks of any size give every line once, whatever the cuts; only a table has the unfinished line."""
    text = "".join(f"line {k} {'x' * (k % 37)}\n" for k in range(300)) + "unfinished"
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt.gz").write_bytes(gzip.compress(text.encode()))
    lines = text.split("\n")
    for part, chunk in ((1, 7), (50, 16), (10_000, 100), (1 << 20, 1 << 20)):
        monkeypatch.setattr(growing, "PART", part)
        monkeypatch.setattr(growing, "CHUNK", chunk)
        batch = growing._Batch(str(tmp_path))
        got = [(b.column(0)[0].as_py(), x) for p in batch.partitions() for b in batch.read(p) for x in b.column(1).to_pylist()]
        assert sorted(got) == sorted((f, x) for f in ("a.txt", "b.txt.gz") for x in lines)
        stream = growing._Stream(str(tmp_path), None)
        rnd, start, seen = random.Random(part), stream.initialOffset(), []
        end = stream.latestOffset()["sizes"]
        for share in sorted([rnd.random() for _ in range(5)] + [1.0]):
            stop = {"done": "", "sizes": {f: int(n * share) for f, n in end.items()}}
            seen += [(b.column(0)[0].as_py(), x) for p in stream.partitions(start, stop) for b in stream.read(p) for x in b.column(1).to_pylist()]
            start = stop
        assert sorted(seen) == sorted((f, x) for f in ("a.txt", "b.txt.gz") for x in lines[:-1])


def test_finished_files_leave_the_offsets(tmp_path):
    for name in "abc":
        (tmp_path / name).write_text("x\n")
    os.utime(tmp_path / "a", (1, 1))
    os.utime(tmp_path / "c", (1, 1))
    stream = growing._Stream(str(tmp_path), 3600)
    first = stream.latestOffset()
    stream.commit(first)
    assert stream.latestOffset() == {"done": "a", "sizes": {"b": 2, "c": 2}}
    assert stream.partitions(first, stream.latestOffset()) == []
    again = growing._Stream(str(tmp_path), 3600).latestOffset()  # after a restart
    assert stream.partitions({"done": "a", "sizes": {"b": 2, "c": 2}}, again) == []


def test_tables_after_a_restart_in_the_middle(spark, tmp_path, monkeypatch):
    """A batch that fails after some of its tables comes again: the tables are those of a run without a fault."""
    feed = tmp_path / "feed"
    feed.mkdir()
    tables = {"trade": ("e = 'trade' AND v > 0", ["t", "v"]), "create": ("e = 'create'", ["t"]), "rejected": ("e = 'trade'", ["t", "v"])}
    also = {"late": ("t % 5 = 0", ["e", "t"])}
    fan_out, calls = live.fan_out, []

    def failing(batch, number, path, tables, also):
        calls.append(number)
        if len(calls) == 2:
            broken = dict(tables, rejected=("e = 'trade'", [F.expr("raise_error('lost')").alias("t")]))
            fan_out(batch, number, path, broken, also)
        fan_out(batch, number, path, tables, also)

    def read(path):
        return {n: sorted(map(tuple, live.fanned_out(spark, path, n).collect()), key=str) for n in (*tables, *also)}

    for part in range(2):
        lines = [{"e": ["trade", "create", "other"][k % 3], "t": k, "v": None if k % 4 == 0 else k % 7 - 2.0} for k in range(100 * part, 100 * part + 100)]
        (feed / f"{part}.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
        for sink in ("good", "failed"):
            rows = growing.growing_feed(spark, str(feed), "e string, t long, v double", stream=True)
            monkeypatch.setattr(live, "fan_out", failing if sink == "failed" else fan_out)
            path, mark = str(tmp_path / sink), str(tmp_path / f"{sink}-mark")
            if sink == "failed" and part == 1:
                with pytest.raises(StreamingQueryException):
                    live.routed(rows, path, mark, tables, also).awaitTermination(120)
                assert (tmp_path / "failed" / "trade" / "batch=1").exists() and len(read(path)["trade"]) < len(read(str(tmp_path / "good"))["trade"])
            live.routed(rows, path, mark, tables, also).awaitTermination(120)
    good = read(str(tmp_path / "good"))
    assert read(str(tmp_path / "failed")) == good and calls == [0, 1, 1]
    assert sum(len(good[n]) for n in tables) == sum(k % 3 < 2 for k in range(200)) and len(good["late"]) == 40 and len(good["rejected"]) > 10


def test_bars_and_sessions(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 3).alias("key"), F.timestamp_seconds(F.col("id") * 37 + F.when(F.col("id") > 100, 5000).otherwise(0)).alias("ts"), (F.col("id") * 1.5).alias("value"))
    s = stream(spark, tmp_path, rows)
    got = run(spark, live.bars(s, "key", "ts", "value", "5 minutes"), "complete")
    want = rows.groupBy("key", F.window("ts", "5 minutes").start.alias("start")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    assert sorted(got.select("key", "start", "n", "total").collect()) == sorted(want.collect())
    assert {r["users"] for r in live.bars(rows.withColumn("u", F.lit(1)), "key", "ts", "value", "5 minutes", user="u").collect()} == {1}
    got = run(spark, live.sessions(s, "key", "ts", "20 minutes"), "complete")
    assert sorted(r["n"] for r in got.collect()) == [33, 33, 33, 33, 34, 34]


def test_duplicates_and_clocks(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 30).alias("key"), F.timestamp_seconds(DAY + F.col("id") % 30).alias("ts"), F.timestamp_seconds(DAY + F.col("id") % 30 + F.col("id") * 30).alias("recv"))
    s = stream(spark, tmp_path, rows)
    assert run(spark, live.deduplicate(s, ["key"], "ts")).count() == 30
    got = run(spark, live.two_clocks(s, "ts", "recv")).collect()
    assert len(got) == 60 and sum(r["late"] for r in got) == sum(k * 30 > 600 for k in range(60))


def test_trips_as_in_batch(spark, tmp_path, rocks):
    rows = spark.range(300).select((F.col("id") % 5).alias("usr"), (F.col("id") % 2).alias("mint"), F.col("id").alias("recv"), F.col("id").alias("seq"), (F.col("id") * 7 % 11 < 6).alias("buy"), (F.col("id") % 13 + 1.0).alias("sol"), (F.col("id") * 3 % 10 + 1.0).alias("tok"))
    got = run(spark, live.round_trips(stream(spark, tmp_path, rows)))
    cols = ["usr", "mint", "opened", "closed", "sol_in", "sol_out", "n_buys", "n_sells"]
    want = trips.round_trips(rows).where("closed IS NOT NULL").select(cols)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.collect())) and want.count() > 10


def test_triggers_as_in_batch(spark, tmp_path, rocks):
    rows = spark.range(300).select((F.col("id") % 4).alias("key"), (F.col("id") * F.col("id") % 17 + F.col("id") * 10).alias("t")).orderBy("t")
    s = stream(spark, tmp_path, rows)
    got = run(spark, live.triggers(s, 100))
    assert sorted(got.collect()) == sorted(folds.cooldown(rows, ["key"], "t", 100).select("key", "t").collect())
    assert run(spark, live.triggers(s, 0, once=True)).count() == 4


def test_quotes_are_thinned(spark, tmp_path, rocks):
    """What waits comes out when it is due, wherever batches are cut, and as over a table."""
    ms, begin = 1000, DAY * 1_000_000
    rows = [(1, 0, 10.0, 1.0), (1, 10, 10.1, 1.0), (1, 20, 10.0, 1.0), (1, 60, 10.2, 1.0), (1, 70, 10.2, 5.0), (1, 900, 10.2, 7.0), (2, 9000, 1.0, 1.0)]
    df = spark.createDataFrame([(k, begin + t * ms, p, s) for k, t, p, s in rows], "key long, t long, price double, size double").orderBy("t")
    want = [(1, begin, 10.0, 1.0), (1, begin + 60 * ms, 10.2, 1.0), (1, begin + 560 * ms, 10.2, 5.0), (1, begin + 1060 * ms, 10.2, 7.0), (2, begin + 9000 * ms, 1.0, 1.0)]
    assert sorted(map(tuple, live.coalesced(df, ["t"], 50 * ms, 500 * ms).collect())) == want
    for parts in (1, 7):
        (tmp_path / str(parts)).mkdir()
        assert sorted(map(tuple, run(spark, live.coalesce_quotes(stream(spark, tmp_path / str(parts), df, parts))).collect())) == want


def test_creates_with_snapshots(spark):
    touches = spark.createDataFrame([(1, 0), (2, 100)], "key long, s long").select("key", F.timestamp_seconds(F.col("s") + DAY).alias("made"))
    events = spark.createDataFrame([(1, 10), (1, 4000), (2, 50), (2, 200)], "key long, s long").select("key", F.timestamp_seconds(F.col("s") + DAY).alias("at"))
    batch = live.with_snapshots(touches, events, "key", "made", "at")
    assert sorted((r["key"], r["at"] is not None) for r in batch.collect()) == [(1, True), (2, True)]


def test_watches_are_extended(spark, tmp_path, rocks):
    """A touch moves the end of its key's watch; every event comes once, wherever batches are cut; a watch that is over comes with
    its count, from the next row of its key or from the timer."""
    touch, event = True, False
    rows = [(1, 0, 0, touch), (1, 1, 0, event), (1, 2, 50, touch), (1, 3, 150, event), (1, 4, 151, event), (2, 5, 160, event), (1, 6, 200, touch), (2, 7, 210, touch), (1, 8, 300, event), (2, 9, 900, event), (3, 10, 5000, event)]
    base = DAY * 1000
    df = spark.createDataFrame([(k, i, base + ms, x) for k, i, ms, x in rows], "key long, id long, ms long, touch boolean").orderBy("id")
    seen = [(1, 1, 0, 0, 1), (1, 3, 0, 150, 2), (1, 8, 200, 300, 1)]
    ended = [(1, None, 0, 150, 2), (1, None, 200, 300, 1), (2, None, 210, 310, 0)]
    plain = lambda df: sorted(((r["key"], r["id"], r["since"] - base, r["ms"] - base, r["n"]) for r in df.collect()), key=str)
    for parts in (1, 5):
        (tmp_path / str(parts)).mkdir()
        assert plain(run(spark, live.watched(stream(spark, tmp_path / str(parts), df, parts), 100, "1 second"))) == sorted(seen + ended, key=str)
    assert plain(live.watched_in(df, 100)) == sorted(seen, key=str)


def test_positions_begin_and_expire(spark, tmp_path, rocks):
    """A stream that begins with a table's open trips closes them; with a time to live, what is forgotten is not closed."""
    rows = spark.range(400).select((F.col("id") % 5).alias("usr"), (F.col("id") % 2).alias("mint"), F.col("id").alias("recv"), F.col("id").alias("seq"), (F.col("id") * 7 % 11 < 6).alias("buy"), (F.col("id") % 13 + 1.0).alias("sol"), (F.col("id") * 3 % 10 + 1.0).alias("tok"))
    cols = ["usr", "mint", "opened", "closed", "sol_in", "sol_out", "bought", "sold", "n_buys", "n_sells"]
    before = trips.round_trips(rows.where("recv < 150"), with_state=True)
    late = stream(spark, tmp_path, rows.where("recv >= 150"), 3)
    got = run(spark, live.round_trips(late, before)).select(cols).union(before.where("closed IS NOT NULL").select(cols))
    want = trips.round_trips(rows).where("closed IS NOT NULL").select(cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert before.where("closed IS NULL AND pos > 0 AND peak >= pos").count() > 3

    prints = spark.createDataFrame([(1, 1, 1, 1, True, 1.0, 1.0), (1, 1, 2, 2, False, 1.0, 1.0)], rows.schema)
    path, sink, mark = (str(tmp_path / x) for x in ("prints", "sink", "mark"))

    def half(cut, ttl):
        prints.where(cut).write.mode("append").parquet(f"{path}-{ttl}")
        q = live.round_trips(spark.readStream.schema(rows.schema).parquet(f"{path}-{ttl}"), ttl_ms=ttl)
        q.writeStream.format("parquet").option("path", f"{sink}-{ttl}").option("checkpointLocation", f"{mark}-{ttl}").trigger(availableNow=True).start().awaitTermination(120)

    for ttl, closed in ((1, 0), (3_600_000, 1)):
        half("buy", ttl)
        half("NOT buy", ttl)
        assert spark.read.schema(live.round_trips(spark.readStream.schema(rows.schema).parquet(f"{path}-{ttl}")).schema).parquet(f"{sink}-{ttl}").count() == closed


@pytest.mark.parametrize("buckets", [2, 64])
def test_positions_in_buckets(spark, tmp_path, rocks, buckets):
    """State by buckets of keys: a value for many keys, the same trips, over several batches and from a table's open trips."""
    rows = spark.range(500).select((F.col("id") * 13 % 23).alias("usr"), (F.col("id") % 3).alias("mint"), F.col("id").alias("recv"), F.col("id").alias("seq"), (F.col("id") * 7 % 11 < 6).alias("buy"), (F.col("id") % 13 + 1.0).alias("sol"), (F.col("id") * 3 % 10 + 1.0).alias("tok"))
    cols = ["usr", "mint", "opened", "closed", "sol_in", "sol_out", "bought", "sold", "n_buys", "n_sells"]
    before = trips.round_trips(rows.where("recv < 150"), with_state=True)
    got = run(spark, live.round_trips(stream(spark, tmp_path, rows.where("recv >= 150"), 2), before, buckets=buckets)).select(cols).union(before.where("closed IS NOT NULL").select(cols))
    want = trips.round_trips(rows).where("closed IS NOT NULL").select(cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        live.round_trips(rows, ttl_ms=1, buckets=buckets)
