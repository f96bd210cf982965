import base64
import gzip
import json
import os
import struct

import numpy as np
from pyspark.sql import functions as F

from tapespark.sources import documents, feeds


def test_binary_events(spark):
    mark, other = bytes(range(8)), bytes(range(8, 16))
    body = lambda m, *xs: base64.b64encode(m + struct.pack("<QQ?", *xs) + bytes(32)).decode()
    rows = [(1, body(mark, 2**64 - 1, 5, True)), (2, body(other, 7, 8, False)), (3, base64.b64encode(b"zz").decode()), (4, base64.b64encode(mark + b"x").decode())]
    kinds = {"buy": (mark.hex(), 25, {"sol": ("u64", 8), "tok": ("u64", 16), "flag": ("bool", 24), "user": ("key", 25)}), "sell": (other.hex(), 25, {"tok": ("u64", 8), "sol": ("u64", 16)})}
    got = {r["id"]: r for r in feeds.decode_events(spark.createDataFrame(rows, "id long, data string"), "data", kinds).collect()}
    assert set(got) == {1, 2}
    assert (int(got[1]["sol"]), int(got[1]["tok"]), got[1]["flag"], got[1]["user"]) == (2**64 - 1, 5, True, "00" * 32)
    assert (int(got[2]["sol"]), int(got[2]["tok"]), got[2]["flag"]) == (8, 7, None)


def test_fields_past_the_end_and_numbers_in_bytes(spark):
    numbers = spark.createDataFrame([(1, 258), (2, -2)], "id long, x long")
    rows = numbers.select("id", F.concat(F.unhex(F.lit("0102030405060708")), feeds.little_endian(F.col("x")), feeds.little_endian(F.col("x"), 4)).alias("data"))
    assert bytes(rows.where("id = 1").first()["data"])[8:] == struct.pack("<qI", 258, 258)
    kinds = {"a": ("0102030405060708", 8, {"x": ("u64", 8), "y": ("u32", 16), "z": ("u64", 13)})}
    got = {r["id"]: r for r in feeds.decode_events(rows, "data", kinds).collect()}
    assert (int(got[1]["x"]), got[1]["y"], got[1]["z"], int(got[2]["x"]), got[2]["y"]) == (258, 258, None, 2**64 - 2, 2**32 - 2)


def test_logs_are_made_once(spark):
    """Neither the filter by kind nor the fields repeat the expression that a log comes from."""
    logs = spark.range(3).select("id", F.base64(F.concat(F.unhex(F.lit("0102030405060708")), F.unhex(F.lpad(F.hex("id"), 16, "0")))).alias("data"))
    out = feeds.decode_events(logs, "data", {"a": ("0102030405060708", 16, {"x": ("u64", 8), "y": ("u64", 8)})})
    assert out.count() == 3
    assert out._jdf.queryExecution().executedPlan().toString().count("unbase64(") == 1


def test_strings_in_events(spark):
    data = b"\0" * 8 + b"".join(struct.pack("<I", len(s)) + s for s in (b"name", b"SYM", b"http://x"))
    df = spark.createDataFrame([(bytearray(data),)], "data binary")
    assert tuple(df.select(*feeds.strings(F.col("data"), 8, 3)).first()) == ("name", "SYM", "http://x")


def test_swaps(spark):
    rows = [("a", "w", 0.01, 10.0, 8.0, [("w", "T", 0.0)], [("w", "T", 5.0), ("z", "T", 9.0)]), ("b", "w", 0.0, 1.0, 1.0, [("w", "T", 5.0), ("w", "WSOL", 0.0)], [("w", "T", 1.0), ("w", "WSOL", 3.0)]), ("c", "w", 0.0, 5.0, 4.0, [], [("w", "T", 1.0), ("w", "U", 1.0)])]
    bal = "array<struct<owner:string,mint:string,amount:double>>"
    df = spark.createDataFrame(rows, f"sig string, wallet string, fee double, sol_pre double, sol_post double, pre {bal}, post {bal}")
    got = {(r["sig"], r["mint"]): (r["tok"], None if r["sol"] is None else round(r["sol"], 6)) for r in feeds.swaps(df).collect()}
    assert got == {("a", "T"): (5.0, -1.99), ("b", "T"): (-4.0, 3.0), ("c", "T"): (1.0, None), ("c", "U"): (1.0, None)}


def test_round_trips_of_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", False), (2, "b", True)], "id long, v string, is_synthetic boolean")
    feeds.export_parquet({"t": df}, str(tmp_path))
    assert sorted(feeds.import_parquet(spark, str(tmp_path), "t").collect()) == sorted(df.collect())
    old = spark.createDataFrame([(1, "old", False), (9, "kept", False)], df.schema)
    assert {(r["id"], r["v"]) for r in feeds.import_parquet(spark, str(tmp_path), "t", old, ["id"]).collect()} == {(1, "a"), (2, "b"), (9, "kept")}
    feeds.export_csv(df, str(tmp_path / "csv"), ["id"])
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == [("1", "a")]
    path = str(tmp_path / "part")
    feeds.load_incremental(spark.createDataFrame([(1, "f1"), (2, "f2")], "id long, src_file string"), path)
    feeds.load_incremental(spark.createDataFrame([(3, "f1"), (4, "f1")], "id long, src_file string"), path)
    assert {r["id"] for r in spark.read.parquet(path).collect()} == {2, 3, 4}
    assert feeds.import_all_or_nothing(df, df.where("id = 2"), str(tmp_path / "no")) == 1 and not (tmp_path / "no").exists()
    assert feeds.import_all_or_nothing(df, df.limit(0), str(tmp_path / "yes")) == 0
    feeds.compact(df.withColumn("hour", F.lit(3)), str(tmp_path / "hours"), "hour", ["id"])
    assert spark.read.parquet(str(tmp_path / "hours")).count() == 2


CAPTIONS = """WEBVTT - made up
STYLE

NOTE nothing here

intro
00:07.5 --> 00:09.25 align:start
good <i>morning</i>

00:09.250 --> 01:02:03.1
good morning
fish &amp; chips &#8212; 3 &lt; 4 &#x263A; &bogus;

00:11,000 --> 00:12,000
fish & chips \u2014 3 < 4 \u263a &bogus;
last one

xx:yy --> 00:13.000
not a cue
"""


def test_captions_and_paragraphs(spark):
    df = spark.createDataFrame([("f", CAPTIONS), ("g", CAPTIONS.replace("\n", "\r\n"))], "file string, body string")
    want = [(0, 7.5, 9.25, "good morning"), (1, 9.25, 3723.1, "fish & chips \u2014 3 < 4 \u263a &bogus;"), (2, 11.0, 12.0, "last one")]
    rows = documents.cues(df, "file", "body").orderBy("file", "seq").collect()
    assert [tuple(r) for r in rows] == [("f", *x) for x in want] + [("g", *x) for x in want]
    roll = spark.createDataFrame([("f", k, f"0:{k:02d} --> 0:{k + 1:02d}\n" + "\n".join(x)) for k, x in enumerate((["a"], ["a", "b"], ["b", "c"], ["c", "d"], ["a"], ["d", "a"]))], "file string, block int, cue string")
    assert [r["text"] for r in documents.segments(roll, "file").orderBy("seq").collect()] == ["a", "b", "c", "d", "a"]
    text = spark.createDataFrame([("f", "one\n two\n\n \n three ")], "file string, body string")
    assert [r["text"] for r in documents.paragraphs(text, "file", "body").orderBy("seq").collect()] == ["one two", "three"]
    js = spark.createDataFrame([("f", '[{"start":1,"end":2,"text":"x"}]')], "file string, body string")
    assert [tuple(r) for r in documents.transcript_json(js, "file", "body").collect()] == [("f", 0, 1.0, 2.0, "x")]


def test_pages(spark):
    html = "<html lang='en'><head><title> T &amp; U </title><style>x{}</style></head><body><p>Hi <b>you</b></p><a href='http://a.b/c'>l</a><a href='http://a.b/c'>l</a></body></html>"
    df = spark.createDataFrame([("u", html), ("v", html)], "url string, html string")
    rows = documents.page_snapshots(df).collect()
    assert len({r["snapshot"] for r in rows}) == 1 and rows[0]["links"] == ["http://a.b/c"] and rows[0]["lang"] == "en" and rows[0]["words"] == 7


def test_feeds_with_faults(spark, tmp_path):
    """Bad lines go, a cut gzip gives its readable part, finished files are loaded once and growing ones again."""
    folder, table, ledger = tmp_path / "feed", str(tmp_path / "table"), str(tmp_path / "ledger")
    folder.mkdir()
    line = lambda k: json.dumps({"id": k, "v": "x" * 50 + str(k)}) + "\n"
    noise = np.random.default_rng(1)
    long = "".join(json.dumps({"id": k, "v": noise.bytes(40).hex()}) + "\n" for k in range(20_000)).encode()
    (folder / "cut.jsonl.gz").write_bytes(gzip.compress(long)[: len(gzip.compress(long)) // 2])
    (folder / "old.jsonl").write_text(line(1) + "{broken\n" + line(2))
    (folder / "new.jsonl").write_text(line(3))
    os.utime(folder / "old.jsonl", (1, 1))
    os.utime(folder / "cut.jsonl.gz", (1, 1))
    assert feeds.load_feed(spark, str(folder), "id long, v string", table, ledger) == 3
    rows = spark.read.parquet(table)
    some = rows.where("src_file = 'cut.jsonl.gz'").count()
    assert 5_000 < some < 20_000 and {r["id"] for r in rows.where("src_file = 'old.jsonl'").collect()} == {1, 2}
    (folder / "new.jsonl").write_text(line(3) + line(4))
    assert feeds.load_feed(spark, str(folder), "id long, v string", table, ledger) == 1
    rows = spark.read.parquet(table)
    assert rows.count() == some + 4 and {r["id"] for r in rows.where("src_file = 'new.jsonl'").collect()} == {3, 4}


def test_import_of_lines(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"id": 1, "side": "buy"}\n\n{"id": 2, "side": "hold"}\nnonsense\n')
    lines = feeds.numbered_lines(spark, str(tmp_path / "in.jsonl"))
    rules = {"unknown side": "side NOT IN ('buy', 'sell')"}
    assert sorted(tuple(r) for r in feeds.import_lines(lines, "id long, side string", rules, str(tmp_path / "no")).collect()) == [("in.jsonl", 3, "unknown side"), ("in.jsonl", 4, "no such row")]
    assert not (tmp_path / "no").exists()
    assert feeds.import_lines(lines.where("line = 1"), "id long, side string", rules, str(tmp_path / "yes")).collect() == []
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "yes")).collect()] == [(1, "buy")]


def test_views_polls_and_announcements(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", False), (1, "a", False), (3, "c", True)], "id long, v string, is_synthetic boolean")
    feeds.export_views({f"view{k}": (df, ["id"]) for k in range(7)}, str(tmp_path / "out"))
    assert [[tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "out" / f"view{k}")).collect()] for k in range(7)] == [[("1", "a"), ("2", "b")]] * 7
    polls = ['{"recv": 1.0004, "n": 2, "coins": [{"mint": 5, "viewers": 1.5}, {"mint": 6}]}', '{"recv": 1.0004, "n": 2, "coins": []}', '{"recv": 2, "error": "no"}', "{", '{"recv": 3, "n": 0, "coins": []}']
    got = feeds.poll_rows(spark.createDataFrame([(p,) for p in polls[:1] + polls[2:]], "line string"), "line", "mint long, viewers double").collect()
    assert sorted(map(tuple, got), key=str) == [(1000, 2, 5, 1.5), (1000, 2, 6, None), (3000, 0, None, None)]
    titles = spark.createDataFrame([(1, "We Will Drop A, B and C & D soon"), (2, "hello"), (3, None)], "id long, title string")
    assert sorted(tuple(r) for r in documents.announced(titles, "title", {"drop": "Will Drop (.+) soon"}).collect()) == [(1, "drop", x) for x in "ABCD"]


def test_repeats_of_lists_are_dropped_without_the_lists(spark):
    """What is dealt out and sorted to drop repeats is a digest and two numbers."""
    from tapespark import plans

    out = plans.QUERIES["s27_list_offsets"](spark, "/root/testdata/sf0.001")
    assert out.count() == out.select("id").distinct().count()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "first(data" not in plan and "sha2(" in plan
