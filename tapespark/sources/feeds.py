"""Feeds and snapshots: JSON lines, event logs in binary, Parquet and CSV snapshots."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BAD = "_bad"


def read_feed(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """JSON lines, gzip or plain: lines that do not parse go, a cut gzip gives its readable part; ``src_file`` is kept."""
    rows = spark.read.schema(_with_bad(schema)).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("ignoreCorruptFiles", True).json(path)
    return _good(rows)


def stream_feed(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 1000) -> DataFrame:
    """The same feed as a stream of rotating files."""
    rows = spark.readStream.schema(_with_bad(schema)).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return _good(rows)


def _with_bad(schema: StructType | str) -> StructType:
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return StructType([*kind.fields]).add(BAD, "string")


def _good(rows: DataFrame) -> DataFrame:
    return rows.withColumn("src_file", F.col("_metadata.file_name")).where(F.col(BAD).isNull()).drop(BAD)


def load_incremental(rows: DataFrame, path: str) -> None:
    """Write by ``src_file``; a file that has grown replaces its own partition and no other."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("src_file").parquet(path)


def load_feed(spark: SparkSession, folder: str, schema: StructType | str, table: str, ledger: str, settled_s: int = 3600) -> int:
    """Load a folder's feed files into ``table``: a finished file once, one that may still grow on every run. Returns how many.

    A file is finished when it was last changed ``settled_s`` or more before. The ledger has a row (name, complete, loaded) for
    each load, and is only added to; names pass through the driver, rows do not.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), (F.current_timestamp() - F.make_dt_interval(secs=F.lit(settled_s)) >= F.col("modificationTime")).alias("complete"))
    todo = files
    try:
        done = spark.read.schema("name string, complete boolean, loaded timestamp").parquet(ledger).where("complete")
        todo = files.join(done, "name", "left_anti")
    except AnalysisException:  # the first load
        pass
    found = todo.select("path", "name", "complete").collect()
    if found:
        load_incremental(read_feed(spark, [r["path"] for r in found], schema), table)
        seen = spark.createDataFrame([(r["name"], r["complete"]) for r in found], "name string, complete boolean")
        seen.withColumn("loaded", F.current_timestamp()).write.mode("append").parquet(ledger)
    return len(found)


def poll_rows(lines: DataFrame, column: str, coin: str) -> DataFrame:
    """Answers of polls, a JSON object each, to a row for each coin in them: recv_ms, n, and the coin's fields.

    Answers that do not parse or report an error go, and of answers at one millisecond one counts. A poll without coins gives one
    row of nulls.
    """
    x = F.from_json(column, f"recv double, n long, error string, coins array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in coin.split(','))}>>")
    polls = lines.select(x.alias("x")).where("x.recv IS NOT NULL AND x.error IS NULL").select(F.round(F.col("x.recv") * 1000).cast("long").alias("recv_ms"), "x.n", "x.coins")
    return polls.dropDuplicates(["recv_ms"]).select("recv_ms", "n", F.explode_outer("coins").alias("c")).select("recv_ms", "n", "c.*")


def unlocks(files: DataFrame, key: str, body: str, classes: dict[str, str], names: list[str]) -> DataFrame:
    """Schedules, a JSON object of events (day, allocations of category and amount) per key, to a row per day on which something
    vests: vest, an amount for each class, the supply unlocked before the day, and vest as a percentage of that."""
    events = F.from_json(body, "events array<struct<day:long,allocations:array<struct<category:string,amount:double>>>>")["events"]
    rows = files.select(key, F.explode(events).alias("e")).select(key, F.col("e.day").alias("day"), F.explode("e.allocations").alias("a")).select(key, "day", "a.category", "a.amount").where("amount > 0")
    known = F.create_map(*(F.lit(x) for pair in classes.items() for x in pair))
    rows = rows.withColumn("class", F.try_element_at(known, F.col("category")))
    of = lambda name: F.round(F.coalesce(F.sum(F.when(F.col("class") == name, F.col("amount"))), F.lit(0.0)), 2).alias(name)
    days = rows.groupBy(key, "day").agg(F.sum(F.when(F.col("class").isNotNull(), F.col("amount"))).alias("vest"), *map(of, names), F.sum("amount").alias("total"))
    days = days.withColumn("before", F.sum("total").over(Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)))
    return days.where("vest > 0").select(key, "day", F.round("vest", 2).alias("vest"), *names, F.round(F.coalesce("before", F.lit(0.0)), 2).alias("circulating"), F.round(100 * F.col("vest") / F.col("before"), 4).alias("size_pct"))


def export_parquet(tables: dict[str, DataFrame], path: str) -> None:
    """One zstd Parquet folder per table."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}.parquet")


def import_parquet(spark: SparkSession, path: str, name: str, old: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Read a table back; with ``old``, upsert by its keys."""
    new = spark.read.parquet(f"{path}/{name}.parquet")
    if old is None:
        return new
    from ..operators.evidence import upsert

    both = upsert(old.withColumn("__load", F.lit(0)), new.withColumn("__load", F.lit(1)), keys or [], "__load")
    return both.drop("__load")


def export_csv(rows: DataFrame, path: str, order: list[str], synthetic: str = "is_synthetic") -> None:
    """Ordered CSV with a header, synthetic rows left out."""
    rows = rows.where(~F.coalesce(F.col(synthetic), F.lit(False))).drop(synthetic) if synthetic in rows.columns else rows
    rows.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def export_views(views: dict[str, tuple[DataFrame, list[str]]], path: str, synthetic: str = "is_synthetic") -> None:
    """A CSV folder for each view (rows, order)."""
    for name, (rows, order) in views.items():
        export_csv(rows, f"{path}/{name}", order, synthetic)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files: file, line (from 1 in its file), value."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    return rows.select("file", F.row_number().over(Window.partitionBy("file").orderBy("block", "i")).alias("line"), "value")


def import_lines(lines: DataFrame, schema: str, rules: dict[str, str], path: str) -> DataFrame:
    """Append JSON lines (file, line, value) to a table if every one parses and breaks no rule (message: SQL condition of a bad
    row). Returns the problems: file, line, problem; none means that the rows are in."""
    parsed = lines.where("trim(value) <> ''").withColumn("x", F.from_json("value", schema))
    names = StructType.fromDDL(schema).names
    rows = parsed.select("file", "line", "x.*", (F.col("x").isNull() | F.expr(" AND ".join(f"x.`{n}` IS NULL" for n in names))).alias(BAD))
    found = F.array(F.when(F.col(BAD), F.lit("no such row")), *(F.when(~F.col(BAD) & F.expr(bad), F.lit(message)) for message, bad in rules.items()))
    problems = rows.select("file", "line", F.explode(F.filter(found, lambda m: m.isNotNull())).alias("problem"))
    if problems.isEmpty():
        rows.select(*names).write.mode("append").parquet(path)
    return problems


def import_all_or_nothing(rows: DataFrame, problems: DataFrame, path: str) -> int:
    """Append the rows only if there are no problems; returns the number of problems."""
    n = problems.count()
    if n == 0:
        rows.write.mode("append").parquet(path)
    return n


def compact(rows: DataFrame, path: str, hour: str, order: list[str]) -> None:
    """One file per hour, sorted inside."""
    rows.repartition(hour).sortWithinPartitions(hour, *order).write.mode("overwrite").partitionBy(hour).parquet(path)


def _slice(data: Column, at: Column | int, n: int) -> Column:
    start = (at if isinstance(at, Column) else F.lit(at)) + 1
    return F.substring(data, start, F.lit(n))


def little_endian(value: Column, n: int = 8) -> Column:
    """The low ``n`` bytes of a number, the least first."""
    x = value.cast("long")
    turned = [F.shiftleft(F.shiftright(x, 8 * k).bitwiseAND(F.lit(255).cast("long")), 56 - 8 * k) for k in range(8)]
    whole = F.unhex(F.lpad(F.hex(reduce(Column.bitwiseOR, turned)), 16, "0"))
    return whole if n == 8 else F.substring(whole, 1, n)


def u64(data: Column, at: Column | int) -> Column:
    """A little-endian unsigned 64-bit field as DECIMAL(20,0); null past the end."""
    raw = F.hex(_slice(data, at, 8))
    turned = F.concat(*(F.substring(raw, 15 - 2 * k, 2) for k in range(8)))
    return F.when(F.length(raw) == 16, F.conv(turned, 16, 10).cast("decimal(20,0)"))


def u32(data: Column, at: Column | int) -> Column:
    raw = F.hex(_slice(data, at, 4))
    turned = F.concat(*(F.substring(raw, 7 - 2 * k, 2) for k in range(4)))
    return F.when(F.length(raw) == 8, F.conv(turned, 16, 10).cast("long"))


def decode_events(logs: DataFrame, data: str, kinds: dict[str, tuple[str, int, dict[str, tuple[str, int]]]]) -> DataFrame:
    """Binary events to rows: kind and its fields; ``kinds`` maps a name to (discriminator hex, least length, fields).

    A field is (type, offset) with the types u64, u32, bool, and key (32 bytes as hex). Unknown and short events go. Fields are cut
    out of a batch's bytes as arrays, so a log is made, and read from base64, once, whatever the number of fields.
    """
    raw = F.unbase64(F.col(data)) if logs.schema[data].dataType.simpleString() == "string" else F.col(data)
    others = [c for c in logs.columns if c != data]
    types = {"u64": "decimal(20,0)", "u32": "long", "bool": "boolean", "key": "string"}
    fields: dict[str, dict[int, tuple[str, int]]] = {}
    for k, (_, _, of) in enumerate(kinds.values()):
        for field, place in of.items():
            fields.setdefault(field, {})[k] = place
    schema = StructType([*logs.select(*others).schema.fields]).add("kind", "string")
    for field, of in fields.items():
        schema = schema.add(field, types[next(iter(of.values()))[0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("__raw").cast(pa.large_binary())
            ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
            data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
            start, size = ends[:-1], np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
            cut = lambda rows, at, n, start=start, data=data: data[start[rows, None] + np.arange(at, at + n)]
            which = np.full(len(column), -1)
            for k, (mark, least, _) in enumerate(kinds.values()):
                rows = np.flatnonzero(size >= max(least, 8))
                which[rows[(cut(rows, 0, 8) == np.frombuffer(bytes.fromhex(mark), np.uint8)).all(1)]] = k
            kept = np.flatnonzero(which >= 0)
            place = np.zeros(len(column), np.int64)
            place[kept] = np.arange(len(kept))
            out = [batch.column(c).take(pa.array(kept)) for c in others] + [pa.array([*kinds], pa.string()).take(pa.array(which[kept]))]
            for of in fields.values():
                type_ = next(iter(of.values()))[0]
                values, null = np.zeros(len(kept), {"u64": np.uint64, "u32": np.int64, "bool": bool, "key": object}[type_]), np.ones(len(kept), bool)
                for k, (_, at) in of.items():
                    rows = np.flatnonzero(which == k)
                    if type_ in ("u64", "u32"):
                        width = 8 if type_ == "u64" else 4
                        rows = rows[size[rows] >= at + width]
                        values[place[rows]] = cut(rows, at, width).view(f"<u{width}")[:, 0]
                    elif type_ == "bool":  # past the end true, as what is not zero
                        values[place[rows]] = True
                        inside = rows[size[rows] > at]
                        values[place[inside]] = cut(inside, at, 1)[:, 0] != 0
                    else:
                        values[place[rows]] = [data[start[i] + min(at, size[i]) : start[i] + min(at + 32, size[i])].tobytes().hex() for i in rows]
                    null[place[rows]] = False
                array = pa.array(values, mask=null)
                out.append(array.cast(pa.decimal128(20, 0)) if type_ == "u64" else array.cast(pa.string()) if type_ == "key" else array)
            yield pa.RecordBatch.from_arrays(out, schema.names)

    return logs.select(*others, raw.alias("__raw")).mapInArrow(run, schema)


def strings(data: Column, at: int, n: int) -> list[Column]:
    """``n`` length-prefixed strings one after the other; offsets are columns of the lengths before them."""
    out, where = [], F.lit(at)
    for _ in range(n):
        size = u32(data, where)
        out.append(F.substring(data, (where + 5).cast("int"), size.cast("int")).cast("string"))
        where = where + 4 + size
    return out


def swaps(transactions: DataFrame) -> DataFrame:
    """Wallet swaps of parsed transactions: per token the change of balance, against that of SOL and wrapped SOL with the fee.

    Takes sig, wallet, fee, sol_pre, sol_post and arrays ``pre`` and ``post`` of (owner, mint, amount). The SOL leg is null if
    over one token changed or the signs agree. Transactions are shuffled once: the wallet's balances, and its change of SOL as an entry
    with the transaction's number, then stand together.
    """
    entry = lambda mint, d, tx: F.struct(mint.cast("string").alias("mint"), d.cast("double").alias("d"), tx.cast("long").alias("tx"))
    none = F.lit(None)
    of_wallet = lambda name, sign: F.coalesce(F.transform(F.filter(name, lambda b: b["owner"] == F.col("wallet")), lambda b: entry(b["mint"], sign * b["amount"], none)), F.array().cast("array<struct<mint:string,d:double,tx:bigint>>"))
    numbered = transactions.where("sig IS NOT NULL AND wallet IS NOT NULL").withColumn("tx", F.monotonically_increasing_id())
    dsol = F.array(entry(none, F.col("sol_post") - F.col("sol_pre") + F.col("fee"), F.col("tx")))
    rows = numbered.select("sig", "wallet", F.concat(of_wallet("pre", -1.0), of_wallet("post", 1.0), dsol).alias("b")).repartition("sig", "wallet").select("sig", "wallet", F.inline("b"))
    change = rows.groupBy("sig", "wallet", "tx", "mint").agg(F.sum("d").alias("tok")).where("tx IS NOT NULL OR abs(tok) > 1e-12")
    of_tx = Window.partitionBy("sig", "wallet")
    token, wrapped = F.col("tx").isNull() & (F.col("mint") != "WSOL"), F.col("tx").isNull() & (F.col("mint") == "WSOL")
    sols = F.collect_list(F.when(F.col("tx").isNotNull(), F.struct(F.col("tok").alias("dsol")))).over(of_tx)
    change = change.select("sig", "wallet", "mint", "tok", token.alias("token"), F.count_if(token).over(of_tx).alias("changed"), F.sum(F.when(wrapped, F.col("tok"))).over(of_tx).alias("wsol"), sols.alias("sols"))
    legs = change.where("token").select("sig", "wallet", "mint", "tok", "changed", "wsol", F.inline("sols"))
    leg = F.col("dsol") + F.coalesce("wsol", F.lit(0.0))
    return legs.select("sig", "wallet", "mint", "tok", F.when((F.col("changed") == 1) & (F.signum(leg) == -F.signum(F.col("tok"))), leg).alias("sol"))
