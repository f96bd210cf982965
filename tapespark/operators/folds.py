"""Ordered folds that windows cannot express: each walks sorted partitions, with a small state between rows."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def sweep(rows: DataFrame, by: list[str], order: list, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``run`` over partitions that hold whole keys, sorted by key and order. Its state goes on from batch to batch, so that no
    key is ever held in memory, whatever its number of rows."""
    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def cooldown(events: DataFrame, by: list[str], at: str, gap: int, order: list[str] | None = None) -> DataFrame:
    """Keep an event only if it comes ``gap`` or more after the last kept one of its key; the choice is greedy in time order.

    Events without a time are not kept.
    """
    names, time = [events.columns.index(c) for c in by], events.columns.index(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, 0
        for batch in batches:
            kept = []
            for *now, t in zip(*(batch.column(k).to_pylist() for k in names), batch.column(time).to_pylist(), strict=True):
                free = now != key or t - last >= gap
                if free:
                    key, last = now, t
                kept.append(free)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return sweep(events.where(F.col(at).isNotNull()), by, [at, *(order or [])], run, events.schema)


class Stairs:
    """Later prints that are further out than all before them, nearest first: finds the first one at or beyond a level in steps
    of the logarithm. Prints come in falling order of time."""

    def __init__(self) -> None:
        self.level: list[float] = []  # falling from the far end to the near end
        self.time: list[int] = []

    def add(self, level: float, time: int) -> None:
        while self.level and self.level[-1] <= level:
            self.level.pop()
            self.time.pop()
        self.level.append(level)
        self.time.append(time)

    def first(self, level: float) -> int | None:
        """Time of the first print at or above the level."""
        k = bisect_right(self.level, -level, key=lambda x: -x)
        return self.time[k - 1] if k else None


def first_touch(prints: DataFrame, key: str, at: str, price: str, entry: str, up: float, down: float, hold: int) -> DataFrame:
    """The entries (rows where ``entry`` is true) with ``tp`` and ``sl``: when a later print of the key, at most ``hold`` after,
    first is at or above ``up`` times, or at or below ``down`` times, the entry's price; null if none is.

    Time is cut in blocks of four holds, and a block also gets the prints of one hold after it, so a busy key goes to many
    tasks. Each task walks its prints back in time over two stairs of extremes: no pairs are made.
    """
    block = F.floor(F.col(at) / (4 * hold)).cast("long")
    here = F.explode(F.array_distinct(F.array(block, F.floor((F.col(at) - hold) / (4 * hold)).cast("long"))))
    rows = prints.where(F.col(at).isNotNull() & F.col(price).isNotNull()).withColumn("__own", block).withColumn("__block", here)
    names = prints.columns
    places = {c: rows.columns.index(c) for c in (key, "__block", "__own", at, price, entry)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, high, low, pending, then = None, Stairs(), Stairs(), [], None
        for batch in batches:
            tp, sl, out = [], [], []
            columns = [batch.column(places[c]).to_pylist() for c in (key, "__block", "__own", at, price, entry)]
            for k, blk, own, t, px, is_entry in zip(*columns, strict=True):
                if (k, blk) != now:
                    now, high, low, pending, then = (k, blk), Stairs(), Stairs(), [], None
                if t != then:  # prints of the same time are not later ones
                    for level, time in pending:
                        high.add(level, time)
                        low.add(-level, time)
                    pending, then = [], t
                wanted = bool(is_entry) and own == blk
                out.append(wanted)
                if wanted:
                    a, b = high.first(up * px), low.first(-down * px)
                    tp.append(a if a is not None and a <= t + hold else None)
                    sl.append(b if b is not None and b <= t + hold else None)
                pending.append((px, t))
            part = batch.filter(pa.array(out, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(tp, pa.int64()), pa.array(sl, pa.int64())], [*names, "tp", "sl"])

    schema = StructType([*prints.schema.fields]).add("tp", "long").add("sl", "long")
    return sweep(rows, [key, "__block"], [F.col(at).desc()], run, schema)
