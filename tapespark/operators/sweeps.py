"""Sweeps in time with a state that windows don't have: a leader over keys, a high with what came since, clusters with a cooldown.

Where the state reaches back only so far, time is cut in blocks and a block also gets the rows of that reach before it, so that one
busy key, or all keys together, are many tasks' work.
"""

from __future__ import annotations

import heapq
from collections import Counter, OrderedDict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import scratch
from .folds import Stairs, sweep

def in_blocks(rows: DataFrame, at: str, block: int, before: int, after: int = 0) -> DataFrame:
    """The rows with ``__block``, once for each block that they lie in or within ``before`` ahead of or ``after`` behind."""
    first, last = F.floor((F.col(at) - after) / block), F.floor((F.col(at) + before) / block)
    return rows.where(F.col(at).isNotNull()).withColumn("__block", F.explode(F.sequence(first, last)))


class Board:
    """Keys with a value that changes, and the largest one: losers of a change stay below until they would win, and are dropped
    then if they no longer hold. Of equal values the smallest key wins. Memory: the keys put in the last ``fresh``, as what no longer
    holds is cleared out once it is the larger part."""

    def __init__(self, fresh: int) -> None:
        self.fresh, self.now, self.heap, self.most = fresh, {}, [], 1000

    def put(self, key, value: float, t: int) -> None:
        self.now[key] = (value, t)
        heapq.heappush(self.heap, (-value, key, t))
        if len(self.heap) > 2 * len(self.now) + 1000 or len(self.now) > self.most:
            self.now = {k: x for k, x in self.now.items() if t - x[1] <= self.fresh}
            self.heap = [(-x, k, put) for k, (x, put) in self.now.items()]
            heapq.heapify(self.heap)
            self.most = 2 * len(self.now) + 1000

    def top(self, t: int) -> tuple | None:
        """(key, value, when it was put) of the largest value put at most ``fresh`` before."""
        while self.heap:
            value, key, put = self.heap[0]
            if self.now.get(key) == (-value, put):
                if t - put <= self.fresh:
                    return key, -value, put
                del self.now[key]
            heapq.heappop(self.heap)
        return None


def leaders(prints: DataFrame, key: str, at: str, order: list[str], value: str, grid: int, fresh: int, block: int) -> DataFrame:
    """(at, key, value) at every point of the grid at which the leader is another than at the point before, ``at`` a multiple of
    ``grid``. The leader is the key whose last value, at most ``fresh`` old, is the largest (then the smallest key); a null key
    means that there is none any more. ``key`` long.

    Blocks of time begin with the prints of the time before that can still count; each is one task's walk over its prints.
    """
    block = max(grid, block // grid * grid)
    rows = prints.select(F.col(key).cast("long").alias("key"), F.col(at).alias("t"), F.col(value).cast("double").alias("value"), *(F.col(c).alias(f"__o{k}") for k, c in enumerate(order))).dropna(subset=["key", "value"])
    # a print at t counts from the first point at or after it to the last one within fresh: of a block and of one before it
    rows = in_blocks(rows, "t", block, fresh + 2 * grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        board = leader = point = None

        def look(t: int) -> None:
            nonlocal leader
            found = board.top(t)
            if (found and found[0]) != (leader and leader[0]) and now * block <= t < (now + 1) * block:
                out.append((t, found and found[0], found and found[1]))
            leader = found

        def upto(t: int) -> None:
            """The points before t: the next one, and those at which the leader is too old."""
            nonlocal point
            while point is not None and point < t:
                look(point)
                point = None if leader is None else max(point + grid, -(-(leader[2] + board.fresh + 1) // grid) * grid)

        for batch in batches:
            for blk, k, t, v in zip(*(batch.column(c).to_pylist() for c in ("__block", "key", "t", "value")), strict=True):
                if blk != now:
                    if now is not None:
                        upto((now + 1) * block)
                    now, board, leader, point = blk, Board(fresh), None, None
                here = -(-t // grid) * grid
                upto(here)
                board.put(k, v, t)
                point = here
            yield _columns(out, (pa.int64(), pa.int64(), pa.float64()), ["at", "key", "value"])
            out = []
        if now is not None:
            upto((now + 1) * block)
        yield _columns(out, (pa.int64(), pa.int64(), pa.float64()), ["at", "key", "value"])

    return sweep(rows, ["__block"], ["t", *(f"__o{k}" for k in range(len(order)))], run, "at long, key long, value double")


def _columns(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


class Tops:
    """Of every point of a grid the largest value seen, of equal ones that of the smallest key. Memory: the points."""

    def __init__(self) -> None:
        self.base, self.value, self.key = 0, np.zeros(0), np.zeros(0, np.int64)

    def see(self, first: np.ndarray, last: np.ndarray, value: np.ndarray, key: np.ndarray) -> None:
        """Values that hold at the points ``first`` to ``last``."""
        n = np.maximum(last - first + 1, 0)
        if not n.any():
            return
        low, high = int(first[n > 0].min()), int(last[n > 0].max())
        if not len(self.value):
            self.base = low
        before, after = max(0, self.base - low), max(0, high - self.base - len(self.value) + 1)
        if before or after:
            self.base -= before
            self.value = np.concatenate([np.full(before, -np.inf), self.value, np.full(after, -np.inf)])
            self.key = np.concatenate([np.full(x, np.iinfo(np.int64).max) if isinstance(x, int) else x for x in (before, self.key, after)])
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first - self.base, n)
        value, key = np.repeat(value, n), np.repeat(key, n)
        won = (value > self.value[at]) | (value == self.value[at]) & (key < self.key[at])
        at, value, key = at[won], value[won], key[won]
        order = np.lexsort((key, -value, at))
        at, value, key = at[order], value[order], key[order]
        top = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
        self.value[at[top]], self.key[at[top]] = value[top], key[top]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, key, value) of the points with a value."""
        k = np.flatnonzero(self.key != np.iinfo(np.int64).max)
        return k + self.base, self.key[k], self.value[k]


def first_hits(prints: DataFrame, key: str, at: str, order: list[str], price: str, sell: str, flags: list[str], window: int, drop: float, grid: int, fresh: int) -> DataFrame:
    """(variant, key, at), the first time of a key for each variant: those of the columns ``flags``; ``crash``, a sell at ``drop`` times the
    highest price of the last ``window`` or less; ``leader``, a point of the grid at which its last price, at most ``fresh`` old, is the
    largest of all keys (of equal ones the smallest key's).

    Prints that are dealt by key are walked where they are, in order. Leaders are found without dealing prints by time: a price holds
    from its point to the key's next print, and every task keeps the best of each point.
    """
    names = ["variant", "key", "at", "value"]

    def rows_of(variant: str, key_: pa.Array, at_: pa.Array, value: pa.Array | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([variant] * len(key_), pa.string()), key_, at_, pa.nulls(len(key_), pa.float64()) if value is None else value], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, now, done, peaks = Tops(), None, False, deque()
        open_ = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # the last print, whose next one is not known

        def hold(k: np.ndarray, t: np.ndarray, px: np.ndarray) -> None:
            """All but the last of these are followed by the next."""
            until = np.where(k[1:] == k[:-1], -(-t[1:] // grid) - 1, np.iinfo(np.int64).max)
            tops.see(-(-t[:-1] // grid), np.minimum(until, (t[:-1] + fresh) // grid), px[:-1], k[:-1])

        for batch in batches:
            for name in flags:
                hit = pa.Table.from_batches([batch.select(["__key", "__at", name]).filter(batch.column(name))])
                if hit.num_rows:
                    first = hit.group_by("__key").aggregate([("__at", "min")]).combine_chunks().to_batches()[0]
                    yield rows_of(name, first.column("__key"), first.column("__at_min"))
            known = batch.filter(pc.and_(pc.and_(batch.column("__key").is_valid(), batch.column("__at").is_valid()), batch.column("__price").is_valid()))
            if not known.num_rows:
                continue
            k, t, px = (known.column(n).to_numpy() for n in ("__key", "__at", "__price"))
            sold = known.column("__sell").fill_null(False).to_numpy(zero_copy_only=False)
            hold(*(np.concatenate(x) for x in zip(open_, (k, t, px), strict=True)))
            open_ = (k[-1:].copy(), t[-1:].copy(), px[-1:].copy())
            cuts, crashed = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if k[a] != now:
                    now, done = k[a], False
                    peaks.clear()
                if done:
                    continue
                for t_, p, sells in zip(t[a:b].tolist(), px[a:b].tolist(), sold[a:b].tolist(), strict=True):
                    while peaks and peaks[-1][1] <= p:
                        peaks.pop()
                    peaks.append((t_, p))
                    while peaks[0][0] < t_ - window:
                        peaks.popleft()
                    if sells and len(peaks) > 1 and p <= drop * peaks[0][1]:
                        crashed.append((now, t_))
                        done = True
                        break
            if crashed:
                yield rows_of("crash", pa.array([x[0] for x in crashed], pa.int64()), pa.array([x[1] for x in crashed], pa.int64()))
        none = np.iinfo(np.int64).min
        hold(*(np.concatenate([x, y]) for x, y in zip(open_, ([none], [0], [0.0]), strict=True)))
        point, who, value = tops.found()
        yield rows_of("leader", pa.array(who), pa.array(point * grid), pa.array(value))

    fields = {"__key": key, "__at": at, "__price": price, "__sell": sell}
    line = prints.select(*(F.col(c).alias(n) for n, c in fields.items()), *order, *flags).sortWithinPartitions("__key", "__at", *order)
    hits = line.mapInArrow(run, "variant string, key long, at long, value double")
    # of the tasks' leaders of a point the best, of hits all
    lead = F.col("variant") == "leader"
    best = F.max_by("key", F.struct(F.col("value"), (-F.col("key")).alias("low")))
    hits = hits.groupBy("variant", F.when(~lead, F.col("key")).alias("own"), F.when(lead, F.col("at")).alias("point")).agg(best.alias("best"), F.min("at").alias("at"))
    return hits.select("variant", F.coalesce("own", F.when(lead, F.col("best"))).alias("key"), "at").groupBy("variant", "key").agg(F.min("at").alias("at"))


class High:
    """The highest price of the last ``window`` (of equal ones the latest), and who has sold how much since then."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.peaks: deque[tuple[int, int, float]] = deque()  # (place, time, price), prices falling
        self.sells: deque[tuple[int, object, int]] = deque()  # (place, seller, amount) since the high
        self.sold: dict[object, list[int]] = {}  # seller: [amount, sells], the first to sell first

    def add(self, place: int, t: int, price: float, seller, amount: int) -> None:
        """One print; ``seller`` is None for a buy."""
        while self.peaks and self.peaks[-1][2] <= price:
            self.peaks.pop()
        self.peaks.append((place, t, price))
        while self.peaks[0][1] < t - self.window:
            self.peaks.popleft()
        if seller is not None:
            self.sells.append((place, seller, amount))
            held = self.sold.setdefault(seller, [0, 0])
            held[0] += amount
            held[1] += 1
        while self.sells and self.sells[0][0] <= self.peaks[0][0]:
            _, who, gone = self.sells.popleft()
            held = self.sold[who]
            held[0] -= gone
            held[1] -= 1
            if not held[1]:
                del self.sold[who]

    def top_seller(self) -> tuple:
        """(who, amount): the largest seller since the high; of equal ones the one whose name is smallest."""
        who = min(self.sold, key=lambda u: (-self.sold[u][0], u))
        return who, self.sold[who][0]


def crashes(prints: DataFrame, key: str, at: str, order: list[str], price: str, user: str, buy: str, amount: str, window: int, drop: float, confirm: int, block: int, unit: float = 1e9) -> DataFrame:
    """Sells at a price of at most 1 - ``drop`` times the highest of the last ``window``: (key, at, the order columns, fall, since, top,
    top_sold, buyers). ``since``: the time from the high (the latest of equal ones); ``top``: who has sold most after it, and how
    much, summed in whole parts of 1/``unit``; ``buyers``: how many users buy afterwards, up to ``confirm`` later.

    Prints are walked in order; equal times have the order of ``order``. A block of time also gets the prints of one window before
    and one ``confirm`` after it. Memory: what lies within those two.
    """
    fields = {"__key": key, "__at": at, "__price": price, "__user": user, "__buy": buy, "__amount": amount}
    orders = {f"__o{k}": c for k, c in enumerate(order)}
    rows = prints.select(*(F.col(c).alias(n) for n, c in {**fields, **orders}.items())).dropna(subset=list(fields))
    kinds = {n: rows.schema[n].dataType.simpleString() for n in rows.columns}
    rows = in_blocks(rows, "__at", block, window, confirm)
    names = ["__key", "__at", *orders, "fall", "since", "top", "top_sold", "buyers"]
    schema = ", ".join([*(f"{n} {kinds[n]}" for n in ("__key", "__at", *orders)), "fall double, since long", f"top {kinds['__user']}", "top_sold double, buyers long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = high = None
        waiting: deque[list] = deque()
        last_buy: OrderedDict[object, int] = OrderedDict()  # user: place of the last buy, in order
        place, out = 0, []

        def ripe(t: int | None) -> None:
            """Crashes whose time to be confirmed is over before t."""
            while waiting and (t is None or waiting[0][1] + confirm < t):
                row = waiting.popleft()
                n = 0
                for where in reversed(last_buy.values()):
                    if where <= row[-1]:
                        break
                    n += 1
                out.append((*row[:-1], n))

        for batch in batches:
            kinds_ = [batch.column(c).type for c in ("__key", "__at", *orders)]
            columns = [batch.column(c).to_pylist() for c in ("__block", *fields, *orders)]
            for blk, k, t, px, who, bought, sold, *rest in zip(*columns, strict=True):
                if (k, blk) != now:
                    ripe(None)
                    now, high, place = (k, blk), High(window), 0
                    last_buy.clear()
                ripe(t)
                place += 1
                high.add(place, t, px, None if bought else who, round(sold * unit))
                if bought:
                    last_buy[who] = place
                    last_buy.move_to_end(who)
                    continue
                top = high.peaks[0]
                if px <= (1 - drop) * top[2] and t // block == blk and top[0] < place:
                    seller, amount_ = high.top_seller()
                    waiting.append([k, t, *rest, 1 - px / top[2], t - top[1], seller, amount_ / unit, place])
            user_type = batch.column("__user").type
            yield _columns(out, (*kinds_, pa.float64(), pa.int64(), user_type, pa.float64(), pa.int64()), names)
            out = []
        ripe(None)
        if out:
            yield _columns(out, (*kinds_, pa.float64(), pa.int64(), user_type, pa.float64(), pa.int64()), names)

    found = sweep(rows, ["__key", "__block"], ["__at", *orders], run, schema)
    return found.withColumnsRenamed({"__key": key, "__at": at, **orders})


def clusters(creates: DataFrame, key: str, at: str, order: list[str], creator: str, item: str, window: int, least: int, cooldown: int) -> DataFrame:
    """(key, at, creators, members): when ``least`` creators or more have made items with the key in the last ``window``, ``cooldown``
    or more after the key's last cluster; members: the items of the window, oldest first.

    The cooldown depends on all clusters before, so a key is walked as a whole, with the window's items as its state.
    """
    rows = creates.select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(creator).alias("creator"), F.col(item).alias("item"), *(F.col(c).alias(f"__o{k}") for k, c in enumerate(order))).dropna(subset=["key", "at"])
    kinds = {n: rows.schema[n].dataType.simpleString() for n in ("key", "item")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        queue: deque[tuple] = deque()
        count: Counter = Counter()
        for batch in batches:
            out = []
            for k, t, who, what in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "creator", "item")), strict=True):
                if k != now:
                    now, last = k, None
                    queue.clear()
                    count.clear()
                queue.append((t, who, what))
                count[who] += 1
                while queue[0][0] < t - window:
                    gone = queue.popleft()[1]
                    count[gone] -= 1
                    if not count[gone]:
                        del count[gone]
                if len(count) >= least and (last is None or t - last >= cooldown):
                    last = t
                    out.append((k, t, len(count), [x[2] for x in queue]))
            yield _columns(out, (batch.column("key").type, pa.int64(), pa.int64(), pa.list_(batch.column("item").type)), ["key", "at", "creators", "members"])

    found = sweep(rows, ["key"], ["at", *(f"__o{k}" for k in range(len(order)))], run, f"key {kinds['key']}, at long, creators long, members array<{kinds['item']}>")
    return found.withColumnRenamed("key", key)


def hand_over(prints: DataFrame, completions: DataFrame, key: str, at: str, price: str, entry: str, up: float, down: float, hold: int, wait: int) -> DataFrame:
    """The entries (rows where ``entry`` is true, before the key's completion) with ``outcome``, ``exit_at`` and ``exit_price``.

    ``completions``: (key, completed), a row per key at most: prints before that are of the first venue, prints from then on of the
    second. An entry ends at its first later print on the first venue, at most ``hold`` after, that is at or beyond ``up`` or ``down``
    times its price ('profit', 'stop'); else, if the completion is at most ``hold`` after it, at the first such print on the second
    venue up to ``wait`` after that venue's first one ('pool profit', 'pool stop'), else at the last print of that time ('wait'), or
    nowhere if the venue has none ('no pool'); else at the last print on the first venue within ``hold`` ('timeout'; the
    entry itself if there is none). Where one time touches both levels the stop counts; of prints of one last time the dearest
    is it. The exit's price is given where no level is touched.

    Time is cut in blocks of four holds, walked back over two pairs of stairs, one of each venue: a block gets the prints of one
    hold after it, and the second venue's first ones if an entry in it may reach the completion. Completions, with the second venue's first
    print, are written first: their size is then known, and as long as they are few, prints are shuffled for the walk only.
    """
    size = 4 * hold
    rows = prints.where(F.col(at).isNotNull() & F.col(price).isNotNull())
    done = scratch.written(completions.select(F.col(key).alias("__key"), F.col("completed").alias("__done")), "completions")
    same = F.col(key) == F.col("__key")
    opens = rows.select(key, at).join(done, same).where(F.col(at) >= F.col("__done")).groupBy("__key", "__done").agg(F.min(at).alias("__open"))
    ends = scratch.written(done.join(opens.drop("__done"), "__key", "left"), "completions")
    rows = rows.join(ends, same, "left").drop("__key").withColumn("__second", F.coalesce(F.col(at) >= F.col("__done"), F.lit(False)))
    rows = rows.where(~F.col("__second") | (F.col(at) <= F.col("__open") + wait))
    own = F.floor(F.col(at) / size)
    first, last = F.when(F.col("__second"), F.floor((F.col("__done") - hold) / size)).otherwise(F.floor((F.col(at) - hold) / size)), F.when(F.col("__second"), F.floor(F.col("__done") / size)).otherwise(own)
    rows = rows.withColumn("__own", F.when(~F.col("__second"), own)).withColumn("__block", F.explode(F.sequence(first, last)))
    names = prints.columns
    rows = rows.select(*names, "__done", "__second", "__own", "__block")
    taken = {c: rows.columns.index(c) for c in (key, "__block", "__own", at, price, entry, "__second", "__done")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = then = None
        stairs: dict[bool, tuple[Stairs, Stairs]] = {}
        ends: dict[bool, tuple | None] = {}
        later: deque[tuple] = deque()  # prints of the first venue, the latest first
        pending: list[tuple] = []
        for batch in batches:
            outcome, exit_at, exit_price, keep = [], [], [], []
            for k, blk, mine, t, px, is_entry, second_, tc in zip(*(batch.column(i).to_pylist() for i in taken.values()), strict=True):
                if (k, blk) != now:
                    now, then, pending = (k, blk), None, []
                    stairs = {v: (Stairs(), Stairs()) for v in (False, True)}
                    ends = {True: None}
                    later.clear()
                if t != then:  # prints of the same time are not later ones
                    for v, level, time in pending:
                        stairs[v][0].add(level, time)
                        stairs[v][1].add(-level, time)
                        if v and ends[True] is None:
                            ends[True] = (time, level)
                        if not v:
                            later.append((time, level))
                    pending, then = [], t
                wanted = bool(is_entry) and not second_ and mine == blk
                keep.append(wanted)
                if wanted:
                    while later and later[0][0] > t + hold:
                        later.popleft()
                    found = None
                    for v, limit, says in ((False, t + hold, ("profit", "stop")), (True, None, ("pool profit", "pool stop"))):
                        if v and (tc is None or tc > t + hold):
                            break
                        hits = [stairs[v][0].first(up * px), stairs[v][1].first(-down * px)]
                        hits = [h if h is not None and (limit is None or h <= limit) else None for h in hits]
                        if hits[1] is not None and (hits[0] is None or hits[1] <= hits[0]):
                            found = (says[1], hits[1], None)
                        elif hits[0] is not None:
                            found = (says[0], hits[0], None)
                        if found:
                            break
                    if not found:
                        if tc is not None and tc <= t + hold:
                            found = ("wait", *ends[True]) if ends[True] else ("no pool", None, None)
                        else:
                            found = ("timeout", *later[0]) if later else ("timeout", t, px)
                    outcome.append(found[0])
                    exit_at.append(found[1])
                    exit_price.append(found[2])
                pending.append((second_, px, t))
            part = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(outcome, pa.string()), pa.array(exit_at, pa.int64()), pa.array(exit_price, pa.float64())], [*names, "outcome", "exit_at", "exit_price"])

    schema = StructType([*prints.schema.fields]).add("outcome", "string").add("exit_at", "long").add("exit_price", "double")
    return sweep(rows, [key, "__block"], [F.col(at).desc(), F.col(price).desc()], run, schema)
