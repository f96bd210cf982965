"""Minimum-cost role repair of conversations, then rendering.

A legal conversation is an optional system turn, then user and assistant in turn, beginning with user and ending with
assistant. Every turn of the input is emitted in some role (``RELABEL`` if that is another one, ``NAME`` if it had none that
is known), or merged into the turn before it (``MERGE``); empty turns may be inserted (``INSERT`` each). The cheapest way is a
path over the automaton's states, found by dynamic programming.

A turn is a matrix of costs from state to state and a run of turns is their (min, +) product, so a conversation of any length
can be cut: turns are range-partitioned by conversation and place, numbered within their conversation and written. A
conversation of more than ``RUN`` turns is cut into runs of that many; each run gives one matrix, runs of matrices give one
again, and so on up; on the way down they give every run the costs to go after it. With these a run leads from each of the four
states to one, chosen turn by turn as without cuts; such maps are joined in the same way, up and down, and give every run the
state it begins in. Then runs and whole conversations are dealt to tasks by hash, about ``RUN`` turns to a group, and each
finds its own path. No task holds a whole long conversation, and where it is cut makes no difference, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._rows import batch_of
from ._store import materialize

RUN = 2000
#: About so many turns are sorted and numbered by a task.
PART = 500_000
MERGE, RELABEL, NAME, INSERT = 1.0, 5.0, 1.0, 3.0
ROLES = ("", "system", "user", "assistant")  # the state after a turn of that role; 0: nothing yet
_NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
_KNOWN = {r: k for k, r in enumerate(ROLES) if r}
_INF = np.inf


def _as(role: str | None, state: int) -> float:
    known = _KNOWN.get(role or "")
    return NAME if known is None else 0.0 if known == state else RELABEL


def _ways(role: str | None) -> dict[tuple[int, int], tuple[float, str, tuple[int, ...]]]:
    """For each (state before, after) one turn: its least cost, what is done, and the roles inserted before it."""
    best: dict[tuple[int, int], tuple[float, str, tuple[int, ...]]] = {}

    def offer(a: int, b: int, cost: float, what: str, put: tuple[int, ...]) -> None:
        if (a, b) not in best or cost < best[a, b][0]:
            best[a, b] = (cost, what, put)

    for a in range(4):
        for b in _NEXT[a]:
            offer(a, b, _as(role, b), "emit", ())
        if a:
            offer(a, a, MERGE + _as(role, a), "merge", ())
        for c in _NEXT[a]:
            for b in _NEXT[c]:
                offer(a, b, INSERT + _as(role, b), "emit", (c,))
                for d in _NEXT[b]:
                    offer(a, d, 2 * INSERT + _as(role, d), "emit", (c, b))
    return best


_TABLE = {r: _ways(r) for r in (None, *_KNOWN)}
_MATRIX = {r: np.array([[_TABLE[r].get((a, b), (_INF,))[0] for b in range(4)] for a in range(4)]) for r in _TABLE}
#: Roles inserted after the last turn, by state, and what they cost.
_END = {0: (), 1: (2, 3), 2: (3,), 3: ()}
_FINAL = np.array([INSERT * len(_END[s]) for s in range(4)])


def _role(role: object) -> str | None:
    return role if isinstance(role, str) and role in _KNOWN else None


def product(roles: list[str | None]) -> np.ndarray:
    """Least cost from each state to each over a run of turns."""
    out = np.where(np.eye(4, dtype=bool), 0.0, _INF)
    for r in roles:
        out = (out[:, :, None] + _MATRIX[r][None]).min(axis=1)
    return out


def path(roles: list[str | None], start: int, left: np.ndarray) -> list[int]:
    """States after each turn of a cheapest path from ``start``, where ``left`` are the costs to go after the last one by its state."""
    costs = [left]
    for r in reversed(roles):
        costs.append((_MATRIX[r] + costs[-1]).min(axis=1))
    out, state = [], start
    for r, after in zip(roles, reversed(costs[:-1]), strict=True):
        state = int((_MATRIX[r][state] + after).argmin())
        out.append(state)
    return out


def leads(roles: list[str | None], left: np.ndarray) -> list[int]:
    """The state in which the path from each of the four states ends."""
    costs = [left]
    for r in reversed(roles):
        costs.append((_MATRIX[r] + costs[-1]).min(axis=1))
    states = np.arange(4)
    for r, after in zip(roles, reversed(costs[:-1]), strict=True):
        states = (_MATRIX[r] + after).argmin(axis=1)[states]
    return states.tolist()


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the turns of each conversation within a sorted partition; the first two columns tell conversations apart."""
    part, key, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        none, conv = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
        first = np.ones(len(conv), bool)
        first[1:] = (conv[1:] != conv[:-1]) | (none[1:] != none[:-1])
        if len(conv):
            first[0] = (none[0], conv[0]) != key
            at = np.where(first, np.arange(len(conv)), -1)
            since = np.maximum.accumulate(at)
            place = np.arange(len(conv)) - since
            place[since < 0] += n - 1  # these go on from the batch before
            key, n = (none[-1], conv[-1]), int(place[-1]) + 1
            yield batch_of([*batch.columns, pa.array(np.full(len(conv), part, np.int32)), pa.array(place)])


_KEY = ["none", "conv"]


def _segments(pdf: pd.DataFrame, by: list[str]) -> list[tuple[int, int]]:
    """Ranges of equal keys in sorted rows."""
    change = np.ones(len(pdf) + 1, bool)
    change[1:-1] = (pdf[by].to_numpy()[1:] != pdf[by].to_numpy()[:-1]).any(axis=1)
    at = np.flatnonzero(change).tolist()
    return list(zip(at, at[1:], strict=False))


def _matrix(pdf: pd.DataFrame) -> pd.DataFrame:
    """The matrix of one run of turns."""
    m = product([_role(x) for x in pdf.sort_values("place")["role"]])
    return pd.DataFrame({"none": pdf["none"][:1], "conv": pdf["conv"][:1], "run": pdf["run"][:1], "costs": [m.ravel().tolist()]})


def _product(pdf: pd.DataFrame) -> pd.DataFrame:
    """The matrix of one run of matrices."""
    out = np.where(np.eye(4, dtype=bool), 0.0, _INF)
    for x in pdf.sort_values("run")["costs"]:
        out = (out[:, :, None] + np.array(x).reshape(4, 4)[None]).min(axis=1)
    return pd.DataFrame({"none": pdf["none"][:1], "conv": pdf["conv"][:1], "run": pdf["upper"][:1], "costs": [out.ravel().tolist()]})


def _lefts(pdf: pd.DataFrame) -> pd.DataFrame:
    """The costs to go after each run, from its run of matrices and the costs to go after that."""
    pdf = pdf.sort_values("run", ignore_index=True)
    left = [np.array(pdf["left"][0])]
    for x in reversed(pdf["costs"][1:].tolist()):
        left.append((np.array(x).reshape(4, 4) + left[-1]).min(axis=1))
    return pd.DataFrame({"none": pdf["none"], "conv": pdf["conv"], "run": pdf["run"], "left": [x.tolist() for x in reversed(left)]})


def _lead(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where one run of turns leads from each state."""
    to = leads([_role(x) for x in pdf.sort_values("place")["role"]], np.array(pdf["left"].iloc[0]))
    return pd.DataFrame({"none": pdf["none"][:1], "conv": pdf["conv"][:1], "run": pdf["run"][:1], "to": [to]})


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where one run of maps leads from each state."""
    to = np.arange(4)
    for x in pdf.sort_values("run")["to"]:
        to = np.array(x)[to]
    return pd.DataFrame({"none": pdf["none"][:1], "conv": pdf["conv"][:1], "run": pdf["upper"][:1], "to": [to.tolist()]})


def _entered(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state before each run, from that before its run of maps."""
    pdf = pdf.sort_values("run", ignore_index=True)
    state, enter = int(pdf["enter"][0]), []
    for x in pdf["to"]:
        enter.append(state)
        state = int(x[state])
    return pd.DataFrame({"none": pdf["none"], "conv": pdf["conv"], "run": pdf["run"], "enter": enter})


def _down(runs: DataFrame, up, up_schema: str, top: Column, value: str, down, down_schema: str) -> DataFrame:
    """What every run gets from all runs of its conversation: runs are joined to upper runs by ``up``, whose value is found in the same
    way, or is ``top`` where there is one only; ``down`` gives it on to the runs. Runs are written at every level."""
    runs = materialize(runs.withColumn("upper", F.floor(F.col("run") / RUN)), "chat-runs")
    if runs.where("upper > 0").isEmpty():
        upper = runs.select(*_KEY, "upper").distinct().withColumn(value, top)
    else:
        upper = _down(runs.groupBy(*_KEY, "upper").applyInPandas(up, up_schema), up, up_schema, top, value, down, down_schema).withColumnRenamed("run", "upper")
    return materialize(runs.join(upper, [*_KEY, "upper"]).groupBy(*_KEY, "upper").applyInPandas(down, down_schema), "chat-cuts")


def _cuts(turns: DataFrame) -> DataFrame:
    """(none, conv, run, enter, left): the state before and the costs to go after each run of ``turns``."""
    run = "none boolean, conv long, run long, "
    matrices = turns.groupBy(*_KEY, "run").applyInPandas(_matrix, run + "costs array<double>")
    left = _down(matrices, _product, run + "costs array<double>", F.array(*map(F.lit, _FINAL.tolist())), "left", _lefts, run + "left array<double>")
    maps = turns.join(left, [*_KEY, "run"]).groupBy(*_KEY, "run").applyInPandas(_lead, run + "to array<int>")
    return left.join(_down(maps, _joined, run + "to array<int>", F.lit(0), "enter", _entered, run + "enter int"), [*_KEY, "run"])


def _open(state: int) -> str:
    return f"<|{ROLES[state]}|>\n"


def _size(pdf: pd.DataFrame) -> pd.DataFrame:
    """How many repaired turns one run of a long conversation gives."""
    state, n = int(pdf["enter"].iloc[0]), 0
    roles = [_role(x) for x in pdf.sort_values("place")["role"]]
    for role, after in zip(roles, path(roles, state, np.array(pdf["left"].iloc[0])), strict=True):
        n += 1 + len(_TABLE[role][state, after][2])
        state = after
    return pd.DataFrame({"none": pdf["none"][:1], "conv": pdf["conv"][:1], "run": pdf["run"][:1], "n": [n]})


_COLUMNS = ["none", "conv", "turn_none", "turn", "position", "action", "role", "rendered"]


def _repair(turns: pd.DataFrame, cuts: pd.DataFrame) -> pd.DataFrame:
    """The repaired turns of some conversations and runs; ``cuts`` has the states and the first position of the runs."""
    turns = turns.sort_values(["none", "conv", "run", "place"], ignore_index=True)
    known = {(n, c, r): rest for n, c, r, *rest in cuts[["none", "conv", "run", "enter", "left", "last", "position"]].itertuples(index=False)}
    rows = []
    for a, b in _segments(turns, ["none", "conv", "run"]):
        key = turns["none"][a], turns["conv"][a]
        enter, left, last, at = known.get((*key, turns["run"][a]), (0, _FINAL, True, 0))
        roles = [_role(x) for x in turns["role"][a:b]]
        out, state = [], enter
        for k, (role, after) in enumerate(zip(roles, path(roles, enter, np.array(left)), strict=True), a):
            _, what, put = _TABLE[role][state, after]
            turn = turns["turn_none"][k], turns["turn"][k]
            out += [(turn, "insert", ROLES[x], _open(x)) for x in put]
            text = turns["text"][k]
            done = "merge" if what == "merge" else "keep" if role == ROLES[after] else "relabel"
            out.append((turn, done, ROLES[after], f"\n{text}" if what == "merge" else _open(after) + text))
            state = after
        if last:
            out += [(turn, "insert", ROLES[x], _open(x)) for x in _END[state]]
        rows += [(*key, *turn, at + i, *x) for i, (turn, *x) in enumerate(out)]
    return pd.DataFrame(rows, columns=_COLUMNS)


def _bucket(groups: int) -> Column:
    return F.pmod(F.xxhash64("none", "conv", "run"), F.lit(groups))


def repair(turns: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, turn (an inserted one has that of its neighbour), position (from 0 in its conversation, in
    the order of the result), action (keep, relabel, merge, insert), role, rendered.

    Takes conv_id, turn, role, text; further columns, whatever their names, stay out. Turns are in order of turn, equal ones of
    role, then of the text's MD5; a null turn comes last, null conv_ids are one conversation, a null or unknown role may become
    any, a null text is empty. Repeated rows are turns of their own. Among ways of equal cost, each turn takes the first state
    in the order system, user, assistant, and there an emitted turn comes before a merged one before an insertion, however long
    the conversation is.
    """
    spark = turns.sparkSession
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    rows = turns.select(F.isnull(F.col("conv_id").cast("long")).alias("none"), whole("conv_id").alias("conv"), F.isnull(F.col("turn").cast("long")).alias("turn_none"), whole("turn").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("none"), F.col("conv"), F.col("turn_none"), F.col("turn"), F.col("role").asc_nulls_last(), F.col("h")]
    rows = rows.withColumn("h", F.md5("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns.count() // PART)
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("h")
    rows = materialize(rows.mapInArrow(_numbered, "none boolean, conv long, turn_none boolean, turn long, role string, text string, part int, place long"), "chat-turns")
    # a conversation over several partitions goes on from the one before: at most one of these in each partition
    held = rows.groupBy(*_KEY, "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy(*_KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = F.broadcast(held.where("before IS NOT NULL").select(*_KEY, "part", "before"))
    rows = rows.join(before, [*_KEY, "part"], "left").withColumn("place", F.col("place") + F.coalesce("before", F.lit(0))).drop("part", "before")
    rows = rows.withColumn("run", F.floor(F.col("place") / RUN))
    bare = rows.select(*_KEY, "run", "place", "role")
    long = bare.where(F.col("place") == RUN).select(*_KEY)
    runs = bare.join(long, _KEY, "left_semi")
    cuts = _cuts(runs)
    sizes = runs.join(cuts, [*_KEY, "run"]).groupBy(*_KEY, "run").applyInPandas(_size, "none boolean, conv long, run long, n long")
    position = F.coalesce(F.sum("n").over(Window.partitionBy(*_KEY).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = F.lead("n").over(Window.partitionBy(*_KEY).orderBy("run")).isNull()
    cuts = cuts.join(sizes.withColumns({"position": position, "last": ends}).drop("n"), [*_KEY, "run"])
    groups = max(1, rows.count() // RUN)
    out = "none boolean, conv long, turn_none boolean, turn long, position long, action string, role string, rendered string"
    done = rows.groupBy(_bucket(groups).alias("bucket")).cogroup(cuts.groupBy(_bucket(groups).alias("bucket"))).applyInPandas(_repair, out)
    return done.select(F.when(~F.col("none"), F.col("conv")).alias("conv_id"), F.when(~F.col("turn_none"), F.col("turn")).alias("turn"), "position", "action", "role", "rendered")


def rendered(repaired: DataFrame) -> DataFrame:
    """conv_id and the text of each whole conversation, which Spark must be able to hold in a row."""
    parts = F.array_sort(F.collect_list(F.struct("position", "rendered")))
    return repaired.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["rendered"]), "\n").alias("text"))


def _sql() -> str:
    """The same by recursion over the turns in DuckDB, back for the costs to go, forth for the states; the automaton as a table."""
    far = 1e9
    matrices = ", ".join(f"('{r or ''}', {[[float(x) if x < far else far for x in row] for row in m.tolist()]}::DOUBLE[][])" for r, m in _MATRIX.items())
    ways = ", ".join(f"('{r or ''}', {a}, {b}, '{what}', {[ROLES[x] for x in put]}::VARCHAR[])" for r, t in _TABLE.items() for (a, b), (_, what, put) in t.items())
    ends = ", ".join(f"({s}, {[ROLES[x] for x in put]}::VARCHAR[])" for s, put in _END.items())
    return f"""WITH RECURSIVE matrices(known, m) AS (VALUES {matrices}), ways(known, a, b, what, put) AS (VALUES {ways}), ends(s, put) AS (VALUES {ends}),
turns AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM (
    SELECT conv_id, turn, role, coalesce(text, '') AS text, CASE WHEN role IN ('system', 'user', 'assistant') THEN role ELSE '' END AS known FROM conversations) JOIN matrices USING (known)
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, md5(text))),
togo(conv_id, i, c) AS (
  SELECT conv_id, n, {_FINAL.tolist()}::DOUBLE[] FROM turns WHERE i = n
  UNION ALL SELECT t.conv_id, t.i - 1, list_transform([1, 2, 3, 4], lambda a: list_min(list_transform([1, 2, 3, 4], lambda b: m[a][b] + c[b]))) FROM togo g JOIN turns t ON t.conv_id IS NOT DISTINCT FROM g.conv_id AND t.i = g.i WHERE t.i > 1),
forth(conv_id, i, before, after) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM turns
  UNION ALL SELECT conv_id, i, before, list_position(v, list_min(v)) - 1 FROM (
    SELECT t.conv_id, t.i, f.after AS before, list_transform([1, 2, 3, 4], lambda b: m[f.after + 1][b] + c[b]) AS v
    FROM forth f JOIN turns t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.i = f.i + 1 JOIN togo g ON g.conv_id IS NOT DISTINCT FROM t.conv_id AND g.i = t.i)),
steps AS (
  SELECT t.*, w.what, w.put, f.after, CASE WHEN t.i = t.n THEN e.put ELSE [] END AS closing
  FROM turns t JOIN forth f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.i = t.i JOIN ways w ON w.known = t.known AND w.a = f.before AND w.b = f.after JOIN ends e ON e.s = f.after),
lines AS (
  SELECT conv_id, turn, i, unnest(range(len(put))) AS j, 'insert' AS action, unnest(put) AS role, '<|' || unnest(put) || '|>' || chr(10) AS rendered FROM steps
  UNION ALL SELECT conv_id, turn, i, 3, CASE WHEN what = 'merge' THEN 'merge' WHEN known = {list(ROLES)}[after + 1] THEN 'keep' ELSE 'relabel' END, {list(ROLES)}[after + 1],
    CASE WHEN what = 'merge' THEN '' ELSE '<|' || {list(ROLES)}[after + 1] || '|>' END || chr(10) || text FROM steps
  UNION ALL SELECT conv_id, turn, i, 4 + unnest(range(len(closing))), 'insert', unnest(closing), '<|' || unnest(closing) || '|>' || chr(10) FROM steps)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY i, j) - 1 AS position, action, role, rendered FROM lines"""


ORACLE_SQL = _sql()
