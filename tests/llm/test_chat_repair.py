import itertools
import random

import duckdb
import numpy as np
import pytest

from tapespark.llm import chat_repair as C


def legal(roles):
    s = 0
    for r in roles:
        k = C.ROLES.index(r)
        if k not in C._NEXT[s]:
            return False
        s = k
    return s in (0, 3)


def brute(roles):
    """Least cost over all ways, by a plain shortest path over (turns done, state)."""
    best = {(0, 0): 0.0}
    for i in range(len(roles) + 1):
        for _ in range(3):
            for s in range(4):
                if (i, s) in best:
                    for b in C._NEXT[s]:
                        best[i, b] = min(best.get((i, b), 1e9), best[i, s] + C.INSERT)
        if i < len(roles):
            r = roles[i]
            for s in range(4):
                if (i, s) in best:
                    for b in C._NEXT[s]:
                        best[i + 1, b] = min(best.get((i + 1, b), 1e9), best[i, s] + C._as(r, b))
                    if s:
                        best[i + 1, s] = min(best.get((i + 1, s), 1e9), best[i, s] + C.MERGE + C._as(r, s))
    return min(best.get((len(roles), s), 1e9) for s in ((3,) if roles else (0, 3)))


@pytest.mark.parametrize("run", [3, 2000])
def test_repair(spark, monkeypatch, run):
    monkeypatch.setattr(C, "RUN", run)
    rnd = random.Random(1)
    convs = {k: list(x) for k, x in enumerate(itertools.product(["system", "user", "assistant", None], repeat=3))}
    convs |= {100 + k: [rnd.choice(["system", "user", "assistant", "tool"]) for _ in range(rnd.randint(1, 40))] for k in range(25)}
    rows = [(c, t, r, f"text {c} {t}") for c, roles in convs.items() for t, r in enumerate(roles)]
    rnd.shuffle(rows)
    rows += [(None, 0, "user", None), (None, None, "user", "last")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("run", C.F.lit("x")).withColumn("a.b", C.F.lit("x"))
    out = {}
    got = C.repair(df)
    for r in sorted(got.collect(), key=lambda r: r["position"]):
        out.setdefault(r["conv_id"], []).append(r)
    for x in out.values():
        assert [r["position"] for r in x] == list(range(len(x)))
    whole = {r["conv_id"]: r["text"] for r in C.rendered(got).collect()}
    assert whole == {c: "\n".join(r["rendered"] for r in x) for c, x in out.items()}
    for c, roles in convs.items():
        got = out[c]
        shown = [r["role"] for r in got if r["action"] != "merge"]
        assert legal(shown)
        kept = [r for r in got if r["action"] != "insert"]
        assert [r["turn"] for r in kept] == list(range(len(roles)))
        text = "".join(r["rendered"] for r in got)
        at = -1
        for t in range(len(roles)):
            at = text.index(f"text {c} {t}", at + 1)
        paid, state = 0.0, 0
        for r in got:
            if r["action"] == "insert":
                paid += C.INSERT
            else:
                paid += C._as(roles[r["turn"]] if roles[r["turn"]] in C._KNOWN else None, C.ROLES.index(r["role"])) + (C.MERGE if r["action"] == "merge" else 0)
        assert paid == pytest.approx(brute([r if r in C._KNOWN else None for r in roles])), (roles, [(r["action"], r["role"]) for r in got])
    assert [r["action"] for r in out[None] if r["action"] != "insert"] == ["keep", "merge"]


@pytest.mark.parametrize("run", [7, 50])
def test_one_long_conversation(spark, monkeypatch, run):
    """Cut once, and again into runs of runs."""
    monkeypatch.setattr(C, "RUN", run)
    df = spark.range(3000).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "'x' AS text")
    rows = C.repair(df).collect()
    assert sorted(r["position"] for r in rows) == list(range(3000)) and {r["action"] for r in rows} == {"keep"}
    same = C.repair(df.selectExpr("conv_id", "0L AS turn", "'user' AS role", "text")).groupBy("action").count().collect()
    assert {r["action"]: r["count"] for r in same} == {"keep": 1, "merge": 2999, "insert": 1}
    rnd = random.Random(run)
    roles = [rnd.choice(["user", "assistant", "system", "tool"]) for _ in range(900)]
    df = spark.createDataFrame([(1, t, r, str(t)) for t, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    got = sorted(C.repair(df).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(len(got))) and legal([r["role"] for r in got if r["action"] != "merge"])
    paid = sum(C.INSERT if r["action"] == "insert" else C._as(roles[r["turn"]] if roles[r["turn"]] in C._KNOWN else None, C.ROLES.index(r["role"])) + (C.MERGE if r["action"] == "merge" else 0) for r in got)
    assert paid == brute([r if r in C._KNOWN else None for r in roles])
    assert C.repair(df.limit(0)).collect() == []


@pytest.mark.parametrize("run", [3, 11])
def test_cuts_make_no_difference(spark, monkeypatch, run):
    """Cut, and cut again, ties included: the result is that of the whole conversations."""
    rnd = random.Random(run)
    rows = [(c, t, rnd.choice(["system", "user", "assistant", "tool"]), str(t)) for c in range(60) for t in range(rnd.choice([2, 12, 12, 12, 40, 150]))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    whole = sorted(map(tuple, C.repair(df).collect()))
    monkeypatch.setattr(C, "RUN", run)
    assert sorted(map(tuple, C.repair(df).collect())) == whole
    left = np.array([3.0, 1.0, 1.0, 0.0])
    roles = [rnd.choice([None, "system", "user", "assistant"]) for _ in range(30)]
    assert C.leads(roles, left) == [C.path(roles, s, left)[-1] for s in range(4)]


@pytest.mark.parametrize("run", [5, 2000])
def test_sql_gives_the_same(spark, monkeypatch, tmp_path, run):
    """Cut or not: ties, nulls, repeated and empty turns, very long texts; one conversation with most turns."""
    monkeypatch.setattr(C, "RUN", run)
    rnd = random.Random(9)
    rows = [(rnd.choice([1, 1, 1, *range(40), None, 2**60, 2**60 + 1]), rnd.choice([*range(30), None]), rnd.choice(["system", "user", "assistant", "tool", "", None]), rnd.choice(["a", "b", "", None, "é\n" * 3])) for _ in range(700)]
    rows += [(50, 0, "user", "long text " * 100_000)]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    got = C.repair(spark.read.parquet(path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({C.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
