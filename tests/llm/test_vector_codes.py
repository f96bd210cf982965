import duckdb
import numpy as np
import pytest

from tapespark.llm import vector_codes


def brute(rows, parts, entries, rounds, scale=256):
    """(vec_id, label, code, error) by comparing every part with every entry in Python's integers."""
    rows = sorted((r for r in rows if r[1]), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[int(np.floor(v * scale)) for v in r[1]] for r in rows], dtype=object).reshape(len(rows), parts, -1)
    books = x[:entries].copy()
    near = lambda p: [min(range(len(books)), key=lambda e: (((v - books[e, p]) ** 2).sum(), e)) for v in x[:, p]]
    for _ in range(rounds):
        for p in range(parts):
            own = near(p)
            for e in set(own):
                books[e, p] = x[[k for k, o in enumerate(own) if o == e], p].sum(0) // own.count(e)
    final = np.array([near(p) for p in range(parts)]).T
    out = []
    for k, r in enumerate(rows):
        out.append((r[0], r[2], "".join(f"{e:02x}" for e in final[k]), int(sum(((x[k, p] - books[e, p]) ** 2).sum() for p, e in enumerate(final[k])))))
    return out, books


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize(("n", "spread", "leaf"), [(300, 1.0, 8), (257, 0.01, 1), (150, 300.0, 48)])
def test_against_brute_force(spark, monkeypatch, n, spread, leaf):
    """Ties (a narrow spread gives many equal integers), repeated vectors, large components; trees of several depths."""
    monkeypatch.setattr(vector_codes, "LEAF", leaf)
    rnd = np.random.default_rng(n)
    rows = [(k, (rnd.standard_normal(8) * spread).tolist(), int(k % 3)) for k in rnd.permutation(n).tolist()]
    rows += [(n + k, rows[0][1], None) for k in range(60)]
    coded, books = vector_codes.quantize(frame(spark, rows).repartition(4), parts=4, entries=13, rounds=2)
    want, entries = brute(rows, 4, 13, 2)
    assert books.transpose(1, 0, 2).tolist() == entries.tolist()
    assert sorted(map(str, map(tuple, coded.collect()))) == sorted(map(str, want))


def test_trees_own_their_points():
    """Every ball holds its points within its radius, with their sum, and the children divide the parent; dominance is exact."""
    rnd = np.random.default_rng(1)
    x = np.concatenate((rnd.integers(-500, 500, (900, 3)), np.full((300, 3), 7), rnd.integers(10**6, 10**6 + 9, (40, 3))))
    order, nodes = vector_codes.build_tree(x)
    assert sorted(order.tolist()) == list(range(len(x)))
    for b in nodes:
        own = x[order[b["start"] : b["stop"]]]
        assert (own.sum(0) == b["sum"]).all() and np.sqrt(((own - own.sum(0) / len(own)) ** 2).sum(1)).max() <= b["radius"] * (1 + 1e-12)
        if b["left"] >= 0:
            left, right = nodes[b["left"]], nodes[b["right"]]
            assert (left["start"], left["stop"], right["stop"]) == (b["start"], right["start"], b["stop"])
    entries = np.concatenate((x[:20], x[:3], x[900:902]))
    found, count, total = vector_codes.assign(x[order], nodes, entries)
    want = (((x[order][:, None] - entries) ** 2).sum(-1)).argmin(1)
    assert (found == want).all() and (count == np.bincount(want, minlength=len(entries))).all()
    assert all((total[e] == x[order][want == e].sum(0)).all() for e in range(len(entries)))


def test_balls_are_owned_whole():
    """Far groups: most points are never compared one by one."""
    rnd = np.random.default_rng(2)
    x = (rnd.integers(-20, 20, (2000, 4)) + 5000 * np.repeat(np.arange(10), 200)[:, None]).astype(np.int64)
    order, nodes = vector_codes.build_tree(x)
    seen = []

    class Points(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, tuple) and isinstance(at[0], np.ndarray):
                seen.append(len(at[0]))
            return np.asarray(self)[at]

    found, *_ = vector_codes.assign(x[order].view(Points), nodes, x[::200].copy())
    assert (found == np.repeat(np.arange(10), 200)[order]).all() and sum(seen) == 0


def test_edges(spark):
    rows = [(5, [0.5, 1.0, -0.001], 1), (None, [0.5, 1.0, 2.0], None), (5, [0.5, 1.0, -0.001], 1), (7, None, 1), (8, [], 1), (9, [1.0, None, 2.0], 1), (10, [1.0, float("nan"), 0.0], 1), (11, [1.0, float("inf"), 0.0], 1), (12, [1.0, 2.0], 1), (13, [1e300, -1e300, 0.0], 2)]
    df = frame(spark, rows).selectExpr("*", "1 AS code", "2 AS error", "3 AS `label.x`")
    got = vector_codes.digest(df).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["13", "5", "5", "None"]
    assert {r["error"] for r in got} == {0} and len({r["codebooks_sha256"] for r in got}) == 1 and all(len(r["code"]) == 32 for r in got)
    assert vector_codes.digest(df.limit(0)).collect() == []


def test_label_errors(spark, monkeypatch):
    """Sent to all, or dealt: a label of a third of the rows, nulls together."""
    rows = [(k, "ab", k % 7, None if k % 3 == 0 else k % 50) for k in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, code string, error long, label int")
    want = {}
    for _, _, e, lab in rows:
        want[lab] = want.get(lab, 0) + e
    for sent, hot in ((1000, 10_000), (0, 100)):
        monkeypatch.setattr(vector_codes, "MOST_SENT", sent)
        monkeypatch.setattr(vector_codes, "HOT", hot)
        got = vector_codes.with_label_error(df).collect()
        assert len(got) == 900 and all(r["label_error"] == want[r["label"]] for r in got)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    got = vector_codes.digest(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(vector_codes.ORACLE_SQL).fetchall())
