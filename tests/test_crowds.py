"""Counts, draws and choice sets in blocks of time against all pairs, where keys repeat within a window; no pairs are made."""

import random
import statistics

import pytest

from tapespark.operators import crowds

SCHEMA = "key long, t long, seq long, size double, ask boolean"


def crowd(seed, keys, span, n=400):
    r = random.Random(seed)
    return [(r.randrange(keys), r.randrange(span), i, float(r.choice([1, 2, 3, 4, 6, 8, 9, 12, r.random() * 20])), r.random() < 0.6) for i in range(n)]


@pytest.mark.parametrize(("seed", "keys", "span", "width"), [(1, 5, 300, 64), (2, 40, 300, 1000), (3, 2, 60, 7), (4, 300, 2000, 500)])
def test_counts_and_draws(spark, seed, keys, span, width):
    rows, reach, a, b = crowd(seed, keys, span), 50, 7_919, 104_729
    df = spark.createDataFrame(rows, SCHEMA)
    counts, draws = {}, set()
    for key, t, seq, size, ask in rows:
        near = [r for r in rows if ask and t - reach < r[1] < t and r[0] != key and size * 0.5 <= r[3] <= size * 1.5]
        if near:
            counts[seq] = (len(near), len({r[0] for r in near}), round(sum(r[3] for r in near), 9))
            order = sorted({r[0] for r in near}, key=lambda k, s=seq: ((k * a + s * b) % 1_000_003, k))
            draws |= {(seq, k, max(r[1] for r in near if r[0] == k), t) for k in order[:3]}
    got = crowds.peer_counts(df, reach, 0.5, 1.5, width).collect()
    assert {r.seq: (r.n, r["keys"], round(r.total, 9)) for r in got} == counts and len(got) == len(counts)
    got = [tuple(r) for r in crowds.peer_draws(df, reach, 0.5, 1.5, 3, (a, b), width).collect()]
    assert set(got) == draws and len(got) == len(draws)


@pytest.mark.parametrize("width", [16, 5000])
def test_draws_of_questions_with_few_keys(spark, width):
    """More rows than a walk takes, and questions that have one or no key among them."""
    rows = [(i, i % 40, i, 100.0, False) for i in range(3000)] + [(5000 + i, 45, 5000 + i, 3.0, i > 2) for i in range(6)] + [(6000, 30, 6000, 2.5, False)]
    got = crowds.peer_draws(spark.createDataFrame(rows, SCHEMA), 40, 0.5, 1.5, 3, (7_919, 104_729), width).collect()
    assert {tuple(r) for r in got} == {(5003 + i, 6000, 30, 45) for i in range(3)}


@pytest.mark.parametrize("width", [13, 4000])
def test_choice_sets(spark, width):
    rows, reach, back = crowd(7, 12, 400), 40, 3
    want = set()
    for key, t, seq, _, ask in rows:
        near = [r for r in rows if ask and t - back - reach <= r[1] < t - back]
        if any(r[0] == key for r in near):
            want |= {(seq, k, sum(r[0] == k for r in near), round(sum(r[3] for r in near if r[0] == k), 6), k == key) for k in {r[0] for r in near}}
    got = [(r.seq, r.key, r.n, round(r.total, 6), r.own) for r in crowds.choice_sets(spark.createDataFrame(rows, SCHEMA), reach, back, width, 50).collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("width", [30, 7000])
def test_cheaper(spark, width):
    r, reach = random.Random(width), 60
    rows = [(r.randrange(15), r.randrange(900), i, float(r.choice([1, 2, 3, 5, 8, 9])), False, r.choice("xy")) for i in range(500)]
    rows += [(100 + k % 3 if k % 2 else k % 15, r.randrange(900), 0, float(r.choice([0.5, 2, 4, 9.5])), True, r.choice("xy")) for k in range(120)]
    want = set()
    for key, t, _, px, ask, group in rows:
        last = {}
        for q in sorted(rows, key=lambda q: (q[1], q[2])) if ask else ():
            if not q[4] and q[5] == group and t - reach < q[1] <= t:
                last[q[0]] = q
        under = [q for k, q in last.items() if k != key and q[3] < px]
        if under:
            top = max(under, key=lambda q: (q[3], q[0]))
            want.add((group, key, t, len(under), top[0], top[3], max(under, key=lambda q: (q[1], q[0]))[0]))
    got = crowds.cheaper(spark.createDataFrame(rows, "key long, t long, seq long, px double, ask boolean, g string"), ["g"], reach, width).collect()
    assert {tuple(x) for x in got} == want


@pytest.mark.parametrize("name", ["j5_range_candidates", "c4_matched_controls", "c6_choice_sets", "c22_sympathy", "j10_shared_keywords", "w33_breadth"])
def test_no_pairs(spark, name):
    """Rows of the same time meet in blocks or as counts, not in a join of two prints."""
    from tapespark import plans

    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert not any("<=" in line or ">=" in line or "Cross" in line for line in joins), joins


def test_choice_sets_move_as_packs(spark):
    """A sum of unknown sizes is null, of some known ones theirs; prints meet their orders and their block as packs only."""
    from tapespark import plans

    rows = [(1, 10, 1, None, False), (1, 12, 2, 2.0, False), (2, 13, 3, None, False), (1, 20, 4, 1.5, True), (None, 14, 5, 9.0, True), (2, None, 6, 9.0, True)]
    got = {tuple(r) for r in crowds.choice_sets(spark.createDataFrame(rows, SCHEMA), 40, 3).collect()}
    assert got == {(4, 1, 2, 2.0, True), (4, 2, 1, None, False)}
    plan = plans.QUERIES["c6_choice_sets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange " in line]
    assert len(dealt) == 2 and all("hashpartitioning(bucket" in line for line in dealt), dealt


@pytest.mark.parametrize(("seed", "keys", "span", "width"), [(1, 6, 700, 90), (2, 40, 300, 1000), (3, 3, 200, 64), (4, 2, 3000, 500)])
def test_returns_of_drawn_keys(spark, seed, keys, span, width):
    """Own and drawn keys' returns from the last price up to a question to the first one ``ahead`` after, and questions of a common seq."""
    reach, ahead, factors, r = 25, 70, (7_919, 104_729), random.Random(seed)
    rows = [(r.randrange(keys), r.randrange(-span // 2, span // 2), 7 * i + 10**12, float(r.choice([3, 4, 5, 6, 8, 9])), r.choice([1.0, 2.0, 5.0, 5.5, None]), r.random() < 0.6, r.random() < 0.1) for i in range(300)]
    price = lambda size, per: (size + 30) / (per + 1)

    def ret(key, t):
        line = sorted((q[1], q[2], price(q[3], q[4])) for q in rows if q[0] == key and q[4] is not None)
        before, after = [x for x in line if x[0] <= t], [x for x in line if x[0] >= t + ahead]
        return after[0][2] / before[-1][2] - 1 if before and after else None

    edges, again = [], set()
    for key, t, seq, size, _, ask, twice in rows:
        near = {q[0] for q in rows if ask and t - reach < q[1] < t and q[0] != key and size * 0.5 <= q[3] <= size * 1.5}
        drawn = sorted(near, key=lambda k, s=seq: ((k * factors[0] + s * factors[1]) % 1_000_003, k))[:3]
        own, peers = ret(key, t), [x for x in (ret(k, t) for k in drawn) if x is not None]
        if ask and twice:
            again.add((own if own is None else round(own, 9), seq, t, tuple(sorted(drawn))))
        elif ask and own is not None and peers:
            edges.append(round(own - statistics.median(peers), 9))
    df = spark.createDataFrame(rows, "key long, t long, seq long, size double, per double, ask boolean, twice boolean")
    got = crowds.drawn_returns(crowds.with_exits(df, reach, ahead, width), reach, 0.5, 1.5, 3, factors, price, width).collect()
    assert sorted(round(x.edge, 9) for x in got if x.edge is not None) == sorted(edges)
    shared = [(x.own if x.own is None else round(x.own, 9), x.again, x.t, tuple(sorted(x.drawn))) for x in got if x.again is not None]
    assert set(shared) == again and len(shared) == len(again)
    asked = [(k, t) for k in range(keys + 1) for t in r.sample(range(-span, span), 4)]
    got = crowds.returns_at(df.repartition(3), spark.createDataFrame(asked, "key long, t long"), ahead, price).collect()
    assert {(x.key, x.t): round(x.ret, 9) for x in got} == {(k, t): round(ret(k, t), 9) for k, t in asked if ret(k, t) is not None}


def test_picks_of_a_common_seq_are_one(spark, tmp_path):
    """Lines have no key: two picks of one seq draw from what both meet, and at both times, as in the SQL."""
    import duckdb

    from tapespark import plans

    day = lambda n: f"TIMESTAMP '1995-01-01' + INTERVAL {n} DAY"
    line = lambda key, supp, price, n, part=5, num=1: f"({key}, {part}, {supp}, {num}, 10.0, {price}.0, 0.1, 0.0, 'N', 'F', {day(n)})"
    # orders 86400 apart have their lines at the same second of a day; lines of number 2 are 13 seconds later
    near = [(3, 2, 100), (86_403, 3, 110), (172_803, 4, 120)]
    lines = [line(k, s, p, n) for n in (10, 20) for k, s, p in near[: 3 if n == 10 else 2]] + [line(k, s, p * 3 + n, n) for n in (45, 60) for k, s, p in near]
    lines += [line(3, 1, 100, 10, 9, 2), line(3, 1, 105, 20, 9, 2), line(86_403, 1, 300, 45, 7, 3), line(86_403, 1, 500, 60, 7, 3)]
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM (VALUES {', '.join(lines)}) v(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) TO '{tmp_path}/raw.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT l_orderkey::BIGINT AS l_orderkey, l_partkey::BIGINT AS l_partkey, l_suppkey::BIGINT AS l_suppkey, l_linenumber::INT AS l_linenumber, l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, l_discount::DOUBLE AS l_discount, l_linestatus, l_shipdate::TIMESTAMP AS l_shipdate FROM '{tmp_path}/raw.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT DISTINCT l_orderkey::BIGINT AS o_orderkey, 7::BIGINT AS o_custkey FROM '{tmp_path}/raw.parquet') TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    for name in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = con.execute(plans.ORACLE_SQL["c2_selection_edge"]).fetchall()
    got = plans.QUERIES["c2_selection_edge"](spark, str(tmp_path)).select("n", "median_edge", "better").collect()
    assert [tuple(map(float, x)) for x in got] == [tuple(map(float, x)) for x in want] and want[0][0] > 0


def test_selection_edge_shuffles_neither_picks_nor_peers(spark, monkeypatch):
    from tapespark import plans
    from tapespark.operators import scratch

    seen, written = {}, scratch.written
    monkeypatch.setattr(scratch, "written", lambda rows, label: seen.setdefault(label, rows) and written(rows, label))
    plans.QUERIES["c2_selection_edge"](spark, "/root/testdata/sf0.001")
    dealt = [line for line in seen["returns"]._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange " in line]
    assert len(dealt) == 3 and sum("hashpartitioning(bucket" in x for x in dealt) == 2 and sum("hashpartitioning(key" in x for x in dealt) == 1, dealt
