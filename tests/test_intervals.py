import random

import pytest

from tapespark.operators import intervals

ROWS = "key long, lo long, hi long"


def fewest(times):
    """Sorted whole times as the fewest intervals."""
    out = []
    for t in sorted(times):
        if out and out[-1][1] == t:
            out[-1] = (out[-1][0], t + 1)
        else:
            out.append((t, t + 1))
    return out


def covers(rows, key):
    return {t for k, lo, hi in rows if k == key and lo is not None and hi is not None for t in range(lo, hi)}


@pytest.mark.parametrize("block", [3, 17, 1000])
def test_algebra_against_sets_of_times(spark, block):
    """Overlapping, meeting, nested, repeated, empty, open-ended and negative intervals; null keys; no keys at all."""
    rnd = random.Random(block)
    draw = lambda: [(rnd.choice([1, 2, None]), lo, lo + rnd.randrange(-2, 12)) for lo in (rnd.randrange(-30, 60) for _ in range(25))]
    a, b = draw() + [(1, 5, None), (1, None, 9)], draw() + [(1, 0, 4), (1, 4, 8)]
    da, db = spark.createDataFrame(a, ROWS), spark.createDataFrame(b, ROWS)
    for op, sets in ((intervals.union, set.union), (intervals.intersection, set.intersection), (intervals.difference, set.difference)):
        want = sorted(((k, lo, hi) for k in (1, 2, None) for lo, hi in fewest(sets(covers(a, k), covers(b, k)))), key=str)
        assert sorted(map(tuple, op(da, db, ["key"], block).collect()), key=str) == want
    none = lambda rows: [(1, lo, hi) for _, lo, hi in rows]
    got = intervals.intersection(da.drop("key"), db.drop("key"), [], block)
    assert sorted(map(tuple, got.collect())) == fewest(covers(none(a), 1) & covers(none(b), 1))
    assert intervals.union(da.limit(0), db.limit(0), ["key"], block).collect() == []


def test_segments_cells_and_cuts(spark):
    points = spark.createDataFrame([(1, t) for t in (0, 3, 6, 20, 21, 40, None)] + [(2, 5), (2, 5)], "key long, t long")
    segs = intervals.segments(points, ["key"], "t", 5, 7)
    assert sorted(map(tuple, segs.collect())) == [(1, 0, 7), (1, 20, 22), (1, 40, 41), (2, 5, 6)]
    rows = spark.createDataFrame([(1, 0, 7), (1, 8, 19), (1, 25, 30)], ROWS)
    assert sorted(map(tuple, intervals.covered_cells(rows, ["key"], 10, 1).collect())) == [(1, 0, 9), (1, 10, 9)]
    assert sorted(map(tuple, intervals.cut(rows, {"x": (0, 5), "y": (6, 26)}, "split").collect())) == [(1, 0, 5, "x"), (1, 6, 7, "y"), (1, 8, 19, "y"), (1, 25, 26, "y")]
