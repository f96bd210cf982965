import random

import pytest

from tapespark.llm import near_dedup
from tapespark.llm.near_dedup import near_duplicates


def brute(rows, size, threshold):
    sets = {}
    for doc, text in rows:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        s = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets[doc] = s
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                r = sorted((find(a), find(b)))
                root[r[1]] = r[0]
    return {(d, len(sets[d]), find(d), find(d) == d) for d in ids}


def test_against_brute_force(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(40):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(1, 120))]
        for _ in range(rnd.randint(1, 8)):
            w = list(base)
            for _ in range(rnd.randint(0, 5)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((k, " ".join(w).upper() if k % 3 == 0 else "\n".join(w)))
            k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, " \n "), (k + 3, "one"), (k + 4, "One")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size, threshold in ((4, 80), (5, 80)):
        assert {tuple(r) for r in near_duplicates(df, size, threshold).collect()} == brute(rows, size, threshold)


def test_chain_of_near_copies(spark):
    words = [f"v{i}" for i in range(300)]
    rows = []
    for k in range(30):
        words = words[8:] + [f"x{k}_{j}" for j in range(8)]
        rows.append((100 - k, " ".join(words)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert {r["component_id"] for r in got} == {71} and sum(r["kept"] for r in got) == 1


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "a b c d e", "x"), (1, "a b c d e", "y"), (None, "a b c d e", "z"), (2, None, None), (3, "A B C D E", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep string").withColumnRenamed("rep", "key")
    got = sorted((tuple(r) for r in near_duplicates(df, 4).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (2, 0, 2, True), (3, 2, 1, False)], key=str)
    assert near_duplicates(df.limit(0)).collect() == []


def test_one_id_with_two_texts(spark):
    rows = [(5, "a b c d e"), (2, "A b c d e"), (5, "p q r s t"), (7, "P q r s t")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert {r["component_id"] for r in got} == {2}


@pytest.mark.parametrize("hot", [2000, 5])
def test_large_group_of_near_copies(spark, monkeypatch, hot):
    """Also with so low a bound that keys and hubs are dealt to several tasks."""
    monkeypatch.setattr(near_dedup, "HOT", hot)
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = [(1000 + k, " ".join(base)) for k in range(5)]
    for k in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(60)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in near_duplicates(df, 4, 80).collect()} == brute(rows, 4, 80)


def test_very_long_text_and_clashing_names(spark):
    base = [f"w{i}" for i in range(300_000)]
    rows = [(1, " ".join(base), 1, 2), (2, " ".join([*base[:-9], "x"]), 1, 2), (3, "short one", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, x int, y int").toDF("doc_id", "text", "n", "a.b")
    assert sorted((r["doc_id"], r["component_id"]) for r in near_duplicates(df, 4).collect()) == [(1, 1), (2, 1), (3, 3)]
