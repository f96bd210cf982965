import random

from tapespark.llm import decontaminate as D


def sellers(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_distance_against_dynamic_programming():
    rnd = random.Random(2)
    for _ in range(300):
        pattern = "".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 90)))
        text = "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 120)))
        assert D.distance(D.masks(pattern), len(pattern), text) == sellers(pattern, text)


def test_search_against_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 7)))
    items = [(k, " ".join(word() for _ in range(rnd.randint(12, 40)))) for k in range(30)]
    items += [(40, None), (41, " \n"), (42, "ab ce"), (43, "e"), (44, "aab"), (45, "(b) da-c"), (None, items[0][1] + " without id")]
    docs = []
    for k in range(120):
        text = " ".join(word() for _ in range(rnd.randint(0, 60)))
        if k % 2:
            part = list(rnd.choice(items[:30])[1])
            for _ in range(rnd.randint(0, 12)):
                at = rnd.randrange(len(part))
                part[at : at + 1] = rnd.choice(["", "x", part[at] + "y"])
            text = text + "\n " + "".join(part).upper() + "  " + text
        docs.append((k, text))
    docs += [(200, None), (201, ""), (None, items[3][1]), (202, items[3][1] * 3), (202, items[3][1] * 3)]
    want = []
    for doc, text in docs:
        t = D.normal(text)
        hits = []
        for i, item in items:
            p = D.normal(item)
            if not p:
                continue
            if len(p) * D.RATE < 1:  # exact, and not inside a word
                inside = lambda k: 0 < k < len(t) and t[k - 1].isalnum() and t[k].isalnum()  # noqa: E731, B023
                d = 0 if any(t.startswith(p, k) and not inside(k) and not inside(k + len(p)) for k in range(len(t))) else 1
            else:
                d = sellers(p, t)
            if d <= int(len(p) * D.RATE):
                hits.append((-1 if i is None else i, d))
        want.append((doc, tuple(sorted(hits))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    of = spark.createDataFrame(items, "item_id long, text string")
    for size in (D.BLOCK_BYTES, 700):
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
        got = [(r["doc_id"], tuple(map(tuple, r["__hits"]))) for r in D.find_items(df, of, ["doc_id"]).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    clash = df.limit(3).selectExpr("*", "1 AS __hits", "2 AS __text")
    rows = D.find_items(clash, of, clash.columns).collect()
    assert rows[0].__fields__ == ["doc_id", "text", "__hits", "__text", "__hits_"] and {r["__hits"] for r in rows} == {1}
    assert D.scan(df.limit(0), of).collect() == []
    assert {r["contaminated"] for r in D.scan(df.withColumn("items", df.text), of.limit(0)).collect()} == {False}


def test_very_long_text(spark):
    item = "what is the name of the river that flows through the town"
    text = "word and word \n" * 200_000 + item.replace("river", "rivver") + " other" * 200_000
    rows = D.scan(spark.createDataFrame([(1, text), (2, "word")], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["items"], r["least_distance"]) for r in rows} == {(1, "7", 1), (2, "", None)}
