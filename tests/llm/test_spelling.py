import random
import re
import zlib
from collections import Counter

import pytest

from tapespark.llm import spelling


def brute_counts(docs, least=5, at_least=3, one_in=97):
    out = Counter()
    for doc, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % one_in == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= least:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= at_least}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_groups(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    root = lambda w: w if form[w] is None else root(form[w])
    return sorted((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items())


def rows(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


@pytest.mark.parametrize("one_in", [97, 3])
def test_counts(spark, monkeypatch, one_in):
    """Against plain Python: letters of two bytes, signs between them, long runs, ends of rows, slices of few bytes."""
    monkeypatch.setattr(spelling, "_SLICE", 200)
    monkeypatch.setattr(spelling, "_COUNTED", 50)
    rnd = random.Random(one_in)
    words = ["Straße", "ÉCOLE", "école", "niño×÷", "abcdeé", "x" * 90, "é" * 40, "Ābcdefg", "日本語abcdef", "aaaaa", "hello", "Hello", "HELLO"]
    docs = [(k if k % 5 else None, "".join(rnd.choice(words) + rnd.choice([" ", "", "-", "1", "\n"]) for _ in range(rnd.randrange(40)))) for k in range(150)] + [(7, None), (8, ""), (9, "abcde"), (9, "abcde"), (9, "abcde")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n")
    got = {r["word"]: r["n"] for r in spelling.count_words(df.repartition(3), one_in=one_in).collect()}
    assert got == brute_counts(docs, one_in=one_in)
    assert spelling.count_words(df.limit(0)).collect() == []


def test_groups(spark):
    """Against all pairs: repeated letters, insertions at both ends, ties of counts, chains of forms."""
    rnd = random.Random(5)
    counts = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 7))): rnd.choice([3, 3, 4, 8, 9, 20, 50]) for _ in range(400)}
    counts |= {"aaaaaaaa": 64, "aaaaaaa": 32, "aaaaaaab": 16, "aaaaaaabb": 8, "aaaaaaabbb": 4, "lonely word": 3, "": 5, "ab" * 3000: 9, "ab" * 2999 + "a": 4}
    got = rows(spelling.group_variants(spark.createDataFrame([*counts.items(), (None, 9)], "word string, n int").selectExpr("*", "1 AS id", "2 AS form")))
    assert got == brute_groups(counts)
    assert max(r[4] for r in got) > 5 and any(r[2] != r[1] and r[1] for r in got)
    assert rows(spelling.group_variants(spark.createDataFrame([], "word string, n long"))) == []


def test_numbers_are_checked(spark, monkeypatch):
    """Nodes that share a number are found out, and another key is taken."""
    words = spark.createDataFrame([(k, w, 3) for k, w in enumerate(["abc", "abd", "bcd", "a"])], "id long, word string, n long")
    assert spelling._numbered_apart(words, 0)
    real = spelling._links
    monkeypatch.setattr(spelling, "_links", lambda key: _coarse(real, key))
    assert not spelling._numbered_apart(words, 0) and spelling._numbered_apart(words, 2)
    got = rows(spelling.group_variants(words))
    assert got == brute_groups({"abc": 3, "abd": 3, "bcd": 3, "a": 3})


def _coarse(real, key):
    def run(batches):
        for batch in real(key)(batches):
            node = batch.column(1).to_numpy() % (4 if key < 2 else 2**62)
            yield batch.set_column(1, "node", spelling.pa.array(node))

    return run


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = brute_counts([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert rows(spelling.group_variants(spelling.count_words(docs))) == brute_groups(counts)


def test_very_long_text(spark):
    text = "manywords of onetext " * 100_000
    got = {r["word"]: r["n"] for r in spelling.count_words(spark.createDataFrame([(1, text), (2, "z" * 300_000)] + [(3, "y" * 200_000)] * 3, "doc_id long, text string")).collect()}
    assert got == {"manywords": 100_000, "onetext": 100_000, "y" * 200_000: 3}
    long = spelling.group_variants(spark.createDataFrame([("y" * 200_000, 9), ("y" * 199_999, 3)], "word string, n long"))
    assert [(r["n_near"], r["form_n"]) for r in long.orderBy("n").collect()] == [(1, 9), (1, None)]
