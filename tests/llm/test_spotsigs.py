import hashlib
import random
import re

import pytest
import xxhash

from tapespark.llm import spotsigs as S


def brute(text):
    """Signatures straight from their definition, with another xxHash."""

    def sig(*words):
        h = 42
        for w in words:
            h = xxhash.xxh64(w.encode(), seed=h).intdigest()
        return (h - (1 << 64) if h >> 63 else h) >> 24

    if not text:
        return []
    words = [w for w in re.split(r"[\x00-\x20!-/:-@\[-`{-~]+", text.lower()) if w]
    if not words:
        return [sig(text)]
    if len(words) <= S.CHAIN:
        return [sig(" ".join(words))]
    out, spots = set(), []
    for i, w in enumerate(words):
        if w in S.ANCHORS:
            follow = [x for x in words[i + 1 : i + 1 + S.REACH] if x not in S.ANCHORS]
            if len(follow) >= S.CHAIN:
                out.add(sig(w, *follow[: S.CHAIN]))
                spots.append(i)
    near = {k for p in spots for k in range(p, p + S.REACH + 1)}
    out |= {sig(*words[i : i + S.CHAIN + 1]) for i in range(len(words) - S.CHAIN) if not near & set(range(i, i + S.CHAIN + 1))}
    return sorted(out)


def test_query_against_brute_force(spark):
    """Fingerprints and both likenesses of every row, and the edited text they are of; one text is very long."""
    rnd = random.Random(11)
    words = ["the", "a", "of", "und", "les", "con", *(f"w{k}" for k in range(40)), "Été", "x-y", "12%", "..."]
    docs = {k: rnd.choice(["", " ", "\n"]).join([" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 3, 30, 80])))] * 2) for k in range(60)}
    docs |= {100: "", 101: "!!", 102: None, 103: "lonely word " + "w1 w2 w3 " * 50_000, 104: docs[7], 105: docs[7] + " the w1 w2"}
    rows = S.scan(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)).collect()
    ids = sorted(docs, reverse=True)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    assert len(rows) == len(docs)
    for r in rows:
        text, after = docs[r["doc_id"]] or "", docs[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]] or ""
        cut = len(text) // 3
        own, edited, following = (brute(x) for x in (text, text[: len(text) - cut] + after[:cut], after))
        show = lambda s: "".join(f"{x + (1 << 40):010X}"[-10:] for x in s)
        assert r["fingerprint"] == show(own) and r["edited_fingerprint"] == show(edited), r["doc_id"]
        assert r["near_edited"] == pytest.approx(like(set(own), set(edited))) and r["near_next"] == pytest.approx(like(set(own), set(following)))


def test_edits_and_likeness(spark, monkeypatch):
    docs = {k: f"the quick{k} brown{k % 7} fox and a lazy{k} dog of house{k} in my blue{k} garden " * (1 + k % 3) for k in range(60)}
    docs[60], docs[61], docs[62], docs[63] = "", None, "x", "nothing common here"
    docs[64] = docs[63]
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3).withColumn("bucket", S.F.lit("b"))
    ids = sorted(docs, reverse=True)
    for size in (S.BUCKET_BYTES, 900):
        monkeypatch.setattr(S, "BUCKET_BYTES", size)
        rows = {r["doc_id"]: r for r in S.scan(df).collect()}
        assert len(rows) == len(docs)
        for k, i in enumerate(ids):
            text, following = docs[i] or "", docs[ids[(k + 1) % len(ids)]] or ""
            cut = len(text) // 3
            edited = text[: len(text) - cut] + following[:cut]
            r = rows[i]
            assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            assert (r["fingerprint"] == "") == (text == "")
            if len(text) > 60:
                assert r["near_edited"] > r["near_next"]
        assert rows[64]["near_next"] == 1.0 and rows[63]["fingerprint"] == rows[64]["fingerprint"]


def test_ties_nulls_and_single(spark):
    df = spark.createDataFrame([(None, "b b b"), (None, "a a a"), (3, "c c c"), (3, "d d d")], "doc_id long, text string")
    got = {(r["doc_id"], r["edited_sha256"]) for r in S.scan(df).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {(3, sha("c c d")), (3, sha("d d a")), (None, sha("a a b")), (None, sha("b b c"))}
    one = S.scan(spark.createDataFrame([(1, "abc abc")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert S.scan(df.limit(0)).collect() == []


def test_signature_chains(spark):
    row = spark.createDataFrame([("The cat sat on the mat.", "the CAT: sat, on the mat")], "a string, b string").select(S.signatures(S.F.col("a")).alias("a"), S.signatures(S.F.col("b")).alias("b")).first()
    assert row["a"] == row["b"] and len(row["a"]) == 1


def test_pairs_against_brute_force(spark):
    base = [f"the alpha{k} beta{k} of gamma{k} delta{k}" for k in range(30)]
    docs = [(k, " ".join(base[j] for j in range(30) if j != k % 9 or k % 4)) for k in range(24)] + [(50, base[0]), (51, base[0]), (52, ""), (53, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pairs, members = S.near_pairs(df)
    sets = {r["doc_id"]: frozenset(r["s"]) for r in df.select("doc_id", S.signatures(S.F.coalesce("text", S.F.lit(""))).alias("s")).collect()}
    reps = {}
    for d in sorted(sets):
        if sets[d]:
            reps.setdefault(sets[d], d)
    want = {(max(a, b), min(a, b)) for x, a in reps.items() for y, b in reps.items() if a > b and len(x & y) / len(x | y) >= 0.8}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and want
    assert {(r["doc_id"], r["rep"]) for r in members.collect()} == {(d, reps[s]) for d, s in sets.items() if s}


def reference(words):
    """(sort, words) of each signature of a list of more than two words."""
    spots, out = [], set()
    for i, w in enumerate(words):
        follow = [x for x in words[i + 1 : i + 1 + S.REACH] if x not in S.ANCHORS]
        if w in S.ANCHORS and len(follow) >= S.CHAIN:
            spots.append(i)
            out.add((w, *follow[: S.CHAIN]))
    for i in range(len(words) - S.CHAIN):
        if not any(i - S.REACH <= s <= i + S.CHAIN for s in spots):
            out.add(tuple(words[i : i + S.CHAIN + 1]))
    return out


def test_signatures_are_local(spark):
    table = " ".join(f"cell{k}" for k in range(90))
    prose = "the quick fox of a lazy house in my garden " * 20
    rows = {r["doc_id"]: r for r in S.scan(spark.createDataFrame([(2, table), (1, prose)], "doc_id long, text string")).collect()}
    assert rows[2]["near_edited"] > 0.4 and rows[2]["near_next"] == 0
    texts = [table, table + " the quick fox", "the quick fox " + table, table + " the quick fox " + table.upper(), "the of a an " + table, "cell the of a", "cell1 the cell2 of", prose, table.replace("cell50", "the")]
    got = [set(r["s"]) for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").select("k", S.signatures(S.F.col("t")).alias("s")).orderBy("k").collect()]
    sets = [reference(t.lower().split()) for t in texts]
    for a, x in zip(got, sets):
        assert len(a) == len(x)
        for b, y in zip(got, sets):
            assert len(a & b) == len(x & y)
