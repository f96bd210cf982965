import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tapespark.llm import language_id as li


def test_grams_against_brute_force():
    texts = ["Ab c!", "", "12 é--ß", "x", "ab" * 3]
    for n, bucket, begin in li._grams(texts):
        want = []
        for t in texts:
            words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
            grams = 0
            for w in words:
                if n == 1:
                    grams += len(w)
                else:
                    p = f" {w} "
                    grams += sum(1 for i in range(len(p) - n + 1) if n > 2 or p[i : i + n] != "  ")
            want.append(grams)
        assert np.diff(begin).tolist() == want and len(bucket) == begin[-1]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = li.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in test) / len(test) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_edges(spark):
    rows = [(1, "hello world the", "en", 1.0), (2, "bonjour été", "fr", 2.0), (None, None, None, None), (4, "", "en", 1.0), (5, "123 !!", None, 1.0), (5, "le été " * 50_000, None, 1.0), (8, "hello", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {(r["doc_id"], r["lang_pred"], r["score"] > 0.5) for r in li.identify(df).collect()}
    assert got >= {(None, "und", False), (4, "und", False), (5, "und", False)}
    model = li.train(df)
    kept = li.predict(df, model, df.columns).collect()
    assert {r["text"]: r["__lang"] for r in kept}["hello"] == "en" and {r["__lang"] for r in kept if r["text"] and r["text"][0] == "l"} == {"fr"}
    assert {r["__lang"] for r in li.predict(df, li.train(df.limit(0)), ["doc_id"]).collect()} == {"und"}
    assert li.identify(df.limit(0)).collect() == []


def buckets(text):
    """Every n-gram of a text, by plain integers."""
    codes = [0]
    for c in (text or "").lower():
        if c.isalpha():
            codes.append(ord(c))
        elif codes[-1]:
            codes.append(0)
    codes += [0] * (codes[-1] > 0)
    full, out = (1 << 64) - 1, []
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            gram = codes[i : i + n]
            if (n == 1 and gram[0]) or (n == 2 and any(gram)) or (n == 3 and gram[1]):
                h = n
                for c in reversed(gram):
                    h = (h * 0x9E3779B97F4A7C15 + c) * 0xD1342543DE82EF95 & full
                out.append(((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & full) >> 48)
    return out


def brute(rows):
    """{doc_id: (language, posterior)} by definition; rows of (doc_id, text, lang)."""
    counts, seen = {}, Counter()
    for d, text, lang in rows:
        if lang is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(buckets(text))
            seen[lang] += 1
    out = {}
    for d, text, _ in rows:
        if not any(c.isalpha() for c in (text or "").lower()):
            out[d] = ("und", 0.0)
            continue
        value = {}
        for lang in sorted(counts):
            total = sum(counts[lang].values()) + 0.5 * 65536
            value[lang] = math.log((seen[lang] + 1) / (sum(seen.values()) + len(seen))) + sum(n * math.log((counts[lang][b] + 0.5) / total) for b, n in Counter(buckets(text)).items())
        best = max(value, key=value.get)
        out[d] = (best, 1 / sum(math.exp(v - value[best]) for v in value.values()))
    return out


@pytest.mark.parametrize("languages", [1, 2, 256])
def test_predictions_against_brute_force(spark, monkeypatch, languages):
    """Also with so small a bound that the model is cut into parts of one or two languages."""
    monkeypatch.setattr(li, "MAX_MODEL_BYTES", 4 * li.BUCKETS * languages)
    monkeypatch.setattr(li, "_SLICE", 3000)
    rnd = random.Random(5)
    rows = []
    for d in range(120):
        lang = rnd.choice(["aa", "bb", "cc", "dd", "ee"])
        letters = {"aa": "abcdeé", "bb": "cdefgß", "cc": "xyzabc", "dd": "mnoabц", "ee": "qrstuv"}[lang]
        text = " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 6))) for _ in range(rnd.choice([0, 1, 3, 1500])))
        rows.append((d, rnd.choice([text, text.upper() + "!"]), rnd.choice([lang, lang, None])))
    rows += [(500, None, "aa"), (501, "12-3", None), (502, "a" * 10_000, None)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in li.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for d, (lang, score) in want.items():
        assert got[d][0] == lang and math.isclose(got[d][1], score, rel_tol=1e-3, abs_tol=1e-9), (d, got[d], want[d])


def test_names_that_clash(spark):
    df = spark.createDataFrame([("the cat", "en", 1, 2, 3, 4), ("le chat", "fr", 5, 6, 7, 8)], "text string, lang string, a int, b int, c int, d int").toDF("text", "lang", "__lang", "__score", "a.b", "__text")
    rows = li.predict(df, li.train(df), df.columns).collect()
    assert rows[0].__fields__ == [*df.columns, "__lang_", "__score_"] and [(r["__lang"], r["a.b"], r["__lang_"]) for r in rows] == [(1, 3, "en"), (5, 7, "fr")]
