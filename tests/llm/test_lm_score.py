import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tapespark.llm import lm_score


def model(texts, order):
    """Brute-force interpolated modified Kneser-Ney."""
    toks = lambda t: (t or "").lower().split() + ["</s>"]
    grams = {order: Counter()}
    base = Counter()
    for t in texts:
        w = toks(t)
        base.update(w)
        w = ["<s>"] * (order - 1) + w
        grams[order].update(tuple(w[i : i + order]) for i in range(len(w) - order + 1))
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    d = {k: lm_score._discounts([sum(c == j for c in grams[k].values()) for j in (1, 2, 3, 4)]) for k in grams}
    by = {k: defaultdict(list) for k in grams}
    for k in grams:
        for g, c in grams[k].items():
            by[k][g[:-1]].append(c)

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (len(base) + 1)
        follow = by[k].get(g[:-1])
        if not follow:
            return p(g[1:])
        c, total = grams[k][g], sum(follow)
        return (c - d[k][min(c, 3)]) / total + sum(d[k][min(x, 3)] for x in follow) / total * p(g[1:])

    def scored(t):
        w = ["<s>"] * (order - 1) + toks(t)
        n, v = sum(base.values()), len(base)
        words = w[order - 1 :]
        return len(words), sum(base[x] > 0 for x in words), n, sum(math.log10((base[x] + 1) / (n + v + 1)) for x in words), sum(math.log10(p(tuple(w[i : i + order]))) for i in range(len(w) - order + 1))

    return scored, p, base


@pytest.mark.parametrize("order", [2, 3])
def test_against_brute_force(spark, order, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_BYTES", 3000)
    rnd = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(60)]
    texts = [" ".join(rnd.choice(vocab, size=rnd.integers(0, 40), p=np.arange(60, 0, -1) / 1830)) for _ in range(200)]
    texts += [None, "", " \n", "the the the " * 200, "Unseen WORDS w1 w2\tw3"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    scored, p, base = model([t for t, h in zip(texts, held) if not h], order)
    for r in lm_score.score_held_out(df, order).collect():
        n, known, total, b, s = scored(texts[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], n, known, total)
        assert r["base_score"] == pytest.approx(b) and r["score"] == pytest.approx(s)
    for context in (("w1",), ("w2",), ("zzz",)):
        assert sum(p((*context, w)) for w in [*base, "<unk>"]) == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    model = lm_score.train(df.limit(0))
    assert [(r["n_tokens"], r["n_known"], r["score"]) for r in lm_score.score(df, model).collect()] == [(3, 0, 0.0), (1, 0, 0.0)]
    assert lm_score.score_held_out(df.limit(0)).collect() == []
    assert lm_score.score_held_out(df.withColumn("score", df.text)).count() == 2
