import functools
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tapespark.llm import swap_packing
from tapespark.llm.packing import best_fit


@functools.cache
def library():
    return Tokenizer.from_file(swap_packing.DEFAULT_TOKENIZER)


def plain(text, end=0):
    return [*library().encode(text or "", add_special_tokens=False).ids, end]


def optimum(sizes, most):
    """The fewest sequences, by trying all partitions of a few pieces."""

    def go(left, n):
        if not left:
            return True
        first, rest = left[0], left[1:]
        for k in range(len(rest) + 1):
            for more in itertools.combinations(range(len(rest)), k):
                if first + sum(rest[i] for i in more) <= most and n and go([x for i, x in enumerate(rest) if i not in more], n - 1):
                    return True
        return False

    return next(n for n in range(1, len(sizes) + 1) if go(sorted(sizes, reverse=True), n))


def test_bound_and_search_against_optimum():
    rnd = random.Random(4)
    for _ in range(60):
        most = rnd.choice([10, 13, 20])
        sizes = [rnd.randrange(1, most) for _ in range(rnd.randrange(1, 9))]
        at, _ = swap_packing.placed(np.array(sizes), most)
        best = optimum(sizes, most)
        assert swap_packing.fewest(np.array(sizes), most) <= best <= len(set(at.tolist()))
        assert max(np.bincount(at, sizes)) <= most


def test_swaps_empty_sequences():
    """Best fit needs one more here; exchanges reach the bound."""
    rnd = np.random.default_rng(0)
    better = 0
    for _ in range(30):
        parts = [np.diff(np.sort(np.concatenate(([0, 100], rnd.choice(np.arange(1, 100), 3, replace=False))))) for _ in range(40)]  # 40 full sequences
        sizes = np.concatenate(parts)
        _, n = best_fit(sizes, 100)
        at, _ = swap_packing.placed(sizes, 100)
        found = len(set(at.tolist()))
        assert swap_packing.fewest(sizes, 100) == 40 <= found <= n
        better += found < n
    assert better


def test_search_ends_where_no_exchange_helps():
    """No single piece moved and no exchange of one for one or two for one raises the sum of squared fills."""
    rnd = random.Random(8)
    for _ in range(20):
        sizes = [rnd.choice([3, 5, 6, 7, 9, 11, 14, 20, 31, 45]) for _ in range(60)]
        at, _ = best_fit(np.array(sizes), 50)
        search = swap_packing.Swaps(sizes, at.tolist(), 50)
        before = sum(x * x for x in np.bincount(at, sizes))
        search.run(0)
        fill = defaultdict(int)
        for s, b in zip(sizes, search.place):
            fill[b] += s
        assert fill == search.fill and len(fill) == search.count and sum(x * x for x in fill.values()) >= before and max(fill.values()) <= 50
        held = defaultdict(list)
        for s, b in zip(sizes, search.place):
            if fill[b] < 50:
                held[b].append(s)
        sums = lambda own, most: {sum(c) for k in range(most + 1) for c in itertools.combinations(own, k)}
        for a, b in itertools.permutations(held, 2):
            for take, give in ((1, 2), (1, 1), (1, 0)):
                for x in sums(held[a], take):
                    for y in sums(held[b], give):
                        assert not (x > y and fill[b] + x - y <= 50 and fill[b] + x - y > fill[a])


TEXTS = ["", "It's 9 o'clock ''s  \n\n\tend  ", "ÉCOLE straße ñandú 12½³ x²    y\x85z \x1c\x1d", "日本語 mixed текст 😀", "a <|endoftext|> b", "_under__score 'll'd''ve'RE", "tab\tand   spaces   ", "x" * 700, " ", "\n \n x", "don't’t"]


def test_encoder_against_library(monkeypatch):
    monkeypatch.setattr(swap_packing, "_WORDS", 20)
    monkeypatch.setattr(swap_packing, "_CUT_CHARS", 5)
    encoder = swap_packing.Encoder(swap_packing.read_tokenizer())
    rnd = random.Random(2)
    texts = TEXTS + ["".join(rnd.choice("ab'sé1½ \n\t_-\xa0.") for _ in range(40)) for _ in range(300)]
    for t, raw in zip(texts, encoder.encode(texts), strict=True):
        want = plain(t)[:-1]
        assert np.frombuffer(raw, "<u4").tolist() == want, t
        assert np.frombuffer(encoder.encode_long(t), "<u4").tolist() == want, t


@pytest.mark.parametrize("groups", [1, 5])
def test_lossless(spark, monkeypatch, groups):
    """All ids come back from the sequences, which are gapless and no longer than allowed; repeated and null ids."""
    monkeypatch.setattr(swap_packing, "GROUP_TOKENS", 8 << 20 if groups == 1 else 3000)
    docs = [(k, t * r) for r in (1, 7, 60) for k, t in enumerate(TEXTS)] + [(1, None), (None, "no id"), (None, "no id"), (1, "same"), (1, "same")] + [(k, "word " * k) for k in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS piece", "1 AS `length`", "2 AS `number`").repartition(3)
    packed = swap_packing.pack(df, length=64)
    rows = packed.collect()
    got, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], tuple(ids)))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for d, t in docs:
        ids = plain(t)
        n = -(-len(ids) // 64)
        ends = [len(ids) - 64 * (n - 1 - j) for j in range(n)]
        want[d] += [(j, a, b - a, tuple(ids[a:b])) for j, (a, b) in enumerate(zip([0, *ends], ends))]
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(v) for d, v in want.items()}
    for held in seqs.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= 64
    if groups == 1:
        assert len(seqs) == -(-sum(r["length"] for r in rows) // 64)
    whole = swap_packing.sequences(packed, 64).collect()
    assert sum(r["n_tokens"] for r in whole) == sum(r["length"] for r in rows) and all(len(r["input_ids"]) == 256 and r["cu_seqlens"][-1] == r["n_tokens"] for r in whole)
    pieces = {(r["sequence_id"], r["offset"]): bytes(r["ids"]) for r in packed.collect()}
    for r in whole:
        for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert bytes(r["input_ids"][4 * a : 4 * b]) == pieces[r["sequence_id"], a]
    assert swap_packing.pack(df.limit(0)).collect() == []


def test_very_long_text_and_query(spark):
    text = "many words of one text " * 60_000
    rows = swap_packing.digest(spark.createDataFrame([("a", text), ("b", "x")], "doc_id string, text string")).collect()
    ids = np.array(plain(text), "<u4")
    own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == "a")
    assert [zlib.crc32(ids[s : s + n].tobytes()) for _, s, n, _ in own] == [c for *_, c in own] and sum(n for _, _, n, _ in own) == len(ids) and {n for k, _, n, _ in own if k} == {2048}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = swap_packing.digest(docs).collect()
    assert sum(r["length"] for r in got) == sum(len(plain(r["text"])) for r in docs.collect())
    assert len({r["sequence_id"] for r in got}) == -(-sum(r["length"] for r in got) // 2048)
