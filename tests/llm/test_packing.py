from collections import defaultdict

import numpy as np
import sentencepiece

from tapespark.llm import packing, sentencepieces


def brute_rows(lengths, row):
    room, out = [], 0
    for n in sorted(lengths, reverse=True):
        fit = [k for k, r in enumerate(room) if r >= n]
        if fit:
            room[min(fit, key=lambda k: room[k])] -= n
        else:
            room.append(row - n)
            out += 1
    return out, sorted(room)


def test_best_fit_against_brute_force():
    rnd = np.random.default_rng(3)
    for row in (1, 7, 64, 100):
        lengths = rnd.integers(1, row + 1, 300)
        at, rows = packing.best_fit(lengths, row)
        used = np.bincount(at, lengths, rows)
        assert (rows, sorted(row - used)) == brute_rows(lengths.tolist(), row)


def test_lossless_and_best_fit(spark, monkeypatch):
    """Every document comes back, also where ids repeat or are null, and each block's rows are those of plain best fit decreasing."""
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 3000)
    docs = [(1, "hello world " * 300), (2, None), (3, ""), (None, "null id"), (None, "another null id " * 90), (5, "a\nb"), (5, "a\nb"), (5, "something else " * 70), (5, "third")] + [(10 + k, "word " * k) for k in range(60)]
    df = spark.createDataFrame([(*d, k) for k, d in enumerate(docs)], "doc_id long, text string, block int").repartition(3)
    sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepieces.read_model())
    parts, blocks, ids_of = defaultdict(list), defaultdict(list), {}
    for r in packing.pack(df, length=128).collect():
        ids = np.frombuffer(r["input_ids"], "<u2")
        cu = r["cu_seqlens"]
        assert len(ids) == 128 and cu[0] == 0 and cu[-1] == r["n_tokens"] and cu[:-1] == r["position_resets"] and (ids[cu[-1] :] == 0).all()
        at = packing.positions(cu, 128)
        assert all(at[x] == 0 for x in r["position_resets"])
        blocks[r["block"]].append(np.diff(cu).tolist())
        for a, b, doc, number, offset in zip(cu, cu[1:], r["doc_ids"], r["doc_numbers"], r["doc_offsets"]):
            parts[r["block"], number].append((offset, ids[a:b].tolist()))
            assert ids_of.setdefault((r["block"], number), doc) == doc
    got = sorted(((ids_of[k], sum((x for _, x in sorted(v)), [])) for k, v in parts.items()), key=str)
    assert got == sorted(((d, [*sp.encode(t or ""), 2]) for d, t in docs), key=str)
    assert len(blocks) > 2
    for rows in blocks.values():
        n, room = brute_rows(sum(rows, []), 128)
        assert len(rows) == n and sorted(128 - sum(x) for x in rows) == room
    assert packing.pack(df.limit(0)).collect() == []


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(packing, "_SLICE", 10_000)
    text = "many words of one text " * 60_000
    rows = packing.pack(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")).collect()
    parts = sorted((o, r["input_ids"][2 * a : 2 * b]) for r in rows for a, b, d, o in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], r["doc_offsets"]) if d == 1)
    sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepieces.read_model())
    assert np.frombuffer(b"".join(x for _, x in parts), "<u2").tolist() == [*sp.encode(text), 2]
