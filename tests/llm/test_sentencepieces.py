import numpy as np
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tapespark.llm import sentencepieces as S
from tapespark.llm._text import utf8

PROTO = S.read_model()
SP = sentencepiece.SentencePieceProcessor(model_proto=PROTO)
VOC = S._vocabulary(PROTO)


def coded(texts, dropout=0.0, seed=0, variant=None):
    raw, off = utf8(pa.array(texts, pa.string()))
    ids, at = S.encode_rows(VOC, raw, off, np.zeros(len(texts), np.int64) if variant is None else variant, dropout, seed)
    back, ends = S.decode_rows(VOC, ids, at)
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])], [bytes(back[a:b]).decode() for a, b in zip(ends, ends[1:])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="▁\0"), max_size=120), max_size=6))
def test_as_the_library_without_dropout(texts):
    ids, back = coded(texts)
    assert ids == [SP.encode(t) for t in texts] and back == texts


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=120), max_size=6), st.floats(0, 1), st.integers(-5, 5))
def test_lossless_with_dropout(texts, dropout, seed):
    assert coded(texts, dropout, seed)[1] == texts


def agenda(text, dropout, key):
    """One merge at a time, each candidate skipped by the same hash."""
    chars, limit = list(text), int(dropout * (1 << 31))
    sym = [(VOC.char[ord(c)], k, k + 1) for k, c in enumerate(chars)]
    while True:
        best = None
        for k in range(len(sym) - 1):
            (a, i, m), (b, _, j) = sym[k], sym[k + 1]
            rank, out = VOC.look(np.array([a]), np.array([b]))
            if rank[0] < S._NEVER and not S._skipped(np.array([key]), np.array([i]), np.array([m]), np.array([j]), limit)[0] and (best is None or rank[0] < best[0]):
                best = (rank[0], k, (int(out[0]), i, j))
        if best is None:
            return [int(s[0]) for s in sym]
        sym[best[1] : best[1] + 2] = [best[2]]


def test_dropout_against_an_agenda():
    keys = np.array([5, 6, 7, 8], np.uint64)
    for word in (" international", " unbelievable", " " + "abcde" * 20):
        symbol = VOC.char[[ord(c) for c in word]]
        begin = np.arange(5) * len(word)
        sym, _, at = S._segment(VOC, np.tile(symbol, 4), begin, keys, int(0.4 * (1 << 31)))
        got = [sym[a:b].tolist() for a, b in zip(at, at[1:])]
        assert got == [agenda(word, 0.4, k) for k in keys]
        assert len({tuple(x) for x in got}) > 1


def test_operators(spark):
    rows = [(1, "the international  word\n", "a"), (2, None, "b"), (None, "", "c"), (3, "x" * 50_000, "d"), (3, "the international  word\n", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = S.encode(df, ["doc_id", "ids"], dropout=0.5, seed=3)
    back = S.decode(out, ["doc_id", "ids"], "__ids").collect()
    assert sorted((r["ids"], r["doc_id"], r["__text"]) for r in back) == sorted((r[2], r[0], r[1]) for r in rows)
    seg = S.segment_corpus(df)
    assert all(r["lossless"] and r["n_tokens"] == len(r["ids"] or []) for r in seg.collect())
    assert S.segment_corpus(df.limit(0)).collect() == []
    again = {(r["doc_id"], tuple(r["ids"] or [])) for r in seg.collect()}
    assert again == {(r["doc_id"], tuple(r["ids"] or [])) for r in S.segment_corpus(df.repartition(2)).collect()}
    assert again != {(r["doc_id"], tuple(r["ids"] or [])) for r in S.segment_corpus(df, seed=18).collect()}


def test_every_occurrence_has_its_own_draws(spark, monkeypatch):
    text = "international " * 300
    ids = coded([text], 0.1, 17)[0][0]
    starts = [k for k, i in enumerate(ids) if SP.id_to_piece(i).startswith("▁")]
    assert len({tuple(ids[a:b]) for a, b in zip(starts[:300], starts[1:301])}) > 4
    df = spark.createDataFrame([(k, "international") for k in range(400)] + [(None, "international")], "doc_id long, text string")
    assert len({tuple(r["ids"]) for r in S.segment_corpus(df).collect()}) > 4
    texts = [text, "the unbelievable  word, ünïcode 漢字 " * 40, "", "abcde" * 40, "x"]
    rows = np.arange(5)
    fast = [coded(texts, d, 3, rows) for d in (0.1, 0.5, 1.0)]
    monkeypatch.setattr(S, "BLOCK_CHARS", 50)
    assert fast == [coded(texts, d, 3, rows) for d in (0.1, 0.5, 1.0)]
    monkeypatch.setattr(S, "_changed", lambda count, back, *_: np.arange(len(back)))
    assert fast == [coded(texts, d, 3, rows) for d in (0.1, 0.5, 1.0)]


def test_long_text_in_pieces(spark, monkeypatch):
    texts = ["the  unbelievable ünïcode   word " * 60 + "x" * 500 + " y" * 300, "   ", "short text"]
    whole = [coded([t], d, 3) for t in texts for d in (0.0, 0.3)]
    monkeypatch.setattr(S, "SLICE_BYTES", 100)
    assert whole == [coded([t], d, 3) for t in texts for d in (0.0, 0.3)]
    df = spark.createDataFrame([(1, texts[0], 2, 3)], "doc_id long, text string, a int, b int").toDF("doc_id", "text", "__ids", "x.y")
    out = S.encode(df, df.columns, dropout=0.3, seed=3)
    assert out.columns == [*df.columns, "__ids_"]
    (r,) = S.decode(out, out.columns, "__ids_").collect()
    assert r["__text"] == texts[0] and (r["__ids"], r["x.y"]) == (2, 3)
