import corpus_pipeline as P
import sentencepiece

from tapespark.llm import decontaminate, language_id, secrets, sentencepieces
from tests.llm.test_near_dedup import brute


def test_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = language_id.train(docs)
    for r in language_id.predict(docs, model, ["doc_id"]).collect():
        if r["__lang"] == "und" or r["__score"] < 0.5:
            del rows[r["doc_id"]]
    kept = {d for d, _, _, k in brute([(d, r["text"]) for d, r in rows.items()], 5, 80) if k}
    items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = set()
    for d in kept:
        t = decontaminate.normal(rows[d]["text"])
        if not any(decontaminate.distance(decontaminate.masks(i), len(i), t) <= int(len(i) * decontaminate.RATE) for i in items):
            clean.add(d)
    got = {r["doc_id"]: r for r in P.run(spark, sf).collect()}
    assert set(got) == clean and 0 < len(clean) < len(kept)
    voc = sentencepieces._vocabulary(sentencepieces.read_model())
    sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepieces.read_model())
    assert voc.size == sp.vocab_size()
    for d, r in got.items():
        text = sp.decode(r["ids"])
        assert not secrets.rules(text) and r["n_tokens"] == len(r["ids"])
        if not secrets.rules(rows[d]["text"]) and "[SECRET]" not in text:
            assert text == rows[d]["text"]


def test_rows_that_are_null_or_repeated(spark, tmp_path):
    rows = [(1, "the cat sat on the mat again", "en", "s", 28), (1, "the cat sat on the mat again", "en", "s", 28), (2, "The cat sat on the mat again", "en", None, None), (None, "another null id text", None, "s", 1), (3, None, "en", "s", 0), (4, "12 !", "en", "s", 4), (5, "one text of a shared id", "en", "s", 1), (5, "a wholly different one, first by text", "en", "t", 1)]
    rows += [(6, "a long text about nothing much " * 40_000, "en", "s", 1), (7, "Nobody Knows", "en", "s", 1), (8, "nobody knowsall", "en", "s", 1)]
    names = ["doc_id", "text", "lang", "source", "n_chars", "__hits", "__text", "__lang", "__found", "n", "x.y"]
    df = spark.createDataFrame([(*r, *range(6)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, a int, b int, c int, d int, e int, f int").toDF(*names)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None), (2, "nobody knows")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = P.run(spark, str(tmp_path)).collect()
    assert sorted([r["doc_id"] for r in got], key=str) == [1, 5, 6, 8, None]
    assert [r["source"] for r in got if r["doc_id"] == 5] == ["t"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for _, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.collect() == []
