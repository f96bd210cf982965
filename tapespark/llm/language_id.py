"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts, per language, the n-grams (1 to ``ORDERS`` code points) of every labelled text in ``BUCKETS`` hash buckets:
tasks add up dense counts and send the non-zero ones, Spark sums them by (language, bucket). The log-probability matrix,
buckets x languages of 4 bytes, is broadcast in parts of as many languages as ``MAX_MODEL_BYTES`` holds; with more languages
than one part has, the documents go through one map for each part, which carries the best language so far and the sum of
likelihoods. Scoring is a map: the n-grams of a batch of texts pick rows of the matrix, which are summed by text.

N-grams are of letters, lower-cased; any run of other characters is one word boundary, which may begin or end an n-gram but
is not inside one. A text longer than a slice is taken piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rows import Texts, batch_of, fresh, named
from ._store import materialize
from ._text import slices, utf8
from .lm_score import held_out

BUCKETS, ORDERS, SMOOTHING = 1 << 16, 3, 0.5
MAX_MODEL_BYTES = 64 << 20
#: A slice of texts is small, since every byte takes some hundred bytes of arrays.
_SLICE = 1 << 18
#: Columns of the matrix that are gathered at a time.
_GROUP = 16
UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _codes(text: str) -> np.ndarray:
    """Code points, 0 for what is no letter."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[np.minimum(code, 0x10FFFF)], code, 0).astype(np.uint64)


def _one_boundary(code: np.ndarray) -> np.ndarray:
    """Which codes stay when every run of boundaries becomes one."""
    keep = code != 0
    keep[1:] |= code[:-1] != 0
    keep[:1] = True
    return keep


def _hashed(code: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the buckets of the n-grams that end at ``least`` or later, and where they end."""
    whole = code != 0
    for n in range(1, ORDERS + 1):
        at = np.arange(max(n - 1, least), len(code))
        ok = whole[at] if n == 1 else np.ones(len(at), bool)
        for k in range(1, n - 1):
            ok &= whole[at - k]
        if n == 2:
            ok = whole[at] | whole[at - 1]
        at = at[ok]
        h = np.full(len(at), np.uint64(n))
        for k in range(n):
            h = (h * np.uint64(0x9E3779B97F4A7C15) + code[at - k]) * np.uint64(0xD1342543DE82EF95)
        yield ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64) % BUCKETS, at


def _grams(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, buckets in order of text, where each text's begin); a long text alone gives several lots of each order."""
    lowered = [t.lower() for t in texts]
    if len(lowered) == 1 and len(lowered[0]) > _SLICE:
        tail, text = np.zeros(1, np.uint64), lowered[0]
        for a in range(0, len(text), _SLICE):
            code = np.concatenate((tail, _codes(text[a : a + _SLICE]), np.zeros(int(a + _SLICE >= len(text)), np.uint64)))
            code = code[_one_boundary(code)]
            for n, (bucket, _) in enumerate(_hashed(code, len(tail)), 1):
                yield n, bucket, np.array([0, len(bucket)])
            tail = code[1 - ORDERS :]
        return
    code = _codes("\0".join(["", *lowered, ""]))
    end = np.cumsum([len(t) + 1 for t in lowered])  # the boundary after each text
    keep = _one_boundary(code)
    last = np.concatenate(([0], np.cumsum(keep)))[np.concatenate(([0], end)) + 1]  # kept codes up to each boundary
    for n, (bucket, at) in enumerate(_hashed(code[keep], 0), 1):
        yield n, bucket, np.searchsorted(at, last)


def _batches(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    _, off = utf8(column)
    for a, b in slices(off, _SLICE):
        yield a, b, ["" if x is None else x for x in column.slice(a, b - a).to_pylist()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        rows = [(lang, np.flatnonzero(x), x) for lang, x in sums.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].tolist() for r in rows], pa.list_(pa.int32())), pa.array([r[2][r[1]].tolist() for r in rows], pa.list_(pa.int64()))], ["lang", "bucket", "count"])

    for batch in batches:
        for a, b, texts in _batches(batch.column(1)):
            langs = batch.column(0).slice(a, b - a).to_pylist()
            names = sorted(set(langs))
            which = np.array([names.index(x) for x in langs])
            for k, name in enumerate(names):
                if name not in sums:
                    sums[name] = np.zeros(BUCKETS + 1, np.int64)
                sums[name][BUCKETS] += int((which == k).sum())
            for _, bucket, begin in _grams(texts):
                of = np.repeat(which, np.diff(begin))
                for k, name in enumerate(names):
                    sums[name][:BUCKETS] += np.bincount(bucket[of == k] if len(names) > 1 else bucket, minlength=BUCKETS)
            if len(sums) > 64:
                yield flush()
                sums.clear()
    if sums:
        yield flush()


@dataclass(frozen=True)
class Part:
    """Some languages: their names in order, buckets x languages of log probabilities, and the logarithms of their shares."""

    langs: list[str]
    weights: np.ndarray
    prior: np.ndarray


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> list:
    """Broadcast parts of the model, learned from all rows with a language; no other column than these two is read.

    A null text adds to its language's share only. The driver holds the counts of one part at a time.
    """
    (lang_column, text_column) = named(lang, text)
    rows = docs.select(lang_column.cast("string").alias("lang"), text_column.cast("string").alias("text")).where("lang IS NOT NULL")
    counts = rows.mapInArrow(_count, "lang string, bucket array<int>, count array<long>")
    counts = counts.select("lang", F.explode(F.arrays_zip("bucket", "count")).alias("x")).groupBy("lang", F.col("x.bucket").alias("bucket")).agg(F.sum("x.count").alias("count"))
    counts = materialize(counts, "lid-counts")
    seen = {r["lang"]: r["count"] for r in counts.where(F.col("bucket") == BUCKETS).collect()}
    langs, most = sorted(seen), max(1, MAX_MODEL_BYTES // (4 * BUCKETS))
    total = sum(seen.values()) + len(langs)
    parts = []
    for k in range(0, len(langs), most):
        some = langs[k : k + most]
        table = counts.where((F.col("bucket") < BUCKETS) & F.col("lang").between(some[0], some[-1])).toArrow()
        grams = np.full((BUCKETS, len(some)), SMOOTHING)
        index = {x: j for j, x in enumerate(some)}
        grams[table.column("bucket").to_numpy(), [index[x] for x in table.column("lang").to_pylist()]] += table.column("count").to_numpy()
        grams /= grams.sum(axis=0)
        parts.append(docs.sparkSession.sparkContext.broadcast(Part(some, np.log(grams).astype(np.float32), np.log(np.array([seen[x] + 1 for x in some]) / total))))
    return parts


def _scores(part: Part, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods of texts x languages, and which texts have a letter."""
    scores = np.tile(part.prior, (len(texts), 1))
    letters = np.zeros(len(texts), bool)
    for n, bucket, begin in _grams(texts):
        some = np.diff(begin) > 0
        if n == 1:
            letters |= some
        if some.any():
            for g in range(0, len(part.langs), _GROUP):
                scores[some, g : g + _GROUP] += np.add.reduceat(part.weights[:, g : g + _GROUP][bucket], begin[:-1][some], axis=0, dtype=np.float64)
    return scores, letters


def _predict(rows: Texts, shared, more: bool):
    """One part's languages; with ``more`` the last three columns are the best so far: language, log likelihood, sum of likelihoods over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = shared.value
        for batch in batches:
            carried = batch.columns[-3:] if more else []
            for a, b, texts in _batches(rows.text(batch)):
                scores, letters = _scores(part, texts)
                best, top = scores.argmax(axis=1), scores.max(axis=1)
                total = np.exp(scores - top[:, None]).sum(axis=1)
                lang = [part.langs[k] if ok else None for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                if carried:
                    was, old, over = (c.slice(a, b - a) for c in carried)
                    old, over = old.to_numpy(), over.to_numpy()
                    high = np.maximum(old, top)
                    total = total * np.exp(top - high) + over * np.exp(old - high)
                    lang = [x if new else y for x, y, new in zip(lang, was.to_pylist(), (top > old).tolist(), strict=True)]
                    top = high
                columns = [batch.column(k).slice(a, b - a) for k in range(batch.num_columns - len(carried))]
                yield batch_of([*columns, pa.array(lang, pa.string()), pa.array(top), pa.array(total)])

    return run


def predict(docs: DataFrame, model: list, keep: list[str], text: str = "text", names: tuple[str, str] | None = None) -> DataFrame:
    """The ``keep`` columns, then the language and its posterior probability, as ``names`` (``__lang`` and ``__score``, with
    underscores added where a kept column has that name).

    A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing was learned. Ties go to the
    language that sorts first. Rows are independent: repeated rows get the same answer. Further columns pass through if kept.
    """
    lang, score = names or fresh(keep, "lang", "score")
    texts = Texts(docs, keep, text)
    if not model:
        return docs.select(*named(*keep), F.lit(UNDETERMINED).alias(lang), F.lit(0.0).alias(score))
    rows = texts.rows
    for k, part in enumerate(model):
        rows = rows.mapInArrow(_predict(texts, part, k > 0), texts.schema("lang string, top double, total double", with_text=True))
    return texts.restored(rows, F.coalesce("lang", F.lit(UNDETERMINED)).alias(lang), F.when(F.col("lang").isNull(), 0.0).otherwise(1 / F.col("total")).alias(score))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled documents that are not held out (crc32 mod 4 is not 2), then predict every document.

    Returns doc_id, held_out, lang_pred, score; further columns of ``docs``, whatever their names, stay out.
    """
    docs = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 4, 2))
    return predict(docs, train(docs.where(~F.col("held_out"))), ["doc_id", "held_out"], names=("lang_pred", "score"))
