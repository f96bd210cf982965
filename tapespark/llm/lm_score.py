"""Interpolated modified Kneser-Ney language model: counted in Spark, stored as sorted hash arrays, memory-mapped to score.

Training is one job. Each task hashes its texts, counts its n-grams and sends them, packed, to shards. A shard sums its counts,
writes sorted arrays of n-gram keys and counts to a file in the shared folder, passes its distinct n-grams on as continuation
counts of the next lower order, and for each of its contexts the total and the numbers of followers seen once, twice, and three
times or more. Those sums of contexts go to shards of their own and are written likewise. Spark adds up the few sums that all
need; only they pass through the driver.

The number of shards follows the text, about ``SHARD_BYTES`` of it each, so that a shard fits in a task at any size. Shards are
a grid of parts by context and parts by token: the followers of a frequent word are dealt over a whole row of it, so a context
that holds a third of all text is split like any other. A frequent n-gram is one entry of a flush, because tasks count before
they send.

Scoring is a map over the documents: workers map the files (pages of one file are shared by all workers of a machine), sort
the keys of a batch of texts and search them shard by shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrays import map_arrays, write_arrays
from ._rows import Texts, batch_of
from ._store import input_bytes, shared_dir
from ._text import U, mix, slices, utf8, words

SHARD_BYTES = 3 << 20
FLUSH_TOKENS, BLOCK_TOKENS = 2_000_000, 500_000
SCORE_BYTES = 4 << 20
END, BEGIN = mix(np.array([1, 2], U) * U(0x632BE59BD9B4E019))
_PARTS = 12  # bits of a key that come from the context, and as many from the token


@dataclass(frozen=True)
class Grid:
    """Shards by context and by token, at most 4096 each way."""

    contexts: int
    tokens: int

    def of(self, key: np.ndarray) -> np.ndarray:
        """The shard of each n-gram."""
        return self.row(key) * self.tokens + ((key >> U(52 - _PARTS) & U(4095)) * U(self.tokens) >> U(_PARTS)).astype(np.int64)

    def row(self, key: np.ndarray) -> np.ndarray:
        """The shard of each context; a key has that of its own."""
        return ((key >> U(52)) * U(self.contexts) >> U(_PARTS)).astype(np.int64)


def _grid(size: int) -> Grid:
    shards = max(1, -(-size // SHARD_BYTES))
    tokens = math.isqrt(shards - 1) + 1
    return Grid(min(4096, -(-shards // tokens)), min(4096, tokens))


def _join(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Key of a context and a token: ``_PARTS`` bits of either, the rest a hash of both."""
    low = mix(context * U(0x9E3779B97F4A7C15) + token) & U((1 << 52 - _PARTS) - 1)
    return (context >> U(52) << U(52)) | (token >> U(52) << U(52 - _PARTS)) | low


def _tokens(raw: np.ndarray, off: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Contexts of 1 to order - 1 tokens, the tokens (words, then one end per row), and where each row's tokens begin."""
    _, _, value, first = words(raw, off)
    rows = len(off) - 1
    begin = first + np.arange(rows + 1)
    token = np.empty(len(value) + rows, U)
    token[begin[1:] - 1] = END
    is_word = np.ones(len(token), bool)
    is_word[begin[1:] - 1] = False
    token[is_word] = value
    place = np.arange(len(token)) - np.repeat(begin[:-1], np.diff(begin))
    contexts: list[np.ndarray] = []
    for k in range(1, order):
        back = np.full(len(token), BEGIN, U)
        back[k:] = np.where(place[k:] >= k, token[:-k], BEGIN)
        contexts.append(back if k == 1 else mix(contexts[-1] * U(0xD1342543DE82EF95) + back))
    return contexts, token, begin


def _sum(columns: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Sorted distinct keys of (longest context, ..., token), their columns, and summed counts."""
    key = _key(columns)
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[at], [c[order[at]] for c in columns], [np.add.reduceat(c[order], at) if len(at) else c[:0] for c in counts]


_PACKED = "level int, shard int, columns binary, counts binary, stats array<long>"
_PACKED_ARROW = pa.schema([("level", pa.int32()), ("shard", pa.int32()), ("columns", pa.binary()), ("counts", pa.binary()), ("stats", pa.list_(pa.int64()))])


def _thin(x: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs, after a byte that says how many."""
    size = next(k for k in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * k - (k == 8))
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def _thick(raw: memoryview, n: int, columns: int) -> list[np.ndarray]:
    out, at = [], 0
    for _ in range(columns):
        size = raw[at]
        out.append(np.frombuffer(raw, f"<u{size}", n, at + 1).astype(np.int64))
        at += 1 + n * size
    return out


def _packed(level: int, shard: np.ndarray, columns: list[np.ndarray], counts: list[np.ndarray]) -> list[dict]:
    """One row for each shard of some sorted entries."""
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    cut = np.append(np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else [], len(shard)).astype(np.int64)
    columns, counts = [c[order] for c in columns], [c[order] for c in counts]
    return [
        {"level": level, "shard": int(shard[a]), "columns": b"".join(c[a:b].tobytes() for c in columns), "counts": b"".join(_thin(c[a:b]) for c in counts), "stats": None}
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)
    ]


def _unpacked(table: pa.Table, columns: int, counts: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    wide = [np.frombuffer(x.as_buffer(), U).reshape(columns, -1) for x in table.column("columns")]
    thin = [_thick(memoryview(x.as_buffer()), w.shape[1], counts) for x, w in zip(table.column("counts"), wide, strict=True)]
    return [np.concatenate(x) for x in zip(*wide, strict=True)], [np.concatenate(x) for x in zip(*thin, strict=True)]


def _key(columns: list[np.ndarray]) -> np.ndarray:
    return _join(columns[0], columns[-1]) if len(columns) > 1 else columns[0]


def _count(order: int, grid: Grid):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            key, columns, counts = _sum(columns, [np.ones(len(columns[0]), np.int64)])
            return pa.RecordBatch.from_pylist(_packed(order, grid.of(key), columns, counts), _PACKED_ARROW)

        for batch in batches:
            raw, off = utf8(batch.column(0))
            for a, b in slices(off):
                contexts, token, _ = _tokens(raw[off[a] : off[b]], off[a : b + 1] - off[a], order)
                for k in range(0, len(token), FLUSH_TOKENS):
                    held.append([x[k : k + FLUSH_TOKENS] for x in (*contexts[::-1], token)])
                    size += len(held[-1][0])
                    if size >= FLUSH_TOKENS:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return run


def _small(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes, with the few above 254 apart."""
    big = np.flatnonzero(counts > 254)
    return {"count": np.minimum(counts, 255).astype(np.uint8), "big_at": big.astype(np.int64), "big": counts[big].astype(np.int64)}


def _reduce(order: int, grid: Grid, folder: str):
    """Sum one shard of n-grams or of contexts (level below 0) and write it; n-grams are passed on as entries of the next lower
    order, their contexts as sums. Rows of stats pass through."""

    def run(table: pa.Table) -> pa.Table:
        level, shard = table.column("level")[0].as_py(), table.column("shard")[0].as_py()
        if level == 0:
            return table
        if level < 0:
            (context,), sums = _unpacked(table, 1, 4)
            _, (context,), sums = _sum([context], sums)
            total, *ns = sums
            write_arrays(f"{folder}/c{-level}/{shard:08d}.arrays", {"context": context, "total": total} | {f"n{k}": x.astype(np.uint32) for k, x in enumerate(ns, 1)})
            return pa.Table.from_pylist([], _PACKED_ARROW)
        columns, counts = _unpacked(table, level, 1 if level == order else 2)
        key, columns, counts = _sum(columns, counts)
        count, raw = counts[0], counts[-1]
        arrays = {"key": key}
        row = [len(key), int(count.sum()), *(int((count == k).sum()) for k in (1, 2, 3, 4)), int(raw.sum())]
        out = [{"level": 0, "shard": level, "columns": None, "counts": None, "stats": row}]
        if level > 1:
            arrays |= _small(count)
            follow = [count, *((count == k if k < 3 else count >= 3).astype(np.int64) for k in (1, 2, 3))]
            _, (context,), sums = _sum(columns[:1], follow)
            out += _packed(-level, grid.row(context), [context], sums)
            lower, low_columns, low_counts = _sum(columns[1:], [np.ones(len(key), np.int64), raw])
            out += _packed(level - 1, grid.of(lower), low_columns, low_counts)
        else:
            arrays |= {"follows": count, "raw": raw}
        write_arrays(f"{folder}/{level}/{shard:08d}.arrays", arrays)
        return pa.Table.from_pylist(out, _PACKED_ARROW)

    return run


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few sums that all of them share. Small enough to send to every task."""

    folder: str
    order: int
    grid: Grid
    tokens: int
    distinct: int
    discounts: dict[int, tuple[float, float, float, float]]
    follows: int
    backoff: float


def _discounts(n: list[int]) -> tuple[float, float, float, float]:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, 3 and more, from the counts of counts; fixed ones where those are missing."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3 and n4):
        return (0.0, 0.5, 0.75, 0.9)
    y = n1 / (n1 + 2 * n2)
    return (0.0, *(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))))


def train(texts: DataFrame, order: int = 2, column: str = "text") -> Model:
    """Count the ``order``-gram model of one text column. A null text counts as empty: it has one token, the end."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    texts = texts.select(F.col(column).cast("string").alias("text"))
    grid = _grid(input_bytes(texts, "text"))
    folder = shared_dir(texts.sparkSession, "lm")
    rows = texts.mapInArrow(_count(order, grid), _PACKED)
    for _ in range(order):
        # stats of one level may come from every shard: dealt by a number of their own
        rows = rows.groupBy("level", "shard", F.when(F.col("level") == 0, F.xxhash64("stats") % 64)).applyInArrow(_reduce(order, grid, folder), _PACKED)
    sums = rows.groupBy("level", "shard").agg(*(F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(7))).where("level = 0").collect()
    total = {k: [0] * 7 for k in range(1, order + 1)} | {r["shard"]: [r[f"s{k}"] for k in range(7)] for r in sums}
    discounts = {k: _discounts(total[k][2:6]) for k in total}
    distinct, follows = total[1][0], total[1][1]
    d, ones, twos = discounts[1], total[1][2], total[1][3]
    held = d[1] * ones + d[2] * twos + d[3] * (distinct - ones - twos)
    return Model(folder, order, grid, total[1][6], distinct, discounts, follows, held / follows if follows else 1.0)


def _find(model: Model, level: int, by: str, wanted: np.ndarray, fields: list[str]) -> list[np.ndarray]:
    """The fields of the wanted keys or contexts, 0 where one is unknown."""
    keys, back = np.unique(wanted, return_inverse=True)
    found = [np.zeros(len(keys), np.int64) for _ in fields]
    shard = model.grid.of(keys) if by == "key" else model.grid.row(keys)
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], np.diff(shard[order]) != 0))) if len(keys) else np.zeros(0, np.int64)
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)], strict=True):
        place = order[a:b]
        arrays = map_arrays(f"{model.folder}/{'' if by == 'key' else 'c'}{level}/{shard[place[0]]:08d}.arrays")
        if arrays is None:
            continue
        have, asked = arrays[by], keys[place]
        at = np.minimum(np.searchsorted(have, asked), len(have) - 1)
        hit = np.flatnonzero(have[at] == asked)
        at = at[hit]
        for out, field in zip(found, fields, strict=True):
            got = arrays[field][at].astype(np.int64)
            if field == "count" and len(arrays["big_at"]) and (large := np.flatnonzero(got == 255)).size:
                got[large] = arrays["big"][np.searchsorted(arrays["big_at"], at[large])]
            out[place[hit]] = got
    return [x[back] for x in found]


def _probability(model: Model, contexts: list[np.ndarray], token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(interpolated probability, count in the training texts) of each token."""
    raw, follows = _find(model, 1, "key", token, ["raw", "follows"])
    d = np.array(model.discounts[1])
    p = np.full(len(token), model.backoff / (model.distinct + 1))
    if model.follows:
        p += (follows - d[np.minimum(follows, 3)]) / model.follows
    for level in range(2, model.order + 1):
        d = np.array(model.discounts[level])
        context = contexts[level - 2]
        total, n1, n2, n3 = _find(model, level, "context", context, ["total", "n1", "n2", "n3"])
        (count,) = _find(model, level, "key", _join(context, token), ["count"])
        seen = np.maximum(total, 1)
        mixed = (count - d[np.minimum(count, 3)]) / seen + (d[1] * n1 + d[2] * n2 + d[3] * n3) / seen * p
        p = np.where(total > 0, mixed, p)
    return p, raw


def _score(model: Model, texts: Texts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(texts.text(batch))
            for a, b in slices(off, SCORE_BYTES):
                contexts, token, begin = _tokens(raw[off[a] : off[b]], off[a : b + 1] - off[a], model.order)
                row = np.repeat(np.arange(b - a), np.diff(begin))
                known, base, score = np.zeros(b - a, np.int64), np.zeros(b - a), np.zeros(b - a)
                for k in range(0, len(token), BLOCK_TOKENS):
                    part = slice(k, k + BLOCK_TOKENS)
                    p, count = _probability(model, [c[part] for c in contexts], token[part])
                    add = lambda x, part=part: np.bincount(row[part], x, b - a)  # noqa: B023, E731
                    known += add(count > 0).astype(np.int64)
                    base += add(np.log10((count + 1) / (model.tokens + model.distinct + 1)))
                    score += add(np.log10(p))
                yield batch_of([*texts.kept(batch, a, b), pa.array(np.diff(begin)), pa.array(known), pa.array(np.full(b - a, model.tokens, np.int64)), pa.array(base), pa.array(score)])

    return run


_SCORED = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, column: str = "text") -> DataFrame:
    """Score one text column; keeps the ``keep`` columns and adds n_tokens, n_known, train_tokens, base_score, score, perplexity,
    whose names the kept ones must not have.

    ``score`` is the model's log10 probability of the text and its end; ``base_score`` that of add-one single-token counts.
    """
    texts = Texts(docs, ["doc_id"] if keep is None else keep, column)
    rows = texts.rows.mapInArrow(_score(model, texts), texts.schema(_SCORED))
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return texts.restored(rows, *(x.split()[0] for x in _SCORED.split(", ")), perplexity.alias("perplexity"))


def held_out(doc_id: Column | str, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves ``part``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % parts == part, F.lit(False))


def score_held_out(docs: DataFrame, order: int = 2) -> DataFrame:
    """Learn from the documents that are not held out (crc32 mod 7 is not 2), then score all of them.

    Null and empty texts have one token, their end. Rows with repeated or null ids are scored each for itself, and all null
    ids are learned from. With no training document every token has base probability and probability 1. Other columns stay out.
    """
    docs = docs.select("doc_id", "text").withColumn("held_out", held_out("doc_id", 7, 2))
    return score(docs, train(docs.where(~F.col("held_out")), order), ["doc_id", "held_out"])
