"""Best-fit-decreasing packing of token ids into rows of one length, with binary id matrices.

Tasks encode their documents and pack blocks of about ``BLOCK_TOKENS`` tokens, so memory is bounded and nothing is shuffled.
A document longer than a row is split into full rows and a rest, with its offset kept, and every document has a number in its
block: the segments of one (block, number), joined by offset, give a document's ids back, whatever its doc_id. Within a block, segments go in order of falling length to the row with the least room that still fits,
which a segment tree over the room left finds in steps of the logarithm of the row length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices, utf8
from .sentencepieces import DEFAULT_MODEL, _gather, _vocabulary, encode_rows, read_model

BLOCK_TOKENS = 3_000_000
_SLICE = 6 << 20


class Room:
    """Which rows have how much room left: a segment tree of counts over 0 to ``most``."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        k = room + self.size
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int]:
        """(room, row) of a row with the least room of ``need`` or more, which goes; (-1, -1) if there is none."""
        count, k = self.count, need + self.size
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):
                k >>= 1
            if k <= 1:
                return -1, -1
            k += 1
            while k < self.size:
                k = 2 * k if count[2 * k] else 2 * k + 1
        room = k - self.size
        while k:
            count[k] -= 1
            k >>= 1
        return room, self.rows[room].pop()


def best_fit(lengths: np.ndarray, row: int) -> tuple[np.ndarray, int]:
    """The row of each segment, by best fit in order of falling length (then of place), and the number of rows."""
    order = np.argsort(-lengths, kind="stable")
    out = np.empty(len(lengths), np.int64)
    room, rows = Room(row), 0
    for k, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        left, at = room.take(n) if n < row else (-1, -1)
        if at < 0:
            left, at, rows = row, rows, rows + 1
        out[k] = at
        if left > n:
            room.add(left - n, at)
    return out, rows


_OUT = "block long, row int, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_numbers array<int>, doc_offsets array<long>"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _pack(block: int, ids: np.ndarray, bounds: np.ndarray, docs: pa.Array, length: int, pad: int) -> pa.RecordBatch:
    size = np.diff(bounds)
    parts = -(-size // length)
    doc = np.repeat(np.arange(len(size)), parts)
    offset = (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)) * length
    lengths = np.minimum(size[doc] - offset, length)
    row, rows = best_fit(lengths, length)
    order = np.argsort(row, kind="stable")
    row, lengths, doc, offset = row[order], lengths[order], doc[order], offset[order]
    first = np.searchsorted(row, np.arange(rows + 1))
    ends = np.cumsum(lengths)
    base = np.concatenate(([0], ends))[first]  # tokens before each row
    where = np.repeat(row * length + (ends - lengths) - base[:-1][row], lengths) + np.arange(int(lengths.sum())) - np.repeat(ends - lengths, lengths)
    matrix = np.full(rows * length, pad, np.uint16)
    matrix[where] = ids[_gather(bounds[:-1][doc] + offset, lengths)]
    starts = ends - lengths - base[:-1][row]
    cumulative = np.insert(starts + lengths, first[:-1], 0)
    lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
    raw = matrix.astype("<u2").tobytes()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(rows, block)),
            pa.array(np.arange(rows, dtype=np.int32)),
            pa.array(np.diff(base).astype(np.int32)),
            pa.array([raw[2 * length * k : 2 * length * (k + 1)] for k in range(rows)], pa.binary()),
            lists(first + np.arange(rows + 1), pa.array(cumulative.astype(np.int32))),
            lists(first, pa.array(starts.astype(np.int32))),
            lists(first, docs.take(pa.array(doc))),
            lists(first, pa.array(doc.astype(np.int32))),
            lists(first, pa.array(offset.astype(np.int64))),
        ],
        _NAMES,
    )


def pack(docs: DataFrame, length: int = 2048, end: int = 2, pad: int = 0, model: str = DEFAULT_MODEL) -> DataFrame:
    """A row per packed row: block and row number, n_tokens, input_ids (``length`` little-endian uint16, padded), cu_seqlens
    (from 0), position_resets (where positions begin again), and of each segment the doc_id, the document's number in the block
    and the offset in the document.

    Every document ends with the ``end`` id, so null and empty texts are one token; null and repeated ids are kept, and rows
    that share an id stay apart by their numbers. The block number has the partition's number in its high bits. Further columns
    of ``docs``, whatever their names, stay out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = _vocabulary(shared.value)
        if voc.size > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        block = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([h[0] for h in held])
            bounds = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(h[1]) for h in held]))))
            return _pack(block, ids, bounds, pa.concat_arrays([h[2] for h in held]), length, pad)

        for batch in batches:
            raw, off = utf8(batch.column(1))
            for a, b in slices(off, _SLICE):
                ids, bounds = encode_rows(voc, raw[off[a] : off[b]], off[a : b + 1] - off[a], np.zeros(b - a, np.int64), 0.0, 0)
                ids = np.insert(ids, bounds[1:], end)
                held.append((ids.astype(np.int32), bounds + np.arange(b - a + 1), batch.column(0).slice(a, b - a)))
                total += len(ids)
                if total >= BLOCK_TOKENS:
                    yield flush()
                    held, total, block = [], 0, block + 1
        if held:
            yield flush()

    return rows.mapInArrow(run, _OUT)


def positions(cu_seqlens: np.ndarray, length: int) -> np.ndarray:
    """Position ids of a packed row: from 0 in each segment, 0 in the padding."""
    out = np.zeros(length, np.int64)
    for a, b in zip(cu_seqlens[:-1], cu_seqlens[1:], strict=True):
        out[a:b] = np.arange(b - a)
    return out
