"""SentencePiece merge-type encoding with seeded merge-dropout, and decoding; whole batches at a time.

A text becomes chunks, each a run of spaces with the word after it (no piece of such a model spans two). The distinct chunks
of a batch are segmented together: every round takes each chunk's best-scored adjacent pair, leftmost first, and merges it,
which is the order in which an agenda gives merges out. A candidate merge is skipped for good if the keyed hash of (seed, row,
place of the chunk in its text, chunk, its first, middle and last character) falls under the dropout rate, so every occurrence
of a word has draws of its own. An occurrence none of whose merges without dropout is skipped has that same segmentation, as
dropout only takes candidates away; the others are segmented one by one. Characters without a piece, and the model's own space
mark, become byte pieces: decoding is lossless.

Chunks of more than ``LONG`` characters use a heap, so a long run without spaces stays n log n. A text longer than a slice is
encoded in pieces that end where a chunk ends, which changes nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ._rows import Texts, batch_of, fresh, named
from ._text import U, hash_ranges, mix, slices, utf8

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONG, SLICE_BYTES = 64, 1 << 20
BLOCK_CHARS = 1 << 17
MAX_MODEL_BYTES = 16 << 20
_NEVER = np.int64(1) << 40


class Vocabulary:
    """Arrays of a merge-type model: piece of each character, ranked merges of pairs, bytes of each piece."""

    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = self.size = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        plain = {p: i for i, p in enumerate(pieces) if not (special[i] or sp.is_byte(i))}
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if any("▁" in p.lstrip("▁") for p in plain) or (self.byte_id == sp.unk_id()).any():
            raise ValueError("the model must have byte pieces and no piece over two words")
        self.char = np.full(0x110000, n, np.int32)
        for p, i in plain.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[0x20], self.char[0x2581] = self.char[0x2581], n
        rank = np.unique([-sp.get_score(i) for i in range(n)], return_inverse=True)[1]
        merges = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                a, b = plain.get(p[:k]), plain.get(p[k:])
                if a is not None and b is not None:
                    merges[a * (n + 1) + b] = i
        self.pair = np.array(sorted(merges), np.int64)
        self.merged = np.array([merges[k] for k in self.pair.tolist()], np.int32)
        self.rank = rank[self.merged].astype(np.int64)
        raw = [b"" if special[i] else (bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()) for i, p in enumerate(pieces)]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.bytes_at = np.concatenate(([0], np.cumsum([len(x) for x in raw])))

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; a rank of ``_NEVER`` if it isn't a piece."""
        key = left.astype(np.int64) * (self.size + 1) + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[at] == key
        return np.where(hit, self.rank[at], _NEVER), self.merged[at]


@cache
def _vocabulary(proto: bytes) -> Vocabulary:
    return Vocabulary(proto)


def _skipped(seed: np.ndarray, first: np.ndarray, middle: np.ndarray, last: np.ndarray, limit: int) -> np.ndarray:
    """True for the candidate merges that the keyed hash drops."""
    return _falls(seed + _place(first, middle, last), limit)


def _place(first: np.ndarray, middle: np.ndarray, last: np.ndarray) -> np.ndarray:
    return first.astype(U) * U(0x9E3779B97F4A7C15) + middle.astype(U) * U(0xC2B2AE3D27D4EB4F) + last.astype(U) * U(0x165667B19E3779F9)


def _falls(key: np.ndarray, limit: int) -> np.ndarray:
    return (mix(key) >> U(33)) < U(limit)


def _code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and where each begins."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    size = np.diff(np.append(at, len(raw)))
    code = np.where(size == 1, raw[at], raw[at] & (0xFF >> (size + 1))).astype(np.int64)
    for k in range(1, 4):
        some = np.flatnonzero(size > k)
        code[some] = code[some] << 6 | (raw[at[some] + k] & 0x3F)
    return code, at


def _merge_long(voc: Vocabulary, symbols: list[int], seed: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """(piece, first character) of one long chunk, by an agenda."""
    n = len(symbols)
    ends, left = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    agenda: list[tuple[int, int, int, int, int]] = []

    def add(starts: list[int]) -> None:
        pairs = [(a, ends[a]) for a in starts if a >= 0 and ends[a] < n]
        if not pairs:
            return
        a, b = (np.array(x) for x in zip(*pairs, strict=True))
        sym = np.array(symbols)
        rank, result = voc.look(sym[a], sym[b]) if len(pairs) > 8 else voc.look(np.array([symbols[x] for x in a]), np.array([symbols[x] for x in b]))
        last = np.array([ends[x] for x in b.tolist()])
        ok = rank < _NEVER
        if limit:
            ok &= ~_skipped(np.full(len(a), seed), a, b, last, limit)
        for k in np.flatnonzero(ok).tolist():
            heapq.heappush(agenda, (int(rank[k]), int(a[k]), int(b[k]), int(last[k]), int(result[k])))

    add_all = list(range(n))
    add(add_all)
    while agenda:
        _, a, b, last, result = heapq.heappop(agenda)
        if not (alive[a] and ends[a] == b and b < n and alive[b] and ends[b] == last):
            continue
        symbols[a], ends[a], alive[b] = result, last, False
        if last < n:
            left[last] = a
        _few(voc, symbols, ends, left[a], a, n, seed, limit, agenda)
    return [(symbols[k], k) for k in range(n) if alive[k]]


def _few(voc: Vocabulary, symbols: list[int], ends: list[int], before: int, at: int, n: int, seed: np.ndarray, limit: int, agenda: list) -> None:
    """Add the candidates on both sides of a merged symbol."""
    for a in (before, at):
        if a < 0 or ends[a] >= n:
            continue
        b = ends[a]
        rank, result = voc.look(np.array([symbols[a]]), np.array([symbols[b]]))
        if rank[0] < _NEVER and not (limit and _skipped(np.array([seed]), np.array([a]), np.array([b]), np.array([ends[b]]), limit)[0]):
            heapq.heappush(agenda, (int(rank[0]), a, b, ends[b], int(result[0])))


def _segment(voc: Vocabulary, symbol: np.ndarray, begin: np.ndarray, seed: np.ndarray, limit: int, taken: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the characters of chunks: (pieces, index of each piece's first character, where each chunk's pieces begin).

    ``taken`` gets (chunk, place) of the merges of each round, without those of long chunks.
    """
    count = np.diff(begin)
    done_sym, done_at, done_chunk = [], [], []
    for c in np.flatnonzero(count > LONG).tolist():
        out = _merge_long(voc, symbol[begin[c] : begin[c + 1]].tolist(), seed[c], limit)
        done_sym.append(np.array([x[0] for x in out], np.int32))
        done_at.append(np.array([x[1] for x in out]) + begin[c])
        done_chunk.append(np.full(len(out), c))
    use = np.flatnonzero(count <= LONG)
    chunk = np.repeat(use, count[use])
    at = np.arange(len(chunk)) + np.repeat(begin[:-1][use] - np.concatenate(([0], np.cumsum(count[use])))[:-1], count[use])
    sym = symbol[at]
    first = at - begin[chunk]
    last = first + 1

    def candidates(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the pairs that begin at positions k."""
        inside = np.zeros(len(k), bool)
        ok = k + 1 < len(sym)
        inside[ok] = chunk[k[ok] + 1] == chunk[k[ok]]
        rank, result = np.full(len(k), _NEVER), np.zeros(len(k), np.int32)
        p = k[inside]
        if len(p):
            r, result[inside] = voc.look(sym[p], sym[p + 1])
            if limit:
                r = np.where(_skipped(seed[chunk[p]], first[p], first[p + 1], last[p + 1], limit), _NEVER, r)
            rank[inside] = r
        return rank, result

    rank, result = candidates(np.arange(len(sym)))
    while len(sym):
        edge = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
        best = np.minimum.reduceat(rank * 128 + first, edge)
        over = best >= _NEVER * 128
        size = np.diff(np.append(edge, len(sym)))
        if over.any():
            stay = np.repeat(~over, size)
            done_sym.append(sym[~stay])
            done_at.append(at[~stay])
            done_chunk.append(chunk[~stay])
            sym, at, chunk, first, last, rank, result = (x[stay] for x in (sym, at, chunk, first, last, rank, result))
            best, size = best[~over], size[~over]
            if not len(sym):
                break
            edge = np.concatenate(([0], np.cumsum(size)[:-1]))
        p = np.flatnonzero(rank * 128 + first == np.repeat(best, size))
        if taken is not None:
            taken.append((chunk[p], _place(first[p], first[p + 1], last[p + 1])))
        sym[p], last[p] = result[p], last[p + 1]
        keep = np.ones(len(sym), bool)
        keep[p + 1] = False
        moved = p - np.arange(len(p))
        sym, at, chunk, first, last, rank, result = (x[keep] for x in (sym, at, chunk, first, last, rank, result))
        touched = np.zeros(len(sym), bool)
        touched[moved] = touched[np.maximum(moved - 1, 0)] = True
        k = np.flatnonzero(touched)
        rank[k], result[k] = candidates(k)
    if not done_sym:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(len(count) + 1, np.int64)
    sym, at, chunk = (np.concatenate(x) for x in (done_sym, done_at, done_chunk))
    order = np.argsort(at)
    return sym[order], at[order], np.searchsorted(chunk[order], np.arange(len(count) + 1))


def _gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the ranges one after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - np.concatenate(([0], np.cumsum(size)))[:-1], size)


def _changed(count: np.ndarray, back: np.ndarray, seeds: np.ndarray, taken: list, limit: int) -> np.ndarray:
    """The occurrences that lose one of their chunk's merges; those of long chunks all count."""
    out = count[back] > LONG
    if not taken:
        return np.flatnonzero(out)
    chunk, place = (np.concatenate(x) for x in zip(*taken, strict=True))
    place = place[np.argsort(chunk, kind="stable")]
    n = np.bincount(chunk, minlength=len(count))
    begin = np.cumsum(n) - n
    for a in range(0, len(back), BLOCK_CHARS):
        c = back[a : a + BLOCK_CHARS]
        lost = _falls(np.repeat(seeds[a : a + BLOCK_CHARS], n[c]) + place[_gather(begin[c], n[c])], limit)
        out[a + np.repeat(np.arange(len(c)), n[c])[lost]] = True
    return np.flatnonzero(out)


def encode_rows(voc: Vocabulary, raw: np.ndarray, off: np.ndarray, key: np.ndarray, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all rows one after the other, and where each row's begin; ``key`` is an integer for each row's draws."""
    if len(off) == 2 and len(raw) > SLICE_BYTES:
        parts, a = [], 0
        while a < len(raw):
            b = _chunk_end(raw, a + SLICE_BYTES)
            parts.append(_encode(voc, raw[a:b], np.array([0, b - a]), key, dropout, seed, a)[0])
            a = b
        ids = np.concatenate(parts)
        return ids, np.array([0, len(ids)])
    return _encode(voc, raw, off, key, dropout, seed, 0)


def _chunk_end(raw: np.ndarray, at: int) -> int:
    """The first place from ``at`` on where a run of spaces begins, or the end."""
    while at < len(raw):
        space = raw[at - 1 : at + SLICE_BYTES] == 0x20
        opens = np.flatnonzero(space[1:] & ~space[:-1])
        if len(opens):
            return at + int(opens[0])
        at += SLICE_BYTES
    return len(raw)


def _encode(voc: Vocabulary, raw: np.ndarray, off: np.ndarray, key: np.ndarray, dropout: float, seed: int, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that fit in a slice, or a piece of one row with ``before`` bytes of it to the left."""
    some = (np.diff(off) > 0) & (before == 0)
    lead = off[:-1][some]
    raw = np.insert(raw, lead, 0x20)  # the space that the model puts before a text
    off = off + np.concatenate(([0], np.cumsum(some)))
    before += int(before > 0)
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    space = raw == 0x20
    opens = space.copy()
    opens[1:] &= ~space[:-1]
    opens[off[:-1][np.diff(off) > 0]] = True
    start = np.flatnonzero(opens)
    end = np.append(start[1:], len(raw))
    row = np.searchsorted(off, start, "right") - 1
    value = hash_ranges(raw, start, end, exact=True)
    _, which, back = np.unique(value, return_index=True, return_inverse=True)
    size = end[which] - start[which]
    text = raw[_gather(start[which], size)]
    code, at = _code_points(text)
    begin = np.searchsorted(at, np.concatenate(([0], np.cumsum(size))))
    symbol, count = voc.char[code], np.diff(begin)
    limit = int(dropout * (1 << 31))
    taken: list = []
    sym, first, parts = _segment(voc, symbol, begin, np.zeros(len(which), U), 0, taken if limit else None)
    if limit:
        draws = mix(key.astype(np.int64).view(U) ^ mix(np.array([seed], np.int64).view(U))[0])
        seeds = mix(value + mix(draws[row] + (start - off[row] + before).astype(U) * U(0x9E3779B97F4A7C15)))
        other = _changed(count, back, seeds, taken, limit)
        ends = np.cumsum(count[back[other]])
        syms, firsts, sizes, a = [sym], [first], [np.diff(parts)], 0
        while a < len(other):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK_CHARS, "right")))
            c = back[other[a:b]]
            chars = _gather(begin[c], count[c])
            s, f, p = _segment(voc, symbol[chars], np.concatenate(([0], np.cumsum(count[c]))), seeds[other[a:b]], limit)
            syms.append(s)
            firsts.append(chars[f])
            sizes.append(np.diff(p))
            a = b
        back[other] = len(which) + np.arange(len(other))
        sym, first = np.concatenate(syms), np.concatenate(firsts)
        parts = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
    width = np.diff(np.append(at, len(text)))
    unknown = sym == voc.size
    spread = np.where(unknown, width[first], 1)
    ids = np.repeat(sym, spread)
    if unknown.any():
        ids[np.repeat(unknown, spread)] = voc.byte_id[text[_gather(at[first[unknown]], spread[unknown])]]
    parts = np.concatenate(([0], np.cumsum(spread)))[parts]
    size = np.diff(parts)[back]
    bounds = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(start, off)]
    return ids[_gather(parts[:-1][back], size)], bounds


def decode_rows(voc: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and their offsets; the space that the model puts before a text is taken off."""
    size = np.diff(voc.bytes_at)[ids]
    raw = voc.bytes[_gather(voc.bytes_at[:-1][ids], size)]
    off = np.concatenate(([0], np.cumsum(size)))[bounds]
    drop = off[:-1][np.diff(off) > 0]
    drop = drop[raw[drop] == 0x20]
    keep = np.ones(len(raw), bool)
    keep[drop] = False
    return raw[keep], np.concatenate(([0], np.cumsum(keep)))[off]


def read_model(path: str = DEFAULT_MODEL) -> bytes:
    """The model file's bytes, at most ``MAX_MODEL_BYTES``; the driver sends them to the workers."""
    with open(path, "rb") as f:
        proto = f.read(MAX_MODEL_BYTES + 1)
    if len(proto) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes")
    return proto


def encode(docs: DataFrame, keep: list[str], key: str = "doc_id", column: str = "text", dropout: float = 0.0, seed: int = 0, model: str = DEFAULT_MODEL, check: bool = False, names: tuple[str, str] | None = None) -> DataFrame:
    """The ``keep`` columns and the ids (array of int); with ``check`` also whether decoding gave back the text's bytes. ``names``
    are ``__ids`` and ``__lossless``, with underscores added where a kept column has that name.

    The segmentation is a function of the text, the seed and the row's ``key`` alone; with a null key, of text and seed. A null
    text has null ids, an empty one none. Rows are independent, so repeats are kept; further columns pass through if kept.
    """
    listed, right = names or fresh(keep, "ids", "lossless")
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model))
    (draw,) = fresh([*docs.columns, *keep], "key")
    docs = docs.withColumn(draw, F.xxhash64(named(key)[0].cast("string"), named(column)[0].cast("string"), F.lit(seed)))
    texts = Texts(docs, [*keep, draw], column)
    drawn = texts.keep - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = _vocabulary(shared.value)
        for batch in batches:
            text = texts.text(batch)
            raw, off = utf8(text)
            for a, b in slices(off, SLICE_BYTES):
                part, at = raw[off[a] : off[b]], off[a : b + 1] - off[a]
                ids, bounds = encode_rows(voc, part, at, batch.column(drawn).slice(a, b - a).to_numpy(), dropout, seed)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()), mask=text.slice(a, b - a).is_null())
                yield batch_of([*texts.kept(batch, a, b), lists, pa.array(_same(voc, ids, bounds, part, at) if check else [None] * (b - a), pa.bool_())])

    rows = texts.rows.mapInArrow(run, texts.schema("ids array<int>, lossless boolean"))
    found = texts.restored(rows, F.col("ids").alias(listed), *[F.col("lossless").alias(right)] * check)
    return found.drop(draw)


def _same(voc: Vocabulary, ids: np.ndarray, bounds: np.ndarray, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which rows the ids give back byte for byte."""
    back, ends = decode_rows(voc, ids, bounds)
    same = np.diff(ends) == np.diff(off)
    if len(back) == len(raw):
        wrong = np.flatnonzero(back != raw)
        same[np.unique(np.searchsorted(off, wrong, "right") - 1)] = False
        return same
    return np.array([x == y and bytes(back[ends[r] : ends[r + 1]]) == bytes(raw[off[r] : off[r + 1]]) for r, (x, y) in enumerate(zip(np.diff(ends), np.diff(off), strict=True))])


def decode(rows: DataFrame, keep: list[str], column: str = "ids", model: str = DEFAULT_MODEL, name: str | None = None) -> DataFrame:
    """The ``keep`` columns and the text, as ``name`` (``__text``, with underscores added where a kept column has that name).

    Null ids have a null text, bytes that are no UTF-8 become replacement characters. Ids must be pieces of the model; a null id
    in a list counts as none.
    """
    (name,) = [name] if name else fresh(keep, "text")
    shared = rows.sparkSession.sparkContext.broadcast(read_model(model))
    kept = rows.select(*(c.alias(f"c{k}") for k, c in enumerate(named(*keep))), F.array_compact(named(column)[0]).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = _vocabulary(shared.value)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            size = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            raw, off = decode_rows(voc, ids, np.concatenate(([0], np.cumsum(size))).astype(np.int64))
            data, there = raw.tobytes(), lists.is_valid().to_pylist()
            texts = [data[off[r] : off[r + 1]].decode(errors="replace") if ok else None for r, ok in enumerate(there)]
            yield batch_of([*batch.columns[:-1], pa.array(texts, pa.string())])

    out = kept.mapInArrow(run, StructType([*kept.schema.fields[:-1], StructField("text", StringType())]))
    return out.select(*(F.col(f"c{k}").alias(n) for k, n in enumerate(keep)), F.col("text").alias(name))


def segment_corpus(docs: DataFrame, dropout: float = 0.1, seed: int = 17, model: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, lossless (decoding gives the text back; true for a null text); a row for each row of ``docs``."""
    rows = encode(docs.select("doc_id", "text"), ["doc_id"], dropout=dropout, seed=seed, model=model, check=True, names=("ids", "lossless"))
    return rows.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "lossless")
