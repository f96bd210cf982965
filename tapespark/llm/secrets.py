"""Secret scan: rules find the plain cases, a linear-chain conditional random field tags the tokens of the rest.

Tokens are the words between white space; each is secret-begin, secret-inside or outside. Features are small integers made
by array operations on the bytes of a batch: the token's shape (length, character classes, changes of class, share of digits,
hexadecimal), its neighbours (what the previous token ends with, key words in the two before it, the length of the next), and
the file (share of tokens with code characters). The field is trained on windows of tokens that the rules label, by gradient
steps on the exact log-likelihood. The windows are a bounded sample, the ``TRAIN_WINDOWS`` with and ``TRAIN_WINDOWS`` without a
secret that have the smallest hashes, of the windows that tasks offer: around the first secret of every row, and around about
``OFFERED`` tokens with a digit of every slice of texts. Decoding is Viterbi over the texts of a batch side by side; a text in
which no token can be worth leaving "outside" is skipped, which changes no result. The tokens of a text of more than ``LONG`` bytes
are made in pieces of about that size, cut at white space, with their neighbours beyond the cut and the whole text's share; only
those that can be part of a stretch worth leaving "outside" are decoded, so that a long text gives what it gives in one piece.
The rules always see the whole text; training windows of a long text come from its pieces.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rows import Texts, batch_of, fresh, named
from ._store import materialize
from ._text import cut_long, slices, utf8, words

KINDS = ("assign", "access", "hex", "crf")
TRAIN_WINDOWS, WINDOW, STEPS, OFFERED = 1000, 32, 120, 64
_SLICE, LONG = 1 << 20, 4 << 20
# The rules.
_KEY_WORDS = "password|passwd|secret|token|api_?key"
ASSIGN = re.compile(rf"(?i:{_KEY_WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
#: Where a key word may begin; of no width, so that one over two rows hides none.
_ANY_KEY = re.compile(rb"(?=[PpSsTtAa])(?i:(?=passw(?:or)?d|secret|token|api_?key))")

_LOWER, _UPPER, _DIGIT, _HEX, _OTHER, _CODE = range(6)
_CLASS = np.zeros((6, 256), np.uint8)
_CLASS[_LOWER, 97:123] = 1
_CLASS[_UPPER, 65:91] = 1
_CLASS[_DIGIT, 48:58] = 1
_CLASS[_HEX, 48:58] = _CLASS[_HEX, 97:103] = 1
_CLASS[_OTHER] = 1 - _CLASS[_LOWER] - _CLASS[_UPPER] - _CLASS[_DIGIT]
_CLASS[_CODE, [ord(c) for c in "=:{}[]();<>\"'_/+"]] = 1
_SORT = np.argmax(_CLASS[[_LOWER, _UPPER, _DIGIT, _OTHER]], axis=0).astype(np.int8)
_LAST = np.zeros(256, np.uint8)
for _k, _c in enumerate("=:\"'", 1):
    _LAST[ord(_c)] = _k
#: Number of values of each feature.
SIZES = (10, 16, 3, 6, 5, 5, 2, 2, 2, 10, 4, 2)
_OFFSETS = np.concatenate(([0], np.cumsum(SIZES)))
FEATURES = int(_OFFSETS[-1])


def rules(text: str) -> list[tuple[str, int, int, int, int]]:
    """Base spans by start, then kind: (kind, start, end, secret's start, secret's end)."""
    found = [(m.start(), 0, m.end(), *m.span(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    found += [(m.start(), 1, m.end(), *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), *m.span()) for m in HEX.finditer(text)]
    return [(KINDS[k], a, b, c, d) for a, k, b, c, d in sorted(found)]


def _suspects(raw: np.ndarray, off: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Rows in which a rule may match."""
    is_hex = np.concatenate(([0], _CLASS[_HEX][raw], [0])).astype(np.int8)
    edge = np.flatnonzero(np.diff(is_hex))
    a, b = edge[::2], edge[1::2]
    long = np.flatnonzero(b - a >= 24)  # such a run may go over several rows
    data = raw.tobytes()
    at, akia = data.find(b"AKIA"), []
    while at >= 0:
        akia.append(at)
        at = data.find(b"AKIA", at + 1)
    row = lambda x: np.searchsorted(off, x, "right") - 1
    rows = [np.arange(p, q + 1) for p, q in zip(row(a[long]), row(b[long] - 1), strict=True)]
    return np.unique(np.concatenate([row(keys), row(np.array(akia, np.int64)), *rows]).astype(np.int64))


class _Slice:
    """The tokens of some rows, with their features."""

    def __init__(self, raw: np.ndarray, off: np.ndarray) -> None:
        self.raw, self.off = raw, off
        self.start, self.end, _, self.first = words(raw, off)
        self.keys = np.array([m.start() for m in _ANY_KEY.finditer(raw.tobytes())], np.int64)

    def features(self, share: float | None = None) -> list[np.ndarray]:
        """A column of small integers for each feature; ``_OFFSETS`` tells them apart. ``share``: that of the file, if it is known."""
        start, end, raw, n = self.start, self.end, self.raw, len(self.start)
        length = end - start
        sums = np.zeros(len(raw) + 1, np.int32)
        held = []
        for table in _CLASS:
            np.cumsum(table[raw], out=sums[1:], dtype=np.int32)
            held.append(sums[end] - sums[start])
        lower, upper, digit, hexa, other, code = held
        change = np.zeros(len(raw) + 1, np.int32)
        kind = _SORT[raw]
        np.cumsum(kind[1:] != kind[:-1], out=change[2:], dtype=np.int32)
        changes = change[end] - change[np.minimum(start + 1, len(raw))]
        size = np.searchsorted([2, 4, 6, 8, 12, 16, 20, 24, 40], length, "right")
        row = np.repeat(np.arange(len(self.off) - 1), np.diff(self.first))
        key = np.zeros(n, np.int64)
        if len(self.keys) and n:
            key[np.minimum(np.searchsorted(start, self.keys, "right") - 1, n - 1)] = 1
        before = np.zeros(n, bool)
        before[1:] = row[1:] == row[:-1]
        second = np.zeros(n, bool)
        second[2:] = row[2:] == row[:-2]
        ends = _LAST[raw[np.maximum(end - 1, 0)]] if n else np.zeros(0, np.uint8)
        shift = lambda x, k: np.concatenate((np.zeros(min(k, n), x.dtype), x[: n - k] if n > k else x[:0]))
        following = np.zeros(n, np.int64)
        following[:-1] = np.where(before[1:], size[1:], 0)
        codes = np.add.reduceat(np.append((code > 0).astype(np.int64), 0), np.minimum(self.first[:-1], n)) if len(self.off) > 1 else np.zeros(0, np.int64)
        counts = np.diff(self.first)
        shares = np.where(counts > 0, codes, 0) / np.maximum(counts, 1) if share is None else np.full(len(counts), share)
        share = np.searchsorted([0.02, 0.1, 0.3], shares, "right")
        columns = (
            size,
            (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (other > 0),
            (hexa == length) * (1 + (length >= 16)),
            np.searchsorted([1, 2, 4, 8, 14], changes, "right"),
            np.searchsorted([0.01, 0.15, 0.4, 0.8], digit / np.maximum(length, 1), "right"),
            np.where(before, shift(ends, 1), 0),
            np.where(before, shift(key, 1), 0),
            np.where(second, shift(key, 2), 0),
            key,
            following,
            share[row],
            (digit > 0) & (lower + upper > 0) & (length >= 16),
        )
        return [c.astype(np.uint8) for c in columns]

    def points(self) -> np.ndarray:
        """Code points before each byte, counted over the slice."""
        return np.concatenate(([0], np.cumsum((self.raw & 0xC0) != 0x80)))


@dataclass(frozen=True)
class Model:
    """Weights by feature and tag, transitions by tag and next tag, start; tags: outside, begin, inside."""

    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray


NOTHING = Model(np.zeros((FEATURES, 3)), np.array([[0, -9.0, -99], [0, -9, -9], [0, -9, -9]]), np.array([0, -9.0, -99]))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of tokens for training: around each row's first secret, and around a token with a digit of the rows without."""
    for batch in batches:
        raw, off = utf8(batch.column(0))
        for a, b in slices(off, _SLICE):
            for part, _ in _pieces(_Slice(raw[off[a] : off[b]], off[a : b + 1] - off[a])):
                if rows := _offered(part):
                    yield batch_of([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())])


def _offered(part: _Slice) -> list[tuple[bool, bytes, bytes]]:
    """(holds a secret, features, tags) of the windows of a slice."""
    features, points = part.features(), part.points()
    token_start, token_end = points[part.start], points[part.end]
    marks = np.zeros(len(part.start), np.uint8)
    centres: dict[int, tuple[int, bool]] = {}
    for r in _suspects(part.raw, part.off, part.keys).tolist():
        base = points[part.off[r]]
        for _, _, _, c, d in rules(part.raw[part.off[r] : part.off[r + 1]].tobytes().decode(errors="replace")):
            lo, hi = np.searchsorted(token_end, base + c, "right"), np.searchsorted(token_start, base + d)
            if hi > lo and not marks[lo:hi].any():
                marks[lo:hi] = 2
                marks[lo] = 1
                centres.setdefault(r, (int(lo), True))
    digits = np.flatnonzero((features[4] > 0) & (marks == 0))
    for at in digits[:: max(1, len(digits) // OFFERED)].tolist():
        centres.setdefault(int(np.searchsorted(part.first, at, "right") - 1), (at, False))
    rows = []
    for r, (at, positive) in centres.items():
        lo = max(int(part.first[r]), at - WINDOW // 2)
        hi = min(int(part.first[r + 1]), lo + WINDOW)
        rows.append((positive, np.stack([x[lo:hi] for x in features], axis=1).tobytes(), marks[lo:hi].tobytes()))
    return rows


def train(docs: DataFrame, column: str = "text") -> Model:
    """Fit the field to the rules' labels on the sample: the windows with the smallest hashes. Without a labelled secret it tags nothing."""
    windows = docs.select(*(c.cast("string") for c in named(column))).mapInArrow(_windows, "positive boolean, features binary, marks binary")
    ranked = materialize(windows.withColumn("h", F.xxhash64("features", "marks")), "secret-windows")
    side = lambda p: ranked.where(F.col("positive") == p).orderBy("h", "features").limit(TRAIN_WINDOWS)
    rows = side(True).union(side(False)).collect()
    if not any(r["positive"] for r in rows):
        return NOTHING
    n = len(rows)
    x = np.full((n, WINDOW, len(SIZES)), FEATURES, np.int32)
    y = np.zeros((n, WINDOW), np.int64)
    there = np.zeros((n, WINDOW), bool)
    for k, r in enumerate(rows):
        marks = np.frombuffer(r["marks"], np.uint8)
        x[k, : len(marks)] = np.frombuffer(r["features"], np.uint8).reshape(len(marks), -1) + _OFFSETS[:-1]
        y[k, : len(marks)] = marks
        there[k, : len(marks)] = True
    return _fit(x, y, there)


def _fit(x: np.ndarray, y: np.ndarray, there: np.ndarray) -> Model:
    """Adam steps on the penalised log-likelihood; gradients by forward-backward over all windows at once."""
    n, width, _ = x.shape
    w, moves, start = np.zeros((FEATURES + 1, 3)), np.zeros((3, 3)), np.zeros(3)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, moves, start)]
    one = np.eye(3)[y] * there[..., None]
    pairs = (one[:, :-1, :, None] * one[:, 1:, None, :]).sum(axis=(0, 1))
    lse = lambda v, axis: (m := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis=axis))
    for step in range(1, STEPS + 1):
        emit = w[x].sum(axis=2)
        fore = np.empty((n, width, 3))
        back = np.zeros((n, width, 3))
        fore[:, 0] = start + emit[:, 0]
        for t in range(1, width):
            fore[:, t] = np.where(there[:, t, None], lse(fore[:, t - 1, :, None] + moves, 1) + emit[:, t], fore[:, t - 1])
        for t in range(width - 2, -1, -1):
            back[:, t] = np.where(there[:, t + 1, None], lse(moves + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2), 0)
        total = lse(fore[:, -1], 1)
        likely = np.exp(fore + back - total[:, None, None]) * there[..., None]
        joint = np.exp(fore[:, :-1, :, None] + moves + (emit[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]) * there[:, 1:, None, None]
        gw = np.zeros_like(w)
        for k in range(x.shape[2]):
            np.add.at(gw, x[:, :, k].ravel(), (one - likely).reshape(-1, 3))
        grads = (gw / n - 1e-4 * w, (pairs - joint.sum(axis=(0, 1))) / n - 1e-4 * moves, (one[:, 0] - likely[:, 0]).mean(axis=0) - 1e-4 * start)
        for p, g, (m, v) in zip((w, moves, start), grads, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w[FEATURES] = 0
    moves[0, 2] = start[2] = -99.0  # inside follows begin or inside only
    return Model(w[:FEATURES], moves, start)


def _gain(model: Model) -> float:
    """What a token can gain at most by its moves when it is not outside."""
    return max(0.0, 2 * (max(model.moves.max(), model.start.max()) - min(model.moves[0, 0], model.start[0])))


def viterbi(model: Model, emit: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best tags of each row's tokens; rows are decoded side by side, longest first."""
    tags = np.zeros(len(emit), np.uint8)
    counts = np.diff(first)
    worth = emit[:, 1:].max(axis=1) - emit[:, 0] + _gain(model) >= 0 if len(emit) else np.zeros(0, bool)
    hit = np.unique(np.searchsorted(first, np.flatnonzero(worth), "right") - 1)
    rows = hit[np.argsort(-counts[hit], kind="stable")]
    if not len(rows):
        return tags
    begin, counts = first[:-1][rows], counts[rows]
    active = np.searchsorted(-counts, -np.arange(int(counts[0])), "left")  # rows longer than t
    back = np.zeros((len(emit), 3), np.uint8)
    best = model.start + emit[begin]
    final = np.zeros((len(rows), 3))
    for t in range(1, int(counts[0])):
        m = int(active[t])
        final[m : len(best)] = best[m:]
        step = best[:m, :, None] + model.moves
        at = begin[:m] + t
        back[at] = step.argmax(axis=1)
        best = step.max(axis=1) + emit[at]
    final[: len(best)] = best
    now = final.argmax(axis=1).astype(np.uint8)
    for t in range(int(counts[0]) - 1, -1, -1):
        m = int(active[t])
        at = begin[:m] + t
        tags[at] = now[:m]
        now[:m] = back[at, now[:m]]
    return tags


_LEFT, _RIGHT = "\"'([{<=:,;", "\"')]}>,.;:!?"


def _ruled(raw: np.ndarray, off: np.ndarray, keys: np.ndarray) -> dict[int, tuple[list, list]]:
    """Rows that have base spans: (base, all), each a list of (kind, start, end) in code points."""
    found: dict[int, tuple[list, list]] = {}
    for r in _suspects(raw, off, keys).tolist():
        if base := [x[:3] for x in rules(raw[off[r] : off[r + 1]].tobytes().decode(errors="replace"))]:
            found[r] = (base, list(base))
    return found


def _emit(model: Model, features: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(features[0]), 3))
    for column, offset in zip(features, _OFFSETS, strict=False):
        out += model.weights[offset : offset + 256][column]
    return out


def _stripped(text: bytes, a: int, b: int) -> tuple[int, int]:
    """The span without quotes and brackets around it."""
    s = text.decode(errors="replace")
    return a + len(s) - len(s.lstrip(_LEFT)), b - (len(s) - len(s.rstrip(_RIGHT)))


def _field(model: Model, part: _Slice) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of the runs of tokens that the field tags, in code points of the row."""
    tags = viterbi(model, _emit(model, part.features()), part.first)
    at = np.flatnonzero(tags)
    if not len(at):
        return
    points = part.points()
    row = np.searchsorted(part.first, at, "right") - 1
    k = 0
    while k < len(at):
        j = k
        while j + 1 < len(at) and at[j + 1] == at[j] + 1 and row[j + 1] == row[k] and tags[at[j + 1]] == 2:
            j += 1
        r = int(row[k])
        lo, hi = int(part.start[at[k]]), int(part.end[at[j]])
        a, b = _stripped(part.raw[lo:hi].tobytes(), int(points[lo] - points[part.off[r]]), int(points[hi] - points[part.off[r]]))
        if b - a >= 6:
            yield r, a, b
        k = j + 1


def _with_neighbours(raw: np.ndarray, a: int, b: int) -> tuple[_Slice, int, int, int]:
    """The tokens of the bytes a to b with up to two before and one after them; the range of their own, and where a is in the slice."""
    back, ahead = 1 << 12, 1 << 12
    while True:
        x, y = max(0, a - back), min(len(raw), b + ahead)
        left, _, _, _ = words(raw[x:a], np.array([0, a - x]))
        right = words(raw[b:y], np.array([0, y - b]))[1]
        if x and len(left) < 3:  # the first of them may be cut
            back *= 4
        elif y < len(raw) and (not len(right) or right[0] == y - b):
            ahead *= 4
        else:
            break
    x = x + int(left[-2]) if len(left) >= 2 else a if not len(left) else x + int(left[0])
    y = b + int(right[0]) if len(right) else b
    part = _Slice(raw[x:y], np.array([0, y - x]))
    return part, int(np.searchsorted(part.start, a - x)), int(np.searchsorted(part.start, b - x)), a - x


def _long_field(model: Model, raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) in code points of what the field tags in one long text, piece by piece.

    A stretch that is not outside gains at most the sum of what its tokens can gain each. So a token of which no stretch around
    it has a sum of 0 or more is outside, and what lies between such tokens is decoded by itself.
    """
    pieces = list(cut_long(raw, LONG))
    tokens = codes = 0
    for a, b in pieces:
        part = _Slice(raw[a:b], np.array([0, b - a]))
        tokens += len(part.start)
        is_code = np.concatenate(([0], np.cumsum(_CLASS[_CODE][part.raw], dtype=np.int64)))
        codes += int((is_code[part.end] > is_code[part.start]).sum())
    share = codes / max(tokens, 1)

    worth = np.zeros(tokens)
    n, gain = 0, _gain(model)
    for a, b in pieces:
        part, k, m, _ = _with_neighbours(raw, a, b)
        emit = _emit(model, [f[k:m] for f in part.features(share)])
        worth[n : n + len(emit)] = emit[:, 1:].max(axis=1) - emit[:, 0] + gain if len(emit) else 0
        n += len(emit)
    best = -worth
    for x, out in ((worth, best), (worth[::-1], best[::-1])):  # the best sum that ends here, and that begins here
        total = np.concatenate(([0.0], np.cumsum(x)))
        out += total[1:] - np.minimum.accumulate(total[:-1])
    open_ = best >= -1e-6
    emits, spots, ranges, n, before = [], [], [], 0, 0
    for a, b in pieces:
        part, k, m, zero = _with_neighbours(raw, a, b)
        at = np.flatnonzero(open_[n : n + m - k])
        if len(at):
            points = part.points()
            base = before - int(points[zero])
            emits.append(_emit(model, [f[k:m][at] for f in part.features(share)]))
            spots.append(at + n)
            ranges += [(int(points[part.start[k + i]] + base), int(points[part.end[k + i]] + base), part.raw[part.start[k + i] : part.end[k + i]].tobytes()) for i in at.tolist()]
        n += m - k
        before += int(((raw[a:b] & 0xC0) != 0x80).sum())
    if not spots:
        return
    spots, emits = np.concatenate(spots), np.concatenate(emits)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(spots) > 1) + 1, [len(spots)]))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        inside = emits[i:j]
        if spots[j - 1] < tokens - 1:  # an outside token follows
            inside = np.concatenate((inside, [[0.0, -np.inf, -np.inf]]))
        tags = viterbi(model if spots[i] == 0 else Model(model.weights, model.moves, model.moves[0]), inside, np.array([0, len(inside)]))[: j - i]
        k = 0
        while k < j - i:
            e = k + 1
            if tags[k]:
                while e < j - i and tags[e] == 2:
                    e += 1
                a, _ = _stripped(ranges[i + k][2], ranges[i + k][0], ranges[i + k][1])
                _, b = _stripped(ranges[i + e - 1][2], ranges[i + e - 1][0], ranges[i + e - 1][1])
                if b - a >= 6:
                    yield a, b
            k = e


def _scan_rows(model: Model, raw: np.ndarray, off: np.ndarray) -> dict[int, tuple[list, list]]:
    """Rows that have spans: (base, all)."""
    whole = _Slice(raw, off)
    found = _ruled(raw, off, whole.keys)
    if model is NOTHING:
        return found
    covers = {r: ([x for _, x, _ in base], list(accumulate((y for _, _, y in base), max))) for r, (base, _) in found.items()}
    long = len(off) == 2 and off[-1] > LONG
    for r, a, b in ((0, *x) for x in _long_field(model, raw)) if long else _field(model, whole):
        starts, ends = covers.get(r, ([], []))
        k = bisect_left(starts, b)  # spans that begin before the end of this one
        if not k or ends[k - 1] <= a:
            found.setdefault(r, ([], []))[1].append(("crf", a, b))
    for _, every in found.values():
        every.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return found


def _pieces(whole: _Slice) -> Iterator[tuple[_Slice, int]]:
    """The slice itself, or the pieces of its one long row, with the row's code points before each."""
    if len(whole.off) != 2 or whole.off[-1] <= LONG:
        yield whole, 0
        return
    before = 0
    for a, b in cut_long(whole.raw, LONG):
        raw = whole.raw[a:b]
        yield _Slice(raw, np.array([0, b - a])), before
        before += int(((raw & 0xC0) != 0x80).sum())


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _find(texts: Texts, model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = NOTHING if model is None else model
        for batch in batches:
            raw, off = utf8(texts.text(batch))
            for a, b in slices(off, _SLICE):
                found = _scan_rows(used, raw[off[a] : off[b]], off[a : b + 1] - off[a])
                lists = [pa.array([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in found[r][k]] if r in found else [] for r in range(b - a)], _SPANS) for k in (0, 1)]
                yield batch_of([*texts.kept(batch, a, b), *lists])

    return run


def find_secrets(docs: DataFrame, model: Model, keep: list[str], column: str = "text", names: tuple[str, str] | None = None) -> DataFrame:
    """The ``keep`` columns, then the rules' spans, and those with the field's where they overlap none, as ``names`` (``__base``
    and ``__found``, with underscores added where a kept column has that name).

    Spans are (kind, start, end) in code points, by start, then kind. A null or empty text has none. Rows are independent, so
    repeated ones are all kept; further columns pass through if kept.
    """
    base, every = names or fresh(keep, "base", "found")
    texts = Texts(docs, keep, column)
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    rows = texts.rows.mapInArrow(_find(texts, None if model is NOTHING else model), texts.schema(f"base {spans}, every {spans}"))
    return texts.restored(rows, F.col("base").alias(base), F.col("every").alias(every))


def redacted(text: str = "text", found: str = "__found", mark: str = "[SECRET]"):
    """Column: the text with every found span replaced; overlapping spans count as one."""
    whole, spans = named(text, found)

    def step(state, s):
        start = F.greatest(s["start"], state["at"])
        fresh = s["start"] >= state["at"]
        piece = F.when(fresh, F.concat(F.substring(whole, (state["at"] + 1).cast("int"), (start - state["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], piece).alias("out"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, begin, step, lambda s: F.concat(s["out"], F.substring(whole, (s["at"] + 1).cast("int"), F.length(whole))))
    return F.when(F.size(spans) > 0, done).otherwise(whole)


def scan(docs: DataFrame) -> DataFrame:
    """Train on the documents, then: doc_id, n_assign, n_access, n_hex, the sha256 of the base spans, and all spans as text.

    Every row of ``docs`` gives a row, also repeated ones; a null text counts as empty. Further columns, whatever their names, stay out.
    """
    docs = docs.select("doc_id", "text")
    rows = find_secrets(docs, train(docs), ["doc_id"])
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in KINDS[:3]]
    return rows.select("doc_id", *counts, F.sha2(text("__base").cast("binary"), 256).alias("base_sha256"), text("__found").alias("spans"))
