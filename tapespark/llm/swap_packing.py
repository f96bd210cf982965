"""Packing token ids into few sequences: best fit, then swaps between underfull sequences.

Shape of the job (``pack``):

1. one pass over the texts encodes them, ends every document with an id, cuts the ones longer than a sequence into pieces (all
   but the first of a sequence's length) and numbers the pieces;
2. pieces as long as a sequence are sequences. The others, without their texts, are dealt by their number to groups of about
   ``GROUP_TOKENS``, so that no group is large whatever the documents are;
3. a group starts with best fit by falling length. If that takes more sequences than a lower bound (total length, and pieces of
   over half a sequence, which never share one), local search goes on: a target sequence takes a piece from a less full one, or
   exchanges one for one, two for one, or one for two, whenever the sum of squared fills rises. That drains the less full ones
   until they are empty, and ends at the bound or where no exchange helps.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rows import fresh, named
from ._store import materialize
from ._text import slices, utf8
from .packing import best_fit

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
MAX_TOKENIZER_BYTES = 32 << 20
GROUP_TOKENS, GROUP_PIECES = 8 << 20, 200_000
_SLICE, _CUT_CHARS = 1 << 20, 1 << 20
#: Words that a worker remembers; when there are more, those not used since the last time are forgotten.
_WORDS = 400_000
#: How many of the least full sequences are looked at for two pieces at once.
_LEAST_FULL = 8

_NARROW = 0x250


def _class(kind: str) -> str:
    return "".join(f"\\u{c:04x}" for c in range(_NARROW) if unicodedata.category(chr(c))[0] == kind)


_L, _N, _S = _class("L"), _class("N"), r" \t\n\v\f\r\x85\xa0"
#: The byte-level tokenizer's own split into words, for texts of code points under ``_NARROW``.
_SPLIT = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WIDE = re.compile(f"[^\\0-\\u{_NARROW - 1:04x}]")
#: A word of the split ends wherever a visible ASCII sign is followed by a space or a line feed.
_CUT = re.compile(r"(?<=[!-~])(?=[ \n])")


class Encoder:
    """Ids of texts as little-endian uint32. Words are encoded once and remembered; what the split does not cover goes to the
    tokenizer as it is: texts with rarer letters, with the tokenizer's special strings, or for a tokenizer of another kind."""

    def __init__(self, model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model.decode())
        kind = json.loads(model)
        split = kind.get("pre_tokenizer") or {}
        self.known = not kind.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True)
        added = kind.get("added_tokens") or []
        self.known &= not any(t.get("lstrip") or t.get("rstrip") or t.get("normalized") or re.search(r"[ \n]", t["content"]) for t in added)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.known and not _WIDE.search(t) and not (self.special and self.special.search(t)) for t in texts]
        split = [_SPLIT.findall(t) if p else [] for t, p in zip(texts, plain, strict=True)]
        words, before = self.words, self.before
        unseen = [w for w in set().union(*split) if w not in words]
        words.update((w, before[w]) for w in unseen if w in before)
        new = [w for w in unseen if w not in before]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        flat = np.array([i for x in ids for i in x], "<u4").tobytes()
        ends = np.cumsum([4 * len(x) for x in ids]).tolist()
        words.update((w, flat[a:b]) for w, a, b in zip(new, [0, *ends], ends, strict=False))
        out = [b"".join(map(words.__getitem__, s)) if p else self._whole(t) for t, p, s in zip(texts, plain, split, strict=True)]
        if len(words) > _WORDS:
            self.words, self.before = {}, words
        return out

    def encode_long(self, text: str) -> bytes:
        """In pieces that end where a word of the split ends; a text without such places is one piece."""
        out, a = [], 0
        while a < len(text):
            found = _CUT.search(text, a + _CUT_CHARS) if self.known else None
            b = found.start() if found else len(text)
            out += self.encode([text[a:b]])
            a = b
        return b"".join(out)


_encoders: dict[int, Encoder] = {}


def _encoder(model: bytes) -> Encoder:
    """The worker's encoder, kept from task to task."""
    key = zlib.crc32(model)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model)
    return _encoders[key]


def read_tokenizer(path: str = DEFAULT_TOKENIZER) -> bytes:
    """The tokenizer file's bytes, at most ``MAX_TOKENIZER_BYTES``; the driver sends them to the workers."""
    with open(path, "rb") as f:
        model = f.read(MAX_TOKENIZER_BYTES + 1)
    if len(model) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{path} is larger than {MAX_TOKENIZER_BYTES} bytes")
    return model


def cut(docs: DataFrame, length: int = 2048, end: int = 0, with_ids: bool = True, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """The pieces of the documents: number long (different for every piece), doc_id, piece int (from 0), start long (the document's
    ids before it), length long, ids_crc32 long, and ``with_ids`` the ids (little-endian uint32).

    A document is the ids of its text (null: none) and ``end``. Only one of more than ``length`` ids is cut, into pieces of
    ``length``, of which the first may be shorter. Repeated and null ids are kept; further columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            _, off = utf8(batch.column(1))
            for a, b in slices(off, _SLICE):
                texts = batch.column(1).slice(a, b - a).fill_null("").to_pylist()
                found = [encoder.encode_long(texts[0])] if b == a + 1 else encoder.encode(texts)
                of, piece, start, size, crc, ids = [], [], [], [], [], []
                for k, raw in enumerate(found):
                    raw += last
                    total = len(raw) // 4
                    at = 0
                    for j in range(-(-total // length)):
                        n = (total - 1) % length + 1 if j == 0 else length
                        part = raw[4 * at : 4 * (at + n)]
                        of.append(k)
                        piece.append(j)
                        start.append(at)
                        size.append(n)
                        crc.append(zlib.crc32(part))
                        ids.append(part)
                        at += n
                numbers = number + np.arange(len(of))
                number += len(of)
                columns = [pa.array(numbers), batch.column(0).slice(a, b - a).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.binary())] if with_ids else [])], [f"c{k}" for k in range(6 + with_ids)])

    out = rows.mapInArrow(run, f"c0 long, c1 {kind}, c2 int, c3 long, c4 long, c5 long" + (", c6 binary" if with_ids else ""))
    return out.toDF("number", "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []))


def fewest(sizes: np.ndarray, most: int) -> int:
    """A lower bound on the number of sequences: for each a up to half a sequence, pieces of over ``most`` - a have one alone, other
    pieces of over half a sequence have one each, and what those leave free is all that pieces of a and more can use of them."""
    of = np.bincount(sizes, minlength=most + 1)
    count = np.concatenate((np.cumsum(of[::-1])[::-1], [0]))  # pieces of this size or more
    total = np.concatenate((np.cumsum((of * np.arange(most + 1))[::-1])[::-1], [0]))
    a = np.arange(most // 2 + 1)
    half = most // 2 + 1
    top = most - a + 1
    alone, wide = count[np.minimum(top, most + 1)], count[half] - count[np.minimum(top, most + 1)]
    free = wide * most - (total[half] - total[np.minimum(top, most + 1)])
    rest = np.maximum(0, total[a] - total[half] - free)
    return int((alone + wide + -(-rest // most)).max())


class Swaps:
    """Local search over the sequences that have room. A sequence holds lists of pieces by size; a shelf lists, for each size,
    the sequences that hold one, the least full first. Entries of the shelves that no longer hold are dropped when met."""

    def __init__(self, sizes: list[int], place: list[int], most: int) -> None:
        self.sizes, self.place, self.most = sizes, place, most
        self.fill: dict[int, int] = {}
        for s, b in zip(sizes, place, strict=True):
            self.fill[b] = self.fill.get(b, 0) + s
        self.count = len(self.fill)
        self.held: dict[int, dict[int, list[int]]] = {b: {} for b, f in self.fill.items() if f < most}
        self.shelf: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]
        self.filled = 0  # bits of the sizes whose shelf is not empty
        for k, b in enumerate(place):
            if b in self.held:
                self.held[b].setdefault(sizes[k], []).append(k)
        for b in self.held:
            self._list(b)

    def _list(self, b: int) -> None:
        for s in self.held[b]:
            heapq.heappush(self.shelf[s], (self.fill[b], b))
            self.filled |= 1 << s

    def _source(self, s: int, target: int) -> int:
        """The least full sequence but the target that holds a piece of this size; -1 if there is none."""
        heap, aside = self.shelf[s], None
        while heap:
            f, b = heap[0]
            if b in self.held and self.fill[b] == f and s in self.held[b]:
                if b != target:
                    break
                aside = heap[0]
            heapq.heappop(heap)
        found = heap[0][1] if heap else -1
        if aside:
            heapq.heappush(heap, aside)
        if not heap:
            self.filled &= ~(1 << s)
        return found

    def _exchange(self, target: int, source: int, take: tuple[int, ...], give: tuple[int, ...]) -> None:
        for a, b, moved in ((source, target, take), (target, source, give)):
            for s in moved:
                k = self.held[a][s].pop()
                if not self.held[a][s]:
                    del self.held[a][s]
                self.held[b].setdefault(s, []).append(k)
                self.place[k] = b
                self.fill[a] -= s
                self.fill[b] += s
        for b in (target, source):
            if self.fill[b] == self.most:
                del self.held[b]
            elif self.fill[b]:
                self._list(b)
            else:
                del self.held[b], self.fill[b]
                self.count -= 1

    @staticmethod
    def _two(held: dict[int, list[int]]) -> list[tuple[int, int]]:
        own = sorted(held)
        return [(a, b) for i, a in enumerate(own) for b in own[i:] if a != b or len(held[a]) > 1]

    def improve(self, target: int, poor: list[int]) -> bool:
        """Make the exchange that fills the target most, of those that raise the sum of squared fills; False if there is none.

        By d, the target goes from f to f + d and the source from g to g - d, which raises the sum if f + d > g."""
        f, held = self.fill[target], self.held[target]
        room, best = self.most - f, (0, -1, (), ())
        for give in [(), *((s,) for s in held), *self._two(held)]:
            out = sum(give)
            open_ = self.filled & ((2 << min(out + room, self.most)) - 1)
            while (s := open_.bit_length() - 1) > out + best[0]:
                source = self._source(s, target)
                if source >= 0 and self.fill[source] < f + s - out:
                    best = (s - out, source, (s,), give)
                open_ ^= 1 << s
            if best[0] == room:
                break
        if best[0] < room:
            for source in poor:
                if source == target or source not in self.held:
                    continue
                pairs = self._two(self.held[source])
                for give in [(), *((s,) for s in held)]:
                    for two in pairs:
                        d = sum(two) - sum(give)
                        if best[0] < d <= room and self.fill[source] < f + d:
                            best = (d, source, two, give)
        if best[1] < 0:
            return False
        self._exchange(target, *best[1:])
        return True

    def run(self, bound: int) -> None:
        going = True
        while going and self.count > bound:
            going = False
            for target in sorted(self.held, key=lambda b: (-self.fill[b], b)):
                if target not in self.held:
                    continue
                poor = heapq.nsmallest(_LEAST_FULL, self.held, key=lambda b: (self.fill[b], b))
                while target in self.held and self.improve(target, poor):
                    going = True
                    if self.count <= bound:
                        return


def placed(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece of 1 to ``most`` ids."""
    at, n = best_fit(sizes, most)
    bound = fewest(sizes, most)
    if n > bound:
        search = Swaps(sizes.tolist(), at.tolist(), most)
        search.run(bound)
        at = np.array(search.place)
    order = np.argsort(at, kind="stable")
    ends = np.cumsum(sizes[order])
    first = np.concatenate(([True], np.diff(at[order]) > 0))
    offset = np.empty(len(at), np.int64)
    offset[order] = ends - sizes[order] - (ends - sizes[order])[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
    return at, offset


def place(pieces: DataFrame, length: int = 2048) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, both long, for columns ``number`` (long, different in every row) and ``length``
    (1 to ``length``); further columns, whatever their names, go along. ``pieces`` is read twice, so it should be a written table."""
    short = pieces.where(F.col("length") < length)
    total = short.agg(F.count("*").alias("n"), F.sum("length").alias("ids")).first()
    groups = max(1, -(-(total["ids"] or 0) // GROUP_TOKENS), -(-total["n"] // GROUP_PIECES))
    group, sequence, offset = fresh(pieces.columns, "group", "sequence", "offset")
    fields = pieces.schema.fields
    size = [f.name for f in fields].index("length")

    def run(rows: pa.Table) -> pa.Table:
        at, where = placed(rows.column(size).to_numpy(), length)
        base = rows.column(len(fields))[0].as_py() << 32
        kept = [rows.column(k).combine_chunks() for k in range(len(fields))]
        return pa.table([*kept, pa.array(base + at), pa.array(where)], [f"c{k}" for k in range(len(fields) + 2)])

    dealt = short.select(*(c.alias(f"c{k}") for k, c in enumerate(named(*pieces.columns))), F.pmod(F.xxhash64("number"), F.lit(groups)).alias(group))
    schema = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(fields)) + f", c{len(fields)} long, c{len(fields) + 1} long"
    found = dealt.groupBy(group).applyInArrow(run, schema).toDF(*pieces.columns, sequence, offset)
    whole = pieces.where(F.col("length") == length).select(*named(*pieces.columns), (-1 - F.col("number")).alias(sequence), F.lit(0).cast("long").alias(offset))
    return found.unionByName(whole).withColumnsRenamed({sequence: "sequence_id", offset: "offset"})


def pack(docs: DataFrame, length: int = 2048, end: int = 0, with_ids: bool = True, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """The pieces of all documents (see ``cut``) with the sequence that holds each and its offset there; sequences have no gaps.

    The grouping depends on the pieces' numbers, which depend on the partitions of ``docs``; what the pieces are does not.
    """
    return place(materialize(cut(docs, length, end, with_ids, tokenizer), "sw-pieces"), length).drop("number")


def sequences(packed: DataFrame, length: int = 2048) -> DataFrame:
    """A row for each sequence of ``pack``'s result: n_tokens, input_ids (little-endian uint32, filled up with zeros), cu_seqlens
    from 0, doc_ids, pieces and starts of its segments. A sequence has at most ``length`` segments."""
    held = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(held.alias("held"), F.sum("length").alias("n_tokens"))
    ids = F.unhex(F.rpad(F.array_join(F.transform("held", lambda x: F.hex(x["ids"])), ""), 8 * length, "0"))
    return rows.select("sequence_id", "n_tokens", ids.alias("input_ids"), F.concat("held.offset", F.array("n_tokens")).alias("cu_seqlens"), F.col("held.doc_id").alias("doc_ids"), F.col("held.piece").alias("pieces"), F.col("held.start").alias("starts"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    return pack(docs, with_ids=False)
