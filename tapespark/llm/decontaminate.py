"""Benchmark decontamination: pigeonhole pieces propose, Myers' bit-parallel edit distance decides.

Texts and items are lower-cased with white space collapsed. An item of n characters may have k = floor(``rate`` n) edits. It
is cut into k + 1 pieces; any text that holds it with at most k edits holds one piece unchanged, near its place. An item that
is too short for an edit is one piece, and must stand between word boundaries. The pieces of a block of items go into one
Aho-Corasick automaton; each hit gives a window of the text, overlapping windows of an item join, and each is verified once.
Items are taken in blocks of about ``BLOCK_BYTES``, the only data sent to workers, one map over the documents for each block;
documents are never shuffled. The driver reads one block at a time and hands it to Spark as a broadcast.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rows import Texts, batch_of, fresh
from ._store import input_bytes

RATE, BLOCK_BYTES = 0.05, 4 << 20
_SPACES = re.compile(r"\s+")


def normal(text: str | None) -> str:
    low = (text or "").lower()
    return " ".join(low.split()) if len(low) < 1 << 20 else _SPACES.sub(" ", low).strip()  # a long text is not cut into words


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): k + 1 parts of nearly equal length."""
    n = len(item)
    cuts = [n * j // (k + 1) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(pattern: str) -> dict[str, int]:
    """For each character the bits of its places in the pattern."""
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


def distance(peq: dict[str, int], m: int, text: str) -> int:
    """Least edit distance between the pattern of m characters and any substring of the text (Myers 1999, as one long word)."""
    top, full = 1 << (m - 1), (1 << m) - 1
    pv, mv, score = full, 0, m
    best = m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best


def apart(text: str, a: int, b: int) -> bool:
    """True if no letter or digit stands right before or after the range."""
    return not (a > 0 and text[a - 1].isalnum() and text[a].isalnum()) and not (b < len(text) and text[b].isalnum() and text[b - 1].isalnum())


class Items:
    """The automaton of a block of items."""

    def __init__(self, rows: list[tuple[int, str]], rate: float) -> None:
        import ahocorasick

        self.items = [(item_id, text, int(len(text) * rate), masks(text)) for item_id, text in rows]
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for index, (_, text, k, _) in enumerate(self.items):
            for offset, piece in pieces(text, k):
                at[piece].append((index, offset + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, where)
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int]]:
        """(item id, distance) of the items that the normalised text holds within their budgets, by item id."""
        starts: dict[int, set[int]] = defaultdict(set)
        for end, where in self.automaton.iter(text):
            for index, past in where:
                starts[index].add(end + 1 - past)
        out = []
        for index, found in starts.items():
            item_id, item, k, peq = self.items[index]
            if not k:
                if any(apart(text, s, s + len(item)) for s in found):
                    out.append((item_id, 0))
                continue
            if item in text:
                out.append((item_id, 0))
                continue
            best, windows = k + 1, []
            for s in sorted(found):
                a, b = max(0, s - k), s + len(item) + k
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = b
                else:
                    windows.append([a, b])
            for a, b in windows:
                best = min(best, distance(peq, len(item), text[a:b]))
            if best <= k:
                out.append((item_id, best))
        return sorted(out)


_cache: dict[str, Items] = {}


def _automaton(name: str, shared, rate: float) -> Items:
    """The items of a named broadcast; a worker keeps the last one."""
    if name not in _cache:
        _cache.clear()
        _cache[name] = Items(shared.value, rate)
    return _cache[name]


_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))


def _search(texts: Texts, shared, rate: float, more: bool):
    """One block of items; with ``more`` the last column has the hits of the blocks before."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _automaton(name, shared, rate)
        for batch in batches:
            columns = batch.columns[: batch.num_columns - more]
            before = batch.columns[-1] if more else [None] * batch.num_rows
            hits = []
            for text, old in zip(texts.text(batch), before, strict=True):
                found = [{"item_id": i, "distance": d} for i, d in items.find(normal(text.as_py()))]
                hits.append(old.as_py() + found if more else found)
            yield batch_of([*columns, pa.array(hits, _HITS)])

    return run


def find_items(docs: DataFrame, items: DataFrame, keep: list[str], column: str = "text", rate: float = RATE, name: str | None = None) -> DataFrame:
    """The ``keep`` columns and, as ``name`` (``__hits``, with underscores added where a kept column has that name), an array of
    (item_id, distance) of the items that a text holds, by item_id.

    ``items`` has item_id and text; one without an id is reported as -1, and one whose text is null or blank is in no text. A
    null or empty text holds none. Equal items, and equal documents, each count for themselves. Further columns pass through
    if kept, whatever their names.
    """
    (name,) = [name] if name else fresh(keep, "hits")
    spark = docs.sparkSession
    items = items.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    blocks = max(1, -(-input_bytes(items, "text") // BLOCK_BYTES))
    texts = Texts(docs, keep, column)
    hits = "array<struct<item_id:bigint,distance:int>>"
    rows, found = texts.rows, False
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        wanted = [(r["item_id"], t) for r in part if (t := normal(r["text"]))]
        if wanted:
            rows = rows.mapInArrow(_search(texts, spark.sparkContext.broadcast(wanted), rate, found), texts.schema(f"hits {hits}", with_text=True))
            found = True
    return texts.restored(rows, (F.array_sort("hits") if found else F.array().cast(hits)).alias(name))


def scan(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_items, items (ids, comma-joined), least_distance (null if none), contaminated; a row for each row of ``docs``."""
    rows = find_items(docs, items, ["doc_id"], name="hits")
    ids = F.array_join(F.transform("hits", lambda h: h["item_id"].cast("string")), ",")
    least = F.array_min(F.transform("hits", lambda h: h["distance"]))
    n = F.size("hits").cast("long")
    return rows.select("doc_id", n.alias("n_items"), ids.alias("items"), least.cast("long").alias("least_distance"), (n > 0).alias("contaminated"))
