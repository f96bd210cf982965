"""Spelling variants: words one edit apart, found exactly by pairs of trie nodes.

Shape of the job (``group_variants``):

1. the distinct words are sorted and numbered, so that numbers order as the words do and long words travel once;
2. the nodes of the trie of the words, and of the trie of the reversed words, are numbered: a node's number is a keyed 64-bit
   function of its parent's number and its letter. ``_numbered_apart`` checks that all rows of a number have one parent and one
   letter, hence, from the roots on, that a number stands for one prefix (suffix); if not, another key is taken;
3. a word w gives a pair (node of w[:i], node of w[i:]) for every place i, and a pair (node of w[:i], node of w[i+1:]) for every
   letter skipped. Two words that meet in a skipped pair differ by one letter replaced; a word whose own pair is another one's
   skipped pair is that word with a letter left out. Of equal letters in a row only the first is skipped for the latter, so
   that every pair of near words meets exactly once;
4. words that meet in a pair differ in one letter there, so a pair has no more rows than there are letters. They are not
   paired with each other: counts and the best two rows of a pair say what each of its words needs;
5. forms are followed by doubling steps. A form is at least twice as frequent, so 6 steps reach the end of any chain.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize
from ._text import cut_long, mix, slices, utf8

#: Bytes of text, letters of words and counted words that a task looks at together.
_SLICE, _LETTERS, _COUNTED = 2 << 20, 1 << 18, 1 << 18
_LONG = 64
U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
_LEAD = 0xC3  # of the two bytes of U+00C0 to U+00FF


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> np.uint32(1) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def crc32_of(data: np.ndarray, at: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each range ``at[k]:at[k+1]`` of the bytes, going on from the crc32 ``before[k]``."""
    size, start = np.diff(at), at[:-1]
    state = ~before.astype(np.uint32)
    open_ = np.flatnonzero((size > 0) & (size <= _LONG))
    j = 0
    while len(open_):
        s = state[open_]
        state[open_] = _CRC[(s ^ data[start[open_] + j]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
        j += 1
        open_ = open_[size[open_] > j]
    out = ~state
    for k in np.flatnonzero(size > _LONG).tolist():
        out[k] = zlib.crc32(data[at[k] : at[k + 1]].tobytes(), int(before[k]))
    return out


def _letters(data: np.ndarray) -> np.ndarray:
    """How many code points begin before each byte, and in all."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))


def slips(raw: np.ndarray, off: np.ndarray, prefix: np.ndarray, least: int, one_in: int) -> pa.Array:
    """The runs of letters of the rows, in lower case, of ``least`` code points or more, one in ``one_in`` with a letter left out.

    ``prefix``: the crc32 of what stands before each row's runs when they are hashed.
    """
    if not len(raw):
        return pa.array([], pa.string())
    lead = raw == _LEAD
    inside = _ASCII[raw] | lead
    inside[1:] |= lead[:-1]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = off[:-1][off[:-1] < len(raw)]
    first[edges] = inside[edges]
    edges = off[1:][off[1:] > 0] - 1
    last[edges] = inside[edges]
    start = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - start
    data = _LOWER[raw[inside]]
    at = np.concatenate(([0], np.cumsum(size)))
    count = np.diff(_letters(data)[at])
    enough = count >= least
    data, size, count = data[np.repeat(enough, size)], size[enough], count[enough]
    at = np.concatenate(([0], np.cumsum(size)))
    h = crc32_of(data, at, prefix[np.searchsorted(off, start[enough], "right") - 1]).astype(np.int64)
    hit = np.flatnonzero(h % one_in == 0)
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    drop = begins[_letters(data)[at[hit]] + h[hit] % count[hit]]
    two = data[drop] == _LEAD
    stay = np.ones(len(data), bool)
    stay[drop] = False
    stay[drop[two] + 1] = False
    size[hit] -= 1 + two
    count[hit] -= 1
    enough = count >= least
    stay &= np.repeat(enough, np.diff(at))
    data, size = data[stay], size[enough]
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def _counts(least: int, one_in: int):
    def merged(held: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).combine_chunks()
        return pa.RecordBatch.from_arrays([rows["word"].combine_chunks(), rows["n_sum"].combine_chunks()], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            raw, off = utf8(batch.column(1))
            prefix = np.array([zlib.crc32(f"{d}:".encode()) for d in batch.column(0).fill_null("").to_pylist()], np.uint32)
            for a, b in slices(off, _SLICE):
                part = raw[off[a] : off[b]]
                for c, d in cut_long(part, _SLICE) if b == a + 1 else [(0, len(part))]:
                    inner = np.array([0, d - c]) if b == a + 1 else off[a : b + 1] - off[a]
                    found = pc.value_counts(slips(part[c:d], inner, prefix[a:b], least, one_in))
                    held.append(pa.table({"word": found.field(0), "n": found.field(1)}))
                    total += len(found)
                    if total >= _COUNTED:
                        yield merged(held)
                        held, total = [], 0
        if held:
            yield merged(held)

    return run


def count_words(docs: DataFrame, least: int = 5, at_least: int = 3, one_in: int = 97) -> DataFrame:
    """(word, n): the words of ``least`` code points or more that occur ``at_least`` times in the documents.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case. Of a run whose crc32 with its doc_id before it
    (``<doc_id>:<run>``) is divisible by ``one_in``, the letter at that crc32 modulo the run's length is left out. Null texts have no
    words, a null doc_id is written as nothing; rows that repeat count as often as they stand. Further columns are not looked at.
    Texts are taken in pieces that end at white space.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counts(least, one_in), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)


def _nodes(words: list[str], key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, where each word's nodes begin, its prefix nodes, its suffix nodes): a word of n letters has n + 1 of each."""
    size = np.array([len(w) for w in words], np.int64)
    letter = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(U)
    begin = np.concatenate(([0], np.cumsum(size)))
    out = begin + np.arange(len(begin))
    prefix, suffix = np.full(int(out[-1]), U(1)), np.full(int(out[-1]), U(1))
    value = mix(letter + U(key << 32) + U(0x9E3779B97F4A7C15))
    order = np.argsort(-size, kind="stable")
    many = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")  # words longer than each length
    front, back = np.full(len(words), U(1)), np.full(len(words), U(1))
    for i, k in enumerate(many.tolist()):
        at = order[:k]
        front[:k] = mix(front[:k] * U(0xD1342543DE82EF95) + value[begin[at] + i])
        prefix[out[at] + i + 1] = front[:k]
        back[:k] = mix(back[:k] * U(0xD1342543DE82EF95) + value[begin[at + 1] - 1 - i])
        suffix[out[at + 1] - 2 - i] = back[:k]
    return letter, out, prefix, suffix


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The words in slices of about ``_LETTERS`` bytes."""
    for batch in batches:
        _, off = utf8(batch.column(1))
        for a, b in slices(off, _LETTERS):
            yield batch.slice(a, b - a), batch.column(1).slice(a, b - a).to_pylist()


def _pairs(key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _words(batches):
            letter, out, prefix, suffix = _nodes(words, key)
            size = np.diff(out) - 1
            word = np.repeat(np.arange(len(words)), size)
            skip = np.arange(len(letter)) + word  # where the skipped letter's prefix stands
            again = np.zeros(len(letter), bool)
            again[1:] = (letter[1:] == letter[:-1]) & (word[1:] == word[:-1])
            p = np.concatenate((prefix, prefix[skip])).view(np.int64)
            s = np.concatenate((suffix, suffix[skip + 1])).view(np.int64)
            kind = np.concatenate((np.zeros(len(prefix), np.int8), 1 + again.astype(np.int8)))
            of = np.concatenate((np.repeat(np.arange(len(words)), size + 1), word))
            row, n = (batch.column(c).to_numpy()[of] for c in (0, 2))
            for a in range(0, len(p), _LETTERS):
                b = a + _LETTERS
                yield pa.RecordBatch.from_arrays([pa.array(x[a:b]) for x in (p, s, kind, row, n)], ["p", "s", "kind", "id", "n"])

    return run


def _links(key: int):
    """Distinct (side, node, parent, letter) of a slice of words, the roots among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in _words(batches):
            letter, out, prefix, suffix = _nodes(words, key)
            skip = np.arange(len(letter)) + np.repeat(np.arange(len(words)), np.diff(out) - 1)
            for side, node, parent in ((0, prefix[skip + 1], prefix[skip]), (1, suffix[skip], suffix[skip + 1])):
                node, parent, letters = (np.append(x, U(y)) for x, y in ((node, 1), (parent, 0), (letter, 0)))
                order = np.lexsort((letters, parent, node))
                node, parent, letters = node[order], parent[order], letters[order]
                new = np.ones(len(node), bool)
                new[1:] = (node[1:] != node[:-1]) | (parent[1:] != parent[:-1]) | (letters[1:] != letters[:-1])
                cols = [np.full(int(new.sum()), side, np.int8), *(x[new].view(np.int64) for x in (node, parent, letters))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["side", "node", "parent", "letter"])

    return run


def _numbered_apart(words: DataFrame, key: int) -> bool:
    """Whether no two nodes of a trie have the same number."""
    found = words.mapInArrow(_links(key), "side byte, node long, parent long, letter long").groupBy("side", "node")
    found = found.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("parent", "letter") for f in (F.min, F.max)))
    return found.where("min_parent <> max_parent OR min_letter <> max_letter").isEmpty()


def _near(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best struct(n, low)): of each word with near words their number and the one of largest n, then smallest id."""
    key = Window.partitionBy("p", "s")
    first = key.orderBy(F.col("kind") == 0, F.desc("n"), "id")  # skipped pairs first, the best of them in front
    me = F.struct("n", (-F.col("id")).alias("low"))
    skipped, whole, shorter = F.col("kind") > 0, F.col("kind") == 0, F.col("kind") == 1
    rows = pairs.select(
        "id", "kind", me.alias("me"),
        F.count("*").over(key).alias("rows"), F.count(F.when(skipped, 1)).over(key).alias("skips"), F.count(F.when(shorter, 1)).over(key).alias("longer"),
        F.max(F.when(whole, me)).over(key).alias("whole"), F.max(F.when(shorter, me)).over(key).alias("best_longer"),
        F.max(F.when(skipped, me)).over(key).alias("best_skip"), F.lead(F.when(skipped, me)).over(first).alias("next_skip"),
    ).where("rows > 1")
    found = F.when(whole, F.col("longer")).otherwise(F.col("skips") - 1 + F.when(shorter & F.col("whole").isNotNull(), 1).otherwise(0))
    other = F.when(F.col("best_skip") == F.col("me"), F.col("next_skip")).otherwise(F.col("best_skip"))
    best = F.when(whole, F.col("best_longer")).otherwise(F.greatest(other, F.when(shorter, F.col("whole"))))
    return rows.groupBy("id").agg(F.sum(found).alias("n_near"), F.max(best).alias("best")).where("n_near > 0")


def _ends(forms: DataFrame) -> DataFrame:
    """(id, end) for the links (id, form): where following them leads."""
    step = materialize(forms.select("id", F.col("form").alias("end")), "sp-ends")
    while True:
        ahead = step.select(F.col("id").alias("end"), F.col("end").alias("beyond"))
        if step.join(ahead, "end", "left_semi").isEmpty():
            return step
        step = materialize(step.join(ahead, "end", "left").select("id", F.coalesce("beyond", "end").alias("end")), "sp-ends")


def group_variants(counted: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for distinct words and their counts (``word``, ``n``; further columns are not looked at).

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its near word of
    largest n (ties: the first in code-point order) if that n is at least ``ratio`` (over 1) times its own, else null; its root is
    the last word that forms lead to, itself if it has none. Null words are left out; the empty word is a word.
    """
    counted = materialize(counted.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "sp-counted")
    words = materialize(counted.orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "sp-words")
    key = next((k for k in range(8) if _numbered_apart(words, k)), None)
    if key is None:
        raise ValueError("trie nodes can't be told apart")
    near = materialize(_near(words.mapInArrow(_pairs(key), "p long, s long, kind byte, id long, n long")), "sp-near")
    known = words.join(near, "id", "left").withColumn("form", F.when(F.col("best.n") >= ratio * F.col("n"), -F.col("best.low")))
    forms = materialize(known.where("form IS NOT NULL").select("id", "form", F.col("best.n").alias("form_n")), "sp-forms")
    name = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"))
    led = forms.join(_ends(forms), "id").join(name("form"), "form").join(name("end"), "end").select("id", "form_word", "end_word", "form_n")
    out = words.join(near.select("id", "n_near"), "id", "left").join(led, "id", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("end_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
