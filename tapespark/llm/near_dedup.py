"""MinHash near-duplicates: banded MinHash proposes, odd sketches screen, full shingle sets decide.

Shape of the job (``near_duplicates``):

1. one pass over the texts makes, per document, the size of its shingle set, a 128-bit hash of the set, ``bands`` keys of
   ``rows`` MinHash samples each, and the odd sketch: the samples folded into a parity bitmap of 512 bits;
2. documents with equal sets form classes (a partial aggregate, so thousands of copies shrink to a row before the shuffle);
3. class representatives that share a band key become candidates. Only pairs with the key's hub, the representative of most
   copies, are made, never all pairs of a key. The XOR popcount of two odd sketches estimates the similarity, and clearly
   dissimilar pairs go; the rest are confirmed on full sets and joined into components;
4. where members of a hub's keys are then still outside its component, members are compared with each other by their
   differences from the hub, which are small: two sets can only be similar if their differences share enough elements, so a
   prefix of the rarest ones must meet (``_left_over``). No link between different texts is lost to the choice of the hub;
5. components get their smallest doc_id.

A key or hub with more than ``HOT`` rows is not left to one task. Hot band keys, of which there can only be so many, are sent
to all tasks with their hub, so their members stay where they are; the members of a hot hub are dealt to several tasks, each
with a copy of the hub's sketch or set.

With 6 rows and 40 bands a pair at similarity 0.8 shares no key with probability (1 - 0.8**6)**40 = 5e-6. The screen drops
a pair at 0.8 with probability under 1e-9 (6.4 standard deviations).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize
from ._text import distinct, mix, shingles, slices, utf8, words
from .components import components

BANDS, ROWS, BITS = 40, 6, 512
HOT, MOST_SENT = 2000, 100_000
#: Differing bits beyond which a pair is not confirmed: an estimated similarity of about 0.53.
SCREEN_BITS = 150
_FACTORS = (mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _sets(text: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of rows: its range, the distinct shingle hashes, where each row's begin."""
    raw, off = utf8(text)
    for a, b in slices(off):
        _, _, value, first = words(raw[off[a] : off[b]], off[a : b + 1] - off[a])
        values, begin = distinct(*shingles(value, first, size))
        yield a, b, values, begin


def _features(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, values, begin in _sets(batch.column(1), size):
                n = np.diff(begin)
                some = n > 0
                at = begin[:-1][some]
                sums = np.zeros((2, b - a), np.uint64)
                samples = np.zeros((int(some.sum()), BANDS * ROWS), np.uint32)
                if len(at):
                    sums[0, some] = np.add.reduceat(mix(values), at)
                    sums[1, some] = np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                    short = (values >> np.uint64(32)).astype(np.uint32)
                    for k, factor in enumerate(_FACTORS):
                        samples[:, k] = np.minimum.reduceat((short ^ np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * factor, at)
                keys = np.empty((len(samples), BANDS), np.uint64)
                for k in range(BANDS):
                    key = np.full(len(samples), k + 1, np.uint64)
                    for j in range(ROWS):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + samples[:, k * ROWS + j])
                    keys[:, k] = key
                bit = mix(samples.astype(np.uint64) * np.uint64(BANDS * ROWS) + np.arange(BANDS * ROWS, dtype=np.uint64)) % np.uint64(BITS)
                parity = np.bincount((np.arange(len(samples))[:, None] * BITS + bit.astype(np.int64)).ravel(), minlength=len(samples) * BITS) & 1
                sketch = np.packbits(parity.astype(np.uint8).reshape(-1, BITS), axis=1)
                spread = np.concatenate(([0], np.cumsum(some)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(n.astype(np.int64)),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array((spread * BANDS).astype(np.int32)), pa.array(keys.ravel().view(np.int64))),
                        pa.ListArray.from_arrays(pa.array((spread * (BITS // 64)).astype(np.int32)), pa.array(np.ascontiguousarray(sketch).ravel().view(np.int64))),
                    ],
                    ["doc_id", "n", "s0", "s1", "bands", "sketch"],
                )

    return run


def _arrays(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, values, begin in _sets(batch.column(1), size):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values.view(np.int64)))], ["rep", "grams"])

    return run


def _hot(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys with more than ``HOT`` rows and the number of tasks that theirs are dealt to; None if there is no such key.
    ``rows`` are read twice, so they should be written ones."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(*keys, F.ceil(F.col("n") / HOT).alias("parts"))
    n = sizes.count()
    return None if not n else F.broadcast(sizes) if n <= MOST_SENT else sizes


def _joined(rows: DataFrame, keys: list[str], by: str, payload: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``rows.join(payload, keys)``: the rows of a hot key go to several tasks by the hash of ``by``, each with a copy of that
    key's payload."""
    if hot is None:
        return rows.join(payload, keys)
    parts = F.coalesce("parts", F.lit(1))
    rows = rows.join(hot, keys, "left").withColumn("part", F.pmod(F.xxhash64(by), parts)).drop("parts")
    payload = payload.join(hot, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    return rows.join(payload, [*keys, "part"]).drop("part")


def _screened(pairs: DataFrame, reps: DataFrame, threshold: int, hot: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) whose sizes and odd sketches allow the similarity."""
    of = lambda p: reps.select(F.col("rep").alias(p), F.col("n").alias(f"n_{p}"), F.col("sketch").alias(f"sk_{p}"))
    differ = sum((F.bit_count(F.col("sk_a")[i].bitwiseXOR(F.col("sk_b")[i])) for i in range(BITS // 64)), F.lit(0))
    near = (100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")) & (differ <= SCREEN_BITS)
    return _joined(pairs, ["b"], "a", of("b"), hot).join(of("a"), "a").where(near).select("a", "b").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int, hot: DataFrame | None = None) -> DataFrame:
    """Links: 100 * intersection >= threshold * union on the full shingle sets."""
    of = lambda p: sets.select(F.col("rep").alias(p), F.col("grams").alias(f"g_{p}"))
    both = _joined(pairs, ["b"], "a", of("b"), hot).join(of("a"), "a").withColumn("i", F.size(F.array_intersect("g_a", "g_b")))
    return both.where(100 * F.col("i") >= threshold * (F.size("g_a") + F.size("g_b") - F.col("i"))).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """Components of documents whose sets of ``size``-word shingles have a Jaccard similarity of ``threshold`` percent or more.

    Takes ``doc_id`` long and ``text``; returns a row per row of ``docs``: doc_id, n_shingles long, component_id (smallest
    doc_id reachable), kept (doc_id = component_id). A text with fewer words than ``size`` is one shingle; a null, empty or
    blank text has no shingles and links with nothing. Rows that share a doc_id are one document: what one links, all do.
    A row without doc_id links with nothing: component_id null, kept true. Other columns of ``docs`` are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n long, s0 long, s1 long, bands array<long>, sketch array<long>"
    feats = materialize(docs.mapInArrow(_features(size), schema), "nd-features")
    whole = feats.where("n > 0 AND doc_id IS NOT NULL")
    reps = materialize(whole.groupBy("s0", "s1", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nd-reps")
    keyed = reps.select("rep", "copies", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.max(F.struct("copies", (-F.col("rep")).alias("low"))).alias("hub"), F.count("*").alias("m")).where("m > 1").select("key", "hub", (-F.col("hub.low")).alias("b"), "m")
    shared = materialize(shared, "nd-shared")
    # at most MOST_SENT keys can have this many rows
    many = max(HOT, reps.count() * BANDS // MOST_SENT + 1)
    hot = F.broadcast(shared.where(F.col("m") > many))
    first = keyed.join(hot, "key", "left_anti").join(shared.where(F.col("m") <= many), "key").unionByName(keyed.join(hot, "key"))
    first = first.where("rep <> b").groupBy(F.col("rep").alias("a"), "b").agg(F.max("hub").alias("hub"))
    first = materialize(first, "nd-first")
    # the ids grow with the documents: the plan is that of a large input at any size
    wanted = first.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().hint("merge")
    texts = docs.join(wanted, "doc_id", "left_semi")
    sets = materialize(texts.mapInArrow(_arrays(size), "rep long, grams array<long>"), "nd-sets")
    pairs = first.select("a", "b")
    hubs = _hot(pairs, ["b"])
    links = materialize(_confirmed(_screened(pairs, reps, threshold, hubs), sets, threshold, hubs), "nd-links")
    roots = components(links)
    more = materialize(_confirmed(_screened(_left_over(first, roots, sets, threshold), reps, threshold), sets, threshold), "nd-links")
    if not more.isEmpty():
        links = links.union(more)
        roots = components(links)
    slim = feats.select("doc_id", "n", "s0", "s1")
    repeated = whole.select("doc_id", "s0", "s1").distinct().groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        own = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("s0", "s1", "n", F.coalesce("root", "rep").alias("root"))
        out = slim.join(own, ["s0", "s1", "n"], "left")
    else:
        same = whole.join(reps.select("s0", "s1", "n", "rep"), ["s0", "s1", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        out = slim.join(components(links.union(same)).withColumnRenamed("node", "doc_id"), "doc_id", "left")
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"))


def _left_over(first: DataFrame, roots: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Candidates (a, b) among the members of a hub that lie in different components.

    Hubs that are members of a better hub first hand their members on to it, so that a large group mostly has one.
    Let D be the symmetric difference of a member's set with the hub's. A pair x, y is linked if |Dx ^ Dy| <= c (|x| + |y|)
    with c = (100 - threshold) / (100 + threshold). In a pair of different components one, x, is not linked with the hub itself:
    |Dx| > c (|x| + |hub|). As |y| <= |hub| + |Dy|, the pair shares over (|Dx| - c (|x| + |hub|) + (1 - c) |Dy|) / 2 elements of
    its differences, hence at least (|Dx| - c (|x| + |hub|)) / (1 + c) and more than (1 - c) |Dy| / 2. So in any common order the
    first |Dx| + 1 - bound elements of x and of y meet; the order is rarest first, where edits of a member's own come first.
    Where they meet first, at places i and j, they can share 1 + min(|Dx| - i, |Dy| - j) elements at most; where that is too
    few, as it is for most pairs of near copies of one text, the pair is not made.
    """
    c = (100 - threshold) / (100 + threshold)
    of = lambda p, r: roots.select(F.col("node").alias(p), F.col("root").alias(r))
    parents = first.groupBy("a").agg(F.max("hub").alias("hub")).select(F.col("a").alias("b"), (-F.col("hub.low")).alias("p"))
    parents = first.select("b").distinct().join(parents, "b", "left").select("b", F.coalesce("p", "b").alias("p"))
    for _ in range(3):
        parents = parents.join(parents.select(F.col("b").alias("p"), F.col("p").alias("q")), "p").select("b", F.col("q").alias("p"))
    parents = materialize(parents, "nd-parents")
    members = first.select("a", "b").join(parents, "b").select("a", "p").union(parents.select(F.col("b").alias("a"), "p"))
    members = members.where("a <> p").select("a", F.col("p").alias("b")).distinct()
    placed = members.join(of("a", "ra"), "a", "left").join(of("b", "rb"), "b", "left").select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"))
    placed = materialize(placed, "nd-placed")
    hubs = _hot(placed, ["b"])
    members = _joined(placed, ["b"], "a", placed.where("ra <> rb").select("b").distinct(), hubs)
    grams = lambda p: sets.select(F.col("rep").alias(p), F.col("grams").alias(f"g_{p}"))
    members = _joined(members, ["b"], "a", grams("b"), hubs).join(grams("a"), "a")
    members = members.select("a", "b", "ra", F.size("g_a").alias("n"), F.size("g_b").alias("nb"), F.concat(F.array_except("g_a", "g_b"), F.array_except("g_b", "g_a")).alias("d"))
    members = members.withColumn("m", F.size("d")).withColumn("over", F.col("m") - c * (F.col("n") + F.col("nb")))
    spread = materialize(members.select("a", "b", "ra", "n", "m", "over", F.explode("d").alias("gram")), "nd-spread")
    spread = _joined(spread, ["b", "gram"], "a", spread.groupBy("b", "gram").agg(F.count("*").alias("df")), _hot(spread, ["b", "gram"]))
    spread = spread.withColumn("place", F.row_number().over(Window.partitionBy("b", "a").orderBy("df", "gram")))
    meets = spread.where(F.col("place") <= F.col("m") - F.floor((1 - c) / 2 * F.col("m") - 1e-9))
    outside = spread.where((F.col("over") > -1e-9) & (F.col("place") <= F.col("m") + 1 - F.greatest(F.lit(1), F.ceil(F.col("over") / (1 + c) - 1e-9))))
    side = lambda rows, p: rows.select("b", "gram", *(F.col(k).alias(k + p) for k in ("a", "ra", "n", "m", "place")))
    shared = (F.col("mx") + F.col("my") - c * (F.col("nx") + F.col("ny"))) / 2
    most = 1 + F.least(F.col("mx") - F.col("placex"), F.col("my") - F.col("placey"))
    sized = 100 * F.least("nx", "ny") >= threshold * F.greatest("nx", "ny")
    pairs = side(outside, "x").join(side(meets, "y"), ["b", "gram"]).where((F.col("rax") != F.col("ray")) & sized & (shared <= most + 1e-9))
    return pairs.select(F.greatest("ax", "ay").alias("a"), F.least("ax", "ay").alias("b")).distinct()


def _sql(size: int, threshold: int) -> str:
    """The same in DuckDB by counting common shingles of all pairs that share one; for tables whose doc_ids differ."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {size - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size - 2}, 2))) AS i FROM words WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {threshold} * (x.n + y.n - i)),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT id, b FROM reach JOIN links ON a = other),
roots AS (SELECT id, min(other) AS root FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, d.doc_id = root AS kept FROM documents d JOIN roots ON id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


ORACLE_SQL = _sql(4, 80)
