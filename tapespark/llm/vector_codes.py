"""Product codes of vectors: exact integer k-means per part over metric trees (anchors hierarchy).

Shape of the job (``quantize``):

1. one pass over the vectors writes blocks of about ``BLOCK_BYTES`` of integer components with a metric tree for each part.
   A tree is built middle-out: about sqrt(n) anchors, each owning the points nearer to it than to the others (a point within
   half the distance between two anchors of its own is never compared with the new one), are balls in the middle of the tree;
   balls are merged upwards, always the two whose union is smallest, and each anchor's points are divided downwards in the
   same way. A ball keeps the sum of its points, their range (so their count) and its radius;
2. each round reads the blocks. A ball inherits its parent's list of candidate entries and strikes off those that are farther
   than its best one for every point it could hold; a ball with one candidate left is wholly owned, and its cached sum and
   count are added without looking at its points. Points of the smallest balls are compared with what is left, in integers;
3. a task adds up its blocks, Spark adds up the tasks; the driver holds the codebooks, whose size is that of the parameters;
4. a last pass over the same blocks gives codes and errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize

BLOCK_BYTES = 2 << 20
#: A ball of at most so many points is not divided.
LEAF = 48
#: Components stop at this size, so that sums of squares stay exact.
MOST = 1 << 25
#: Labels that are sent to all tasks; more of them are joined, large ones dealt to several tasks.
MOST_SENT, HOT = 100_000, 10_000


def _anchors(x: np.ndarray, k: int) -> np.ndarray:
    """The owner of each point among at most ``k`` anchors; each new anchor is the point farthest from its own."""
    far = ((x - x[0]) ** 2).sum(1)
    owner, at = np.zeros(len(x), np.int64), [0]
    while len(at) < k:
        new = int(far.argmax())
        if not far[new]:
            break
        between = ((x[at] - x[new]) ** 2).sum(1)
        open_ = np.flatnonzero(4 * far > between[owner])  # nearer to its anchor than half the way: stays
        d = ((x[open_] - x[new]) ** 2).sum(1)
        won = d < far[open_]
        owner[open_[won]], far[open_[won]] = len(at), d[won]
        at.append(new)
    return owner


class _Growth:
    """Balls as they are made: children, or the points of a leaf."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.children, self.points = x, [], []

    def add(self, children: tuple[int, int] | None, points: np.ndarray | None) -> int:
        self.children.append(children)
        self.points.append(points)
        return len(self.children) - 1

    def grow(self, points: np.ndarray) -> int:
        if len(points) <= LEAF:
            return self.add(None, points)
        owner = _anchors(self.x[points], int(len(points) ** 0.5) + 1)
        order = np.argsort(owner, kind="stable")
        parts = np.split(points[order], np.flatnonzero(np.diff(owner[order])) + 1)
        if len(parts) == 1:  # all points are equal
            return self.add(None, points)
        n = np.array([len(p) for p in parts], float)
        centre = np.array([self.x[p].sum(0) / len(p) for p in parts])
        radius = np.array([((self.x[p] - c) ** 2).sum(1).max() ** 0.5 for p, c in zip(parts, centre, strict=True)])
        return self.merged([self.grow(p) for p in parts], n, centre, radius)

    def merged(self, balls: list[int], n: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> int:
        def joint(i: int) -> np.ndarray:
            """Radius of the union of ball i with each other one."""
            apart = np.sqrt(((centre - centre[i]) ** 2).sum(1))
            out = np.maximum(apart * n / (n + n[i]) + radius[i], apart * n[i] / (n + n[i]) + radius)
            out[gone] = out[i] = np.inf
            return out

        gone = np.zeros(len(balls), bool)
        wide = np.array([joint(i) for i in range(len(balls))])
        for _ in range(len(balls) - 1):
            i, j = divmod(int(wide.argmin()), len(balls))
            balls[i], r = self.add((balls[i], balls[j]), None), wide[i, j]
            centre[i] = (n[i] * centre[i] + n[j] * centre[j]) / (n[i] + n[j])
            radius[i], gone[j] = r, True
            n[i] += n[j]
            wide[j] = wide[:, j] = np.inf
            wide[i] = wide[:, i] = joint(i)
        return balls[i]


def _node(width: int) -> np.dtype:
    return np.dtype([("left", "<i4"), ("right", "<i4"), ("start", "<i4"), ("stop", "<i4"), ("radius", "<f8"), ("sum", "<i8", (width,))])


def build_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the points, balls; the root first). The points of a ball are a range of the order."""
    growth = _Growth(x)
    root = growth.grow(np.arange(len(x)))
    out, order, todo, number = np.zeros(len(growth.children), _node(x.shape[1])), [], [root], {}
    while todo:  # children after their parents, left before right
        k = todo.pop()
        number[k] = len(number)
        if growth.children[k]:
            todo += reversed(growth.children[k])
        else:
            order.append(growth.points[k])
    at, stops = 0, {}
    for k in reversed(number):
        if growth.children[k] is None:
            stops[k] = len(growth.points[k])
        else:
            stops[k] = stops[growth.children[k][0]] + stops[growth.children[k][1]]
    order = np.concatenate(order)
    sums = np.concatenate((np.zeros((1, x.shape[1]), np.int64), np.cumsum(x[order], 0)))
    begin = {root: 0}
    for k, at in number.items():
        a, b = begin[k], begin[k] + stops[k]
        pair = growth.children[k]
        if pair:
            begin[pair[0]], begin[pair[1]] = a, a + stops[pair[0]]
        total = sums[b] - sums[a]
        radius = ((x[order[a:b]] - total / (b - a)) ** 2).sum(1).max() ** 0.5
        out[at] = (number[pair[0]] if pair else -1, number[pair[1]] if pair else -1, a, b, radius, total)
    return order, out


def assign(x: np.ndarray, nodes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry of each point, points of each entry, their sums); ties go to the lower entry.

    ``x``: the points in the tree's order. A candidate c of a ball with centre m and radius r goes if |m-c|^2 - |m-b|^2 > 2 r |b-c|
    for its best candidate b: then c is farther than b from each point of the ball. The margin left for rounding only keeps
    candidates. An entry that repeats an earlier one never wins a tie and is no candidate.
    """
    place, n_entries = entries.astype(float), len(entries)
    gap = np.sqrt(((place[:, None] - place) ** 2).sum(-1))
    scale = 1e-9 * (1 + max(np.abs(place).max(), np.abs(x).max()))
    first = np.ones(n_entries, bool)
    first[1:] = [not (entries[:k] == entries[k]).all(1).any() for k in range(1, n_entries)]
    found = np.empty(len(x), np.int64)
    count, total = np.zeros(n_entries, np.int64), np.zeros(entries.shape, np.int64)
    front, mask, leaves, left_over = np.zeros(1, np.int64), first[None].copy(), [], []
    while len(front):
        ball = nodes[front]
        centre = ball["sum"] / (ball["stop"] - ball["start"])[:, None]
        d = ((centre[:, None] - place) ** 2).sum(-1)
        best = np.where(mask, d, np.inf).argmin(1)
        least = d[np.arange(len(d)), best][:, None]
        mask &= d - least <= 2 * (ball["radius"] * (1 + 1e-9) + scale)[:, None] * gap[best] + 1e-12 * (d + least)
        owned = mask.sum(1) == 1
        for a, b, e in zip(ball["start"][owned].tolist(), ball["stop"][owned].tolist(), best[owned].tolist(), strict=True):
            found[a:b] = e
        np.add.at(count, best[owned], (ball["stop"] - ball["start"])[owned])
        np.add.at(total, best[owned], ball["sum"][owned])
        leaf, inner = ~owned & (ball["left"] < 0), ~owned & (ball["left"] >= 0)
        leaves.append(front[leaf])
        left_over.append(mask[leaf])
        front = np.concatenate((ball["left"][inner], ball["right"][inner]))
        mask = np.concatenate((mask[inner], mask[inner]))
    leaves, left_over = np.concatenate(leaves), np.concatenate(left_over)
    if len(leaves):
        size = (nodes["stop"] - nodes["start"])[leaves]
        of = np.repeat(np.arange(len(leaves)), size)  # the leaf of each open point
        point = nodes["start"][leaves][of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        each = left_over.sum(1)
        entry = np.nonzero(left_over)[1]
        begin = np.concatenate(([0], np.cumsum(each[of])))
        pair_of = np.repeat(np.arange(len(of)), each[of])
        pair = entry[(np.cumsum(each) - each)[of][pair_of] + np.arange(begin[-1]) - begin[:-1][pair_of]]
        d = np.zeros(len(pair), np.int64)
        for j in range(x.shape[1]):
            d += (x[point, j][pair_of] - entries[pair, j]) ** 2
        hit = np.flatnonzero(d == np.minimum.reduceat(d, begin[:-1])[pair_of])
        nearest = pair[hit[np.searchsorted(hit, begin[:-1])]]
        found[point] = nearest
        count += np.bincount(nearest, minlength=n_entries)
        np.add.at(total, nearest, x[point])
    return found, count, total


def _build(parts: int, width: int, length: int, scale: float):
    most = max(64, BLOCK_BYTES // (8 * parts * width))

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        n = len(rows)
        raw = rows.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        x = np.zeros((n, parts * width), np.int64)
        with np.errstate(over="ignore"):
            x[:, :length] = np.clip(np.floor(raw * scale), -MOST, MOST).reshape(n, length)
        trees = [build_tree(x[:, p * width : (p + 1) * width]) for p in range(parts)]
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), values.combine_chunks())
        return pa.RecordBatch.from_arrays(
            [
                one(rows.column(0)),
                one(rows.column(1)),
                pa.array([x.astype("<i4").tobytes()], pa.binary()),
                pa.array([b"".join(order.astype("<i4").tobytes() for order, _ in trees)], pa.binary()),
                pa.array([[nodes.tobytes() for _, nodes in trees]], pa.list_(pa.binary())),
            ],
            ["ids", "labels", "points", "orders", "trees"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            a = 0
            while a < batch.num_rows:
                b = min(batch.num_rows, a + most - n)
                held.append(batch.slice(a, b - a))
                n, a = n + b - a, b
                if n == most:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return run


def _trees(batches: Iterator[pa.RecordBatch], parts: int, width: int, at: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Each block: its batch and row, the points, the parts' orders and trees; their columns begin at ``at``."""
    for batch in batches:
        for k in range(batch.num_rows):
            x = np.frombuffer(batch.column(at)[k].as_buffer(), "<i4").astype(np.int64).reshape(-1, parts * width)
            orders = np.frombuffer(batch.column(at + 1)[k].as_buffer(), "<i4").reshape(parts, len(x))
            yield batch, k, x, orders, [np.frombuffer(t.as_buffer(), _node(width)) for t in batch.column(at + 2)[k].values]


def _sums(books: np.ndarray):
    parts, n_entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, n_entries, width + 1), np.int64)
        for _, _, x, orders, trees in _trees(batches, parts, width, 0):
            for p in range(parts):
                _, count, total = assign(x[orders[p], p * width : (p + 1) * width], trees[p], books[p])
                sums[p, :, 0] += count
                sums[p, :, 1:] += total
        cells = np.flatnonzero(sums.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(sums.ravel()[cells])], ["cell", "value"])

    return run


def _codes(books: np.ndarray):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k, x, orders, trees in _trees(batches, parts, width, 2):
            code, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                code[orders[p], p] = assign(own[orders[p]], trees[p], books[p])[0]
                error += ((own - books[p][code[:, p]]) ** 2).sum(1)
            text = code.tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[k].values, batch.column(1)[k].values, pa.array([text[2 * parts * i : 2 * parts * (i + 1)] for i in range(len(x))], pa.string()), pa.array(error)],
                ["vec_id", "label", "code", "error"],
            )

    return run


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def quantize(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every vector that is kept, and the codebooks (parts x entries x width).

    Takes ``vec_id``, ``embedding`` (array of float or double) and ``label``; further columns of ``vectors`` are not looked at.
    A row whose vector is null, empty, or holds null or non-finite components goes, and so does one whose vector is not as long
    as that of the smallest kept vec_id. A length that ``parts`` does not divide is filled with zeros at the end. Components
    floor(``scale`` * x) stop at +-2^25. Rows that repeat an id are vectors of their own; the first entries are the vectors of
    the smallest ids (null ids last; of equal ids the smaller vectors, of equal vectors each). With fewer rows than ``entries``
    there are fewer entries; without rows the result is empty. At most 256 entries (two hex digits a part).
    """
    if not 0 < entries <= 256:
        raise ValueError("entries: 1 to 256")
    rows = vectors.select("vec_id", "label", "embedding").where(_finite("embedding"))
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(1).first()
    length = len(start["embedding"]) if start else 0
    width = max(1, -(-length // parts))
    rows = rows.where(F.size("embedding") == length)
    first = [r["embedding"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).collect()]
    books = np.zeros((len(first), parts * width), np.int64)
    if first:
        with np.errstate(over="ignore"):
            books[:, :length] = np.clip(np.floor(np.array(first, float) * scale), -MOST, MOST)
    books = np.ascontiguousarray(books.reshape(-1, parts, width).transpose(1, 0, 2))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    blocks = rows.mapInArrow(_build(parts, width, length, scale), f"ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, points binary, orders binary, trees array<binary>")
    blocks = materialize(blocks, "vc-blocks")
    for _ in range(rounds):
        cells = blocks.select("points", "orders", "trees").mapInArrow(_sums(books), "cell long, value long").groupBy("cell").agg(F.sum("value").alias("value"))
        sums = np.zeros(books.size + books[:, :, 0].size, np.int64)
        for cell, value in cells.collect():  # as many as the codebooks have numbers
            sums[cell] = value
        sums = sums.reshape(parts, books.shape[1], width + 1)
        used = sums[:, :, 0] > 0
        books[used] = sums[used][:, 1:] // sums[used][:, :1]
    return blocks.mapInArrow(_codes(books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), books


def codebook_digest(books: np.ndarray) -> str:
    """sha256 of all components, comma-joined, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error: the errors of all rows of the same label, null being one; null where they exceed a long.

    ``coded`` is read twice, so it should be a written table.
    """
    totals = materialize(coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")), "vc-labels")
    of = totals.select(F.col("label").alias("__of"), "label_error", (F.col("n") / HOT).cast("int").alias("__parts"))
    if totals.count() <= MOST_SENT:
        return coded.join(F.broadcast(of.drop("__parts")), F.col("label").eqNullSafe(F.col("__of"))).drop("__of")
    # the rows of a large label are dealt to several tasks, each with a copy of its total
    large = of.where("__parts > 0").select(F.col("__of").alias("__large"), F.col("__parts").alias("__deal"))
    large = F.broadcast(large) if large.count() <= MOST_SENT else large
    dealt = coded.join(large, F.col("label").eqNullSafe(F.col("__large")), "left").withColumn("__part", F.pmod(F.xxhash64("vec_id", "code"), F.coalesce("__deal", F.lit(0)) + 1))
    of = of.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__parts"))))
    return dealt.join(of, F.col("label").eqNullSafe(F.col("__of")) & (F.col("__part") == F.col("__copy"))).select(*coded.columns, "label_error")


def digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector (see ``quantize``)."""
    coded, books = quantize(vectors)
    out = with_label_error(materialize(coded, "vc-codes"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))


def _sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The same in DuckDB by comparing every part with every entry; for tables whose ids differ and whose vectors are of one length."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS (SELECT vec_id, p, min(d * 256 + e) AS best FROM (SELECT vec_id, a.p, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d FROM parts a JOIN book{k} b ON a.p = b.p) GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""cells{k} AS (SELECT p, best % 256 AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT p, best, x, unnest(range(1, len(x) + 1)) AS i FROM near{k} JOIN parts USING (vec_id, p)) GROUP BY ALL),
book{k + 1} AS (SELECT p, e, coalesce(u, c) AS c FROM book{k} LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS u FROM cells{k} GROUP BY ALL) USING (p, e))""")
    return f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM (SELECT *, unnest(range({parts})) AS p FROM kept)),
book0 AS (SELECT p, (place - 1)::BIGINT AS e, x AS c FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS place FROM parts) WHERE place <= {entries}),
{", ".join(steps)},
coded AS (SELECT vec_id, string_agg(lower(format('{{:02x}}', best % 256)), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256 FROM coded JOIN kept USING (vec_id)"""


ORACLE_SQL = _sql()
