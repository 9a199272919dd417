"""Vector code compression: product codes whose codebooks are refined over metric trees.

A vector is cut into parts; every part position has a codebook. Points of one part position, a few thousand vectors at a
time, are held in a tree of balls built from the middle out: about the square root of their number of anchors share the points out by the
triangle inequality, the anchors' balls are merged upwards by least radius, and each anchor is divided downwards
in the same way. A ball keeps its pivot, radius, and the sum and number of its points. Assigning
walks down with the codebook's entries as candidates: an entry that another one beats at every point of
a ball is struck from the list that the ball's children inherit. A ball with one candidate left is owned
as a whole and adds its cached sums; only in leaves are points looked at one by one.

Trees are built once where the rows lie, stored, and walked once per round; a round sends
one row per part, entry and task. All counts, sums and compared distances are integers, so neither the trees' shape nor the
partitioning shows in the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from convoy.llm.common import stage

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components of the vectors in one set of trees: 8192 vectors of 64.
TREE_COMPONENTS = 1 << 19
#: Points up to which a ball is a leaf.
LEAF = 40
#: Largest scaled component: squared distances of a part of 64 components still fit a long.
LIMIT = 1 << 27


class Tree:
    """Balls over integer points as arrays; nodes come parents first, and a node's points lie end to end in ``order``."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self._nodes: list[list] = []
        self._order: list[np.ndarray] = []
        self._placed = 0
        if len(points):
            self._build(np.arange(len(points)))
        self.order = np.concatenate(self._order).astype(np.int32) if self._order else np.zeros(0, np.int32)
        columns = list(zip(*self._nodes, strict=True)) if self._nodes else [[]] * 6
        self.pivot = np.array(columns[0], np.int32)  # a point's index
        self.radius2 = np.array(columns[1], np.int64)
        self.first, self.count = np.array(columns[2], np.int32), np.array(columns[3], np.int32)
        # children of a node; -1 in leaves
        self.left = np.array([columns[4], columns[5]], np.int32).reshape(2, -1).T
        sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[self.order], axis=0)])
        self.total = sums[self.first + self.count] - sums[self.first]

    def _far2(self, pivot: int, rows: np.ndarray) -> np.ndarray:
        gap = self.points[rows] - self.points[pivot]
        return np.einsum("ij,ij->i", gap, gap)

    def _anchors(self, rows: np.ndarray, wanted: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(pivot, its points, their squared distances): every point is with its nearest anchor."""
        distance2 = self._far2(rows[0], rows)
        owner = np.zeros(len(rows), np.int64)
        pivots = [int(rows[0])]
        radius2 = [int(distance2.max())]
        while len(pivots) < wanted:
            widest = int(np.argmax(radius2))
            if radius2[widest] == 0:
                break
            mine = np.flatnonzero(owner == widest)
            new = int(rows[mine[np.argmax(distance2[mine])]])
            apart2 = self._far2(new, np.array(pivots))
            # a point nearer to its anchor than half the way to the new one stays
            open_ = np.flatnonzero(4 * distance2 > apart2[owner])
            d2 = self._far2(new, rows[open_])
            won = d2 < distance2[open_]
            at = open_[won]
            losers = np.unique(owner[at])
            owner[at], distance2[at] = len(pivots), d2[won]
            pivots.append(new)
            radius2.append(int(d2[won].max()))
            for k in losers.tolist():
                radius2[k] = int(distance2[owner == k].max())
        by = np.argsort(owner, kind="stable")
        at = np.searchsorted(owner[by], np.arange(len(pivots) + 1))
        return [(p, rows[by[a:b]], distance2[by[a:b]]) for p, a, b in zip(pivots, at, at[1:], strict=False)]

    def _add(self, pivot: int, radius2: int) -> int:
        self._nodes.append([pivot, radius2, 0, 0, -1, -1])
        return len(self._nodes) - 1

    def _leaf(self, pivot: int, rows: np.ndarray, distance2: np.ndarray) -> int:
        node = self._add(pivot, int(distance2.max()))
        self._nodes[node][2:4] = self._placed, len(rows)
        self._order.append(rows)
        self._placed += len(rows)
        return node

    def _build(self, rows: np.ndarray, pivot: int | None = None, distance2: np.ndarray | None = None) -> int:
        """The ball over ``rows``; a ball is numbered before those inside it."""
        if pivot is not None and (len(rows) <= LEAF or not distance2.any()):
            return self._leaf(pivot, rows, distance2)
        anchors = self._anchors(rows, max(2, int(len(rows) ** 0.5)))
        if len(anchors) == 1:
            return self._leaf(*anchors[0])
        return self._emit(self._merged(anchors))

    def _merged(self, anchors: list) -> tuple:
        """Anchors merged two by two, least radius of the enclosing ball first: nested (pivot, radius, children)."""
        balls = [(p, float(d2.max()) ** 0.5, (p, rows, d2)) for p, rows, d2 in anchors]
        centre = self.points[[b[0] for b in balls]].astype(np.float64)
        radius = np.array([b[1] for b in balls])
        weight = np.array([float(len(b[2][1])) for b in balls])
        alive = np.ones(len(balls), bool)
        apart = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(2))
        cost = (apart + radius[:, None] + radius[None]) / 2
        np.fill_diagonal(cost, np.inf)
        for _ in range(len(balls) - 1):
            a, b = divmod(int(np.argmin(cost)), len(balls))
            # pivots stay points: the pivot of the heavier ball serves the merged one
            if weight[b] > weight[a]:
                a, b = b, a
            balls[a] = (balls[a][0], max(radius[a], apart[a, b] + radius[b]), (balls[a], balls[b]))
            radius[a], weight[a], alive[b] = balls[a][1], weight[a] + weight[b], False
            cost[b, :] = cost[:, b] = np.inf
            row = np.where(alive, (apart[a] + radius[a] + radius) / 2, np.inf)
            row[a] = np.inf
            cost[a, :] = cost[:, a] = row
        return balls[int(np.flatnonzero(alive)[0])]

    def _emit(self, ball: tuple) -> int:
        pivot, _, inside = ball
        if len(inside) == 3:
            return self._build(inside[1], pivot, inside[2])
        node, start = self._add(pivot, 0), self._placed
        left, right = self._emit(inside[0]), self._emit(inside[1])
        rows = np.concatenate(self._order[self._pieces(start) :])
        # the true radius over all points, an integer, replaces the bound of the merge
        self._nodes[node][1:] = [int(self._far2(pivot, rows).max()), start, self._placed - start, left, right]
        return node

    def _pieces(self, start: int) -> int:
        """Index in ``_order`` of the piece that begins at place ``start``."""
        at, k = self._placed, len(self._order)
        while at > start:
            k -= 1
            at -= len(self._order[k])
        return k

    def packed(self) -> bytes:
        """Points in the order of the leaves and the balls as bytes."""
        head = np.array([self.points.shape[0], self.points.shape[1], len(self.pivot)], np.int64)
        arrays = (self.points[self.order].astype(np.int32), self.order, self._rank(self.pivot), self.radius2, self.first, self.count, self.left, self.total)
        return b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])

    def _rank(self, rows: np.ndarray) -> np.ndarray:
        place = np.empty(len(self.order), np.int32)
        place[self.order] = np.arange(len(self.order))
        return place[rows]


class Balls:
    """A packed tree, ready to be walked."""

    def __init__(self, packed: bytes):
        n, width, nodes = np.frombuffer(packed, np.int64, 3).tolist()
        at = 24

        def take(dtype, *shape):
            nonlocal at
            size = int(np.prod(shape))
            out = np.frombuffer(packed, dtype, size, at).reshape(shape)
            at += out.nbytes
            return out

        self.points = take(np.int32, n, width).astype(np.int64)
        self.order, self.pivot = take(np.int32, n), take(np.int32, nodes)
        self.radius2 = take(np.int64, nodes)
        self.first, self.count, self.children = take(np.int32, nodes), take(np.int32, nodes), take(np.int32, nodes, 2)
        self.total = take(np.int64, nodes, width)

    def walk(self, book: np.ndarray, owned, looked_at) -> None:
        """Assigns all points: ``owned(nodes, entries)`` for whole balls, ``looked_at(places, entries)`` for single points.

        Level by level; each ball's row of ``open_`` is the list of candidates it inherited.
        """
        nodes = np.zeros(1 if len(self.pivot) else 0, np.int64)
        open_ = np.ones((len(nodes), len(book)), bool)
        norm = (book * book).sum(1)
        apart = np.sqrt(_far2(book, book).astype(np.float64))
        while len(nodes):
            far2 = _far2(self.points[self.pivot[nodes]], book, norm)
            best = np.argmin(np.where(open_, far2, np.iinfo(np.int64).max), 1)
            near2 = np.take_along_axis(far2, best[:, None], 1)
            # entry b loses to a at every point of the ball if it does so at the point of the ball that favours b most
            reach = 2 * np.sqrt(self.radius2[nodes].astype(np.float64))[:, None] * apart[best]
            lost = (far2 - near2).astype(np.float64) > reach * (1 + 1e-9) + 0.5
            # a ball of equal points goes to the nearest entry, the first of equals
            point = self.radius2[nodes] == 0
            open_ &= ~lost & ~(point[:, None] & (np.arange(len(book)) != best[:, None]))
            whole = open_.sum(1) == 1
            if whole.any():
                owned(nodes[whole], best[whole])
            rest, lists = nodes[~whole], open_[~whole]
            leaf = self.children[rest, 0] < 0
            self._leaves(rest[leaf], lists[leaf], book, norm, looked_at)
            nodes = self.children[rest[~leaf]].ravel().astype(np.int64)
            open_ = np.repeat(lists[~leaf], 2, axis=0)

    def _leaves(self, nodes, lists, book, norm, looked_at) -> None:
        size = self.count[nodes].astype(np.int64)
        if not len(nodes):
            return
        places = _spans(self.first[nodes].astype(np.int64), size)
        far2 = _far2(self.points[places], book, norm)
        far2[~np.repeat(lists, size, axis=0)] = np.iinfo(np.int64).max
        looked_at(places, np.argmin(far2, 1))

    def sums(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and number of the points nearest to each entry; ties go to the lower index."""
        total, count = np.zeros_like(book), np.zeros(len(book), np.int64)

        def owned(nodes, entries):
            np.add.at(total, entries, self.total[nodes])
            np.add.at(count, entries, self.count[nodes])

        def looked_at(places, entries):
            np.add.at(total, entries, self.points[places])
            np.add.at(count, entries, 1)

        self.walk(book, owned, looked_at)
        return total, count

    def nearest(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of every point, in the order of the rows that the tree was built of, and its squared distance."""
        entry = np.empty(len(self.points), np.int64)

        def owned(nodes, entries):
            size = self.count[nodes].astype(np.int64)
            entry[_spans(self.first[nodes].astype(np.int64), size)] = np.repeat(entries, size)

        def looked_at(places, entries):
            entry[places] = entries

        self.walk(book, owned, looked_at)
        gap = self.points - book[entry]
        codes, errors = np.empty_like(entry), np.empty_like(entry)
        codes[self.order], errors[self.order] = entry, np.einsum("ij,ij->i", gap, gap)
        return codes, errors


def _far2(a: np.ndarray, b: np.ndarray, norm: np.ndarray | None = None) -> np.ndarray:
    """Squared distances between all rows of two short integer tables."""
    norm = (b * b).sum(1) if norm is None else norm
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + norm


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)


def usable(vector: str | Column, width: int) -> Column:
    """True for vectors of ``width`` components, all of them finite numbers."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == width) & finite, F.lit(False))


def scaled(batch: pa.Array, width: int) -> np.ndarray:
    """Components times SCALE, rounded down."""
    whole = np.floor(batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).reshape(-1, width)
    if whole.size and np.abs(whole).max() >= LIMIT:
        raise ValueError(f"components of {LIMIT / SCALE:g} or more in size leave no room for exact sums")
    return whole.astype(np.int64)


TREES = T.StructType(
    [
        T.StructField("vec_id", T.ArrayType(T.LongType())),
        T.StructField("label", T.ArrayType(T.StringType())),
        T.StructField("trees", T.ArrayType(T.BinaryType())),
    ]
)


def trees(rows: DataFrame, width: int, parts: int = PARTS) -> DataFrame:
    """Rows of some thousand vectors: their ids and labels, and a packed tree for each part position. No shuffle."""
    size = max(TREE_COMPONENTS // width, 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _regrouped(batches, size):
            points = scaled(batch["vector"], width).reshape(batch.num_rows, parts, -1)
            packed = [Tree(np.ascontiguousarray(points[:, p])).packed() for p in range(parts)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch["vec_id"].to_pylist()], pa.list_(pa.int64())), pa.array([batch["label"].to_pylist()], pa.list_(pa.string())),
                    pa.array([packed], pa.list_(pa.binary())),
                ],
                ["vec_id", "label", "trees"],
            )

    return rows.select("vec_id", "label", "vector").mapInArrow(run, TREES)


def _regrouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task in batches of ``size``, the last one shorter."""
    held, have = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size - have)
            held.append(part)
            have += part.num_rows
            at += part.num_rows
            if have == size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, have = [], 0
    if have:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def refined(built: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry replaced by the rounded-down mean of its parts; unused entries stay."""
    spark = built.sparkSession
    shared = spark.sparkContext.broadcast(books)
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(shared.value), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for packed in batch["trees"].to_pylist():
                for p in range(parts):
                    s, n = Balls(packed[p]).sums(shared.value[p])
                    total[p] += s
                    count[p] += n
        part, entry = np.nonzero(count)
        sums = total[part, entry]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), *(pa.array(np.ascontiguousarray(sums[:, k])) for k in range(width))],
            ["part", "entry", "n", *(f"s{k}" for k in range(width))],
        )

    schema = ", ".join(["part int", "entry int", "n long", *(f"s{k} long" for k in range(width))])
    partial = built.select("trees").mapInArrow(run, schema)
    # at most parts x entries rows come back
    found = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)]).collect()
    out = books.copy()
    for r in found:
        out[r.part, r.entry] = [r[f"s{k}"] // r.n for k in range(width)]
    shared.unpersist()
    return out


def coded(built: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector under the final codebooks."""
    shared = built.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = [Balls(t).nearest(shared.value[p]) for p, t in enumerate(batch["trees"][i].as_py())]
                codes = np.stack([f[0] for f in found], 1).astype(np.uint8)
                errors = np.sum([f[1] for f in found], axis=0)
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"][i].values, batch["label"][i].values, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors, pa.int64())],
                    ["vec_id", "label", "code", "error"],
                )

    return built.mapInArrow(run, "vec_id long, label string, code string, error long")


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors, and the codebooks (parts x entries x components, integers scaled by SCALE).

    Rows: vec_id (a long), label (as text), code (two hexadecimal digits per part), error (squared distances summed over parts),
    label_error (error summed over equal labels, nulls together). Left out are vectors that are null, hold null or
    non-finite components, or have another length than that of the least vec_id kept; that length must
    be a multiple of ``parts``, or ValueError is raised, and so it is for components of 2^27 / 256 or more. Codebooks
    start from the ``entries`` least vec_ids (ties by components; null ids last); a smaller table has smaller codebooks.
    Repeated rows are each coded. An empty table gives no rows. Extra columns are not read.
    """
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits a part")
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector")
    )
    sound = rows.where(usable("vector", F.size("vector")) & (F.size("vector") > 0))
    first = sound.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(1).collect()
    width = len(first[0].vector) if first else parts
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    rows = rows.where(usable("vector", width))
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    head = scaled(pa.array([r.vector for r in start], pa.list_(pa.float64())), width)
    books = np.ascontiguousarray(head.reshape(len(start), parts, width // parts).transpose(1, 0, 2))
    built = stage(trees(rows, width, parts), "trees")
    for _ in range(rounds if len(start) else 0):
        books = refined(built, books)
    codes = stage(coded(built, books), "codes")
    by_label = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = codes.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return out, books


def codebook_text(books: np.ndarray) -> str:
    """All entries' components by part, entry and position, joined by commas."""
    return ",".join(map(str, books.ravel().tolist()))


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(codebook_text(books).encode()).hexdigest()
