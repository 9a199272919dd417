"""Embedding near-dedup by PCA-ordered tiled comparison.

Unit vectors are turned onto the principal axes of all of them, the axis of most weight first, which leaves every
cosine as it was. A label's vectors, one row for equal ones, are dealt along the leading axis into tiles of a bounded number; two tiles
whose stretches lie farther apart than linked vectors can are never paired, every other pair of a label's tiles is one group
of a Spark shuffle. Inside it blocks accumulate the products of the leading components first; what the
others can add is bounded by the product of the two suffix norms, and a pair of vectors is dropped as soon as
sum and bound together miss the threshold. What is left at the last axis is a link, decided
by the vectors themselves where rounding could matter.

A pair of tiles tells of each vector how many it is linked with and one member of its component there, so the rows
that leave grow with the vectors and not with the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from convoy.llm.common import stage
from convoy.llm.components import components

SIMILARITY = 0.93
#: Components in a tile: 32768 vectors of 64, 16 MB.
TILE_COMPONENTS = 1 << 21
#: Vectors on either side of a block, and the axes after which bounds are looked at (then doubled up to the last).
BLOCK, LEADING = 1024, 8
#: Stretches of the leading axis in which vectors are counted before they are dealt.
BINS = 4096
#: Far above what rounding adds to a cosine of rotated unit vectors, far below what tells vectors apart.
SLACK = 1e-9
#: Share of a block up to which the open pairs are followed one by one.
SPARSE = 1 / 32


def linkable(label: str, vector: str) -> Column:
    """True where label and vector are there, and all components are finite and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(label).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that no square overflows or vanishes."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def by_width(column: pa.Array, rows: int = 4096) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, vectors as a matrix) of a list column, ``rows`` at a time."""
    for at in range(0, len(column), rows):
        part = column.slice(at, rows)
        flat, ends = part.values.to_numpy(zero_copy_only=False), part.offsets.to_numpy()
        size = np.diff(ends)
        for width in np.unique(size).tolist():
            mine = np.flatnonzero(size == width)
            yield width, mine + at, flat[ends[mine][:, None] + np.arange(width)]


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors the axes of their unit vectors' second moments as columns, the weightiest first.

    A task sends one row per pair of components; what comes to the driver is bounded by the square of the length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, _, vectors in by_width(batch["vector"]):
                u = units(vectors)
                moments[width] = moments.get(width, 0) + u.T @ u
        for width, m in moments.items():
            i, j = np.triu_indices(width)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), width)), pa.array(i), pa.array(j), pa.array(m[i, j])], ["width", "i", "j", "m"])

    sums = classes.select("vector").mapInArrow(run, "width long, i long, j long, m double")
    found = sums.groupBy("width", "i", "j").agg(F.sum("m").alias("m")).toArrow()
    width, i, j, m = (found[c].to_numpy() for c in ("width", "i", "j", "m"))
    out = {}
    for w in np.unique(width).tolist():
        mine, moment = width == w, np.zeros((w, w))
        moment[i[mine], j[mine]] = moment[j[mine], i[mine]] = m[mine]
        out[w] = np.ascontiguousarray(np.linalg.eigh(moment)[1][:, ::-1])
    return out


def placed(classes: DataFrame, axes) -> DataFrame:
    """Classes with the length of their vector and its bin on the leading axis."""

    @F.arrow_udf("int")
    def bin_of(vectors: pa.Array) -> pa.Array:
        out = np.zeros(len(vectors), np.int64)
        for width, rows, v in by_width(vectors):
            out[rows] = np.clip((units(v) @ axes.value[width][:, 0] + 1) * (BINS / 2), 0, BINS - 1)
        return pa.array(out, pa.int32())

    return classes.withColumns({"width": F.size("vector"), "bin": bin_of("vector")})


def dealt(bins: DataFrame, tile_components: int) -> DataFrame:
    """From (label, width, bin, n): the bin's first tile, and how many tiles its vectors are spread over.

    Neighbouring bins share a tile while they fit; a bin of more vectors than a tile holds has tiles of its own.
    """
    most = F.greatest(F.lit(tile_components) / F.col("width"), F.lit(64)).cast("long")
    along = Window.partitionBy("label", "width").orderBy("bin")
    sized = bins.withColumn("_pieces", F.greatest(F.ceil(F.col("n") / most), F.lit(1)).cast("long"))
    # places are counted in tile sizes; a bin of several pieces takes whole ones
    room = F.when(F.col("_pieces") > 1, F.col("_pieces") * most).otherwise(F.col("n"))
    sized = sized.withColumn("_stop", F.sum(room).over(along)).withColumn("_start", F.col("_stop") - room)
    first = F.when(F.col("_pieces") > 1, F.ceil(F.col("_start") / most) * 2 + 1).otherwise(F.floor(F.col("_start") / most) * 2)
    return sized.select("label", "width", "bin", first.cast("long").alias("first"), F.col("_pieces").alias("pieces"))


def tile_pairs(bins: DataFrame, similarity: float) -> DataFrame:
    """(label, width, tile, a, b) for every pair a <= b of a label's tiles that lie near enough, one row per side of it."""
    tiles = (
        bins.withColumn("tile", F.explode(F.sequence("first", F.col("first") + 2 * (F.col("pieces") - 1), F.lit(2).cast("long"))))
        .groupBy("label", "width", "tile")
        .agg(F.min("bin").alias("low"), F.max("bin").alias("high"))
    )
    # unit vectors with that cosine are at most so far apart, along any axis; a bin more on either side for rounding
    reach = int(np.ceil((2 - 2 * similarity) ** 0.5 * BINS / 2)) + 2
    a, b = tiles.alias("a"), tiles.alias("b")
    near = (F.col("b.low") <= F.col("a.high") + reach) & (F.col("a.low") <= F.col("b.high") + reach)
    same = (F.col("a.label") == F.col("b.label")) & (F.col("a.width") == F.col("b.width"))
    pairs = a.join(b, same & near & (F.col("a.tile") <= F.col("b.tile"))).select("a.label", "a.width", F.col("a.tile").alias("a"), F.col("b.tile").alias("b"))
    sides = F.array_distinct(F.array("a", "b"))
    return pairs.select("label", "width", F.explode(sides).alias("tile"), "a", "b")


class Side:
    """A tile's rotated unit vectors and the norms of what follows each cut of the axes."""

    def __init__(self, vectors: np.ndarray, axes: np.ndarray):
        self.vectors = vectors
        self.unit = units(vectors) @ axes
        width = axes.shape[0]
        self.cuts = [min(LEADING, width)]
        while self.cuts[-1] < width:
            self.cuts.append(min(2 * self.cuts[-1], width))
        square = np.cumsum((self.unit * self.unit)[:, ::-1], axis=1)[:, ::-1]
        self.rest = {c: np.sqrt(square[:, c]) if c < width else np.zeros(len(vectors)) for c in self.cuts}


def block_links(a: Side, b: Side, rows: slice, columns: slice, similarity: float, upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of a block, as places in the two tiles; of a block with itself those above the diagonal."""
    floor = similarity - SLACK
    have, total, i, j = 0, None, None, None
    for cut in a.cuts:
        x, y = a.unit[rows, have:cut], b.unit[columns, have:cut]
        if i is None:
            part = x @ y.T
            total = part if total is None else np.add(total, part, out=total)
            open_ = total + np.outer(a.rest[cut][rows], b.rest[cut][columns]) >= floor
            if upper:
                open_ = np.triu(open_, 1)
            if np.count_nonzero(open_) <= SPARSE * open_.size or cut == a.cuts[-1]:
                i, j = np.nonzero(open_)
                total = total[i, j]
        else:
            total = total + np.einsum("ij,ij->i", x[i], y[j])
            keep = total + a.rest[cut][rows][i] * b.rest[cut][columns][j] >= floor
            i, j, total = i[keep], j[keep], total[keep]
        if i is not None and not len(i):
            break
        have = cut
    i, j = i + rows.start, j + columns.start
    close = np.flatnonzero(total < similarity + SLACK)
    keep = np.ones(len(i), bool)
    for at in range(0, len(close), BLOCK * LEADING):
        some = close[at : at + BLOCK * LEADING]
        keep[some] = cosine(a.vectors[i[some]].astype(np.float64), b.vectors[j[some]].astype(np.float64)) >= similarity
    return i[keep], j[keep]


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    dot = lambda p, q: np.einsum("ij,ij->i", p, q)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        plain = dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y)))
    odd = ~np.isfinite(plain)
    if odd.any():
        plain[odd] = dot(units(x[odd]), units(y[odd]))
    return plain


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least number of each number's component under the links u-v."""
    root = np.arange(n)
    while len(u):
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[u] != root[v]
        u, v = u[open_], v[open_]
    return root


def _spans(n: int) -> list[slice]:
    return [slice(k, min(k + BLOCK, n)) for k in range(0, n, BLOCK)]


def compared(a: Side, b: Side | None, weight: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of two tiles (or one with itself): each vector's number of linked ones, by their weights, and its least companion.

    Vectors of the second tile are numbered after those of the first.
    """
    here = len(a.unit)
    shift = here if b is not None else 0
    other = a if b is None else b
    n = here + (len(b.unit) if b is not None else 0)
    links, root = np.zeros(n, np.int64), np.arange(n)
    for rows in _spans(here):
        for columns in _spans(len(other.unit)):
            if b is None and columns.start < rows.start:
                continue
            i, j = block_links(a, other, rows, columns, similarity, b is None and columns == rows)
            if not len(i):
                continue
            j = j + shift
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            u, v = root[i], root[j]
            open_ = u != v
            if open_.any():
                root = roots(n, u[open_], v[open_])[root]
    return links, root


LINKS = "node long, root long, links long"


def tile_links(rows: DataFrame, axes, similarity: float) -> DataFrame:
    """(node, root, links) of every vector with links in a pair of tiles; rows: label, width, a, b, tile, node, copies, vector."""

    def run(group: pa.Table) -> pa.Table:
        first, second = group["a"][0].as_py(), group["b"][0].as_py()
        tile = group["tile"].to_numpy()
        order = np.argsort(tile != first, kind="stable")
        node, weight = group["node"].to_numpy()[order], group["copies"].to_numpy()[order]
        here = int((tile == first).sum())
        width = group["width"][0].as_py()
        vectors = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in group["vector"].chunks]).reshape(-1, width)[order]
        a = Side(vectors[:here], axes.value[width])
        b = Side(vectors[here:], axes.value[width]) if second != first else None
        links, root = compared(a, b, weight, similarity)
        linked = np.flatnonzero(links)
        return pa.table([pa.array(node[linked]), pa.array(node[root[linked]]), pa.array(links[linked])], ["node", "root", "links"])

    return rows.groupBy("label", "width", "a", "b").applyInArrow(run, LINKS)


def near_vectors(
    vectors: DataFrame, similarity: float = SIMILARITY, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    tile_components: int = TILE_COMPONENTS,
) -> DataFrame:
    """Per row: vec_id (a long), n_links, component_id, kept.

    Two vectors are linked if their labels are equal and not null, their lengths are equal, and their cosine in double precision is
    ``similarity`` (above 0) or more. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so
    do those without a label. n_links counts the other rows linked directly, copies of the vector among them; component_id is
    the least vec_id reachable, and kept tells whether it is the row's own. Rows are vectors, repeated ones and those of one
    vec_id too; a null vec_id is never the least one of several and is kept only where no other is in its component. An empty table gives no rows.
    Extra columns are not read.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")
    ).withColumn("_links", linkable("label", "vector"))
    some = rows.where("_links").select("vec_id", "label", "vector")
    classes = some.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    axes = vectors.sparkSession.sparkContext.broadcast(principal_axes(classes))
    turned = placed(classes, axes)
    bins = stage(dealt(turned.groupBy("label", "width", "bin").agg(F.count("*").alias("n")), tile_components), "bins")
    piece = F.pmod(F.xxhash64("node"), F.col("pieces"))
    tiled = turned.join(bins, ["label", "width", "bin"]).withColumn("tile", F.col("first") + 2 * piece)
    paired = tiled.join(tile_pairs(bins, similarity), ["label", "width", "tile"])
    found = stage(tile_links(paired.select("label", "width", "a", "b", "tile", "node", "copies", "vector"), axes, similarity), "links")
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of_class = classes.select("label", "vector", "node", "least", "copies").join(degree, "node", "left").join(joined, "node", "left")
    of_class = of_class.withColumn("component", F.coalesce("component", "node"))
    least = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    # the hash leads, so that sorting and dealing rarely look at the vectors
    known = of_class.join(least, "component").select(
        F.xxhash64("label", "vector").alias("_hash"), F.col("label").alias("_label"), F.col("vector").alias("_vector"), links.alias("n_links"), "component_id"
    )
    rows = rows.withColumn("_h", F.when(F.col("_links"), F.xxhash64("label", "vector")))
    same = (F.col("_h") == F.col("_hash")) & (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector"))
    # a null component stands for rows whose ids are all null
    component = F.when(F.col("_hash").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.join(known, same, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
