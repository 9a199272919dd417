"""Embedding near-dedup against the cosines of all pairs."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from convoy.llm import embedding_near as near
from convoy.llm.queries import op13_embedding_near

SCHEMA = "vec_id long, embedding array<float>, label int, component_id string, links long, node string"


def plainly(rows, similarity=near.SIMILARITY):
    """(vec_id, n_links, component_id, kept) of every row by the definition."""
    sound = [
        r[2] is not None and bool(r[1]) and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows
    ]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, v, lab) in enumerate(rows):
        for j in range(i):
            if sound[i] and sound[j] and rows[j][2] == lab and len(rows[j][1]) == len(v):
                x, y = np.array(v, np.float64), np.array(rows[j][1], np.float64)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if rows[j][1] == v or x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= similarity:
                    links[i] += 1
                    links[j] += 1
                    parent[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return Counter((r[0], links[i], least.get(top(i)), r[0] == least.get(top(i))) for i, r in enumerate(rows))


def awkward():
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (30, 12))
    near_ones = base[rng.integers(0, 30, 200)] + rng.normal(0, 0.25, (200, 12))  # about the threshold
    chain = np.stack([np.concatenate([[math.cos(t / 4), math.sin(t / 4)], np.zeros(10)]) for t in range(12)])  # neighbours only
    vectors = np.float32(np.concatenate([base, near_ones, chain, np.eye(12), base[:5] * 1e30, base[:5] * 1e-30]))
    rows = [(5000 - 3 * i, [float(x) for x in v], int(i % 2) if i < 230 else 3) for i, v in enumerate(vectors)]
    copies = [(i, rows[0][1], 0) for i in range(60)]
    v = rows[8][1]
    bad = [None, [], [0.0] * 12, [-0.0] * 12, [None, *v[1:]], [math.nan, *v[1:]], [math.inf, *v[1:]], v[:6], v[:6]]
    rows += copies + [(7000 + i, b, 0) for i, b in enumerate(bad)] + [(8000, v, None), (8001, v, None)]
    return [*rows, (None, v, 0), (None, [-x for x in v], 0), rows[8], rows[8], (rows[8][0], rows[9][1], 1)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("tile_components", [near.TILE_COMPONENTS, 64])
def test_against_all_pairs(spark, monkeypatch, tile_components):
    monkeypatch.setattr(near, "BLOCK", 16 if tile_components == 64 else near.BLOCK)
    rows = awkward()
    out = near.near_vectors(table(spark, rows), tile_components=tile_components)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert Counter(map(tuple, out.collect())) == plainly(rows)


def test_many_copies_and_near_copies_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 32)
    rng = np.random.default_rng(9)
    group = np.float32(rng.normal(0, 1, 8) + rng.normal(0, 0.02, (300, 8)))
    rows = [(i, [float(x) for x in group[max(i, 100)]], 4) for i in range(300)]
    got = near.near_vectors(table(spark, rows), tile_components=64 * 8).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(299, 0)} and sum(r.kept for r in got) == 1


def test_far_tiles_are_not_paired(spark):
    """Opposite ends of the leading axis: only tiles within reach of one another meet."""
    angles = np.linspace(0, math.pi, 1500)
    rows = [(i, [float(np.float32(math.cos(t))), float(np.float32(math.sin(t)))], 1) for i, t in enumerate(angles)]
    classes = table(spark, rows).selectExpr("label", "embedding AS vector")
    axes = spark.sparkContext.broadcast(near.principal_axes(classes))
    counted = near.placed(classes, axes).groupBy("label", "width", "bin").count().withColumnRenamed("count", "n")
    bins = near.dealt(counted, 128)
    tiles = bins.groupBy("first").count().count()
    pairs = near.tile_pairs(bins, 0.93).select("a", "b").distinct().count()
    assert tiles > 20 and pairs < tiles * tiles / 4
    got = Counter(map(tuple, near.near_vectors(table(spark, rows), tile_components=128).collect()))
    assert {r[2] for r in got} == {0} and len(got) == 1500


def test_empty(spark):
    assert near.near_vectors(table(spark, awkward()[:1]).limit(0)).count() == 0
    lone = near.near_vectors(table(spark, [(1, None, 1), (2, [1.0], None)])).collect()
    assert Counter(map(tuple, lone)) == Counter([(1, 0, 1, True), (2, 0, 2, True)])


def test_the_query_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{sf}/embeddings.parquet'").fetchall()
    assert Counter(map(tuple, op13_embedding_near(spark, sf).collect())) == plainly(rows)
