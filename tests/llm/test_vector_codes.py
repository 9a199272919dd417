"""Vector codes over metric trees against plain refinement of the codebooks."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoy.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, part int"


def plainly(rows, parts=4, entries=8, rounds=2):
    """(vec_id, code, error, label_error) and the codebooks by the definition, point by point."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in kept if len(v) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, x: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            own = [nearest(p, c[p]) for c in cut]
            for e in set(own):
                mine = [c[p] for c, o in zip(cut, own, strict=True) if o == e]
                new[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
        books = new
    codes = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(far(c[p], books[p][e]) for p, e in enumerate(code)) for c, code in zip(cut, codes, strict=True)]
    by_label = Counter()
    for (_, _, lab), e in zip(kept, errors, strict=True):
        by_label[lab] += e
    out = [(i, "".join(f"{e:02x}" for e in code), err, by_label[lab]) for (i, _, lab), code, err in zip(kept, codes, errors, strict=True)]
    return Counter(out), books


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", "e", 1) for r in rows], SCHEMA).repartition(3)


def awkward():
    rng = np.random.default_rng(5)
    vectors = np.float32(rng.normal(0, 0.1, (400, 8)))
    vectors[200:300] = vectors[200]  # many copies
    vectors[300:340, :4] = 0  # equal parts in different vectors
    vectors[340:360] = np.float32(np.round(vectors[340:360] * 8) / 8)  # ties
    rows = [(1000 - i, [float(x) for x in v], None if i % 9 == 0 else i % 3) for i, v in enumerate(vectors)]
    bad = [None, [], [0.1] * 7 + [None], [0.1] * 7 + [math.nan], [math.inf] + [0.1] * 7, [0.5] * 4, [0.5] * 16]
    rows += [(2000 + i, v, 1) for i, v in enumerate(bad)]
    return [*rows, rows[7], rows[7], (None, rows[3][1], 2), (990, rows[4][1], 2)]


def test_against_plain_refinement(spark, monkeypatch):
    rows = awkward()
    want, books = plainly(rows)
    got, found = vc.vector_codes(table(spark, rows), parts=4, entries=8)
    assert Counter(map(tuple, got.select("vec_id", "code", "error", "label_error").collect())) == want
    assert found.tolist() == [[list(e) for e in b] for b in books]
    assert vc.codebook_text(found).split(",")[:2] == [str(x) for x in books[0][0]]
    monkeypatch.setattr(vc, "TREE_COMPONENTS", 64 * 8)  # many small trees give the same
    again, same = vc.vector_codes(table(spark, rows), parts=4, entries=8)
    assert (same == found).all() and Counter(map(tuple, again.select("vec_id", "code", "error", "label_error").collect())) == want


def test_few_and_no_vectors(spark):
    few = [(3, [0.1] * 8, 1), (1, [0.2] * 8, None), (3, [0.1] * 8, 1)]
    got, books = vc.vector_codes(table(spark, few), parts=4)
    assert books.shape == (4, 3, 2)
    assert Counter(map(tuple, got.select("vec_id", "code", "error", "label_error").collect())) == plainly(few, entries=64)[0]
    none, books = vc.vector_codes(table(spark, few).where(F.lit(False)), parts=4)
    assert none.count() == 0 and books.size == 0
    with pytest.raises(ValueError):
        vc.vector_codes(table(spark, few), parts=3)
    with pytest.raises(ValueError):
        vc.vector_codes(table(spark, few), entries=257)


@pytest.mark.parametrize("seed", range(12))
def test_trees_assign_like_full_search(seed):
    rng = np.random.default_rng(seed)
    n, width = int(rng.choice([1, 5, 50, 3000])), int(rng.choice([1, 2, 4]))
    points = rng.integers(-5, 6, (n, width)) if seed % 2 else np.floor(rng.normal(0, 30, (n, width))).astype(np.int64)
    points[: n // (1 + seed % 3)] = points[0]
    book = points[:64].copy()
    book[len(book) // 2] = book[0]
    far = ((points[:, None] - book[None]) ** 2).sum(2)
    balls = vc.Balls(vc.Tree(points).packed())
    entry, error = balls.nearest(book)
    assert (entry == far.argmin(1)).all() and (error == far.min(1)).all()
    total, count = balls.sums(book)
    plain = np.zeros_like(book)
    np.add.at(plain, entry, points)
    assert (total == plain).all() and (count == np.bincount(entry, minlength=len(book))).all()


def test_lists_shrink_until_balls_are_owned():
    """Far-apart clusters: whole balls are owned and hardly a point is looked at."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-20_000, 20_000, (16, 4))
    points = (centres[rng.integers(0, 16, 4000)] + rng.integers(-40, 41, (4000, 4))).astype(np.int64)
    balls, seen = vc.Balls(vc.Tree(points).packed()), Counter()
    balls.walk(
        centres.astype(np.int64), lambda nodes, _: seen.update(owned=int(balls.count[nodes].sum())), lambda places, _: seen.update(single=len(places))
    )
    assert seen["owned"] == 4000 and not seen["single"]
