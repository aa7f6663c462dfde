"""Exact and approximate search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid.llm import neighbours as nb
from reelgrid.llm import topk as tk
from reelgrid.llm.vectors import first_k

SMALL = "/root/testdata/sf0.01"


def plain(rows, score, k, step=50):
    out = []
    for q, x in rows.items():
        if q % step:
            continue
        found = sorted((-score(x, y), c) for c, y in rows.items() if c != q and len(y) == len(x))
        out += [(q, n, c, -s) for n, (s, c) in enumerate(found[:k], 1)]
    return sorted(out)


def product(x, y):
    return sum(math.floor(256 * float(a)) * math.floor(256 * float(b)) for a, b in zip(x, y))


def cosine(x, y):
    x, y = np.array(x, float), np.array(y, float)
    return float(x @ y / np.sqrt((x @ x) * (y @ y)))


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    return {r["vec_id"]: r["embedding"] for r in rows}


def test_topk_query(spark, vectors):
    got = sorted(map(tuple, tk.op8_exact_topk(spark, SMALL).collect()))
    assert got == plain(vectors, product, 5)


def test_neighbour_query_recall(spark, vectors):
    got = {tuple(r)[:3]: r["score"] for r in nb.op9_neighbours(spark, SMALL).collect()}
    want = {r[:3]: r[3] for r in plain(vectors, cosine, 5)}
    assert len(got) == len(want)
    assert len(got.keys() & want.keys()) >= 0.9 * len(want)
    assert all(abs(got[x] - want[x]) < 1e-12 for x in got.keys() & want.keys())


@pytest.mark.parametrize("n", [1, 3, 300, 5000])
def test_blocks_against_brute_force(n):
    rng = np.random.default_rng(n)
    v = rng.standard_normal((n, 9)) / 3
    v[n // 2:n // 2 + n // 3] = v[0]
    ids = rng.permutation(n)
    pick = ids % 7 == 0
    x = np.floor(256 * v)
    at, found, score = tk.top_products(ids[pick], x[pick], ids, x, 5)
    full = (x[pick] @ x.T).astype(np.int64)
    i, j = np.nonzero(ids[pick][:, None] != ids[None, :])
    best = first_k(i, ids[j], full[i, j], 5)
    assert sorted(zip(at, found, score)) == sorted(zip(i[best], ids[j][best], full[i, j][best]))
    at, found, score = nb.nearest(ids[pick], v[pick], ids, v, 5)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    full = np.round(unit[pick] @ unit.T, 12)
    best = first_k(i, ids[j], full[i, j], 5)
    got, want = set(zip(at, found)), set(zip(i[best], ids[j][best]))
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_bounds_hold_at_any_depth():
    rng = np.random.default_rng(0)
    v = np.floor(rng.standard_normal((50, 6)) * 100)
    q = np.floor(rng.standard_normal((4, 6)) * 100)
    lists = tk.SortedLists(v)
    for depth in (1, 7, 49, 50):
        low, high = lists.bounds(np.maximum(q, 0), np.minimum(q, 0), depth)
        assert (low <= q @ v.T).all() and (q @ v.T <= high).all()
    assert (low == high).all()


def test_large_components_are_exact():
    v = np.floor(np.array([[1e30, 1.0], [1e5, 3.0], [0.0, 0.0]]))
    at, found, score = tk.top_products(np.array([0]), v[:1], np.array([0, 1, 2]), v, 5)
    assert list(found) == [1, 2] and list(score) == [2**63 - 1, 0]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame(
        [(0, [1.0, 0.0], "q"), (0, [1.0, 0.0], "again"), (50, [0.0, 1.0], "q"), (3, None, "n"),
         (4, [nan, 1.0], "n"), (5, [inf, 1.0], "n"), (6, [None, 1.0], "n"), (7, [0.0, 0.0], "z"),
         (8, [1.0, 0.0], "t"), (9, [1.0, 0.0], "t"), (10, [1.0, 0.0, 0.0], "d"), (11, [], "e"),
         (None, [1.0, 1.0], "i")], "vec_id long, embedding array<float>, rank string")
    is_query = F.col("vec_id") % 50 == 0
    got = sorted(map(tuple, tk.top_k(rows, is_query, 3).collect()))
    assert got == [(0, 1, 8, 65536), (0, 2, 9, 65536), (0, 3, 7, 0),
                   (50, 1, 0, 0), (50, 2, 7, 0), (50, 3, 8, 0)]
    got = sorted(map(tuple, nb.near_vectors(rows, is_query, 3).collect()))
    assert got == [(0, 1, 8, 1.0), (0, 2, 9, 1.0), (0, 3, 50, 0.0),
                   (50, 1, 0, 0.0), (50, 2, 8, 0.0), (50, 3, 9, 0.0)]
    none = rows.where("vec_id = 11")
    assert tk.top_k(none, is_query, 3).count() == 0
    assert nb.near_vectors(none, is_query, 3).count() == 0
