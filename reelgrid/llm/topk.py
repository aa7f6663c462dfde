"""Exact top-k by inner product of integer vectors, reading sorted lists in order only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.rows import table
from reelgrid.llm.vectors import first_k, search, usable

SCALE = 256
BLOCK = 2048
QUERIES = 256
DEPTHS = (1 / 16, 1 / 4, 1 / 2, 3 / 4, 1)
FEW = 4


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.floor(scale * vectors)


def _kind(q: np.ndarray, v: np.ndarray):
    """Smallest type in which every sum is an exact integer."""
    most = q.shape[1] * np.abs(q).max(initial=0) * np.abs(v).max(initial=0)
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


class SortedLists:
    """One list per component of a block of vectors, sorted by value.

    A query reads the list of a component from its high end where its own component is
    positive, from its low end where it is negative, so contributions fall along the list.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.n = len(vectors)
        order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, order, axis=0)
        self.place = np.empty_like(order)
        np.put_along_axis(self.place, order, np.arange(self.n)[:, None], axis=0)

    def bounds(self, up: np.ndarray, down: np.ndarray, depth: int):
        """Lower and upper bounds of all scores once ``depth`` entries of each list are read.

        Read entries count as they are; an unread one is at most the last one read, at least
        the list's end.
        """
        high, low = self.place >= self.n - depth, self.place < depth
        v = self.vectors
        upper = (up @ np.where(high, v, self.sorted[self.n - depth]).T
                 + down @ np.where(low, v, self.sorted[depth - 1]).T)
        lower = (up @ np.where(high, v, self.sorted[0]).T
                 + down @ np.where(low, v, self.sorted[-1]).T)
        return lower, upper


def _resolved(q: np.ndarray, v: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Exact scores of pairs, added component by component."""
    if _kind(q, v) is object:
        exact = [sum(int(a) * int(b) for a, b in zip(q[i], v[j])) for i, j in zip(at, to)]
        return np.array([max(-2**63, min(2**63 - 1, x)) for x in exact], np.int64)
    score = np.zeros(len(at), np.int64)
    for d in range(q.shape[1]):
        score += q[at, d].astype(np.int64) * v[to, d].astype(np.int64)
    return score


def top_products(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int):
    """Each query's k highest inner products among ``v``, its own id left out.

    Blocks of vectors are taken one after the other. In a block all lists are read in step;
    a query's reading stops when at most a few vectors could still reach its k-th best lower
    bound (of this block or of the blocks before), and only their scores are resolved.
    Vectors that could tie stay, so ties are settled by id.
    """
    kind = _kind(q, v)
    at_all, id_all, score_all = [], [], []
    floor = np.full(len(q), -np.inf)
    for a in range(0, len(v), BLOCK):
        part, part_ids = v[a:a + BLOCK], ids[a:a + BLOCK]
        if kind is object:
            at, to = (x.ravel() for x in np.indices((len(q), len(part))))
            keep = qids[at] != part_ids[to]
            at, to = at[keep], to[keep]
        else:
            lists = SortedLists(part.astype(kind))
            pairs = [_candidates(lists, qids, q, part_ids, floor, np.arange(
                b, min(len(q), b + QUERIES)), k, kind) for b in range(0, len(q), QUERIES)]
            at, to = (np.concatenate([p[x] for p in pairs]) for x in (0, 1))
        score = _resolved(q, part, at, to)
        at = np.concatenate([*at_all, at])
        found = np.concatenate([*id_all, part_ids[to]])
        score = np.concatenate([*score_all, score])
        best = first_k(at, found, score, k)
        at_all, id_all, score_all = [at[best]], [found[best]], [score[best]]
        held = np.bincount(at_all[0], minlength=len(q)) == k
        least = np.full(len(q), np.inf)
        np.minimum.at(least, at_all[0], score_all[0])
        floor = np.where(held, least, -np.inf)
    return at_all[0], id_all[0], score_all[0]


def _candidates(lists, qids, q, ids, floor, open_, k, kind):
    """Pairs (query place, vector place) that may be among the k best."""
    at, to = [], []
    for share in DEPTHS:
        depth = max(1, min(lists.n, round(share * lists.n)))
        part = q[open_].astype(kind)
        lower, upper = lists.bounds(np.maximum(part, 0), np.minimum(part, 0), depth)
        own = qids[open_][:, None] == ids[None, :]
        lower[own], upper[own] = -np.inf, -np.inf
        bar = floor[open_]
        if lists.n >= k:
            bar = np.maximum(bar, np.partition(lower, lists.n - k, axis=1)[:, lists.n - k])
        may = (upper >= bar[:, None]) & ~own
        done = may.sum(axis=1) <= FEW * k
        if depth == lists.n:
            done[:] = True
        i, j = np.nonzero(may & done[:, None])
        at.append(open_[i])
        to.append(j)
        open_ = open_[~done]
        if not len(open_):
            break
    return np.concatenate(at), np.concatenate(to)


def top_k(rows: DataFrame, is_query, k: int, vec_id: str = "vec_id", vector: str = "embedding",
          scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest inner products of vectors
    taken to floor(scale * x); all candidates where there are fewer. ``is_query`` is a
    condition on ``vec_id``.

    Null vectors and ones with null or non-finite components take no part, nor do null ids;
    repeated rows of one id count once (the least vector); vectors meet those of their
    dimension. Ties go to the smaller vec_id. A score beyond 64 bits is cut to the range.
    """
    def best(qids, q, ids, v):
        return top_products(qids, integers(q, scale), ids, integers(v, scale), k)

    return search(usable(rows, vec_id, vector, zero=True), is_query, k, best, "long")


def op8_exact_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
