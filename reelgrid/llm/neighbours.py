"""Approximate nearest neighbours by randomly rotated one-bit codes and exact reranking."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.rows import table
from reelgrid.llm.vectors import first_k, search, usable

BLOCK = 2048
QUERIES = 256
ERRORS = 3.0
SEED = 7


def rotation(dim: int) -> np.ndarray:
    """The same random rotation on every executor."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component near one."""
    _, power = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -power[:, None])


def _norms(v: np.ndarray) -> np.ndarray:
    total = np.zeros(len(v))
    for d in range(v.shape[1]):
        total += v[:, d] * v[:, d]
    return np.sqrt(total)


def cosines(q, q_norm, v, v_norm, at, to) -> np.ndarray:
    """Exact cosines of pairs, summed in one order, so that equal vectors get equal scores."""
    total = np.zeros(len(at))
    for d in range(q.shape[1]):
        total += q[at, d] * v[to, d]
    return total / (q_norm[at] * v_norm[to])


class BitCodes:
    """Packed one-bit codes of unit vectors about their mean, with correction scalars.

    A vector's residual is turned by a random rotation and kept as one sign bit a component.
    ``aligned`` is the inner product of the unit residual with its code's unit vector;
    dividing by it makes the estimate unbiased, and its distance from one gives the error.
    """

    def __init__(self, units: np.ndarray, turn: np.ndarray):
        self.dim = units.shape[1]
        self.centre = units.mean(axis=0)
        rest = units - self.centre
        self.length = np.linalg.norm(rest, axis=1)
        turned = (rest / np.where(self.length > 0, self.length, 1)[:, None]) @ turn.T
        self.codes = np.packbits(turned >= 0, axis=1)
        self.aligned = np.maximum(np.abs(turned).sum(axis=1) / np.sqrt(self.dim), 1e-6)
        self.offset = units @ self.centre
        loose = np.sqrt(np.maximum(0, 1 - self.aligned**2)) / self.aligned
        self.error = loose / np.sqrt(max(1, self.dim - 1))
        self.turn = turn

    def estimates(self, units: np.ndarray, errors: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosines to each code, and how far the true ones may be off."""
        rest = units - self.centre
        size = np.linalg.norm(rest, axis=1)
        turned = (rest @ self.turn.T).astype(np.float32)
        wide = np.zeros((len(units), self.codes.shape[1] * 8), np.float32)
        wide[:, :self.dim] = turned
        signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1
        dot = np.zeros((len(units), len(self.codes)), np.float32)
        for byte in range(self.codes.shape[1]):
            sums = wide[:, 8 * byte:8 * byte + 8] @ signs.T.astype(np.float32)
            dot += sums[:, self.codes[:, byte]]
        scale = (self.length / (self.aligned * np.sqrt(self.dim))).astype(np.float32)
        flat = (units @ self.centre)[:, None] + self.offset - self.centre @ self.centre
        return dot * scale + flat, errors * np.outer(size, self.length * self.error) + 1e-5


def nearest(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int,
            errors: float = ERRORS):
    """Each query's k largest cosines found among ``v``, its own id left out.

    A vector is reranked by its exact cosine when estimate plus error reaches the k-th best
    cosine known so far.
    """
    q, v = scaled(q), scaled(v)
    q_norm, v_norm = _norms(q), _norms(v)
    q_unit, v_unit = q / q_norm[:, None], v / v_norm[:, None]
    turn = rotation(q.shape[1])
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    bar = np.full(len(q), -np.inf)
    for a in range(0, len(v), BLOCK):
        block = slice(a, a + BLOCK)
        codes, own_ids = BitCodes(v_unit[block], turn), ids[block]
        more_at, more_to = [], []
        for b in range(0, len(q), QUERIES):
            rows = np.arange(b, min(len(q), b + QUERIES))
            guess, error = codes.estimates(q_unit[rows], errors)
            own = qids[rows][:, None] == own_ids[None, :]
            guess[own] = -np.inf
            line = bar[rows]
            if len(own_ids) > k:
                first = np.argpartition(-guess, k, axis=1)[:, :k]
                i = np.repeat(np.arange(len(rows)), k)
                sure = cosines(q, q_norm, v[block], v_norm[block], rows[i], first.ravel())
                sure = np.where(own[i, first.ravel()], -np.inf, sure).reshape(-1, k)
                line = np.maximum(line, sure.min(axis=1))
            i, j = np.nonzero((guess + error >= line[:, None] - 1e-9) & ~own)
            more_at.append(rows[i])
            more_to.append(j)
        at, to = np.concatenate(more_at), np.concatenate(more_to)
        score = cosines(q, q_norm, v[block], v_norm[block], at, to)
        at, found, score = (np.concatenate(x) for x in zip(held, (at, own_ids[to], score)))
        best = first_k(at, found, score, k)
        held = [at[best], found[best], score[best]]
        full = np.bincount(held[0], minlength=len(q)) == k
        least = np.full(len(q), np.inf)
        np.minimum.at(least, held[0], held[2])
        bar = np.where(full, least, -np.inf)
    return tuple(held)


def near_vectors(rows: DataFrame, is_query, k: int, vec_id: str = "vec_id",
                 vector: str = "embedding", errors: float = ERRORS) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest by cosine, as found; all
    candidates where there are fewer. ``is_query`` is a condition on ``vec_id``.

    ``errors`` sets how many expected errors an estimate may be off before its vector is
    passed by. Zero and null vectors and ones with null or non-finite components take no
    part, nor do null ids; repeated rows of one id count once (the least vector); vectors
    meet those of their dimension. Ties go to the smaller vec_id.
    """
    def best(qids, q, ids, v):
        return nearest(qids, q, ids, v, k, errors)

    return search(usable(rows, vec_id, vector, zero=False), is_query, k, best, "double")


def op9_neighbours(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)
