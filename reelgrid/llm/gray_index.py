"""Hierarchical index over bit codes in Gray order, for all pairs within few differing bits."""

from __future__ import annotations

import numpy as np

FAN = 8
FRONTIER = 1 << 19
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def sub_masks(mask: int, parts: int, bits: int = 64) -> list[int]:
    """``mask`` with one of ``parts`` runs of its unset bits set.

    Codes that agree under ``mask`` and differ in fewer than ``parts`` bits agree under one
    of these at least.
    """
    free = [b for b in range(bits) if not mask >> b & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[a:b_]) for a, b_ in zip(cuts, cuts[1:])]


class GrayIndex:
    """Distinct codes sorted by bucket (bits under ``mask``), then Gray rank.

    Level 0 holds the codes; a node above covers FAN nodes below and keeps the bits they all
    share. Those bits are taken out of its children (``own``), so a descent adds each bit's
    difference once, and a whole group goes when the sum passes the limit or a bucket bit
    differs.
    """

    def __init__(self, codes: np.ndarray, mask: int = 0):
        self.mask = np.uint64(mask)
        self.codes = codes[np.lexsort((gray_rank(codes), codes & self.mask))]
        shared, pattern = [np.full(len(codes), ALL)], [self.codes]
        while len(pattern[-1]) > FAN:
            starts = np.arange(0, len(pattern[-1]), FAN)
            low = np.bitwise_and.reduceat(pattern[-1], starts)
            high = np.bitwise_or.reduceat(pattern[-1], starts)
            same = np.bitwise_and.reduceat(shared[-1], starts) & ~(low ^ high)
            shared.append(same)
            pattern.append(low & same)
        self.pattern = pattern
        self.own = [s & ~np.repeat(up, FAN)[:len(s)] for s, up in zip(shared, shared[1:])]
        self.own.append(shared[-1])

    def pairs(self, limit: int):
        """Arrays (i, j), i < j, of places of codes in one bucket within ``limit`` bits."""
        n, top = len(self.codes), len(self.pattern) - 1
        width = len(self.pattern[top]) if n else 0
        step = max(1, FRONTIER // FAN // max(1, width))
        todo = []
        for a in range(0, n, step):
            seek = np.arange(a, min(n, a + step))
            todo.append((top, np.repeat(seek, width), np.tile(np.arange(width), len(seek)),
                         np.zeros(len(seek) * width, np.uint8)))
            while todo:
                level, seek, node, so_far = todo.pop()
                off = (self.codes[seek] ^ self.pattern[level][node]) & self.own[level][node]
                so_far = so_far + np.bitwise_count(off)
                keep = ((so_far <= limit) & ((off & self.mask) == 0)
                        & ((node + 1) * FAN ** level - 1 > seek))
                seek, node, so_far = seek[keep], node[keep], so_far[keep]
                if level == 0:
                    yield seek, node
                    continue
                for s in range(0, len(seek), FRONTIER // FAN):
                    part = slice(s, s + FRONTIER // FAN)
                    below = (node[part, None] * FAN + np.arange(FAN)).ravel()
                    there = below < len(self.pattern[level - 1])
                    todo.append((level - 1, np.repeat(seek[part], FAN)[there], below[there],
                                 np.repeat(so_far[part], FAN)[there]))

    def forest(self, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes and a code of the same component each; no more links than codes."""
        parent = np.arange(len(self.codes))

        def root(x):
            while True:
                up = parent[x]
                if np.array_equal(up, parent[up]):
                    return up
                parent[x] = parent[up]

        for i, j in self.pairs(limit):
            while len(i):
                ri, rj = root(i), root(j)
                apart = ri != rj
                i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
                np.minimum.at(parent, np.maximum(ri, rj), np.minimum(ri, rj))
        every = np.arange(len(self.codes))
        tops = root(every)
        moved = tops != every
        return self.codes[moved], self.codes[tops[moved]]
