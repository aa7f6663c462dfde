"""Piece models read from their files: vocabulary, merge order, segments of texts."""

from __future__ import annotations

import heapq
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np

from reelgrid.llm.rows import kept

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
LONGEST = 64
MOST_WORDS = 500_000
MOST_PAIRS = 500_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_RUNS = re.compile(r"\n[^ \n]*| +[^ \n]*|[^ \n]+")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a message in protocol-buffer form."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        elif tag & 7 == 2:
            size = number()
            yield tag >> 3, data[at:at + size]
            at += size
        else:
            size = 8 if tag & 7 == 1 else 4
            yield tag >> 3, data[at:at + size]
            at += size


class PieceModel:
    """A BPE or unigram piece model with byte fallback and no character map.

    ``token`` numbers here are merge ranks: single characters first, then merged pieces in the
    order BPE merges them; the last number stands for a character without a piece. Decoding
    needs no ``merges``.
    """

    def __init__(self, data: bytes, merges: bool = True):
        pieces, kind, spec = [], 1, {}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                score = struct.unpack("<f", own.get(2, bytes(4)))[0]
                pieces.append((own[1].decode(), score, own.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif number == 3:
                spec = dict(_fields(value))
        if kind not in (1, 2) or spec.get(2, b"") or not spec.get(5, 1):
            raise ValueError("only BPE and unigram models without a character map are read")
        self.is_bpe = kind == 2
        self.prefix, self.collapse = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self.pieces = pieces
        self.byte_ids = np.zeros(256, np.int32)
        for i, (text, _, type_) in enumerate(pieces):
            if type_ == BYTE:
                self.byte_ids[int(text[1:-1], 16)] = i
        normal = [(t, s, i) for i, (t, s, type_) in enumerate(pieces) if type_ in (NORMAL, USER)]
        order = sorted(normal, key=lambda p: (len(p[0]) > 1, -p[1], p[2]))
        self.token = {t: k for k, (t, _, _) in enumerate(order)}
        self.text = [t for t, _, _ in order]
        self.score = np.array([s for _, s, _ in order] + [
            min(s for _, s, _ in order) - UNKNOWN_PENALTY], np.float64)
        self.ids = np.array([i for _, _, i in order] + [-1], np.int32)
        self.sizes = np.array([len(t) for t in self.text] + [1], np.int64)
        self.unknown = len(order)
        scores = Counter(s for t, s, _ in order if len(t) > 1)
        shared = {s for s, n in scores.items() if n > 1}
        if any(t.strip(SPACE) for t, s, _ in order if len(t) > 1 and s in shared) and self.is_bpe:
            raise ValueError("pieces of one score must be runs of spaces")
        if any(a != SPACE and b == SPACE for t in self.text for a, b in zip(t, t[1:])):
            raise ValueError("a piece spans a word border")
        if any("\n" in t for t in self.text):
            raise ValueError("a piece spans a line border")
        if self.is_bpe and merges:
            self._merges()

    def _merges(self):
        """For each piece the two pieces of its last merge; for each pair what it merges to."""
        n = self.unknown + 1
        self.left, self.right = np.arange(n), np.arange(n)
        self.reached = np.zeros(n, bool)
        pairs: dict[int, int] = {}
        for k, text in enumerate(self.text):
            for cut in range(1, len(text)):
                a, b = self.token.get(text[:cut]), self.token.get(text[cut:])
                if a is not None and b is not None:
                    pairs[a * n + b] = k
        self.pairs = pairs
        for k, text in enumerate(self.text):
            steps: list = []
            self.reached[k] = self.merge(text, steps) == [k]
            if steps and self.reached[k]:
                self.left[k], self.right[k] = steps[-1]
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys = keys
        self.pair_values = np.array([pairs[x] for x in keys.tolist()], np.int64)
        self.lefts, self.rights = self.left.tolist(), self.right.tolist()
        self._fits: dict[int, bool] = {}

    def merge(self, word: str, steps: list | None = None) -> list[int]:
        """Tokens of a word by merging the best pair first, the leftmost of equal ones."""
        tokens = [self.token.get(c, self.unknown) for c in word]
        after, before = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1))
        n, heap = self.unknown + 1, []

        def push(a, b):
            made = self.pairs.get(tokens[a] * n + tokens[b])
            if made is not None:
                heapq.heappush(heap, (-self.score[made], a, b, tokens[a], tokens[b], made))

        for a in range(len(tokens) - 1):
            push(a, a + 1)
        while heap:
            _, a, b, one, two, made = heapq.heappop(heap)
            if tokens[a] != one or tokens[b] != two or after[a] != b:
                continue
            if steps is not None:
                steps.append((one, two))
            tokens[a], tokens[b] = made, -1
            after[a] = after[b]
            if after[b] < len(tokens):
                before[after[b]] = a
                push(a, after[b])
            if before[a] >= 0:
                push(before[a], a)
        return [t for t in tokens if t >= 0]

    def fits(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether BPE leaves token ``two`` after token ``one``, for pairs of tokens.

        The later of both merges is undone step by step at the border; the pair is refused as
        soon as a merge across the border would have come before the one just undone.
        """
        n = self.unknown + 1
        out = np.ones(len(one), bool)
        live = np.arange(len(one))
        one, two = one.copy(), two.copy()
        limit = np.full(len(one), 2 * n)
        while len(live):
            key = one * n + two
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            bad = (self.pair_keys[at] == key) & (self.pair_values[at] < limit)
            out[live[bad]] = False
            split_one, split_two = self.right[one] != one, self.left[two] != two
            undo_one = split_one & ((one > two) | ~split_two)
            keep = ~bad & (split_one | split_two)
            limit = np.where(undo_one, one, two + 1)
            one, two = (np.where(undo_one, self.right[one], one),
                        np.where(undo_one, two, self.left[two]))
            live, one, two, limit = live[keep], one[keep], two[keep], limit[keep]
        return out

    def fit(self, one: int, two: int) -> bool:
        """``fits`` for one pair, remembered."""
        n = self.unknown + 1
        key = one * n + two
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > MOST_PAIRS:
                self._fits.clear()
            known = self._fits[key] = self._undone(one, two, n)
        return known

    def _undone(self, one: int, two: int, n: int) -> bool:
        limit, pairs, lefts, rights = 2 * n, self.pairs, self.lefts, self.rights
        while True:
            made = pairs.get(one * n + two)
            if made is not None and made < limit:
                return False
            right, left = rights[one], lefts[two]
            if right != one and (one > two or left == two):
                limit, one = one, right
            elif left != two:
                limit, two = two + 1, left
            else:
                return True

    def words(self, text: str) -> list[str]:
        """Runs of a text no piece crosses: a word with the spaces before it, or a line end
        with what follows. The first space is left out of a run; a run without one that is at
        no line end is marked by two line ends."""
        text = text.replace(SPACE, " ")
        if self.collapse:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return []
        if self.prefix and "  " not in text and text[0] != " ":
            return text.replace("\n", " \n").split(" ")
        runs = _RUNS.findall(" " + text if self.prefix else text)
        return [r[1:] if r[0] == " " else r if r[0] == "\n" else "\n\n" + r for r in runs]

    @staticmethod
    def segment(word: str) -> str:
        """Characters of a run as pieces spell them."""
        if word[:1] == "\n":
            return word[2:] if word[:2] == "\n\n" else word
        return SPACE + word.replace(" ", SPACE)

    def plain(self, word: str) -> bool:
        """Whether a run is left to ``merge``: very long, or with pieces of one score."""
        return len(word) > LONGEST or SPACE * 2 in word


def piece_model(data: bytes) -> PieceModel:
    """The worker's model of a file's content."""
    return kept(("pieces", hash(data)), lambda: PieceModel(data))


def model_bytes(path: str | None, name: str = "piece_bpe_32k.model") -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as f:
        return f.read()
