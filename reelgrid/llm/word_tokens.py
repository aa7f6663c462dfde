"""Token ids of whole texts by a word-based BPE tokenizer, with ids kept per word."""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np
import regex

from reelgrid.llm.rows import kept
from reelgrid.llm.words import grown

MOST_WORDS = 300_000

# The tokenizer file's own split pattern.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Latin words, on which Unicode composition changes nothing and lower case goes letter by letter.
LATIN = re.compile("[!-~¡-įı-ɏ]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


class Places(dict):
    """Numbers words in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


class WordTokens:
    """Encodes texts word by word; a word's ids are found once and kept.

    White space never lies in a token of this kind of tokenizer, so a text's ids are those of
    its words in order. Words of Latin letters go straight to the merge model; all others
    through the whole tokenizer. At ``MOST_WORDS`` kept words the store starts afresh, which
    changes no result.
    """

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.clear()

    def clear(self):
        self.words = Places()
        self.pieces: dict[str, list[int]] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 12, np.int64)
        self.sizes = np.zeros(1 << 12, np.int64)
        self.used = 0

    def _piece(self, piece: str) -> list[int]:
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(
            self.letters)
        found = self.pieces[piece] = [t.id for t in self.model.tokenize(mapped)]
        return found

    def _word(self, word: bytes) -> list[int]:
        text = word.decode()
        if LATIN.fullmatch(text) and "<|" not in text:
            out: list[int] = []
            for piece in SPLIT.findall(text.lower()):
                out += self.pieces.get(piece) or self._piece(piece)
            return out
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _keep(self, words: list[bytes]):
        found = [self._word(w) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        first = len(self.words) - len(words)
        self.starts, self.sizes = (grown(x, len(self.words)) for x in (self.starts, self.sizes))
        total = int(sizes.sum())
        self.ids = grown(self.ids, self.used + total)
        self.ids[self.used:self.used + total] = np.fromiter(
            (i for x in found for i in x), np.uint32, total)
        self.starts[first:first + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first:first + len(words)] = sizes
        self.used += total

    def encode(self, texts: list[bytes], end: int) -> list[np.ndarray]:
        """Ids of each text, with ``end`` after them."""
        if len(self.words) > MOST_WORDS:
            self.clear()
        known, places, counts = len(self.words), [], []
        for text in texts:
            words = text.split()
            counts.append(len(words))
            places.extend(map(self.words.__getitem__, words))
        at = np.array(places, np.int64)
        if len(self.words) > known:
            self._keep(list(islice(self.words, known, None)))
        sizes = self.sizes[at]
        before = np.cumsum(sizes) - sizes
        flat = self.ids[np.repeat(self.starts[at] - before, sizes) + np.arange(sizes.sum())]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(np.array(counts, np.int64))]
        flat = np.insert(flat, ends, end)
        cuts = ends + np.arange(1, len(ends) + 1)
        return np.split(flat, cuts[:-1]) if len(ends) else []


def word_tokens(definition: str) -> WordTokens:
    """The worker's encoder for a tokenizer definition; tasks of one worker share its words."""
    return kept(("words", hash(definition)), lambda: WordTokens(definition))
