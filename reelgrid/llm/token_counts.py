"""Token counts without ids: vocabulary matches by Aho-Corasick, counts by dynamic programming."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid.llm.pieces import MOST_WORDS, SPACE, PieceModel, model_bytes, piece_model
from reelgrid.llm.rows import table, with_columns
from reelgrid.llm.words import grown


class Counter:
    """Number of tokens of texts under a piece model, word by word, each word once."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.matches = ahocorasick.Automaton()
        for k, text in enumerate(model.text):
            if not model.is_bpe or model.reached[k]:
                self.matches.add_word(text, (len(text), k))
        self.matches.make_automaton()
        self.clear()

    def clear(self):
        self.place: dict[str, int] = {}
        self.counts = np.zeros(1 << 12, np.int64)

    def count(self, word: str) -> int:
        """Tokens of one run of characters.

        At each end the best score so far and its token count are carried. In a unigram model
        a later match wins only with a higher total, so the one that starts first stays among
        equals. In a BPE model the score of a match is that of the merge order: only the match
        that BPE leaves after the token before it counts, and there is one.
        """
        model = self.model
        if not word:
            return 0
        if model.is_bpe and SPACE * 2 in word:  # pieces of one score: merged one by one
            return sum(self._bytes(c) if t == model.unknown else 1
                       for t, c in self._spelt(word, model.merge(word)))
        if model.is_bpe:
            return self._left_by_merges(word)
        unknown, score = model.unknown, model.score
        best, tokens = [0.0], [0]
        found: list = [[] for _ in word]
        for end, match in self.matches.iter(word):
            found[end].append(match)
        for end in range(len(word)):
            top, count, single = -np.inf, 0, False
            for size, k in sorted(found[end], reverse=True):
                at = end + 1 - size
                single |= size == 1
                if best[at] + score[k] > top:
                    top, count = best[at] + score[k], tokens[at] + 1
            if not single and best[end] + score[unknown] > top:
                top = best[end] + score[unknown]
                count = tokens[end] + self._bytes(word[end])
            best.append(top)
            tokens.append(count)
        return tokens[-1]

    def _left_by_merges(self, word: str) -> int:
        """Tokens of a word under a BPE model: at each end the one match that the merge order
        leaves after the token before it. Matches of one end come longest first. Where a
        character is no piece, no piece that merges reach holds it, so nothing ends there."""
        model = self.model
        fit, fits, n, unknown = model.fit, model._fits, model.unknown + 1, model.unknown
        last, tokens = [unknown] * (len(word) + 1), [0] * (len(word) + 1)
        filled = 0  # ends up to here have their token and count
        for end, (size, k) in self.matches.iter(word):
            if end < filled:
                continue
            while filled < end:
                tokens[filled + 1] = tokens[filled] + self._bytes(word[filled])
                filled += 1
            at = end + 1 - size
            if at:
                before = last[at]
                known = fits.get(before * n + k)
                if not (fit(before, k) if known is None else known):
                    continue
            tokens[end + 1], last[end + 1] = tokens[at] + 1, k
            filled = end + 1
        while filled < len(word):
            tokens[filled + 1] = tokens[filled] + self._bytes(word[filled])
            filled += 1
        return tokens[-1]

    @staticmethod
    def _bytes(char: str) -> int:
        return len(char.encode("utf-8", "surrogatepass"))

    def _spelt(self, word: str, found: list[int]):
        at = 0
        for t in found:
            yield t, word[at]
            at += int(self.model.sizes[t])

    def totals(self, texts: list[str]) -> np.ndarray:
        if len(self.place) > MOST_WORDS:
            self.clear()
        place, counts, model = self.place, [], self.model
        out = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            at = []
            for w in model.words(text):
                n = place.get(w)
                if n is None:
                    n = place[w] = len(place)
                    counts.append(self.count(model.segment(w)))
                at.append(n)
            if counts:
                self.counts = grown(self.counts, len(place))
                self.counts[len(place) - len(counts):len(place)] = counts
                counts = []
            out[k] = self.counts[np.array(at, np.int64)].sum()
        return out


def count_tokens(docs: DataFrame, model: bytes, text: str = "text",
                 name: str = "n_tokens") -> DataFrame:
    """Rows with the number of tokens of their whole text under a piece model's file content,
    as its own library counts them. Null and empty texts have none. A column already called
    ``name`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary file

    def make():
        counter = Counter(piece_model(shared.value))
        return lambda batch: [pa.array(counter.totals(
            [t or "" for t in batch.column(text).to_pylist()]))]

    return with_columns(docs, [(name, T.LongType())], text, make)


def op6_token_counts(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, model_bytes(model))
    return counted.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long")
                          .alias("n_chars"), "n_tokens")
