"""SentencePiece encoding and decoding by a batched search over words of equal length."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid.llm.pieces import (BYTE, CONTROL, LONGEST, MOST_WORDS, SPACE, UNKNOWN, UNUSED,
                                 PieceModel, model_bytes)
from reelgrid.llm.rows import kept, table, with_columns
from reelgrid.llm.words import grown

AT_ONCE = 1 << 17
BASE = np.uint64(0x9E3779B97F4A7C15)


class Encoder:
    """Ids of texts; a word's ids are found once and kept, up to ``MOST_WORDS`` words."""

    def __init__(self, model: PieceModel):
        self.model = model
        with np.errstate(over="ignore"):
            powers = [np.uint64(1)]
            for _ in range(LONGEST):
                powers.append(powers[-1] * BASE)
        self.powers = np.array(powers, np.uint64)
        self.keys, self.tokens, self.id_of = {}, {}, model.ids.tolist()
        by_size = defaultdict(list)
        for k, text in enumerate(model.text):
            if not model.is_bpe or model.reached[k]:
                by_size[len(text)].append(k)
        for size, tokens in by_size.items():
            if size > LONGEST:
                continue
            hashes = self.hashes(self.characters([model.text[k] for k in tokens]))[:, size]
            order = np.argsort(hashes)
            self.keys[size], self.tokens[size] = hashes[order], np.array(tokens)[order]
            if len(np.unique(hashes)) < len(hashes):
                raise ValueError("two pieces share a hash")
        self.clear()

    def clear(self):
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 12, np.int64)
        self.sizes = np.zeros(1 << 12, np.int64)
        self.used = 0

    @staticmethod
    def characters(words: list[str]) -> np.ndarray:
        """Code points of words of one length."""
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        return flat.reshape(len(words), -1)

    def hashes(self, chars: np.ndarray) -> np.ndarray:
        """Hash of each start of each word; the hash of a substring follows from two."""
        out = np.zeros((len(chars), chars.shape[1] + 1), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(chars.shape[1]):
                out[:, k + 1] = out[:, k] * BASE + chars[:, k] + np.uint64(1)
        return out

    def probe(self, hashes: np.ndarray, end: int, size: int, rows: np.ndarray) -> np.ndarray:
        """Token of the substring of each row, -1 where it is no piece."""
        keys = self.keys[size]
        with np.errstate(over="ignore"):
            own = hashes[rows, end] - hashes[rows, end - size] * self.powers[size]
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        return np.where(keys[at] == own, self.tokens[size][at], -1)

    def batch(self, words: list[str]) -> list[np.ndarray]:
        """Tokens of words of one length.

        All words advance together, end by end. A unigram model keeps at each end the piece
        of the highest total, the longest of equal ones. A BPE model keeps the one piece that
        can follow the piece kept where it starts; there is exactly one such way to each end,
        and it is the one merging gives.
        """
        model, chars = self.model, self.characters(words)
        n, length = chars.shape
        hashes = self.hashes(chars)
        last = np.full((n, length + 1), model.unknown)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        every = np.arange(n)
        for end in range(1, length + 1):
            rows = every
            single = self.probe(hashes, end, 1, every) if 1 in self.keys else np.full(n, -1)
            for size in sorted((s for s in self.keys if s <= end), reverse=True):
                token = single[rows] if size == 1 else self.probe(hashes, end, size, rows)
                some = token >= 0
                at, token = rows[some], token[some]
                if model.is_bpe:
                    fits = (np.ones(len(at), bool) if size == end else
                            model.fits(last[at, end - size], token))
                    last[at[fits], end] = token[fits]
                    done = np.zeros(n, bool)
                    done[at[fits]] = True
                    rows = rows[~done[rows]]
                else:
                    total = best[at, end - size] + model.score[token]
                    more = total > best[at, end]
                    last[at[more], end], best[at[more], end] = token[more], total[more]
            if not model.is_bpe:
                at = np.flatnonzero(single < 0)
                total = best[at, end - 1] + model.score[model.unknown]
                more = total > best[at, end]
                last[at[more], end], best[at[more], end] = model.unknown, total[more]
        back, where = [], np.full(n, length)
        while (where > 0).any():
            token = np.where(where > 0, last[every, where], -1)
            back.append(token)
            where = where - np.where(where > 0, model.sizes[token], 0)
        back = np.stack(back[::-1], axis=1)
        return [row[row >= 0] for row in back]

    def _ids(self, word: str, tokens) -> list[int]:
        """Ids of a word's tokens; a character without a piece becomes its bytes' ids."""
        model = self.model
        if model.unknown not in tokens:
            if "".join([model.text[t] for t in tokens]) != word:
                raise ValueError("a substring hash met a different piece")
            return [self.id_of[t] for t in tokens]
        out, at = [], 0
        for t in tokens:
            if t == model.unknown:
                out += model.byte_ids[list(word[at].encode("utf-8", "surrogatepass"))].tolist()
                at += 1
            else:
                if not word.startswith(model.text[t], at):
                    raise ValueError("a substring hash met a different piece")
                out.append(self.id_of[t])
                at += len(model.text[t])
        return out

    def best_plain(self, word: str) -> list[int]:
        """Tokens of one word that is too long for a batch."""
        model = self.model
        if model.is_bpe:
            return model.merge(word)
        best, last = [0.0] + [-np.inf] * len(word), [model.unknown] * (len(word) + 1)
        for end in range(1, len(word) + 1):
            for size in sorted((s for s in self.keys if s <= end), reverse=True):
                token = model.token.get(word[end - size:end])
                if token is None and size == 1:
                    token = model.unknown
                if token is not None and best[end - size] + model.score[token] > best[end]:
                    best[end], last[end] = best[end - size] + model.score[token], token
        out, end = [], len(word)
        while end:
            out.append(last[end])
            end -= int(model.sizes[last[end]])
        return out[::-1]

    def _keep(self, new: list[str]):
        words = [self.model.segment(w) for w in new]
        found: list = [None] * len(words)
        groups = defaultdict(list)
        for k, w in enumerate(words):
            if self.model.plain(w):
                found[k] = self._ids(w, self.best_plain(w))
            else:
                groups[len(w)].append(k)
        for places in groups.values():
            for k, tokens in zip(places, self.batch([words[k] for k in places])):
                found[k] = self._ids(words[k], tokens.tolist())
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        first, total = len(self.place) - len(new), int(sizes.sum())
        self.starts, self.sizes = (grown(x, len(self.place)) for x in (self.starts, self.sizes))
        self.ids = grown(self.ids, self.used + total)
        self.ids[self.used:self.used + total] = np.fromiter(
            (i for x in found for i in x), np.int32, total)
        self.starts[first:len(self.place)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first:len(self.place)] = sizes
        self.used += total

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of each text."""
        if len(self.place) > MOST_WORDS:
            self.clear()
        place, new, at = self.place, [], []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            words = self.model.words(text)
            counts[k] = len(words)
            for w in words:
                n = place.get(w)
                if n is None:
                    n = place[w] = len(place)
                    new.append(w)
                at.append(n)
        if new:
            self._keep(new)
        at = np.array(at, np.int64)
        sizes = self.sizes[at]
        before = np.cumsum(sizes) - sizes
        flat = self.ids[np.repeat(self.starts[at] - before, sizes) + np.arange(sizes.sum())]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        return flat, np.diff(ends, prepend=0)


class Decoder:
    """Texts of ids: byte pieces are bytes, control pieces nothing, the first space goes."""

    def __init__(self, model: PieceModel):
        self.prefix = model.prefix
        spelt = []
        for text, _, kind in model.pieces:
            if kind == BYTE:
                spelt.append(bytes([int(text[1:-1], 16)]))
            elif kind in (CONTROL, UNUSED):
                spelt.append(b"")
            else:
                text = " ⁇ " if kind == UNKNOWN else text.replace(SPACE, " ")
                spelt.append(text.encode())
        self.sizes = np.fromiter(map(len, spelt), np.int64, len(spelt))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(spelt), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts one after the other, and where each begins and ends, from
        all ids in order and the number of each text."""
        sizes = self.sizes[ids]
        before = np.cumsum(sizes) - sizes
        flat = self.letters[np.repeat(self.starts[ids] - before, sizes) + np.arange(sizes.sum())]
        edges = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        if self.prefix and len(flat):
            first = edges[:-1][edges[1:] > edges[:-1]]
            spaces = first[flat[first] == 32]
            flat = np.delete(flat, spaces)
            edges = edges - np.searchsorted(spaces, edges)
        return flat, edges

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Decoded texts, some AT_ONCE ids at a time; bytes that are no UTF-8 become
        replacement characters."""
        ends = np.cumsum(counts)
        edges = [0, *(np.flatnonzero(np.diff(ends // AT_ONCE)) + 1).tolist(), len(counts)]
        return pa.concat_arrays([self._texts(
            ids[ends[a] - counts[a]:ends[b - 1]], counts[a:b])
            for a, b in zip(edges, edges[1:]) if b > a] or [pa.array([], pa.string())])

    def _texts(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        flat, edges = self.decode(ids, counts)
        out = pa.StringArray.from_buffers(len(counts), pa.py_buffer(edges.astype(np.int32)),
                                          pa.py_buffer(flat))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            whole = flat.tobytes()
            out = pa.array([whole[a:b].decode("utf-8", "replace")
                            for a, b in zip(edges, edges[1:])], pa.string())
        return out


def encode(docs: DataFrame, model: bytes, text: str = "text", name: str = "ids") -> DataFrame:
    """Rows with the ids of their whole text as an array of ints.

    ``model`` is the content of a piece model file; ids are those of the model's own library.
    A null text has null ids, an empty one none. A column already called ``name`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary file

    def make():
        encoder = kept(("encoder", hash(shared.value)), lambda: Encoder(PieceModel(shared.value)))

        def compute(batch):
            texts = batch.column(text).to_pylist()
            flat, counts = encoder.encode([t or "" for t in texts])
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            if any(t is None for t in texts):
                ids = pa.array([None if t is None else x for t, x in zip(texts, ids.to_pylist())],
                               pa.list_(pa.int32()))
            return [ids]
        return compute

    return with_columns(docs, [(name, T.ArrayType(T.IntegerType(), True))], text, make)


def decode(rows: DataFrame, model: bytes, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Rows with the text of their ids; null for null ids. Decoding gives back what was encoded
    but for the space sign, which comes back as a space."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    wide = rows.withColumn("__weight", F.lit(""))

    def make():
        decoder = Decoder(PieceModel(shared.value, merges=False))

        def compute(batch):
            column = batch.column(ids)
            counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
            found = decoder.texts(column.flatten().to_numpy(), counts)
            return [pc.if_else(column.is_null(), pa.scalar(None, pa.string()), found)]
        return compute

    return with_columns(wide, [(name, T.StringType())], "__weight", make).drop("__weight")


def op1_sentencepiece(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    """Per document: number and digest of its ids, digest of the decoded text, and whether that
    is the text again."""
    data = model_bytes(model)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decode(encode(docs, data), data).select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_xxhash64"), F.crc32("decoded").alias("decoded_crc32"),
        (F.col("decoded").eqNullSafe(F.translate("text", SPACE, " "))).alias("lossless"))
