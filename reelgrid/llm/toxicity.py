"""Toxicity by a bidirectional gated recurrent network with attention over word windows."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid.llm.rows import kept, raw_texts, table, with_columns
from reelgrid.llm.words import WordIndex, bare, grown, labelled_sample, remainder

WINDOW, STEP = 32, 16
CHAR_BUCKETS = 1 << 13
GRAMS = (3, 5, 7)
SEEN_IN = 8
DROPPED = 0.4
WORD_DIM, CHAR_DIM, HIDDEN = 8, 8, 8
PER_CLASS = 800
ROUNDS, BATCH = 320, 16
MOST_WORDS = 200_000
WINDOWS = 2048
SEED = 5


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and length of each window: WINDOW words every STEP, until the last
    word is in one. A text has one window at least."""
    many = 1 + np.maximum(0, -(-(counts - WINDOW) // STEP))
    owner = np.repeat(np.arange(len(counts)), many)
    first = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * STEP
    return owner, first, np.minimum(WINDOW, counts[owner] - first)


def spellings(words: list[bytes], known: dict[bytes, int]):
    """Place of each word among the known ones (0: none), and the hash buckets of its byte
    sequences of the lengths GRAMS, word ends marked, with their number."""
    words = [bare(w) for w in words]
    own = np.fromiter((known.get(w, 0) for w in words), np.int64, len(words))
    padded = [b"<%b>" % w for w in words]
    flat = np.frombuffer(b"".join(padded) + bytes(max(GRAMS)), np.uint8).astype(np.int64)
    length = np.fromiter(map(len, padded), np.int64, len(words))
    first = np.cumsum(length) - length
    found, sizes = [], np.zeros(len(words), np.int64)
    for n in GRAMS:
        mixed = np.zeros(len(flat) - max(GRAMS), np.int64)
        for k in range(n):
            mixed = mixed * 65599 + flat[k:k + len(mixed)]
        many = np.maximum(length - n + 1, n == min(GRAMS))
        found.append((np.repeat(np.arange(len(words)), many),
                      ((mixed * 2654435761) >> 20)[_ranges(first, many)] % CHAR_BUCKETS))
        sizes += many
    owner, buckets = (np.concatenate(x) for x in zip(*found))
    return own, buckets[np.argsort(owner, kind="stable")], sizes


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Network:
    """Known words, parameters by name and the passes through them, in 32-bit floats."""

    def __init__(self, known: dict[bytes, int], params: dict[str, np.ndarray] | None = None,
                 seed: int = SEED):
        self.known = known
        if params is None:
            rng = np.random.default_rng(seed)

            def draw(scale, *shape):
                return rng.normal(0, scale, shape).astype(np.float32)

            width = WORD_DIM + CHAR_DIM
            params = {"word": draw(0.1, len(known) + 1, WORD_DIM),
                      "char": draw(0.3, CHAR_BUCKETS, CHAR_DIM),
                      "in": draw(width**-0.5, 2, width, 3 * HIDDEN),
                      "shift": np.zeros((2, 1, 3 * HIDDEN), np.float32),
                      "turn": draw(HIDDEN**-0.5, 2, HIDDEN, 3 * HIDDEN),
                      "look": draw(0.3, 2 * HIDDEN), "out": draw(0.5, 2 * HIDDEN),
                      "bias": np.full(1, -4, np.float32)}
        self.p = params

    def inputs(self, own, chars, sizes) -> np.ndarray:
        """Word vectors beside the mean of their spelling vectors."""
        starts = np.cumsum(sizes) - sizes
        spelt = np.add.reduceat(self.p["char"][chars], starts, axis=0) / sizes[:, None]
        return np.concatenate([self.p["word"][own], spelt], axis=1, dtype=np.float32)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What words add to the gates, both directions: (2, words, 3 * HIDDEN)."""
        return x @ self.p["in"] + self.p["shift"]

    def run(self, gates: np.ndarray, at: np.ndarray, size: np.ndarray, keep: bool = False):
        """Logits of windows; ``at`` has word places (windows, WINDOW), of which the first
        ``size`` count. ``keep``: also all that ``back`` needs."""
        n, steps = at.shape
        there = (np.arange(steps) < size[:, None]).astype(np.float32)
        turn, hidden = self.p["turn"], np.zeros((2, n, HIDDEN), np.float32)
        states = np.zeros((steps, 2, n, HIDDEN), np.float32)
        kept = []
        for s in range(steps):
            times = (s, steps - 1 - s)
            x = np.stack([gates[d][at[:, t]] for d, t in enumerate(times)])
            on = np.stack([there[:, t] for t in times])[:, :, None]
            u = hidden @ turn
            gate = sigmoid(x[..., :2 * HIDDEN] + u[..., :2 * HIDDEN])
            z, r = gate[..., :HIDDEN], gate[..., HIDDEN:]
            fresh = np.tanh(x[..., 2 * HIDDEN:] + r * u[..., 2 * HIDDEN:])
            after = hidden + on * (1 - z) * (fresh - hidden)
            if keep:
                kept.append((hidden, z, r, fresh, u[..., 2 * HIDDEN:], on))
            hidden = states[s] = after
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2).transpose(1, 0, 2)
        sight = np.where(there > 0, both @ self.p["look"], -1e9)
        share = np.exp(sight - sight.max(axis=1, keepdims=True)) * there
        share /= share.sum(axis=1, keepdims=True)
        pooled = (share[:, None, :] @ both)[:, 0]
        logits = pooled @ self.p["out"] + self.p["bias"][0]
        return (logits, (both, share, pooled, kept)) if keep else logits

    def back(self, d_logits: np.ndarray, passed) -> tuple[dict, np.ndarray]:
        """Gradients of the shared parameters and of each word's gates (2, windows, steps, .)."""
        both, share, pooled, kept = passed
        n, steps, _ = both.shape
        grad = {"out": pooled.T @ d_logits, "bias": d_logits.sum(keepdims=True)}
        d_pooled = d_logits[:, None] * self.p["out"]
        d_share = (both @ d_pooled[:, :, None])[:, :, 0]
        d_sight = share * (d_share - (share * d_share).sum(axis=1, keepdims=True))
        grad["look"] = np.einsum("nt,nth->h", d_sight, both)
        d_both = share[:, :, None] * d_pooled[:, None, :] + d_sight[:, :, None] * self.p["look"]
        d_both = d_both.transpose(1, 0, 2)
        turn = self.p["turn"]
        grad["turn"] = np.zeros_like(turn)
        d_gates = np.zeros((2, steps, n, 3 * HIDDEN), np.float32)
        d_hidden = np.zeros((2, n, HIDDEN), np.float32)
        for s in range(steps - 1, -1, -1):
            before, z, r, fresh, u, on = kept[s]
            d_hidden = d_hidden + np.stack([d_both[s, :, :HIDDEN],
                                            d_both[steps - 1 - s, :, HIDDEN:]])
            d_new = on * d_hidden
            d_fresh = d_new * (1 - z) * (1 - fresh**2)
            d_z = d_new * (before - fresh) * z * (1 - z)
            d_r = d_fresh * u * r * (1 - r)
            d_in = np.concatenate([d_z, d_r, d_fresh], axis=2)
            d_turn = np.concatenate([d_z, d_r, d_fresh * r], axis=2)
            grad["turn"] += before.transpose(0, 2, 1) @ d_turn
            d_hidden = d_hidden - d_new * (1 - z) + d_turn @ turn.transpose(0, 2, 1)
            d_gates[0, s], d_gates[1, steps - 1 - s] = d_in[0], d_in[1]
        return grad, d_gates


class WordGates:
    """A task's words with their gate inputs, computed once per word."""

    def __init__(self, network: Network):
        self.network = network
        self.clear()

    def clear(self):
        self.words = WordIndex()
        self.rows = np.zeros((1 << 10, 2, 3 * HIDDEN), np.float32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Highest window probability of each text."""
        if len(self.words) > MOST_WORDS:
            self.clear()
        at, counts, new = self.words.look_up([t if t.strip() else b"-" for t in texts])
        if new:
            x = self.network.inputs(*spellings(new, self.network.known))
            self.rows = grown(self.rows, len(self.words))
            self.rows[len(self.words) - len(new):len(self.words)] = (
                self.network.gates(x).transpose(1, 0, 2))
        gates = self.rows.transpose(1, 0, 2)
        owner, first, size = windows_of(counts)
        first = first + (np.cumsum(counts) - counts)[owner]
        at = np.concatenate([at, np.zeros(WINDOW, np.int64)])
        logits = np.concatenate([self.network.run(
            gates, at[first[a:a + WINDOWS, None] + np.arange(WINDOW)], size[a:a + WINDOWS])
            for a in range(0, len(first), WINDOWS)])
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        return sigmoid(np.maximum.reduceat(logits, starts).astype(np.float64))


def train(texts: list[bytes], y: np.ndarray, rounds: int = ROUNDS, seed: int = SEED) -> Network:
    """Learns from whole labelled texts.

    A text's logit is the smooth maximum over its windows, so a clean text pushes all its
    windows down and a toxic one its most suspicious ones up. Words of fewer than SEEN_IN
    texts have one vector together, and word and spelling inputs drop out at random, so that
    no single text is learnt by heart. Adam; half of each batch toxic.
    """
    seen = Counter(w for t in texts for w in {bare(x) for x in t.split()})
    common = sorted(w for w, n in seen.items() if n >= SEEN_IN)
    net = Network({w: k for k, w in enumerate(common, 1)}, seed=seed)
    rng = np.random.default_rng(seed)
    at, counts, new = WordIndex().look_up([t if t.strip() else b"-" for t in texts])
    own, chars, sizes = spellings(new, net.known)
    char_first = np.cumsum(sizes) - sizes
    text_first = np.cumsum(counts) - counts
    at = np.concatenate([at, np.zeros(WINDOW, np.int64)])
    good, bad = np.flatnonzero(y == 0), np.flatnonzero(y == 1)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, rounds + 1):
        pick = np.concatenate([rng.choice(good, BATCH // 2), rng.choice(bad, BATCH // 2)])
        owner, start, size = windows_of(counts[pick])
        words = at[(start + text_first[pick][owner])[:, None] + np.arange(WINDOW)]
        used, place = np.unique(words, return_inverse=True)
        place = place.reshape(words.shape)
        used_chars = chars[_ranges(char_first[used], sizes[used])]
        held = (rng.random((2, len(used), 1)) >= DROPPED) / np.float32(1 - DROPPED)
        held = np.concatenate([np.repeat(held[0], WORD_DIM, 1), np.repeat(held[1], CHAR_DIM, 1)],
                              axis=1, dtype=np.float32)
        x = net.inputs(own[used], used_chars, sizes[used]) * held
        logits, passed = net.run(net.gates(x), place, size, keep=True)
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        top = np.maximum.reduceat(logits, starts)
        soft = np.exp(logits - top[owner])
        whole = np.add.reduceat(soft, starts)
        off = (sigmoid(top + np.log(whole)) - y[pick]) / len(pick)
        grad, d_gates = net.back((off[owner] * soft / whole[owner]).astype(np.float32), passed)
        flat = d_gates.transpose(0, 2, 1, 3).reshape(2, -1, 3 * HIDDEN)
        d_used = np.zeros((2, len(used), 3 * HIDDEN), np.float32)
        order = np.argsort(place.ravel(), kind="stable")
        edges = np.flatnonzero(np.diff(place.ravel()[order], prepend=-1))
        for d in (0, 1):
            d_used[d] = np.add.reduceat(flat[d][order], edges, axis=0)
        grad["in"] = x.T @ d_used
        grad["shift"] = d_used.sum(axis=1, keepdims=True)
        d_x = (d_used @ net.p["in"].transpose(0, 2, 1)).sum(axis=0) * held
        grad["word"], grad["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
        np.add.at(grad["word"], own[used], d_x[:, :WORD_DIM])
        np.add.at(grad["char"], used_chars,
                  np.repeat(d_x[:, WORD_DIM:] / sizes[used][:, None], sizes[used], axis=0))
        rate = 0.02 * (1 - 0.95 * step / rounds)
        for k, g in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.p[k] = net.p[k] - (rate * (first[k] / (1 - 0.9**step)) / (
                np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        for k in ("word", "char"):
            net.p[k] *= np.float32(1 - 0.002)
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str, taught, doc_id: str = "doc_id",
        text: str = "text", per_class: int = PER_CLASS, rounds: int = ROUNDS) -> Network | None:
    """A network learnt from at most ``per_class`` labelled texts a class, whole; None where a
    class has no text."""
    rows = labelled_sample(docs, labels, label, taught, per_class, doc_id).select(
        F.col(text).cast("binary").alias("text"), "taught_label").collect()
    rows.sort(key=lambda r: (bytes(r["text"] or b""), r["taught_label"]))
    y = np.array([r["taught_label"] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    return train([bytes(r["text"] or b"") for r in rows], y, rounds)


def score(docs: DataFrame, network: Network | None, text: str = "text", name: str = "score",
          predicted: str = "predicted") -> DataFrame:
    """Rows with ``name``, 0 to 1: the highest probability of any window of the whole text, and
    ``predicted`` (1 at 0.5 or more).

    Null, empty and blank texts are scored as one blank word. Without a network all scores
    are 0. Columns already called so are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        network and (network.known, network.p))  # words of the bounded sample at most

    def make():
        kept("toxicity", lambda: None)  # lets stores of other operators go
        scorer = WordGates(Network(*shared.value)) if shared.value else None

        def compute(batch):
            value = (scorer.scores(raw_texts(batch, text)) if scorer and batch.num_rows
                     else np.zeros(batch.num_rows))
            return [pa.array(value), pa.array((value >= 0.5).astype(np.int32))]
        return compute

    return with_columns(docs, [(name, T.DoubleType()), (predicted, T.IntegerType())], text, make)


def toxicity_model(spark, docs: DataFrame, sf_dir: str) -> Network | None:
    """Learnt from labelled rows whose crc32(doc_id) modulo 5 is not 0."""
    return fit(docs, table(spark, sf_dir, "labels"), "toxic", remainder("doc_id", 5) > 0)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
                         "predicted")
