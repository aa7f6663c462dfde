"""Text quality by a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid.llm.rows import kept, raw_texts, table, with_columns
from reelgrid.llm.words import WordIndex, bare, grown, labelled_sample, remainder

BUCKETS = 1 << 12
FACTORS = 8
PER_CLASS = 2000
ROUNDS = 1200
BATCH = 64
SEED = 11
MOST_WORDS = 400_000
DOCS = 128

CLASSES = np.full(256, 7, np.int64)  # bytes beyond ASCII and controls
for _kind, _members in enumerate((
        b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t",
        b"\n\r\x0b\x0c", b".,;:'\"?-()", b"!#$%&*+/<=>@[\\]^_`{|}~")):
    CLASSES[np.frombuffer(_members, np.uint8)] = _kind
SHAPES = 20


class Features:
    """Feature rows of texts: word counts by hashed word, then structure statistics."""

    def __init__(self):
        self.words = WordIndex()
        self.bucket = np.zeros(1 << 12, np.int64)

    def rows(self, texts: list[bytes], metadata: np.ndarray) -> np.ndarray:
        if len(self.words) > MOST_WORDS:
            self.words = WordIndex()
        at, counts, new = self.words.look_up(texts)
        self.bucket = grown(self.bucket, len(self.words))
        self.bucket[len(self.words) - len(new):len(self.words)] = np.fromiter(
            (zlib.crc32(bare(w)) % BUCKETS for w in new), np.int64, len(new))
        n = len(texts)
        owner = np.repeat(np.arange(n), counts)
        tf = np.bincount(owner * BUCKETS + self.bucket[at], minlength=n * BUCKETS)
        tf = tf.reshape(n, BUCKETS).astype(np.float32)
        shape = self._shapes(texts, counts, tf)
        size = np.sqrt((tf * tf).sum(axis=1))
        tf /= np.maximum(size, 1)[:, None]
        extra = np.log1p(np.maximum(np.nan_to_num(metadata, posinf=0, neginf=0), 0)) / 10
        return np.concatenate([tf, shape, extra], axis=1, dtype=np.float32)

    @staticmethod
    def _shapes(texts, counts, tf) -> np.ndarray:
        n = len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, n)
        kind = CLASSES[np.frombuffer(b"".join(texts), np.uint8)]
        owner = np.repeat(np.arange(n), sizes)
        share = np.bincount(owner * 8 + kind, minlength=8 * n).reshape(n, 8)
        again = np.zeros(len(kind))
        again[1:] = (kind[1:] == kind[:-1]) & (kind[1:] >= 5) & (kind[1:] < 7)
        again = np.bincount(owner, again, minlength=n)
        size, words = np.maximum(sizes, 1), np.maximum(counts, 1)
        distinct = (tf > 0).sum(axis=1)
        out = np.zeros((n, SHAPES))
        out[:, :8] = share / size[:, None]
        out[:, 8] = again / size
        out[:, 9] = distinct / np.minimum(words, BUCKETS)
        out[:, 10] = tf.max(axis=1, initial=0) / words
        out[:, 11] = np.log1p(counts) / 10
        out[:, 12] = np.minimum(sizes / words, 40) / 20
        letters = np.maximum(share[:, 0] + share[:, 1] + share[:, 7], 1)
        out[:, 13] = share[:, 1] / letters
        out[:, 14] = np.minimum((share[:, 5] + share[:, 6]) / words, 4) / 2
        out[:, 15] = share[:, 6] / words
        out[:, 16] = share[:, 2] / words
        out[:, 17] = share[:, 4] / words
        out[:, 18] = counts == 0
        out[:, 19] = distinct / np.maximum(tf.max(axis=1, initial=0), 1) / 100
        return np.clip(out, 0, 4)


@dataclass
class Machine:
    """Factorisation machine: bias, weights, factors."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Linear in the features: the pair sum is half of (sum)^2 less sum of squares."""
        mixed = x @ self.factors
        squares = (x * x) @ (self.factors ** 2)
        return self.bias + x @ self.weights + 0.5 * (mixed ** 2 - squares).sum(axis=1)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, prior: float, rounds: int = ROUNDS) -> Machine:
    """Adam on the log loss with a little weight decay. Where a class is missing, the score is
    that class's share; where all is missing, ``prior``."""
    n, width = x.shape
    share = y.mean() if n else prior
    model = Machine(0.0, np.zeros(width, np.float32), np.zeros((width, FACTORS), np.float32))
    if not 0 < share < 1:
        model.bias = float(np.log((share + 1e-4) / (1 - share + 1e-4)))
        return model
    rng = np.random.default_rng(SEED)
    model.factors = rng.normal(0, 0.05, (width, FACTORS)).astype(np.float32)
    model.bias = float(np.log(share / (1 - share)))
    flat = np.concatenate([[model.bias], model.weights, model.factors.ravel()]).astype(np.float32)
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, rounds + 1):
        pick = rng.integers(0, n, BATCH)
        part = x[pick]
        model = Machine(flat[0], flat[1:1 + width], flat[1 + width:].reshape(width, FACTORS))
        off = ((sigmoid(model.logits(part)) - y[pick]) / BATCH).astype(np.float32)
        mixed = part @ model.factors
        d_factors = part.T @ (off[:, None] * mixed) - model.factors * (
            (part * part).T @ off)[:, None]
        grad = np.concatenate([[off.sum()], part.T @ off, d_factors.ravel()]) + 1e-5 * flat
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        rate = 0.02 * (1 - 0.9 * step / rounds)
        flat = flat - rate * (first / (1 - 0.9**step)) / (
            np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Machine(float(flat[0]), flat[1:1 + width].astype(np.float32),
                   flat[1 + width:].reshape(width, FACTORS).astype(np.float32))


def _metadata(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    if not columns:
        return np.zeros((batch.num_rows, 0))
    return np.stack([batch.column(c).cast(pa.float64()).fill_null(0).to_numpy(
        zero_copy_only=False) for c in columns], axis=1)


def fit(docs: DataFrame, labels: DataFrame, label: str, taught, doc_id: str = "doc_id",
        text: str = "text", metadata: tuple[str, ...] = (), per_class: int = PER_CLASS,
        prior: float = 1.0) -> Machine:
    """Learns from a bounded sample: at most ``per_class`` labelled texts a class, whole.

    Tasks make the sample's feature rows; the driver gets their nonzero entries only.
    Classes are weighed back to their shares among all taught labels by the bias.
    """
    sample = labelled_sample(docs, labels, label, taught, per_class, doc_id)
    sample = sample.select(F.col(text).alias("text"), "taught_label",
                           *(F.col(c).cast("double").alias(f"m{k}") for k, c in enumerate(metadata)))
    meta = [f"m{k}" for k in range(len(metadata))]

    def make():
        features = Features()

        def compute(batch):
            rows = features.rows(raw_texts(batch, "text"), _metadata(batch, meta))
            at = [np.flatnonzero(r).astype(np.uint16) for r in rows]
            return [pa.array([a.tobytes() for a in at], pa.binary()),
                    pa.array([r[a].tobytes() for r, a in zip(rows, at)], pa.binary())]
        return compute

    found = with_columns(sample, [("at", T.BinaryType()), ("x", T.BinaryType())], "text", make)
    rows = found.select("taught_label", "at", "x").collect()  # at most 2 * per_class
    rows.sort(key=lambda r: (r["at"], r["x"]))
    x = np.zeros((len(rows), BUCKETS + SHAPES + len(meta)), np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["x"], np.float32)
    y = np.array([r["taught_label"] for r in rows], np.float32)
    model = train(x, y, prior)
    shares = dict(map(tuple, labels.where(taught & F.col(label).isin(0, 1))
                      .groupBy(F.col(label).cast("int")).count().collect()))
    if len(y) and 0 < y.mean() < 1:
        model.bias += float(np.log(shares[1] / shares[0]) - np.log(y.mean() / (1 - y.mean())))
    return model


def score(docs: DataFrame, model: Machine, text: str = "text", metadata: tuple[str, ...] = (),
          name: str = "score", predicted: str = "predicted") -> DataFrame:
    """Rows with ``name``, 0 to 1, and ``predicted`` (1 at 0.5 or more) for their whole text.

    Null and empty texts are scored like any other, from their shape; null metadata counts as
    zero. Columns already called so are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows at most

    def make():
        kept("quality", lambda: None)  # lets stores of other operators go
        features, machine = Features(), shared.value

        def compute(batch):
            texts, meta = raw_texts(batch, text), _metadata(batch, list(metadata))
            out = [sigmoid(machine.logits(features.rows(texts[a:a + DOCS], meta[a:a + DOCS])))
                   for a in range(0, len(texts), DOCS)]
            value = np.concatenate(out).astype(np.float64)
            return [pa.array(value), pa.array((value >= 0.5).astype(np.int32))]
        return compute

    return with_columns(docs, [(name, T.DoubleType()), (predicted, T.IntegerType())], text, make)


def quality_model(spark, docs: DataFrame, sf_dir: str) -> Machine:
    """Learnt from labelled rows whose crc32(doc_id) modulo 3 is not 1."""
    return fit(docs, table(spark, sf_dir, "labels"), "quality", remainder("doc_id", 3) != 1,
               metadata=("n_chars",))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scored = score(docs, quality_model(spark, docs, sf_dir), metadata=("n_chars",))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score",
                         "predicted")
