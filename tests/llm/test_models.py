"""Quality and toxicity models: parts against plain versions, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgrid.llm import quality as ql
from reelgrid.llm import toxicity as tx
from reelgrid.llm.words import labelled_sample, remainder

LARGE = "/root/testdata/sf0.1"
ODD = "doc_id long, text string, n_chars long, score double, Predicted string"


def odd_rows(spark):
    return spark.createDataFrame(
        [(1, None, None, 9.0, "x"), (None, "", 0, 9.0, "x"), (3, " \n", -5, 9.0, "x"),
         (4, "long " * 60000, 7, 9.0, "x"), (4, "long " * 60000, 7, 9.0, "x"),
         (5, "x" * 300000, 1, 9.0, "x"), (6, "日本 \x00 🙂", 5, 9.0, "x")], ODD)


def test_pair_sum_identity():
    rng = np.random.default_rng(0)
    m = ql.Machine(0.3, rng.normal(size=7), rng.normal(size=(7, 3)))
    x = rng.normal(size=(5, 7))
    want = [0.3 + r @ m.weights + sum(m.factors[i] @ m.factors[j] * r[i] * r[j]
                                      for i in range(7) for j in range(i)) for r in x]
    assert np.allclose(m.logits(x), want)


def test_feature_rows_do_not_depend_on_the_batch():
    texts = [b"", b"One two, TWO!", b"a$$$ b$$$\n\nc", "é è".encode() * 9]
    meta = np.array([[0.0], [13.0], [np.nan], [5.0]])
    whole = ql.Features().rows(texts, meta)
    features = ql.Features()
    single = [features.rows([t], m[None])[0] for t, m in zip(texts, meta)]
    assert np.array_equal(whole, np.stack(single)) and np.isfinite(whole).all()
    counts = np.bincount([zlib.crc32(w) % ql.BUCKETS for w in (b"one", b"two", b"two")],
                         minlength=ql.BUCKETS)
    assert np.allclose(whole[1, :ql.BUCKETS], counts / np.sqrt(5))


def test_gradient_of_the_network():
    rng = np.random.default_rng(2)
    net = tx.Network({b"a": 1, b"b": 2})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    gates = rng.normal(size=(2, 6, 3 * tx.HIDDEN))
    at = rng.integers(0, 6, (4, 5))
    size = np.array([5, 3, 1, 4])
    weight = rng.normal(size=4)

    def loss():
        return float(net.run(gates, at, size) @ weight)

    logits, passed = net.run(gates, at, size, keep=True)
    grad, d_gates = net.back(weight, passed)
    for name in ("turn", "look", "out", "bias"):
        flat = net.p[name].reshape(-1)
        for k in rng.choice(flat.size, min(6, flat.size), replace=False):
            old = flat[k]
            flat[k] = old + 1e-2
            up = loss()
            flat[k] = old - 1e-2
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-2 - grad[name].reshape(-1)[k]) < 2e-3
    for d in (0, 1):
        word, unit = 3, 5
        old = gates[d, word, unit]
        gates[d, word, unit] = old + 1e-2
        up = loss()
        gates[d, word, unit] = old - 1e-2
        down = loss()
        gates[d, word, unit] = old
        want = d_gates[d].transpose(1, 0, 2)[at == word][:, unit].sum()
        assert abs((up - down) / 2e-2 - want) < 2e-3


def test_windows_overlap_and_cover():
    owner, first, size = tx.windows_of(np.array([1, 32, 33, 100]))
    spans = [[(int(f), int(f + s)) for o, f, s in zip(owner, first, size) if o == k]
             for k in range(4)]
    assert spans == [[(0, 1)], [(0, 32)], [(0, 32), (16, 33)],
                     [(0, 32), (16, 48), (32, 64), (48, 80), (64, 96), (80, 100)]]


def test_a_text_scores_as_its_worst_window():
    net = tx.Network({b"word": 1})
    net.p = {k: v * 3 for k, v in net.p.items()}
    words = [b"word%d" % (k * k % 37) for k in range(90)]
    scorer = tx.WordGates(net)
    whole = scorer.scores([b" ".join(words), b"other text"])[0]
    _, first, size = tx.windows_of(np.array([90]))
    parts = [scorer.scores([b" ".join(words[f:f + s])])[0] for f, s in zip(first, size)]
    assert abs(whole - max(parts)) < 1e-6


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{LARGE}/labels.parquet")


def test_quality_held_out(spark, labels):
    got = ql.op4_quality(spark, LARGE)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r["predicted"] == r["quality"] for r in rows])
    clean = [r["predicted"] for r in rows if r["quality"] == 1]
    assert right > 0.97 and np.mean(clean) > 0.99


def test_toxicity_held_out(spark, labels):
    got = tx.op10_toxicity(spark, LARGE)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(labels, "doc_id").where("held_out").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    # 360 toxic texts teach here, too few for the rarer languages; larger tables give all
    assert np.mean(toxic) > 0.75 and np.mean(clean) < 0.01


def test_held_out_rows_teach_nothing(spark, labels):
    docs = spark.read.parquet(f"{LARGE}/documents.parquet")
    sample = labelled_sample(docs, labels, "toxic", remainder("doc_id", 5) > 0, 30).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in sample)
    assert sum(r["taught_label"] for r in sample) == 30 and len(sample) == 60


def test_odd_rows(spark, labels):
    docs = odd_rows(spark)
    machine = ql.train(np.zeros((0, 5), np.float32), np.zeros(0), 1.0)
    assert ql.sigmoid(machine.bias) > 0.99
    rng = np.random.default_rng(0)
    width = ql.BUCKETS + ql.SHAPES + 1
    machine = ql.Machine(0.1, rng.normal(0, .1, width).astype(np.float32),
                         rng.normal(0, .1, (width, 4)).astype(np.float32))
    scorers = [ql.score(docs, machine, metadata=("n_chars",)), tx.score(docs, tx.Network({})),
               tx.score(docs, None)]
    for scored in scorers:
        assert [c.lower() for c in scored.columns] == [
            "doc_id", "text", "n_chars", "score", "predicted"]
        rows = scored.collect()
        assert len(rows) == 7
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 4}) == 1
        assert scored.where("doc_id = 99").count() == 0
    empty = labels.where("doc_id < 0")
    assert tx.fit(docs, empty, "toxic", F.lit(True)) is None
    assert ql.fit(docs, empty, "quality", F.lit(True), metadata=("n_chars",)).bias > 5


def test_contradicting_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1)],
                                   "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", F.lit(True), 9).collect()
    assert [(r["doc_id"], r["taught_label"]) for r in rows] == [(1, 1)]
