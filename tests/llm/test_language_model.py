"""Language-model scores: base by brute force, the code and the mixing against plain versions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from reelgrid.llm import language_model as lm

SMALL = "/root/testdata/sf0.01"


def plain_tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), lm.END_WORD]


@pytest.fixture(scope="module")
def scored(spark):
    return {r["doc_id"]: r for r in lm.op7_language_model(spark, SMALL).collect()}


def test_base_by_brute_force(spark, scored):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in rows}
    counts = Counter(t for r in rows if not held[r["doc_id"]] for t in plain_tokens(r["text"]))
    total, distinct = sum(counts.values()), len(counts)
    assert len(scored) == len(rows)
    for r in rows:
        got, tokens = scored[r["doc_id"]], plain_tokens(r["text"])
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens)
        assert (got["held_out"], got["n_tokens"], got["n_known"], got["train_tokens"]) == (
            held[r["doc_id"]], len(tokens), sum(t in counts for t in tokens), total)
        assert abs(got["base_score"] - base) < 1e-6 * max(1, -base)


def test_model_is_better_than_base_on_held_out(scored):
    held = [r for r in scored.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.98 * sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 and r["bits_per_byte"] > 0 for r in scored.values())


def small_model(words):
    counts = np.arange(1, len(words) + 1)
    seen = np.ones(258, np.int64)
    for w, c in zip(words, counts):
        seen[list(w)] += c
    model = lm.MixModel(lm.huffman(seen))
    bits = model.bits(words)
    for k, width in enumerate(lm.TABLE_BITS):
        model.counts.append(tuple(np.bincount(
            bits.slots[k][bits.bit == b], counts[bits.word][bits.bit == b],
            minlength=1 << width).astype(np.float32) for b in (0, 1)))
    model.weights = lm.first_weights().astype(np.float32)
    return model


def test_huffman_paths_are_a_complete_code():
    paths = lm.huffman(np.array([5, 1, 9, 3, 3, 40]))
    codes = ["".join(str(b) for _, b in p) for p in paths]
    assert sum(2.0 ** -len(c) for c in codes) == 1
    assert len(codes[5]) == min(map(len, codes))


def test_symbols_after_a_start_share_probability_one():
    """Chances of the symbols that can follow a start of a word add up to one at most."""
    words = [b"the", b"then", b"than", "é".encode(), lm.END_WORD.encode()]
    model = small_model(words)
    for start in (b"", b"t", b"th", b"zz"):
        total = 0
        for symbol in range(258):
            if symbol in [*b" \t\n\r\x0b\x0c"] or symbol == (lm.END if start else lm.SPACE):
                continue  # no word has these here
            word = b" " if symbol == lm.END else start + bytes([symbol] if symbol < 256 else [])
            bits = model.bits([word])
            inputs, gate = model.inputs(bits)
            at = np.flatnonzero(bits.place == len(start))
            assert len(at) == len(model.paths[symbol])
            chance = 1 / (1 + np.exp(-(inputs[at] * model.weights[0][gate[at]]).sum(axis=1)))
            total += np.prod(np.where(bits.bit[at] == 1, chance, 1 - chance))
        assert 0.5 < total <= 1 + 1e-5


def test_bits_do_not_depend_on_the_batch():
    words = [b"a", b"longer", lm.END_WORD.encode(), b"x" * 90, "ünï".encode()]
    model = small_model(words)
    whole = model.word_logs(words)
    single = np.concatenate([model.word_logs([w]) for w in words])
    assert np.allclose(whole, single) and (whole < 0).all()


def test_mixing_against_a_plain_loop():
    rng = np.random.default_rng(0)
    logs = -rng.uniform(1, 9, (6, 3))
    counts = np.array([1, 50, 17, 16])
    at = rng.integers(0, 6, counts.sum())
    got = lm.mixed_logs(counts, at, logs)
    start = 0
    for k, n in enumerate(counts):
        shares = np.full(4, (1 - lm.FIRST_SHARE) / 3)
        shares[0] = lm.FIRST_SHARE
        total, words, made = 0.0, at[start:start + n], np.zeros(4)
        for t, w in enumerate(words):
            cache = (list(words[:t]).count(w) + lm.CACHE * math.exp(logs[w, 0])) / (t + lm.CACHE)
            row = np.append(logs[w], math.log(cache))
            total += math.log(float(shares @ np.exp(row)))
            made += row
            if t % lm.BLOCK == lm.BLOCK - 1:
                shares = shares * np.exp(made - made.max()) + 1e-300
                shares = (1 - lm.SHARE) * shares / shares.sum() + lm.SHARE / 4
                made = np.zeros(4)
        assert abs(total - got[k]) < 1e-9
        start += n


def text_model(texts):
    """Counts of contexts inside words and across them, from texts as lists of words."""
    words = [w for t in texts for w in t]
    model = small_model(sorted(set(words)))
    bits = model.bits(words, [w for t in texts for w in (b"", *t[:-1])])
    for k, width in enumerate(lm.TEXT_BITS, len(lm.TABLE_BITS)):
        model.text_counts.append(tuple(np.bincount(
            bits.slots[k][bits.bit == b], minlength=1 << width).astype(np.float32)
            for b in (0, 1)))
    model.text_weights = lm.first_text_weights()
    return model


def test_text_before_a_word_changes_its_chance():
    """Words seen in one order only: the same words score better in that order, also where
    they are equally common, and each text alone as among others."""
    texts = [lm.words_of(b"red apple green pear " * 3)] * 20
    model = text_model(texts)
    in_order, turned = (lm.words_of(x) for x in (b"red apple green pear", b"pear green apple red"))
    logs = model.text_logs([in_order, turned, texts[0]])
    assert (logs < 0).all()
    assert logs[:5].sum() > logs[5:10].sum() + 1
    assert np.allclose(logs[5:10], model.text_logs([turned]), atol=1e-5)


def test_scores_follow_the_text_while_it_is_read():
    """A new word that comes again and again gets likelier after each block of words."""
    model = text_model([lm.words_of(b"the cat sat on a mat")] * 5)
    logs = model.text_logs([lm.words_of(b"zyx " * (3 * lm.BLOCK))])
    blocks = logs[:3 * lm.BLOCK].reshape(3, -1).mean(axis=1)
    assert blocks[0] < blocks[1] < blocks[2]


def test_mixed_symbols_share_probability_one():
    """Chances of all symbols after a start add up to one at most, across words too."""
    model = text_model([lm.words_of(b"the cat sat on a mat")] * 5)
    total = 0
    for symbol in range(258):
        if symbol in [*b" \t\n\r\x0b\x0c"] or symbol == lm.SPACE:
            continue
        word = b" " if symbol == lm.END else bytes([symbol])
        bits = model.bits([word], [b"cat"])
        none = np.zeros(len(bits.bit), np.float32)
        inputs, gate = model.text_inputs(bits, (none, none))
        at = np.flatnonzero(bits.place == 0)
        chance = 1 / (1 + np.exp(-(inputs[:, at].T * model.text_weights[gate[at]]).sum(axis=1)))
        total += np.prod(np.where(bits.bit[at] == 1, chance, 1 - chance))
    assert 0.5 < total <= 1 + 1e-5


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, 0), (None, "", 0), (2, "a b\tc", 0), (2, "a b\tc", 0), (3, "w" * 50000, 0),
         (4, "new words \x00 🙂 " * 3000, 0)], "doc_id long, text string, score int")
    counted = lm.word_counts(docs.where("doc_id = 2"))
    distinct, totals = 4, [counted.agg({c: "sum"}).first()[0] for c in lm.COUNTS]
    model = lm.fit(counted)
    rows = lm.score(docs, counted, model, totals, distinct, chunk_bytes=1000).collect()
    assert sorted((r["n_tokens"], r["n_known"]) for r in rows) == [
        (1, 1), (1, 1), (2, 1), (4, 4), (4, 4), (12001, 1)]
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 2}) == 1
    none = lm.word_counts(docs.where("doc_id = 9"))
    assert none.count() == 0
    empty = lm.fit(none)
    got = lm.score(docs, none, empty, [0] * len(lm.COUNTS), 0).collect()
    assert len(got) == 6 and all(np.isfinite(r["score"]) and r["n_known"] == 0 for r in got)
    assert lm.score(docs.where("doc_id = 9"), none, empty, [0] * len(lm.COUNTS), 0).count() == 0
