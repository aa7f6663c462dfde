"""The mixed bits: fewer decisions by a code for each symbol before, sure misses, plain loops."""

import numpy as np

from reelgrid.llm import language_model as lm

TEXTS = [lm.words_of(x) for x in [b"the thin thing then thanks them"] * 20 + ["ünï né".encode()] * 3]


def pairs_of(texts):
    pairs = np.zeros((lm.START + 1, lm.SYMBOLS), np.int64)
    for w in (w for t in texts for w in t):
        symbols = [lm.END] if w == b" " else [*w, lm.SPACE]
        for a, b in zip([lm.START, *symbols], symbols):
            pairs[a, b] += 1
    return pairs


def model_of(texts, code):
    """Counts by a plain loop over decisions."""
    words = [w for t in texts for w in t]
    model = lm.MixModel(code)
    bits = model.bits(words, [w for t in texts for w in (b"", *t[:-1])])
    made = []
    for k, width in enumerate(lm.TABLE_BITS + lm.TEXT_BITS):
        pair = np.zeros((2, 1 << width), np.float32)
        for slot, bit in zip(bits.slots[k], bits.bit):
            pair[bit, slot] += 1
        made.append(tuple(pair))
    model.counts, model.text_counts = made[:len(lm.TABLE_BITS)], made[len(lm.TABLE_BITS):]
    model.weights = lm.first_weights().astype(np.float32)
    model.text_weights = lm.first_text_weights()
    return model, bits


def test_code_after_each_symbol_asks_less():
    pairs = pairs_of(TEXTS)
    after, bits = model_of(TEXTS, lm.codes_after(pairs))
    single, plain = model_of(TEXTS, lm.huffman(pairs.sum(axis=0) + 1))
    assert len(bits.bit) < 0.8 * len(plain.bit)
    assert after.text_logs(TEXTS).sum() > single.text_logs(TEXTS).sum()


def test_codes_share_probability_one():
    model, _ = model_of(TEXTS, lm.codes_after(pairs_of(TEXTS)))
    for start in (b"", b"t", b"th", b"zz"):
        total = 0
        for symbol in range(lm.SYMBOLS):
            if symbol in [*b" \t\n\r\x0b\x0c"] or symbol == (lm.END if start else lm.SPACE):
                continue
            bits = model.bits([b" " if symbol == lm.END else
                               start + bytes([symbol] if symbol < 256 else [])], [b"cat"])
            none = np.zeros(len(bits.bit), np.float32)
            inputs, gate = model.text_inputs(bits, (none, none))
            at = np.flatnonzero(bits.place == len(start))
            chance = 1 / (1 + np.exp(-(inputs[:, at].T * model.text_weights[gate[at]]).sum(axis=1)))
            total += np.prod(np.where(bits.bit[at] == 1, chance, 1 - chance))
        assert 0.5 < total <= 1 + 1e-5


def test_sure_and_wrong_costs_no_infinite_loss():
    model, _ = model_of(TEXTS, lm.codes_after(pairs_of(TEXTS)))
    model.text_weights = np.full_like(model.text_weights, 50)
    logs = model.text_logs([lm.words_of(b"the zebra thinks xylophone")])
    assert np.isfinite(logs).all()


def test_text_logs_against_a_plain_loop():
    """Decision by decision: predictors from the counts, own counts, weights after each block."""
    model, _ = model_of(TEXTS, lm.codes_after(pairs_of(TEXTS)))
    words = lm.words_of(b"the thick then zyx zyx " * 9)
    w, squares = model.text_weights.astype(float), np.full(model.text_weights.shape, lm.FIRST_SQUARES)
    own, want, before = {}, [], b""
    for a in range(0, len(words), lm.BLOCK):
        grads, sights = np.zeros_like(w), []
        for word in words[a:a + lm.BLOCK]:
            bits, total = model.bits([word], [before]), 0.0
            for k in range(len(bits.bit)):
                x = [np.log((n1[s[k]] + lm.PRIOR) / (n0[s[k]] + lm.PRIOR)) for (n0, n1), s in
                     zip(model.counts + model.text_counts, bits.slots)]
                last = bits.slots[len(lm.TABLE_BITS) - 1][k]
                n = sum(c[last] for c in model.counts[-1])
                cell = last & (1 << lm.OWN_BITS) - 1
                seen = own.get(cell, (0, 0))
                x += [np.log((seen[1] + lm.PRIOR) / (seen[0] + lm.PRIOR)), 1.0]
                gate = min(bits.place[k], 7) * 3 + (n > 0) + (n > 30)
                chance = 1 / (1 + np.exp(-np.dot(x, w[gate])))
                total += np.log(chance if bits.bit[k] else 1 - chance)
                grads[gate] += (bits.bit[k] - chance) * np.array(x)
                sights.append((cell, bits.bit[k]))
            want.append(total)
            before = word
        squares += grads ** 2
        w += lm.RATE * grads / np.sqrt(squares)
        for cell, bit in sights:
            zeros, ones = own.get(cell, (0, 0))
            own[cell] = (zeros + (bit == 0), ones + (bit == 1))
    assert np.allclose(model.text_logs([words]), want, atol=1e-3)


def test_learning_leaves_the_decision_itself_out():
    model, bits = model_of(TEXTS, lm.codes_after(pairs_of(TEXTS)))
    none = np.zeros(len(bits.bit), np.float32)
    got, gate = model.text_inputs(bits, (none, none), own=True)
    for k, (n0, n1) in enumerate(model.counts + model.text_counts):
        zeros = np.array([max(n0[s] - (b == 0), 0) for s, b in zip(bits.slots[k], bits.bit)])
        ones = np.array([max(n1[s] - (b == 1), 0) for s, b in zip(bits.slots[k], bits.bit)])
        assert np.allclose(got[k], np.log((ones + lm.PRIOR) / (zeros + lm.PRIOR)), atol=1e-5)
        if k == len(lm.TABLE_BITS) - 1:
            known = (zeros + ones > 0).astype(int) + (zeros + ones > 30)
            assert (gate == np.minimum(bits.place, 7) * 3 + known).all()
