"""The common words' code: fewer decisions a word, chances that add up, mixing against a plain loop."""

import numpy as np

from reelgrid.llm import language_model as lm

TEXTS = [b"the thin thing then thanks the them"] * 20 + ["ünï the né".encode()] * 6


def code_of(texts):
    words = [lm.words_of(t) for t in texts]
    names = sorted({w for t in words for w in t})
    counts = np.zeros((len(names) + 1, 1 + lm.CLASSES))
    for t, text in zip(words, texts):
        for w in t:
            counts[names.index(w), [0, 1 + lm.text_class(text)]] += 1
    counts[-1, :2] = 3
    code = lm.WordCode(names, counts)
    signs, sizes = code.read(texts)
    _, _, bit, slot = code.decisions(signs, code.before(signs, sizes))
    code.pairs = tuple(np.bincount(slot[bit == b], minlength=1 << lm.PAIR_BITS).astype(np.float32)
                       for b in (0, 1))
    return code


def test_codes_are_a_complete_prefix_code():
    sizes = lm.code_sizes(np.array([5, 1, 9, 3, 3, 40]))
    codes, shift = lm.canonical(sizes)
    names = [format(c, f"0{n}b") for c, n in zip(codes, sizes)]
    assert sum(2.0 ** -n for n in sizes) == 1 and min(names, key=len) == names[5]
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    nodes = {(n[:d], int(n[:d] or "0", 2) + shift[d]) for n in names for d in range(len(n))}
    assert sorted(k for _, k in nodes) == list(range(len(names) - 1))
    assert lm.code_sizes(np.array([7])).tolist() == [0]


def test_a_common_word_asks_fewer_decisions_than_its_spelling():
    code = code_of(TEXTS)
    words = lm.words_of(TEXTS[0])
    spelt = lm.MixModel(lm.huffman(np.ones(lm.SYMBOLS))).bits(words)
    owner, _, _, _ = code.decisions(code.signs(words), code.signs(words))
    assert len(owner) < len(spelt.bit) / 3


def test_chances_of_all_signs_add_up_to_one():
    code = code_of(TEXTS)
    every = np.arange(code.other + 1)
    logs = code.place_logs(every, np.ones(len(every), np.int64))
    assert abs(np.exp(logs).sum() - 1) < 1e-4


def test_mixing_against_a_plain_loop():
    code = code_of(TEXTS)
    texts = [b"the thing zzz then the them " * 9, b"", "né né the ".encode() * 13]
    signs, sizes = code.read(texts)
    before = code.before(signs, sizes)
    got, start = code.place_logs(signs, sizes), 0
    nodes, odds = code.tabulate(False)
    for size in sizes:
        w, own, kind = code.weights.astype(float), {}, 0
        squares, heard = np.full(w.shape, lm.FIRST_SQUARES), np.zeros(lm.CLASSES)
        for a in range(0, size, lm.BLOCK):
            grads, sights = np.zeros_like(w), []
            for t in range(start + a, start + min(a + lm.BLOCK, size)):
                total = 0.0
                for n, b, s in zip(*(x.tolist() for x in code.decisions(
                        signs[t:t + 1], before[t:t + 1])[1:])):
                    cell = n % (1 << lm.LIST_BITS)
                    zeros, ones = own.get(cell, (0, 0))
                    x = np.array([nodes[kind, n], (odds[s] >> 2) / lm.ODDS,
                                  np.log((ones + lm.PRIOR) / (zeros + lm.PRIOR))])
                    gate = 3 * (odds[s] & 3) + min(zeros + ones, 2)
                    chance = 1 / (1 + np.exp(-x @ w[int(gate)]))
                    total += np.log(chance if b else 1 - chance)
                    grads[int(gate)] += (b - chance) * x
                    sights.append((cell, b))
                assert abs(got[t] - total) < 1e-3
                heard += code.class_logs[signs[t]]
            squares += grads ** 2
            w += lm.RATE * grads / np.sqrt(squares)
            for cell, b in sights:
                zeros, ones = own.get(cell, (0, 0))
                own[cell] = (zeros + (b == 0), ones + (b == 1))
            kind = 1 + heard.argmax()
        start += size


def test_words_without_a_sign_share_its_chance():
    code = code_of(TEXTS)
    seen = np.array([1, 2, 0])
    logs = code.rest_logs(seen, code.other + 2, np.array([0, 0, -1.0]))
    assert np.allclose(np.exp(logs), [1 / 5, 2 / 5, 2 / 5 * np.exp(-1)])


def test_listed_and_other_words_are_all_words(spark):
    rows = [("a", 9), ("b", 7), ("c", 7), ("d", 7), ("e", 2)]
    vocabulary = spark.createDataFrame([(w, n, n, *[0] * 7) for w, n in rows],
                                       "word string, " + ", ".join(f"{c} long" for c in lm.COUNTS))
    for listed, want in ((2, [b"a", b"b"]), (3, [b"a", b"b", b"c"]), (9, [b"a", b"b", b"c", b"d"])):
        code, rest = lm.listed_words(vocabulary, listed)
        assert code.words == want
        assert sorted(r["word"] for r in rest.collect()) == sorted(
            w for w, _ in rows if w.encode() not in want)
        assert code.counts[:, 0].sum() == 32


def test_with_and_without_a_list_all_texts_are_scored(spark):
    docs = spark.createDataFrame([(k, "the thin thing then thanks the them " * 3) for k in range(9)]
                                 + [(9, None), (10, "zyx the")], "doc_id long, text string")
    counted = lm.word_counts(docs.where("doc_id < 9"))
    totals = list(counted.agg(*(lm.F.sum(c) for c in lm.COUNTS)).first())
    for listed in (0, 3, lm.LISTED):
        model = lm.fit(counted, docs.where("doc_id < 9"), listed=listed)
        assert (model.code.other if model.code else 0) == min(listed, 7)
        rows = {r["doc_id"]: r for r in lm.score(docs, counted, model, totals, 7).collect()}
        assert len(rows) == 11 and all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows.values())
        assert rows[0]["score"] > rows[0]["base_score"] and rows[10]["n_known"] == 2
