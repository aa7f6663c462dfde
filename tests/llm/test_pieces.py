"""Piece ids and counts against the model's own library; the unigram rule, for which there is
no file, against a plain search."""

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from reelgrid.llm import pieces as pc
from reelgrid.llm import sentencepieces as sn
from reelgrid.llm import token_counts as tc

SMALL = "/root/testdata/sf0.001"
DATA = pc.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))


def unigram(data):
    """The same pieces and scores under the unigram rule."""
    model = pc.PieceModel(data)
    model.is_bpe = False
    return model


def plain_unigram(model, text):
    """Ids of the highest total over each run of characters; the earliest start of equals."""
    out = []
    for word in map(model.segment, model.words(text)):
        best = [(0.0, [])]
        for end in range(1, len(word) + 1):
            top = (-float("inf"), None)
            for start in range(max(0, end - 16), end):
                token = model.token.get(word[start:end])
                ids = None if token is None else [int(model.ids[token])]
                if token is None and end - start == 1:
                    token = model.unknown
                    ids = [int(model.byte_ids[b]) for b in word[start].encode()]
                if token is not None and best[start][0] + model.score[token] > top[0]:
                    top = (best[start][0] + model.score[token], best[start][1] + ids)
            best.append(top)
        out += best[-1][1]
    return out


BPE = pc.PieceModel(DATA)
UNIGRAM = unigram(DATA)
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=DATA)
ENCODERS = [sn.Encoder(BPE), sn.Encoder(UNIGRAM)]
COUNTERS = [tc.Counter(BPE), tc.Counter(UNIGRAM)]

ODD = ["", " ", "a", "Hello world", "  two  spaces   here ", "line\nbreak\n\n next", "\n", " \n a",
       "naïve Ünïİ", "日本語テキスト です", "🙂🙂 ok", "\x00 nul", "▁sign▁here▁▁", "tab\there",
       "<s> </s> <0x0A> <unk>", "a" * 200, "ab " * 90, "thththe ononont heererer", "x" * 64,
       "antidisestablishmentarianism " * 3, "don't stop", "€100,000.00", " " * 40 + "x"]


def same(texts):
    for encoder, counter in zip(ENCODERS, COUNTERS):
        want = [LIBRARY.encode(t) if encoder.model.is_bpe else plain_unigram(encoder.model, t)
                for t in texts]
        flat, counts = encoder.encode(texts)
        got, at = [], 0
        for c in counts:
            got.append(flat[at:at + c].tolist())
            at += c
        assert got == want
        assert counter.totals(texts).tolist() == [len(w) for w in want]
        decoder = sn.Decoder(encoder.model)
        back = decoder.texts(np.array(flat, np.int64), np.array(counts)).to_pylist()
        assert back == [t.replace("▁", " ") for t in texts]


def test_odd_texts():
    same(ODD)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text("athereons \n▁", max_size=40)), max_size=3))
def test_any_text(texts):
    same([t.encode("utf-8", "ignore").decode() for t in texts])


def test_documents(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    for encoder, counter in zip(ENCODERS[:1], COUNTERS):
        want = LIBRARY.encode([r["text"] for r in rows])
        flat, counts = encoder.encode([r["text"] for r in rows])
        assert flat.tolist() == [i for w in want for i in w]
    got = {r["doc_id"]: r for r in sn.op1_sentencepiece(spark, SMALL).collect()}
    assert {k: r["n_pieces"] for k, r in got.items()} == {
        r["doc_id"]: len(w) for r, w in zip(rows, want)}
    assert all(r["lossless"] for r in got.values())
    counted = {r["doc_id"]: r["n_tokens"] for r in tc.op6_token_counts(spark, SMALL).collect()}
    assert counted == {k: r["n_pieces"] for k, r in got.items()}


@pytest.mark.parametrize("operator", [sn, tc])
def test_odd_rows(spark, operator):
    rows = [(1, None, "x"), (None, "", "x"), (2, "two words", "x"), (2, "two words", "x"),
            (3, "w" * 100000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    if operator is sn:
        got = sn.decode(sn.encode(docs, DATA), DATA)
        assert got.columns == ["doc_id", "text", "ids", "decoded"]
        found = got.collect()
        assert [r["decoded"] for r in found] == [r["text"] for r in found]
        assert {r["ids"] is None for r in found if r["text"] is None} == {True}
    else:
        got = tc.count_tokens(docs, DATA, name="ids")
        want = {t: len(LIBRARY.encode(t or "")) for _, t, _ in rows}
        assert all(r["ids"] == want[r["text"]] for r in got.collect())
    assert got.where("doc_id = 9").count() == 0


def test_ids_that_spell_no_text():
    decoder = sn.Decoder(BPE)
    ids = np.array([1, *BPE.byte_ids[[0xFF, 0xC3]], int(BPE.ids[BPE.token["▁a"]])])
    assert decoder.texts(ids, np.array([4, 0])).to_pylist() == ["\ufffd\ufffd a", ""]


def test_small_store_changes_nothing(monkeypatch):
    texts = [f"word{k} and more{k % 7}" for k in range(60)]
    for module in (sn, tc):
        monkeypatch.setattr(module, "MOST_WORDS", 5)
    for t in texts:
        same([t])
