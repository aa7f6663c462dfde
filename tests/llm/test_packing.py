"""Packing against the plain tokenizer, and the packing rules."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reelgrid.llm import packing as pk
from reelgrid.llm.word_tokens import WordTokens

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(pk.TOKENIZER)
DEFINITION = pk.definition_of(PATH)
PLAIN = Tokenizer.from_file(PATH)
WORDS = WordTokens(DEFINITION)


def plain_ids(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 2]


ODD = ["", " \t\n", "Don't STOP", "naïve Ünïİ İstanbul ΣΑΣ", "é äb ́x",
       "<|endoftext|> a<|startoftext|>b", "x y z\x85q \x1c\x1d a\x1fb", "1234 ½²",
       "日本語 テスト", "🙂🙂 ok", "a­b \x00 \x7f", "l'été d'où we'll they'VE", "ǅ ﬁ K Å",
       "word " * 3000, "x" * 9000]


def test_odd_texts():
    got = WORDS.encode([t.encode() for t in ODD], 2)
    assert [x.tolist() for x in got] == [plain_ids(t) for t in ODD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = WORDS.encode([t.encode() for t in texts], 2)
    assert [x.tolist() for x in got] == [plain_ids(t) for t in texts]


def check_pieces(pieces, docs, window):
    """Every id in one piece, windows gapless; share of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(docs)
    for name, ids in docs.items():
        own = sorted(by_doc[name], key=lambda p: p["start"])
        assert [p["start"] for p in own] == [0, *np.cumsum([p["length"] for p in own])[:-1]]
        assert all(p["doc_tokens"] == len(ids) for p in own)
        assert sum(p["length"] for p in own) == len(ids)
        for p in own:
            part = np.array(ids[p["start"]:p["start"] + p["length"]], "<u4")
            assert p["ids_crc32"] == zlib.crc32(part.tobytes())
    used = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [0, *np.cumsum([p["length"] for p in own])[:-1]]
        total = sum(p["length"] for p in own)
        assert 0 < total <= window
        used += total
    return 1 - used / (window * len(by_sequence))


def test_query(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    docs = {r["doc_id"]: plain_ids(r["text"]) for r in rows}
    assert check_pieces(pk.op5_packing(spark, SMALL).collect(), docs, pk.WINDOW) < 0.05


def test_small_windows(spark):
    rows = [(k, ("word " * (k * 7 % 61)) or None) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "Body")
    df = df.selectExpr("doc_id", "Body", "'x' AS ids", "1 AS offset").repartition(5)
    got = pk.piece_digests(pk.pack(df, DEFINITION, text="Body", window=64, open_windows=4,
                                   merged_windows=8)).collect()
    docs = {k: plain_ids(t) for k, t in rows}
    # pieces up to the window size and four open windows: the hard case for best fit
    assert check_pieces(got, docs, 64) < 0.12


def test_repeats_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    got = [r for r in pk.pack(df, DEFINITION).collect()]
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got) == [(0, 1), (1, 3), (1, 3)]
    assert len({r["sequence_id"] for r in got}) == 1 and got[0]["sequence_id"] >= 1 << 62
    assert pk.pack(df.where("doc_id > 1"), DEFINITION).count() == 0


def test_best_fit_and_fullest():
    p = pk.Packer(10, 2, 0)
    for name, size in (("a", 6), ("b", 5), ("c", 4), ("d", 9), ("e", 3)):
        p.place(name, 0, np.zeros(size, np.uint32), size)
    assert [(r[0], r[5], r[6]) for r in p.rows] == [("a", 0, 0), ("c", 0, 6)]
    p.place("f", 0, np.zeros(4, np.uint32), 4)
    # the fullest takes the head of the piece that fits nowhere, the rest opens a window
    assert [(r[0], r[1], r[2], r[6]) for r in p.rows[-2:]] == [("d", 0, 9, 0), ("f", 0, 1, 9)]
    assert [w[0] for w in p.windows] == [8, 3]


def test_documents_over_half_a_window_fill_it():
    """Lengths of which no two fit one window: pieces are cut into the room that is left."""
    for sizes in ([2100] * 1500, [2049 + (k * 37) % 1950 for k in range(1500)]):
        packer = pk.Packer(4096, 64, 0)
        for name, size in enumerate(sizes):
            packer.document(name, np.arange(size, dtype=np.uint32))
        closed = packer.next_id
        held = sum(r[2] for r in packer.rows)
        assert held / (closed * 4096) > 0.97 and len(packer.windows) <= 64
        assert all(ids.base is None for w in packer.windows for _, _, ids, _ in w[1])
        packer.finish(left_open=True)
        seen = defaultdict(list)
        for name, start, length, total, ids, _, _, _ in packer.rows:
            assert np.frombuffer(ids, np.uint32).tolist() == list(range(start, start + length))
            seen[name].append((start, length, total))
        for name, size in enumerate(sizes):
            parts = sorted(seen[name])
            assert sum(p[1] for p in parts) == size == parts[0][2]
            assert [p[0] for p in parts] == [sum(q[1] for q in parts[:k]) for k in range(len(parts))]


def test_whole_windows_evict_nothing():
    packer = pk.Packer(8, 1, 0)
    packer.document("a", np.arange(3, dtype=np.uint32))
    packer.document("b", np.arange(16, dtype=np.uint32))
    assert [r[0] for r in packer.rows] == ["b", "b"] and packer.windows[0][0] == 3
