"""Alignment of two tokenizers against their own libraries on whole texts and plain loops."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from reelgrid.llm import alignment as al

SMALL = "/root/testdata/sf0.001"
A = Tokenizer.from_file(public_tokenizers.path(al.BYTE_TOKENIZER))
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=public_tokenizers.path(al.PIECE_MODEL))
DEFINITION = open(public_tokenizers.path(al.BYTE_TOKENIZER), encoding="utf-8").read()
MODEL = open(public_tokenizers.path(al.PIECE_MODEL), "rb").read()
RUNS = al.Runs(al.Tokenizers(DEFINITION, MODEL))


def tokens(text):
    """(A tokens, B tokens) as (id, first byte, end) of the whole text; none where they do not
    spell it."""
    whole = (" " + text).encode()
    if not text:
        return [], []
    out = []
    for ids, spelt in ((A.encode(" " + text, add_special_tokens=False).ids, RUNS.tokenizers.a_bytes),
                       (B.encode(text), RUNS.tokenizers.b_bytes)):
        at, found = 0, []
        for i in ids:
            found.append((i, at, at + len(spelt[i])))
            at += len(spelt[i])
        if b"".join(spelt[i] for i in ids) != whole:
            return [], []
        out.append(found)
    return out


def plain(text):
    """Groups as text and all links, by comparing every pair of tokens."""
    a, b = tokens(text or "")
    links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
    ends = sorted({x[2] for x in a} & {y[2] for y in b})
    groups, start = [], 0
    for end in ends:
        groups.append("|".join(",".join(str(t[0]) for t in side if start < t[2] <= end)
                               for side in (a, b)))
        start = end
    return len(a), len(b), groups, links


def plain_rows(docs):
    found = [(d, *plain(t)) for d, t in docs]
    counts = Counter(link for f in found for link in f[4])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted([(d, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links),
                    sum(counts[x] for x in links),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "")
                   for d, n_a, n_b, groups, links in found], key=repr)


ODD = ["", " ", "  a", "a\nb  c", "two  spaces   three", "tab\tand \n line\n\n end ", " lead", "tail ",
       "naïve Ünï 日本語 テスト 🙂🙂 x", "▁ sign", "a▁b", "<|endoftext|> <s> </s> <0x41> <unk>",
       "don't we'll", "x" * 700, "日本" * 300, "1234567 3.14 !!! ?? ...", "\x00 nul \x1c sep \x85 q",
       "  nbsp em", "é ​ zero", "word " * 50]


def one(text):
    at = RUNS.look_up([text.encode()])[0]
    if at is None:
        return 0, 0, [], 0
    facts = RUNS.facts[at].sum(axis=0).tolist()
    return facts[0], facts[1], ";".join(RUNS.groups[n] for n in at).split(";"), facts[3]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    n_a, n_b, groups, links = plain(text)
    assert one(text) == (n_a, n_b, groups, len(links))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t ab.'1é日▁"), st.characters()), max_size=40)
       .map(lambda t: t.encode("utf-8", "ignore").decode()))
def test_any_text(text):
    n_a, n_b, groups, links = plain(text)
    assert one(text) == (n_a, n_b, groups, len(links))


@given(st.lists(st.integers(1, 5), min_size=1, max_size=12), st.randoms())
def test_groups_and_links_of_sizes(sizes, random):
    """Another cut of the same bytes."""
    whole, other = sum(sizes), []
    while sum(other) < whole:
        other.append(random.randint(1, min(5, whole - sum(other))))
    spans = [[(sum(s[:k]), sum(s[:k + 1])) for k in range(len(s))] for s in (sizes, other)]
    want = {(i, j) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1])
            if x[0] < y[1] and y[0] < x[1]}
    a_ends, b_ends = ([x[1] for x in side] for side in spans)
    i, j = al.overlaps(al.np.array(a_ends), al.np.array(b_ends))
    got = list(zip(i.tolist(), j.tolist()))
    assert len(got) == len(set(got)) and set(got) == want
    i_to, j_to = al.align(a_ends, b_ends)
    assert [a_ends[k - 1] for k in i_to] == [b_ends[k - 1] for k in j_to] == sorted(
        set(a_ends) & set(b_ends))


def query(spark, folder, docs, columns="doc_id long, text string"):
    spark.createDataFrame(docs, columns).repartition(2).write.parquet(f"{folder}/documents.parquet")
    return sorted(map(tuple, al.op11_alignment(spark, str(folder)).collect()), key=repr)


def test_query_on_given_documents(spark, tmp_path):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select(
        "doc_id", "text").collect() if len(r.text or "") < 20_000]
    assert query(spark, tmp_path, docs) == plain_rows(docs)


def test_odd_rows_and_small_chunks(spark, tmp_path, monkeypatch):
    """Nulls, repeated rows, ties of counts, clashing columns; many chunks and a store that
    starts afresh give the same."""
    docs = [(k, t) for k, t in enumerate(ODD)] + [(None, "a b"), (None, None), (3, "a b"), (3, "a b"),
                                                  (90, "long text, " * 4000)]
    wide = [(*d, "kept", 1) for d in docs]
    columns = "doc_id long, text string, runs string, chunk int"
    whole = query(spark, tmp_path / "a", wide, columns)
    monkeypatch.setattr(al.aligned, "__defaults__", ("doc_id", "text", 100))
    assert query(spark, tmp_path / "b", wide, columns) == whole
    few = [d for d in docs if d[0] != 90]
    assert query(spark, tmp_path / "c", few) == plain_rows(few)


def test_store_that_starts_afresh(monkeypatch):
    runs = al.Runs(RUNS.tokenizers)
    before = [runs.look_up([t.encode()])[0] is None for t in ODD]
    runs.clear()
    assert [runs.look_up([t.encode()])[0] is None for t in ODD] == before


def test_empty_table(spark, tmp_path):
    assert query(spark, tmp_path, []) == []
