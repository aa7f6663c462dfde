"""The pipeline's stages against their operators and a plain version of what they keep."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from reelgrid.llm import quality, toxicity
from test_simhash import plain_classes, plain_fingerprint

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows of documents and of each stage's result."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    frames = [docs]
    for name, stage in cp.STAGES:
        path = str(folder / name)
        stage(spark, frames[-1], SMALL).write.parquet(path)
        frames.append(spark.read.parquet(path))
    return frames


def test_filters_keep_columns_and_take_effect(spark, stages):
    docs, clean, good, single, _ = stages
    for frame in (clean, good, single):
        assert frame.dtypes == docs.dtypes
    network = toxicity.toxicity_model(spark, docs, SMALL)
    texts = {r["doc_id"]: r for r in docs.collect()}
    want = toxicity.WordGates(network).scores([r["text"].encode() for r in texts.values()])
    kept = {k for k, s in zip(texts, want) if s < 0.5}
    assert {r["doc_id"] for r in clean.collect()} == kept
    machine = quality.quality_model(spark, clean, SMALL)
    meta = np.array([[texts[k]["n_chars"]] for k in kept], float)
    rows = quality.Features().rows([texts[k]["text"].encode() for k in kept], meta)
    fine = {k for k, x in zip(kept, machine.logits(rows)) if x >= 0}
    assert {r["doc_id"] for r in good.collect()} == fine
    assert 0 < len(fine) < len(kept) <= len(texts)


def test_one_of_each_group_stays(stages):
    before = sorted(stages[2].collect(), key=lambda r: r["doc_id"])
    label = plain_classes([plain_fingerprint(r["text"]) for r in before], 3)
    want = {before[k]["doc_id"] for k in set(label)}
    got = stages[3].collect()
    assert {r["doc_id"] for r in got} == want and len(got) == len(want) < len(before)


def test_every_token_is_packed(stages):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = stages[4].collect()
    for r in stages[3].collect():
        ids = np.array([*plain.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        own = sorted((p for p in pieces if p["doc_id"] == r["doc_id"]), key=lambda p: p["start"])
        at = 0
        for p in own:
            assert p["start"] == at
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"]:at].tobytes())
        assert at == len(ids) == own[0]["doc_tokens"]
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in stages[3].collect()}


def test_run(spark, stages):
    got = cp.run(spark, SMALL)
    assert got.columns == stages[4].columns
    key = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert sorted(got.select(*key).collect()) == sorted(stages[4].select(*key).collect())


def test_clashing_columns_stay(spark):
    """Columns called like the stages' own come through all filters with their values."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr(
        "*", "doc_id + 7 AS predicted", "'own' AS score", "doc_id AS __id", "text AS __hash")
    for _, stage in cp.STAGES[:3]:
        docs = stage(spark, docs, SMALL)
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "predicted", "score",
                            "__id", "__hash"]
    assert docs.where("predicted <> doc_id + 7 OR score <> 'own' OR __id <> doc_id "
                      "OR __hash <> text").count() == 0
    assert docs.count() > 0


def test_null_id_stays_only_alone(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame(
        [(None, text), (5, text), (9, text), (None, "quite other words are written here"), (3, None), (4, "")],
        "doc_id long, text string")
    got = cp.drop_copies(spark, docs, SMALL).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got if r["text"]) == [
        (-1, "quite other words are written here"), (5, text)]
    assert [r["doc_id"] for r in got if not r["text"]] == [3]


def test_very_long_text(spark):
    docs = spark.createDataFrame(
        [(1, "plain words in a row " * 100_000, "en", "s", 2_100_000)],
        "doc_id long, text string, lang string, source string, n_chars long")
    own = cp.pack(spark, cp.drop_copies(spark, docs, SMALL), SMALL).collect()
    assert sum(r["length"] for r in own) == own[0]["doc_tokens"] > 500_000


def test_odd_rows(spark):
    rows = [(1, None, "en", None, 0, "x"), (None, "", None, "s", None, "x"),
            (2, "good words here", "en", "s", 15, "x"), (2, "good words here", "en", "s", 15, "x")]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, id string")
    for _, stage in cp.STAGES[:3]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns[-1] == "id"
    found = docs.collect()
    assert len([r for r in found if r["doc_id"] == 2]) == 1
    assert cp.pack(spark, docs.where("doc_id = 99"), SMALL).count() == 0
