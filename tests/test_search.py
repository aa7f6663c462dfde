import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import rows
from reelgrid.functions import text as tx
from reelgrid.operators import search as se

SEGMENTS = ("id string, transcript_id string, recording_id string, segment_index long, "
            "start_ms long, end_ms long, text string")


def library(spark, texts, status="completed"):
    segments = spark.createDataFrame(
        [(f"s{i}", "t1", "r1", i, i * 5000, i * 5000 + 4000, t) for i, t in enumerate(texts)], SEGMENTS)
    transcripts = spark.createDataFrame([("t1", "r1", status)], "id string, recording_id string, status string")
    recordings = spark.createDataFrame(
        [("r1", "Title", None, None, None, "1")],
        "id string, title string, media_path string, thumbnail_path string, captured_at string, created_at string")
    return segments, transcripts, recordings


def test_hit_stale_restored(spark):
    s, t, r = library(spark, ["Opening words here.", "Harbour lights and compass turns."])
    index = se.build_index(s, t)
    found = se.search("compass", index, s, t, r).collect()
    assert [(x.segment_id, x.start_ms) for x in found] == [("s1", 5000)]
    assert "[compass]" in found[0].snippet

    failed = t.withColumn("status", F.lit("failed"))
    assert se.search("compass", index, s, failed, r).count() == 0
    replaced = se.replace_in_index(index, s, failed)
    assert replaced.documents.count() == 0

    s2, t2, _ = library(spark, ["Compass returns anew."])
    back = se.replace_in_index(replaced, s2, t2)
    assert back.corpus.head().n == 1
    assert se.search("anew", back, s2, t2, r).count() == 1


def test_query_tokens_and_phrases(spark):
    one = spark.createDataFrame([("Hello, foo_Bar--ÉTÉ 9!",), ("?!",), ("_",)], "q string")
    got = one.select(tx.query_tokens(F.col("q")), tx.query_phrases(F.col("q"))).collect()
    assert got[0][0] == ["hello", "foo_bar", "ÉtÉ", "9"]
    assert got[0][1] == [["hello"], ["foo", "bar"], ["ete"], ["9"]]
    assert got[1][0] == [] and got[2][1] == [[]]


def test_no_tokens_and_only_underscores_match_nothing(spark):
    s, t, r = library(spark, ["a b c"])
    index = se.build_index(s, t)
    assert se.search(" ?! ", index, s, t, r).count() == 0
    assert se.search("a _", index, s, t, r).count() == 0


def test_underscore_token_needs_adjacent_words(spark):
    s, t, r = library(spark, ["big red car", "red big car", "big big red"])
    index = se.build_index(s, t)
    assert {x.segment_id for x in se.search("big_red", index, s, t, r).collect()} == {"s0", "s2"}
    queries = spark.createDataFrame([(1, "big_red car"), (2, "red"), (3, "nothing red")],
                                    "query_id int, query string")
    got = se.search_batch(queries, index, s, t, r).collect()
    assert {(x.query_id, x.segment_id) for x in got} == {
        (1, "s0"), (2, "s0"), (2, "s1"), (2, "s2")}


def brute_rank(texts, query):
    docs = [re.findall(r"[a-z0-9]+", x.lower()) for x in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    out = {}
    for i, d in enumerate(docs):
        tf, score = Counter(d), 0.0
        for w in query:
            if not tf[w]:
                score = None
                break
            df = sum(w in x for x in docs)
            idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
            score -= idf * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(d) / avg))
        if score is not None:
            out[f"s{i}"] = round(score, 9)
    return out


def test_rank_equals_brute_force_single_and_batch(spark):
    words = "alpha beta gamma delta eps zeta".split()
    texts = [" ".join(words[(i * j) % 6] for j in range(1, 3 + i % 7)) for i in range(40)]
    s, t, r = library(spark, texts)
    index = se.build_index(s, t)
    for query in (["alpha"], ["beta", "gamma"], ["alpha", "alpha"], ["delta", "eps", "zeta"]):
        want = brute_rank(texts, query)
        single = {x.segment_id: x.rank for x in se.match_query(" ".join(query), index).collect()}
        batch = {x.segment_id: x.rank for x in se.match_and_rank(
            spark.createDataFrame([(1, " ".join(query))], "query_id int, query string"), index).collect()}
        assert set(single) == set(want) == set(batch)
        assert all(abs(single[k] - want[k]) < 1e-8 and abs(batch[k] - want[k]) < 1e-8 for k in want)


def test_limit_is_clamped_and_order_is_total(spark):
    assert [se.clamp_limit(x) for x in (None, 0, 7, 1000)] == [50, 1, 7, 100]
    s, t, r = library(spark, ["same words"] * 120)
    found = se.search("same", se.build_index(s, t), s, t, r, limit=500).collect()
    assert [x.start_ms for x in found] == [i * 5000 for i in range(100)]


def test_snippet_windows(spark):
    text = " ".join(f"w{i}" for i in range(40)) + ". Key word, key!"
    df = spark.createDataFrame([(text,), ("Short: key.",), ("...",)], "text string")
    got = [x[0] for x in df.select(se.snippet(F.col("text"), tx.query_phrases(F.lit("key")))).collect()]
    assert got[0].startswith("...w") and got[0].endswith("[Key] word, [key]!")
    assert got[1] == "Short: [key]." and got[2] == "..."
    early = spark.createDataFrame([("key " + " ".join(f"w{i}" for i in range(30)),)], "text string")
    assert early.select(se.snippet(F.col("text"), tx.query_phrases(F.lit("key")))).head()[0] == (
        "[key] " + " ".join(f"w{i}" for i in range(17)) + "...")
    joined = spark.createDataFrame([("a Red  car here",)], "text string")
    assert joined.select(se.snippet(F.col("text"), tx.query_phrases(F.lit("red_car")))).head()[0] == (
        "a [Red  car] here")


def test_stored_index_append_and_counts(spark, tmp_path):
    s, t, r = library(spark, ["one two", "two three"])
    path = str(tmp_path / "ix")
    assert se.reindex(s, t, path, 4).head().indexed_segment_count == 2
    more, _, _ = library(spark, ["one two", "two three", "three four five"])
    se.append_missing(more, t, path, 4)
    index = se.read_index(spark, path, 4)
    assert index.corpus.head().n == 3
    assert rows(index.terms.where("term = 'three'")) == [("three", 2, 2)]
    se.append_missing(more, t, path, 4)
    assert se.read_index(spark, path, 4).documents.count() == 3
    found = se.search("three", se.read_index(spark, path, 4), more, t, r).collect()
    assert len(found) == 2
    plan = se.match_query("three", se.read_index(spark, path, 4))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "term_bucket" in plan


def test_append_cut_short_runs_again(spark, tmp_path):
    s, t, r = library(spark, ["one two", "two three"])
    path = str(tmp_path / "ix")
    se.write_index(se.build_index(s, t), path, 4)
    more, _, _ = library(spark, ["one two", "two three", "three four five"])
    added = se.index_segments(se.unindexed_segments(more, t, se.read_index(spark, path, 4)))
    se.write_by_term(added.postings, f"{path}/postings/batch=1", "overwrite", 4)
    assert se.read_index(spark, path, 4).terms.where("term = 'four'").count() == 0
    se.append_missing(more, t, path, 4)
    index = se.read_index(spark, path, 4)
    assert rows(index.terms.where("term IN ('three', 'four')"), "term") == [("four", 1, 1), ("three", 2, 2)]
    query = spark.createDataFrame([(1, "four")], "query_id int, query string")
    assert se.match_and_rank(query, index).count() == se.match_query("four", index).count() == 1


def test_stored_replace_and_rebuild(spark, tmp_path):
    s, t, r = library(spark, ["one two", "two three"])
    path = str(tmp_path / "ix")
    se.write_index(se.build_index(s, t), path, 4)
    se.replace_stored(s, t.withColumn("status", F.lit("failed")), path, 4)
    gone = se.read_index(spark, path, 4)
    assert gone.terms.count() == gone.documents.count() == gone.postings.count() == 0
    s2, t2, _ = library(spark, ["two new words"])
    se.replace_stored(s2, t2, path, 4)
    back = se.read_index(spark, path, 4)
    assert rows(back.terms, "term") == [("new", 1, 1), ("two", 1, 1), ("words", 1, 1)]
    assert tuple(back.corpus.head()) == (1, 3.0) and back.positions.count() == 3
    se.write_index(se.build_index(s, t), path, 4)
    assert se.read_index(spark, path, 4).documents.count() == 2


def test_many_queries_on_one_word(spark):
    s, t, r = library(spark, ["common " * (1 + i % 3) for i in range(60)])
    queries = spark.range(1000).select("id", F.lit("common").alias("query")).withColumnRenamed("id", "query_id")
    got = se.search_batch(queries, se.build_index(s, t), s, t, r, limit=5)
    counts = got.groupBy("query_id").count().groupBy("count").count().collect()
    assert [tuple(x) for x in counts] == [(5, 1000)]


def test_combining_marks_and_case(spark):
    df = spark.createDataFrame([("Ca\u0301fe \u00c9T\u00c9 na\u00efve",), (None,)], "t string")
    got = [x[0] for x in df.select(tx.index_tokens(F.col("t"))).collect()]
    assert got == [["cafe", "ete", "naive"], []]


def test_compaction_keeps_results_and_survives_a_cut(spark, tmp_path, monkeypatch):
    """Batches with replaced transcripts folded into one: the same rows, no list of dropped
    transcripts, and a run cut off before its entry changes nothing."""
    path = str(tmp_path / "index")
    s, t, _ = library(spark, ["alpha beta alpha", "beta gamma", "gamma delta gamma", "alpha"])
    se.write_index(se.build_index(s, t), path, 4)
    new = s.withColumn("text", F.lit("omega beta"))
    for _ in range(2):
        se.replace_stored(new, t, path, 4)

    def facts():
        index = se.read_index(spark, path, 4)
        return (rows(index.terms, "term"), rows(index.postings.drop("term_bucket"), "term", "segment_id"),
                rows(index.documents, "segment_id"), rows(index.corpus),
                rows(se.match_query("omega_beta", index), "segment_id"))

    before = facts()
    assert [r.drops for r in se._batches(spark, path)] == [False, True, True]

    real = se.write_by_term
    monkeypatch.setattr(se, "write_by_term", lambda *a: (_ for _ in ()).throw(RuntimeError("cut off")))
    with pytest.raises(RuntimeError):
        se.compact_index(spark, path, 4)
    assert facts() == before
    monkeypatch.setattr(se, "write_by_term", real)
    se.compact_index(spark, path, 4)
    assert facts() == before
    assert [r.drops for r in se._batches(spark, path)] == [False]
    assert se.idle_batches(spark, path) == [0, 1, 2]
    se.compact_index(spark, path, 4)
    assert se.idle_batches(spark, path) == [0, 1, 2]


def test_search_skips_blocks_that_cannot_win(spark, tmp_path):
    """The same winners with every posting read and with few; fewer are read, ties at the last
    place and segments of failed transcripts included."""
    texts = [" ".join(["hot"] * (1 + i % 7) + [f"w{i}"] + ["cold"] * (i % 31)) for i in range(600)]
    texts += ["hot cold hot"] * 40
    s, t, r = library(spark, texts)
    s = s.withColumn("transcript_id", F.concat(F.lit("t"), "segment_index"))
    t = s.select(F.col("transcript_id").alias("id"), "recording_id", F.when(
        F.col("segment_index") % 5 == 0, "failed").otherwise("completed").alias("status"))
    path = str(tmp_path / "index")
    se.write_index(se.index_segments(s), path, 4)
    index = se.read_index(spark, path, 4)
    for query in ("hot", "cold hot", "hot_cold hot"):
        whole = [tuple(x) for x in se.search(query, index, s, t, r, 10).collect()]
        few = [tuple(x) for x in se.search(query, index, s, t, r, 10, few_postings=5).collect()]
        assert whole == few and len(whole) == 10
    asked = se.parse_query(spark, "hot", 4)
    _, _, read, held = se.few_blocks(asked, index, t, 10, 5)
    assert held == 640 and read < held / 2


def test_snippets_are_made_by_all_tasks(spark):
    import oracle
    from reelgrid.plans import search_queries as sq

    small = "/root/testdata/sf0.001"
    found = sq.search_snippet(spark, small)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert oracle.difference(found, oracle.connect(small), sq.SEARCH_SNIPPET_SQL) is None


def test_batch_keeps_its_own_words_only(spark, tmp_path):
    texts = ["big red car", "Red big car", "big big red", "", None, "caf\u00e9 \u0301 bar big", "other words"]
    s, t, r = library(spark, texts)
    queries = spark.createDataFrame(
        [(1, "big_red car"), (2, "red"), (3, "nothing red"), (4, "cafe_bar"), (5, "big big"), (6, "_"), (7, "red")],
        "query_id int, query string")
    path = str(tmp_path / "words")
    index, whole = se.index_words(queries, s, path), se.build_index(s, t)
    assert {x.term for x in spark.read.parquet(path).collect()} == {"", "big", "red", "car", "cafe", "bar"}
    assert index.corpus.head() == whole.corpus.head()
    got, want = ({(x.query_id, x.segment_id, x.rank) for x in se.match_and_rank(queries, i).collect()}
                 for i in (index, whole))
    assert got == want and {q for q, _, _ in got} == {1, 2, 5, 7}


def test_batch_queries_write_no_whole_index(spark, monkeypatch):
    from reelgrid.plans import retrieval_queries as rq, search_queries as sq

    monkeypatch.setattr(se, "write_index", lambda *a: (_ for _ in ()).throw(AssertionError("whole index")))
    monkeypatch.setattr(sq, "_stored", {})
    assert sq.search_bm25_batch(spark, "/root/testdata/sf0.001").columns[0] == "query_id"
