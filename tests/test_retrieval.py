"""Vector search, fused ranks and context against plain loops."""

import math
import random

from pyspark.sql import functions as F

from reelgrid.operators import retrieval as rt

WIDE = "segment_id string, embedding array<float>"


def test_exact_with_few_clusters_and_odd_vectors(spark):
    rng = random.Random(3)
    rows = [(f"s{n:03}", [rng.gauss(0, 1) for _ in range(6)]) for n in range(120)]
    rows += [("same1", rows[0][1]), ("same2", rows[0][1]), ("zero", [0.0] * 6), ("none", None),
             ("hole", [1.0, None] + [0.0] * 4), ("nan", [float("nan")] * 6), (None, rows[1][1])]
    units = rt.unit_vectors(spark.createDataFrame(rows, WIDE), "segment_id")
    kept = {r["segment_id"]: r["unit"] for r in units.collect()}
    assert len(kept) == 122
    assert all(math.isclose(sum(x * x for x in u), 1) for u in kept.values())
    asked = units.where("segment_id IN ('s000', 's007', 's050')").withColumnRenamed(
        "segment_id", "query_id")
    got = rt.nearest_segments(asked, rt.vector_index(units, centres=9), 5).collect()
    for q in ("s000", "s007", "s050"):
        want = sorted(kept, key=lambda s: (-round(sum(a * b for a, b in zip(kept[q], kept[s])), 9), s))
        own = sorted((r["place"], r["segment_id"]) for r in got if r["query_id"] == q)
        assert own == list(enumerate(want[:5], 1))


def test_slices_are_scored_by_matrices_with_many_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(rt, "VECTORS_HELD", 16)
    rng = random.Random(5)
    rows = [(f"s{n:03}", [rng.gauss(0, 1) for _ in range(6)]) for n in range(60)]
    rows += [(f"t{n:03}", rows[7][1]) for n in range(90)]
    units = rt.unit_vectors(spark.createDataFrame(rows, WIDE), "segment_id").cache()
    kept = {r["segment_id"]: r["unit"] for r in units.collect()}
    asked = units.where("segment_id IN ('s007', 's020')").withColumnRenamed("segment_id", "query_id")
    index = rt.vector_index(units, centres=4)
    dealt = asked.crossJoin(index.centres.select("cluster")).withColumnRenamed("unit", "asked")
    # a slice gives k of its equal vectors, never all of them
    scored = rt._scored(dealt, index, 2, 3).where("query_id = 's007' AND segment_id > 't'").collect()
    assert 3 <= len(scored) <= 2 * 3 * math.ceil(91 / 16)
    got = rt.nearest_segments(asked, index, 3).collect()
    for q in ("s007", "s020"):
        want = sorted(kept, key=lambda s: (-round(sum(a * b for a, b in zip(kept[q], kept[s])), 9), s))
        own = sorted((r["place"], r["segment_id"]) for r in got if r["query_id"] == q)
        assert own == list(enumerate(want[:3], 1))


def test_fused_places(spark):
    schema = "query_id long, segment_id string, place int"
    words = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], schema)
    vectors = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 1)], schema)
    got = rt.fused(words, vectors, 2).select("query_id", "place", "segment_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "b"), (1, 2, "a"), (2, 1, "d")]


def test_context_counts_a_shared_neighbour_once(spark):
    segments = spark.createDataFrame(
        [("t", n, 10) for n in range(6)], "transcript_id string, segment_index long, size long")
    hits = spark.createDataFrame(
        [(1, "t", 2, 1), (1, "t", 4, 2)],
        "query_id long, transcript_id string, segment_index long, place int")

    def shown(budget):
        rows = rt.context(hits, segments, F.col("size"), budget).collect()
        return [r["segment_index"] for r in sorted(rows, key=lambda r: r["position"])]

    assert shown(100) == [2, 1, 3, 4, 5]
    assert shown(39) == [2, 1, 3]
    assert shown(9) == []


def test_hybrid_writes_no_whole_index(spark, monkeypatch):
    from reelgrid.operators import search as se
    from reelgrid.plans import retrieval_queries as rq
    from reelgrid.plans import search_queries as sq

    monkeypatch.setattr(se, "write_index", lambda *a: (_ for _ in ()).throw(AssertionError("whole index")))
    monkeypatch.setattr(sq, "_stored", {})
    assert rq.hybrid_rank(spark, "/root/testdata/sf0.001").columns[0] == "query_id"
