"""Segments found by vector, by vector and words together, and as context for a question."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.functions.text import let

CENTRES = 64
SLICES = 8
FUSION = 60  # ranks are damped by this many places
DIGITS = 9  # similarities that agree so far are equal
SLACK = 1e-6  # what rounding may add to a bound
VECTORS_HELD = 1 << 13  # vectors of a slice that meet its queries at a time


class VectorIndex(NamedTuple):
    """``vectors`` (segment_id, cluster, slice, unit, cosine), ``clusters`` (cluster, centre, reach),
    where reach is the widest angle between a cluster's vectors and its centre; ``centres``
    (cluster, centre) are known before any vector is placed."""

    vectors: DataFrame
    clusters: DataFrame
    centres: DataFrame


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def unit_vectors(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, unit) of vectors of length one. Vectors that are null, zero or hold a null or
    non-finite component are left out, as are null keys."""
    own = rows.select(F.col(key), F.col(vector).cast("array<double>").alias("v"))
    sound = own.where(F.col(key).isNotNull() & F.forall(
        "v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sized = sound.withColumn("size", size).where("size > 0 AND size < double('inf')")
    return sized.select(key, let(F.col("size"), lambda n: F.transform("v", lambda x: x / n)).alias("unit"))


def vector_index(units: DataFrame, centres: int = CENTRES, slices: int = SLICES) -> VectorIndex:
    """Vectors by their nearest centre. Centres are the ``centres`` vectors least by hash of
    their segment, so a rebuild gives the same clusters; they ride along as one small value."""
    picked = units.orderBy(F.xxhash64("segment_id"), "segment_id").limit(centres).agg(
        F.sort_array(F.collect_list(F.struct(F.col("segment_id").alias("cluster"), "unit"))))
    near = let(F.col("unit"), lambda unit: F.array_max(F.transform("centres", lambda c: F.struct(
        _dot(unit, c["unit"]).alias("cosine"), c["cluster"].alias("cluster"),
        c["unit"].alias("centre")))))
    # vectors cost far more than their bytes tell, so they are dealt over all tasks
    placed = units.repartition(_tasks(units), "segment_id").withColumn(
        "centres", picked.scalar()).withColumn("near", near).select(
        "segment_id", F.col("near.cluster").alias("cluster"),
        F.pmod(F.xxhash64("segment_id"), F.lit(slices)).alias("slice"), "unit",
        F.col("near.cosine").alias("cosine"))
    centre = picked.select(F.explode(picked.columns[0]).alias("c")).select(
        F.col("c.cluster").alias("cluster"), F.col("c.unit").alias("centre"))
    return VectorIndex(placed, _clusters(placed, centre), centre)


def _tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _clusters(placed: DataFrame, centre: DataFrame) -> DataFrame:
    return placed.groupBy("cluster").agg(_angle(F.min("cosine")).alias("reach")).join(
        centre.dropDuplicates(["cluster"]), "cluster").select("cluster", "centre", "reach")


def write_vector_index(index: VectorIndex, path: str) -> None:
    """Places all vectors once; what is known of the clusters follows from the stored ones."""
    (index.vectors.repartition("cluster", "slice").write.mode("overwrite").partitionBy("cluster")
     .parquet(f"{path}/vectors"))
    spark = index.vectors.sparkSession
    _clusters(_stored_vectors(spark, path), index.centres).write.mode(
        "overwrite").parquet(f"{path}/clusters")


def _stored_vectors(spark, path: str) -> DataFrame:
    return spark.read.schema("segment_id string, slice bigint, unit array<double>, cosine double, "
                             "cluster string").parquet(f"{path}/vectors")


def read_vector_index(spark, path: str) -> VectorIndex:
    clusters = spark.read.parquet(f"{path}/clusters")
    return VectorIndex(_stored_vectors(spark, path), clusters, clusters.select("cluster", "centre"))


def _best_pairs(asked: np.ndarray, held: np.ndarray, ids: np.ndarray, k: int):
    """Rows of ``asked`` and of ``held`` that may be among the k nearest, and their products,
    each added up in order. Of equal ones the k of smallest id are kept."""
    found = asked @ held.T
    k = min(k, found.shape[1])
    least = np.partition(found, -k, axis=1)[:, -k] - SLACK
    for q, row in enumerate(found):
        at = np.flatnonzero(row >= least[q])
        exact = np.cumsum(asked[q] * held[at], axis=1)[:, -1] + 0.0
        order = np.lexsort((ids[at], exact))
        at, exact = at[order], exact[order]
        first = np.searchsorted(exact, exact)  # of its equals
        kept = np.arange(len(exact)) - first < k
        yield q, at[kept], exact[kept]


def _scored(asked: DataFrame, index: VectorIndex, slices: int, k: int) -> DataFrame:
    """Similarities of (query_id, asked, cluster) with the vectors of that cluster that may be
    among the query's k nearest; a cluster is dealt over its slices, so a hot one is scored by
    many tasks, each by products of matrices."""
    dealt = asked.withColumn("slice", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint"))))

    def best(own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        parts = [([], [], [])]
        if len(own) and len(near):
            queries, names = np.stack(own["asked"]), own["query_id"].to_numpy()
            for at in range(0, len(near), VECTORS_HELD):
                some = near.iloc[at:at + VECTORS_HELD]
                ids = some["segment_id"].to_numpy(dtype=object)
                for q, found, exact in _best_pairs(queries, np.stack(some["unit"]), ids, k):
                    parts.append((names[[q] * len(found)], ids[found], exact))
        return pd.DataFrame({n: pd.Series([x for c in column for x in c], dtype=t) for n, t, column in zip(
            ("query_id", "segment_id", "similarity"), (own["query_id"].dtype, object, float), zip(*parts))})

    kind = asked.schema["query_id"].dataType.simpleString()
    return dealt.groupBy("cluster", "slice").cogroup(
        index.vectors.select("cluster", "slice", "segment_id", "unit").groupBy("cluster", "slice")
    ).applyInPandas(best, f"query_id {kind}, segment_id string, similarity double")


def _top(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(
        F.round("similarity", DIGITS).desc(), "segment_id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nearest_segments(queries: DataFrame, index: VectorIndex, k: int, slices: int = SLICES
                     ) -> DataFrame:
    """(query_id, segment_id, similarity, place): the ``k`` segments of largest cosine for each
    (query_id, unit), ties by segment. The result is exact.

    A query's nearest cluster is scored first. Its k-th similarity found there is a floor: a
    cluster is read only if an angle smaller by the cluster's reach could still beat it. A query
    with fewer than ``k`` found so far reads all clusters.
    """
    centres = index.clusters.agg(F.collect_list(F.struct("cluster", "centre", "reach")))
    near = let(F.col("asked"), lambda own: F.transform("centres", lambda c: F.struct(
        _dot(own, c["centre"]).alias("cosine"), c["cluster"].alias("cluster"),
        c["reach"].alias("reach"))))
    bounds = F.transform(near, lambda c: F.struct(
        F.cos(F.greatest(F.lit(0.0), _angle(c["cosine"]) - c["reach"])).alias("most"),
        c["cluster"].alias("cluster"), c["cosine"].alias("cosine")))
    asked = queries.select("query_id", F.col("unit").alias("asked")).withColumn(
        "centres", centres.scalar()).withColumn("bounds", bounds).drop("centres")
    first = asked.select("query_id", "asked", F.array_max(F.transform(
        "bounds", lambda b: F.struct(b["cosine"], b["cluster"])))["cluster"].alias("cluster"))
    floor = _top(_scored(first, index, slices, k), k).groupBy("query_id").agg(
        F.when(F.count("*") == k, F.min("similarity")).alias("floor"))
    # an outer explode, since the filter on its input that a plain one implies is pushed below
    # the joins of the queries, and bounds would be made for rows that they drop
    open_ = asked.join(floor, "query_id", "left").select(
        "query_id", "asked", "floor", F.explode_outer("bounds").alias("b")).where("b IS NOT NULL").where(
        F.col("floor").isNull() | (F.col("b.most") >= F.col("floor") - SLACK))
    wanted = open_.select("query_id", "asked", F.col("b.cluster").alias("cluster"))
    return _top(_scored(wanted, index, slices, k), k)


def fused(by_words: DataFrame, by_vector: DataFrame, k: int, damping: int = FUSION) -> DataFrame:
    """Hits of two searches (query_id, segment_id, place) under one order: the sum of
    1 / (damping + place) over the lists a segment is in. Ties go to the segment's id."""
    words = by_words.select("query_id", "segment_id", F.col("place").cast("bigint").alias("word_place"))
    vectors = by_vector.select("query_id", "segment_id",
                               F.col("place").cast("bigint").alias("vector_place"))
    part = sum((F.coalesce(1 / (F.lit(damping) + F.col(c)), F.lit(0.0))
                for c in ("word_place", "vector_place")), F.lit(0.0))
    both = words.join(vectors, ["query_id", "segment_id"], "full_outer").withColumn("score", part)
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "segment_id")
    return both.withColumn("place", F.row_number().over(order).cast("bigint")).where(
        F.col("place") <= k)


def context(hits: DataFrame, segments: DataFrame, tokens: Column, budget: int, around: int = 1
            ) -> DataFrame:
    """Segments to show with a question: hits (query_id, transcript_id, segment_index, place),
    best first, each followed by its neighbours up to ``around`` away, nearest first, while the
    sum of ``tokens`` stays within ``budget``. A segment that several hits ask for counts once,
    at its best place. A query's window holds its hits and their neighbours only.
    """
    steps = F.explode(F.sequence(F.lit(-around), F.lit(around)))
    near = hits.select("query_id", "transcript_id", "segment_index", "place", steps.alias("step"))
    asked = near.groupBy("query_id", "transcript_id",
                         (F.col("segment_index") + F.col("step")).alias("segment_index")).agg(
        F.min(F.struct("place", F.abs("step").alias("away"))).alias("best"))
    rows = segments.withColumn("tokens", tokens.cast("bigint"))
    order = Window.partitionBy("query_id").orderBy(
        "best.place", "best.away", "transcript_id", "segment_index")
    held = asked.join(rows, ["transcript_id", "segment_index"]).withColumn(
        "used", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return held.where(F.col("used") <= budget).withColumn(
        "position", F.row_number().over(order).cast("bigint")).drop("best")
