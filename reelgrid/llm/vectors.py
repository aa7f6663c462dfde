"""Stated queries against all vectors, in blocks; shared by exact and approximate search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_ROWS = 2048
SLICE_ROWS = 8192


def usable(rows: DataFrame, vec_id: str, vector: str, zero: bool) -> DataFrame:
    """One row (vec_id, vec) per id whose vector has finite components only.

    Null ids, null or empty vectors and vectors with a null or non-finite component go, and
    all-zero ones unless ``zero``. Of rows with one id the least vector counts.
    """
    vec = F.col(vector).cast("array<double>")
    good = F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x)
                               & (F.abs(x) < float("inf"))), F.lit(False))
    good = good & (F.size(vec) > 0) & F.col(vec_id).isNotNull()
    if not zero:
        good = good & F.exists(vec, lambda x: x != 0)
    return (rows.where(good).groupBy(F.col(vec_id).cast("long").alias("vec_id"))
            .agg(F.min(vector).alias("vec")))


def matrix(rows: pa.Table) -> np.ndarray:
    """The vectors as rows of doubles."""
    flat = rows["vec"].combine_chunks()
    values = np.asarray(pa.concat_arrays(flat.chunks).flatten() if isinstance(
        flat, pa.ChunkedArray) else flat.flatten(), np.float64)
    return values.reshape(rows.num_rows, -1)


def search(vectors: DataFrame, is_query, k: int,
           best: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple],
           score_type: str, query_rows: int = QUERY_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query, ties to the smaller vec_id.

    Queries go to groups of about ``query_rows``, candidates to slices of about
    ``slice_rows``, by hash; each task meets one group with one slice of the same dimension
    and ``best(query ids, queries, ids, vectors)`` gives at most k rows a query (query place,
    vec_id, score). Only those are merged.
    """
    counts = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    slices = -(-counts[0] // slice_rows) or 1
    groups = -(-counts[1] // query_rows) or 1

    def dealt(n):
        return F.sequence(F.lit(0), F.lit(n - 1))

    size = F.size("vec").alias("dim")
    queries = vectors.where(is_query).select(
        "vec_id", "vec", size, F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("g"),
        F.explode(dealt(slices)).alias("c"))
    others = vectors.select(
        "vec_id", "vec", size, F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int").alias("c"),
        F.explode(dealt(groups)).alias("g"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            at, ids, score = (np.zeros(0, np.int64),) * 3
        else:
            at, ids, score = best(left["vec_id"].to_numpy(), matrix(left),
                                  right["vec_id"].to_numpy(), matrix(right))
        kind = pa.int64() if score_type == "long" else pa.float64()
        return pa.table({"query_id": pa.array(left["vec_id"].to_numpy()[at], pa.int64()),
                         "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, kind)})

    keys = ["g", "c", "dim"]
    found = queries.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInArrow(
        meet, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def first_k(at: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best of (query place, id, score), ties to the smaller id."""
    order = np.lexsort((ids, -score, at))
    at = at[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    return order[place < k]
