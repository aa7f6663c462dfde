"""Helpers of the operators: record batches of bounded size, stored tables, task caches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from reelgrid.session import shared_folder

_KEPT: dict = {}
SLICE_BYTES = 4 << 20
BATCH_BYTES = 32 << 20


def bound_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Let no Arrow batch to Python hold many times ``limit`` bytes, however long the texts are.

    A smaller value the session has already stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, None)
    if held is None or not str(held).isdigit() or not 0 < int(held) <= limit:
        spark.conf.set(key, str(limit))


def kept(key, build):
    """What ``build`` makes, kept in the Python worker for its later tasks. One thing is kept
    at a time: another key lets the one before go."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts take about ``limit`` bytes; a longer text is alone."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes.astype(np.int64)) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of each text; a null is the empty text."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def with_columns(rows: DataFrame, fields: list[tuple[str, T.DataType]], text: str,
                 make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """Rows with columns computed from record batches.

    ``make`` runs once per task and gives the function from a batch to one array per new
    column. An existing column of a new column's name is replaced, whatever its case.
    """
    new = {name.lower() for name, _ in fields}
    kept = [f for f in rows.schema.fields if f.name.lower() not in new]
    names = [f.name for f in kept]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in fields])
    bound_batches(rows.sparkSession)

    def run(batches):
        compute = make()
        for batch in batches:
            for part in slices(batch, text):
                arrays = [part.column(n) for n in names] + list(compute(part))
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *(n for n, _ in fields)])

    return rows.mapInArrow(run, schema)


def free_name(rows: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of ``rows`` is called so."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows written to the folder all executors share, and read back."""
    spark = rows.sparkSession
    path = shared_folder(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def checkpointed(rows: DataFrame) -> DataFrame:
    """Rows whose lineage ends at a checkpoint in the shared folder."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession, "checkpoints"))
    return rows.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
