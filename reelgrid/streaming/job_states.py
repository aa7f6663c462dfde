"""Current job state from a stream of job events, in arrival order.

Each micro-batch folds its events onto the stored rows of the jobs they touch. The
fold is made of aggregates that combine on the map side, so a job with a large share
of all events is split over tasks. Stored rows lie in folders by batch and by hash of the
job; a batch writes the jobs it changed and reads the folders of its own jobs' hashes only.
A hash whose chain of batches has grown long is written whole with the batch that makes it
so. Results are overwritten when a batch is run again.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid.operators import jobs as jb

BUCKETS = 64
LONGEST_CHAIN = 20
SALTS = 8

TEXT = T.StringType()
JOB_EVENTS = T.StructType([
    T.StructField("job_id", TEXT), T.StructField("seq", T.LongType()), T.StructField("at", TEXT),
    T.StructField("state", TEXT), T.StructField("attempts", T.LongType()),
    T.StructField("output_json", TEXT), T.StructField("error_message", TEXT),
    T.StructField("interrupted", T.BooleanType()), T.StructField("started_at", TEXT),
    T.StructField("completed_at", TEXT),
])


def read_job_events(spark: SparkSession, path: str,
                    files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(JOB_EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")


def read_chains(spark: SparkSession, target: str, batch_id: int,
                buckets: int = BUCKETS) -> tuple[list[list[int]], T.StructType | None]:
    """For each hash the batches that hold its rows after a batch, from the last whole one on,
    and the schema of the rows. One small row."""
    try:
        row = spark.read.schema("chains array<array<int>>, rows string").parquet(
            f"{target}/chains/batch_id={batch_id}").head()
    except AnalysisException:  # nothing was folded yet
        return [[] for _ in range(buckets)], None
    return row.chains, T.StructType.fromJson(json.loads(row.rows))


def folders(target: str, chains: list[list[int]], touched) -> list[str]:
    """Folders that hold all rows of the given hashes."""
    return [f"{target}/rows/batch_id={batch}/bucket={k}" for k in touched for batch in chains[k]]


def _stored(spark: SparkSession, target: str, chains, touched, schema) -> DataFrame | None:
    paths = folders(target, chains, touched)
    if not paths:
        return None
    wide = T.StructType([*schema.fields, T.StructField("batch_id", T.IntegerType()),
                         T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(wide).option("basePath", f"{target}/rows").parquet(*paths)


def _newest(rows: DataFrame) -> DataFrame:
    others = [c for c in rows.columns if c not in ("job_id", "batch_id")]
    found = rows.groupBy("job_id").agg(F.max_by(F.struct(*others), "batch_id").alias("r"))
    return found.select("job_id", "r.*")


def states_after(spark: SparkSession, target: str, batch_id: int) -> DataFrame:
    """All job rows after a batch."""
    chains, schema = read_chains(spark, target, batch_id)
    rows = _stored(spark, target, chains, range(len(chains)), schema)
    if rows is None:
        return spark.createDataFrame([], schema)
    return _newest(rows).drop("bucket").select(*schema.names)


def fold_batch(events: DataFrame, batch_id: int, target: str, buckets: int = BUCKETS) -> None:
    spark = events.sparkSession
    chains, schema = read_chains(spark, target, batch_id - 1, buckets)
    touched = sorted(r[0] for r in events.select(_bucket(buckets)).distinct().collect())  # few
    before = _stored(spark, target, chains, touched, schema)
    whole = [k for k in touched if len(chains[k]) + 1 >= LONGEST_CHAIN]
    ids = events.select("job_id").distinct()
    if before is None:
        changed = jb.fold_events(events)
    else:
        own = _newest(before.join(ids, "job_id", "left_semi")).drop("bucket")
        changed = jb.fold_events(jb.as_base_event(own).unionByName(events, allowMissingColumns=True))
    rows, names = changed, changed.columns
    if whole and before is not None:
        rest = before.where(F.col("bucket").isin(whole)).join(ids, "job_id", "left_anti")
        rows = rows.unionByName(_newest(rest).select(*names))
    (rows.withColumn("bucket", _bucket(buckets))
     .repartition("bucket", F.pmod(F.xxhash64("job_id", F.lit(1)), F.lit(SALTS)))
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/rows/batch_id={batch_id}"))
    after = [chain if k not in touched else [batch_id] if k in whole else [*chain, batch_id]
             for k, chain in enumerate(chains)]
    spark.createDataFrame([(after, changed.schema.json())], "chains array<array<int>>, rows string").coalesce(
        1).write.mode("overwrite").parquet(f"{target}/chains/batch_id={batch_id}")


def start_job_states(events: DataFrame, target: str, checkpoint: str):
    return (events.writeStream
            .foreachBatch(lambda rows, batch: fold_batch(rows, batch, target))
            .option("checkpointLocation", checkpoint))
