"""Transcript files that land over time, into append-only versioned tables.

Each micro-batch writes its own folder and overwrites it when it is run again, so a
restart never doubles rows. Readers take the newest version of each recording.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelgrid.functions import text as tx
from reelgrid.operators import search as se
from reelgrid.operators import transcripts as tr
from reelgrid.sources import documents as dc

FILE_SCHEMA = "value string"
BUCKETS = 16


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """Stream of whole transcript files: path, json."""
    return (spark.readStream.schema(FILE_SCHEMA).option("wholetext", True).text(path)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json")))


def read_landing_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Stream of the documents of bundles that land: path, json."""
    return spark.readStream.schema(dc.BUNDLE).parquet(path)


def recording_of(path):
    """Recording id of ``.../{id}/{file}``; a folder may be written ``name={id}``."""
    return F.regexp_extract(path, "(?:[^/=]+=)?([^/=]+)/[^/]+$", 1)


def land_batch(files: DataFrame, batch_id: int, target: str, model: str = tx.DEFAULT_MODEL) -> None:
    """Parse one batch of files and write its transcripts, segments and index rows.

    A document that cannot be used becomes a failed transcript without segments. The
    parsed rows are written first and read back, so a file is parsed once.
    """
    spark = files.sparkSession
    raw = files.select(recording_of(F.col("path")).alias("recording_id"), "path", "json",
                       F.lit(model).alias("model_name"))
    folder = f"batch_id={batch_id}"
    parsed_path = f"{target}/parsed/{folder}"
    parsed = tr.parse_documents(raw, ["recording_id", "path"])
    parsed.drop("rejects").write.mode("overwrite").parquet(parsed_path)
    done = spark.read.parquet(parsed_path)
    # Two files of one recording in a batch: the one with the later path wins.
    last = F.row_number().over(Window.partitionBy("recording_id").orderBy(F.desc("path")))
    done = done.withColumn("n", last).where("n = 1").drop("n")

    transcript_id = tx.stable_id(F.lit("transcript"), F.col("recording_id"))
    ok = F.col("error").isNull()
    version = F.lit(batch_id).cast("bigint")
    transcripts = done.select(
        transcript_id.alias("id"), "recording_id",
        F.when(ok, "completed").otherwise("failed").alias("status"), "language", "model_name",
        F.col("path").alias("raw_json_path"), F.when(ok, F.col("text")).alias("text"),
        F.col("error").alias("failure_message"), version.alias("version"))
    transcripts.write.mode("overwrite").parquet(f"{target}/transcripts/{folder}")

    segments = done.where(ok).select(
        transcript_id.alias("transcript_id"), "recording_id", F.inline("segments")).select(
        tx.stable_id(F.lit("segment"), F.col("transcript_id"), F.col("segment_index"), version)
        .alias("id"), "*", version.alias("version"))
    segments.write.mode("overwrite").parquet(f"{target}/segments/{folder}")

    se.replace_stored(spark.read.parquet(f"{target}/segments/{folder}"),
                      spark.read.parquet(f"{target}/transcripts/{folder}"), f"{target}/index", BUCKETS)


def start_landing(spark: SparkSession, source: str, target: str, checkpoint: str,
                  model: str = tx.DEFAULT_MODEL, bundles: bool = False):
    """Lands files of a document each or, with ``bundles``, of very many."""
    return ((read_landing_bundles if bundles else read_landing)(spark, source).writeStream
            .foreachBatch(lambda rows, batch: land_batch(rows, batch, target, model))
            .option("checkpointLocation", checkpoint))


def _versioned(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch_id")


def current_transcripts(spark: SparkSession, target: str) -> DataFrame:
    """Newest transcript of each recording."""
    rows = _versioned(spark, f"{target}/transcripts")
    others = [c for c in rows.columns if c != "recording_id"]
    newest = rows.groupBy("recording_id").agg(F.max_by(F.struct(*others), "version").alias("r"))
    return newest.select("recording_id", "r.*")


def current_segments(spark: SparkSession, target: str) -> DataFrame:
    """Segments of the newest transcripts; those of replaced ones are left out."""
    live = current_transcripts(spark, target).select(F.col("id").alias("transcript_id"), "version")
    return _versioned(spark, f"{target}/segments").join(
        live, ["transcript_id", "version"], "left_semi")


def current_index(spark: SparkSession, target: str) -> se.SearchIndex:
    """The stored search index over the newest transcripts."""
    return se.read_index(spark, f"{target}/index", BUCKETS)
