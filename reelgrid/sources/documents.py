"""JSON documents: transcripts, session files and chunk manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid import schemas
from reelgrid.functions import text as tx


BUNDLE = "path string, json string"


def write_bundles(documents: DataFrame, path: str) -> None:
    """Documents (path, json), very many of them to a file: a file and folder for each would cost
    more than all work on them."""
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    documents.select("path", "json").repartition(tasks, "path").write.parquet(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """path, json of bundled documents."""
    return spark.read.schema(BUNDLE).parquet(path)


def read_transcript_json(spark: SparkSession, path: str, model: str = tx.DEFAULT_MODEL) -> DataFrame:
    """One row per transcript file: path, json, model_name."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"),
        F.lit(model).alias("model_name"))


def read_session_files(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Session files as nested rows with their path: one pretty-printed object per file, or
    the line form that ``write_session_files`` makes."""
    return (spark.read.schema(schemas.SESSION_SIDECAR).option("multiLine", one_per_file).json(path)
            .select("*", F.col("_metadata.file_path").alias("path")))


def flat_sessions(nested: DataFrame) -> DataFrame:
    """The library columns a session file holds."""
    s = nested.select(
        F.col("sessionId").alias("id"), F.col("recordingId").alias("recording_id"), "status",
        F.col("createdAt").alias("created_at"), F.col("startedAt").alias("started_at"),
        F.col("stoppedAt").alias("stopped_at"), F.col("durationMs").alias("duration_ms"),
        F.col("resolution.width").alias("width"), F.col("resolution.height").alias("height"),
        F.col("frameRate").alias("frame_rate"), F.col("frameCount").alias("frame_count"),
        F.col("video.path").alias("video_path"),
        F.col("video.source.id").alias("video_source_id"),
        F.col("video.source.kind").alias("video_source_kind"),
        F.col("video.source.title").alias("video_source_title"),
        F.col("video.source.appName").alias("video_source_app_name"),
        F.col("video.source.processId").alias("video_source_process_id"),
        F.col("video.source.windowId").alias("video_source_window_id"),
        F.col("audio.mode").alias("audio_mode"),
        *[F.col(f"audio.{stream}.{name}").alias(f"{stream}_audio_{column}")
          for stream in ("microphone", "source")
          for name, column in (("path", "path"), ("sampleRate", "sample_rate"),
                               ("channels", "channels"), ("sampleFormat", "sample_format"),
                               ("byteCount", "byte_count"))],
        F.col("failureMessage").alias("failure_message"))
    return s


def nested_sessions(sessions: DataFrame) -> DataFrame:
    """Session rows in the nested form of session files, for ``write_session_files``."""
    size = F.struct("width", "height")

    def stream(name: str):
        path = F.col(f"{name}_audio_path")
        return F.when(path.isNotNull(), F.struct(
            path.alias("path"), F.lit("raw_pcm").alias("format"),
            F.col(f"{name}_audio_sample_rate").alias("sampleRate"),
            F.col(f"{name}_audio_channels").alias("channels"),
            F.col(f"{name}_audio_sample_format").alias("sampleFormat"),
            F.col(f"{name}_audio_byte_count").alias("byteCount"))).alias(name)

    return sessions.select(
        F.col("id").alias("sessionId"), F.col("recording_id").alias("recordingId"), "status",
        F.col("created_at").alias("createdAt"), F.col("started_at").alias("startedAt"),
        F.col("stopped_at").alias("stoppedAt"), F.col("duration_ms").alias("durationMs"),
        size.alias("resolution"), F.col("frame_rate").alias("frameRate"),
        F.col("frame_count").alias("frameCount"),
        F.struct(
            F.col("video_path").alias("path"), F.lit("raw_video").alias("format"),
            F.struct(F.col("video_source_id").alias("id"), F.col("video_source_kind").alias("kind"),
                     F.col("video_source_title").alias("title"),
                     F.col("video_source_app_name").alias("appName"),
                     F.col("video_source_process_id").alias("processId"),
                     F.col("video_source_window_id").alias("windowId")).alias("source"),
            size.alias("outputDimensions")).alias("video"),
        F.struct(F.col("audio_mode").alias("mode"), stream("microphone"), stream("source"))
        .alias("audio"),
        F.col("failure_message").alias("failureMessage"))


def write_session_files(sessions: DataFrame, path: str) -> None:
    nested_sessions(sessions).write.mode("overwrite").option("ignoreNullFields", False).json(path)


_MANIFEST = T.StructType([*schemas.CHUNK_MANIFEST.fields, T.StructField("_corrupt", T.StringType())])


def read_manifests(spark: SparkSession, path: str, manifest_format: str) -> DataFrame:
    """Chunk manifests of the wanted format, with their path. Files that are not JSON, lack
    a field or have another format yield no row."""
    found = (spark.read.schema(_MANIFEST).option("multiLine", True)
             .option("columnNameOfCorruptRecord", "_corrupt").json(path)
             .select("*", F.col("_metadata.file_path").alias("manifest_path")))
    return _usable_manifests(found, manifest_format)


def bundled_manifests(documents: DataFrame, manifest_format: str) -> DataFrame:
    """The same for manifests that come as rows (path, json), one manifest each."""
    read = F.from_json("json", _MANIFEST, {"columnNameOfCorruptRecord": "_corrupt"})
    return _usable_manifests(documents.select(F.col("path").alias("manifest_path"), read.alias("m"))
                             .select("m.*", "manifest_path"), manifest_format)


def _usable_manifests(found: DataFrame, manifest_format: str) -> DataFrame:
    whole = F.lit(True)
    for field in schemas.CHUNK_MANIFEST.fields:
        whole = whole & F.col(field.name).isNotNull()
    known = F.col("status").isin("recording", "completed")
    return found.where(F.col("_corrupt").isNull() & whole & known
                       & (F.col("format") == manifest_format)).drop("_corrupt")
