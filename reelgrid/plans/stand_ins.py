"""Library tables made from the given tables, in Spark and, for checking, in SQL.

Every stand-in is derived from whole given tables, so work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid import schemas
from reelgrid.functions import text as tx
from reelgrid.operators.running import running_before

NOW = "1800000000"
ROOT = "/library"


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conform(rows: DataFrame, table: str) -> DataFrame:
    """Columns of a library table in order; absent ones are null."""
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.TABLES[table].fields])


# --- conversations: one recording per conversation, one segment per turn -----------------

def talk_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    placed = running_before(rows, ["conv_id"], "turn", {"before": ("sum", F.length("text"))})
    start = F.col("before") * 50
    conv = F.col("conv_id").cast("string")
    return placed.select(
        F.concat(F.lit("c"), conv, F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.concat(F.lit("t"), conv).alias("transcript_id"),
        F.concat(F.lit("r"), conv).alias("recording_id"), F.col("turn").alias("segment_index"),
        start.cast("bigint").alias("start_ms"),
        (start + F.length("text") * 50).cast("bigint").alias("end_ms"), "text",
        (((F.col("conv_id") * 7 + F.col("turn")) % 11) / 10.0).cast("double").alias("confidence"))


def plain_talk_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same segments with no times in them, for jobs that need none."""
    conv = F.col("conv_id").cast("string")
    return given(spark, sf_dir, "conversations").select("conv_id", "turn", "text").select(
        F.concat(F.lit("c"), conv, F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.concat(F.lit("t"), conv).alias("transcript_id"),
        F.concat(F.lit("r"), conv).alias("recording_id"), F.col("turn").alias("segment_index"),
        F.lit(0).cast("bigint").alias("start_ms"), "text")


def talk_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id").cast("string")
    rows = given(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return conform(rows.select(
        F.concat(F.lit("t"), conv).alias("id"), F.concat(F.lit("r"), conv).alias("recording_id"),
        F.when(F.col("conv_id") % 7 == 3, "failed").otherwise("completed").alias("status"),
        F.lit(tx.DEFAULT_MODEL).alias("model_name"), F.lit("1700000000").alias("created_at"),
        F.lit("1700000000").alias("updated_at")), "transcripts")


def talk_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id").cast("string")
    rows = given(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.sum(F.length("text")).alias("chars"))
    made = (F.lit(1700000000) + F.col("conv_id") % 17).cast("string")
    return conform(rows.select(
        F.concat(F.lit("r"), conv).alias("id"), F.concat(F.lit("Talk "), conv).alias("title"),
        F.lit("completed").alias("status"),
        F.concat(F.lit("recordings/r"), conv).alias("recording_directory"),
        F.concat(F.lit("recordings/r"), conv, F.lit("/recording.mp4")).alias("media_path"),
        (F.col("chars") * 50).alias("duration_ms"), made.alias("created_at"),
        made.alias("updated_at")), "recordings")


TALK_SQL = """
talk_segments AS (
  SELECT 'c' || conv_id || '-' || turn AS id, 't' || conv_id AS transcript_id,
         'r' || conv_id AS recording_id, turn AS segment_index,
         CAST(50 * coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms,
         CAST(50 * sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS end_ms,
         text, CAST(((conv_id * 7 + turn) % 11) / 10.0 AS DOUBLE) AS confidence
  FROM conversations),
talk_transcripts AS (
  SELECT DISTINCT 't' || conv_id AS id, 'r' || conv_id AS recording_id,
         CASE WHEN conv_id % 7 = 3 THEN 'failed' ELSE 'completed' END AS status,
         'small.en' AS model_name
  FROM conversations),
talk_recordings AS (
  SELECT 'r' || conv_id AS id, 'Talk ' || conv_id AS title, 'completed' AS status,
         CAST(50 * sum(length(text)) AS BIGINT) AS duration_ms,
         CAST(1700000000 + conv_id % 17 AS VARCHAR) AS created_at
  FROM conversations GROUP BY conv_id)"""


# --- documents: one recording, one transcript, one segment per document ------------------

def doc_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, n = F.col("doc_id").cast("string"), F.col("n_chars")
    status = F.element_at(F.array(*map(F.lit, schemas.RECORDING_STATUSES)),
                          (n % 5 + 1).cast("int"))
    made = (F.lit(1700000000) + F.col("doc_id") % 97).cast("string")
    rows = given(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    shaped = rows.withColumn("status", status)
    done = F.col("status") == "completed"
    return conform(shaped.select(
        F.concat(F.lit("d"), doc).alias("id"), F.col("source").alias("title"), "status",
        F.concat(F.lit("recordings/d"), doc).alias("recording_directory"),
        F.when(done, F.concat(F.when(n % 2 == 0, F.lit("/media/")).otherwise(F.lit("media/")), doc,
                              F.lit(".mp4"))).alias("media_path"),
        F.when(done & (n % 3 == 0), F.concat(F.lit("thumbs/"), doc, F.lit(".jpg")))
        .alias("thumbnail_path"),
        (n * 60).alias("duration_ms"), F.when(n % 4 > 0, made).alias("captured_at"),
        made.alias("created_at"), made.alias("updated_at"),
        F.when(done, made).alias("completed_at"),
        F.when(F.col("status") == "failed", F.lit("encode failed")).alias("failure_message")),
        "recordings")


def doc_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = given(spark, sf_dir, "labels").select("doc_id", "quality")
    doc = F.col("doc_id").cast("string")
    rows = docs.join(labels, "doc_id", "left").withColumn(
        "status", F.when(F.col("quality") == 1, "completed")
        .when(F.col("quality") == 0, "failed").otherwise("not_started"))
    done = F.col("status") == "completed"
    return conform(rows.select(
        F.concat(F.lit("x"), doc).alias("id"), F.concat(F.lit("d"), doc).alias("recording_id"),
        "status", F.when(done, F.col("lang")).alias("language"),
        F.lit(tx.DEFAULT_MODEL).alias("model_name"), F.when(done, F.col("text")).alias("text"),
        F.lit("1700000000").alias("created_at"), F.lit("1700000000").alias("updated_at")),
        "transcripts")


def doc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id").cast("string")
    return given(spark, sf_dir, "documents").select("doc_id", "text", "n_chars").select(
        F.concat(F.lit("g"), doc).alias("id"), F.concat(F.lit("x"), doc).alias("transcript_id"),
        F.concat(F.lit("d"), doc).alias("recording_id"),
        F.lit(0).cast("bigint").alias("segment_index"), F.lit(0).cast("bigint").alias("start_ms"),
        (F.col("n_chars") * 60).alias("end_ms"), "text",
        F.lit(None).cast("double").alias("confidence"))


DOC_SQL = """
doc_recordings AS (
  SELECT id, title, status, recording_directory,
         CASE WHEN status = 'completed' THEN
           (CASE WHEN n % 2 = 0 THEN '/media/' ELSE 'media/' END) || doc_id || '.mp4' END AS media_path,
         CASE WHEN status = 'completed' AND n % 3 = 0 THEN 'thumbs/' || doc_id || '.jpg' END AS thumbnail_path,
         n * 60 AS duration_ms, CASE WHEN n % 4 > 0 THEN made END AS captured_at,
         made AS created_at, made AS updated_at,
         CASE WHEN status = 'completed' THEN made END AS completed_at,
         CASE WHEN status = 'failed' THEN 'encode failed' END AS failure_message
  FROM (SELECT doc_id, 'd' || doc_id AS id, source AS title, n_chars AS n,
               CASE n_chars % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'capturing' WHEN 2 THEN 'processing'
                 WHEN 3 THEN 'completed' ELSE 'failed' END AS status,
               'recordings/d' || doc_id AS recording_directory,
               CAST(1700000000 + doc_id % 97 AS VARCHAR) AS made
        FROM documents)),
doc_transcripts AS (
  SELECT 'x' || doc_id AS id, 'd' || doc_id AS recording_id, status,
         CASE WHEN status = 'completed' THEN lang END AS language, 'small.en' AS model_name,
         CASE WHEN status = 'completed' THEN text END AS text,
         '1700000000' AS created_at, '1700000000' AS updated_at
  FROM (SELECT d.doc_id, d.lang, d.text,
               CASE l.quality WHEN 1 THEN 'completed' WHEN 0 THEN 'failed' ELSE 'not_started' END AS status
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)),
doc_segments AS (
  SELECT 'g' || doc_id AS id, 'x' || doc_id AS transcript_id, 'd' || doc_id AS recording_id,
         text, n_chars * 60 AS end_ms
  FROM documents)"""


# --- orders: processing jobs ------------------------------------------------------------

ORDER_KINDS = ("encode_recording", "transcribe_recording", "extract_audio", "run_whisper",
               "index_transcript", "ai_summary", "clean_temp_files", "custom_step")


def order_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    kind = F.element_at(F.array(*map(F.lit, ORDER_KINDS)), (key % 8 + 1).cast("int"))
    made = F.date_format("o_orderdate", "yyyy-MM-dd")
    failed = status == "F"
    rows = given(spark, sf_dir, "orders")
    return conform(rows.select(
        key.cast("string").alias("id"),
        F.when(key % 13 > 0, F.concat(F.lit("d"), F.col("o_custkey").cast("string")))
        .alias("recording_id"),
        kind.alias("kind"),
        F.when(status == "O", "queued").when(status == "P", "running")
        .when(key % 3 == 0, "succeeded").when(key % 3 == 1, "failed").otherwise("cancelled")
        .alias("state"),
        (F.lit(6) - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
        (key % 5).alias("attempts"), F.lit(3).alias("max_attempts"),
        F.when(key % 4 == 0, F.concat(F.lit('{"modelName":" ggml-base-'), (key % 6).cast("string"),
                                      F.lit('.bin ","payload":{"userNotes":"note '),
                                      (key % 9).cast("string"), F.lit('"}}')))
        .when(key % 4 == 1, F.concat(F.lit('{"userNotes":"call '), (key % 9).cast("string"),
                                     F.lit('"}')))
        .when(key % 4 == 2, F.lit("{not json")).alias("input_json"),
        F.when(failed & (key % 3 == 0), F.lit('{"ok":true}')).alias("output_json"),
        F.when(failed & (key % 3 == 1), F.lit("step failed")).alias("error_message"),
        (failed & (key % 6 == 1)).alias("interrupted"),
        F.when(failed & (key % 3 == 1), made).alias("last_error_at"),
        made.alias("created_at"), made.alias("updated_at"),
        F.when(status != "O", made).alias("started_at"), F.when(failed, made).alias("completed_at")),
        "processing_jobs")


JOB_SQL = """
order_jobs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id,
         CASE WHEN o_orderkey % 13 > 0 THEN 'd' || o_custkey END AS recording_id,
         CASE o_orderkey % 8 WHEN 0 THEN 'encode_recording' WHEN 1 THEN 'transcribe_recording'
           WHEN 2 THEN 'extract_audio' WHEN 3 THEN 'run_whisper' WHEN 4 THEN 'index_transcript'
           WHEN 5 THEN 'ai_summary' WHEN 6 THEN 'clean_temp_files' ELSE 'custom_step' END AS kind,
         CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'running'
           WHEN o_orderkey % 3 = 0 THEN 'succeeded' WHEN o_orderkey % 3 = 1 THEN 'failed'
           ELSE 'cancelled' END AS state,
         CAST(6 - CAST(left(o_orderpriority, 1) AS INTEGER) AS BIGINT) AS priority,
         o_orderkey % 5 AS attempts, CAST(3 AS BIGINT) AS max_attempts,
         CASE o_orderkey % 4
           WHEN 0 THEN '{"modelName":" ggml-base-' || (o_orderkey % 6) || '.bin ","payload":{"userNotes":"note ' || (o_orderkey % 9) || '"}}'
           WHEN 1 THEN '{"userNotes":"call ' || (o_orderkey % 9) || '"}'
           WHEN 2 THEN '{not json' END AS input_json,
         CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN '{"ok":true}' END AS output_json,
         CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 1 THEN 'step failed' END AS error_message,
         o_orderstatus = 'F' AND o_orderkey % 6 = 1 AS interrupted,
         CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 1 THEN made END AS last_error_at,
         made AS created_at, made AS updated_at,
         CASE WHEN o_orderstatus <> 'O' THEN made END AS started_at,
         CASE WHEN o_orderstatus = 'F' THEN made END AS completed_at
  FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS made FROM orders))"""


# --- events: capture sessions -----------------------------------------------------------

def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions in the legacy form: one audio path, often without mode or source columns."""
    e, u, cents = F.col("event_id"), F.col("user_id"), F.round(F.col("value") * 100).cast("bigint")
    es, us = e.cast("string"), u.cast("string")
    home = F.concat(F.lit("temp/recording-sessions/s"), es)
    made = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    screen = (
        F.when(e % 4 == 0, F.concat(F.lit("window:"), us, F.when(e % 8 == 0, "-main").otherwise("")))
        .when(e % 4 == 1, F.concat(F.lit("Application:"), us))
        .when(e % 4 == 2, F.concat(F.lit("display:"), us))
        .otherwise(F.concat(F.lit("screen"), us)))
    audio = (F.when(e % 3 == 0, F.concat(home, F.lit("/source_audio.pcm")))
             .when(e % 3 == 1, F.concat(home, F.lit("/microphone.pcm")))
             .when(e % 9 == 2, F.lit("")))
    status = (F.when(F.col("event_type") == "click", "capturing")
              .when(F.col("event_type") == "error", "failed").otherwise("stopped"))
    rows = given(spark, sf_dir, "events").select(
        F.concat(F.lit("s"), es).alias("id"), F.concat(F.lit("d"), es).alias("recording_id"),
        status.alias("status"), home.alias("temp_directory"),
        F.concat(home, F.lit("/screen_video.bin")).alias("video_path"), audio.alias("audio_path"),
        F.concat(home, F.lit("/session.json")).alias("metadata_path"),
        F.when(e % 5 == 0, F.concat(F.lit("display:"), es)).otherwise("").alias("video_source_id"),
        screen.alias("screen_source_id"), F.lit("display").alias("video_source_kind"),
        F.when(e % 7 == 0, F.lit("Named")).otherwise("").alias("video_source_title"),
        F.when(e % 11 == 0, e).alias("video_source_window_id"),
        (e % 2 == 0).alias("include_microphone"),
        F.when(e % 10 == 0, "source").when(e % 10 == 1, "none").when(e % 10 < 5, "microphone")
        .when(e % 10 == 5, "microphone_and_source").otherwise("").alias("audio_mode"),
        F.when(e % 20 == 3, F.concat(home, F.lit("/mic2.pcm"))).alias("microphone_audio_path"),
        F.when(e % 20 == 5, F.concat(home, F.lit("/src2.pcm"))).alias("source_audio_path"),
        F.when(e % 6 > 0, cents % 4000).alias("width"),
        F.when(e % 6 > 0, cents % 2300).alias("height"), F.lit(30).alias("frame_rate"),
        (cents % 9000).alias("frame_count"), cents.alias("audio_byte_count"),
        F.when(e % 5 > 0, F.lit(48000)).alias("audio_sample_rate"),
        F.when(e % 5 > 1, F.lit(2)).alias("audio_channels"),
        F.when(e % 5 > 2, F.lit("f32")).when(e % 5 == 2, F.lit("i64")).alias("audio_sample_format"),
        F.when(e % 2 == 0, F.lit(0)).otherwise(cents % 50).alias("microphone_audio_byte_count"),
        F.when(e % 9 == 0, F.lit(44100)).alias("microphone_audio_sample_rate"),
        F.when(e % 3 == 0, F.lit(0)).otherwise(cents % 40).alias("source_audio_byte_count"),
        F.when(e % 9 == 1, F.lit(1)).alias("source_audio_channels"),
        made.alias("started_at"), F.when(F.col("event_type") != "click", made).alias("stopped_at"),
        F.when(F.col("event_type") != "click", cents * 10).alias("duration_ms"),
        made.alias("created_at"), made.alias("updated_at"))
    return conform(rows, "recording_sessions")


SESSION_SQL = """
event_sessions AS (
  SELECT 's' || e AS id, 'd' || e AS recording_id,
         CASE event_type WHEN 'click' THEN 'capturing' WHEN 'error' THEN 'failed' ELSE 'stopped' END AS status,
         home AS temp_directory, home || '/screen_video.bin' AS video_path,
         CASE WHEN e % 3 = 0 THEN home || '/source_audio.pcm' WHEN e % 3 = 1 THEN home || '/microphone.pcm'
           WHEN e % 9 = 2 THEN '' END AS audio_path,
         home || '/session.json' AS metadata_path,
         CASE WHEN e % 5 = 0 THEN 'display:' || e ELSE '' END AS video_source_id,
         CASE e % 4 WHEN 0 THEN 'window:' || u || (CASE WHEN e % 8 = 0 THEN '-main' ELSE '' END)
           WHEN 1 THEN 'Application:' || u WHEN 2 THEN 'display:' || u ELSE 'screen' || u END AS screen_source_id,
         'display' AS video_source_kind,
         CASE WHEN e % 7 = 0 THEN 'Named' ELSE '' END AS video_source_title,
         CASE WHEN e % 11 = 0 THEN e END AS video_source_window_id,
         e % 2 = 0 AS include_microphone,
         CASE WHEN e % 10 = 0 THEN 'source' WHEN e % 10 = 1 THEN 'none' WHEN e % 10 < 5 THEN 'microphone'
           WHEN e % 10 = 5 THEN 'microphone_and_source' ELSE '' END AS audio_mode,
         CASE WHEN e % 20 = 3 THEN home || '/mic2.pcm' END AS microphone_audio_path,
         CASE WHEN e % 20 = 5 THEN home || '/src2.pcm' END AS source_audio_path,
         CASE WHEN e % 6 > 0 THEN cents % 4000 END AS width, CASE WHEN e % 6 > 0 THEN cents % 2300 END AS height,
         CAST(30 AS BIGINT) AS frame_rate, cents % 9000 AS frame_count, cents AS audio_byte_count,
         CASE WHEN e % 5 > 0 THEN CAST(48000 AS BIGINT) END AS audio_sample_rate,
         CASE WHEN e % 5 > 1 THEN CAST(2 AS BIGINT) END AS audio_channels,
         CASE WHEN e % 5 > 2 THEN 'f32' WHEN e % 5 = 2 THEN 'i64' END AS audio_sample_format,
         CASE WHEN e % 2 = 0 THEN 0 ELSE cents % 50 END AS microphone_audio_byte_count,
         CASE WHEN e % 9 = 0 THEN CAST(44100 AS BIGINT) END AS microphone_audio_sample_rate,
         CAST(NULL AS BIGINT) AS microphone_audio_channels,
         CAST(NULL AS VARCHAR) AS microphone_audio_sample_format,
         CASE WHEN e % 3 = 0 THEN 0 ELSE cents % 40 END AS source_audio_byte_count,
         CAST(NULL AS BIGINT) AS source_audio_sample_rate,
         CASE WHEN e % 9 = 1 THEN CAST(1 AS BIGINT) END AS source_audio_channels,
         CAST(NULL AS VARCHAR) AS source_audio_sample_format,
         made AS started_at, CASE WHEN event_type <> 'click' THEN made END AS stopped_at,
         CASE WHEN event_type <> 'click' THEN cents * 10 END AS duration_ms,
         CAST(NULL AS VARCHAR) AS failure_message, made AS created_at, made AS updated_at
  FROM (SELECT event_id AS e, user_id AS u, event_type, CAST(round(value * 100) AS BIGINT) AS cents,
               'temp/recording-sessions/s' || event_id AS home,
               strftime(ts, '%Y-%m-%d %H:%M:%S') AS made FROM events))"""


def doc_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary row per labelled document."""
    doc = F.col("doc_id").cast("string")
    rows = given(spark, sf_dir, "labels")
    return conform(rows.select(
        F.concat(F.lit("a"), doc).alias("id"), F.concat(F.lit("d"), doc).alias("recording_id"),
        F.when(F.col("toxic") == 1, "failed").otherwise("completed").alias("status"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("summary_text"),
        F.lit("1700000000").alias("created_at"), F.lit("1700000000").alias("updated_at")),
        "ai_summaries")


SUMMARY_SQL = """
doc_summaries AS (
  SELECT 'a' || doc_id AS id, 'd' || doc_id AS recording_id,
         CASE WHEN toxic = 1 THEN 'failed' ELSE 'completed' END AS status,
         'quality ' || quality AS summary_text,
         '1700000000' AS created_at, '1700000000' AS updated_at
  FROM labels)"""


def library(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The document library with jobs and sessions."""
    return {
        "recordings": doc_recordings(spark, sf_dir),
        "transcripts": doc_transcripts(spark, sf_dir),
        "transcript_segments": doc_segments(spark, sf_dir),
        "ai_summaries": doc_summaries(spark, sf_dir),
        "processing_jobs": order_jobs(spark, sf_dir),
        "recording_sessions": event_sessions(spark, sf_dir),
    }


def with_sql(*parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts) + "\n"
