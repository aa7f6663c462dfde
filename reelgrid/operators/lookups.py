"""Reads of library tables: by id, by recording, lists, overview and eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions import text as tx
from reelgrid.operators.transcripts import with_position


def by_id(table: DataFrame, row_id: str) -> DataFrame:
    return table.where(F.col("id") == row_id)


def by_recording(table: DataFrame, recording_id: str) -> DataFrame:
    return table.where(F.col("recording_id") == recording_id)


def of_recordings(table: DataFrame, recordings: DataFrame) -> DataFrame:
    """Rows of a child table for many recordings at once."""
    return table.join(recordings.select(F.col("id").alias("recording_id")),
                      "recording_id", "left_semi")


def list_recordings(recordings: DataFrame) -> DataFrame:
    """Newest first; times are compared as stored text."""
    return recordings.orderBy(F.desc("created_at"), "id")


def list_jobs(jobs: DataFrame, state: str | None = None,
              recording_id: str | None = None) -> DataFrame:
    """Jobs filtered by state and recording. With a state: by priority, oldest first;
    without: newest first."""
    found = jobs
    if state is not None:
        found = found.where(F.col("state") == state)
    if recording_id is not None:
        found = found.where(F.col("recording_id") == recording_id)
    if state is not None:
        return found.orderBy(F.desc("priority"), F.asc("created_at"), "id")
    return found.orderBy(F.desc("created_at"), "id")


def nested_transcripts(transcripts: DataFrame, segments: DataFrame) -> DataFrame:
    """Transcripts with their segments as flat rows: position (from 0, in index order),
    segment_index, start_ms, end_ms, segment_text beside the transcript's columns.

    The transcript's own text stands in its first row only. A transcript without segments
    keeps one row with null segment columns.
    """
    flat = with_position(segments).select(
        F.col("transcript_id").alias("id"), "position", "segment_index", "start_ms", "end_ms",
        F.col("text").alias("segment_text"))
    own = F.when(F.coalesce("position", F.lit(0)) == 0, F.col("text")).alias("text")
    return transcripts.join(flat, "id", "left").select(
        *[own if c == "text" else F.col(c) for c in transcripts.columns], "position",
        "segment_index", "start_ms", "end_ms", "segment_text")


def transcript_of(recording_id: str, transcripts: DataFrame, segments: DataFrame) -> DataFrame:
    return nested_transcripts(by_recording(transcripts, recording_id),
                              by_recording(segments, recording_id)).orderBy("position")


def overview(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name and row_count of each library table."""
    counts = None
    for name in sorted(tables):
        one = tables[name].agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def asset_paths(recordings: DataFrame, root: str) -> DataFrame:
    return recordings.select(
        F.col("id").alias("recording_id"),
        tx.resolve_path(F.col("media_path"), root).alias("media_path"),
        tx.resolve_path(F.col("thumbnail_path"), root).alias("thumbnail_path"))


def encode_retry_eligible(recording_status: Column, session_status: Column) -> Column:
    return F.coalesce((recording_status == "failed") & (session_status == "stopped"),
                      F.lit(False))


def transcribe_eligible(recording_status: Column) -> Column:
    return recording_status == "completed"


def _job_totals(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("recording_id").isNotNull()).groupBy("recording_id").agg(
        F.count("*").alias("job_count"),
        F.count_if(F.col("state").isin("queued", "running")).alias("open_job_count"),
        F.max(F.struct("updated_at", "id"))["id"].alias("latest_job_id"))


def _has_words(segments: DataFrame) -> DataFrame:
    return segments.groupBy("transcript_id").agg(
        F.count("*").alias("segment_count"),
        F.bool_or(tx.has_words(F.col("text"))).alias("segments_have_text"))


def recording_detail(recordings: DataFrame, transcripts: DataFrame, segments: DataFrame,
                     summaries: DataFrame, jobs: DataFrame, sessions: DataFrame,
                     root: str) -> DataFrame:
    """One row per recording: transcript, summary, session and job facts, asset paths
    and what can be done next. Jobs and segments are aggregated, not nested."""
    t = transcripts.select(F.col("id").alias("transcript_id"), "recording_id",
                           F.col("status").alias("transcript_status"),
                           F.col("text").alias("transcript_text"))
    s = summaries.select("recording_id", F.col("status").alias("summary_status"))
    x = sessions.select("recording_id", F.col("id").alias("session_id"),
                        F.col("status").alias("session_status"))
    rows = (
        recordings.withColumn("recording_id", F.col("id"))
        .join(t, "recording_id", "left")
        .join(s, "recording_id", "left")
        .join(x, "recording_id", "left")
        .join(_job_totals(jobs), "recording_id", "left")
        .join(_has_words(segments), "transcript_id", "left"))
    own_text = F.nullif(F.col("transcript_text"), F.lit(""))
    words = F.when(own_text.isNotNull(), tx.has_words(own_text)).otherwise(
        F.coalesce("segments_have_text", F.lit(False)))
    ready = (F.col("status") == "completed") & (F.col("transcript_status") == "completed")
    return rows.select(
        "recording_id", "title", "status", "transcript_status", "summary_status",
        "session_id", "session_status",
        F.coalesce("segment_count", F.lit(0)).alias("segment_count"),
        F.coalesce("job_count", F.lit(0)).alias("job_count"),
        F.coalesce("open_job_count", F.lit(0)).alias("open_job_count"), "latest_job_id",
        tx.resolve_path(F.col("media_path"), root).alias("media_path"),
        tx.resolve_path(F.col("thumbnail_path"), root).alias("thumbnail_path"),
        F.coalesce(ready & words, F.lit(False)).alias("can_summarise"),
        encode_retry_eligible(F.col("status"), F.col("session_status")).alias("can_retry_encode"),
        transcribe_eligible(F.col("status")).alias("can_transcribe"))


def recording_context(ids: DataFrame, recordings: DataFrame, transcripts: DataFrame,
                      segments: DataFrame, summaries: DataFrame, jobs: DataFrame,
                      sessions: DataFrame, root: str) -> dict[str, DataFrame]:
    """The parts of a detail view for the recordings in ``ids`` (one column, id)."""
    chosen = recordings.join(ids.select("id"), "id", "left_semi")
    return {
        "recording": chosen,
        "transcript": of_recordings(transcripts, chosen),
        "segments": of_recordings(segments, chosen),
        "summary": of_recordings(summaries, chosen),
        "jobs": list_jobs(of_recordings(jobs, chosen)),
        "session": of_recordings(sessions, chosen),
        "assets": asset_paths(chosen, root),
    }


def work_pending(recordings: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: whether any recording is processing or any job is queued or running."""
    busy = recordings.agg(F.bool_or(F.col("status") == "processing").alias("b"))
    open_jobs = jobs.agg(F.bool_or(F.col("state").isin("queued", "running")).alias("b"))
    return busy.unionByName(open_jobs).agg(
        F.coalesce(F.bool_or("b"), F.lit(False)).alias("work_pending"))
