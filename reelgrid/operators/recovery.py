"""Recovery after a stop: interrupted captures and jobs, rescheduling, cleanup plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions import text as tx
from reelgrid.operators import jobs as jb
from reelgrid.operators import upserts as up

# Messages stored with interrupted work.
INTERRUPTED_JOB = "Job was interrupted because the app stopped before it completed."
INTERRUPTED_CAPTURE = ("Recording capture was interrupted because the app stopped before the "
                       "session finished.")

# Working files that may always be removed from a recording directory.
REMOVABLE_FILES = (
    "encoding-video.bgra", "encoding-audio.raw", "encoding-microphone.raw", "encoding-source.raw",
    "recording.tmp.mp4", "thumbnail.tmp.jpg", "transcript-audio.wav", "whisper-output.json")
REMOVABLE_PREFIX = "recording.tmp.mp4.sb-"


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def interrupted_jobs(jobs: DataFrame, now: Column | str | None = None,
                     message: str = INTERRUPTED_JOB) -> DataFrame:
    """The running jobs, as they look once interrupted; exactly the rows changed."""
    at = up.as_time(now)
    return jobs.where("state = 'running'").withColumns({
        "state": F.lit("failed"), "interrupted": F.lit(True), "error_message": F.lit(message),
        "last_error_at": at, "updated_at": at, "completed_at": at})


def interrupt_jobs(jobs: DataFrame, now: Column | str | None = None,
                   message: str = INTERRUPTED_JOB) -> DataFrame:
    """The job table with all running jobs interrupted, in one pass and no shuffle."""
    at, running = up.as_time(now), F.col("state") == "running"
    new = {"state": F.lit("failed"), "interrupted": F.lit(True), "error_message": F.lit(message),
           "last_error_at": at, "updated_at": at, "completed_at": at}
    return jobs.select(*[
        F.when(running, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
        for c in jobs.columns])


def interruption_effects(interrupted: DataFrame,
                         message: str = INTERRUPTED_JOB) -> dict[str, DataFrame]:
    """Change frames by kind of interrupted job, one row per recording.

    Encoding fails the recording, transcript work fails the transcript, summary work
    fails the summary. Where several jobs of a recording were interrupted, the one
    last in queue order names the model.
    """
    owned = interrupted.where("recording_id IS NOT NULL")
    name, _ = tx.model_name(jb.input_model(F.col("input_json")))
    last = F.struct(-F.col("priority"), "created_at", "id")
    encode = owned.where("kind = 'encode_recording'").select("recording_id").distinct()
    speech = owned.where(F.col("kind").isin(*jb.TRANSCRIPT_KINDS)).groupBy("recording_id").agg(
        F.max_by(F.coalesce(name, F.lit(tx.DEFAULT_MODEL)), last).alias("model_name"))
    summary = owned.where("kind = 'ai_summary'").select("recording_id").distinct()
    text = F.lit(message)
    return {
        "recordings": encode.select(
            F.col("recording_id").alias("id"), F.lit("failed").alias("target"),
            _null().alias("media_path"), _null().alias("thumbnail_path"),
            _null("bigint").alias("duration_ms"), _null().alias("completed_at"),
            text.alias("failure_message")),
        "transcripts": speech.select(
            "recording_id", F.lit("failed").alias("status"), _null().alias("language"),
            "model_name", _null().alias("raw_json_path"), _null().alias("text"),
            _null().alias("completed_at"), text.alias("failure_message")),
        "summaries": summary.select(
            "recording_id", F.lit("failed").alias("status"),
            *[_null().alias(c) for c in (
                "model_name", "summary_text", "action_items_json", "decisions_json",
                "questions_json", "risks_json", "chapters_json", "completed_at")],
            text.alias("failure_message")),
    }


def interrupted_captures(recordings: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions still capturing whose recording exists: session id, recording_id."""
    return sessions.where("status = 'capturing'").join(
        recordings.select(F.col("id").alias("recording_id")), "recording_id", "left_semi")


def capture_effects(captures: DataFrame,
                    now: Column | str | None = None) -> dict[str, DataFrame]:
    """Patch frames for sessions and recordings of interrupted captures."""
    at = up.as_time(now)
    kept = ["width", "height", *up.CAPTURE_DETAILS, "frame_count", "audio_byte_count",
            "microphone_audio_byte_count", "source_audio_byte_count"]
    return {
        "sessions": captures.select(
            "id", F.lit("failed").alias("status"), *kept, at.alias("stopped_at"),
            F.coalesce("duration_ms", F.lit(0)).cast("bigint").alias("duration_ms"),
            F.lit(INTERRUPTED_CAPTURE).alias("failure_message")),
        "recordings": captures.select(
            F.col("recording_id").alias("id"), _null().alias("title"),
            F.lit("failed").alias("status"), _null().alias("media_path"),
            _null().alias("thumbnail_path"), _null("bigint").alias("duration_ms"),
            _null().alias("captured_at"), at.alias("completed_at"),
            F.lit(INTERRUPTED_CAPTURE).alias("failure_message")),
    }


def reschedulable(recordings: DataFrame, sessions: DataFrame, jobs: DataFrame) -> DataFrame:
    """recording_id of recordings in processing without media, whose session stopped
    and which have no open encode job."""
    due = recordings.where("status = 'processing' AND media_path IS NULL").select(
        F.col("id").alias("recording_id"))
    stopped = sessions.where("status = 'stopped'").select("recording_id")
    return jb.with_open_job(due.join(stopped, "recording_id", "left_semi"), jobs,
                            "encode_recording", present=False)


def recover(tables: dict[str, DataFrame], now: Column | str | None = None) -> dict[str, DataFrame]:
    """Tables after a restart and a one-row ``recovery`` summary.

    Order: interrupted captures, interrupted jobs with their effects, rescheduling.
    """
    at = up.as_time(now)
    recordings, sessions, jobs = tables["recordings"], tables["recording_sessions"], tables[
        "processing_jobs"]
    captures = interrupted_captures(recordings, sessions)
    patch = capture_effects(captures, at)
    sessions = up.finish_sessions(sessions, patch["sessions"], at)
    recordings = up.patch_recordings(recordings, patch["recordings"], at)

    stopped = interrupted_jobs(jobs, at)
    effects = interruption_effects(stopped)
    alive = recordings.select(F.col("id").alias("recording_id"))
    speech = effects["transcripts"].join(alive, "recording_id", "left_semi")
    recordings = up.change_recording_status(recordings, effects["recordings"], at)
    transcripts = up.upsert_transcripts(tables["transcripts"], speech, at)
    gone = transcripts.join(speech.select("recording_id"), "recording_id", "left_semi").select(
        F.col("id").alias("transcript_id"))
    segments = tables["transcript_segments"].join(gone, "transcript_id", "left_anti").select(
        *tables["transcript_segments"].columns)
    summaries = up.upsert_summaries(
        tables["ai_summaries"], effects["summaries"].join(alive, "recording_id", "left_semi"), at)
    jobs = interrupt_jobs(jobs, at)

    due = reschedulable(recordings, sessions, jobs)
    requests = jb.encode_requests(due, sessions, jobs).withColumn(
        "request_id", F.concat_ws("-", "request_id", at))
    recordings = up.patch_recordings(recordings, due.select(
        F.col("recording_id").alias("id"), *[_null("bigint" if c == "duration_ms" else "string")
                                             .alias(c) for c in up.RECORDING_PATCH]), at)
    jobs = jobs.unionByName(jb.create_jobs(requests, recordings, at))
    return {
        "recordings": recordings, "recording_sessions": sessions, "processing_jobs": jobs,
        "transcripts": transcripts, "transcript_segments": segments, "ai_summaries": summaries,
        "recovery": recovery_summary(tables, captures, due),
    }


def recovery_summary(tables: dict[str, DataFrame], captures: DataFrame,
                     due: DataFrame) -> DataFrame:
    """One row: interrupted jobs and recordings, rescheduled and queued jobs. Each
    rescheduled recording adds one queued job."""
    counts = tables["processing_jobs"].agg(
        F.count_if(F.col("state") == "running").alias("interrupted_jobs"),
        F.count_if(F.col("state") == "queued").alias("queued"))
    rescheduled = due.agg(F.count("*").alias("n")).scalar()
    return counts.select(
        "interrupted_jobs",
        captures.agg(F.count("*").alias("n")).scalar().alias("interrupted_recordings"),
        rescheduled.alias("rescheduled_jobs"),
        (F.col("queued") + rescheduled).alias("queued_jobs"))


def _plain_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def _parent_folders(files: DataFrame) -> DataFrame:
    """All folders that hold a file, at any depth."""
    parent = F.expr("left(path, length(path) - length(substring_index(path, '/', -1)) - 1)")
    direct = files.select(parent.alias("folder")).distinct()
    folders = F.transform(
        F.sequence(F.lit(2), F.size(F.split("folder", "/"))),
        lambda n: F.call_function("substring_index", F.col("folder"), F.lit("/"), n))
    return direct.where(F.col("folder") != "").select(F.explode(folders).alias("folder")).distinct()


def cleanup_plan(recordings: DataFrame, sessions: DataFrame, inventory: DataFrame,
                 root: str) -> DataFrame:
    """recording_id, action (remove or preserve), path. Nothing is deleted.

    ``inventory`` lists existing files (column path). Working files may always go; a
    session's temporary folder goes only when the recording is completed and its
    media file exists, else its files are listed as preserved.
    """
    files = inventory.select(_plain_path(F.col("path")).alias("path"))
    name = F.substring_index("path", "/", -1)
    working = files.where(name.isin(*REMOVABLE_FILES) | name.startswith(REMOVABLE_PREFIX)).select(
        "path", F.expr("left(path, length(path) - length(substring_index(path, '/', -1)) - 1)")
        .alias("folder"))
    homes = recordings.select(
        F.col("id").alias("recording_id"), "status",
        F.rtrim(tx.resolve_path(F.col("recording_directory"), root), F.lit("/")).alias("folder"),
        tx.resolve_path(F.col("media_path"), root).alias("media"))
    always = working.join(homes, "folder").select(
        "recording_id", F.lit("remove").alias("action"), "path")

    found = files.select(F.col("path").alias("media"), F.lit(True).alias("has_media"))
    checked = homes.join(found, "media", "left").select(
        "recording_id",
        ((F.col("status") == "completed") & F.coalesce("has_media", F.lit(False))).alias("safe"))

    def full(c: str) -> Column:
        return tx.resolve_path(F.col(c), root)

    held = sessions.select(
        "recording_id", full("temp_directory").alias("temp"), full("video_path").alias("video"),
        full("microphone_audio_path").alias("mic"), full("source_audio_path").alias("source"),
        full("audio_path").alias("legacy"), full("metadata_path").alias("metadata")
    ).join(checked, "recording_id")
    folders = _parent_folders(files).select(F.col("folder").alias("temp"))
    dropped = held.where("safe").join(folders, "temp", "left_semi").select(
        "recording_id", F.lit("remove").alias("action"), F.col("temp").alias("path"))
    first = F.array("temp", "video", "mic", "source")
    repeated = F.coalesce(F.array_contains(F.array_compact(first), F.col("legacy")), F.lit(True))
    kept = F.concat(first, F.array(F.when(~repeated, F.col("legacy")), F.col("metadata")))
    preserved = held.where("NOT safe").select(
        "recording_id", F.lit("preserve").alias("action"),
        F.explode(F.array_compact(kept)).alias("path"))
    return always.unionByName(dropped).unionByName(preserved)
