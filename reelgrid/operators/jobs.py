"""Processing jobs: creation, queue order, state changes, retry and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelgrid import schemas
from reelgrid.functions import text as tx
from reelgrid.functions import variants as vr
from reelgrid.operators.running import with_group_facts
from reelgrid.operators.upserts import as_time

DEFAULT_MAX_ATTEMPTS = 3

# Job kind, queue priority, attempts allowed.
JOB_KINDS = (
    ("encode_recording", 20, 3),
    ("transcribe_recording", 10, 2),
    ("extract_audio", 9, 1),
    ("run_whisper", 8, 1),
    ("generate_thumbnail", 8, 1),
    ("index_transcript", 6, 1),
    ("ai_summary", 5, 2),
    ("clean_temp_files", 1, 2),
)
# A full reindex is queued below the per-transcript index step.
REINDEX_PRIORITY = 4
# Kinds a user can retry.
RETRYABLE_KINDS = ("encode_recording", "transcribe_recording", "ai_summary", "index_transcript",
                   "clean_temp_files")
# Kinds that belong to producing a transcript.
TRANSCRIPT_KINDS = ("transcribe_recording", "extract_audio", "run_whisper")
OPEN_STATES = ("queued", "running")
ENDED_STATES = ("succeeded", "failed", "cancelled")


def kind_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(JOB_KINDS, "kind string, priority long, max_attempts long")


def create_jobs(requests: DataFrame, recordings: DataFrame,
                now: Column | str | None = None) -> DataFrame:
    """Queued jobs from (request_id, recording_id, kind, priority, max_attempts,
    input_json). A named recording must exist; see ``refused_jobs`` for the rest."""
    known = recordings.select(F.col("id").alias("recording_id"))
    named = requests.where(F.col("recording_id").isNotNull()).join(
        known, "recording_id", "left_semi")
    free = requests.where(F.col("recording_id").isNull())
    allowed = F.coalesce(F.when(F.col("max_attempts") > 0, F.col("max_attempts")),
                         F.lit(DEFAULT_MAX_ATTEMPTS))
    fixed = {
        "id": tx.stable_id(F.lit("job"), F.col("request_id")), "state": F.lit("queued"),
        "priority": F.coalesce("priority", F.lit(0)), "attempts": F.lit(0),
        "max_attempts": allowed, "interrupted": F.lit(False),
        "created_at": as_time(now), "updated_at": as_time(now),
    }
    return free.unionByName(named).select(*[
        fixed.get(f.name, F.col(f.name) if f.name in requests.columns else F.lit(None))
        .cast(f.dataType).alias(f.name) for f in schemas.PROCESSING_JOBS.fields])


def refused_jobs(requests: DataFrame, recordings: DataFrame) -> DataFrame:
    return requests.where(F.col("recording_id").isNotNull()).join(
        recordings.select(F.col("id").alias("recording_id")), "recording_id", "left_anti")


def open_jobs(jobs: DataFrame, kind: str) -> DataFrame:
    return jobs.where((F.col("kind") == kind) & F.col("state").isin(*OPEN_STATES))


def with_open_job(recording_ids: DataFrame, jobs: DataFrame, kind: str,
                  present: bool = True) -> DataFrame:
    """Recordings (column recording_id) that have, or lack, an open job of a kind."""
    busy = open_jobs(jobs, kind).select("recording_id").distinct()
    return recording_ids.join(busy, "recording_id", "left_semi" if present else "left_anti")


def encode_requests(recording_ids: DataFrame, sessions: DataFrame, jobs: DataFrame) -> DataFrame:
    """One encode request per recording with a session and no open encode job."""
    s = sessions.select(
        "recording_id", F.col("id").alias("session_id"), "video_path", "audio_path",
        "microphone_audio_path", "source_audio_path")
    due = with_open_job(recording_ids.select("recording_id"), jobs, "encode_recording", False)
    _, priority, attempts = JOB_KINDS[0]
    body = F.struct(
        F.col("recording_id").alias("recordingId"), F.col("session_id").alias("sessionId"),
        F.col("video_path").alias("videoPath"), F.col("audio_path").alias("audioPath"),
        F.col("microphone_audio_path").alias("microphoneAudioPath"),
        F.col("source_audio_path").alias("sourceAudioPath"))
    return due.join(s, "recording_id").select(
        F.concat(F.lit("encode-"), "session_id").alias("request_id"), "recording_id",
        F.lit("encode_recording").alias("kind"), F.lit(priority).cast("bigint").alias("priority"),
        F.lit(attempts).cast("bigint").alias("max_attempts"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("input_json"))


def _queue_order() -> list[Column]:
    return [F.desc("priority"), F.asc("created_at"), F.asc("id")]


def next_jobs(jobs: DataFrame, n: int = 1) -> DataFrame:
    """The next ``n`` queued jobs: highest priority, then oldest."""
    return jobs.where("state = 'queued'").orderBy(*_queue_order()).limit(n)


def next_jobs_per(jobs: DataFrame, group: str, n: int = 1) -> DataFrame:
    """The next ``n`` queued jobs of each group; every task keeps n per group before
    the shuffle."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*_queue_order()))
    return jobs.where("state = 'queued'").withColumn("place", place).where(F.col("place") <= n)


def _started(now: Column | str | None) -> dict[str, Column]:
    nothing = F.lit(None).cast("string")
    return {"state": F.lit("running"), "attempts": F.col("attempts") + 1, "output_json": nothing,
            "error_message": nothing, "interrupted": F.lit(False), "last_error_at": nothing,
            "updated_at": as_time(now), "started_at": as_time(now), "completed_at": nothing}


def claim(jobs: DataFrame, n: int = 1, now: Column | str | None = None) -> DataFrame:
    """The next ``n`` jobs as they look once claimed. ``max_attempts`` does not stop a
    claim; see ``over_limit``."""
    return next_jobs(jobs, n).withColumns(_started(now))


def apply_rows(jobs: DataFrame, changed: DataFrame) -> DataFrame:
    """Table with the changed rows put in place of the old ones."""
    kept = jobs.join(changed.select("id"), "id", "left_anti").select(*jobs.columns)
    return kept.unionByName(changed.select(*jobs.columns))


def _time_of_error(state: Column, error: Column, interrupted: Column, old: Column,
                   now: Column) -> Column:
    fresh = error.isNotNull() | interrupted
    return F.when(fresh, now).when(state.isin("failed", "cancelled"), old)


def update_jobs(jobs: DataFrame, patches: DataFrame,
                now: Column | str | None = None) -> DataFrame:
    """Apply at most one patch per job (id, state, attempts, output_json, error_message,
    interrupted, started_at, completed_at; all but id may be null)."""
    fields = ["state", "attempts", "output_json", "error_message", "interrupted", "started_at",
              "completed_at"]
    p = F.col("_p")
    joined = jobs.join(patches.select(F.col("id").alias("_key"), F.struct(*fields).alias("_p")),
                       F.col("id") == F.col("_key"), "left")
    at = as_time(now)
    state = F.coalesce(p["state"], F.col("state"))
    interrupted = F.coalesce(p["interrupted"], F.col("interrupted"))
    error = F.when(state.isin("failed", "cancelled"),
                   F.coalesce(p["error_message"], F.col("error_message")))
    started = F.coalesce(p["started_at"], F.col("started_at"), F.when(state == "running", at))
    completed = F.when(state.isin(*ENDED_STATES),
                       F.coalesce(p["completed_at"], F.col("completed_at"), at))
    new = {
        "state": state, "attempts": F.coalesce(p["attempts"], F.col("attempts")),
        "output_json": F.coalesce(
            p["output_json"], F.when(state == "succeeded", F.col("output_json"))),
        "error_message": error, "interrupted": interrupted, "updated_at": at,
        "last_error_at": _time_of_error(state, error, interrupted, F.col("last_error_at"), at),
        "started_at": started, "completed_at": completed,
    }
    return joined.select(*[
        F.when(p.isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
        for c in jobs.columns])


def retry_jobs(jobs: DataFrame, ids: DataFrame, now: Column | str | None = None) -> DataFrame:
    """Put the given jobs (column id) back into the queue. Attempts are kept."""
    nothing = F.lit(None).cast("string")
    reset = {"state": F.lit("queued"), "output_json": nothing, "error_message": nothing,
             "interrupted": F.lit(False), "last_error_at": nothing, "updated_at": as_time(now),
             "started_at": nothing, "completed_at": nothing}
    return apply_rows(jobs, jobs.join(ids.select("id"), "id", "left_semi").withColumns(reset))


def retry_effects(jobs: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """What a retry does to the recording: change frames for the upsert operators. A retry
    whose model name is refused changes no transcript; ``refused`` has it with the error."""
    chosen = jobs.join(ids.select("id"), "id", "left_semi").where("recording_id IS NOT NULL")
    nothing = F.lit(None).cast("string")
    encode = chosen.where("kind = 'encode_recording'").select("recording_id").distinct()
    name, error = tx.model_name(input_model(F.col("input_json")))
    named = F.struct(name.alias("model_name"), error.alias("error"))
    asked = chosen.where(F.col("kind").isin(*TRANSCRIPT_KINDS)).groupBy("recording_id").agg(
        F.max_by(named, F.struct("updated_at", "id")).alias("n")).select("recording_id", "n.*")
    speech = asked.where("error IS NULL")
    summary = chosen.where("kind = 'ai_summary'").groupBy("recording_id").agg(
        F.max_by(input_notes(F.col("input_json")), F.struct("updated_at", "id")).alias("notes"))
    return {
        "recordings": encode.select(
            F.col("recording_id").alias("id"), F.lit("processing").alias("target"),
            nothing.alias("media_path"), nothing.alias("thumbnail_path"),
            F.lit(None).cast("bigint").alias("duration_ms"), nothing.alias("completed_at"),
            nothing.alias("failure_message")),
        "transcripts": speech.select(
            "recording_id", F.lit("processing").alias("status"), nothing.alias("language"),
            "model_name", nothing.alias("raw_json_path"), nothing.alias("text"),
            nothing.alias("completed_at"), nothing.alias("failure_message")),
        "summaries": summary.select(
            "recording_id", F.lit("processing").alias("status"), "notes"),
        "refused": asked.where("error IS NOT NULL").select("recording_id", "error"),
    }


def retry_eligible(kind: Column, state: Column, interrupted: Column) -> Column:
    return kind.isin(*RETRYABLE_KINDS) & (state.isin("failed", "cancelled") | interrupted)


def input_model(input_json: Column) -> Column:
    """Model name a job was given; null for none or for broken JSON."""
    return vr.string_at(F.try_parse_json(input_json), "$.modelName")


def input_notes(input_json: Column) -> Column:
    v = F.try_parse_json(input_json)
    return F.coalesce(vr.string_at(v, "$.userNotes"), vr.string_at(v, "$.payload.userNotes"))


def job_counts(jobs: DataFrame) -> DataFrame:
    """Jobs per kind with one column per state."""
    counts = jobs.groupBy("kind").pivot("state", list(schemas.JOB_STATES)).agg(F.count(F.lit(1)))
    return counts.na.fill(0, list(schemas.JOB_STATES))


def recording_job_report(jobs: DataFrame) -> DataFrame:
    """Jobs, attempts and errors per recording."""
    return jobs.where("recording_id IS NOT NULL").groupBy("recording_id").agg(
        F.count("*").alias("jobs"), F.sum("attempts").cast("bigint").alias("attempts"),
        F.count_if(F.col("error_message").isNotNull()).alias("errors"),
        F.count_if(F.col("attempts") > F.col("max_attempts")).alias("over_limit"),
        F.max("last_error_at").alias("last_error_at"))


def over_limit(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("attempts") > F.col("max_attempts"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final state of jobs from their update events alone.

    Events hold job_id, seq (unique per job, arrival order), at, and nullable state,
    attempts, output_json, error_message, interrupted, started_at, completed_at, as
    ``update_jobs`` patches do; the first event of a job should name its state. The
    result equals applying the events one by one, but is made of aggregates that
    combine on the map side, so a job with very many events is no hot spot. Two
    passes: the first finds where the job's last runs of states begin, the second
    aggregates the events from there on. A row made by ``as_base_event`` stands for
    all earlier events of a job.
    """
    for name, kind in (("last_error_at", "string"), ("events", "bigint")):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast(kind))
    seq, state = F.col("seq"), F.col("state")

    def last_seq(cond: Column) -> Column:
        return F.max(F.when(cond, seq))

    def last_value(c: str, cond: Column | None = None) -> Column:
        present = F.col(c).isNotNull() if cond is None else F.col(c).isNotNull() & cond
        return F.max_by(F.col(c), F.when(present, seq))

    marks = events.groupBy("job_id").agg(
        last_value("state").alias("final_state"),
        F.coalesce(last_seq(state.isin(*OPEN_STATES)), F.lit(-2)).alias("open_seq"),
        F.coalesce(last_seq(state != "succeeded"), F.lit(-2)).alias("unsucceeded_seq"),
        F.coalesce(last_seq(~state.isin("failed", "cancelled")), F.lit(-2)).alias("clean_seq"),
        last_seq(F.col("interrupted")).alias("true_seq"))
    # First event that names the state of the last run, per kind of run.
    rows = with_group_facts(events, marks, ["job_id"], "seq")
    starts = rows.groupBy("job_id", "final_state").agg(
        F.min(F.when(state.isNotNull() & (seq > F.col("open_seq")), seq)).alias("end_from"),
        F.min(F.when(state.isNotNull() & (seq > F.col("unsucceeded_seq")), seq)).alias("ok_from"),
        F.min(F.when(state.isNotNull() & (seq > F.col("clean_seq")), seq)).alias("bad_from"),
        F.min(F.when(~F.col("interrupted") & (seq > F.col("true_seq")), seq)).alias("false_from"))
    rows = with_group_facts(events, starts, ["job_id"], "seq")
    final = F.col("final_state")
    ended, bad = final.isin(*ENDED_STATES), final.isin("failed", "cancelled")
    before_ok = F.max(F.when(seq < F.col("ok_from"), F.struct("seq", "output_json")))
    folded = rows.groupBy("job_id", "final_state").agg(
        F.max(F.struct("seq", "output_json"))["output_json"].alias("last_output"),
        before_ok["output_json"].alias("output_before"),
        last_value("output_json", seq >= F.col("ok_from")).alias("ok_output"),
        last_value("error_message", seq >= F.col("bad_from")).alias("bad_error"),
        last_value("attempts").alias("attempts"),
        F.coalesce(last_value("interrupted"), F.lit(False)).alias("interrupted"),
        F.max(F.when(seq < F.col("false_from"), F.struct("seq", "at"))).alias("last_interrupted"),
        F.max(F.when(seq < F.col("bad_from"), seq)).alias("before_bad"),
        last_value("started_at").alias("given_start"),
        F.min(F.when(state == "running", F.struct("seq", "at")))["at"].alias("first_run"),
        last_value("completed_at", seq >= F.col("end_from")).alias("given_end"),
        F.min(F.when(seq == F.col("end_from"), F.col("at"))).alias("first_end"),
        F.max(F.struct("seq", "at"))["at"].alias("updated_at"),
        last_value("last_error_at").alias("base_error_at"),
        F.sum(F.coalesce("events", F.lit(1))).cast("bigint").alias("events"))
    error = F.when(bad, F.col("bad_error"))
    # Kept from an interruption that was lifted during the run of failed states.
    earlier = F.coalesce(
        F.when(F.col("last_interrupted.seq") >= F.coalesce("before_bad", F.lit(-2)),
               F.col("last_interrupted.at")),
        F.when(F.col("before_bad").isNull(), F.col("base_error_at")))
    return folded.select(
        "job_id", final.alias("state"), F.coalesce("attempts", F.lit(0)).alias("attempts"),
        F.when(final == "succeeded", F.coalesce("ok_output", "output_before"))
        .otherwise(F.col("last_output")).alias("output_json"),
        error.alias("error_message"), "interrupted",
        _time_of_error(final, error, F.col("interrupted"), earlier, F.col("updated_at"))
        .alias("last_error_at"),
        F.coalesce("given_start", "first_run").alias("started_at"),
        F.when(ended, F.coalesce("given_end", "first_end")).alias("completed_at"),
        "updated_at", "events")


def as_base_event(states: DataFrame) -> DataFrame:
    """Folded rows as first events, so that later events can be folded onto them."""
    return states.select(
        "job_id", F.lit(-1).cast("bigint").alias("seq"), F.col("updated_at").alias("at"), "state",
        "attempts", "output_json", "error_message", "interrupted", "started_at", "completed_at",
        "last_error_at", "events")
