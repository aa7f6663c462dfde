"""Registered queries: library reads, upserts, constraints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid import schemas
from reelgrid.operators import constraints as cn
from reelgrid.operators import lookups as lk
from reelgrid.operators import transcripts as tr
from reelgrid.operators import upserts as up
from reelgrid.plans import stand_ins as st
from reelgrid.session import shared_folder
from reelgrid.sources import library as lib

NOW = st.NOW


def library_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enum check on read: order status letters are not job states, so some rows fail."""
    jobs = st.order_jobs(spark, sf_dir).withColumn(
        "state", F.when(F.col("attempts") == 4, F.concat(F.lit("was "), "state"))
        .otherwise(F.col("state")))
    good = lib.valid_rows(jobs, "processing_jobs").groupBy("state").agg(F.count("*").alias("jobs"))
    bad = lib.rejected_rows(jobs, "processing_jobs").groupBy("fault").agg(F.count("*").alias("jobs"))
    return good.select(F.lit("valid").alias("outcome"), F.col("state").alias("detail"), "jobs"
                       ).unionByName(bad.select(F.lit("rejected").alias("outcome"),
                                                F.col("fault").alias("detail"), "jobs"))


VALID_SQL = st.with_sql(st.JOB_SQL) + """
SELECT CASE WHEN attempts = 4 THEN 'rejected' ELSE 'valid' END AS outcome,
       CASE WHEN attempts = 4 THEN 'state=was ' || state ELSE state END AS detail, count(*) AS jobs
FROM order_jobs GROUP BY ALL"""


def library_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lk.list_recordings(st.doc_recordings(spark, sf_dir)).select(
        "id", "title", "status", "duration_ms", "created_at")


LATEST_SQL = st.with_sql(st.DOC_SQL) + """
SELECT id, title, status, duration_ms, created_at FROM doc_recordings ORDER BY created_at DESC, id"""


def recording_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording named by a job, with its session (set form of the id lookups)."""
    named = st.order_jobs(spark, sf_dir).select("recording_id").where("recording_id IS NOT NULL").distinct()
    sessions = st.event_sessions(spark, sf_dir).select(
        "recording_id", F.col("id").alias("session_id"), F.col("status").alias("session_status"))
    recordings = st.doc_recordings(spark, sf_dir).select(
        F.col("id").alias("recording_id"), "title", "status")
    return recordings.join(named, "recording_id", "left_semi").join(
        sessions, "recording_id", "left")


LOOKUP_SQL = st.with_sql(st.DOC_SQL, st.JOB_SQL, st.SESSION_SQL) + """
SELECT r.id AS recording_id, r.title, r.status, s.id AS session_id, s.status AS session_status
FROM doc_recordings r LEFT JOIN event_sessions s ON s.recording_id = r.id
WHERE r.id IN (SELECT recording_id FROM order_jobs WHERE recording_id IS NOT NULL)"""


def transcript_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts with their ordered segments; every third transcript has gaps in its indexes."""
    segments = st.talk_segments(spark, sf_dir)
    gaps = F.substring("transcript_id", 2, 20).cast("bigint") % 3 == 0
    segments = segments.withColumn("segment_index", F.when(
        gaps, F.col("segment_index") * 5000 + 7).otherwise(F.col("segment_index")))
    return lk.nested_transcripts(st.talk_transcripts(spark, sf_dir), segments).select(
        "id", "recording_id", "status", "position", "segment_index", "start_ms", "end_ms",
        "segment_text")


NESTED_SQL = st.with_sql(st.TALK_SQL) + """
SELECT t.id, t.recording_id, t.status,
       row_number() OVER (PARTITION BY t.id ORDER BY s.segment_index) - 1 AS position,
       CASE WHEN CAST(substr(t.id, 2) AS BIGINT) % 3 = 0 THEN s.segment_index * 5000 + 7 ELSE s.segment_index END AS segment_index,
       start_ms, end_ms, s.text AS segment_text
FROM talk_transcripts t LEFT JOIN talk_segments s ON s.transcript_id = t.id"""


def transcript_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews of both libraries: stored texts and joined segments."""
    docs = tr.transcript_preview(st.doc_transcripts(spark, sf_dir), st.doc_segments(spark, sf_dir))
    talks = tr.transcript_preview(st.talk_transcripts(spark, sf_dir),
                                  st.talk_segments(spark, sf_dir))
    return docs.unionByName(talks)


PREVIEW_SQL = st.with_sql(st.DOC_SQL, st.TALK_SQL) + """
SELECT t.recording_id, coalesce(nullif(t.text, ''), s.text, '') AS preview
FROM doc_transcripts t LEFT JOIN doc_segments s ON s.transcript_id = t.id
UNION ALL
SELECT recording_id, string_agg(text, ' ' ORDER BY segment_index) FROM talk_segments GROUP BY recording_id"""


def library_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lk.overview({"recordings": st.doc_recordings(spark, sf_dir),
                        "processing_jobs": st.order_jobs(spark, sf_dir)})


OVERVIEW_SQL = """
SELECT 'recordings' AS table_name, count(*) AS row_count FROM documents
UNION ALL SELECT 'processing_jobs', count(*) FROM orders"""


def asset_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lk.asset_paths(st.doc_recordings(spark, sf_dir), st.ROOT)


ASSET_SQL = st.with_sql(st.DOC_SQL) + """
SELECT id AS recording_id,
       CASE WHEN media_path LIKE '/%' THEN media_path ELSE '/library/' || media_path END AS media_path,
       '/library/' || thumbnail_path AS thumbnail_path FROM doc_recordings"""


def recording_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = st.library(spark, sf_dir)
    return lk.recording_detail(t["recordings"], t["transcripts"], t["transcript_segments"],
                               t["ai_summaries"], t["processing_jobs"], t["recording_sessions"],
                               st.ROOT)


DETAIL_SQL = st.with_sql(st.DOC_SQL, st.JOB_SQL, st.SESSION_SQL, st.SUMMARY_SQL, """
jt AS (SELECT recording_id, count(*) AS job_count, count(*) FILTER (state IN ('queued', 'running')) AS open_job_count,
              arg_max(id, (updated_at, id)) AS latest_job_id
       FROM order_jobs WHERE recording_id IS NOT NULL GROUP BY recording_id)""") + """
SELECT r.id AS recording_id, r.title, r.status, t.status AS transcript_status, a.status AS summary_status,
       s.id AS session_id, s.status AS session_status, CAST(1 AS BIGINT) AS segment_count,
       coalesce(job_count, 0) AS job_count, coalesce(open_job_count, 0) AS open_job_count, latest_job_id,
       CASE WHEN media_path LIKE '/%' THEN media_path ELSE '/library/' || media_path END AS media_path,
       '/library/' || thumbnail_path AS thumbnail_path,
       r.status = 'completed' AND t.status = 'completed' AND regexp_matches(g.text, '\\S') AS can_summarise,
       coalesce(r.status = 'failed' AND s.status = 'stopped', false) AS can_retry_encode,
       r.status = 'completed' AS can_transcribe
FROM doc_recordings r JOIN doc_transcripts t ON t.recording_id = r.id JOIN doc_segments g ON g.recording_id = r.id
  LEFT JOIN doc_summaries a ON a.recording_id = r.id LEFT JOIN event_sessions s ON s.recording_id = r.id
  LEFT JOIN jt ON jt.recording_id = r.id"""


def work_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lk.work_pending(st.doc_recordings(spark, sf_dir), st.order_jobs(spark, sf_dir))


PENDING_SQL = st.with_sql(st.DOC_SQL, st.JOB_SQL) + """
SELECT EXISTS (SELECT 1 FROM doc_recordings WHERE status = 'processing')
    OR EXISTS (SELECT 1 FROM order_jobs WHERE state IN ('queued', 'running')) AS work_pending"""


def recording_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = st.given(spark, sf_dir, "pages").select(
        F.col("page_id").alias("request_id"),
        F.when(F.col("page_id") % 3 == 0, F.lit("  \t ")).otherwise(
            F.concat(F.lit("  "), "url", F.lit("\n"))).alias("title"),
        F.lit(None).cast("string").alias("media_path"), F.lit("2024").alias("captured_at"))
    return up.create_recordings(requests, NOW)


CREATE_SQL = """
SELECT md5('recording|' || page_id) AS id,
       CASE WHEN page_id % 3 = 0 THEN 'Untitled recording' ELSE trim(url) END AS title, 'pending' AS status,
       'recordings/' || md5('recording|' || page_id) AS recording_directory,
       CAST(NULL AS VARCHAR) AS media_path, CAST(NULL AS VARCHAR) AS thumbnail_path,
       CAST(NULL AS BIGINT) AS duration_ms, '2024' AS captured_at, '1800000000' AS created_at,
       '1800000000' AS updated_at, CAST(NULL AS VARCHAR) AS completed_at, CAST(NULL AS VARCHAR) AS failure_message
FROM pages"""


def _doc_key(column: str = "doc_id"):
    return F.concat(F.lit("d"), F.col(column).cast("string"))


def label_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as patches: title and failure text from them, the rest left alone."""
    null = F.lit(None).cast("string")
    return st.given(spark, sf_dir, "labels").select(
        _doc_key().alias("id"),
        F.when(F.col("quality") == 1, F.concat(F.lit("good "), F.col("doc_id").cast("string")))
        .alias("title"), null.alias("status"), null.alias("media_path"),
        null.alias("thumbnail_path"),
        F.when(F.col("toxic") == 1, F.lit(5).cast("bigint")).alias("duration_ms"),
        null.alias("captured_at"), null.alias("completed_at"),
        F.when(F.col("toxic") == 1, F.lit("toxic")).alias("failure_message"))


def recording_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return up.patch_recordings(st.doc_recordings(spark, sf_dir), label_patches(spark, sf_dir), NOW)


def stored_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patches applied to a stored table, in the folders of the patched recordings."""
    path = shared_folder(spark, f"stored-{uuid.uuid4().hex}")
    lib.write_snapshot(st.doc_recordings(spark, sf_dir), path)
    patches = label_patches(spark, sf_dir)
    lib.change_snapshot(spark, path, "recordings", patches.select("id"),
                        lambda rows: up.patch_recordings(rows, patches, NOW))
    return lib.read_snapshot(spark, path, "recordings")


PATCH_SQL = st.with_sql(st.DOC_SQL) + """
SELECT r.id, CASE WHEN quality = 1 THEN 'good ' || l.doc_id ELSE r.title END AS title, r.status,
       recording_directory, media_path, thumbnail_path,
       CASE WHEN toxic = 1 THEN CAST(5 AS BIGINT) ELSE duration_ms END AS duration_ms, captured_at, created_at,
       CASE WHEN l.doc_id IS NULL THEN updated_at ELSE '1800000000' END AS updated_at, completed_at,
       CASE WHEN toxic = 1 THEN 'toxic' ELSE failure_message END AS failure_message
FROM doc_recordings r LEFT JOIN labels l ON 'd' || l.doc_id = r.id"""


def patch_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    patches = st.given(spark, sf_dir, "customer").select(_doc_key("c_custkey").alias("id"))
    return up.unmatched(patches, st.doc_recordings(spark, sf_dir))


UNMATCHED_SQL = """
SELECT 'd' || c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM documents)"""


def recording_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = F.lit(None).cast("string")
    target = (F.when(F.col("doc_id") % 3 == 0, "processing")
              .when(F.col("doc_id") % 3 == 1, "completed").otherwise("failed"))
    changes = st.given(spark, sf_dir, "labels").select(
        _doc_key().alias("id"), target.alias("target"), F.lit("new.mp4").alias("media_path"),
        F.lit("new.jpg").alias("thumbnail_path"), F.col("doc_id").alias("duration_ms"),
        F.lit("1799999999").alias("completed_at"), F.lit("broken").alias("failure_message"))
    return up.change_recording_status(st.doc_recordings(spark, sf_dir), changes, NOW)


TRANSITION_SQL = st.with_sql(st.DOC_SQL) + """
SELECT r.id, r.title, recording_directory, captured_at, created_at,
       CASE WHEN l.doc_id IS NULL THEN r.status WHEN l.doc_id % 3 = 0 THEN 'processing'
         WHEN l.doc_id % 3 = 1 THEN 'completed' ELSE 'failed' END AS status,
       CASE WHEN l.doc_id IS NULL THEN media_path WHEN l.doc_id % 3 = 1 THEN 'new.mp4' END AS media_path,
       CASE WHEN l.doc_id IS NULL THEN thumbnail_path WHEN l.doc_id % 3 = 1 THEN 'new.jpg' END AS thumbnail_path,
       CASE WHEN l.doc_id % 3 = 1 THEN l.doc_id ELSE duration_ms END AS duration_ms,
       CASE WHEN l.doc_id IS NULL THEN updated_at ELSE '1800000000' END AS updated_at,
       CASE WHEN l.doc_id IS NULL THEN completed_at WHEN l.doc_id % 3 = 1 THEN '1799999999' END AS completed_at,
       CASE WHEN l.doc_id IS NULL THEN failure_message WHEN l.doc_id % 3 = 2 THEN 'broken' END AS failure_message
FROM doc_recordings r LEFT JOIN labels l ON 'd' || l.doc_id = r.id"""


def _incoming_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transcript per customer: some for known recordings, some for new ones."""
    null = F.lit(None).cast("string")
    return st.given(spark, sf_dir, "customer").select(
        _doc_key("c_custkey").alias("recording_id"),
        F.when(F.col("c_acctbal") < 0, "failed").otherwise("completed").alias("status"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("en")).alias("language"),
        F.lit("base").alias("model_name"), null.alias("raw_json_path"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("text"),
        F.lit(NOW).alias("completed_at"), null.alias("failure_message"))


def transcript_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return up.upsert_transcripts(st.doc_transcripts(spark, sf_dir),
                                 _incoming_transcripts(spark, sf_dir), NOW)


UPSERT_SQL = st.with_sql(st.DOC_SQL) + """
SELECT coalesce(t.id, md5('transcript|d' || c_custkey)) AS id, coalesce(t.recording_id, 'd' || c_custkey) AS recording_id,
       CASE WHEN c_custkey IS NULL THEN t.status WHEN c_acctbal < 0 THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN c_custkey IS NULL THEN t.language WHEN c_custkey % 2 = 0 THEN 'en' END AS language,
       CASE WHEN c_custkey IS NULL THEN t.model_name ELSE 'base' END AS model_name,
       CAST(NULL AS VARCHAR) AS raw_json_path,
       CASE WHEN c_custkey IS NULL THEN t.text WHEN c_acctbal >= 0 THEN c_name END AS text,
       coalesce(t.created_at, '1800000000') AS created_at,
       CASE WHEN c_custkey IS NULL THEN t.updated_at ELSE '1800000000' END AS updated_at,
       CASE WHEN c_custkey IS NOT NULL THEN '1800000000' END AS completed_at, CAST(NULL AS VARCHAR) AS failure_message
FROM doc_transcripts t FULL JOIN customer ON 'd' || c_custkey = t.recording_id"""


def segment_changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, replaced transcripts and what comes in: every third conversation gets new
    segments; every sixth one loses all of them."""
    segments = st.talk_segments(spark, sf_dir)
    number = F.substring("transcript_id", 2, 20).cast("bigint")
    replaced = st.talk_transcripts(spark, sf_dir).select(
        F.col("id").alias("transcript_id"), "recording_id").where(number % 3 == 0)
    incoming = segments.where((number % 3 == 0) & (number % 6 != 0)).select(
        "transcript_id", F.col("segment_index").alias("position"),
        F.when(F.col("segment_index") % 2 == 0, F.col("segment_index") * 10).alias("segment_index"),
        "start_ms", "end_ms", F.concat(F.lit("again: "), "text").alias("text"), "confidence")
    return segments, replaced, incoming


def segment_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return up.replace_segments(*segment_changes(spark, sf_dir), NOW)


def stored_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same replacement on stored segments, in the folders of the replaced transcripts."""
    path = shared_folder(spark, f"stored-{uuid.uuid4().hex}")
    segments, replaced, incoming = segment_changes(spark, sf_dir)
    lib.write_snapshot(segments, path, "recording_id")
    lib.change_snapshot(spark, path, "transcript_segments", replaced.select("recording_id"),
                        lambda rows: up.replace_segments(rows, replaced, incoming, NOW), "recording_id")
    return lib.read_snapshot(spark, path, "transcript_segments")


SEGMENT_REPLACE_SQL = st.with_sql(
    st.TALK_SQL, "s AS (SELECT *, CAST(substr(transcript_id, 2) AS BIGINT) AS k FROM talk_segments)",
    """n AS (SELECT *, CASE WHEN segment_index % 2 = 0 THEN segment_index * 10 ELSE segment_index END AS i
       FROM s WHERE k % 3 = 0 AND k % 6 <> 0)""") + """
SELECT id, transcript_id, recording_id, segment_index, start_ms, end_ms, text, confidence FROM s WHERE k % 3 <> 0
UNION ALL
SELECT md5('segment|' || transcript_id || '|' || i || '|1800000000'), transcript_id, recording_id, i, start_ms,
       end_ms, 'again: ' || text, confidence FROM n"""


def summary_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming = st.given(spark, sf_dir, "customer").select(
        _doc_key("c_custkey").alias("recording_id"), F.lit("completed").alias("status"),
        *[F.lit(None).cast("string").alias(c) for c in (
            "model_name", "action_items_json", "decisions_json", "questions_json", "risks_json",
            "chapters_json", "completed_at", "failure_message")],
        F.col("c_name").alias("summary_text"))
    return up.upsert_summaries(st.doc_summaries(spark, sf_dir), incoming, NOW).select(
        "id", "recording_id", "status", "summary_text", "created_at", "updated_at")


SUMMARY_UPSERT_SQL = st.with_sql(st.SUMMARY_SQL) + """
SELECT coalesce(a.id, md5('summary|d' || c_custkey)) AS id, coalesce(a.recording_id, 'd' || c_custkey) AS recording_id,
       CASE WHEN c_custkey IS NULL THEN a.status ELSE 'completed' END AS status,
       CASE WHEN c_custkey IS NULL THEN a.summary_text ELSE c_name END AS summary_text,
       coalesce(a.created_at, '1800000000') AS created_at,
       CASE WHEN c_custkey IS NULL THEN a.updated_at ELSE '1800000000' END AS updated_at
FROM doc_summaries a FULL JOIN customer ON 'd' || c_custkey = a.recording_id"""


def _session_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches from events: only sessions of errors get one."""
    e = F.col("event_id")
    patch = {"width": F.when(e % 2 == 0, F.lit(640)), "height": F.when(e % 2 == 0, F.lit(480)),
             "source_audio_sample_rate": F.lit(22050), "source_audio_sample_format": F.lit("f32"),
             "status": F.lit("failed"), "frame_count": F.lit(7), "audio_byte_count": F.lit(120),
             "microphone_audio_byte_count": F.lit(120), "source_audio_byte_count": F.lit(240),
             "stopped_at": F.lit(NOW), "duration_ms": F.lit(99), "failure_message": F.lit(None)}
    types = {f.name: f.dataType for f in schemas.RECORDING_SESSIONS.fields}
    names = ["width", "height", *up.CAPTURE_DETAILS, "status", "frame_count", "audio_byte_count",
             "microphone_audio_byte_count", "source_audio_byte_count", "stopped_at", "duration_ms",
             "failure_message"]
    return st.given(spark, sf_dir, "events").where("event_type = 'error'").select(
        F.concat(F.lit("s"), e.cast("string")).alias("id"),
        *[patch.get(n, F.lit(None)).cast(types[n]).alias(n) for n in names])


SESSION_FACTS = ["id", "status", "width", "height", "frame_count", "audio_byte_count",
                 "microphone_audio_byte_count", "source_audio_byte_count",
                 "source_audio_sample_rate", "source_audio_sample_format", "source_audio_channels",
                 "audio_sample_rate", "stopped_at", "duration_ms", "failure_message", "updated_at"]


def session_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return up.finish_sessions(st.event_sessions(spark, sf_dir),
                              _session_patches(spark, sf_dir), NOW).select(*SESSION_FACTS)


def session_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return up.patch_capture_details(st.event_sessions(spark, sf_dir),
                                    _session_patches(spark, sf_dir), NOW).select(*SESSION_FACTS)


def _session_patch_sql(final: bool) -> str:
    def put(c: str, v: str) -> str:
        return f"CASE WHEN hit THEN {v} ELSE {c} END AS {c}" if final else c
    return st.with_sql(st.SESSION_SQL, """
p AS (SELECT *, status = 'failed' AS hit, hit AND CAST(substr(id, 2) AS BIGINT) % 2 = 0 AS even FROM event_sessions)""") + f"""
SELECT id, status, CASE WHEN even THEN 640 ELSE width END AS width, CASE WHEN even THEN 480 ELSE height END AS height,
       {put('frame_count', '7')}, {put('audio_byte_count', '120')}, {put('microphone_audio_byte_count', '120')},
       {put('source_audio_byte_count', '240')},
       CASE WHEN hit THEN 22050 ELSE source_audio_sample_rate END AS source_audio_sample_rate,
       CASE WHEN hit THEN 'f32' ELSE source_audio_sample_format END AS source_audio_sample_format,
       source_audio_channels, audio_sample_rate, {put('stopped_at', "'1800000000'")}, {put('duration_ms', '99')},
       failure_message, CASE WHEN hit THEN '1800000000' ELSE updated_at END AS updated_at
FROM p"""


def session_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = st.event_sessions(spark, sf_dir).drop(
        "status", "frame_count", "audio_byte_count", "microphone_audio_byte_count",
        "source_audio_byte_count", "stopped_at", "duration_ms", "created_at", "updated_at")
    return up.create_sessions(rows, NOW).select(
        "id", "status", "screen_source_id", "audio_mode", "frame_count", "audio_byte_count",
        "stopped_at", "duration_ms", "created_at")


SESSION_CREATE_SQL = st.with_sql(st.SESSION_SQL) + """
SELECT id, 'capturing' AS status, screen_source_id, audio_mode, CAST(0 AS BIGINT) AS frame_count,
       CAST(0 AS BIGINT) AS audio_byte_count, CAST(NULL AS VARCHAR) AS stopped_at,
       CAST(NULL AS BIGINT) AS duration_ms, '1800000000' AS created_at FROM event_sessions"""


def job_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job by its id."""
    return lk.by_id(st.order_jobs(spark, sf_dir), "1").select(
        "id", "recording_id", "kind", "state", "priority", "attempts")


JOB_LOOKUP_SQL = st.with_sql(st.JOB_SQL) + """
SELECT id, recording_id, kind, state, priority, attempts FROM order_jobs WHERE id = '1'"""


def recording_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of the detail view of all recordings: name of the part, recording, id."""
    t = st.library(spark, sf_dir)
    parts = lk.recording_context(t["recordings"].select("id"), t["recordings"], t["transcripts"],
                                 t["transcript_segments"], t["ai_summaries"],
                                 t["processing_jobs"], t["recording_sessions"], st.ROOT)
    out = None
    for name, rows in sorted(parts.items()):
        recording = F.col("id" if name == "recording" else "recording_id").alias("recording_id")
        key = F.col("media_path" if name == "assets" else "id").alias("key")
        rows = rows.select(F.lit(name).alias("part"), recording, key)
        out = rows if out is None else out.unionByName(rows)
    return out


PARTS_SQL = st.with_sql(st.DOC_SQL, st.JOB_SQL, st.SESSION_SQL, st.SUMMARY_SQL, """
w AS (SELECT id FROM doc_recordings)""") + """
SELECT 'recording' AS part, id AS recording_id, id AS key FROM w
UNION ALL SELECT 'assets', id, CASE WHEN media_path LIKE '/%' THEN media_path ELSE '/library/' || media_path END
FROM doc_recordings WHERE id IN (SELECT id FROM w)
UNION ALL SELECT 'transcript', recording_id, id FROM doc_transcripts WHERE recording_id IN (SELECT id FROM w)
UNION ALL SELECT 'segments', recording_id, id FROM doc_segments WHERE recording_id IN (SELECT id FROM w)
UNION ALL SELECT 'summary', recording_id, id FROM doc_summaries WHERE recording_id IN (SELECT id FROM w)
UNION ALL SELECT 'jobs', recording_id, id FROM order_jobs WHERE recording_id IN (SELECT id FROM w)
UNION ALL SELECT 'session', recording_id, id FROM event_sessions WHERE recording_id IN (SELECT id FROM w)"""


def list_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest version of each user's row among all events."""
    rows = st.given(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), "event_type",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at"),
        F.lit("1").alias("created_at"))
    return up.latest_recordings(rows).select("id", "event_type", "updated_at")


LIST_UPSERT_SQL = """
SELECT 'u' || user_id AS id, arg_max(event_type, ts) AS event_type,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM events GROUP BY user_id"""


def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of jobs, recordings and transcripts, with some rows made to break them; rules that
    hold are listed with zero."""
    t = st.library(spark, sf_dir)
    jobs = t["processing_jobs"].withColumn("max_attempts", F.col("attempts") - 1)
    return cn.constraint_report({
        "recordings": t["recordings"].withColumn("recording_directory", F.col("title")),
        "transcripts": t["transcripts"], "processing_jobs": jobs})


CONSTRAINT_SQL = st.with_sql(st.DOC_SQL, st.JOB_SQL) + """
SELECT 'recordings' AS table_name, 'unique recording_directory' AS rule, count(*) AS violations
FROM (SELECT source FROM documents GROUP BY source HAVING count(*) > 1)
UNION ALL SELECT 'processing_jobs', 'max_attempts not positive', count(*) FROM order_jobs WHERE attempts - 1 <= 0
UNION ALL SELECT 'processing_jobs', 'recording_id without parent', count(*) FROM order_jobs
WHERE recording_id IS NOT NULL AND recording_id NOT IN (SELECT id FROM doc_recordings)
UNION ALL SELECT 'recordings', 'status unknown', count(*) FROM doc_recordings WHERE status NOT IN ('pending', 'capturing', 'processing', 'completed', 'failed')
UNION ALL SELECT 'recordings', 'id missing', count(*) FROM doc_recordings WHERE id IS NULL
UNION ALL SELECT 'recordings', 'title missing', count(*) FROM doc_recordings WHERE title IS NULL
UNION ALL SELECT 'recordings', 'status missing', count(*) FROM doc_recordings WHERE status IS NULL
UNION ALL SELECT 'recordings', 'recording_directory missing', count(*) FROM doc_recordings WHERE recording_directory IS NULL
UNION ALL SELECT 'recordings', 'created_at missing', count(*) FROM doc_recordings WHERE created_at IS NULL
UNION ALL SELECT 'recordings', 'updated_at missing', count(*) FROM doc_recordings WHERE updated_at IS NULL
UNION ALL SELECT 'recordings', 'duration_ms negative', count(*) FROM doc_recordings WHERE duration_ms < 0
UNION ALL SELECT 'recordings', 'unique id', count(*) FROM (SELECT id FROM doc_recordings GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'transcripts', 'status unknown', count(*) FROM doc_transcripts WHERE status NOT IN ('not_started', 'pending', 'capturing', 'processing', 'completed', 'failed')
UNION ALL SELECT 'transcripts', 'id missing', count(*) FROM doc_transcripts WHERE id IS NULL
UNION ALL SELECT 'transcripts', 'recording_id missing', count(*) FROM doc_transcripts WHERE recording_id IS NULL
UNION ALL SELECT 'transcripts', 'status missing', count(*) FROM doc_transcripts WHERE status IS NULL
UNION ALL SELECT 'transcripts', 'created_at missing', count(*) FROM doc_transcripts WHERE created_at IS NULL
UNION ALL SELECT 'transcripts', 'updated_at missing', count(*) FROM doc_transcripts WHERE updated_at IS NULL
UNION ALL SELECT 'transcripts', 'unique id', count(*) FROM (SELECT id FROM doc_transcripts GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'transcripts', 'unique recording_id', count(*) FROM (SELECT recording_id FROM doc_transcripts GROUP BY recording_id HAVING count(*) > 1)
UNION ALL SELECT 'transcripts', 'recording_id without parent', count(*) FROM doc_transcripts WHERE recording_id NOT IN (SELECT id FROM doc_recordings)
UNION ALL SELECT 'processing_jobs', 'state unknown', count(*) FROM order_jobs WHERE state NOT IN ('queued', 'running', 'succeeded', 'failed', 'cancelled')
UNION ALL SELECT 'processing_jobs', 'id missing', count(*) FROM order_jobs WHERE id IS NULL
UNION ALL SELECT 'processing_jobs', 'kind missing', count(*) FROM order_jobs WHERE kind IS NULL
UNION ALL SELECT 'processing_jobs', 'state missing', count(*) FROM order_jobs WHERE state IS NULL
UNION ALL SELECT 'processing_jobs', 'priority missing', count(*) FROM order_jobs WHERE priority IS NULL
UNION ALL SELECT 'processing_jobs', 'attempts missing', count(*) FROM order_jobs WHERE attempts IS NULL
UNION ALL SELECT 'processing_jobs', 'max_attempts missing', count(*) FROM order_jobs WHERE max_attempts IS NULL
UNION ALL SELECT 'processing_jobs', 'interrupted missing', count(*) FROM order_jobs WHERE interrupted IS NULL
UNION ALL SELECT 'processing_jobs', 'created_at missing', count(*) FROM order_jobs WHERE created_at IS NULL
UNION ALL SELECT 'processing_jobs', 'updated_at missing', count(*) FROM order_jobs WHERE updated_at IS NULL
UNION ALL SELECT 'processing_jobs', 'attempts negative', count(*) FROM order_jobs WHERE attempts < 0
UNION ALL SELECT 'processing_jobs', 'unique id', count(*) FROM (SELECT id FROM order_jobs GROUP BY id HAVING count(*) > 1)"""


def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cn.orphans(st.order_jobs(spark, sf_dir), "recording_id",
                      st.doc_recordings(spark, sf_dir)).select("id", "recording_id")


ORPHAN_SQL = st.with_sql(st.JOB_SQL) + """
SELECT id, recording_id FROM order_jobs
WHERE recording_id IS NOT NULL AND recording_id NOT IN (SELECT 'd' || doc_id FROM documents)"""


def delete_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings in failed state deleted: transcripts drop, jobs are released."""
    left = st.doc_recordings(spark, sf_dir).where("status <> 'failed'")
    kept = cn.drop_children(st.doc_transcripts(spark, sf_dir), left).select(
        F.lit("transcript").alias("kind"), "id", "recording_id")
    jobs = cn.release_jobs(st.order_jobs(spark, sf_dir), left).select(
        F.lit("job").alias("kind"), "id", "recording_id")
    return kept.unionByName(jobs)


DELETE_SQL = st.with_sql(st.DOC_SQL, st.JOB_SQL, "alive AS (SELECT id FROM doc_recordings WHERE status <> 'failed')") + """
SELECT 'transcript' AS kind, id, recording_id FROM doc_transcripts WHERE recording_id IN (SELECT id FROM alive)
UNION ALL SELECT 'job', j.id, a.id FROM order_jobs j LEFT JOIN alive a ON a.id = j.recording_id"""


def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of three table versions in one frame: columns added later get defaults."""
    rows = st.event_sessions(spark, sf_dir)
    added = list(schemas.ADDED_COLUMN_DEFAULTS["recording_sessions"])
    number = F.substring("id", 2, 20).cast("bigint") % 3
    oldest = rows.where(number == 0).drop(*added)
    middle = rows.where(number == 1).drop(*added[6:])
    both = cn.union_versions([oldest, middle, rows.where(number == 2)], schemas.RECORDING_SESSIONS,
                             schemas.ADDED_COLUMN_DEFAULTS["recording_sessions"])
    return both.select("id", "video_source_id", "video_source_kind", "video_source_title",
                       "video_source_window_id", "audio_mode", "microphone_audio_byte_count",
                       "source_audio_channels")


EVOLUTION_SQL = st.with_sql(st.SESSION_SQL, "v AS (SELECT *, CAST(substr(id, 2) AS BIGINT) % 3 AS k FROM event_sessions)") + """
SELECT id, CASE WHEN k = 0 THEN '' ELSE video_source_id END AS video_source_id, 'display' AS video_source_kind,
       CASE WHEN k = 0 THEN '' ELSE video_source_title END AS video_source_title,
       CASE WHEN k > 0 THEN video_source_window_id END AS video_source_window_id,
       CASE WHEN k < 2 THEN 'microphone' ELSE audio_mode END AS audio_mode,
       CASE WHEN k < 2 THEN 0 ELSE microphone_audio_byte_count END AS microphone_audio_byte_count,
       CASE WHEN k = 2 THEN source_audio_channels END AS source_audio_channels FROM v"""


QUERIES = {
    "library_valid": (library_valid, VALID_SQL),
    "library_latest": (library_latest, LATEST_SQL),
    "library_overview": (library_overview, OVERVIEW_SQL),
    "recording_lookup": (recording_lookup, LOOKUP_SQL),
    "transcript_nested": (transcript_nested, NESTED_SQL),
    "transcript_preview": (transcript_preview, PREVIEW_SQL),
    "asset_paths": (asset_paths, ASSET_SQL),
    "recording_detail": (recording_detail, DETAIL_SQL),
    "work_pending": (work_pending, PENDING_SQL),
    "recording_create": (recording_create, CREATE_SQL),
    "stored_patch": (stored_patch, PATCH_SQL),
    "stored_segments": (stored_segments, SEGMENT_REPLACE_SQL),
    "recording_patch": (recording_patch, PATCH_SQL),
    "patch_unmatched": (patch_unmatched, UNMATCHED_SQL),
    "recording_transition": (recording_transition, TRANSITION_SQL),
    "transcript_upsert": (transcript_upsert, UPSERT_SQL),
    "segment_replace": (segment_replace, SEGMENT_REPLACE_SQL),
    "summary_upsert": (summary_upsert, SUMMARY_UPSERT_SQL),
    "session_create": (session_create, SESSION_CREATE_SQL),
    "session_details": (session_details, _session_patch_sql(False)),
    "session_finish": (session_finish, _session_patch_sql(True)),
    "job_lookup": (job_lookup, JOB_LOOKUP_SQL),
    "recording_parts": (recording_parts, PARTS_SQL),
    "list_upsert": (list_upsert, LIST_UPSERT_SQL),
    "constraint_report": (constraint_report, CONSTRAINT_SQL),
    "orphan_rows": (orphan_rows, ORPHAN_SQL),
    "delete_effects": (delete_effects, DELETE_SQL),
    "schema_evolution": (schema_evolution, EVOLUTION_SQL),
}
