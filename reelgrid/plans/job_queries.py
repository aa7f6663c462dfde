"""Registered queries: jobs, recovery, cleanup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.functions import display as dp
from reelgrid.functions import text as tx
from reelgrid.operators import jobs as jb
from reelgrid.operators import lookups as lk
from reelgrid.operators import recovery as rc
from reelgrid.plans import stand_ins as st

NOW = st.NOW
JOB_FACTS = ["id", "state", "attempts", "output_json", "error_message", "interrupted",
             "last_error_at", "updated_at", "started_at", "completed_at"]


def jobs_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lk.list_jobs(st.order_jobs(spark, sf_dir), state="failed")
    return found.select("id", "recording_id", "kind", "priority", "created_at")


FILTERED_SQL = st.with_sql(st.JOB_SQL) + """
SELECT id, recording_id, kind, priority, created_at FROM order_jobs WHERE state = 'failed'
ORDER BY priority DESC, created_at, id"""


def job_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jb.next_jobs(st.order_jobs(spark, sf_dir), 25).select("id", "kind", "priority", "created_at")


QUEUE_SQL = st.with_sql(st.JOB_SQL) + """
SELECT id, kind, priority, created_at FROM order_jobs WHERE state = 'queued'
ORDER BY priority DESC, created_at, id LIMIT 25"""


def job_queue_per_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jb.next_jobs_per(st.order_jobs(spark, sf_dir), "kind", 5).select(
        "kind", F.col("place").cast("bigint").alias("place"), "id")


QUEUE_KIND_SQL = st.with_sql(st.JOB_SQL) + """
SELECT kind, place, id FROM (
  SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY priority DESC, created_at, id) AS place
  FROM order_jobs WHERE state = 'queued') WHERE place <= 5"""


def job_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job table after the next ten jobs were claimed."""
    jobs = st.order_jobs(spark, sf_dir)
    return jb.apply_rows(jobs, jb.claim(jobs, 10, NOW)).select(*JOB_FACTS)


CLAIM_SQL = st.with_sql(st.JOB_SQL, """
c AS (SELECT id AS cid FROM order_jobs WHERE state = 'queued' ORDER BY priority DESC, created_at, id LIMIT 10)""") + """
SELECT id, CASE WHEN cid IS NULL THEN state ELSE 'running' END AS state,
       CASE WHEN cid IS NULL THEN attempts ELSE attempts + 1 END AS attempts,
       CASE WHEN cid IS NULL THEN output_json END AS output_json,
       CASE WHEN cid IS NULL THEN error_message END AS error_message, interrupted AND cid IS NULL AS interrupted,
       CASE WHEN cid IS NULL THEN last_error_at END AS last_error_at,
       CASE WHEN cid IS NULL THEN updated_at ELSE '1800000000' END AS updated_at,
       CASE WHEN cid IS NULL THEN started_at ELSE '1800000000' END AS started_at,
       CASE WHEN cid IS NULL THEN completed_at END AS completed_at
FROM order_jobs LEFT JOIN c ON cid = id"""


def job_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch for every job with line items: the state from its first line, other
    fields given for some."""
    lines = st.given(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_linenumber").alias("n"))
    n = F.col("n")
    states = F.array(*map(F.lit, ("queued", "running", "succeeded", "failed", "cancelled")))
    patches = lines.select(
        F.col("l_orderkey").cast("string").alias("id"),
        F.when(n % 6 < 5, F.element_at(states, (n % 6 + 1).cast("int"))).alias("state"),
        F.when(n % 4 == 0, n).alias("attempts"),
        F.when(n % 5 == 0, F.lit("{}")).alias("output_json"),
        F.when(n % 7 == 0, F.lit("new error")).alias("error_message"),
        F.when(n % 3 == 0, n % 2 == 0).alias("interrupted"),
        F.when(n % 11 == 0, F.lit("111")).alias("started_at"),
        F.when(n % 13 == 0, F.lit("222")).alias("completed_at"))
    return jb.update_jobs(st.order_jobs(spark, sf_dir), patches, NOW).select(*JOB_FACTS)


UPDATE_SQL = st.with_sql(st.JOB_SQL, """
n AS (SELECT CAST(l_orderkey AS VARCHAR) AS pid, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY 1),
j AS (SELECT *, CASE WHEN n IS NULL OR n % 6 = 5 THEN state ELSE ['queued', 'running', 'succeeded', 'failed', 'cancelled'][n % 6 + 1] END AS s2,
        coalesce(CASE WHEN n % 3 = 0 THEN n % 2 = 0 END, interrupted) AS i2,
        CASE WHEN n % 5 = 0 THEN '{}' END AS o2, CASE WHEN n % 7 = 0 THEN 'new error' END AS e2
      FROM order_jobs LEFT JOIN n ON pid = id),
k AS (SELECT *, CASE WHEN s2 IN ('failed', 'cancelled') THEN coalesce(e2, error_message) END AS e3 FROM j)""") + """
SELECT id, s2 AS state, coalesce(CASE WHEN n % 4 = 0 THEN n END, attempts) AS attempts,
       CASE WHEN n IS NULL THEN output_json WHEN s2 = 'succeeded' THEN coalesce(o2, output_json) ELSE o2 END AS output_json,
       CASE WHEN n IS NULL THEN error_message ELSE e3 END AS error_message, i2 AS interrupted,
       CASE WHEN n IS NULL THEN last_error_at WHEN e3 IS NOT NULL OR i2 THEN '1800000000'
         WHEN s2 IN ('failed', 'cancelled') THEN last_error_at END AS last_error_at,
       CASE WHEN n IS NULL THEN updated_at ELSE '1800000000' END AS updated_at,
       CASE WHEN n IS NULL THEN started_at ELSE coalesce(CASE WHEN n % 11 = 0 THEN '111' END, started_at,
         CASE WHEN s2 = 'running' THEN '1800000000' END) END AS started_at,
       CASE WHEN n IS NULL THEN completed_at WHEN s2 IN ('queued', 'running') THEN NULL
         ELSE coalesce(CASE WHEN n % 13 = 0 THEN '222' END, completed_at, '1800000000') END AS completed_at
FROM k"""


def job_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All retryable jobs put back into the queue."""
    jobs = st.order_jobs(spark, sf_dir)
    ids = jobs.where(jb.retry_eligible(F.col("kind"), F.col("state"), F.col("interrupted")))
    return jb.retry_jobs(jobs, ids, NOW).select(*JOB_FACTS)


RETRY_SQL = st.with_sql(st.JOB_SQL, """
r AS (SELECT *, kind IN ('encode_recording', 'transcribe_recording', 'ai_summary', 'index_transcript', 'clean_temp_files')
        AND (state IN ('failed', 'cancelled') OR interrupted) AS hit FROM order_jobs)""") + """
SELECT id, CASE WHEN hit THEN 'queued' ELSE state END AS state, attempts,
       CASE WHEN NOT hit THEN output_json END AS output_json, CASE WHEN NOT hit THEN error_message END AS error_message,
       interrupted AND NOT hit AS interrupted, CASE WHEN NOT hit THEN last_error_at END AS last_error_at,
       CASE WHEN hit THEN '1800000000' ELSE updated_at END AS updated_at,
       CASE WHEN NOT hit THEN started_at END AS started_at, CASE WHEN NOT hit THEN completed_at END AS completed_at
FROM r"""


def job_retry_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects on all failed jobs, broken inputs included; one model name is refused."""
    jobs = st.order_jobs(spark, sf_dir).withColumn("input_json", F.replace(
        F.col("input_json"), F.lit("ggml-base-4"), F.lit("sub/base-4")))
    made = jb.retry_effects(jobs, jobs.where("state = 'failed'"))
    return (
        made["recordings"].select(F.lit("recording").alias("kind"), F.col("id").alias("recording_id"),
                                  F.col("target").alias("status"), F.lit(None).cast("string").alias("detail"))
        .unionByName(made["transcripts"].select(F.lit("transcript").alias("kind"), "recording_id",
                                                "status", F.col("model_name").alias("detail")))
        .unionByName(made["summaries"].select(F.lit("summary").alias("kind"), "recording_id",
                                              "status", F.col("notes").alias("detail")))
        .unionByName(made["refused"].select(F.lit("refused").alias("kind"), "recording_id",
                                            F.lit(None).cast("string").alias("status"),
                                            F.col("error").alias("detail"))))


RETRY_EFFECTS_SQL = st.with_sql(st.JOB_SQL, """
f AS (SELECT *, CASE WHEN input_json LIKE '{"modelName"%' THEN 'base-' || regexp_extract(input_json, 'base-([0-9]+)', 1) ELSE 'small.en' END AS model,
        nullif(regexp_extract(input_json, '(note [0-9]|call [0-9])', 1), '') AS notes
      FROM order_jobs WHERE state = 'failed' AND recording_id IS NOT NULL)""") + """
SELECT DISTINCT 'recording' AS kind, recording_id, 'processing' AS status, CAST(NULL AS VARCHAR) AS detail
FROM f WHERE kind = 'encode_recording'
UNION ALL SELECT CASE WHEN model = 'base-4' THEN 'refused' ELSE 'transcript' END, recording_id,
       CASE WHEN model <> 'base-4' THEN 'processing' END,
       CASE WHEN model = 'base-4' THEN 'model name must be a local file name' ELSE model END
FROM (SELECT recording_id, arg_max(model, (updated_at, id)) AS model FROM f
      WHERE kind IN ('transcribe_recording', 'extract_audio', 'run_whisper') GROUP BY recording_id)
UNION ALL SELECT 'summary', recording_id, 'processing', arg_max_null(notes, (updated_at, id)) FROM f
WHERE kind = 'ai_summary' GROUP BY recording_id"""


def job_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job requests by customers: unknown recordings are refused, bad limits defaulted."""
    kinds = jb.kind_dimension(spark)
    requests = st.given(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.when(F.col("c_custkey") % 10 > 0, F.concat(F.lit("d"), F.col("c_custkey").cast("string")))
        .alias("recording_id"),
        F.element_at(F.array(*[F.lit(k[0]) for k in jb.JOB_KINDS]),
                     (F.col("c_custkey") % 8 + 1).cast("int")).alias("kind"),
        (F.col("c_nationkey") - 2).cast("bigint").alias("asked"), F.col("c_name").alias("input_json"))
    # The kind dimension has a fixed number of rows, so it is safe to broadcast.
    with_kind = requests.join(F.broadcast(kinds.select("kind", "priority")), "kind").withColumn(
        "max_attempts", F.when(F.col("request_id") % 3 > 0, F.col("asked")))
    return jb.create_jobs(with_kind, st.doc_recordings(spark, sf_dir), NOW).select(
        "id", "recording_id", "kind", "state", "priority", "attempts", "max_attempts", "input_json",
        "created_at")


JOB_CREATE_SQL = """
WITH k AS (SELECT * FROM (VALUES (0, 'encode_recording', 20), (1, 'transcribe_recording', 10), (2, 'extract_audio', 9),
  (3, 'run_whisper', 8), (4, 'generate_thumbnail', 8), (5, 'index_transcript', 6), (6, 'ai_summary', 5),
  (7, 'clean_temp_files', 1)) t(n, kind, priority))
SELECT md5('job|' || c_custkey) AS id, CASE WHEN c_custkey % 10 > 0 THEN 'd' || c_custkey END AS recording_id, kind,
       'queued' AS state, CAST(priority AS BIGINT) AS priority, CAST(0 AS BIGINT) AS attempts,
       CAST(CASE WHEN c_custkey % 3 > 0 AND c_nationkey - 2 > 0 THEN c_nationkey - 2 ELSE 3 END AS BIGINT) AS max_attempts,
       c_name AS input_json, '1800000000' AS created_at
FROM customer JOIN k ON n = c_custkey % 8
WHERE c_custkey % 10 = 0 OR c_custkey IN (SELECT doc_id FROM documents)"""


def job_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = st.given(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("recording_id"))
    return jb.refused_jobs(requests, st.doc_recordings(spark, sf_dir)).select("request_id", "recording_id")


REFUSED_SQL = """
SELECT c_custkey AS request_id, 'd' || c_custkey AS recording_id FROM customer
WHERE c_custkey NOT IN (SELECT doc_id FROM documents)"""


def enqueue_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode requests for stopped sessions of known recordings without an open one."""
    recordings = st.doc_recordings(spark, sf_dir).select(F.col("id").alias("recording_id"))
    return jb.encode_requests(recordings, st.event_sessions(spark, sf_dir),
                              st.order_jobs(spark, sf_dir))


ENQUEUE_SQL = st.with_sql(st.DOC_SQL, st.JOB_SQL, st.SESSION_SQL) + """
SELECT 'encode-' || s.id AS request_id, s.recording_id, 'encode_recording' AS kind, CAST(20 AS BIGINT) AS priority,
       CAST(3 AS BIGINT) AS max_attempts,
       '{"recordingId":"' || s.recording_id || '","sessionId":"' || s.id || '","videoPath":"' || video_path ||
       '","audioPath":' || coalesce('"' || audio_path || '"', 'null') || ',"microphoneAudioPath":' ||
       coalesce('"' || microphone_audio_path || '"', 'null') || ',"sourceAudioPath":' ||
       coalesce('"' || source_audio_path || '"', 'null') || '}' AS input_json
FROM event_sessions s JOIN doc_recordings r ON r.id = s.recording_id
WHERE NOT EXISTS (SELECT 1 FROM order_jobs j WHERE j.recording_id = r.id AND j.kind = 'encode_recording'
                  AND j.state IN ('queued', 'running'))"""


def jobs_interrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.interrupted_jobs(st.order_jobs(spark, sf_dir), NOW).select("recording_id", "kind", *JOB_FACTS)


INTERRUPTED_SQL = st.with_sql(st.JOB_SQL) + f"""
SELECT recording_id, kind, id, 'failed' AS state, attempts, output_json, '{rc.INTERRUPTED_JOB}' AS error_message,
       true AS interrupted, '1800000000' AS last_error_at, '1800000000' AS updated_at, started_at,
       '1800000000' AS completed_at
FROM order_jobs WHERE state = 'running'"""


def interruption_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rc.interruption_effects(rc.interrupted_jobs(st.order_jobs(spark, sf_dir), NOW))
    none = F.lit(None).cast("string")
    return (
        made["recordings"].select(F.lit("recording").alias("kind"), F.col("id").alias("recording_id"),
                                  none.alias("model_name"))
        .unionByName(made["transcripts"].select(F.lit("transcript").alias("kind"), "recording_id",
                                                "model_name"))
        .unionByName(made["summaries"].select(F.lit("summary").alias("kind"), "recording_id",
                                              none.alias("model_name"))))


EFFECTS_SQL = st.with_sql(st.JOB_SQL, """
r AS (SELECT *, CASE WHEN input_json LIKE '{"modelName"%' THEN 'base-' || regexp_extract(input_json, 'base-([0-9]+)', 1) ELSE 'small.en' END AS model
      FROM order_jobs WHERE state = 'running' AND recording_id IS NOT NULL)""") + """
SELECT DISTINCT 'recording' AS kind, recording_id, CAST(NULL AS VARCHAR) AS model_name FROM r WHERE kind = 'encode_recording'
UNION ALL SELECT 'transcript', recording_id, arg_max(model, (-priority, created_at, id)) FROM r
WHERE kind IN ('transcribe_recording', 'extract_audio', 'run_whisper') GROUP BY recording_id
UNION ALL SELECT DISTINCT 'summary', recording_id, CAST(NULL AS VARCHAR) FROM r WHERE kind = 'ai_summary'"""


def reschedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.reschedulable(st.doc_recordings(spark, sf_dir), st.event_sessions(spark, sf_dir),
                            st.order_jobs(spark, sf_dir))


RESCHEDULE_SQL = st.with_sql(st.DOC_SQL, st.JOB_SQL, st.SESSION_SQL) + """
SELECT r.id AS recording_id FROM doc_recordings r JOIN event_sessions s ON s.recording_id = r.id
WHERE r.status = 'processing' AND media_path IS NULL AND s.status = 'stopped'
  AND NOT EXISTS (SELECT 1 FROM order_jobs j WHERE j.recording_id = r.id AND j.kind = 'encode_recording'
                  AND j.state IN ('queued', 'running'))"""

_RECOVER_CTES = """
cap AS (SELECT s.id AS sid, s.recording_id AS rid FROM event_sessions s JOIN doc_recordings r ON r.id = s.recording_id
        WHERE s.status = 'capturing'),
run AS (SELECT * FROM order_jobs WHERE state = 'running'),
enc AS (SELECT DISTINCT recording_id AS rid FROM run WHERE kind = 'encode_recording' AND recording_id IS NOT NULL),
due AS (SELECT r.id AS rid, s.id AS sid FROM doc_recordings r JOIN event_sessions s ON s.recording_id = r.id
        WHERE r.status = 'processing' AND media_path IS NULL AND s.status = 'stopped'
          AND r.id NOT IN (SELECT rid FROM enc)
          AND NOT EXISTS (SELECT 1 FROM order_jobs j WHERE j.recording_id = r.id AND j.kind = 'encode_recording'
                          AND j.state = 'queued'))"""


def recovery_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.recover(st.library(spark, sf_dir), NOW)["recovery"]


RECOVERY_SQL = st.with_sql(st.DOC_SQL, st.JOB_SQL, st.SESSION_SQL, _RECOVER_CTES) + """
SELECT (SELECT count(*) FROM run) AS interrupted_jobs, (SELECT count(*) FROM cap) AS interrupted_recordings,
       (SELECT count(*) FROM due) AS rescheduled_jobs,
       (SELECT count(*) FROM order_jobs WHERE state = 'queued') + (SELECT count(*) FROM due) AS queued_jobs"""


def recovery_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recordings table after recovery."""
    return rc.recover(st.library(spark, sf_dir), NOW)["recordings"].select(
        "id", "status", "media_path", "completed_at", "failure_message", "updated_at")


RECOVERED_SQL = st.with_sql(st.DOC_SQL, st.JOB_SQL, st.SESSION_SQL, _RECOVER_CTES) + f"""
SELECT r.id, CASE WHEN e.rid IS NOT NULL OR c.rid IS NOT NULL THEN 'failed' ELSE status END AS status,
       CASE WHEN e.rid IS NULL THEN media_path END AS media_path,
       CASE WHEN e.rid IS NOT NULL THEN NULL WHEN c.rid IS NOT NULL THEN '1800000000' ELSE completed_at END AS completed_at,
       CASE WHEN e.rid IS NOT NULL THEN '{rc.INTERRUPTED_JOB}' WHEN c.rid IS NOT NULL THEN '{rc.INTERRUPTED_CAPTURE}'
         ELSE failure_message END AS failure_message,
       CASE WHEN e.rid IS NOT NULL OR c.rid IS NOT NULL OR d.rid IS NOT NULL THEN '1800000000' ELSE updated_at END AS updated_at
FROM doc_recordings r LEFT JOIN enc e ON e.rid = r.id LEFT JOIN cap c ON c.rid = r.id LEFT JOIN due d ON d.rid = r.id"""


def recovery_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job table after recovery, with the rescheduled encode jobs."""
    return rc.recover(st.library(spark, sf_dir), NOW)["processing_jobs"].groupBy(
        "kind", "state", "interrupted").agg(F.count("*").alias("jobs"))


RECOVERED_JOBS_SQL = st.with_sql(st.DOC_SQL, st.JOB_SQL, st.SESSION_SQL, _RECOVER_CTES) + """
SELECT kind, state, interrupted, count(*) AS jobs FROM (
  SELECT kind, CASE WHEN state = 'running' THEN 'failed' ELSE state END AS state, interrupted OR state = 'running' AS interrupted
  FROM order_jobs
  UNION ALL SELECT 'encode_recording', 'queued', false FROM due) GROUP BY ALL"""


def job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jb.job_counts(st.order_jobs(spark, sf_dir))


COUNTS_SQL = st.with_sql(st.JOB_SQL) + """
SELECT kind, count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (state = 'running') AS running,
       count(*) FILTER (state = 'succeeded') AS succeeded, count(*) FILTER (state = 'failed') AS failed,
       count(*) FILTER (state = 'cancelled') AS cancelled FROM order_jobs GROUP BY kind"""


def job_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jb.recording_job_report(st.order_jobs(spark, sf_dir))


REPORT_SQL = st.with_sql(st.JOB_SQL) + """
SELECT recording_id, count(*) AS jobs, CAST(sum(attempts) AS BIGINT) AS attempts, count(error_message) AS errors,
       count(*) FILTER (attempts > max_attempts) AS over_limit, max(last_error_at) AS last_error_at
FROM order_jobs WHERE recording_id IS NOT NULL GROUP BY recording_id"""


def job_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return st.order_jobs(spark, sf_dir).select(
        "id", dp.job_display_status(c("state"), c("interrupted")).alias("display_status"),
        dp.job_state_label(c("state"), c("interrupted"), c("attempts")).alias("label"),
        tx.job_kind_label(c("kind")).alias("kind_label"),
        dp.job_meta(c("attempts"), c("max_attempts"), c("last_error_at"), c("updated_at")).alias("meta"),
        jb.retry_eligible(c("kind"), c("state"), c("interrupted")).alias("can_retry"))


LABELS_SQL = st.with_sql(st.JOB_SQL) + """
SELECT id, CASE WHEN interrupted THEN 'interrupted' ELSE state END AS display_status,
       CASE WHEN interrupted THEN 'Interrupted' WHEN state = 'queued' AND attempts > 0 THEN 'Retry queued'
         WHEN state = 'running' AND attempts > 1 THEN 'Retrying' ELSE upper(left(state, 1)) || substr(state, 2) END AS label,
       CASE kind WHEN 'run_whisper' THEN 'Run Whisper' WHEN 'ai_summary' THEN 'AI summary' WHEN 'custom_step' THEN 'Custom Step'
         ELSE upper(left(kind, 1)) || replace(substr(kind, 2), '_', ' ') END AS kind_label,
       'Attempt ' || attempts || '/3 / ' || CASE WHEN last_error_at IS NOT NULL THEN 'Last error ' || last_error_at || ' 00:00:00'
         ELSE 'Updated ' || updated_at || ' 00:00:00' END AS meta,
       kind NOT IN ('extract_audio', 'run_whisper', 'custom_step') AND (state IN ('failed', 'cancelled') OR interrupted) AS can_retry
FROM order_jobs"""


def json_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model names and notes a job was given."""
    jobs = st.order_jobs(spark, sf_dir)
    name, error = tx.model_name(jb.input_model(F.col("input_json")))
    return jobs.select("id", name.alias("model_name"), error.alias("model_error"),
                       jb.input_notes(F.col("input_json")).alias("notes"))


INPUTS_SQL = st.with_sql(st.JOB_SQL) + """
SELECT id, CASE WHEN input_json LIKE '{"modelName"%' THEN 'base-' || regexp_extract(input_json, 'base-([0-9]+)', 1)
         ELSE 'small.en' END AS model_name, CAST(NULL AS VARCHAR) AS model_error,
       nullif(regexp_extract(input_json, '(note [0-9]|call [0-9])', 1), '') AS notes
FROM order_jobs"""


def event_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as job update events, in event order per user."""
    v, kind = F.col("value"), F.col("event_type")
    state = (F.when(kind == "signup", "queued").when(kind == "view", "running")
             .when(kind == "purchase", "succeeded").when(kind == "error", "failed")
             .otherwise("cancelled"))
    cents = F.round(v * 100).cast("bigint")
    return st.given(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("job_id"),
        F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"),
        state.alias("state"), F.when(cents % 4 == 0, cents % 9).alias("attempts"),
        F.when(cents % 3 == 0, F.col("props")).alias("output_json"),
        F.when(cents % 5 == 0, F.concat(F.lit("error "), cents.cast("string"))).alias("error_message"),
        F.when(cents % 7 == 0, cents % 2 == 0).alias("interrupted"),
        F.lit(None).cast("string").alias("started_at"),
        F.when(cents % 11 == 0, F.lit("2030")).alias("completed_at"))


def job_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jb.fold_events(event_patches(spark, sf_dir))


_FOLD_CTE = """
e AS (SELECT 'u' || user_id AS job_id, event_id AS seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS tm,
        CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'succeeded'
          WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS state,
        CAST(round(value * 100) AS BIGINT) AS c, props FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS n FROM e)"""
# One event at a time, the way the rules are stated.
FOLD_SQL = "WITH RECURSIVE " + _FOLD_CTE.strip() + """,
f AS (
  SELECT job_id, CAST(0 AS BIGINT) AS n, 'queued' AS state, CAST(0 AS BIGINT) AS attempts, CAST(NULL AS VARCHAR) AS output_json,
         CAST(NULL AS VARCHAR) AS error_message, false AS interrupted, CAST(NULL AS VARCHAR) AS last_error_at,
         CAST(NULL AS VARCHAR) AS started_at, CAST(NULL AS VARCHAR) AS completed_at, CAST(NULL AS VARCHAR) AS updated_at
  FROM (SELECT DISTINCT job_id FROM e)
  UNION ALL
  SELECT job_id, n, state, attempts, output_json, error_message, interrupted,
         CASE WHEN error_message IS NOT NULL OR interrupted THEN updated_at
           WHEN state IN ('failed', 'cancelled') THEN last_error_at END AS last_error_at,
         started_at, completed_at, updated_at
  FROM (SELECT r.job_id, r.n, r.state, coalesce(CASE WHEN c % 4 = 0 THEN c % 9 END, f.attempts) AS attempts,
         CASE WHEN c % 3 = 0 THEN props WHEN r.state = 'succeeded' THEN f.output_json END AS output_json,
         CASE WHEN r.state IN ('failed', 'cancelled') THEN coalesce(CASE WHEN c % 5 = 0 THEN 'error ' || c END, f.error_message) END AS error_message,
         coalesce(CASE WHEN c % 7 = 0 THEN c % 2 = 0 END, f.interrupted) AS interrupted, f.last_error_at,
         coalesce(f.started_at, CASE WHEN r.state = 'running' THEN tm END) AS started_at,
         CASE WHEN r.state IN ('succeeded', 'failed', 'cancelled') THEN
           coalesce(CASE WHEN c % 11 = 0 THEN '2030' END, f.completed_at, tm) END AS completed_at, tm AS updated_at
        FROM f JOIN r ON r.job_id = f.job_id AND r.n = f.n + 1))
SELECT job_id, state, attempts, output_json, error_message, interrupted, last_error_at, started_at, completed_at,
       updated_at, n AS events
FROM f WHERE (job_id, n) IN (SELECT (job_id, max(n)) FROM r GROUP BY job_id)"""


def event_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File paths below the library: media, working files and session files."""
    e, es = F.col("event_id"), F.col("event_id").cast("string")
    names = F.array(*map(F.lit, ("recording.tmp.mp4", "whisper-output.json",
                                 "recording.tmp.mp4.sb-1a", "notes.txt", "thumbnail.jpg")))
    files = F.array(
        F.concat(F.lit("/library/recordings/d"), es, F.lit("/"),
                 F.element_at(names, (e % 5 + 1).cast("int"))),
        F.when(e % 2 == 0, F.concat(F.lit("file:/library/media/"), es, F.lit(".mp4"))),
        F.when(e % 3 > 0, F.concat(F.lit("/library/temp/recording-sessions/s"), es,
                                   F.lit("/chunks/0.bin"))))
    return st.given(spark, sf_dir, "events").select(F.explode(F.array_compact(files)).alias("path"))


def cleanup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.cleanup_plan(st.doc_recordings(spark, sf_dir), st.event_sessions(spark, sf_dir),
                           event_inventory(spark, sf_dir), st.ROOT)


CLEANUP_SQL = st.with_sql(st.DOC_SQL, st.SESSION_SQL, """
f AS (SELECT '/library/recordings/d' || event_id || '/' ||
        ['recording.tmp.mp4', 'whisper-output.json', 'recording.tmp.mp4.sb-1a', 'notes.txt', 'thumbnail.jpg'][event_id % 5 + 1] AS path FROM events
      UNION ALL SELECT '/library/media/' || event_id || '.mp4' FROM events WHERE event_id % 2 = 0
      UNION ALL SELECT '/library/temp/recording-sessions/s' || event_id || '/chunks/0.bin' FROM events WHERE event_id % 3 > 0),
h AS (SELECT r.id AS recording_id, s.*, r.status = 'completed' AND
        coalesce(CASE WHEN media_path LIKE '/%' THEN media_path ELSE '/library/' || media_path END IN (SELECT path FROM f), false) AS safe
      FROM doc_recordings r JOIN (SELECT * EXCLUDE (recording_id, status, id), recording_id AS rid FROM event_sessions) s ON rid = r.id)""") + """
SELECT r.id AS recording_id, 'remove' AS action, path FROM f JOIN doc_recordings r
  ON path LIKE '/library/' || recording_directory || '/%' WHERE path LIKE '%recording.tmp.mp4%' OR path LIKE '%whisper-output.json'
UNION ALL SELECT recording_id, 'remove', '/library/' || temp_directory FROM h
WHERE safe AND '/library/' || temp_directory || '/chunks/0.bin' IN (SELECT path FROM f)
UNION ALL SELECT recording_id, 'preserve', '/library/' || p FROM (
  SELECT recording_id, unnest(list_filter([temp_directory, video_path, microphone_audio_path, source_audio_path,
    CASE WHEN audio_path IS DISTINCT FROM microphone_audio_path AND audio_path IS DISTINCT FROM source_audio_path THEN audio_path END,
    metadata_path], lambda x: x IS NOT NULL)) AS p FROM h WHERE NOT safe)"""


QUERIES = {
    "jobs_filtered": (jobs_filtered, FILTERED_SQL),
    "job_queue": (job_queue, QUEUE_SQL),
    "job_queue_per_kind": (job_queue_per_kind, QUEUE_KIND_SQL),
    "job_claim": (job_claim, CLAIM_SQL),
    "job_update": (job_update, UPDATE_SQL),
    "job_retry": (job_retry, RETRY_SQL),
    "job_retry_effects": (job_retry_effects, RETRY_EFFECTS_SQL),
    "job_create": (job_create, JOB_CREATE_SQL),
    "job_refused": (job_refused, REFUSED_SQL),
    "enqueue_once": (enqueue_once, ENQUEUE_SQL),
    "jobs_interrupted": (jobs_interrupted, INTERRUPTED_SQL),
    "interruption_effects": (interruption_effects, EFFECTS_SQL),
    "reschedule": (reschedule, RESCHEDULE_SQL),
    "recovery_summary": (recovery_summary, RECOVERY_SQL),
    "recovery_recordings": (recovery_recordings, RECOVERED_SQL),
    "recovery_jobs": (recovery_jobs, RECOVERED_JOBS_SQL),
    "job_counts": (job_counts, COUNTS_SQL),
    "job_report": (job_report, REPORT_SQL),
    "job_labels": (job_labels, LABELS_SQL),
    "json_inputs": (json_inputs, INPUTS_SQL),
    "job_state_fold": (job_state_fold, FOLD_SQL),
    "cleanup_plan": (cleanup_plan, CLEANUP_SQL),
}
