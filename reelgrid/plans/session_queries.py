"""Registered queries: session backfill and source ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.operators import backfill as bf
from reelgrid.plans import stand_ins as st

FACTS = ["id", "video_source_id", "video_source_kind", "video_source_title",
         "video_source_window_id", "audio_mode", "audio_path", "microphone_audio_path",
         "source_audio_path",
         *[f"{s}_audio_{d}" for s in bf.STREAMS
           for d in ("byte_count", "sample_rate", "channels", "sample_format")]]

_BACKFILL_CTES = """
v AS (SELECT * REPLACE (
        coalesce(nullif(video_source_id, ''), screen_source_id) AS video_source_id,
        CASE WHEN screen_source_id ILIKE 'window:%' THEN 'window'
          WHEN screen_source_id ILIKE 'application:%' THEN 'application' ELSE 'display' END AS video_source_kind,
        coalesce(nullif(video_source_title, ''), screen_source_id) AS video_source_title,
        coalesce(TRY_CAST(nullif(regexp_extract(screen_source_id, '^window:([0-9]+)', 1), '') AS BIGINT),
                 video_source_window_id) AS video_source_window_id)
      FROM event_sessions),
m AS (SELECT * REPLACE (
        CASE WHEN coalesce(audio_mode, '') = '' OR (audio_mode = 'microphone' AND NOT include_microphone) THEN
          CASE WHEN include_microphone AND audio_path ILIKE '%source_audio.pcm' THEN 'microphone_and_source'
            WHEN include_microphone THEN 'microphone' WHEN audio_path ILIKE '%source_audio.pcm' THEN 'source'
            WHEN coalesce(audio_path, '') <> '' THEN 'microphone' ELSE 'none' END
        ELSE audio_mode END AS audio_mode) FROM v),
p AS (SELECT * REPLACE (
        coalesce(microphone_audio_path, CASE WHEN audio_path <> '' AND audio_mode <> 'source' THEN audio_path END) AS microphone_audio_path,
        coalesce(source_audio_path, CASE WHEN audio_path <> '' AND audio_mode = 'source' THEN audio_path END) AS source_audio_path)
      FROM m),
b AS (SELECT * REPLACE (
        CASE WHEN microphone_audio_path IS NOT NULL AND microphone_audio_byte_count = 0 THEN audio_byte_count
          ELSE microphone_audio_byte_count END AS microphone_audio_byte_count,
        coalesce(microphone_audio_sample_rate, audio_sample_rate) AS microphone_audio_sample_rate,
        coalesce(microphone_audio_channels, audio_channels) AS microphone_audio_channels,
        coalesce(microphone_audio_sample_format, audio_sample_format) AS microphone_audio_sample_format,
        CASE WHEN source_audio_path IS NOT NULL AND source_audio_byte_count = 0 THEN audio_byte_count
          ELSE source_audio_byte_count END AS source_audio_byte_count,
        coalesce(source_audio_sample_rate, CASE WHEN source_audio_path IS NOT NULL THEN audio_sample_rate END) AS source_audio_sample_rate,
        coalesce(source_audio_channels, CASE WHEN source_audio_path IS NOT NULL THEN audio_channels END) AS source_audio_channels,
        coalesce(source_audio_sample_format, CASE WHEN source_audio_path IS NOT NULL THEN audio_sample_format END) AS source_audio_sample_format)
      FROM p)"""


def session_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bf.backfill_sessions(st.event_sessions(spark, sf_dir)).select(*FACTS)


BACKFILL_SQL = st.with_sql(st.SESSION_SQL, _BACKFILL_CTES) + f"SELECT {', '.join(FACTS)} FROM b"


def session_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fallbacks on read for rows that were never backfilled (empty modes read as none)."""
    rows = st.event_sessions(spark, sf_dir).withColumn(
        "audio_mode", F.coalesce(F.nullif("audio_mode", F.lit("")), F.lit("none")))
    return bf.read_sessions(rows).select(*FACTS)


READ_SQL = st.with_sql(st.SESSION_SQL, """
e AS (SELECT * REPLACE (coalesce(nullif(audio_mode, ''), 'none') AS audio_mode) FROM event_sessions),
w AS (SELECT *, coalesce(microphone_audio_path, CASE WHEN audio_mode <> 'source' THEN audio_path END) AS mp,
             coalesce(source_audio_path, CASE WHEN audio_mode = 'source' AND audio_path <> '' THEN audio_path END) AS sp FROM e)""") + """
SELECT id, coalesce(nullif(video_source_id, ''), screen_source_id) AS video_source_id, video_source_kind,
       video_source_title, video_source_window_id, audio_mode, coalesce(audio_path, mp) AS audio_path,
       mp AS microphone_audio_path, sp AS source_audio_path,
       CASE WHEN microphone_audio_byte_count = 0 AND mp IS NOT NULL AND audio_byte_count > 0 THEN audio_byte_count
         ELSE microphone_audio_byte_count END AS microphone_audio_byte_count,
       coalesce(microphone_audio_sample_rate, CASE WHEN mp IS NOT NULL THEN audio_sample_rate END) AS microphone_audio_sample_rate,
       coalesce(microphone_audio_channels, CASE WHEN mp IS NOT NULL THEN audio_channels END) AS microphone_audio_channels,
       coalesce(microphone_audio_sample_format, CASE WHEN mp IS NOT NULL THEN audio_sample_format END) AS microphone_audio_sample_format,
       CASE WHEN source_audio_byte_count = 0 AND sp IS NOT NULL AND audio_byte_count > 0 THEN audio_byte_count
         ELSE source_audio_byte_count END AS source_audio_byte_count,
       coalesce(source_audio_sample_rate, CASE WHEN sp IS NOT NULL THEN audio_sample_rate END) AS source_audio_sample_rate,
       coalesce(source_audio_channels, CASE WHEN sp IS NOT NULL THEN audio_channels END) AS source_audio_channels,
       coalesce(source_audio_sample_format, CASE WHEN sp IS NOT NULL THEN audio_sample_format END) AS source_audio_sample_format
FROM w"""


def preference_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = st.event_sessions(spark, sf_dir).select(
        "id", "video_source_id", "screen_source_id", "audio_mode", "include_microphone")
    return bf.fill_preferences(rows).select("id", "video_source_id", "audio_mode")


PREFERENCE_SQL = st.with_sql(st.SESSION_SQL) + """
SELECT id, coalesce(nullif(video_source_id, ''), nullif(screen_source_id, '')) AS video_source_id,
       coalesce(nullif(audio_mode, ''), CASE WHEN include_microphone THEN 'microphone' ELSE 'none' END) AS audio_mode
FROM event_sessions"""


def source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source ids taken apart, with labels and option texts."""
    e = F.col("event_id")
    rows = st.given(spark, sf_dir, "events").select(
        e, F.concat(
            F.element_at(F.array(*map(F.lit, ("display:", "application:", "window:", "tab:", "", "window: "))),
                         (e % 6 + 1).cast("int")),
            F.when(e % 7 > 0, F.col("user_id").cast("string")).otherwise("")).alias("source_id"),
        F.col("event_type").alias("app_name"), "user_id")
    parts = bf.parse_source_id(F.col("source_id"))
    taken = rows.select("*", *[c.alias(n) for n, c in parts.items()])
    title = F.when(e % 5 == 0, F.lit(" ")).when(e % 5 == 1, F.col("app_name")).otherwise("Main")
    return taken.select(
        "event_id", "source_id", "kind", "native_id", "error",
        bf.source_label(F.col("source_id")).alias("label"),
        bf.source_option(F.col("source_id"), F.col("kind"), title, e % 2 == 0, F.col("app_name"),
                         F.col("user_id"), F.when(e % 3 == 2, e)).alias("option_text"))


SOURCE_SQL = """
WITH s AS (SELECT event_id, user_id, event_type AS app_name,
    CASE event_id % 6 WHEN 0 THEN 'display:' WHEN 1 THEN 'application:' WHEN 2 THEN 'window:' WHEN 3 THEN 'tab:'
      WHEN 4 THEN '' ELSE 'window: ' END || CASE WHEN event_id % 7 > 0 THEN CAST(user_id AS VARCHAR) ELSE '' END AS source_id
  FROM events),
p AS (SELECT *, split_part(source_id, ':', 1) AS prefix, trim(substr(source_id, strpos(source_id, ':') + 1)) AS native FROM s),
e AS (SELECT *, CASE WHEN strpos(source_id, ':') = 0 THEN 'no kind prefix' WHEN native = '' THEN 'no native id'
        WHEN prefix NOT IN ('display', 'application', 'window') THEN 'unknown kind prefix' END AS error FROM p),
k AS (SELECT *, CASE WHEN error IS NULL THEN prefix END AS kind,
        coalesce(nullif(trim(CASE event_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN app_name ELSE 'Main' END), ''), source_id) AS shown FROM e),
c AS (SELECT *, CASE kind
        WHEN 'display' THEN CASE WHEN event_id % 2 = 0 THEN 'Primary' ELSE '' END
        WHEN 'application' THEN concat_ws(' / ', CASE WHEN app_name <> shown THEN app_name END,
          CASE WHEN user_id <> 0 THEN 'PID ' || user_id END)
        WHEN 'window' THEN concat_ws(' / ', CASE WHEN app_name <> shown THEN app_name END,
          CASE WHEN event_id % 3 = 2 AND event_id <> 0 THEN 'Window ' || event_id END) ELSE '' END AS context FROM k)
SELECT event_id, source_id, kind, CASE WHEN error IS NULL THEN native END AS native_id, error,
       CASE prefix WHEN 'display' THEN 'Display' WHEN 'application' THEN 'Application' WHEN 'window' THEN 'Window'
         ELSE 'Source' END AS label,
       CASE WHEN context <> '' THEN shown || ' - ' || context ELSE shown END AS option_text FROM c"""


QUERIES = {
    "session_backfill": (session_backfill, BACKFILL_SQL),
    "session_read": (session_read, READ_SQL),
    "preference_backfill": (preference_backfill, PREFERENCE_SQL),
    "source_ids": (source_ids, SOURCE_SQL),
}
