"""Set-based changes of library tables.

Every function takes the current table and a frame of changes and returns the new
state of the table; the caller writes it as a new snapshot. Change frames hold at
most one row per key. ``now`` is a column or text giving the time of the change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid import schemas
from reelgrid.functions import text as tx


def current_time() -> Column:
    """Seconds since the epoch as text, the form the library stores."""
    return F.unix_timestamp().cast("string")


def as_time(now: Column | str | None) -> Column:
    if now is None:
        return current_time()
    return F.lit(now) if isinstance(now, str) else now


def create_recordings(requests: DataFrame, now: Column | str | None = None) -> DataFrame:
    """New pending recordings from (request_id, title, media_path, captured_at).

    Ids derive from the request, so a task that is run again makes the same rows.
    """
    at = as_time(now)
    rid = tx.stable_id(F.lit("recording"), F.col("request_id"))
    made = requests.select(
        rid.alias("id"), tx.normal_title(F.col("title")).alias("title"),
        F.lit("pending").alias("status"),
        F.concat(F.lit("recordings/"), rid).alias("recording_directory"), "media_path",
        F.lit(None).cast("string").alias("thumbnail_path"),
        F.lit(None).cast("bigint").alias("duration_ms"), "captured_at",
        at.alias("created_at"), at.alias("updated_at"),
        F.lit(None).cast("string").alias("completed_at"),
        F.lit(None).cast("string").alias("failure_message"))
    return made.select(*schemas.RECORDINGS.fieldNames())


def _patched(table: DataFrame, patches: DataFrame, key: str, keep: list[str], put: list[str],
             now: Column | str | None) -> DataFrame:
    """``keep`` columns keep the old value under a null patch, ``put`` columns take the
    patch as it is. Rows without a patch stay as they are."""
    changes = patches.select(
        F.col(key).alias("_key"), F.struct(*keep, *put).alias("_p"))
    joined = table.join(changes, F.col(key) == F.col("_key"), "left")
    hit, p = F.col("_p").isNotNull(), F.col("_p")
    out = []
    for c in table.columns:
        if c == "updated_at":
            out.append(F.when(hit, as_time(now)).otherwise(F.col(c)).alias(c))
        elif c in keep:
            out.append(F.coalesce(p[c], F.col(c)).alias(c))
        elif c in put:
            out.append(F.when(hit, p[c]).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def unmatched(patches: DataFrame, table: DataFrame, key: str = "id",
              table_key: str = "id") -> DataFrame:
    """Changes whose row does not exist; the caller reports them."""
    return patches.join(table.select(F.col(table_key).alias(key)), key, "left_anti")


RECORDING_PATCH = ["title", "status", "media_path", "thumbnail_path", "duration_ms",
                   "captured_at", "completed_at", "failure_message"]


def patch_recordings(recordings: DataFrame, patches: DataFrame,
                     now: Column | str | None = None) -> DataFrame:
    """Patch by id. A null in the patch keeps the old value, so no column can be
    set to null this way."""
    return _patched(recordings, patches, "id", RECORDING_PATCH, [], now)


def change_recording_status(recordings: DataFrame, changes: DataFrame,
                            now: Column | str | None = None) -> DataFrame:
    """Apply encode transitions (id, target, media_path, thumbnail_path, duration_ms,
    completed_at, failure_message) with target processing, completed or failed."""
    c = changes.select(F.col("id").alias("_key"), F.struct(
        "target", "media_path", "thumbnail_path", "duration_ms", "completed_at",
        "failure_message").alias("_t"))
    joined = recordings.join(c, F.col("id") == F.col("_key"), "left")
    t, target = F.col("_t"), F.col("_t.target")
    done, hit = target == "completed", F.col("_t").isNotNull()
    new = {
        "status": target,
        "media_path": F.when(done, t["media_path"]),
        "thumbnail_path": F.when(done, t["thumbnail_path"]),
        "duration_ms": F.when(done, t["duration_ms"]).otherwise(F.col("duration_ms")),
        "updated_at": as_time(now),
        "completed_at": F.when(done, t["completed_at"]),
        "failure_message": F.when(target == "failed", t["failure_message"]),
    }
    return joined.select(*[
        F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
        for c in recordings.columns])


def _upsert_by_recording(table: DataFrame, incoming: DataFrame, columns: list[str], kind: str,
                         now: Column | str | None) -> DataFrame:
    """One row per recording: id and creation time survive, all else is overwritten,
    also with nulls."""
    payload = [c for c in columns if c not in ("id", "recording_id", "created_at", "updated_at")]
    new = incoming.select(F.col("recording_id").alias("_key"), F.struct(*payload).alias("_n"))
    joined = table.join(new, F.col("recording_id") == F.col("_key"), "full_outer")
    n, hit = F.col("_n"), F.col("_n").isNotNull()
    out = {
        "id": F.coalesce("id", tx.stable_id(F.lit(kind), F.col("_key"))),
        "recording_id": F.coalesce("recording_id", "_key"),
        "created_at": F.coalesce(F.col("created_at"), as_time(now)),
        "updated_at": F.when(hit, as_time(now)).otherwise(F.col("updated_at")),
    }
    return joined.select(*[
        (out[c] if c in out else F.when(hit, n[c]).otherwise(F.col(c))).alias(c)
        for c in columns])


def upsert_transcripts(transcripts: DataFrame, incoming: DataFrame,
                       now: Column | str | None = None) -> DataFrame:
    return _upsert_by_recording(transcripts, incoming, schemas.TRANSCRIPTS.fieldNames(),
                                "transcript", now)


def upsert_summaries(summaries: DataFrame, incoming: DataFrame,
                     now: Column | str | None = None) -> DataFrame:
    return _upsert_by_recording(summaries, incoming, schemas.AI_SUMMARIES.fieldNames(),
                                "summary", now)


def replace_segments(segments: DataFrame, replaced: DataFrame, incoming: DataFrame,
                     now: Column | str | None = None) -> DataFrame:
    """Drop every segment of the replaced transcripts, add the new ones.

    ``replaced`` lists (transcript_id, recording_id), also for transcripts that get
    no new segments: a failed transcript loses its earlier ones. ``incoming`` has
    transcript_id, position, segment_index, start_ms, end_ms, text, confidence; the
    index defaults to the position. New rows get new ids at each time of change.
    """
    kept = segments.join(replaced.select("transcript_id"), "transcript_id", "left_anti")
    index = F.coalesce("segment_index", "position").cast("bigint")
    added = incoming.join(replaced, "transcript_id").select(
        tx.stable_id(F.lit("segment"), F.col("transcript_id"), index, as_time(now)).alias("id"),
        "transcript_id", "recording_id", index.alias("segment_index"), "start_ms", "end_ms",
        "text", "confidence")
    return kept.select(*added.columns).unionByName(added)


def create_sessions(requests: DataFrame, now: Column | str | None = None) -> DataFrame:
    """New capturing sessions. Columns the request lacks start empty or zero."""
    at = as_time(now)
    fixed = {
        "status": F.lit("capturing"), "created_at": at, "updated_at": at,
        "frame_count": F.lit(0), "audio_byte_count": F.lit(0),
        "microphone_audio_byte_count": F.lit(0), "source_audio_byte_count": F.lit(0),
    }
    out = []
    for field in schemas.RECORDING_SESSIONS.fields:
        if field.name in fixed:
            value = fixed[field.name]
        elif field.name in requests.columns:
            value = F.col(field.name)
        else:
            value = F.lit(None)
        out.append(value.cast(field.dataType).alias(field.name))
    return requests.select(*out)


CAPTURE_DETAILS = ["audio_sample_rate", "audio_channels", "audio_sample_format",
                   "microphone_audio_sample_rate", "microphone_audio_channels",
                   "microphone_audio_sample_format", "source_audio_sample_rate",
                   "source_audio_channels", "source_audio_sample_format"]


def patch_capture_details(sessions: DataFrame, patches: DataFrame,
                          now: Column | str | None = None) -> DataFrame:
    """Sizes and audio details learned during capture; nulls keep the old value."""
    return _patched(sessions, patches, "id", ["width", "height", *CAPTURE_DETAILS], [], now)


def finish_sessions(sessions: DataFrame, patches: DataFrame,
                    now: Column | str | None = None) -> DataFrame:
    """Final facts of a capture: sizes and audio details keep the old value under a
    null; status, counts, stop time, duration and failure are replaced."""
    return _patched(
        sessions, patches, "id", ["width", "height", *CAPTURE_DETAILS],
        ["status", "frame_count", "audio_byte_count", "microphone_audio_byte_count",
         "source_audio_byte_count", "stopped_at", "duration_ms", "failure_message"], now)


def latest_rows(rows: DataFrame, key: str = "id", version: str = "updated_at") -> DataFrame:
    """Newest version of each row. ``max_by`` combines on the map side, so a key with
    very many versions is no hot spot. Equal versions are told apart by content."""
    others = [c for c in rows.columns if c != key]
    order = F.struct(F.col(version), F.xxhash64(*others))
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_r"))
    return picked.select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c)
                           for c in rows.columns])


def latest_recordings(rows: DataFrame) -> DataFrame:
    """List upsert: replaced by id, newest created first."""
    return latest_rows(rows).orderBy(F.desc("created_at"), "id")
