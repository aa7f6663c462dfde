"""Backfill of session rows written by older versions, and source ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid import schemas
from reelgrid.functions import text as tx

STREAMS = ("microphone", "source")
STREAM_DETAILS = ("sample_rate", "channels", "sample_format")

# Fixed value: name of the file a source-only legacy capture wrote.
LEGACY_SOURCE_FILE = "source_audio.pcm"


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def fill_video_source(sessions: DataFrame) -> DataFrame:
    """Video source columns from the screen source id. The kind is always derived
    anew; id and title only where empty; the window id where one can be read."""
    screen = F.col("screen_source_id")
    kind = (F.when(screen.ilike("window:%"), "window")
            .when(screen.ilike("application:%"), "application").otherwise("display"))
    window = F.regexp_extract(screen, "^window:([0-9]+)", 1).try_cast("bigint")
    return sessions.withColumns({
        "video_source_id": F.coalesce(F.nullif("video_source_id", F.lit("")), screen),
        "video_source_kind": kind,
        "video_source_title": F.coalesce(F.nullif("video_source_title", F.lit("")), screen),
        "video_source_window_id": F.coalesce(window, "video_source_window_id"),
    })


def fill_audio_mode(sessions: DataFrame) -> DataFrame:
    """Audio mode where it is empty or contradicts the microphone flag."""
    mode, with_mic = F.col("audio_mode"), F.col("include_microphone")
    source_file = F.coalesce(F.col("audio_path").ilike(f"%{LEGACY_SOURCE_FILE}"), F.lit(False))
    derived = (
        F.when(with_mic, F.when(source_file, "microphone_and_source").otherwise("microphone"))
        .when(source_file, "source")
        .when(_filled(F.col("audio_path")), "microphone")
        .otherwise("none"))
    stale = ~_filled(mode) | ((mode == "microphone") & ~with_mic)
    return sessions.withColumn("audio_mode", F.when(stale, derived).otherwise(mode))


def fill_audio_paths(sessions: DataFrame) -> DataFrame:
    """The one legacy path goes to the source stream for mode source, else to the
    microphone."""
    legacy = F.nullif("audio_path", F.lit(""))
    is_source = F.col("audio_mode") == "source"
    return sessions.withColumns({
        "microphone_audio_path": F.coalesce("microphone_audio_path", F.when(~is_source, legacy)),
        "source_audio_path": F.coalesce("source_audio_path", F.when(is_source, legacy)),
    })


def _legacy_bytes(stream: str, path: Column, extra: Column | None = None) -> Column:
    own = F.col(f"{stream}_audio_byte_count")
    use = path.isNotNull() & (own == 0)
    if extra is not None:
        use = use & extra
    return F.when(use, F.col("audio_byte_count")).otherwise(own)


def fill_audio_stats(sessions: DataFrame) -> DataFrame:
    """Stream facts from the legacy facts. Microphone details are filled with or
    without a path, source details only with one."""
    new = {}
    for stream in STREAMS:
        path = F.col(f"{stream}_audio_path")
        new[f"{stream}_audio_byte_count"] = _legacy_bytes(stream, path)
        for detail in STREAM_DETAILS:
            own, legacy = F.col(f"{stream}_audio_{detail}"), F.col(f"audio_{detail}")
            usable = legacy if stream == "microphone" else F.when(path.isNotNull(), legacy)
            new[f"{stream}_audio_{detail}"] = F.coalesce(own, usable)
    return sessions.withColumns(new)


def backfill_sessions(sessions: DataFrame) -> DataFrame:
    """All four steps in order; each reads the result of the one before."""
    step = fill_audio_mode(fill_video_source(sessions))
    return fill_audio_stats(fill_audio_paths(step))


def fill_preferences(preferences: DataFrame) -> DataFrame:
    """The same defaults for stored capture preferences."""
    mode = F.when(F.col("include_microphone"), "microphone").otherwise("none")
    return preferences.withColumns({
        "video_source_id": F.coalesce(F.nullif("video_source_id", F.lit("")),
                                      F.nullif("screen_source_id", F.lit(""))),
        "audio_mode": F.coalesce(F.nullif("audio_mode", F.lit("")), mode),
    })


def read_sessions(sessions: DataFrame) -> DataFrame:
    """Session rows with legacy fallbacks applied on read.

    Unlike the stored backfill, details of either stream need a path, and the
    legacy byte count is used only when positive.
    """
    legacy, is_source = F.col("audio_path"), F.col("audio_mode") == "source"
    paths = {
        "microphone": F.coalesce("microphone_audio_path", F.when(~is_source, legacy)),
        "source": F.coalesce("source_audio_path",
                             F.when(is_source, F.nullif(legacy, F.lit("")))),
    }
    new = {
        "video_source_id": F.coalesce(F.nullif("video_source_id", F.lit("")), "screen_source_id"),
        "audio_path": F.coalesce(legacy, paths["microphone"]),
    }
    for stream, path in paths.items():
        new[f"{stream}_audio_path"] = path
        new[f"{stream}_audio_byte_count"] = _legacy_bytes(
            stream, path, F.col("audio_byte_count") > 0)
        for detail in STREAM_DETAILS:
            new[f"{stream}_audio_{detail}"] = F.coalesce(
                f"{stream}_audio_{detail}", F.when(path.isNotNull(), F.col(f"audio_{detail}")))
    return sessions.withColumns(new)


def parse_source_id(source_id: Column) -> dict[str, Column]:
    """kind, native_id and error of a ``kind:native`` id."""
    has_prefix = source_id.contains(":")
    prefix = F.substring_index(source_id, ":", 1)
    native = tx.trim_space(F.substr(source_id, F.length(prefix) + 2))
    error = (
        F.when(~has_prefix, F.lit("no kind prefix"))
        .when(native == "", F.lit("no native id"))
        .when(~prefix.isin(*schemas.SOURCE_KINDS), F.lit("unknown kind prefix")))
    return {"kind": F.when(error.isNull(), prefix), "native_id": F.when(error.isNull(), native),
            "error": error}


def source_label(source_id: Column) -> Column:
    prefix = F.substring_index(source_id, ":", 1)
    return F.when(prefix.isin(*schemas.SOURCE_KINDS), F.initcap(prefix)).otherwise("Source")


def source_context(kind: Column, title: Column, primary: Column, app_name: Column,
                   process_id: Column, window_id: Column) -> Column:
    """Distinguishing facts of a capture source, joined by a slash."""
    named = F.when(_filled(app_name) & (app_name != title), app_name)
    app, window = kind == "application", kind == "window"
    return F.concat_ws(
        " / ",
        F.when((kind == "display") & primary, F.lit("Primary")),
        F.when(app | window, named),
        F.when(app & (process_id != 0), F.concat(F.lit("PID "), process_id.cast("string"))),
        F.when(window & (window_id != 0), F.concat(F.lit("Window "), window_id.cast("string"))))


def source_option(source_id: Column, kind: Column, title: Column, primary: Column,
                  app_name: Column, process_id: Column, window_id: Column) -> Column:
    shown = F.coalesce(tx.blank_to_null(title), source_id)
    context = source_context(kind, shown, primary, app_name, process_id, window_id)
    return F.when(context != "", F.concat(shown, F.lit(" - "), context)).otherwise(shown)
