"""Declared schemas, enum domains and column defaults of the library tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The status and mode names stored in the library tables.
RECORDING_STATUSES = ("pending", "capturing", "processing", "completed", "failed")
TRANSCRIPT_STATUSES = ("not_started", "processing", "completed", "failed")
SUMMARY_STATUSES = ("disabled", "pending", "processing", "completed", "failed")
JOB_STATES = ("queued", "running", "succeeded", "failed", "cancelled")
SESSION_STATUSES = ("capturing", "stopped", "failed")
AUDIO_MODES = ("none", "microphone", "source", "microphone_and_source")
SOURCE_KINDS = ("display", "application", "window")


def _struct(spec: str) -> T.StructType:
    """Build a StructType from ``name type`` pairs; a trailing ``!`` means not null."""
    kinds = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(),
             "boolean": T.BooleanType(), "binary": T.BinaryType()}
    fields = []
    for item in spec.split(","):
        name, kind = item.split()
        fields.append(T.StructField(name, kinds[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(fields)


RECORDINGS = _struct(
    "id string!, title string!, status string!, recording_directory string!, media_path string,"
    "thumbnail_path string, duration_ms long, captured_at string, created_at string!,"
    "updated_at string!, completed_at string, failure_message string")

TRANSCRIPTS = _struct(
    "id string!, recording_id string!, status string!, language string, model_name string,"
    "raw_json_path string, text string, created_at string!, updated_at string!,"
    "completed_at string, failure_message string")

TRANSCRIPT_SEGMENTS = _struct(
    "id string!, transcript_id string!, recording_id string!, segment_index long!,"
    "start_ms long!, end_ms long!, text string!, confidence double")

AI_SUMMARIES = _struct(
    "id string!, recording_id string!, status string!, model_name string, summary_text string,"
    "action_items_json string, decisions_json string, questions_json string, risks_json string,"
    "chapters_json string, created_at string!, updated_at string!, completed_at string,"
    "failure_message string")

PROCESSING_JOBS = _struct(
    "id string!, recording_id string, kind string!, state string!, priority long!, attempts long!,"
    "max_attempts long!, input_json string, output_json string, error_message string,"
    "interrupted boolean!, last_error_at string, created_at string!, updated_at string!,"
    "started_at string, completed_at string")

RECORDING_SESSIONS = _struct(
    "id string!, recording_id string!, status string!, temp_directory string!, video_path string!,"
    "audio_path string, metadata_path string!, video_source_id string!, screen_source_id string!,"
    "video_source_kind string!, video_source_title string!, video_source_app_name string,"
    "video_source_process_id long, video_source_window_id long, microphone_device_id string,"
    "include_microphone boolean!, audio_mode string!, microphone_audio_path string,"
    "source_audio_path string, width long, height long, frame_rate long!, frame_count long!,"
    "audio_byte_count long!, audio_sample_rate long, audio_channels long,"
    "audio_sample_format string, microphone_audio_byte_count long!,"
    "microphone_audio_sample_rate long, microphone_audio_channels long,"
    "microphone_audio_sample_format string, source_audio_byte_count long!,"
    "source_audio_sample_rate long, source_audio_channels long, source_audio_sample_format string,"
    "started_at string!, stopped_at string, duration_ms long, failure_message string,"
    "created_at string!, updated_at string!")

AUDIO_BLOCK_INDEX = _struct(
    "path string!, block_seq long, elapsed_ms long, callback_stream_ns long,"
    "capture_stream_ns long, byte_offset long, byte_count long, error string")

VIDEO_FRAME_INDEX = _struct(
    "path string!, frame_seq long, elapsed_ms long, display_time_ms long, format_code long,"
    "width long, height long, byte_offset long, byte_count long, error string")

SAMPLE_ROWS = _struct(
    "stream_id string!, block_seq long!, frame long!, left double, right double, error string")

CHUNK_MANIFEST = T.StructType([
    T.StructField("format", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("codec", T.StringType()),
    T.StructField("container", T.StringType()),
    T.StructField("width", T.LongType()),
    T.StructField("height", T.LongType()),
    T.StructField("frameRate", T.LongType()),
    T.StructField("frameCount", T.LongType()),
    T.StructField("durationMs", T.LongType()),
    T.StructField("thumbnailFramePath", T.StringType()),
    T.StructField("chunks", T.ArrayType(T.StructType([
        T.StructField("path", T.StringType()),
        T.StructField("index", T.LongType()),
        T.StructField("startFrame", T.LongType()),
        T.StructField("frameCount", T.LongType()),
        T.StructField("durationMs", T.LongType()),
    ]))),
])

_SIZE = T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())])
_STREAM = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("sampleRate", T.LongType()),
    T.StructField("channels", T.LongType()),
    T.StructField("sampleFormat", T.StringType()),
    T.StructField("byteCount", T.LongType()),
])

SESSION_SIDECAR = T.StructType([
    T.StructField("sessionId", T.StringType()),
    T.StructField("recordingId", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("createdAt", T.StringType()),
    T.StructField("startedAt", T.StringType()),
    T.StructField("stoppedAt", T.StringType()),
    T.StructField("durationMs", T.LongType()),
    T.StructField("resolution", _SIZE),
    T.StructField("frameRate", T.LongType()),
    T.StructField("frameCount", T.LongType()),
    T.StructField("video", T.StructType([
        T.StructField("path", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("source", T.StructType([
            T.StructField("id", T.StringType()),
            T.StructField("kind", T.StringType()),
            T.StructField("title", T.StringType()),
            T.StructField("appName", T.StringType()),
            T.StructField("processId", T.LongType()),
            T.StructField("windowId", T.LongType()),
        ])),
        T.StructField("outputDimensions", _SIZE),
        T.StructField("initialOutputDimensions", _SIZE),
        T.StructField("currentSourceDimensions", _SIZE),
        T.StructField("normalization", T.StructType([
            T.StructField("policy", T.StringType()),
            T.StructField("padding", T.StringType()),
        ])),
    ])),
    T.StructField("audio", T.StructType([
        T.StructField("mode", T.StringType()),
        T.StructField("microphone", _STREAM),
        T.StructField("source", _STREAM),
    ])),
    T.StructField("sync", T.StructType([
        T.StructField("videoClock", T.StringType()),
        T.StructField("audioClock", T.StringType()),
        T.StructField("note", T.StringType()),
    ])),
    T.StructField("failureMessage", T.StringType()),
])

TABLES = {
    "recordings": RECORDINGS,
    "transcripts": TRANSCRIPTS,
    "transcript_segments": TRANSCRIPT_SEGMENTS,
    "ai_summaries": AI_SUMMARIES,
    "processing_jobs": PROCESSING_JOBS,
    "recording_sessions": RECORDING_SESSIONS,
}

# Enum columns checked on read, per table.
ENUM_COLUMNS = {
    "recordings": {"status": RECORDING_STATUSES},
    "transcripts": {"status": TRANSCRIPT_STATUSES},
    "transcript_segments": {},
    "ai_summaries": {"status": SUMMARY_STATUSES},
    "processing_jobs": {"state": JOB_STATES},
    "recording_sessions": {"status": SESSION_STATUSES, "audio_mode": AUDIO_MODES},
}

# Defaults of columns added to a table after its first version.
ADDED_COLUMN_DEFAULTS = {
    "transcript_segments": {"confidence": None},
    "processing_jobs": {"interrupted": False, "last_error_at": None},
    "recording_sessions": {
        "video_source_id": "", "video_source_kind": "display", "video_source_title": "",
        "video_source_app_name": None, "video_source_process_id": None,
        "video_source_window_id": None, "audio_mode": "microphone",
        "microphone_audio_path": None, "source_audio_path": None,
        "microphone_audio_byte_count": 0, "microphone_audio_sample_rate": None,
        "microphone_audio_channels": None, "microphone_audio_sample_format": None,
        "source_audio_byte_count": 0, "source_audio_sample_rate": None,
        "source_audio_channels": None, "source_audio_sample_format": None,
    },
}
