"""Audio timelines: block placement, levels, resampling, mixing, speech samples.

Streams may be of any length: running values use chunked windows, and samples are worked on in
blocks (``audio_blocks``). The functions on sample rows here gather rows into blocks first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.operators import audio_blocks as ab
from reelgrid.operators.running import CHUNK_WIDTH, running_before

# Supported PCM sample formats and the bytes one sample takes.
SAMPLE_BYTES = {"i8": 1, "u8": 1, "i16": 2, "u16": 2, "i24": 4, "i32": 4, "u24": 4, "u32": 4,
                "f32": 4, "f64": 8}
# Sample rates for encoding and for speech recognition.
ENCODE_RATE = 48000
SPEECH_RATE = 16000
# Fixed value: the largest sample size that still counts as silence (32-bit epsilon).
SILENCE = 1.1920929e-07
STEREO = ["left", "right"]


def frame_at(elapsed_ms: str, rate: str) -> Column:
    """Frame number of a time, rounded to the nearest frame, in whole numbers."""
    return F.expr(f"({elapsed_ms} * {rate} + 500L) div 1000L")


def place_blocks(blocks: DataFrame, chunk_width: int = CHUNK_WIDTH) -> DataFrame:
    """Place blocks (stream_id, block_seq, elapsed_ms, sample_rate, frames) on their
    stream's timeline, in file order.

    Adds start_frame, timeline_end (end of all earlier blocks), gap_frames of silence
    before the block, skip_frames dropped from its front, kept_frames and out_frame,
    where the kept part starts.
    """
    started = blocks.withColumn("start_frame", frame_at("elapsed_ms", "sample_rate"))
    stop = F.col("start_frame") + F.col("frames")
    rows = running_before(started, ["stream_id"], "block_seq",
                          {"timeline_end": ("max", stop)}, chunk_width)
    cur = F.coalesce("timeline_end", F.lit(0))
    out = F.greatest(F.col("start_frame"), cur)
    return rows.withColumns({
        "timeline_end": cur,
        "gap_frames": F.greatest(F.col("start_frame") - cur, F.lit(0)),
        "skip_frames": F.least(F.greatest(cur - F.col("start_frame"), F.lit(0)), F.col("frames")),
        "kept_frames": F.greatest(stop - out, F.lit(0)),
        "out_frame": out,
    })


def timeline_lengths(placed: DataFrame) -> DataFrame:
    """stream_id, frames, silent_frames, dropped_frames of each timeline."""
    return placed.groupBy("stream_id").agg(
        F.max(F.col("start_frame") + F.col("frames")).alias("frames"),
        F.sum("gap_frames").cast("bigint").alias("silent_frames"),
        F.sum("skip_frames").cast("bigint").alias("dropped_frames"))


def silent_samples(placed: DataFrame, piece: int = CHUNK_WIDTH) -> DataFrame:
    """Sample rows of the gaps. A long gap is opened in pieces of bounded size."""
    none = [F.lit(None).cast("array<double>").alias(v) for v in STEREO]
    gaps = placed.where("gap_frames > 0").select(
        "stream_id", F.col("timeline_end").alias("first"), F.col("gap_frames").alias("n"), *none)
    return ab.rows_of_blocks(gaps, STEREO, "stream_id", piece)


def timeline_samples(placed: DataFrame, decoded: DataFrame) -> DataFrame:
    """stream_id, frame, left, right of the whole timeline.

    ``decoded`` has stream_id, block_seq and the arrays left and right, one row per
    block.
    """
    return ab.rows_of_blocks(ab.timeline_blocks(placed, decoded), STEREO, "stream_id")


def stream_levels(samples: DataFrame, key: str = "stream_id") -> DataFrame:
    """Per stream: frames, peak, and whether it is only silence."""
    peak = F.max(F.greatest(F.abs("left"), F.abs("right")))
    return samples.groupBy(key).agg(
        (F.max("frame") + 1).alias("frames"), peak.alias("peak"),
        (peak <= SILENCE).alias("is_silent"))


def resample(samples: DataFrame, rates: DataFrame | int, rate_out: int, values: list[str],
             key: str = "stream_id", chunk_width: int = ab.WIDTH) -> DataFrame:
    """Linear resampling of gap-free sample rows.

    ``rates`` is one rate for all streams or a frame with sample_rate per stream. The last
    frame repeats.
    """
    blocks = ab.blocks_of_rows(samples, values, key, chunk_width)
    return ab.rows_of_blocks(ab.resample(blocks, rates, rate_out, values, key, chunk_width), values,
                             key)


def source_gains(levels: DataFrame, sources: DataFrame) -> DataFrame:
    """stream_id, recording_id, gain for the sources that are not empty and not silent."""
    usable = levels.where("NOT is_silent").join(
        sources.select("stream_id", "recording_id"), "stream_id")
    shares = usable.groupBy("recording_id").agg(F.count("*").alias("n"))
    return usable.join(shares, "recording_id").select(
        "stream_id", "recording_id", (F.lit(1.0) / F.col("n")).alias("gain"))


def mix(samples: DataFrame, gains: DataFrame) -> DataFrame:
    """recording_id, frame, left, right: equal-gain sum as long as the longest source."""
    blocks = ab.blocks_of_rows(samples, STEREO, "stream_id")
    return ab.rows_of_blocks(ab.mix(blocks, gains), STEREO, "recording_id")


def sixteen_bit(sample: Column) -> Column:
    """Clamped 16-bit value of a sample; values that are not finite become zero."""
    finite = ~F.isnan(sample) & (F.abs(sample) != float("inf"))
    level = F.when(finite, F.greatest(F.least(sample, F.lit(1.0)), F.lit(-1.0))).otherwise(0.0)
    # rounded half away from zero
    return F.when(level < 0, F.ceil(level * 32768.0 - 0.5)).otherwise(
        F.floor(level * 32767.0 + 0.5)).cast("int")


def speech_blocks(blocks: DataFrame, rate: int = ENCODE_RATE, key: str = "recording_id",
                  width: int = ab.WIDTH) -> DataFrame:
    """Blocks (key, first, n, sample): mono, 16 kHz, 16 bit; null where silent."""
    return ab.speech(blocks, rate, SPEECH_RATE, sixteen_bit, key, width)


def speech_samples(samples: DataFrame, rate: int = ENCODE_RATE,
                   key: str = "recording_id") -> DataFrame:
    """key, frame, sample: mono, 16 kHz, 16 bit."""
    heard = speech_blocks(ab.blocks_of_rows(samples, STEREO, key), rate, key)
    return ab.rows_of_blocks(heard, ["sample"], key).withColumn("sample", F.col("sample").cast("int"))


def format_problem(rate: Column, channels: Column, sample_format: Column) -> Column:
    """Why a stream's format cannot be used, or null; checked in this order."""
    return (
        F.when(F.coalesce(rate, F.lit(0)) <= 0, F.lit("missing sample rate"))
        .when(F.coalesce(channels, F.lit(0)) <= 0, F.lit("missing channels"))
        .when(sample_format.isNull(), F.lit("missing sample format"))
        .when(~sample_format.isin(*SAMPLE_BYTES), F.lit("unsupported sample format")))


MICROPHONE, SOURCE = "microphone audio", "source audio"


def requested_streams(sessions: DataFrame) -> DataFrame:
    """Audio streams a session's mode asks for: session_id, label, path, sample_rate,
    channels, sample_format, warning.

    A requested stream without a path becomes a row with a warning. Mode none still
    takes a legacy path as microphone, with the legacy format.
    """
    mode = F.col("audio_mode")
    legacy = F.when(mode != "source", F.col("audio_path"))
    mic = mode.isin("microphone", "microphone_and_source")
    missing = F.lit(" was requested but no capture file was recorded")

    def rows(cond: Column, label: str, path: Column, prefix: str) -> DataFrame:
        return sessions.where(cond).select(
            F.col("id").alias("session_id"), F.lit(label).alias("label"), path.alias("path"),
            F.col(f"{prefix}_sample_rate").alias("sample_rate"),
            F.col(f"{prefix}_channels").alias("channels"),
            F.col(f"{prefix}_sample_format").alias("sample_format"),
            F.when(path.isNull(), F.concat(F.lit(label), missing)).alias("warning"))

    return (
        rows(mic, MICROPHONE, F.coalesce("microphone_audio_path", legacy), "microphone_audio")
        .unionByName(rows((mode == "none") & legacy.isNotNull(), MICROPHONE, legacy, "audio"))
        .unionByName(rows(mode.isin("source", "microphone_and_source"), SOURCE,
                          F.col("source_audio_path"), "source_audio")))


def stream_warnings(streams: DataFrame, levels: DataFrame) -> DataFrame:
    """One reason per unusable stream: no path, bad format, no samples, only silence.

    ``levels`` has one row per path with samples (path, is_silent)."""
    problem = format_problem(F.col("sample_rate"), F.col("channels"), F.col("sample_format"))
    reason = F.coalesce(
        F.col("warning"), problem,
        F.when(F.col("is_silent").isNull(), F.lit("no audio samples")),
        F.when(F.col("is_silent"), F.lit("only silence")))
    return streams.join(levels.select("path", "is_silent"), "path", "left").select(
        "session_id", "label", "path", reason.alias("reason")).where("reason IS NOT NULL")
