"""Media facts: durations, frame and manifest checks, output sizes, capture statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions import text as tx
from reelgrid.operators.running import with_group_facts

# Frame format codes, bytes per pixel and size bounds.
RAW_FRAME_FORMAT = 7
PACKED_FRAME_FORMAT = 8
BYTES_PER_PIXEL = 4
ENCODE_BOUND = (1920, 1080)
CAPTURE_BOUND = (1280, 720)
THUMBNAIL_WIDTH = 480


def _whole_ratio(numerator: Column, denominator: Column) -> Column:
    """Rounded quotient of two whole numbers, in whole-number arithmetic."""
    half = F.call_function("div", denominator, F.lit(2))
    return F.call_function("div", numerator + half, denominator)


def frames_duration(frames: Column, rate: Column) -> Column:
    """Milliseconds of a number of frames, or null when either is not positive."""
    n, r = frames.cast("bigint"), rate.cast("bigint")
    return F.when((n > 0) & (r > 0), _whole_ratio(n * 1000, r))


def media_duration(frames: Column, rate: Column, audio_ms: Column, hint_ms: Column) -> Column:
    """The longer of video and audio, else the hint."""
    return F.coalesce(F.greatest(frames_duration(frames, rate), audio_ms), hint_ms)


def even_size(size: Column) -> Column:
    return F.when(size <= 2, F.greatest(size, F.lit(1))).otherwise(size - size % 2)


def bounded_size(width: Column, height: Column, bound: tuple[int, int]) -> Column:
    """Struct of the even width and height that fit the bound at the same ratio."""
    w, h = width.cast("bigint"), height.cast("bigint")
    max_w, max_h = F.lit(bound[0]).cast("bigint"), F.lit(bound[1]).cast("bigint")
    fits = (w <= max_w) & (h <= max_h)
    wide = w * max_h > max_w * h
    w2 = F.when(fits, w).when(wide, max_w).otherwise(
        F.greatest(F.least(_whole_ratio(w * max_h, h), max_w), F.lit(1)))
    h2 = F.when(fits, h).when(wide, F.greatest(F.least(_whole_ratio(h * max_w, w), max_h),
                                               F.lit(1))).otherwise(max_h)
    usable = (w > 0) & (h > 0)
    return F.when(usable, F.struct(even_size(w2).alias("width"), even_size(h2).alias("height")))


def thumbnail_height(width: Column, height: Column) -> Column:
    w, h = width.cast("bigint"), height.cast("bigint")
    return F.when(w > 0, F.greatest(_whole_ratio(h * THUMBNAIL_WIDTH, w), F.lit(1)))


def letterbox(width: Column, height: Column, canvas_width: Column, canvas_height: Column) -> Column:
    """Struct of scaled width and height and the offsets that centre it on a canvas."""
    w, h = width.cast("bigint"), height.cast("bigint")
    cw, ch = canvas_width.cast("bigint"), canvas_height.cast("bigint")
    tall = w * ch <= cw * h
    w2 = F.when(tall, F.greatest(F.least(_whole_ratio(w * ch, h), cw), F.lit(1))).otherwise(cw)
    h2 = F.when(tall, ch).otherwise(
        F.greatest(F.least(_whole_ratio(h * cw, w), ch), F.lit(1)))
    two = F.lit(2)
    return F.when((w > 0) & (h > 0), F.struct(
        w2.alias("width"), h2.alias("height"),
        F.call_function("div", cw - w2, two).alias("x"),
        F.call_function("div", ch - h2, two).alias("y")))


def check_frames(frames: DataFrame) -> DataFrame:
    """Frame headers (stream_id, frame_seq, format_code, width, height, byte_count) with
    a reason for each bad one. Sizes are compared with the stream's first frame."""
    first = frames.groupBy("stream_id").agg(
        F.min_by(F.struct("width", "height"), "frame_seq").alias("_first"))
    joined = with_group_facts(frames, first, ["stream_id"], "frame_seq")
    expected = F.col("width") * F.col("height") * BYTES_PER_PIXEL
    code = F.col("format_code")
    reason = (
        F.when((F.col("width") <= 0) | (F.col("height") <= 0), F.lit("invalid size"))
        .when((F.col("width") != F.col("_first.width")) | (F.col("height") != F.col("_first.height")),
              F.lit("size changed"))
        .when((code == RAW_FRAME_FORMAT) & (F.col("byte_count") != expected),
              F.lit("wrong byte count"))
        .when(~code.isin(RAW_FRAME_FORMAT, PACKED_FRAME_FORMAT), F.lit("unsupported format")))
    return joined.select(*frames.columns, reason.alias("reason"))


def frame_report(checked: DataFrame) -> DataFrame:
    """Per stream: frames, bad frames, usable frames before the first bad one, its reason."""
    bad = F.col("reason").isNotNull()
    return checked.groupBy("stream_id").agg(
        F.count("*").alias("frames"), F.count_if(bad).alias("bad_frames"),
        F.min(F.when(bad, F.col("frame_seq"))).alias("first_bad_seq"),
        F.min_by("reason", F.when(bad, F.col("frame_seq"))).alias("first_reason"))


def manifest_problem() -> Column:
    """Why a chunk manifest is invalid, or null. Columns are those of the manifest."""
    chunks = F.col("chunks")
    n = F.coalesce(F.size(chunks), F.lit(0))
    total = F.aggregate(chunks, F.lit(0).cast("bigint"), lambda acc, c: acc + c["frameCount"])
    return (
        F.when((F.col("width") <= 0) | (F.col("height") <= 0) | (F.col("frameRate") <= 0),
               F.lit("invalid size or frame rate"))
        .when((F.col("frameCount") <= 0) | (n <= 0), F.lit("no finished chunks"))
        .when(F.exists(chunks, lambda c: ~tx.has_words(c["path"])), F.lit("chunk without path"))
        .when(F.exists(chunks, lambda c: c["frameCount"] <= 0), F.lit("empty chunk"))
        .when(total != F.col("frameCount"), F.lit("frame count mismatch")))


def check_manifests(manifests: DataFrame) -> DataFrame:
    """Adds problem and warning; an unfinished but valid manifest is usable."""
    problem = manifest_problem()
    unfinished = problem.isNull() & (F.col("status") != "completed")
    return manifests.withColumns({
        "problem": problem,
        "warning": F.when(unfinished, F.lit("recovered from an unfinished recording"))})


def capture_stats(events: DataFrame) -> DataFrame:
    """Per session: counts, bytes per stream, last sizes, first error and status.

    ``events`` has session_id, seq, kind (frame, microphone, source, error), byte_count,
    width, height, message.
    """
    kind, seq = F.col("kind"), F.col("seq")

    def total(stream: str) -> Column:
        return F.coalesce(F.sum(F.when(kind == stream, F.col("byte_count"))), F.lit(0)).cast("bigint")

    def latest(c: str) -> Column:
        return F.max_by(F.col(c), F.when(kind == "frame", seq))

    return events.groupBy("session_id").agg(
        F.count_if(kind == "frame").alias("frame_count"),
        total("microphone").alias("microphone_audio_byte_count"),
        total("source").alias("source_audio_byte_count"),
        latest("width").alias("width"), latest("height").alias("height"),
        F.count_if(kind == "error").alias("error_count"),
        F.min_by("message", F.when(kind == "error", seq)).alias("first_error"),
    ).withColumn("status", F.when(F.col("error_count") > 0, "failed").otherwise("stopped"))


def failure_messages(events: DataFrame) -> DataFrame:
    """session_id, seq, message: every error of every session, in order of seq. A session's
    failure text is these messages joined by a semicolon; kept as rows, a session that
    reports errors without end needs no large group."""
    return events.where("kind = 'error'").select("session_id", "seq", "message")
