"""Report text for times, durations, sizes, ranks, jobs and streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display labels of the job states.
JOB_STATE_LABELS = {"queued": "Queued", "running": "Running", "succeeded": "Succeeded",
                    "failed": "Failed", "cancelled": "Cancelled"}

DATE_PATTERN = "yyyy-MM-dd HH:mm:ss"


def truthy(c: Column) -> Column:
    """Not null and not zero."""
    return F.coalesce(c, F.lit(0)) != 0


def text_timestamp(text: Column) -> Column:
    """Timestamp of a text holding epoch seconds or ISO-8601; null when neither."""
    epoch = F.timestamp_seconds(F.when(text.rlike("^[0-9]+$"), text).try_cast("bigint"))
    return F.when(text.rlike("^[0-9]+$"), epoch).otherwise(F.try_to_timestamp(text))


def date_text(text: Column, pattern: str = DATE_PATTERN) -> Column:
    shown = F.coalesce(F.date_format(text_timestamp(text), pattern), text)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("Not captured")).otherwise(shown)


def _minutes_seconds(total_seconds: Column) -> Column:
    total = total_seconds.cast("bigint")
    minutes = F.floor(total / 60).cast("string")
    return F.concat(minutes, F.lit(":"), F.lpad(F.pmod(total, F.lit(60)).cast("string"), 2, "0"))


def duration_text(ms: Column) -> Column:
    return F.when(~truthy(ms), F.lit("Duration pending")).otherwise(
        _minutes_seconds(F.floor(ms / 1000 + F.lit(0.5))))


def segment_time(ms: Column) -> Column:
    return _minutes_seconds(F.floor(ms / 1000))


def _fixed(value: Column, digits: int) -> Column:
    """A non-negative number with a fixed number of decimals, rounded by its exact binary
    value (0.1035 is stored as slightly less, so three decimals give 0.103)."""
    scale = float(10 ** digits)
    # The part of value * scale that is lost in the product, from an exact split of value.
    far = value * F.lit(134217729.0)
    high = far - (far - value)
    product = value * scale
    lost = (high * scale - product) + (value - high) * scale
    whole = F.floor(product)
    units = (whole + F.when(product - whole - F.lit(0.5) + lost >= 0, 1).otherwise(0)).cast("bigint")
    return F.concat(
        F.floor(units / int(scale)).cast("string"), F.lit("."),
        F.lpad((units % int(scale)).cast("string"), digits, "0"))


def byte_text(n: Column) -> Column:
    size = n.cast("double")
    return (
        F.when(~truthy(n), F.lit("No bytes written"))
        .when(size < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B")))
        .when(size < 1024 ** 2, F.concat(_fixed(size / 1024, 1), F.lit(" KB")))
        .when(size < 1024 ** 3, F.concat(_fixed(size / 1024 ** 2, 1), F.lit(" MB")))
        .otherwise(F.concat(_fixed(size / 1024 ** 3, 1), F.lit(" GB"))))


def rank_text(rank: Column) -> Column:
    rank = rank + F.lit(0.0)  # a negative zero is shown without its sign
    finite = rank.isNotNull() & ~F.isnan(rank) & (F.abs(rank) < float("inf"))
    exponent = F.regexp_replace(F.format_string("%.2e", rank), r"e([+-])0+(\d)", "e$1$2")
    plain = F.concat(F.when(rank < 0, "-").otherwise(""), _fixed(F.abs(rank), 3))
    value = F.when(F.abs(rank) < 0.001, exponent).otherwise(plain)
    return F.when(finite, F.concat(F.lit("Rank "), value)).otherwise(F.lit("Rank pending"))


def confidence_text(confidence: Column) -> Column:
    percent = F.floor(confidence * 100 + F.lit(0.5)).cast("bigint").cast("string")
    return F.when(confidence.isNull(), F.lit("")).otherwise(F.concat(percent, F.lit("%")))


def resolution_text(width: Column, height: Column) -> Column:
    shown = F.concat(width.cast("string"), F.lit(" x "), height.cast("string"))
    return F.when(truthy(width) & truthy(height), shown).otherwise(F.lit("Pending"))


def audio_stream_text(path: Column, channels: Column, rate: Column, sample_format: Column) -> Column:
    details = F.concat_ws(
        " / ",
        F.when(truthy(channels), F.concat(channels.cast("string"), F.lit(" ch"))),
        F.when(truthy(rate), F.concat(rate.cast("string"), F.lit(" Hz"))),
        F.nullif(sample_format, F.lit("")))
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit("Off")).otherwise(
        F.coalesce(F.nullif(details, F.lit("")), F.lit("PCM pending")))


def job_display_status(state: Column, interrupted: Column) -> Column:
    return F.when(interrupted, F.lit("interrupted")).otherwise(state)


def job_state_label(state: Column, interrupted: Column, attempts: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in JOB_STATE_LABELS.items() for x in pair])
    return (
        F.when(interrupted, F.lit("Interrupted"))
        .when((state == "queued") & (attempts > 0), F.lit("Retry queued"))
        .when((state == "running") & (attempts > 1), F.lit("Retrying"))
        .otherwise(F.try_element_at(labels, state)))


def job_meta(attempts: Column, max_attempts: Column, last_error_at: Column,
             updated_at: Column) -> Column:
    attempt = F.concat(
        F.lit("Attempt "), attempts.cast("string"),
        F.when(max_attempts > 0, F.concat(F.lit("/"), max_attempts.cast("string"))).otherwise(""))
    has_error = F.coalesce(last_error_at, F.lit("")) != ""
    moment = F.when(has_error, F.concat(F.lit("Last error "), date_text(last_error_at))).otherwise(
        F.concat(F.lit("Updated "), date_text(updated_at)))
    return F.concat_ws(" / ", attempt, moment)
