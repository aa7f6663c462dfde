"""Recogniser JSON documents to transcript and segment rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions import text as tx
from reelgrid.functions import variants as vr
from reelgrid.operators.running import running_before

# Confidence keys in the order they are looked up.
CONFIDENCE_KEYS = ("confidence", "confidence_score", "probability")


def _offset_ms(segment: Column, exact: str, seconds: str, edge: str) -> Column:
    """First reading of a segment edge that parses, in milliseconds."""
    return F.coalesce(
        vr.whole_at(segment, f"$.{exact}"),
        vr.milliseconds_at(segment, f"$.{seconds}"),
        vr.whole_at(segment, f"$.offsets.{edge}"),
        vr.clock_ms(vr.string_at(segment, f"$.timestamps.{edge}")))


def _confidence(segment: Column) -> Column:
    first = F.coalesce(*[vr.number_at(segment, f"$.{key}") for key in CONFIDENCE_KEYS])
    return F.when(first.between(0.0, 1.0), first)


def _segment_fields(segment: Column, position: Column) -> Column:
    text = vr.string_at(segment, "$.text")
    return F.struct(
        position.cast("bigint").alias("segment_index"),
        _offset_ms(segment, "start_ms", "start", "from").alias("start_ms"),
        _offset_ms(segment, "end_ms", "end", "to").alias("end_ms"),
        tx.blank_to_null(text).alias("text"),
        _confidence(segment).alias("confidence"))


def _reject_reason(s: Column) -> Column:
    return (
        F.when(s["text"].isNull(), F.lit("missing or blank text"))
        .when(s["start_ms"].isNull(), F.lit("no start"))
        .when(s["end_ms"].isNull(), F.lit("no end"))
        .when(s["start_ms"] < 0, F.lit("negative start"))
        .when(s["end_ms"] < s["start_ms"], F.lit("end before start")))


def _language(doc: Column, model: Column) -> Column:
    stated = tx.blank_to_null(
        F.coalesce(vr.string_at(doc, "$.language"), vr.string_at(doc, "$.result.language")))
    return F.coalesce(stated, F.when(model.endswith(".en"), F.lit("en")))


def _full_text(doc: Column, kept: Column) -> Column:
    stated = tx.blank_to_null(
        F.coalesce(vr.string_at(doc, "$.text"), vr.string_at(doc, "$.result.text")))
    joined = F.array_join(F.transform(kept, lambda s: s["text"]), " ")
    return F.coalesce(stated, F.nullif(joined, F.lit("")))


def parse_documents(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Parse JSON documents (key columns, ``json``, ``model_name``).

    Adds language, text, segments, rejects and error. One document is one row, so
    its segments stay in the row as arrays: no shuffle is needed for the joined
    text. Segment positions are taken before rejects are dropped.
    """
    doc = F.col("doc")
    found = F.coalesce(vr.array_at(doc, "$.segments"), vr.array_at(doc, "$.transcription"))
    parsed = raw.withColumn("doc", F.try_parse_json("json"))
    # Segments are read into plain structs once; later steps only filter them.
    read = parsed.withColumn("read", F.transform(
        F.coalesce(found, F.array().cast("array<variant>")), _segment_fields))
    split = read.select(
        *keys, "model_name", "doc",
        F.filter("read", lambda s: _reject_reason(s).isNull()).alias("segments"),
        F.filter("read", lambda s: _reject_reason(s).isNotNull()).alias("rejects"))
    return split.select(
        *keys, "model_name", _language(doc, F.col("model_name")).alias("language"),
        _full_text(doc, F.col("segments")).alias("text"), "segments", "rejects",
        F.when(doc.isNull(), F.lit("unparsable JSON")).alias("json_error")
    ).withColumn("error", F.coalesce(
        "json_error",
        F.when((F.size("segments") == 0) & F.col("text").isNull(),
               F.lit("no text and no segments")))).drop("json_error")


def parsed_segments(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Accepted segments, one row each. A document with an error has none, so no filter on
    the error is needed (it would be pushed below the parse and repeat it)."""
    return parsed.select(*keys, F.inline("segments"))


def rejected_segments(parsed: DataFrame, keys: list[str]) -> DataFrame:
    rows = parsed.select(*keys, F.explode("rejects").alias("s"))
    return rows.select(*keys, "s.*", _reject_reason(F.col("s")).alias("reason"))


def rejected_documents(parsed: DataFrame, keys: list[str]) -> DataFrame:
    return parsed.where(F.col("error").isNotNull()).select(*keys, "error")


def with_position(segments: DataFrame) -> DataFrame:
    """Segments with their place in the transcript, from 0, whatever gaps the indexes have."""
    return running_before(segments, ["transcript_id"], "segment_index",
                          {"position": ("sum", F.lit(1).cast("bigint"))})


def segment_pages(segments: DataFrame, page_segments: int | None = None) -> DataFrame:
    """(transcript_id, page, segments): segments nested in order, by transcript or, with
    ``page_segments``, by so many of them. (transcript_id, segment_index) is unique."""
    item = F.struct("segment_index", "start_ms", "end_ms", "text")
    nested = F.array_sort(F.collect_list(item)).alias("segments")
    if page_segments is None:
        return segments.groupBy("transcript_id").agg(nested).select(
            "transcript_id", F.lit(0).cast("bigint").alias("page"), "segments")
    page = F.call_function("div", F.col("position"), F.lit(page_segments).cast("bigint"))
    return with_position(segments).groupBy("transcript_id", page.alias("page")).agg(nested)


def heads_with_pages(heads: DataFrame, segments: DataFrame,
                     page_segments: int | None = None) -> DataFrame:
    """Rows of ``heads`` (with transcript_id) once per page of their segments, with page,
    parts (how many pages there are) and segments. Transcripts without segments keep one row
    with an empty array."""
    pages = segment_pages(segments, page_segments)
    joined = heads.join(pages, "transcript_id", "left")
    if page_segments is None:
        parts = F.lit(1).cast("bigint")
    else:
        counts = segments.groupBy("transcript_id").agg(
            F.ceil(F.count("*") / page_segments).cast("bigint").alias("parts"))
        joined = joined.join(counts, "transcript_id", "left")
        parts = F.coalesce("parts", F.lit(1))
    empty = F.array().cast(pages.schema["segments"].dataType)
    return joined.select(*heads.columns, F.coalesce("page", F.lit(0)).alias("page"),
                         parts.alias("parts"), F.coalesce("segments", empty).alias("segments"))


def page_text(segments: Column, trim: bool = True) -> Column:
    """Segment texts of a page joined by one space."""
    texts = F.transform(segments, lambda s: tx.trim_space(s["text"]) if trim else s["text"])
    if trim:
        texts = F.filter(texts, lambda t: t != "")
    return F.array_join(texts, " ")


def transcript_preview(transcripts: DataFrame, segments: DataFrame) -> DataFrame:
    """recording_id, preview: the transcript text, else its untrimmed segment texts joined by
    a space, else an empty text."""
    has_text = F.coalesce(F.col("text"), F.lit("")) != ""
    stated = transcripts.where(has_text).select("recording_id", F.col("text").alias("preview"))
    without = transcripts.where(~has_text).select(F.col("id").alias("transcript_id"), "recording_id")
    wanted = segments.join(without, "transcript_id", "left_semi")
    joined = heads_with_pages(without, wanted).select(
        "recording_id", page_text(F.col("segments"), trim=False).alias("preview"))
    return stated.unionByName(joined)
