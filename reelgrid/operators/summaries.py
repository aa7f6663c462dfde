"""Summary payloads, their guardrails, and parsing of summary outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions import display as dp
from reelgrid.functions import text as tx
from reelgrid.functions import variants as vr
from reelgrid.operators.transcripts import heads_with_pages, page_text

# Outputs a payload asks for.
REQUESTED_OUTPUTS = ("summary", "action_items", "decisions", "questions", "risks", "chapters")
# List outputs of a summary.
LIST_OUTPUTS = ("action_items", "decisions", "questions", "risks", "chapters")
# Key fragments a payload must not contain.
FORBIDDEN_KEY_FRAGMENTS = ("path", "directory", "media", "audio", "video", "thumbnail", "raw_json")
# Text markers of a media path.
MEDIA_PATH_MARKERS = (
    ".mp4", ".mov", ".mkv", ".webm", ".avi", ".mfrv", ".mfcv", ".pcm", ".wav", ".mp3", ".m4a",
    ".flac", ".jpg", ".jpeg", ".png", ".webp", "temp/recording-sessions/")
# Starts and parts of a text that make it a likely path.
PATH_STARTS = ("/users/", "/var/", "/tmp/")
PATH_PARTS = (":/", "recordings/")
# Keys looked up, in order, for an item's title and details.
TITLE_KEYS = ("title", "text", "summary", "question", "risk", "decision", "action", "description")
OWNER_KEYS = ("owner", "due", "status", "priority")
REASON_KEYS = ("details", "rationale", "reason")

# A JSON string literal, with the colon after it where it is a key.
LITERAL_PATTERN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?'
TOKEN_PATTERN = LITERAL_PATTERN + r"|[{}\[\],]"
KEY_PATTERN = "|".join(FORBIDDEN_KEY_FRAGMENTS)
START_PATTERN = f"^[{tx.SPACE_CLASS}]*({'|'.join(PATH_STARTS)})"


def likely_media_path(text: Column) -> Column:
    """True for a text that starts like a path or holds any marker of one. Plain substring
    tests on the text brought to one form are far cheaper on long texts than one pattern of
    many branches."""
    def marked(normal: Column) -> Column:
        found = normal.rlike(START_PATTERN)
        for part in PATH_PARTS + MEDIA_PATH_MARKERS:
            found = found | normal.contains(part)
        return found

    return tx.let(F.replace(F.lower(text), F.lit("\\"), F.lit("/")), marked)


def summary_payloads(recordings: DataFrame, transcripts: DataFrame, segments: DataFrame,
                     notes: DataFrame | None = None,
                     page_segments: int | None = None) -> DataFrame:
    """recording_id, part, parts, payload, error.

    ``payload`` is JSON text: one for a recording with its whole text and segments. With
    ``page_segments`` a transcript of more segments goes in several parts, by place, each
    with its own segments and their text. A payload the guardrail refuses is not returned;
    its error says so.
    """
    t = transcripts.select(
        F.col("id").alias("transcript_id"), "recording_id", "language", "model_name",
        F.col("text").alias("stored"), F.col("status").alias("transcript_status"))
    r = recordings.select(F.col("id").alias("recording_id"), "title", "status", "captured_at",
                          "duration_ms", "completed_at")
    words = segments.groupBy("transcript_id").agg(
        F.bool_or(tx.has_words(F.col("text"))).alias("has_words"))
    heads = r.join(t, "recording_id").join(words, "transcript_id", "left")
    if notes is None:
        heads = heads.withColumn("notes", F.lit(None).cast("string"))
    else:
        heads = heads.join(notes.select("recording_id", "notes"), "recording_id", "left")
    ready = segments.join(t.where("transcript_status = 'completed'").select("transcript_id"),
                          "transcript_id", "left_semi")
    joined = heads_with_pages(heads, ready, page_segments)
    part = F.col("page")
    stored = F.col("stored")
    body = F.when(stored.isNull() | (F.col("parts") > 1),
                  page_text(F.col("segments"))).otherwise(stored)
    usable = F.when(stored.isNull(), F.coalesce("has_words", F.lit(False))).otherwise(
        tx.has_words(stored))
    base = joined.select("*", part.alias("part"), body.alias("body"), usable.alias("usable"))
    error = (
        F.when(F.col("transcript_status") != "completed",
               F.lit("a completed transcript is required"))
        .when(~F.col("usable"), F.lit("transcript text is required")))
    items = F.transform(
        "segments",
        lambda s: F.struct(s["segment_index"].alias("index"), s["start_ms"].alias("startMs"),
                           s["end_ms"].alias("endMs"), s["text"].alias("text")))
    payload = F.to_json(
        F.struct(
            F.struct(F.col("recording_id").alias("id"), "title", "status",
                     F.col("captured_at").alias("capturedAt"),
                     F.col("duration_ms").alias("durationMs"),
                     F.col("completed_at").alias("completedAt")).alias("recording"),
            F.struct(F.col("transcript_id").alias("id"), "language",
                     F.col("model_name").alias("modelName"), F.col("body").alias("text"),
                     items.alias("segments")).alias("transcript"),
            tx.blank_to_null(F.col("notes")).alias("userNotes"),
            F.array(*map(F.lit, REQUESTED_OUTPUTS)).alias("requestedOutputs")),
        {"ignoreNullFields": "false"})
    made = base.select("recording_id", "part", "parts", error.alias("stated"),
                       F.when(error.isNull(), payload).alias("made"))
    checked = made.withColumn("error", F.coalesce("stated", F.when(
        refused(F.col("made")), F.lit("payload holds a media path or field"))))
    return checked.select("recording_id", "part", "parts", "error",
                          F.when(F.col("error").isNull(), F.col("made")).alias("payload"))


def _plain(literal: Column) -> Column:
    """Text of a string literal; null where its escapes are no JSON."""
    text = F.regexp_replace(literal, r'^"|"\s*:?$', "")
    whole = F.from_json(F.concat(F.lit('["'), text, F.lit('"]')), "array<string>")
    return F.when(text.contains("\\"), F.get(whole, 0)).otherwise(text)


def _bad_key(literal: Column) -> Column:
    return F.coalesce(F.lower(_plain(literal)).rlike(KEY_PATTERN), F.lit(True))


def _bad_value(literal: Column) -> Column:
    """Every path marker has a slash or a dot, or escapes that may become one; literals without
    them are not looked into."""
    worth = literal.contains("/") | literal.contains(".") | literal.contains("\\")
    return F.when(worth, F.coalesce(likely_media_path(_plain(literal)), F.lit(True))).otherwise(False)


def refused(payload: Column) -> Column:
    """Whether a payload is no JSON, or holds a forbidden key or a likely media path at any
    depth. One pass over its string literals; one that a colon follows is a key."""
    found = F.regexp_extract_all(payload, F.lit(LITERAL_PATTERN), F.lit(0))
    bad = F.exists(found, lambda x: F.when(x.endswith(":"), _bad_key(x)).otherwise(_bad_value(x)))
    return F.try_parse_json(payload).isNull() | bad


VIOLATIONS = "array<struct<location:string,kind:string>>"


def _location(path: Column) -> Column:
    """``$`` and the fields and places of the open objects and lists."""
    return F.concat(F.lit("$"), F.array_join(F.transform(path, lambda step: F.coalesce(
        F.concat(F.lit("."), step["name"]), F.concat(F.lit("["), step["at"].cast("string"), F.lit("]")))), ""))


def violations(payload: Column) -> Column:
    """Location and kind of each violation of a JSON text, in document order.

    One fold over its literals and brackets: the state holds a step for each open object (the
    field it is at) or list (the place it is at), and what was found so far.
    """
    step = "struct<name:string,at:int>"
    none = F.lit(None)
    tokens = F.transform(
        F.regexp_extract_all(payload, F.lit(TOKEN_PATTERN), F.lit(0)),
        lambda x: tx.let(x.endswith(":"), lambda key: F.struct(
            F.when(x.startswith('"'), F.when(key, "key").otherwise("value")).otherwise(x).alias("kind"),
            F.when(key, _plain(x)).alias("name"),
            F.when(~x.startswith('"'), False).when(key, _bad_key(x)).otherwise(_bad_value(x)).alias("bad"))))
    start = F.struct(F.array().cast(f"array<{step}>").alias("path"), F.array().cast(VIOLATIONS).alias("found"))

    def fold(state: Column, token: Column) -> Column:
        path, kind = state["path"], token["kind"]
        outer = F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))

        def opened(name: Column, at: Column) -> Column:
            return F.array(F.struct(name.cast("string").alias("name"), at.cast("int").alias("at")))

        last = F.get(path, F.size(path) - 1)
        moved = (
            F.when(kind == "value", path)
            .when(kind == "key", F.concat(outer, opened(F.coalesce(token["name"], F.lit("")), none)))
            .when(kind == "{", F.concat(path, opened(F.lit(""), none)))
            .when(kind == "[", F.concat(path, opened(none, F.lit(0))))
            .when((kind == ",") & last["at"].isNotNull(), F.concat(outer, opened(none, last["at"] + 1)))
            .when(kind == ",", path)
            .otherwise(outer))
        where = _location(F.when(kind == "key", outer).otherwise(path))
        found = F.when(token["bad"], F.concat(state["found"], F.array(F.struct(
            where.alias("location"), kind.alias("kind"))))).otherwise(state["found"])
        return F.struct(moved.alias("path"), found.alias("found"))

    return F.aggregate(tokens, start, fold, lambda state: state["found"])


def _violations(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the array of violations. Only refused payloads are walked."""
    payload = F.col("payload")
    unreadable = F.array(F.struct(F.lit("$").alias("location"), F.lit("unreadable").alias("kind")))
    readable = F.try_parse_json(payload).isNotNull()
    walked = tx.let(violations(payload), lambda v: F.when(F.size(v) > 0, v).otherwise(unreadable))
    found = F.when(payload.isNull() | ~readable, unreadable).when(refused(payload), walked).otherwise(
        F.array().cast(VIOLATIONS))
    return payloads.select(*keys, found.alias("found"))


def guardrail_violations(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """keys, location, kind for each forbidden key (``key``, located by its parent), likely media path
    (``value``), and for a payload that is missing or no JSON (``unreadable``)."""
    return _violations(payloads, keys).select(*keys, F.inline("found"))


def guardrail_verdicts(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """One row per payload: accepted, number of violations and the location of the first in
    document order."""
    return _violations(payloads, keys).select(
        *keys, (F.size("found") == 0).alias("accepted"),
        F.size("found").cast("bigint").alias("violations"),
        F.get("found", 0)["location"].alias("first_location"))


def strip_fence(content: Column) -> Column:
    """Reply text without a surrounding code fence."""
    opened = tx.trim_space(F.regexp_replace(tx.trim_space(content), "^```(json)?", ""))
    return tx.trim_space(F.regexp_replace(opened, "```$", ""))


def _list_json(reply: Column, key: str) -> Column:
    found = vr.leaf(reply, f"$.{key}")
    missing = found.isNull() | (vr.kind(found) == "VOID")
    return (F.when(missing, F.lit("[]"))
            .when(vr.kind(found).startswith("ARRAY"), F.to_json(found))
            .otherwise(F.concat(F.lit("["), F.to_json(found), F.lit("]"))))


def parse_replies(replies: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """keys, summary_text, the five list columns as JSON text, error."""
    parsed = replies.select(*keys, F.try_parse_json(strip_fence(F.col(content))).alias("reply"))
    reply = F.col("reply")
    stated = F.coalesce(vr.leaf(reply, "$.summary"), vr.leaf(reply, "$.summary_text"))
    shown = F.when(vr.kind(stated) == "STRING", F.try_variant_get(stated, "$", "string")
                   ).otherwise(F.to_json(stated))
    rows = parsed.select(
        *keys, "reply", F.when(tx.trim_space(shown) != "", shown).alias("summary_text"))
    error = (F.when(reply.isNull(), F.lit("reply is not valid JSON"))
             .when(F.col("summary_text").isNull(), F.lit("reply has no summary")))
    lists = [F.when(F.col("summary_text").isNotNull(), _list_json(reply, key)).alias(f"{key}_json")
             for key in LIST_OUTPUTS]
    return rows.select(*keys, "summary_text", *lists, error.alias("error"))


def _first_string(item: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[tx.blank_to_null(vr.string_at(item, f"$.{n}")) for n in names])


def _plain_number(item: Column, *names: str) -> Column:
    """First of the named values that is present; its number, or null if it is none."""
    values = [vr.leaf(item, f"$.{n}") for n in names]
    first = F.coalesce(*[F.when(vr.kind(v) != "VOID", v) for v in values])
    return F.when(vr.is_number(first), F.try_variant_get(first, "$", "double"))


def _time_range(item: Column) -> Column:
    start = _plain_number(item, "start_ms", "startMs")
    end = _plain_number(item, "end_ms", "endMs")
    return F.coalesce(
        F.concat(dp.segment_time(start), F.lit(" - "), dp.segment_time(end)),
        dp.segment_time(start), dp.segment_time(end))


def list_items(lists: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Items of a JSON list column as rows: keys, position, primary, detail."""
    present = lists.where(F.coalesce(F.col(column), F.lit("")) != "")
    parsed = present.select(*keys, column, F.try_parse_json(column).alias("v"))
    whole = F.array(F.col("v"))
    items = parsed.where(F.col("v").isNotNull()).select(
        *keys, F.posexplode(F.coalesce(vr.array_at(F.col("v"), "$"), whole)).alias("position", "item"))
    item = F.col("item")
    kind = vr.kind(item)
    is_object = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    primary = (
        F.when(kind == "STRING", F.try_variant_get(item, "$", "string"))
        .when(vr.is_number(item) | (kind == "BOOLEAN"), F.to_json(item))
        .when(is_object, F.coalesce(_first_string(item, TITLE_KEYS), F.to_json(item)))
        .otherwise(F.lit("")))
    detail = F.when(is_object, F.concat_ws(
        " / ", _time_range(item), _first_string(item, OWNER_KEYS),
        _first_string(item, REASON_KEYS))).otherwise(F.lit(""))
    rows = items.select(*keys, F.col("position").cast("bigint").alias("position"),
                        primary.alias("primary"), detail.alias("detail"))
    broken = parsed.where(F.col("v").isNull()).select(
        *keys, F.lit(0).cast("bigint").alias("position"), F.col(column).alias("primary"),
        F.lit("").alias("detail"))
    return rows.where(F.col("primary") != "").unionByName(broken)
