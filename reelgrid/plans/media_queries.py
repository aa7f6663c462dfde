"""Registered queries: timelines, mixing, media checks, capture statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.functions import variants as vr
from reelgrid.operators import audio_blocks as ab
from reelgrid.operators import media as md
from reelgrid.operators import timeline as tl
from reelgrid.operators.running import running_before
from reelgrid.plans import stand_ins as st
from reelgrid.session import shared_folder
from reelgrid.sources import raw_capture as raw

RATE = 16000


def event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audio blocks of one stream per user, in event order."""
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return st.given(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("stream_id"),
        F.col("event_id").alias("block_seq"),
        seconds.alias("elapsed_ms"),
        F.lit(RATE).cast("bigint").alias("sample_rate"),
        F.round(F.col("value") * 10000).cast("bigint").alias("frames"))


_BLOCK_CTE = """
blk AS (SELECT 'u' || user_id AS stream_id, event_id AS block_seq,
          (epoch_us(ts) - 1704067200000000) // 1000000 AS elapsed_ms, CAST(round(value * 10000) AS BIGINT) AS frames FROM events),
st AS (SELECT *, (elapsed_ms * 16000 + 500) // 1000 AS start_frame FROM blk),
cu AS (SELECT *, coalesce(max(start_frame + frames) OVER (PARTITION BY stream_id ORDER BY block_seq
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS timeline_end FROM st),
pl AS (SELECT *, greatest(start_frame - timeline_end, 0) AS gap_frames,
         least(greatest(timeline_end - start_frame, 0), frames) AS skip_frames,
         greatest(start_frame + frames - greatest(start_frame, timeline_end), 0) AS kept_frames,
         greatest(start_frame, timeline_end) AS out_frame FROM cu)"""


def timeline_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.place_blocks(event_blocks(spark, sf_dir), chunk_width=1000).select(
        "stream_id", "block_seq", "start_frame", "timeline_end", "gap_frames", "skip_frames",
        "kept_frames", "out_frame")


BLOCKS_SQL = st.with_sql(_BLOCK_CTE) + """
SELECT stream_id, block_seq, start_frame, timeline_end, gap_frames, skip_frames, kept_frames, out_frame FROM pl"""


def timeline_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.timeline_lengths(tl.place_blocks(event_blocks(spark, sf_dir)))


LENGTHS_SQL = st.with_sql(_BLOCK_CTE) + """
SELECT stream_id, max(start_frame + frames) AS frames, CAST(sum(gap_frames) AS BIGINT) AS silent_frames,
       CAST(sum(skip_frames) AS BIGINT) AS dropped_frames FROM pl GROUP BY stream_id"""


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as gap-free stereo samples, one stream per user and event type. Streams of
    errors are silent."""
    rows = st.given(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), "event_type").alias("stream_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("recording_id"),
        "event_id", F.when(F.col("event_type") == "error", F.lit(0.0)).otherwise(F.col("value") / 500)
        .alias("left"))
    counted = running_before(rows, ["stream_id"], "event_id", {"frame": ("sum", F.lit(1))})
    return counted.select("stream_id", "recording_id", F.col("frame").cast("bigint").alias("frame"),
                          "left", (-F.col("left") / 2).alias("right"))


_SAMPLE_CTE = """
sm AS (SELECT 'u' || user_id || '-' || event_type AS stream_id, 'u' || user_id AS recording_id,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS frame,
         CASE WHEN event_type = 'error' THEN 0.0 ELSE value / 500 END AS l FROM events),
lv AS (SELECT stream_id, any_value(recording_id) AS recording_id, count(*) AS n, max(l) AS peak FROM sm GROUP BY stream_id)"""


def stored_blocks(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Sample rows gathered into blocks and stored, as captured audio is."""
    path = shared_folder(spark, f"blocks-{uuid.uuid4().hex}")
    ab.blocks_of_rows(rows, tl.STEREO, "stream_id").write.parquet(path)
    return spark.read.parquet(path)


def stream_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = ab.blocks_of_rows(event_samples(spark, sf_dir), tl.STEREO, "stream_id")
    return ab.levels(blocks, "stream_id", tl.SILENCE).withColumn("peak", F.round("peak", 9))


LEVELS_SQL = st.with_sql(_SAMPLE_CTE) + """
SELECT stream_id, n AS frames, round(peak, 9) AS peak, peak <= 1.1920929e-07 AS is_silent FROM lv"""


def mix_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each user gathered into blocks, mixed by cells, and opened again."""
    blocks = stored_blocks(spark, event_samples(spark, sf_dir))
    sources = blocks.select("stream_id", F.split_part("stream_id", F.lit("-"), F.lit(1)).alias("recording_id")).distinct()
    gains = tl.source_gains(ab.levels(blocks, "stream_id", tl.SILENCE), sources)
    mixed = ab.rows_of_blocks(ab.mix(blocks, gains), tl.STEREO, "recording_id")
    return mixed.select("recording_id", "frame", F.round("left", 9).alias("left"),
                        F.round("right", 9).alias("right"))


MIX_SQL = st.with_sql(_SAMPLE_CTE, """
g AS (SELECT stream_id, recording_id, 1.0 / count(*) OVER (PARTITION BY recording_id) AS gain FROM lv WHERE peak > 1.1920929e-07)""") + """
SELECT g.recording_id, frame, round(sum(l * CAST(gain AS DOUBLE)), 9) AS "left", round(sum(-l / 2 * CAST(gain AS DOUBLE)), 9) AS "right"
FROM sm JOIN g ON g.stream_id = sm.stream_id GROUP BY g.recording_id, frame"""


def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of two rates brought to 44.1 kHz."""
    blocks = stored_blocks(spark, event_samples(spark, sf_dir))
    rates = blocks.select("stream_id").distinct().withColumn(
        "sample_rate", F.when(F.col("stream_id").endswith("k"), 48000).otherwise(22050).cast("bigint"))
    out = ab.rows_of_blocks(ab.resample(blocks, rates, 44100, tl.STEREO, "stream_id"), tl.STEREO, "stream_id")
    return out.select("stream_id", "frame", F.round("left", 9).alias("left"),
                      F.round("right", 9).alias("right"))


RESAMPLE_SQL = st.with_sql(_SAMPLE_CTE, """
n AS (SELECT stream_id, n, CASE WHEN stream_id LIKE '%k' THEN 48000 ELSE 22050 END AS r FROM lv),
o AS (SELECT stream_id, n, r, unnest(range(0, (n * 44100 + r // 2) // r)) AS frame FROM n),
p AS (SELECT *, frame * r // 44100 AS lo, least(frame * r // 44100 + 1, n - 1) AS hi, frame * r / 44100.0 - frame * r // 44100 AS f FROM o)""") + """
SELECT p.stream_id, p.frame, round(a.l + (b.l - a.l) * f, 9) AS "left", round(-a.l / 2 + (-b.l / 2 + a.l / 2) * f, 9) AS "right"
FROM p JOIN sm a ON a.stream_id = p.stream_id AND a.frame = lo JOIN sm b ON b.stream_id = p.stream_id AND b.frame = hi"""


def speech_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    loud = event_samples(spark, sf_dir).withColumn("left", F.col("left") * 8).withColumn(
        "right", F.col("right") * 3)
    return tl.speech_samples(loud, 48000, "stream_id")


SPEECH_SQL = st.with_sql(_SAMPLE_CTE, """
mo AS (SELECT stream_id, frame, (l * 8 + (-l / 2) * 3) / 2 AS m FROM sm),
o AS (SELECT stream_id, n, unnest(range(0, (n * 16000 + 24000) // 48000)) AS frame FROM lv),
v AS (SELECT o.stream_id, o.frame, greatest(least(m, 1.0), -1.0) AS m
      FROM o JOIN mo ON mo.stream_id = o.stream_id AND mo.frame = o.frame * 3)""") + """
SELECT stream_id, frame, CAST(round(m * CASE WHEN m < 0 THEN 32768 ELSE 32767 END) AS INTEGER) AS sample FROM v"""


PCM_FORMATS = ("i8", "u8", "i16", "u16", "i24", "u24", "i32", "u32", "f32", "f64", "i64")


def pcm_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts read as PCM bytes in all formats: frames, sums of both sides as 16-bit
    levels, and errors. Three texts in four are filled up with spaces to whole frames."""
    docs = st.given(spark, sf_dir, "documents").select(
        "doc_id", "text", F.element_at(F.array(*map(F.lit, PCM_FORMATS)), (F.col("doc_id") % 11 + 1)
                                       .cast("int")).alias("sample_format"),
        (F.col("doc_id") % 3 + 1).alias("channels"))
    size = F.try_element_at(F.create_map(*[F.lit(x) for pair in tl.SAMPLE_BYTES.items() for x in pair]),
                            F.col("sample_format")) * F.col("channels")
    missing = F.when(F.col("doc_id") % 4 != 0, F.pmod(-F.octet_length("text"), size)).otherwise(0)
    blocks = docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("stream_id"),
        F.lit(0).cast("bigint").alias("block_seq"), F.lit(0).cast("bigint").alias("elapsed_ms"),
        F.concat("text", F.repeat(F.lit(" "), F.coalesce(missing, F.lit(0)).cast("int"))).cast("binary")
        .alias("bytes"), "sample_format", "channels")

    def total(side: str):
        return F.aggregate(side, F.lit(0).cast("bigint"), lambda s, x: s + tl.sixteen_bit(x)).alias(f"{side}_sum")

    return raw.decode_blocks(blocks).select("stream_id", "frames", total("left"), total("right"), "error")


def _bits_sql(width: int, exponent: int, mantissa: int, bias: int) -> str:
    """Value of an IEEE number of so many bytes, from its bits ``u``."""
    e, m = f"((u >> {mantissa}) & {2 ** exponent - 1})", f"(u & {2 ** mantissa - 1})::DOUBLE"
    sign = f"CASE WHEN (u >> {width * 8 - 1}) & 1 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END"
    return (f"CASE WHEN {e} = {2 ** exponent - 1} THEN 'inf'::DOUBLE WHEN {e} = 0 THEN {sign} * {m} * "
            f"pow(2.0, {1 - bias - mantissa}) ELSE {sign} * (1.0::DOUBLE + {m} / {2.0 ** mantissa!r}::DOUBLE) * "
            f"pow(2.0, ({e})::INTEGER - {bias}) END")


_SIGNED = "(CASE WHEN u >= {half} THEN u::HUGEINT - {full} ELSE u::HUGEINT END)::DOUBLE"
_VALUES = {"i8": (8, True), "u8": (8, False), "i16": (16, True), "u16": (16, False),
           "i32": (32, True), "u32": (32, False)}
_DECODED = "\n".join(
    [f"WHEN '{f}' THEN " + (_SIGNED.format(half=2 ** (b - 1), full=2 ** b) + f" / {2.0 ** (b - 1)!r}::DOUBLE" if signed
                            else f"(u::DOUBLE - {2.0 ** (b - 1)!r}::DOUBLE) / {2.0 ** (b - 1)!r}::DOUBLE")
     for f, (b, signed) in _VALUES.items()]
    + [f"WHEN 'i24' THEN {_SIGNED.format(half=2 ** 31, full=2 ** 32)} / 8388608.0::DOUBLE",
       f"WHEN 'u24' THEN ({_SIGNED.format(half=2 ** 31, full=2 ** 32)} - 8388608.0::DOUBLE) / 8388608.0::DOUBLE",
       f"WHEN 'f32' THEN {_bits_sql(4, 8, 23, 127)}", f"WHEN 'f64' THEN {_bits_sql(8, 11, 52, 1023)}"])
_LEVEL_SQL = ("CAST(round(CASE WHEN abs({0}) > 3.4028234663852886e38::FLOAT THEN 0 WHEN {0} < 0 THEN "
              "greatest({0}::DOUBLE, -1.0) * 32768 ELSE least({0}::DOUBLE, 1.0) * 32767 END) AS BIGINT)")
DECODE_SQL = f"""
WITH b AS (SELECT doc_id, text, doc_id % 3 + 1 AS ch, [{", ".join(repr(f) for f in PCM_FORMATS)}][doc_id % 11 + 1] AS f,
             [1, 1, 2, 2, 4, 4, 4, 4, 4, 8, NULL][doc_id % 11 + 1] AS w FROM documents),
p AS (SELECT *, text || repeat(' ', coalesce(CASE WHEN doc_id % 4 <> 0 THEN (w * ch - strlen(text) % (w * ch)) % (w * ch) END, 0)) AS t FROM b),
q AS (SELECT doc_id, ch, f, w, strlen(t) AS n, hex(encode(t)) AS h FROM p),
r AS (SELECT *, unnest(range(n // w)) AS k FROM q WHERE n % (w * ch) = 0),
s AS (SELECT doc_id, ch, f, k, CAST('0x' || list_aggregate(list_transform(range(w), lambda j: h[2 * (k * w + w - 1 - j) + 1:2 * (k * w + w - 1 - j) + 2]), 'string_agg', '') AS UBIGINT) AS u FROM r),
v AS (SELECT doc_id, ch, k, CASE f {_DECODED} END AS x FROM s),
x AS (SELECT doc_id, ch, k // ch AS frame, k % ch AS c, CASE WHEN abs(x) >= 3.4028235677973366e38 THEN sign(x) * 'inf'::FLOAT ELSE x::FLOAT END AS x FROM v),
y AS (SELECT doc_id, frame, ch, max(CASE WHEN c = 0 THEN x END) AS a, max(CASE WHEN c = 1 THEN x END) AS b, max(CASE WHEN c = 2 THEN x END) AS d FROM x GROUP BY ALL),
z AS (SELECT doc_id, CASE WHEN ch < 3 THEN a ELSE ((a + b) + d) / 3::FLOAT END AS l, CASE ch WHEN 1 THEN a WHEN 2 THEN b ELSE ((a + b) + d) / 3::FLOAT END AS r FROM y),
t AS (SELECT doc_id, CAST(sum({_LEVEL_SQL.format('l')}) AS BIGINT) AS left_sum, CAST(sum({_LEVEL_SQL.format('r')}) AS BIGINT) AS right_sum FROM z GROUP BY doc_id)
SELECT 'd' || doc_id AS stream_id, CASE WHEN n % (w * ch) = 0 THEN n // (w * ch) END AS frames,
       CASE WHEN n % (w * ch) = 0 THEN coalesce(left_sum, 0) END AS left_sum, CASE WHEN n % (w * ch) = 0 THEN coalesce(right_sum, 0) END AS right_sum,
       CASE WHEN w IS NULL THEN 'unsupported sample format' WHEN n % (w * ch) <> 0 THEN 'block not aligned to frames' END AS error
FROM q LEFT JOIN t USING (doc_id)"""


def requested_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = st.event_sessions(spark, sf_dir).withColumn(
        "audio_mode", F.coalesce(F.nullif("audio_mode", F.lit("")), F.lit("none")))
    found = tl.requested_streams(rows)
    problem = tl.format_problem(F.col("sample_rate"), F.col("channels"), F.col("sample_format"))
    return found.withColumn("problem", problem)


STREAMS_SQL = st.with_sql(st.SESSION_SQL, """
e AS (SELECT * REPLACE (coalesce(nullif(audio_mode, ''), 'none') AS audio_mode) FROM event_sessions),
q AS (SELECT id AS session_id, 'microphone audio' AS label, coalesce(microphone_audio_path, audio_path) AS path,
        microphone_audio_sample_rate AS sample_rate, microphone_audio_channels AS channels, microphone_audio_sample_format AS sample_format
      FROM e WHERE audio_mode IN ('microphone', 'microphone_and_source')
      UNION ALL SELECT id, 'microphone audio', audio_path, audio_sample_rate, audio_channels, audio_sample_format
      FROM e WHERE audio_mode = 'none' AND audio_path IS NOT NULL
      UNION ALL SELECT id, 'source audio', source_audio_path, source_audio_sample_rate, source_audio_channels, source_audio_sample_format
      FROM e WHERE audio_mode IN ('source', 'microphone_and_source'))""") + """
SELECT *, CASE WHEN path IS NULL THEN label || ' was requested but no capture file was recorded' END AS warning,
       CASE WHEN coalesce(sample_rate, 0) <= 0 THEN 'missing sample rate' WHEN coalesce(channels, 0) <= 0 THEN 'missing channels'
         WHEN sample_format IS NULL THEN 'missing sample format' WHEN sample_format = 'i64' THEN 'unsupported sample format' END AS problem
FROM q"""


def stream_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = st.event_sessions(spark, sf_dir).withColumn(
        "audio_mode", F.coalesce(F.nullif("audio_mode", F.lit("")), F.lit("none")))
    number = F.substring("id", 2, 20).cast("bigint")
    levels = rows.where((number % 2 == 1) & (F.coalesce("audio_path", F.lit("")) != "")).select(
        F.col("audio_path").alias("path"), (number % 4 == 3).alias("is_silent"))
    return tl.stream_warnings(tl.requested_streams(rows), levels).groupBy("label", "reason").agg(
        F.count("*").alias("streams"))


WARNINGS_SQL = STREAMS_SQL.split("\nSELECT *")[0].replace("q AS (", """
lv AS (SELECT audio_path AS lpath, CAST(substr(id, 2) AS BIGINT) % 4 = 3 AS is_silent FROM e
       WHERE CAST(substr(id, 2) AS BIGINT) % 2 = 1 AND coalesce(audio_path, '') <> ''),
q AS (""") + """
SELECT label, reason, count(*) AS streams FROM (
  SELECT label, CASE WHEN path IS NULL THEN label || ' was requested but no capture file was recorded'
    WHEN coalesce(sample_rate, 0) <= 0 THEN 'missing sample rate' WHEN coalesce(channels, 0) <= 0 THEN 'missing channels'
    WHEN sample_format IS NULL THEN 'missing sample format' WHEN sample_format = 'i64' THEN 'unsupported sample format'
    WHEN is_silent IS NULL THEN 'no audio samples' WHEN is_silent THEN 'only silence' END AS reason
  FROM q LEFT JOIN lv ON lpath = path) WHERE reason IS NOT NULL GROUP BY ALL"""


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = st.event_sessions(spark, sf_dir)
    audio = F.when(F.col("audio_sample_rate") > 0, F.col("audio_byte_count") * 10)
    hint = F.when(F.col("frame_count") > 0, F.col("duration_ms"))
    return s.select(
        "id", md.frames_duration(F.col("frame_count"), F.col("frame_rate")).alias("video_ms"),
        md.media_duration(F.col("frame_count"), F.col("frame_rate"), audio, hint).alias("duration_ms"))


DURATION_SQL = st.with_sql(st.SESSION_SQL, """
v AS (SELECT *, CASE WHEN frame_count > 0 THEN (frame_count * 1000 + 15) // 30 END AS video_ms,
        CASE WHEN audio_sample_rate > 0 THEN audio_byte_count * 10 END AS audio_ms FROM event_sessions)""") + """
SELECT id, video_ms, coalesce(greatest(video_ms, audio_ms), CASE WHEN frame_count > 0 THEN duration_ms END) AS duration_ms FROM v"""


def frame_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frame headers of one stream per user."""
    e, c = F.col("event_id"), F.round(F.col("value") * 100).cast("bigint")
    w = F.when(c % 17 == 0, F.lit(2)).when(c % 29 == 0, F.lit(0)).otherwise(F.lit(4)).cast("bigint")
    frames = st.given(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_id"), e.alias("frame_seq"),
        F.when(c % 13 == 0, 9).when(c % 2 == 0, 8).otherwise(7).cast("bigint").alias("format_code"),
        w.alias("width"), F.lit(3).cast("bigint").alias("height"),
        F.when(c % 19 == 0, F.lit(5)).otherwise(w * 12).cast("bigint").alias("byte_count"))
    return md.frame_report(md.check_frames(frames))


FRAME_SQL = """
WITH f AS (SELECT user_id AS stream_id, event_id AS frame_seq, CAST(round(value * 100) AS BIGINT) AS c FROM events),
g AS (SELECT *, CASE WHEN c % 17 = 0 THEN 2 WHEN c % 29 = 0 THEN 0 ELSE 4 END AS w FROM f),
h AS (SELECT *, first_value(w) OVER (PARTITION BY stream_id ORDER BY frame_seq) AS w0 FROM g),
r AS (SELECT *, CASE WHEN w = 0 THEN 'invalid size' WHEN w <> w0 THEN 'size changed'
        WHEN c % 13 <> 0 AND c % 2 <> 0 AND c % 19 = 0 THEN 'wrong byte count' WHEN c % 13 = 0 THEN 'unsupported format' END AS reason FROM h)
SELECT stream_id, count(*) AS frames, count(reason) AS bad_frames, min(CASE WHEN reason IS NOT NULL THEN frame_seq END) AS first_bad_seq,
       arg_min(reason, frame_seq) FILTER (reason IS NOT NULL) AS first_reason FROM r GROUP BY stream_id"""


def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as chunk manifests, one chunk per line."""
    rows = st.given(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    lines = F.split("text", "\n")
    k = F.col("conv_id") + F.col("turn")
    total = F.aggregate(lines, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    chunks = F.transform(lines, lambda x: F.struct(
        F.when(k % 14 == 0, F.lit("\t\u00a0")).when(k % 7 == 0, F.lit(" ")).otherwise(F.substring(x, 1, 5)).alias("path"),
        F.when(k % 11 == 0, F.lit(0)).otherwise(F.length(x)).cast("bigint").alias("frameCount")))
    manifests = rows.select(
        "conv_id", "turn", F.when(k % 2 == 0, "completed").otherwise("recording").alias("status"),
        F.when(k % 13 == 0, F.lit(0)).otherwise(F.lit(2)).cast("bigint").alias("width"),
        F.lit(2).cast("bigint").alias("height"), F.lit(30).cast("bigint").alias("frameRate"),
        F.when(k % 5 == 0, total + 1).otherwise(total).alias("frameCount"),
        F.when(k % 17 == 0, F.array().cast("array<struct<path:string,frameCount:bigint>>"))
        .otherwise(chunks).alias("chunks"))
    return md.check_manifests(manifests).select("conv_id", "turn", "problem", "warning")


MANIFEST_SQL = """
WITH m AS (SELECT conv_id, turn, conv_id + turn AS k, string_split(text, chr(10)) AS ls FROM conversations),
n AS (SELECT *, list_sum(list_transform(ls, lambda x: length(x))) AS total, list_bool_or(list_transform(ls, lambda x: trim(left(x, 5)) = '')) AS blank,
        list_bool_or(list_transform(ls, lambda x: length(x) = 0)) AS empty FROM m),
p AS (SELECT *, CASE WHEN k % 13 = 0 THEN 'invalid size or frame rate'
        WHEN k % 17 = 0 OR (total = 0 AND k % 5 <> 0) THEN 'no finished chunks'
        WHEN k % 7 = 0 OR blank THEN 'chunk without path' WHEN k % 11 = 0 OR empty THEN 'empty chunk'
        WHEN k % 5 = 0 THEN 'frame count mismatch' END AS problem FROM n)
SELECT conv_id, turn, problem, CASE WHEN problem IS NULL AND k % 2 <> 0 THEN 'recovered from an unfinished recording' END AS warning FROM p"""


def output_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = st.event_sessions(spark, sf_dir)
    w, h = F.col("width"), F.col("height")
    enc, cap = md.bounded_size(w, h, md.ENCODE_BOUND), md.bounded_size(w, h, md.CAPTURE_BOUND)
    box = md.letterbox(w, h, F.lit(1280), F.lit(720))
    return s.select(
        "id", enc["width"].alias("enc_w"), enc["height"].alias("enc_h"), cap["width"].alias("cap_w"),
        cap["height"].alias("cap_h"), md.thumbnail_height(w, h).alias("thumb_h"),
        box["width"].alias("box_w"), box["height"].alias("box_h"), box["x"].alias("box_x"),
        box["y"].alias("box_y"))


def _fit_sql(mw: int, mh: int, p: str) -> str:
    return f"""
    CASE WHEN ok THEN CASE WHEN w <= {mw} AND h <= {mh} THEN w WHEN w * {mh} > {mw} * h THEN {mw}
      ELSE greatest(least((w * {mh} + h // 2) // h, {mw}), 1) END END AS {p}w,
    CASE WHEN ok THEN CASE WHEN w <= {mw} AND h <= {mh} THEN h WHEN w * {mh} > {mw} * h
      THEN greatest(least((h * {mw} + w // 2) // w, {mh}), 1) ELSE {mh} END END AS {p}h"""


SIZES_SQL = st.with_sql(st.SESSION_SQL, f"""
a AS (SELECT id, width AS w, height AS h, coalesce(width > 0 AND height > 0, false) AS ok FROM event_sessions),
b AS (SELECT *, {_fit_sql(1920, 1080, 'e')}, {_fit_sql(1280, 720, 'c')},
        CASE WHEN w * 720 <= 1280 * h THEN greatest(least((w * 720 + h // 2) // h, 1280), 1) ELSE 1280 END AS bw,
        CASE WHEN w * 720 <= 1280 * h THEN 720 ELSE greatest(least((h * 1280 + w // 2) // w, 720), 1) END AS bh FROM a)""") + """
SELECT id, CASE WHEN ew <= 2 THEN greatest(ew, 1) ELSE ew - ew % 2 END AS enc_w, CASE WHEN eh <= 2 THEN greatest(eh, 1) ELSE eh - eh % 2 END AS enc_h,
       CASE WHEN cw <= 2 THEN greatest(cw, 1) ELSE cw - cw % 2 END AS cap_w, CASE WHEN ch <= 2 THEN greatest(ch, 1) ELSE ch - ch % 2 END AS cap_h,
       CASE WHEN w > 0 THEN greatest((h * 480 + w // 2) // w, 1) END AS thumb_h,
       CASE WHEN ok THEN bw END AS box_w, CASE WHEN ok THEN bh END AS box_h, CASE WHEN ok THEN (1280 - bw) // 2 END AS box_x,
       CASE WHEN ok THEN (720 - bh) // 2 END AS box_y FROM b"""


def capture_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, kind = F.round(F.col("value") * 100).cast("bigint"), F.col("event_type")
    return st.given(spark, sf_dir, "events").select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        F.col("event_id").alias("seq"),
        F.when(kind.isin("view", "click"), "frame").when(kind == "signup", "microphone")
        .when(kind == "purchase", "source").when(F.col("user_id") % 3 == 0, "error").otherwise("frame").alias("kind"),
        c.alias("byte_count"), (c % 100).alias("width"), (c % 50).alias("height"),
        F.concat(F.lit("fault "), c.cast("string")).alias("message"))


_CAPTURE_CTE = """
ce AS (SELECT 's' || user_id AS session_id, event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN 'frame'
         WHEN event_type = 'signup' THEN 'microphone' WHEN event_type = 'purchase' THEN 'source'
         WHEN user_id % 3 = 0 THEN 'error' ELSE 'frame' END AS kind, CAST(round(value * 100) AS BIGINT) AS c FROM events)"""


def capture_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.capture_stats(capture_events(spark, sf_dir))


CAPTURE_SQL = st.with_sql(_CAPTURE_CTE) + """
SELECT session_id, count(*) FILTER (kind = 'frame') AS frame_count,
       CAST(coalesce(sum(c) FILTER (kind = 'microphone'), 0) AS BIGINT) AS microphone_audio_byte_count,
       CAST(coalesce(sum(c) FILTER (kind = 'source'), 0) AS BIGINT) AS source_audio_byte_count,
       arg_max(c % 100, seq) FILTER (kind = 'frame') AS width, arg_max(c % 50, seq) FILTER (kind = 'frame') AS height,
       count(*) FILTER (kind = 'error') AS error_count, 'fault ' || arg_min(c, seq) FILTER (kind = 'error') AS first_error,
       CASE WHEN bool_or(kind = 'error') THEN 'failed' ELSE 'stopped' END AS status
FROM ce GROUP BY session_id"""


def failure_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.failure_messages(capture_events(spark, sf_dir))


FAILURE_SQL = st.with_sql(_CAPTURE_CTE) + """
SELECT session_id, seq, 'fault ' || c AS message FROM ce WHERE kind = 'error'"""


def clock_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock texts of events in both forms, read as milliseconds."""
    ts = F.col("ts")
    text = (F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "HH:mm:ss,SSS"))
            .when(F.col("event_id") % 3 == 1, F.date_format(ts, "mm:ss.SSS"))
            .otherwise(F.date_format(ts, "ss.SSS")))
    return st.given(spark, sf_dir, "events").select("event_id", vr.clock_ms(text).alias("ms"))


CLOCK_SQL = """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch_us(ts) // 1000 % 86400000 WHEN 1 THEN epoch_us(ts) // 1000 % 3600000 END AS ms
FROM events"""


QUERIES = {
    "timeline_blocks": (timeline_blocks, BLOCKS_SQL),
    "timeline_lengths": (timeline_lengths, LENGTHS_SQL),
    "stream_levels": (stream_levels, LEVELS_SQL),
    "mix_gain": (mix_gain, MIX_SQL),
    "resample": (resample, RESAMPLE_SQL),
    "speech_samples": (speech_samples, SPEECH_SQL),
    "pcm_decode": (pcm_decode, DECODE_SQL),
    "requested_streams": (requested_streams, STREAMS_SQL),
    "stream_warnings": (stream_warnings, WARNINGS_SQL),
    "durations": (durations, DURATION_SQL),
    "frame_check": (frame_check, FRAME_SQL),
    "manifest_check": (manifest_check, MANIFEST_SQL),
    "output_sizes": (output_sizes, SIZES_SQL),
    "capture_stats": (capture_stats, CAPTURE_SQL),
    "failure_messages": (failure_messages, FAILURE_SQL),
    "clock_texts": (clock_texts, CLOCK_SQL),
}
