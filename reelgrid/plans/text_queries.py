"""Registered queries: transcript JSON, summary payloads and replies, report texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.functions import display as dp
from reelgrid.functions import text as tx
from reelgrid.functions import variants as vr
from reelgrid.operators import summaries as sm
from reelgrid.operators import transcripts as tr
from reelgrid.plans import stand_ins as st

KEYS = ["conv_id", "turn"]


def transcript_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recogniser document per conversation turn, one segment per line of it.

    Even turns use the layout with seconds, odd ones the layout with offsets and clock
    texts. Some segments lack an end, run backwards or have odd confidences.
    """
    rows = st.given(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    lines = F.split("text", "\n")

    def seconds(line, i):
        base = i.cast("double") * 1.5 + 0.25
        return F.struct(
            F.when(i % 5 != 3, base).alias("start"),
            F.when(i % 7 == 6, base - 1.0).otherwise(base + 1.25).alias("end"),
            F.concat(F.lit(" "), line, F.lit("\t")).alias("text"),
            F.when(i % 3 == 0, F.lit(0.5)).when(i % 3 == 1, F.lit(1.5)).alias("confidence"),
            F.when(i % 2 == 0, F.lit("0.75")).alias("probability"))

    def clock(line, i):
        ms = i * 2250 + 125
        text = F.format_string("00:%02d:%02d,%03d", F.floor(ms / 60000), F.floor(ms / 1000) % 60,
                               ms % 1000)
        return F.struct(
            F.struct(text.alias("from"), F.lit("00:59:59.5").alias("to")).alias("timestamps"),
            F.when(i % 4 != 1, F.struct((ms + 1).cast("string").alias("from"),
                                        (ms + 900).alias("to"))).alias("offsets"),
            line.alias("text"), F.when(i % 2 == 0, F.lit(True)).alias("confidence"))

    even = F.to_json(F.struct(
        F.when(F.col("turn") % 4 == 0, F.lit(" fr ")).alias("language"),
        F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit(" "), "role", F.lit(" "))).alias("text"),
        F.transform(lines, seconds).alias("segments")))
    odd = F.to_json(F.struct(
        F.struct(F.lit("de").alias("language")).alias("result"),
        F.transform(lines, clock).alias("transcription")))
    return rows.select(
        *KEYS, F.when(F.col("turn") % 2 == 0, even)
        .when(F.col("conv_id") % 10 == 9, F.concat(F.lit("broken "), odd)).otherwise(odd).alias("json"),
        F.lit("small.en").alias("model_name"))


_LINES_CTE = """
lines AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM conversations),
seg AS (
  SELECT conv_id, turn, i AS segment_index, trim(line, ' \t\r\n') AS text,
         CASE WHEN turn % 2 = 0 THEN CASE WHEN i % 5 <> 3 THEN i * 1500 + 250 END
           ELSE CASE WHEN i % 4 <> 1 THEN i * 2250 + 126 ELSE i * 2250 + 125 END END AS start_ms,
         CASE WHEN turn % 2 = 0 THEN CASE WHEN i % 7 = 6 THEN i * 1500 + 250 - 1000 ELSE i * 1500 + 250 + 1250 END
           ELSE CASE WHEN i % 4 <> 1 THEN i * 2250 + 125 + 900 ELSE 3599500 END END AS end_ms,
         CASE WHEN turn % 2 = 0 THEN CASE WHEN i % 3 = 0 THEN 0.5 WHEN i % 3 = 1 THEN NULL
           WHEN i % 2 = 0 THEN 0.75 END END AS confidence
  FROM lines),
good AS (SELECT * FROM seg WHERE text <> '' AND start_ms >= 0 AND end_ms >= start_ms),
doc AS (SELECT conv_id, turn, role, NOT (turn % 2 = 1 AND conv_id % 10 = 9) AS parsed FROM conversations)"""


def transcript_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = tr.parse_documents(transcript_documents(spark, sf_dir), KEYS)
    return tr.parsed_segments(parsed, KEYS)


PARSE_SQL = st.with_sql(_LINES_CTE) + """
SELECT conv_id, turn, CAST(segment_index AS BIGINT) AS segment_index, CAST(start_ms AS BIGINT) AS start_ms,
       CAST(end_ms AS BIGINT) AS end_ms, text, CAST(confidence AS DOUBLE) AS confidence
FROM good JOIN doc USING (conv_id, turn) WHERE parsed"""


def transcript_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = tr.parse_documents(transcript_documents(spark, sf_dir), KEYS)
    return parsed.select(*KEYS, "language", "text", F.size("segments").cast("bigint").alias("segments"),
                         F.size("rejects").cast("bigint").alias("rejects"), "error")


TEXTS_SQL = st.with_sql(_LINES_CTE, """
j AS (SELECT conv_id, turn, string_agg(text, ' ' ORDER BY segment_index) AS joined, count(*) AS n FROM good GROUP BY ALL),
a AS (SELECT conv_id, turn, count(*) AS total FROM seg GROUP BY ALL),
t AS (SELECT d.*, coalesce(n, 0) AS n, total, CASE WHEN turn % 2 = 0 AND conv_id % 5 = 0 THEN role ELSE joined END AS body
      FROM doc d JOIN a USING (conv_id, turn) LEFT JOIN j USING (conv_id, turn))""") + """
SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'fr' WHEN turn % 2 = 1 AND parsed THEN 'de' ELSE 'en' END AS language,
       CASE WHEN parsed THEN body END AS text, CASE WHEN parsed THEN n ELSE 0 END AS segments,
       CASE WHEN parsed THEN total - n ELSE 0 END AS rejects,
       CASE WHEN NOT parsed THEN 'unparsable JSON' WHEN n = 0 AND body IS NULL THEN 'no text and no segments' END AS error
FROM t"""


def transcript_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = tr.parse_documents(transcript_documents(spark, sf_dir), KEYS)
    return tr.rejected_segments(parsed, KEYS).groupBy("reason").agg(F.count("*").alias("segments"))


REJECTS_SQL = st.with_sql(_LINES_CTE) + """
SELECT CASE WHEN text = '' THEN 'missing or blank text' WHEN start_ms IS NULL THEN 'no start'
         WHEN start_ms < 0 THEN 'negative start' ELSE 'end before start' END AS reason, count(*) AS segments
FROM seg JOIN doc USING (conv_id, turn)
WHERE parsed AND (text = '' OR start_ms IS NULL OR start_ms < 0 OR end_ms < start_ms) GROUP BY 1"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of all conversations, read back from their JSON; some notes name a file."""
    notes = st.talk_recordings(spark, sf_dir).select(
        F.col("id").alias("recording_id"), F.concat(F.lit("  "), "title", F.when(
            F.substring("id", 2, 20).cast("bigint") % 7 == 3, F.lit(" /tmp/a.mp4")).otherwise(
            F.lit(""))).alias("notes"))
    made = sm.summary_payloads(st.talk_recordings(spark, sf_dir), st.talk_transcripts(spark, sf_dir),
                               st.talk_segments(spark, sf_dir), notes)
    v = F.try_parse_json("payload")
    return made.select(
        "recording_id", "part", "parts", "error", vr.string_at(v, "$.userNotes").alias("notes"),
        vr.string_at(v, "$.transcript.text").alias("text"),
        F.size(vr.array_at(v, "$.transcript.segments")).cast("bigint").alias("segments"),
        F.try_variant_get(v, "$.transcript.segments[0].endMs", "bigint").alias("first_end"),
        vr.string_at(v, "$.requestedOutputs[5]").alias("last_output"))


_TRIM_SQL = f"regexp_replace(text, '{tx.TRIM_PATTERN}', '', 'g')"
PAYLOADS_SQL = st.with_sql(st.TALK_SQL, """
p AS (SELECT *, CASE WHEN status <> 'completed' THEN 'a completed transcript is required'
                WHEN CAST(substr(recording_id, 2) AS BIGINT) % 7 = 3 THEN 'payload holds a media path or field' END AS error
      FROM talk_transcripts)""") + f"""
SELECT t.recording_id, CAST(0 AS BIGINT) AS part, CAST(1 AS BIGINT) AS parts, error,
       CASE WHEN error IS NULL THEN 'Talk ' || substr(t.recording_id, 2) END AS notes,
       CASE WHEN error IS NULL THEN string_agg({_TRIM_SQL}, ' ' ORDER BY segment_index) END AS text,
       CASE WHEN error IS NULL THEN count(*) END AS segments,
       CASE WHEN error IS NULL THEN arg_min(end_ms, segment_index) END AS first_end,
       CASE WHEN error IS NULL THEN 'chapters' END AS last_output
FROM p t JOIN talk_segments s ON s.transcript_id = t.id GROUP BY t.recording_id, error"""


def _page_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = st.given(spark, sf_dir, "pages").select("page_id", "url", "html")
    # Bodies of every fourth page name a file; every fifth page nests its body deeply.
    html = F.when(F.col("page_id") % 4 == 1, F.concat(F.col("html"), F.lit("\nC:\\Clips\\a.MP4"))).otherwise(
        F.col("html"))
    body = F.struct(
        html.alias("body"), F.array("url", F.lit("plain"), F.lit(1).cast("string")).alias("links"),
        F.when(F.col("page_id") % 3 == 0, F.struct(F.lit("x").alias("mediaPath"))).alias("extra"))
    deep = F.concat(F.lit('{"a":[' * 20), F.to_json(body), F.lit("]}" * 20))
    return pages.select("page_id", F.when(F.col("page_id") % 5 == 2, deep).otherwise(
        F.to_json(body)).alias("payload"))


def guardrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.guardrail_verdicts(_page_payloads(spark, sf_dir), ["page_id"])


_VALUE_PATTERN = "^(/users/|/var/|/tmp/)|" + "|".join(
    w.replace(".", r"\.") for w in sm.PATH_PARTS + sm.MEDIA_PATH_MARKERS)
_PATH_SQL = f"regexp_matches(replace(lower(trim({{0}}, ' \t\r\n')), '\\', '/'), '{_VALUE_PATTERN}')"
GUARDRAIL_SQL = f"""
WITH b AS (SELECT page_id, CASE WHEN page_id % 5 = 2 THEN '$' || repeat('.a[0]', 20) ELSE '$' END AS root,
                  CAST(page_id % 4 = 1 OR {_PATH_SQL.format('html')} AS INTEGER) AS html_bad,
                  CAST({_PATH_SQL.format('url')} AS INTEGER) AS url_bad,
                  CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS key_bad FROM pages)
SELECT page_id, html_bad + url_bad + key_bad = 0 AS accepted,
       CAST(html_bad + url_bad + key_bad AS BIGINT) AS violations,
       CASE WHEN html_bad = 1 THEN root || '.body' WHEN url_bad = 1 THEN root || '.links[0]'
            WHEN key_bad = 1 THEN root || '.extra' END AS first_location
FROM b"""


def path_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold a likely media path."""
    docs = st.given(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", sm.likely_media_path(F.col("text")).alias("rejected"))


PATH_SCAN_SQL = f"SELECT doc_id, {_PATH_SQL.format('text')} AS rejected FROM documents"


def summary_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies around event properties: fenced, plain, without summary, broken."""
    e = F.col("event_id")
    rows = st.given(spark, sf_dir, "events").select(
        e, F.when(e % 5 == 0, F.concat(F.lit('```json\n{"summary":"'), "event_type",
                                       F.lit('","risks":null,"action_items":["a",'), "props", F.lit("]}\n```")))
        .when(e % 5 == 1, F.concat(F.lit('{"summary_text":"'), "event_type", F.lit('","questions":'),
                                   "props", F.lit(',"chapters":5}')))
        .when(e % 5 == 2, F.concat(F.lit('``` {"summary":'), "props", F.lit(',"decisions":[]} ```')))
        .when(e % 5 == 3, F.lit('{"summary":"  ","risks":[1]}'))
        .otherwise(F.concat(F.lit("no json "), "props")).alias("content"))
    return sm.parse_replies(rows, ["event_id"])


REPLIES_SQL = """
WITH p AS (SELECT event_id, event_id % 5 AS k, event_type, replace(props, ' ', '') AS props FROM events)
SELECT event_id, CASE k WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 2 THEN props END AS summary_text,
       CASE k WHEN 0 THEN '["a",' || props || ']' WHEN 1 THEN '[]' WHEN 2 THEN '[]' END AS action_items_json,
       CASE WHEN k < 3 THEN '[]' END AS decisions_json,
       CASE k WHEN 1 THEN '[' || props || ']' WHEN 0 THEN '[]' WHEN 2 THEN '[]' END AS questions_json,
       CASE WHEN k < 3 THEN '[]' END AS risks_json, CASE k WHEN 1 THEN '[5]' WHEN 0 THEN '[]' WHEN 2 THEN '[]' END AS chapters_json,
       CASE k WHEN 3 THEN 'reply has no summary' WHEN 4 THEN 'reply is not valid JSON' END AS error
FROM p"""


def summary_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of list fields made from events."""
    e, v = F.col("event_id"), F.floor(F.col("value") * 1000).cast("string")
    rows = st.given(spark, sf_dir, "events").select(e, F.when(e % 4 == 0, F.concat(
        F.lit('["one", 2, true, null, "", {"title":" '), "event_type", F.lit(' ","start_ms":'), v,
        F.lit(',"owner":"me","reason":"why"}]')))
        .when(e % 4 == 1, F.concat(F.lit('{"question":"q","endMs":'), v, F.lit(',"due":" ","status":"open"}')))
        .when(e % 4 == 2, F.col("props")).otherwise(F.concat(F.lit("not json "), "event_type")).alias("items"))
    return sm.list_items(rows, ["event_id"], "items")


LISTS_SQL = """
WITH p AS (SELECT *, CAST(floor(floor(value * 1000) / 1000) AS BIGINT) AS secs FROM events),
t AS (SELECT *, (secs // 60) || ':' || lpad(CAST(secs % 60 AS VARCHAR), 2, '0') AS clock FROM p)
SELECT event_id, CAST(0 AS BIGINT) AS position, 'one' AS primary, '' AS detail FROM t WHERE event_id % 4 = 0
UNION ALL SELECT event_id, 1, '2', '' FROM t WHERE event_id % 4 = 0
UNION ALL SELECT event_id, 2, 'true', '' FROM t WHERE event_id % 4 = 0
UNION ALL SELECT event_id, 5, event_type, clock || ' / me / why' FROM t WHERE event_id % 4 = 0
UNION ALL SELECT event_id, 0, 'q', clock || ' / open' FROM t WHERE event_id % 4 = 1
UNION ALL SELECT event_id, 0, replace(props, ' ', ''), '' FROM t WHERE event_id % 4 = 2
UNION ALL SELECT event_id, 0, 'not json ' || event_type, '' FROM t WHERE event_id % 4 = 3"""
LISTS_SQL = LISTS_SQL.replace(" AS primary,", ' AS "primary",')


def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 7 == 0, F.lit("  ")).when(
        F.col("p_partkey") % 7 == 1, F.concat(F.lit(" ggml-"), "p_brand", F.lit(".bin"))).when(
        F.col("p_partkey") % 7 == 2, F.lit("a/b")).when(F.col("p_partkey") % 7 == 3, F.lit("ggml-.bin")
        ).otherwise(F.col("p_type"))
    name, error = tx.model_name(raw)
    return st.given(spark, sf_dir, "part").select("p_partkey", name.alias("name"), error.alias("error"))


MODEL_SQL = """
WITH r AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'small.en' WHEN 1 THEN p_brand WHEN 2 THEN 'a/b' WHEN 3 THEN ''
             ELSE trim(p_type) END AS n FROM part),
e AS (SELECT *, CASE WHEN contains(n, '/') OR contains(n, '..') THEN 'model name must be a local file name'
        WHEN n = '' THEN 'model name is required'
        WHEN NOT regexp_full_match(n, '[A-Za-z0-9._-]+') THEN 'model name has unsupported characters' END AS error FROM r)
SELECT p_partkey, CASE WHEN error IS NULL THEN n END AS name, error FROM e"""


def format_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report texts for every event."""
    e, v = F.col("event_id"), F.col("value")
    n = F.round(v * v * v * 100).cast("bigint")
    rows = st.given(spark, sf_dir, "events").select(
        e, v, n.alias("n"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"),
        F.unix_seconds(F.col("ts").cast("timestamp")).cast("string").alias("epoch"), "user_id", "event_type")
    c = F.col
    when = F.when(e % 4 == 0, c("epoch")).when(e % 4 == 1, c("iso")).when(e % 4 == 2, F.lit("soon"))
    return rows.select(
        e, dp.date_text(when).alias("date_text"), dp.duration_text(F.when(e % 9 > 0, c("n"))).alias("duration"),
        dp.byte_text(F.when(e % 9 > 0, c("n") * 10)).alias("bytes"),
        dp.segment_time(c("n")).alias("segment_time"), dp.rank_text(-v / 1000).alias("rank"),
        dp.confidence_text(F.when(e % 3 > 0, v / 500)).alias("confidence"),
        dp.resolution_text(c("user_id"), F.when(e % 2 == 0, c("n") + 1)).alias("resolution"),
        dp.audio_stream_text(F.when(e % 5 > 0, F.lit("p")), F.when(e % 5 > 1, F.lit(2)),
                             F.when(e % 5 > 2, F.lit(48000)), F.when(e % 5 > 3, F.lit("f32")))
        .alias("stream"),
        tx.path_tail(F.when(e % 6 > 0, F.concat(F.lit("/a\\"), "event_type", F.lit("//"), e.cast("string"))))
        .alias("tail"),
        tx.job_kind_label(F.concat("event_type", F.lit("_soonER"))).alias("kind_label"),
        tx.compact_error(F.repeat(c("event_type"), (c("user_id") % 150).cast("int"))).alias("error_text"))


FORMAT_SQL = """
WITH r AS (SELECT event_id AS e, value AS v, CAST(round(value * value * value * 100) AS BIGINT) AS n, ts, user_id, event_type FROM events),
s AS (SELECT *, CAST(floor(n / 1000 + 0.5) AS BIGINT) AS secs, n // 1000 AS fsecs, n * 10 AS b FROM r)
SELECT e AS event_id,
  CASE WHEN e % 4 < 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN e % 4 = 2 THEN 'soon' ELSE 'Not captured' END AS date_text,
  CASE WHEN e % 9 = 0 OR n = 0 THEN 'Duration pending' ELSE (secs // 60) || ':' || lpad(CAST(secs % 60 AS VARCHAR), 2, '0') END AS duration,
  CASE WHEN e % 9 = 0 OR n = 0 THEN 'No bytes written' WHEN b < 1024 THEN b || ' B'
    WHEN b < 1048576 THEN printf('%.1f', floor(b / 1024 * 10 + 0.5) / 10) || ' KB'
    WHEN b < 1073741824 THEN printf('%.1f', floor(b / 1048576 * 10 + 0.5) / 10) || ' MB'
    ELSE printf('%.1f', floor(b / 1073741824 * 10 + 0.5) / 10) || ' GB' END AS bytes,
  (fsecs // 60) || ':' || lpad(CAST(fsecs % 60 AS VARCHAR), 2, '0') AS segment_time,
  'Rank ' || CASE WHEN v / 1000 < 0.001 THEN regexp_replace(printf('%.2e', 0 - v / 1000), 'e([+-])0+([0-9])', 'e\\1\\2') ELSE printf('%.3f',
    -(v / 1000 + CASE WHEN v / 1000 * 16 % 2 = 1 THEN 0.0001 ELSE 0 END)) END AS rank,
  CASE WHEN e % 3 > 0 THEN CAST(floor(v / 500 * 100 + 0.5) AS BIGINT) || '%' ELSE '' END AS confidence,
  CASE WHEN e % 2 = 0 AND user_id <> 0 THEN user_id || ' x ' || (n + 1) ELSE 'Pending' END AS resolution,
  CASE e % 5 WHEN 0 THEN 'Off' WHEN 1 THEN 'PCM pending' WHEN 2 THEN '2 ch' WHEN 3 THEN '2 ch / 48000 Hz' ELSE '2 ch / 48000 Hz / f32' END AS stream,
  CASE WHEN e % 6 > 0 THEN event_type || '/' || e ELSE 'Pending' END AS tail,
  upper(left(event_type, 1)) || substr(event_type, 2) || ' SoonER' AS kind_label,
  CASE WHEN length(repeat(event_type, user_id % 150)) > 500 THEN left(repeat(event_type, user_id % 150), 500) || '...'
    ELSE repeat(event_type, user_id % 150) END AS error_text
FROM s"""


QUERIES = {
    "transcript_parse": (transcript_parse, PARSE_SQL),
    "transcript_texts": (transcript_texts, TEXTS_SQL),
    "transcript_rejects": (transcript_rejects, REJECTS_SQL),
    "payloads": (payloads, PAYLOADS_SQL),
    "guardrail": (guardrail, GUARDRAIL_SQL),
    "path_scan": (path_scan, PATH_SCAN_SQL),
    "summary_replies": (summary_replies, REPLIES_SQL),
    "summary_lists": (summary_lists, LISTS_SQL),
    "model_names": (model_names, MODEL_SQL),
    "format_report": (format_report, FORMAT_SQL),
}
