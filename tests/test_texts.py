import json

from pyspark.sql import functions as F

from conftest import rows
from reelgrid.functions import display as dp
from reelgrid.functions import text as tx
from reelgrid.functions import variants as vr
from reelgrid.operators import summaries as sm
from reelgrid.operators import transcripts as tr


def parse(spark, *documents, model="small.en"):
    df = spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d), model)
                                for i, d in enumerate(documents)], "n int, json string, model_name string")
    return tr.parse_documents(df, ["n"])


def test_edges_in_mixed_forms(spark):
    """Seconds, milliseconds, numbers as text and a gap in one document; one item is refused."""
    doc = {"segments": [
        {"start": "0.0405", "end_ms": 1600, "text": "harbour lights", "probability": "0.25"},
        {"start_ms": 9000.5, "end": 9.75, "text": "\tfog\n"},
        {"start_ms": 12000, "end_ms": 11999, "text": "runs backwards"},
        {"start": 12, "end": 12, "text": "one instant", "confidence": 0}], "language": " pt "}
    p = parse(spark, doc, model="tide")
    assert rows(tr.parsed_segments(p, ["n"]), "segment_index") == [
        (0, 0, 41, 1600, "harbour lights", 0.25), (0, 1, 9001, 9750, "fog", None),
        (0, 3, 12000, 12000, "one instant", 0.0)]
    assert rows(tr.rejected_segments(p, ["n"]).select("segment_index", "reason")) == [
        (2, "end before start")]
    assert p.head().text == "harbour lights fog one instant" and p.head().language == "pt"


def test_offsets_and_clock_edges_of_one_list(spark):
    """Offsets win over clock texts; a clock text alone counts; offsets of one side only do not
    keep an item."""
    doc = {"transcription": [
        {"offsets": {"from": 70, "to": 90}, "timestamps": {"from": "00:09:00,000", "to": "00:09:01,000"},
         "text": "offsets"},
        {"timestamps": {"from": "01:30,5", "to": "00:01:31.250"}, "text": "clock"},
        {"offsets": {"from": 95000}, "text": "half"}]}
    p = parse(spark, doc, model="tide")
    assert rows(tr.parsed_segments(p, ["n"]), "segment_index") == [
        (0, 0, 70, 90, "offsets", None), (0, 1, 90500, 91250, "clock", None)]
    assert rows(tr.rejected_segments(p, ["n"]).select("segment_index", "reason")) == [(2, "no end")]
    assert p.head().text == "offsets clock" and p.head().language is None


def test_rejects_keep_positions_and_reasons(spark):
    doc = {"segments": [
        {"start": 0, "end": 1, "text": "  "}, {"end": 1, "text": "a"}, {"start": 1, "text": "b"},
        {"start_ms": -5, "end_ms": 1, "text": "c"}, {"start": 3, "end": 2, "text": "d"},
        {"start_ms": "7.5", "end": "1e0", "text": " e ", "confidence": "bad", "probability": "0.5"},
        {"start": True, "offsets": {"from": 4}, "end_ms": 9, "text": "f", "confidence": 7, "probability": 0.1},
        {"start": 1, "end": 2, "text": 5}, 17]}
    p = parse(spark, doc)
    assert rows(tr.parsed_segments(p, ["n"]), "segment_index") == [
        (0, 5, 8, 1000, "e", 0.5), (0, 6, 4, 9, "f", None)]
    reasons = {r.segment_index: r.reason for r in tr.rejected_segments(p, ["n"]).collect()}
    assert reasons == {0: "missing or blank text", 1: "no start", 2: "no end", 3: "negative start",
                       4: "end before start", 7: "missing or blank text", 8: "missing or blank text"}


def test_document_errors_text_and_language(spark):
    p = parse(spark, "{oops", {"segments": []}, {"result": {"text": " hi "}, "language": " "},
              {"text": "x", "segments": {"a": 1}, "transcription": [{"start": 0, "end": 1, "text": "y"}]})
    got = {r.n: (r.error, r.text, r.language, len(r.segments)) for r in p.collect()}
    assert got[0] == ("unparsable JSON", None, "en", 0)
    assert got[1] == ("no text and no segments", None, "en", 0)
    assert got[2] == (None, "hi", "en", 0)
    assert got[3] == (None, "x", "en", 1)
    assert parse(spark, {"text": "x"}, model="base").head().language is None
    assert rows(tr.rejected_documents(p, ["n"]), "n") == [(0, "unparsable JSON"), (1, "no text and no segments")]


def test_clock_and_model_names(spark):
    df = spark.createDataFrame([(x,) for x in ("01:02,5", "1:00:00.25", "5", "a:b", "1:2:3:4", " 1:2")], "t string")
    assert [r[0] for r in df.select(vr.clock_ms(F.col("t"))).collect()] == [62500, 3600250, None, None, None, None]
    df = spark.createDataFrame([(x,) for x in (None, " ", " ggml-base.en.bin ", "a..b", "x y", "ggml-.bin", "a\\b")], "m string")
    name, error = tx.model_name(F.col("m"))
    got = [tuple(r) for r in df.select(name, error.isNull()).collect()]
    assert got == [("small.en", True), ("small.en", True), ("base.en", True), (None, False),
                   (None, False), (None, False), (None, False)]


def test_segment_pages_and_preview(spark):
    s = spark.createDataFrame([("t", i, i, i + 1, f" w{i} ") for i in range(10)],
                              "transcript_id string, segment_index long, start_ms long, end_ms long, text string")
    s = s.withColumn("segment_index", F.col("segment_index") * 3000)  # gaps do not count
    pages = rows(tr.segment_pages(s, 4).select("page", F.size("segments"), tr.page_text(F.col("segments"))), "page")
    assert pages == [(0, 4, "w0 w1 w2 w3"), (1, 4, "w4 w5 w6 w7"), (2, 2, "w8 w9")]
    t = spark.createDataFrame([("t", "r", None), ("u", "q", "own"), ("v", "p", "")],
                              "id string, recording_id string, text string")
    got = rows(tr.transcript_preview(t, s), "recording_id")
    assert got == [("p", ""), ("q", "own"), ("r", " ".join(f" w{i} " for i in range(10)))]


def summary_tables(spark, text="Hello.", status="completed", title="T"):
    r = spark.createDataFrame([("r", title, "completed", None, 5, "9")],
                              "id string, title string, status string, captured_at string, duration_ms long, completed_at string")
    t = spark.createDataFrame([("t", "r", "en", "m", text, status)],
                              "id string, recording_id string, language string, model_name string, text string, status string")
    s = spark.createDataFrame([("t", i, i, i + 1, f"w{i}") for i in range(5)],
                              "transcript_id string, segment_index long, start_ms long, end_ms long, text string")
    return r, t, s


def test_payload_shape_and_errors(spark):
    r, t, s = summary_tables(spark)
    notes = spark.createDataFrame([("r", "  note ")], "recording_id string, notes string")
    made = sm.summary_payloads(r, t, s, notes).collect()
    assert len(made) == 1 and made[0].error is None
    p = json.loads(made[0].payload)
    assert p["transcript"]["text"] == "Hello." and p["userNotes"] == "note"
    assert p["recording"] == {"id": "r", "title": "T", "status": "completed", "capturedAt": None,
                              "durationMs": 5, "completedAt": "9"}
    assert p["transcript"]["segments"][1] == {"index": 1, "startMs": 1, "endMs": 2, "text": "w1"}
    assert "path" not in made[0].payload.lower()
    assert sm.guardrail_verdicts(sm.summary_payloads(r, t, s), ["recording_id"]).head().accepted

    parts = sm.summary_payloads(*summary_tables(spark, text=None), page_segments=2).orderBy("part").collect()
    assert [json.loads(x.payload)["transcript"]["text"] for x in parts] == ["w0 w1", "w2 w3", "w4"]
    stored = sm.summary_payloads(r, t, s, page_segments=2).orderBy("part").collect()
    assert [json.loads(x.payload)["transcript"]["text"] for x in stored] == ["w0 w1", "w2 w3", "w4"]
    assert {(x.parts, x.error) for x in stored} == {(3, None)}
    unsafe = sm.summary_payloads(*summary_tables(spark, title="/Users/me/clip.mp4")).head()
    assert unsafe.payload is None and unsafe.error == "payload holds a media path or field"
    assert sm.summary_payloads(*summary_tables(spark, status="failed")).head().payload is None
    assert sm.summary_payloads(*summary_tables(spark, text=" ")).head().error == "transcript text is required"


def verdict(spark, value):
    df = spark.createDataFrame([(1, json.dumps(value))], "n int, payload string")
    return sm.guardrail_violations(df, ["n"]).select("location", "kind").collect()


def test_guardrails(spark):
    assert verdict(spark, {"recording": {"mediaPath": 1}}) == [("$.recording", "key")]
    assert verdict(spark, {"recording": {"title": "/Users/me/clip.mp4"}}) == [("$.recording.title", "value")]
    assert verdict(spark, {"title": "temp/recording-sessions/a.pcm"}) == [("$.title", "value")]
    assert verdict(spark, {"a": [1, {"b": "see https://x"}]}) == [("$.a[1].b", "value")]
    assert verdict(spark, {"a": " C:\\x"}) == [("$.a", "value")]
    assert verdict(spark, {"a": "plain text", "b": [1, None, True]}) == []
    deep = {"Raw_JSON": 1, "title": "x"}
    for _ in range(60):
        deep = {"a": [deep]}
    assert verdict(spark, deep) == [("$" + ".a[0]" * 60, "key")]
    first = {"z": "\u002fTMP/x", "a": {"audio": "f.wav"}}
    assert verdict(spark, first) == [("$.z", "value"), ("$.a", "key"), ("$.a.audio", "value")]
    assert verdict(spark, {"text": 'a "media": quote', "b": 'ends with colon":'}) == []
    bad = spark.createDataFrame([(1, "{oops"), (2, None)], "n int, payload string")
    assert [(r.accepted, r.violations) for r in sm.guardrail_verdicts(bad, ["n"]).collect()] == [(False, 1)] * 2


def test_replies_and_items(spark):
    replies = [
        '```json\n{"summary": "S", "risks": null, "action_items": ["Follow up"], "questions": {"q": 1}, "chapters": [{"t": 1}]}\n```',
        '{"summary_text": {"a": 1}}', '{"summary": " "}', "nope"]
    df = spark.createDataFrame(list(enumerate(replies)), "n int, content string")
    got = sm.parse_replies(df, ["n"]).orderBy("n").collect()
    assert got[0].summary_text == "S" and got[0].risks_json == "[]"
    assert json.loads(got[0].action_items_json) == ["Follow up"]
    assert json.loads(got[0].questions_json) == [{"q": 1}] and json.loads(got[0].chapters_json) == [{"t": 1}]
    assert got[1].summary_text == '{"a":1}' and got[1].error is None
    assert got[2].error == "reply has no summary" and got[3].error == "reply is not valid JSON"

    lists = [None, "", '["a", 3, false, null, "", {"risk": " r ", "start_ms": 61000, "end_ms": 62500, "status": "open", "details": "d"}]',
             '{"x": {"y": 1}}', "raw text", '{"title": 5, "start_ms": null, "startMs": 1000}']
    df = spark.createDataFrame(list(enumerate(lists)), "n int, items string")
    got = rows(sm.list_items(df, ["n"], "items"), "n", "position")
    assert got == [(2, 0, "a", ""), (2, 1, "3", ""), (2, 2, "false", ""),
                   (2, 5, "r", "1:01 - 1:02 / open / d"), (3, 0, '{"x":{"y":1}}', ""),
                   (4, 0, "raw text", ""), (5, 0, '{"startMs":1000,"start_ms":null,"title":5}', "0:01")]


def test_display_texts(spark):
    one = spark.range(1)

    def show(c):
        return one.select(c).head()[0]

    lit = F.lit
    assert show(dp.duration_text(lit(61499))) == "1:01" and show(dp.duration_text(lit(61500))) == "1:02"
    assert show(dp.duration_text(lit(0))) == "Duration pending"
    assert [show(dp.byte_text(lit(n))) for n in (0, 5, 1023, 1024, 1280, 1536, 5 * 1024 ** 2, 3 * 1024 ** 4)] == [
        "No bytes written", "5 B", "1023 B", "1.0 KB", "1.3 KB", "1.5 KB", "5.0 MB", "3072.0 GB"]
    assert [show(dp.rank_text(lit(x))) for x in (-1.23456, -0.1035, 0.0005, -9.45e-7, 0.0, float("nan"))] == [
        "Rank -1.235", "Rank -0.103", "Rank 5.00e-4", "Rank -9.45e-7", "Rank 0.00e+0", "Rank pending"]
    assert show(dp.confidence_text(lit(0.875))) == "88%" and show(dp.confidence_text(lit(None).cast("double"))) == ""
    assert show(dp.segment_time(lit(59999))) == "0:59"
    assert show(dp.date_text(lit("1700000000"))) == "2023-11-14 22:13:20"
    assert show(dp.date_text(lit("2026-07-01T12:00:00Z"))) == "2026-07-01 12:00:00"
    assert show(dp.date_text(lit("soon"))) == "soon" and show(dp.date_text(lit(""))) == "Not captured"
    assert show(tx.job_kind_label(lit("my_ownKind"))) == "My OwnKind"
    assert show(tx.path_tail(lit("a"))) == "a" and show(tx.path_tail(lit("/x/y\\z/"))) == "y/z"
    assert show(tx.normal_title(lit("  Monday notes  "))) == "Monday notes"
    assert show(tx.normal_title(lit(" \u00a0\t"))) == "Untitled recording"


def test_rank_texts_of_ties_and_zero_agree_with_their_sql(spark, tmp_path):
    """Exact ties of three decimals go up, a negative zero has no sign and one digit of exponent."""
    import datetime

    import duckdb
    import oracle
    from reelgrid.plans import text_queries as tq

    values = [62.5, 187.5, 562.5, 1062.5, 62.4, 0.0, 0.05, 0.99, 1.0]
    spark.createDataFrame(
        [(n, n % 3, datetime.datetime(2024, 1, 1), "view", v) for n, v in enumerate(values)],
        "event_id long, user_id long, ts timestamp_ntz, event_type string, value double").write.parquet(
            f"{tmp_path}/events.parquet")
    found = tq.format_report(spark, str(tmp_path))
    assert [r["rank"] for r in found.orderBy("event_id").collect()] == ["Rank " + t for t in (
        "-0.063", "-0.188", "-0.563", "-1.063", "-0.062", "0.00e+0", "-5.00e-5", "-9.90e-4", "-0.001")]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert oracle.difference(found, con, tq.FORMAT_SQL) is None
