from pyspark.sql import functions as F

from conftest import rows
from reelgrid import schemas
from reelgrid.operators import backfill as bf
from reelgrid.operators import constraints as cn
from reelgrid.operators import lookups as lk
from reelgrid.operators import upserts as up
from reelgrid.plans import library_queries as lq
from oracle import connect, difference

SMALL = "/root/testdata/sf0.001"


def frame(spark, table, *records):
    schema = schemas.TABLES[table]
    fill = {"string": "x", "bigint": 0, "boolean": False, "double": 0.0}
    data = []
    for record in records:
        data.append(tuple(
            record.get(f.name, None if f.nullable else fill[f.dataType.simpleString()])
            for f in schema.fields))
    return spark.createDataFrame(data, schema)


def test_create_trims_title(spark):
    req = spark.createDataFrame([(1, "  Monday notes  ", None, "2026-07-01T12:00:00Z"), (2, None, None, None)],
                                "request_id int, title string, media_path string, captured_at string")
    made = up.create_recordings(req, "5").orderBy("captured_at").collect()
    assert {m.title for m in made} == {"Monday notes", "Untitled recording"}
    assert all(m.status == "pending" and m.created_at == "5" for m in made)
    assert all(m.recording_directory == f"recordings/{m.id}" for m in made)
    assert up.create_recordings(req, "5").exceptAll(up.create_recordings(req, "5")).count() == 0


def test_patch_cannot_null_and_is_idempotent(spark):
    r = frame(spark, "recordings", {"id": "a", "media_path": "m", "title": "old"}, {"id": "b"})
    patch = spark.createDataFrame(
        [("a", "new"), ("z", "?")], "id string, title string").select(
        "id", "title", *[F.lit(None).cast("bigint" if c == "duration_ms" else "string").alias(c)
                         for c in up.RECORDING_PATCH if c != "title"])
    once = up.patch_recordings(r, patch, "9")
    a = once.where("id = 'a'").head()
    assert (a.title, a.media_path, a.updated_at) == ("new", "m", "9")
    assert once.where("id = 'b'").head().updated_at == "x"
    assert up.patch_recordings(once, patch, "9").exceptAll(once).count() == 0
    assert rows(up.unmatched(patch, r).select("id")) == [("z",)]


def test_transcript_upsert_overwrites_with_nulls(spark):
    t = frame(spark, "transcripts", {"id": "t", "recording_id": "r", "text": "old", "language": "en",
                                     "created_at": "1"})
    new = spark.createDataFrame([("r", "failed"), ("q", "completed")], "recording_id string, status string").select(
        "*", *[F.lit(None).cast("string").alias(c) for c in (
            "language", "model_name", "raw_json_path", "text", "completed_at", "failure_message")])
    once = up.upsert_transcripts(t, new, "9")
    got = {x.recording_id: x for x in once.collect()}
    assert (got["r"].id, got["r"].created_at, got["r"].text, got["r"].status) == ("t", "1", None, "failed")
    assert got["q"].created_at == "9" and got["q"].id
    assert up.upsert_transcripts(once, new, "9").exceptAll(once).count() == 0


def test_segment_replace_defaults_index(spark):
    s = frame(spark, "transcript_segments", {"id": "o", "transcript_id": "t"}, {"id": "k", "transcript_id": "u"})
    gone = spark.createDataFrame([("t", "r")], "transcript_id string, recording_id string")
    new = spark.createDataFrame(
        [("t", 0, None, 0, 5, "a", 0.92), ("t", 1, None, 5, 9, "b", None)],
        "transcript_id string, position long, segment_index long, start_ms long, end_ms long, text string, confidence double")
    got = rows(up.replace_segments(s, gone, new, "1").select("transcript_id", "segment_index", "confidence"),
               "transcript_id", "segment_index")
    assert got == [("t", 0, 0.92), ("t", 1, None), ("u", 0, None)]
    first = {x.id for x in up.replace_segments(s, gone, new, "1").collect()}
    second = {x.id for x in up.replace_segments(s, gone, new, "2").collect()}
    assert len(first & second) == 1
    assert up.replace_segments(s, gone, new.where("false"), "1").count() == 1


def test_split_session_finish(spark):
    s = frame(spark, "recording_sessions", {"id": "s", "audio_mode": "microphone_and_source", "status": "capturing",
                                            "width": 10, "source_audio_channels": 2})
    types = {f.name: f.dataType for f in schemas.RECORDING_SESSIONS.fields}
    given = {"id": "s", "status": "stopped", "frame_count": 3, "audio_byte_count": 120,
             "microphone_audio_byte_count": 120, "source_audio_byte_count": 240}
    names = ["id", "width", "height", *up.CAPTURE_DETAILS, "status", "frame_count", "audio_byte_count",
             "microphone_audio_byte_count", "source_audio_byte_count", "stopped_at", "duration_ms", "failure_message"]
    p = spark.range(1).select(*[F.lit(given.get(n)).cast(types[n]).alias(n) for n in names])
    x = up.finish_sessions(s, p, "9").head()
    assert (x.audio_byte_count, x.microphone_audio_byte_count, x.source_audio_byte_count) == (120, 120, 240)
    assert (x.width, x.source_audio_channels, x.status) == (10, 2, "stopped")


def test_legacy_session_reads_as_microphone(spark):
    s = frame(spark, "recording_sessions", {
        "id": "s", "audio_path": "a.pcm", "audio_byte_count": 96, "audio_sample_rate": 48000,
        "audio_channels": 2, "audio_sample_format": "f32", "screen_source_id": "display:7",
        "video_source_id": "", "audio_mode": "microphone", "include_microphone": True})
    for x in (bf.read_sessions(s).head(), bf.backfill_sessions(s).head()):
        assert (x.video_source_id, x.audio_mode, x.microphone_audio_path) == ("display:7", "microphone", "a.pcm")
        assert (x.microphone_audio_byte_count, x.microphone_audio_sample_rate, x.microphone_audio_channels,
                x.microphone_audio_sample_format) == (96, 48000, 2, "f32")
        assert x.source_audio_path is None and x.source_audio_byte_count == 0


def test_stored_and_read_backfill_differ_without_a_path(spark):
    s = frame(spark, "recording_sessions", {"id": "s", "audio_mode": "none", "audio_sample_rate": 8000,
                                            "screen_source_id": "WINDOW:12", "video_source_kind": "display"})
    stored, read = bf.backfill_sessions(s).head(), bf.read_sessions(s).head()
    assert stored.microphone_audio_sample_rate == 8000 and read.microphone_audio_sample_rate is None
    assert stored.source_audio_sample_rate is None
    assert stored.video_source_kind == "window" and stored.video_source_window_id is None


def test_backfill_twice_changes_nothing(spark):
    s = frame(spark, "recording_sessions", *[
        {"id": str(i), "audio_path": p, "audio_mode": m, "include_microphone": w, "audio_byte_count": 7,
         "screen_source_id": f"window:{i}b", "video_source_id": ""}
        for i, (p, m, w) in enumerate([("x/source_audio.pcm", "", False), ("x/source_audio.pcm", "microphone", False),
                                       ("x.pcm", "", True), (None, "", False), ("", "microphone", False)])])
    once = bf.backfill_sessions(s)
    assert [r.audio_mode for r in once.orderBy("id").collect()] == ["source", "source", "microphone", "none", "none"]
    assert once.orderBy("id").head().video_source_window_id == 0
    assert bf.backfill_sessions(once).exceptAll(once).count() == 0


def test_list_order_depends_on_filter(spark):
    j = frame(spark, "processing_jobs", {"id": "a", "state": "queued", "priority": 1, "created_at": "1"},
              {"id": "b", "state": "queued", "priority": 5, "created_at": "2"},
              {"id": "c", "state": "failed", "priority": 9, "created_at": "3"})
    assert [x.id for x in lk.list_jobs(j, state="queued").collect()] == ["b", "a"]
    assert [x.id for x in lk.list_jobs(j).collect()] == ["c", "b", "a"]


def test_nested_keeps_empty_transcripts(spark):
    t = frame(spark, "transcripts", {"id": "t", "recording_id": "r"}, {"id": "u", "recording_id": "q"})
    s = frame(spark, "transcript_segments", *[{"id": str(i), "transcript_id": "t", "recording_id": "r", "segment_index": i}
                                              for i in (2, 0, 1)])
    got = rows(lk.nested_transcripts(t, s).select("id", "position", "segment_index"), "id", "position")
    assert got == [("t", 0, 0), ("t", 1, 1), ("t", 2, 2), ("u", None, None)]
    assert lk.transcript_of("none", t, s).count() == 0


def test_constraints_and_orphans(spark):
    r = frame(spark, "recordings", {"id": "a", "status": "odd", "duration_ms": -1}, {"id": "b", "status": "failed", "recording_directory": "y"})
    s = frame(spark, "transcript_segments", {"id": "1", "transcript_id": "t", "recording_id": "a", "start_ms": 5, "end_ms": 4, "confidence": 2.0})
    t = frame(spark, "transcripts", {"id": "t", "recording_id": "gone", "status": "failed"})
    bad = {(x.table_name, x.rule): x.violations for x in cn.constraint_report(
        {"recordings": r, "transcripts": t, "transcript_segments": s}).where("violations > 0").collect()}
    assert bad == {("recordings", "status unknown"): 1, ("recordings", "duration_ms negative"): 1,
                   ("transcript_segments", "end before start"): 1, ("transcript_segments", "confidence out of range"): 1,
                   ("transcripts", "recording_id without parent"): 1}
    j = frame(spark, "processing_jobs", {"id": "j", "recording_id": "gone"}, {"id": "k", "recording_id": "a"})
    j = j.unionByName(frame(spark, "processing_jobs", {"id": "l", "recording_id": None}))
    assert rows(cn.release_jobs(j, r).select("id", "recording_id"), "id") == [("j", None), ("k", "a"), ("l", None)]
    assert cn.drop_children(t, r).count() == 0


def test_latest_row_wins(spark):
    v = spark.createDataFrame([("a", 1, "1"), ("a", 2, "3"), ("a", 3, "2"), ("b", 4, "1")], "id string, n int, updated_at string")
    assert rows(up.latest_rows(v), "id") == [("a", 2, "3"), ("b", 4, "1")]


def test_detail_parts_of_all_recordings(spark):
    """Against the check SQL, read here without its choice of every fifth recording."""
    whole = lq.PARTS_SQL.replace(" WHERE CAST(substr(id, 2) AS BIGINT) % 5 = 0", "")
    got = lq.recording_parts(spark, SMALL)
    assert difference(got, connect(SMALL), whole) is None
    assert got.where(F.substring("recording_id", 2, 20).cast("bigint") % 5 != 0).count() > 0


def test_stored_changes_touch_their_folders_only(spark, tmp_path):
    """A patch and a removal rewrite the folders of their recordings; other files keep their
    names, and a folder that loses all its rows reads as empty."""
    import glob

    from reelgrid import schemas
    from reelgrid.operators import upserts as up
    from reelgrid.sources import library as lib

    made = spark.range(60).select(
        F.concat(F.lit("s"), "id").alias("id"), F.concat(F.lit("t"), F.col("id") % 30).alias("transcript_id"),
        F.concat(F.lit("r"), F.col("id") % 30).alias("recording_id"), F.col("id").alias("segment_index"),
        F.lit(0).cast("long").alias("start_ms"), F.lit(1).cast("long").alias("end_ms"), F.lit("x").alias("text"),
        F.lit(None).cast("double").alias("confidence"))
    path = str(tmp_path / "segments")
    lib.write_snapshot(made.select(*schemas.TRANSCRIPT_SEGMENTS.fieldNames()), path, "recording_id", 8)

    def files():
        return {f for f in glob.glob(f"{path}/bucket=*/*.parquet")}

    before = files()
    replaced = spark.createDataFrame([("t1", "r1"), ("t2", "r2")], "transcript_id string, recording_id string")
    none = spark.createDataFrame([], "transcript_id string, position long, segment_index long, start_ms long, "
                                     "end_ms long, text string, confidence double")
    touched = lib.change_snapshot(spark, path, "transcript_segments", replaced.select("recording_id"),
                                  lambda held: up.replace_segments(held, replaced, none, "9"), "recording_id", 8)
    after = files()
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert kept and kept == before & after
    left = lib.read_snapshot(spark, path, "transcript_segments")
    assert {r[0] for r in left.select("transcript_id").distinct().collect()} == {
        f"t{k}" for k in range(30) if k not in (1, 2)}
    every = spark.createDataFrame([(f"t{k}", f"r{k}") for k in range(30)], "transcript_id string, recording_id string")
    lib.change_snapshot(spark, path, "transcript_segments", every.select("recording_id"),
                        lambda held: up.replace_segments(held, every, none, "9"), "recording_id", 8)
    assert lib.read_snapshot(spark, path, "transcript_segments").count() == 0
