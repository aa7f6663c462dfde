import json
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from reelgrid.operators import media as md
from reelgrid.operators import audio_blocks as ab
from reelgrid.operators import timeline as tl
from reelgrid.operators.running import running_before
from reelgrid.sources import documents as dc
from reelgrid.sources import files as fl
from reelgrid.sources import raw_capture as raw

BLOCK = "stream_id string, block_seq long, elapsed_ms long, sample_rate long, frames long"


def place_loop(blocks):
    ends, out = {}, {}
    for stream, seq, ms, rate, n in sorted(blocks, key=lambda b: b[1]):
        cur, start = ends.get(stream, 0), (ms * rate + 500) // 1000
        gap = max(0, start - cur)
        skip = min(n, max(0, cur - start))
        out[(stream, seq)] = (gap, skip, n - skip)
        ends[stream] = max(cur, start + n)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_placement_equals_loop(spark, seed):
    rng = random.Random(seed)
    width = rng.randint(1, 9)
    blocks = [(rng.choice(["hot", "hot", "a", "b"]), i, rng.randint(0, 400), 1000, rng.randint(0, 900))
              for i in range(rng.randint(1, 120))]
    placed = tl.place_blocks(spark.createDataFrame(blocks, BLOCK), chunk_width=width)
    got = {(r.stream_id, r.block_seq): (r.gap_frames, r.skip_frames, r.kept_frames) for r in placed.collect()}
    assert got == place_loop(blocks)


def test_running_values_do_not_depend_on_chunks(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"),
                                 ((F.col("id") * 37) % 101).alias("v"))
    specs = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")),
             "l": ("last", F.when(F.col("v") > 90, F.col("v")))}
    want = rows(running_before(df, ["k"], "o", specs, 10 ** 6), "k", "o")
    for width in (1, 7, 64):
        assert rows(running_before(df, ["k"], "o", specs, width), "k", "o") == want
    inclusive = running_before(df, ["k"], "o", {"s": ("sum", F.lit(1))}, 16, inclusive=True)
    assert inclusive.agg(F.max("s")).head()[0] == 250


def test_one_frame_at_one_ms(spark):
    placed = tl.place_blocks(spark.createDataFrame([("s", 0, 1, 48000, 1)], BLOCK))
    decoded = spark.createDataFrame([("s", 0, [0.5], [0.25])],
                                    "stream_id string, block_seq long, left array<float>, right array<float>")
    got = rows(tl.timeline_samples(placed, decoded), "frame")
    assert len(got) == 49 and got[:48] == [("s", i, 0.0, 0.0) for i in range(48)]
    assert got[48] == ("s", 48, 0.5, 0.25)
    long = tl.silent_samples(tl.place_blocks(spark.createDataFrame([("s", 0, 5000, 1000, 1)], BLOCK)), piece=64)
    assert rows(long.select("frame"), "frame") == [(i,) for i in range(5000)]


@pytest.mark.parametrize("fmt,packed,want", [
    ("i8", struct.pack("<b", -128), -1.0), ("u8", struct.pack("<B", 128), 0.0),
    ("i16", struct.pack("<h", -32768), -1.0), ("u16", struct.pack("<H", 32768), 0.0),
    ("i24", struct.pack("<i", -4194304), -0.5), ("u24", struct.pack("<i", 12582912), 0.5),
    ("i32", struct.pack("<i", -2 ** 31), -1.0), ("u32", struct.pack("<I", 2 ** 31), 0.0),
    ("f32", struct.pack("<f", 0.25), 0.25), ("f64", struct.pack("<d", 0.75), 0.75)])
def test_pcm_formats(fmt, packed, want):
    left, right = raw.to_stereo(packed, fmt, 1)
    assert left.tolist() == right.tolist() == [want]


def test_decode_channels_and_errors(spark):
    three = struct.pack("<3f", 0.0, 0.5, 1.0)
    df = spark.createDataFrame(
        [("a", 0, 0, bytearray(three), "f32", 3), ("a", 1, 0, bytearray(three), "f32", 2),
         ("a", 2, 0, bytearray(three), "i64", 1), ("a", 3, 0, bytearray(three), "f32", 0), ("a", 4, 0, bytearray(b""), "f32", 1)],
        "stream_id string, block_seq long, elapsed_ms long, bytes binary, sample_format string, channels long")
    got = {r.block_seq: r for r in raw.decode_blocks(df).collect()}
    assert got[0].left == got[0].right == [0.5]
    assert got[1].error == "block not aligned to frames" and got[1].left is None
    assert got[2].error == "unsupported sample format" and got[3].error == "invalid channel count"
    assert got[4].frames == 0 and got[4].error is None


def resample_loop(values, rate_in, rate_out):
    n = len(values)
    out = []
    for o in range((n * rate_out + rate_in // 2) // rate_in):
        low = o * rate_in // rate_out
        high = min(low + 1, n - 1)
        out.append(values[low] + (values[high] - values[low]) * (o * rate_in / rate_out - low))
    return out


@pytest.mark.parametrize("rate_in,rate_out,n", [(24000, 48000, 2), (44100, 16000, 37), (16000, 44100, 20),
                                                (3, 1, 7)])
def test_resample_equals_loop(spark, rate_in, rate_out, n, width=3):
    values = [((i * 29) % 17) / 16 for i in range(n)]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "stream_id string, frame long, mono double")
    got = rows(tl.resample(df, rate_in, rate_out, ["mono"], chunk_width=width).select("frame", "mono"), "frame")
    want = resample_loop(values, rate_in, rate_out)
    assert [f for f, _ in got] == list(range(len(want)))
    assert np.allclose([v for _, v in got], want, atol=1e-9)


def samples(spark, streams):
    return spark.createDataFrame(
        [(s, r, i, v, v) for (s, r), vs in streams.items() for i, v in enumerate(vs)],
        "stream_id string, recording_id string, frame long, left double, right double")


def test_mix_two_and_silent_sources(spark):
    df = samples(spark, {("a", "r"): [1.0, 1.0], ("b", "r"): [0.5] * 4, ("c", "r"): [0.0] * 9, ("d", "q"): [0.3]})
    gains = tl.source_gains(tl.stream_levels(df), df.select("stream_id", "recording_id").distinct())
    got = rows(tl.mix(df.drop("recording_id"), gains).select("recording_id", "frame", "left"), "recording_id", "frame")
    assert got == [("q", 0, 0.3)] + [("r", i, v) for i, v in enumerate([0.75, 0.75, 0.25, 0.25])]


def test_speech_samples(spark):
    df = spark.createDataFrame([("r", i, 0.5, 0.25) for i in range(480)],
                               "recording_id string, frame long, left double, right double")
    got = rows(tl.speech_samples(df).select("frame", "sample"), "frame")
    assert len(got) == 160 and got[0] == (0, 12288)
    edge = spark.createDataFrame([(float("nan"),), (2.0,), (-3.0,), (float("inf"),)], "x double")
    assert [r[0] for r in edge.select(tl.sixteen_bit(F.col("x"))).collect()] == [0, 32767, -32768, 0]


def one(spark, c):
    return spark.range(1).select(c).head()[0]


def test_durations(spark):
    lit = F.lit
    none = F.lit(None).cast("bigint")
    assert one(spark, md.media_duration(lit(60), lit(30), lit(2500), lit(3000))) == 2500
    assert one(spark, md.media_duration(lit(0), lit(30), none, lit(1234))) == 1234
    assert one(spark, md.frames_duration(lit(1), lit(3))) == 333 and one(spark, md.frames_duration(lit(5), lit(0))) is None


def test_output_sizes(spark):
    def size(w, h, bound):
        return tuple(one(spark, md.bounded_size(F.lit(w), F.lit(h), bound)))
    assert size(1279, 719, md.CAPTURE_BOUND) == (1278, 718)
    assert size(3600, 2338, md.ENCODE_BOUND) == (1662, 1080)
    assert size(3600, 2338, md.CAPTURE_BOUND) == (1108, 720)
    assert size(1930, 1080, md.ENCODE_BOUND) == (1920, 1074)
    assert size(1, 1, md.ENCODE_BOUND) == (1, 1)
    assert one(spark, md.thumbnail_height(F.lit(1920), F.lit(1080))) == 270
    assert tuple(one(spark, md.letterbox(F.lit(100), F.lit(200), F.lit(1280), F.lit(720)))) == (360, 720, 460, 0)


def test_frame_checks(spark):
    df = spark.createDataFrame(
        [("s", 0, 7, 1, 1, 4), ("s", 1, 7, 2, 1, 8), ("s", 2, 7, 1, 1, 3), ("s", 3, 99, 1, 1, 4), ("s", 4, 8, 1, 1, 1),
         ("z", 0, 7, 0, 1, 0)],
        "stream_id string, frame_seq long, format_code long, width long, height long, byte_count long")
    got = {(r.stream_id, r.frame_seq): r.reason for r in md.check_frames(df).collect()}
    assert got == {("s", 0): None, ("s", 1): "size changed", ("s", 2): "wrong byte count",
                   ("s", 3): "unsupported format", ("s", 4): None, ("z", 0): "invalid size"}
    report = rows(md.frame_report(md.check_frames(df)), "stream_id")
    assert report == [("s", 5, 3, 1, "size changed"), ("z", 1, 1, 0, "invalid size")]


def write_audio(path, blocks, magic=b"AUDIO_V1\n", tail=b""):
    with open(path, "wb") as f:
        f.write(magic)
        for ms, data in blocks:
            f.write(struct.pack("<QQQI", ms, 2, 3, len(data)) + data)
        f.write(tail)


def test_raw_audio_files(spark, tmp_path):
    good = [(i, struct.pack("<2h", i, -i)) for i in range(1000)]
    write_audio(tmp_path / "good.pcm", good)
    write_audio(tmp_path / "cut.pcm", good[:2], tail=struct.pack("<QQQI", 1, 1, 1, 50) + b"xx")
    write_audio(tmp_path / "head.pcm", good[:1], tail=b"abc")
    write_audio(tmp_path / "other.pcm", good, magic=b"SOMETHING")
    write_audio(tmp_path / "empty.pcm", [])
    write_audio(tmp_path / "huge.pcm", [(2 ** 63 + 1, b"")])
    files = fl.inventory(spark, str(tmp_path), "*.pcm")
    assert files.count() == 6
    index = raw.audio_index(files, b"AUDIO_V1\n")
    errors = {r.path.split("/")[-1]: r.error for r in raw.file_errors(index).collect()}
    assert errors == {"cut.pcm": "truncated block", "head.pcm": "truncated block header",
                      "other.pcm": "unsupported file header", "huge.pcm": "header value out of range"}
    counts = {r.path.split("/")[-1]: r["count"] for r in index.where("error IS NULL").groupBy("path").count().collect()}
    assert counts == {"good.pcm": 1000, "cut.pcm": 2, "head.pcm": 1}
    formats = index.select("path").distinct().select(
        "path", F.substring_index("path", "/", -1).alias("stream_id"), F.lit("i16").alias("sample_format"),
        F.lit(2).cast("bigint").alias("channels"))
    decoded = raw.decode_files(index, formats)
    got = {r.block_seq: (r.elapsed_ms, r.left, r.right) for r in decoded.where("stream_id = 'good.pcm'").collect()}
    assert len(got) == 1000 and got[999] == (999, [999 / 32768], [-999 / 32768])


def test_raw_video_files(spark, tmp_path):
    with open(tmp_path / "v.raw", "wb") as f:
        f.write(b"VIDEO_V1\n")
        for n, (code, w) in enumerate([(7, 1), (8, 1), (7, 2), (99, 1)]):
            f.write(struct.pack("<QQIIII", n, n + 5, code, w, 1, 4) + b"abcd")
        f.write(b"\x01\x02")
    index = raw.video_index(fl.inventory(spark, str(tmp_path)), b"VIDEO_V1\n")
    got = rows(index.select("frame_seq", "display_time_ms", "format_code", "width", "byte_count", "error"), "frame_seq")
    assert got[:4] == [(0, 5, 7, 1, 4, None), (1, 6, 8, 1, 4, None), (2, 7, 7, 2, 4, None), (3, 8, 99, 1, 4, None)]
    assert got[4][5] == "truncated block header"
    checked = md.check_frames(index.where("error IS NULL").withColumnRenamed("path", "stream_id"))
    assert [r.reason for r in checked.orderBy("frame_seq").collect()] == [
        None, None, "size changed", "unsupported format"]


def manifest(**changes):
    base = {"format": "chunks-v1", "status": "completed", "codec": "h264", "container": "mp4", "width": 2, "height": 2,
            "frameRate": 30, "frameCount": 3, "durationMs": 100, "thumbnailFramePath": "t",
            "chunks": [{"path": "c0", "index": 0, "startFrame": 0, "frameCount": 3, "durationMs": 100}]}
    return {**base, **changes}


def test_manifests(spark, tmp_path):
    cases = {"ok": manifest(), "open": manifest(status="recording"), "alien": manifest(format="x"),
             "sum": manifest(frameCount=4), "none": manifest(chunks=[]), "size": manifest(width=0)}
    for name, body in cases.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=2))
    (tmp_path / "junk.json").write_bytes(b"RAW\x00\x01")
    short = manifest()
    del short["codec"]
    (tmp_path / "short.json").write_text(json.dumps(short))
    found = md.check_manifests(dc.read_manifests(spark, str(tmp_path), "chunks-v1"))
    got = {r.manifest_path.split("/")[-1][:-5]: (r.problem, r.warning is not None) for r in found.collect()}
    assert got == {"ok": (None, False), "open": (None, True), "sum": ("frame count mismatch", False),
                   "none": ("no finished chunks", False), "size": ("invalid size or frame rate", False)}


def test_transcript_and_session_files(spark, tmp_path):
    home = tmp_path / "r1"
    home.mkdir()
    (home / "transcript.json").write_text('{"text": "a\\nb",\n "segments": []}')
    raw_rows = dc.read_transcript_json(spark, str(tmp_path / "*" / "transcript.json")).collect()
    assert len(raw_rows) == 1 and json.loads(raw_rows[0].json)["text"] == "a\nb"
    session = {"sessionId": "s", "recordingId": "r", "status": "stopped", "frameRate": 30, "frameCount": 2,
               "resolution": {"width": 4, "height": 3}, "audio": {"mode": "none", "microphone": None, "source": None},
               "video": {"path": "v", "source": {"id": "display:1", "kind": "display", "title": "Main"}}}
    side = tmp_path / "side"
    side.mkdir()
    (side / "session.json").write_text(json.dumps(session, indent=2))
    flat = dc.flat_sessions(dc.read_session_files(spark, str(side))).head()
    assert (flat.id, flat.width, flat.video_source_title, flat.audio_mode, flat.microphone_audio_path) == (
        "s", 4, "Main", "none", None)


def test_requested_streams_and_warnings(spark):
    from test_library import frame
    s = frame(spark, "recording_sessions",
              {"id": "1", "audio_mode": "microphone_and_source", "microphone_audio_path": "m", "microphone_audio_sample_rate": 1,
               "microphone_audio_channels": 1, "microphone_audio_sample_format": "f32"},
              {"id": "2", "audio_mode": "none", "audio_path": "l", "audio_sample_rate": 1, "audio_channels": 1, "audio_sample_format": "i64"},
              {"id": "3", "audio_mode": "none"})
    streams = tl.requested_streams(s)
    assert rows(streams.select("session_id", "label", "path"), "session_id", "label") == [
        ("1", "microphone audio", "m"), ("1", "source audio", None), ("2", "microphone audio", "l")]
    levels = spark.createDataFrame([("m", False), ("l", True)], "path string, is_silent boolean")
    got = rows(tl.stream_warnings(streams, levels).select("session_id", "reason"), "session_id")
    assert got == [("1", "source audio was requested but no capture file was recorded"), ("2", "unsupported sample format")]


def test_a_year_of_silence_is_one_row(spark):
    """Two short sounds a year apart: the gap is one row through resampling, mixing and speech
    preparation, beside the few cells with sound."""
    year = 365 * 24 * 3600 * 48000
    blocks = spark.createDataFrame(
        [("s", 0, 3, [0.5, 1.0, -0.5], [0.5, 1.0, -0.5]), ("s", 3, year, None, None), ("s", year + 3, 2, [0.25, 0.5], [0.25, 0.5])],
        "stream_id string, first long, n long, left array<double>, right array<double>")
    width = 64
    cut = ab.cells(blocks, tl.STEREO, "stream_id", width, overlap=1)
    assert cut.where("left IS NULL").count() == 1 and cut.count() <= 4
    assert cut.agg(F.sum("n")).head()[0] == year + 5
    slow = ab.resample(blocks, 48000, 16000, tl.STEREO, "stream_id", width)
    assert slow.where("left IS NULL").count() == 1 and slow.count() <= 4
    assert slow.agg(F.sum("n")).head()[0] == (year + 5 + 1) // 3
    gains = spark.createDataFrame([("s", "r", 0.5)], "stream_id string, recording_id string, gain double")
    mixed = ab.mix(blocks, gains, width)
    assert mixed.where("left IS NULL").count() == 1
    assert mixed.agg(F.sum("n"), F.max(F.col("first") + F.col("n"))).head()[:] == (year + 5, year + 5)
    heard = tl.speech_blocks(mixed, 48000, width=width)
    assert heard.where("sample IS NULL").count() == 1
    tail = ab.resample(blocks.where("first < 100").withColumn("n", F.least("n", F.lit(200))), 3, 1, tl.STEREO, "stream_id", 8)
    got = {r.frame: r.left for r in ab.rows_of_blocks(tail, tl.STEREO, "stream_id", 16).collect()}
    assert sorted(got) == list(range(68)) and got[0] == 0.5 and got[1] == 0.0


@pytest.mark.parametrize("width", [1, 2, 5])
def test_cells_hold_every_frame_and_one_more(spark, width):
    """Blocks of any cut, silence included, give the frames back, with the next one as overlap."""
    values = [0.0 if 4 <= i < 19 or i > 27 else (i * 7 % 11) / 10 + 0.1 for i in range(31)]
    parts = [(0, 3), (3, 1), (4, 15), (19, 2), (21, 7), (28, 3)]
    blocks = spark.createDataFrame(
        [("s", a, n, None if values[a] == 0.0 else values[a:a + n]) for a, n in parts],
        "k string, first long, n long, mono array<double>")
    seen = {}
    for r in ab.cells(blocks, ["mono"], "k", width, overlap=1).collect():
        for i in range(r.n):
            seen[r.first + i] = 0.0 if r.mono is None else r.mono[i]
        if r.mono is not None:
            assert r.n <= width and len(r.mono) == min(r.n + 1, 31 - r.first) or r.n < width
            assert r.mono == values[r.first:r.first + len(r.mono)]
    assert [seen[i] for i in range(31)] == values


def test_capture_source_ranges_and_damage(spark, tmp_path):
    """Written in parallel, read by ranges of any size: every block once; no index, a wrong
    magic and cut files give what can be read and one error each."""
    import os

    from reelgrid.sources import capture_source as cs

    cs.register(spark)
    path = str(tmp_path / "capture")
    options = {"path": path, "kind": "audio", "magic": "MAGIC", "indexEvery": "3"}
    rows_in = spark.range(300).select(
        F.concat(F.lit("u"), F.col("id") % 3, F.lit("/0")).alias("file"), F.col("id").alias("elapsed_ms"),
        (F.col("id") * 2).alias("callback_stream_ns"), F.col("id").alias("capture_stream_ns"),
        F.repeat(F.lit("x"), (F.col("id") % 5).cast("int")).cast("binary").alias("bytes"))
    (rows_in.repartition(3, "file").sortWithinPartitions("file", "elapsed_ms")
     .write.format(cs.NAME).options(**options).mode("append").save())

    def read(split):
        return spark.read.format(cs.NAME).options(**options, payload="true", splitBytes=str(split)).load()

    whole = rows(read(1 << 20), "file", "block_seq")
    assert len(whole) == 300 and whole == rows(read(100), "file", "block_seq") == rows(read(7), "file", "block_seq")
    assert read(100).rdd.getNumPartitions() > read(1 << 20).rdd.getNumPartitions()
    assert {(r.elapsed_ms, bytes(r.bytes)) for r in read(64).collect()} == {(i, b"x" * (i % 5)) for i in range(300)}
    os.remove(f"{path}/u0/0.raw.index")
    assert rows(read(50), "file", "block_seq") == whole
    with open(f"{path}/u1/0.raw", "r+b") as f:
        f.truncate(os.path.getsize(f"{path}/u1/0.raw") - 1)
    with open(f"{path}/u2/0.raw", "r+b") as f:
        f.write(b"m")
    for split in (40, 1 << 20):
        bad = read(split).where("error IS NOT NULL")
        assert rows(bad.select("file", "block_seq", "error"), "file") == [
            ("u1/0", 99, "truncated block"), ("u2/0", 0, "unsupported file header")]
        assert read(split).where("error IS NULL").count() == 199


def test_many_captures_make_few_files(spark, tmp_path):
    """Files of a write task lie in one pack; the inventory has each of them by name and size."""
    from reelgrid.plans import capture_queries as cq
    from reelgrid.sources import capture_source as cs

    blocks = spark.range(3000).select(
        F.concat(F.lit("u"), F.col("id") % 1000, F.lit("/0")).alias("file"), F.col("id").alias("order"),
        *[F.col("id").alias(n) for n in cs.FIELDS["audio"][1]],
        F.repeat(F.lit("x"), (F.col("id") % 1000 % 5).cast("int")).cast("binary").alias("bytes"))
    root = cq._written(spark, blocks, "audio", "MAGIC")
    found = rows(fl.packed(spark, root), "file")
    assert [tuple(r) for r in found] == sorted((f"u{i}/0", 5 + 3 * (28 + i % 5)) for i in range(1000))
    base = cs.file_system(root)[1]
    stored = [f for _, _, names in os.walk(base) for f in names]
    assert len(stored) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(os.path.getsize(f"{base}/{f}") for f in stored if f.endswith(cs.PACK)) == sum(n for _, n in found)


def test_small_capture_files_share_tasks(spark, tmp_path):
    from reelgrid.sources import capture_source as cs

    cs.register(spark)
    options = {"path": str(tmp_path / "c"), "kind": "audio", "magic": "MAGIC"}
    blocks = spark.range(200).select(
        F.concat(F.lit("u"), "id").alias("file"), *[F.col("id").alias(n) for n in cs.FIELDS["audio"][1]],
        F.lit("abc").cast("binary").alias("bytes"))
    blocks.coalesce(2).write.format(cs.NAME).options(**options).mode("append").save()
    found = spark.read.format(cs.NAME).options(**options).load()
    assert found.rdd.getNumPartitions() == 1 and found.where("error IS NULL").count() == 200


def test_packed_captures_read_by_ranges(spark, tmp_path, monkeypatch):
    """A pack read by ranges of any size gives every block once; a file cut in it ends with an
    error, and the file behind it is whole; a file of another magic is told."""
    from reelgrid.plans import capture_queries as cq
    from reelgrid.sources import capture_source as cs

    names = cs.FIELDS["video"][1]
    blocks = spark.range(1500).select(
        F.concat(F.lit("u"), F.col("id") % 2, F.lit("/0")).alias("file"), F.col("id").alias("order"),
        *[F.col("id").alias(n) for n in names],
        F.repeat(F.lit("x"), (F.col("id") % 7 + 1).cast("int")).cast("binary").alias("bytes")).coalesce(1)
    seen = []
    for split in (1 << 20, 1000):
        monkeypatch.setattr(cq, "SPLIT_BYTES", split)
        seen.append(rows(cq._round_trip(spark, blocks, "video", "MAGIC"), "file", "block_seq"))
    assert seen[0] == seen[1] and len(seen[0]) == 1500
    bad = [r for r in seen[0] if r[-1]]
    assert [(r[0], r[1], r[-1]) for r in bad] == [("u0/0", 749, "truncated block")]
    good = [r for r in seen[0] if not r[-1]]
    assert sorted((r[2], bytes(r[-2])) for r in good) == [(i, b"x" * (i % 7 + 1)) for i in range(1500) if i != 1498]
    assert [r[-4] for r in good if r[0] == "u1/0"][:2] == [5 + 32, 5 + 32 + 2 + 32]
    root = cq._written(spark, blocks, "video", "MAGIC")
    other = spark.read.format(cs.NAME).options(path=root, kind="video", magic="OTHER", splitBytes="1000").load()
    assert rows(other.select("file", "block_seq", "error"), "file") == [
        ("u0/0", 0, "unsupported file header"), ("u1/0", 0, "unsupported file header")]
