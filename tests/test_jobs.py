import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from reelgrid.operators import jobs as jb
from reelgrid.operators import recovery as rc
from reelgrid.streaming import job_states
from test_library import frame

EVENT = ("job_id string, seq long, at string, state string, attempts long, output_json string, "
         "error_message string, interrupted boolean, started_at string, completed_at string")


def step(row, event):
    """One update, the way the rules are stated."""
    _, _, at, state, attempts, output, error, interrupted, started, completed = event
    new = dict(row)
    new["state"] = state or row["state"]
    new["attempts"] = row["attempts"] if attempts is None else attempts
    new["interrupted"] = row["interrupted"] if interrupted is None else interrupted
    bad = new["state"] in ("failed", "cancelled")
    new["output_json"] = output if output is not None else (
        row["output_json"] if new["state"] == "succeeded" else None)
    new["error_message"] = (error if error is not None else row["error_message"]) if bad else None
    if new["error_message"] is not None or new["interrupted"]:
        new["last_error_at"] = at
    elif not bad:
        new["last_error_at"] = None
    new["started_at"] = started or row["started_at"]
    if new["state"] == "running" and new["started_at"] is None:
        new["started_at"] = at
    if new["state"] in ("queued", "running"):
        new["completed_at"] = None
    else:
        new["completed_at"] = completed or row["completed_at"] or at
    new["updated_at"] = at
    new["events"] = row["events"] + 1
    return new


START = {"state": "queued", "attempts": 0, "output_json": None, "error_message": None, "interrupted": False,
         "last_error_at": None, "started_at": None, "completed_at": None, "updated_at": None, "events": 0}


def loop(events):
    out = {}
    for e in sorted(events, key=lambda x: x[1]):
        out[e[0]] = step(out.get(e[0], START), e)
    return out


def random_events(rng, jobs=12, n=150):
    events, seen = [], set()
    for seq in range(n):
        job = f"j{rng.randrange(jobs)}"
        # The first event of a job names its state.
        state = rng.choice(["queued", "running", "succeeded", "failed", "cancelled"] + [None] * (3 if job in seen else 0))
        seen.add(job)
        maybe = lambda v: v if rng.random() < 0.35 else None
        events.append((job, seq, f"t{seq:04d}", state, maybe(seq), maybe(f"o{seq}"), maybe(f"e{seq}"),
                       maybe(rng.random() < 0.5), maybe(f"s{seq}"), maybe(f"c{seq}")))
    return events


def as_dicts(df):
    return {r.job_id: {k: r[k] for k in START} for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_fold_equals_loop(spark, seed):
    events = random_events(random.Random(seed))
    assert as_dicts(jb.fold_events(spark.createDataFrame(events, EVENT))) == loop(events)


@pytest.mark.parametrize("seed", range(2))
def test_fold_in_batches_equals_loop(spark, tmp_path, seed):
    events = random_events(random.Random(seed), jobs=5, n=80)
    target = str(tmp_path)
    for batch, low in enumerate(range(0, 80, 20)):
        part = spark.createDataFrame(events[low:low + 20], EVENT)
        job_states.fold_batch(part, batch, target)
        if batch == 2:
            # A batch that runs again writes the same result.
            job_states.fold_batch(part, batch, target)
    assert as_dicts(job_states.states_after(spark, target, 3)) == loop(events)


def test_hot_job_folds_the_same(spark):
    events = [("hot", i, f"t{i:05d}", "failed" if i % 2 else "running", None, None, f"e{i}", None, None, None)
              for i in range(5000)]
    assert as_dicts(jb.fold_events(spark.createDataFrame(events, EVENT))) == loop(events)


def one_job(spark, **values):
    return frame(spark, "processing_jobs", {"id": "j", "kind": "ai_summary", "state": "queued",
                                            "max_attempts": 3, **values})


def patch(spark, **values):
    names = ["id", "state", "attempts", "output_json", "error_message", "interrupted", "started_at", "completed_at"]
    kinds = {"attempts": "bigint", "interrupted": "boolean"}
    return spark.range(1).select(*[
        F.lit({"id": "j", **values}.get(n)).cast(kinds.get(n, "string")).alias(n) for n in names])


def test_set_running(spark):
    j = jb.update_jobs(one_job(spark), patch(spark, state="running", attempts=1), "7").head()
    assert (j.state, j.attempts, j.started_at, j.completed_at) == ("running", 1, "7", None)


def test_claim_ignores_limit_and_retry_keeps_attempts(spark):
    j = one_job(spark, attempts=9)
    claimed = jb.claim(j, 1, "5")
    assert (claimed.head().state, claimed.head().attempts) == ("running", 10)
    assert jb.over_limit(claimed).count() == 1
    failed = one_job(spark, state="failed", attempts=2, error_message="x", interrupted=True, completed_at="1")
    again = jb.retry_jobs(failed, failed.select("id"), "9").head()
    assert (again.state, again.attempts, again.error_message, again.interrupted, again.completed_at) == (
        "queued", 2, None, False, None)


def test_create_defaults_and_refusals(spark):
    r = frame(spark, "recordings", {"id": "r"})
    req = spark.createDataFrame([(1, "r", "k", None, 0, None), (2, None, "k", 4, 2, None), (3, "no", "k", 1, 1, None)],
                                "request_id int, recording_id string, kind string, priority long, max_attempts long, input_json string")
    got = rows(jb.create_jobs(req, r, "1").select("recording_id", "priority", "max_attempts", "state"), "priority")
    assert got == [("r", 0, 3, "queued"), (None, 4, 2, "queued")]
    assert [x.request_id for x in jb.refused_jobs(req, r).collect()] == [3]


def recovery_tables(spark):
    return {
        "recordings": frame(spark, "recordings", {"id": "cap", "status": "capturing", "duration_ms": 4},
                            {"id": "enc", "status": "processing", "media_path": "m"},
                            {"id": "due", "status": "processing"}, {"id": "say", "status": "completed"}),
        "recording_sessions": frame(spark, "recording_sessions",
                                    {"id": "s1", "recording_id": "cap", "status": "capturing"},
                                    {"id": "s2", "recording_id": "due", "status": "stopped"}),
        "processing_jobs": frame(spark, "processing_jobs",
                                 {"id": "1", "recording_id": "enc", "kind": "encode_recording", "state": "running"},
                                 {"id": "2", "recording_id": "say", "kind": "run_whisper", "state": "running",
                                  "input_json": '{"modelName":"base"}'},
                                 {"id": "3", "recording_id": "say", "kind": "ai_summary", "state": "running"},
                                 {"id": "4", "kind": "ai_summary", "state": "running"},
                                 {"id": "5", "kind": "clean_temp_files", "state": "queued"}),
        "transcripts": frame(spark, "transcripts", {"id": "t", "recording_id": "say", "status": "completed", "text": "x"}),
        "transcript_segments": frame(spark, "transcript_segments", {"id": "g", "transcript_id": "t", "recording_id": "say"},
                                     {"id": "h", "transcript_id": "u", "recording_id": "other"}),
        "ai_summaries": frame(spark, "ai_summaries"),
    }


def test_recovery(spark):
    after = rc.recover(recovery_tables(spark), "9")
    assert tuple(after["recovery"].head()) == (4, 1, 1, 2)
    r = {x.id: (x.status, x.media_path, x.failure_message) for x in after["recordings"].collect()}
    assert r["cap"] == ("failed", None, rc.INTERRUPTED_CAPTURE)
    assert r["enc"] == ("failed", None, rc.INTERRUPTED_JOB) and r["due"][0] == "processing"
    s = {x.id: (x.status, x.duration_ms) for x in after["recording_sessions"].collect()}
    assert s == {"s1": ("failed", 0), "s2": ("stopped", None)}
    t = after["transcripts"].head()
    assert (t.id, t.status, t.text, t.model_name) == ("t", "failed", None, "base")
    assert rows(after["transcript_segments"].select("id")) == [("h",)]
    assert rows(after["ai_summaries"].select("recording_id", "status")) == [("say", "failed")]
    jobs = after["processing_jobs"]
    assert jobs.where("state = 'queued'").count() == 2 and jobs.where("interrupted").count() == 4
    # Nothing is left to recover; the rescheduled job is not queued twice.
    again = rc.recover({k: after[k] for k in recovery_tables(spark)}, "10")
    assert tuple(again["recovery"].head()) == (0, 0, 0, 2)


def test_cleanup_plan(spark):
    r = frame(spark, "recordings", {"id": "a", "status": "completed", "media_path": "m/a.mp4", "recording_directory": "recordings/a"},
              {"id": "b", "status": "completed", "media_path": "m/b.mp4", "recording_directory": "recordings/b/"})
    s = frame(spark, "recording_sessions",
              {"id": "1", "recording_id": "a", "temp_directory": "temp/1", "video_path": "temp/1/v"},
              {"id": "2", "recording_id": "b", "temp_directory": "temp/2", "video_path": "temp/2/v",
               "audio_path": "temp/2/mic", "microphone_audio_path": "temp/2/mic", "metadata_path": "temp/2/j"})
    files = spark.createDataFrame([(x,) for x in (
        "file:/lib/m/a.mp4", "/lib/temp/1/deep/file", "/lib/recordings/a/encoding-audio.raw",
        "/lib/recordings/b/recording.tmp.mp4.sb-9", "/lib/recordings/b/keep.txt")], "path string")
    got = rows(rc.cleanup_plan(r, s, files, "/lib"), "recording_id", "action", "path")
    assert got == [("a", "remove", "/lib/recordings/a/encoding-audio.raw"), ("a", "remove", "/lib/temp/1"),
                   ("b", "preserve", "/lib/temp/2"), ("b", "preserve", "/lib/temp/2/j"),
                   ("b", "preserve", "/lib/temp/2/mic"), ("b", "preserve", "/lib/temp/2/v"),
                   ("b", "remove", "/lib/recordings/b/recording.tmp.mp4.sb-9")]


def test_job_states_read_the_folders_of_their_events(spark, tmp_path, monkeypatch):
    """A batch reads the chains of its own jobs' hashes only; a long chain is written whole; an
    empty batch and a batch run again change nothing."""
    monkeypatch.setattr(job_states, "LONGEST_CHAIN", 3)
    target = str(tmp_path / "states")

    def events(ids, seq, state):
        return spark.createDataFrame([(f"j{i}", seq, str(seq), state) for i in ids],
                                     "job_id string, seq long, at string, state string").select(
            *[F.col(f.name) if f.name in ("job_id", "seq", "at", "state") else F.lit(None).cast(f.dataType).alias(f.name)
              for f in job_states.JOB_EVENTS.fields])

    job_states.fold_batch(events([], 0, "queued"), 0, target)
    assert job_states.states_after(spark, target, 0).count() == 0
    job_states.fold_batch(events(range(200), 1, "queued"), 1, target)
    for batch, state in ((2, "running"), (3, "succeeded"), (4, "failed")):
        job_states.fold_batch(events([7], batch, state), batch, target)
        job_states.fold_batch(events([7], batch, state), batch, target)
    chains, _ = job_states.read_chains(spark, target, 4)
    bucket = spark.sql(f"SELECT CAST(pmod(xxhash64('j7'), {job_states.BUCKETS}) AS INT)").head()[0]
    assert chains[bucket] == [3, 4] and all(c == [1] for k, c in enumerate(chains) if c and k != bucket)
    assert len(job_states.folders(target, chains, [bucket])) == 2
    after = {r.job_id: r.state for r in job_states.states_after(spark, target, 4).collect()}
    assert len(after) == 200 and after["j7"] == "failed" and after["j8"] == "queued"
