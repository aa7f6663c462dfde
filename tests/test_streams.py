"""Streams: state that ends, events that never come."""

import os


from conftest import rows
from reelgrid.plans import stream_queries as sq
from reelgrid.streaming import counters

SMALL = "/root/testdata/sf0.001"


def test_a_stopped_session_leaves_the_state(spark, tmp_path):
    """Three batches: an open session goes on, a stopped one gives its last counters and its
    state goes; parts of a batch are merged in the order of seq."""
    counters.use_state_store(spark)
    path, out = str(tmp_path / "events"), []
    batches = [
        [("a", 1, "frame", None, 10, 20, None), ("a", 2, "error", None, None, None, "first"), ("b", 3, "microphone", 5, None, None, None)],
        [("a", 5, "frame", None, 30, 40, None), ("a", 4, "error", None, None, None, "second"), ("b", 6, "source", 7, None, None, None)],
        [("a", 7, "stop", None, None, None, None), ("b", 8, "microphone", 6, None, None, None)]]
    held = []
    for batch in batches:
        spark.createDataFrame(batch, counters.CAPTURE_EVENTS).repartition(2).write.mode("append").parquet(path)
        query = (counters.ending_counters(counters.read_capture_events(spark, path)).writeStream
                 .outputMode("update").foreachBatch(lambda df, n: out.append(rows(df, "session_id")))
                 .option("checkpointLocation", str(tmp_path / "checkpoint"))
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        held.append(sum(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]
                        if p["numInputRows"]))
    seen = [r for r in out if r]
    assert seen[-1] == [("a", 2, 0, 0, 30, 40, 2, "first", "failed", True),
                        ("b", 0, 11, 7, None, None, 0, None, "stopped", False)]
    assert seen[1][0] == ("a", 2, 0, 0, 30, 40, 2, "first", "failed", False)
    assert held[0] > held[-1]


def test_no_events(spark, tmp_path):
    for name in os.listdir(SMALL):
        table = spark.read.parquet(f"{SMALL}/{name}")
        (table.limit(0) if name.startswith("events") else table).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    assert sq.live_counters(spark, str(tmp_path)).count() == 0
    assert sq.job_state_stream(spark, str(tmp_path)).count() == 0


def test_a_session_costs_one_read_and_one_write_of_its_state():
    """Rows, not frames, reach a session's counters; a session that ends in its first batch
    writes nothing."""
    calls = []

    class Held:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            calls.append("clear")
            self.value = None

    counting = counters._Counting()
    counting.held = Held()
    part = ("a", 1, 2, 0, 0, 7, 10, 20, None, None)
    first = list(counting.handleInputRows(("a",), iter([(*part, False)]), None))
    assert tuple(first[0]) == ("a", 1, 2, 0, 10, 20, 0, None, "stopped", False) and calls == ["get", "update"]
    last = list(counting.handleInputRows(("a",), iter([(*part, True)]), None))
    assert tuple(last[0]) == ("a", 2, 4, 0, 10, 20, 0, None, "stopped", True) and calls[2:] == ["get", "clear"]
    list(counting.handleInputRows(("b",), iter([("b", *part[1:], True)]), None))
    assert calls[4:] == ["get"]
