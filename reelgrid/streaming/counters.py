"""Live capture counters over a stream of capture events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reelgrid.operators import media

STOP = "stop"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

CAPTURE_EVENTS = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("byte_count", T.LongType()),
    T.StructField("width", T.LongType()),
    T.StructField("height", T.LongType()),
    T.StructField("message", T.StringType()),
])

# Counters of a part of a session: sums, and values with the seq they were seen at.
PART = ("frames long, microphone long, source long, errors long, frame_seq long, width long, "
        "height long, error_seq long, first_error string")
PARTS = f"session_id string, {PART}, stopped boolean"
COUNTERS = ("session_id string, frame_count long, microphone_audio_byte_count long, "
            "source_audio_byte_count long, width long, height long, error_count long, "
            "first_error string, status string, stopped boolean")
_SHOWN = Row(*(f.split()[0] for f in COUNTERS.split(", ")))
SUMS = ("frames", "microphone", "source", "errors")


def read_capture_events(spark: SparkSession, path: str,
                        files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(CAPTURE_EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def live_counters(events: DataFrame) -> DataFrame:
    """Counters per session, the same aggregates as the batch statistics.

    Meant for update mode. Every batch is combined on the map side first, and the state
    is one row of counters per session. There is no lateness rule: a session counts
    events in arrival order, and its state stays.
    """
    return media.capture_stats(events)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each session of an Arrow batch, so that a session with most events sends few
    rows to its state."""
    schema = pa.schema([("session_id", pa.string()), *((n, pa.int64()) for n in SUMS),
                        *((n, pa.int64()) for n in ("frame_seq", "width", "height", "error_seq")),
                        ("first_error", pa.string()), ("stopped", pa.bool_())])
    for batch in batches:
        rows = batch.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        kind = rows["kind"]
        rows = rows.assign(
            frames=(kind == "frame").astype("int64"), errors=(kind == "error").astype("int64"),
            microphone=rows["byte_count"].where(kind == "microphone", 0).fillna(0),
            source=rows["byte_count"].where(kind == "source", 0).fillna(0), stopped=kind == STOP)
        by = rows.groupby("session_id", sort=False, dropna=False)
        out = by[[*SUMS, "stopped"]].agg({**dict.fromkeys(SUMS, "sum"), "stopped": "any"})
        frames = rows[kind == "frame"].sort_values("seq").groupby("session_id", dropna=False).tail(1)
        errors = rows[kind == "error"].sort_values("seq").groupby("session_id", dropna=False).head(1)
        out = out.join(frames.set_index("session_id")[["seq", "width", "height"]].rename(
            columns={"seq": "frame_seq"})).join(errors.set_index("session_id")[["seq", "message"]].rename(
                columns={"seq": "error_seq", "message": "first_error"}))
        yield pa.RecordBatch.from_pandas(out.reset_index()[schema.names], schema, preserve_index=False)


def merged(parts: list[tuple]) -> tuple:
    """One part from several, each in the order of PART."""
    sums = [sum(p[k] for p in parts) for k in range(4)]
    framed = [p for p in parts if p[4] is not None]
    failed = [p for p in parts if p[7] is not None]
    frame = max(framed, key=lambda p: p[4])[4:7] if framed else (None, None, None)
    error = min(failed, key=lambda p: p[7])[7:9] if failed else (None, None)
    return (*sums, *frame, *error)


class _Counting(StatefulProcessor):
    """A session's counters until its stop event, with which they leave the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("counters", PART)

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        parts, stopped = [], False
        for row in rows:
            _, *part, ended = row
            parts.append(tuple(part))
            stopped |= bool(ended)
        before = self.held.get()
        if before is not None:
            parts.append(tuple(before))
        whole = merged(parts)
        if not stopped:
            self.held.update(whole)
        elif before is not None:
            self.held.clear()
        frames, microphone, source, errors, _, width, height, _, first = whole
        yield _SHOWN(key[0], frames, microphone, source, width, height, errors, first,
                     "failed" if errors else "stopped", stopped)

    def close(self) -> None:
        pass


def ending_counters(events: DataFrame) -> DataFrame:
    """Counters per session, as ``live_counters`` has them, and whether the session stopped.

    A session's state ends with its ``stop`` event, so the state grows with the open sessions
    only; what arrives after the stop begins a new count. For update mode, with the state store
    set by ``use_state_store``.
    """
    parts = events.mapInArrow(_parts, PARTS)
    return parts.groupBy("session_id").transformWithState(
        _Counting(), COUNTERS, outputMode="update", timeMode="none")


def use_state_store(spark: SparkSession) -> None:
    """Counters with an end need a store that keeps states by name."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
