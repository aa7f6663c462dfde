"""Raw capture files: length-prefixed timed blocks of audio or video.

A file is first indexed: one task walks its headers and seeks over the payloads, so
memory use does not depend on file or block size. The index rows are then spread over
the cluster and each payload is read by its offset, so one long capture is decoded by
many tasks. File magic is a parameter.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid import schemas
from reelgrid.operators.timeline import SAMPLE_BYTES

# Little-endian header layouts. Audio: elapsed ms, callback ns, capture ns,
# byte count. Video: elapsed ms, display ms, format code, width, height, byte count.
AUDIO_HEADER = "<QQQI"
VIDEO_HEADER = "<QQIIII"

ROWS_PER_BATCH = 4096
LARGEST_LONG = 2 ** 63 - 1

# Payload bytes a task decodes at a time.
BYTES_HELD = 1 << 21


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1)
                                          if path.startswith("file:/")
                                          and not path.startswith("file://") else path)
    return system.open_input_file(name)


def _headers(path: str, magic: bytes, layout: str) -> Iterator[tuple]:
    """(fields, payload offset, payload length, error) of each block, in file order."""
    head = struct.calcsize(layout)
    with _open(path) as f:
        size = f.size()
        if f.read(len(magic)) != magic:
            yield None, None, None, "unsupported file header"
            return
        at = len(magic)
        while at < size:
            f.seek(at)
            raw = f.read(head)
            if len(raw) < head:
                yield None, None, None, "truncated block header"
                return
            *fields, count = struct.unpack(layout, raw)
            if at + head + count > size:
                yield None, None, None, "truncated block"
                return
            if max(fields) > LARGEST_LONG:
                yield None, None, None, "header value out of range"
            else:
                yield fields, at + head, count, None
            at += head + count


def _index(files: DataFrame, magic: bytes, layout: str, schema, names: list[str],
           seq: str) -> DataFrame:
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [f.name for f in schema.fields]
        for batch in batches:
            for path in batch["path"]:
                rows = []
                for n, (fields, offset, count, error) in enumerate(_headers(path, magic, layout)):
                    row = dict.fromkeys(columns)
                    row.update(path=path, error=error)
                    row[seq] = n
                    if error is None:
                        row.update(zip(names, fields), byte_offset=offset, byte_count=count)
                    rows.append(row)
                    if len(rows) == ROWS_PER_BATCH:
                        yield _frame(rows, columns)
                        rows = []
                if rows:
                    yield _frame(rows, columns)

    def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns)
        for c in columns:
            if c not in ("path", "error"):
                out[c] = out[c].astype("Int64")
        return out

    spread = files.select("path").repartition("path")
    return spread.mapInPandas(walk, schema)


def audio_index(files: DataFrame, magic: bytes) -> DataFrame:
    """Block headers of raw audio files (column path). A damaged file ends with a row
    holding its error; the blocks before it are kept."""
    return _index(files, magic, AUDIO_HEADER, schemas.AUDIO_BLOCK_INDEX,
                  ["elapsed_ms", "callback_stream_ns", "capture_stream_ns"], "block_seq")


def video_index(files: DataFrame, magic: bytes) -> DataFrame:
    """Frame headers of raw video files; payloads are skipped, not decoded."""
    return _index(files, magic, VIDEO_HEADER, schemas.VIDEO_FRAME_INDEX,
                  ["elapsed_ms", "display_time_ms", "format_code", "width", "height"], "frame_seq")


def file_errors(index: DataFrame) -> DataFrame:
    return index.where("error IS NOT NULL").select("path", "error")


def _samples(raw: bytes, sample_format: str) -> np.ndarray:
    """Samples of one block as float32 in [-1, 1]. 24-bit samples take four bytes and are
    read as signed numbers, also the unsigned ones."""
    kind, bits = sample_format[0], int(sample_format[1:])
    width = SAMPLE_BYTES[sample_format]
    if kind == "f":
        return np.frombuffer(raw, f"<f{width}").astype(np.float32)
    half = float(2 ** (bits - 1))
    stored = "i" if bits == 24 else kind
    values = np.frombuffer(raw, f"<{stored}{width}").astype(np.float64)
    centred = values - half if kind == "u" else values
    return (centred / half).astype(np.float32)


def _both(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right of frames (frames x channels): mono is doubled, stereo kept, more
    channels averaged in their order."""
    channels = frames.shape[1]
    if channels == 2:
        return frames[:, 0], frames[:, 1]
    mono = frames[:, 0]
    for k in range(1, channels):
        mono = mono + frames[:, k]
    if channels > 1:
        mono = mono / np.float32(channels)
    return mono, mono


def to_stereo(raw: bytes, sample_format: str, channels: int) -> tuple[np.ndarray, np.ndarray]:
    """Left and right of one block."""
    return _both(_samples(raw, sample_format).reshape(-1, channels))


DECODED = ("stream_id string, block_seq long, elapsed_ms long, frames long, "
           "left array<float>, right array<float>, error string")


def block_problem(byte_count: Column, sample_format: Column, channels: Column) -> Column:
    sizes = F.create_map(*[F.lit(x) for pair in SAMPLE_BYTES.items() for x in pair])
    size = F.try_element_at(sizes, sample_format)
    return (F.when(F.coalesce(channels, F.lit(0)) <= 0, F.lit("invalid channel count"))
            .when(size.isNull(), F.lit("unsupported sample format"))
            .when(byte_count % (size * channels) != 0, F.lit("block not aligned to frames")))


ARROW_DECODED = pa.schema([
    ("stream_id", pa.string()), ("block_seq", pa.int64()), ("elapsed_ms", pa.int64()),
    ("frames", pa.int64()), ("left", pa.list_(pa.float32())), ("right", pa.list_(pa.float32())),
    ("error", pa.string())])


def _decode(batch: pa.RecordBatch, payloads: pa.Array) -> pa.RecordBatch:
    """Decoded rows of a batch. Blocks of one format and channel count are decoded as one run
    of samples and cut into rows by offsets, so no work is done row by row."""
    rows = batch.num_rows
    kinds = list(zip(batch.column("sample_format").to_pylist(), batch.column("channels").to_pylist(),
                     batch.column("error").is_null().to_pylist()))
    groups: dict[tuple, list[int]] = {}
    for k, (sample_format, channels, good) in enumerate(kinds):
        if good:
            groups.setdefault((sample_format, channels), []).append(k)
    place = np.full(rows, -1, np.int64)
    parts, done = ([], []), 0
    with np.errstate(over="ignore", invalid="ignore"):
        for (sample_format, channels), members in groups.items():
            taken = payloads.take(pa.array(members))
            sizes = pc.binary_length(taken).to_numpy().astype(np.int64)
            raw = b"".join(taken.to_pylist())
            found = _both(_samples(raw, sample_format).reshape(-1, channels))
            edges = np.concatenate([[0], np.cumsum(sizes // (SAMPLE_BYTES[sample_format] * channels))])
            for side, part in zip(found, parts):
                part.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)),
                                                     pa.array(side, pa.float32())))
            place[members] = np.arange(done, done + len(members))
            done += len(members)
    at = pa.array(place, mask=place < 0)
    empty = pa.array([], pa.list_(pa.float32()))
    left, right = (pa.concat_arrays([*p, empty]).take(at) for p in parts)
    return pa.RecordBatch.from_arrays(
        [*(batch.column(n) for n in ("stream_id", "block_seq", "elapsed_ms")),
         pc.cast(pc.list_value_length(left), pa.int64()), left, right, batch.column("error")],
        schema=ARROW_DECODED)


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """Decode block rows (stream_id, block_seq, elapsed_ms, bytes, sample_format, channels)
    to stereo arrays, one row per block; a block that cannot be decoded has an error."""
    checked = blocks.select(
        "stream_id", "block_seq", "elapsed_ms", "bytes", "sample_format", "channels",
        block_problem(F.length("bytes"), F.col("sample_format"), F.col("channels")).alias("error"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("bytes")), 0).to_numpy(zero_copy_only=False)
            for a, b in _runs(sizes):
                part = batch.slice(a, b - a)
                yield _decode(part, part.column("bytes"))

    return checked.mapInArrow(run, DECODED)


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about BYTES_HELD bytes each; a larger row is alone."""
    part = np.cumsum(sizes.astype(np.int64)) // BYTES_HELD
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    yield from ((a, b) for a, b in zip(edges, edges[1:]) if b > a)


def decode_files(index: DataFrame, formats: DataFrame) -> DataFrame:
    """Decode indexed audio files. ``formats`` gives path, stream_id, sample_format and
    channels. Index rows are spread by (path, block), so one file is read by many tasks."""
    rows = index.where("error IS NULL").join(formats, "path").select(
        "stream_id", "path", "block_seq", "elapsed_ms", "byte_offset", "byte_count",
        "sample_format", "channels",
        block_problem(F.col("byte_count"), F.col("sample_format"), F.col("channels"))
        .alias("error")).repartition("path", F.expr("block_seq div 256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = {}

        def payload(path: str, offset: int, count: int) -> bytes:
            if path not in opened:
                for f in opened.values():
                    f.close()
                opened.clear()
                opened[path] = _open(path)
            opened[path].seek(offset)
            return opened[path].read(count)

        for batch in batches:
            for a, b in _runs(batch.column("byte_count").to_numpy()):
                part = batch.slice(a, b - a)
                places = zip(*(part.column(n).to_pylist() for n in ("path", "byte_offset", "byte_count")))
                yield _decode(part, pa.array([payload(*p) for p in places], pa.binary()))

    return rows.mapInArrow(run, DECODED)
