"""Data source ``raw_capture``: files of length-prefixed timed blocks, read and written by tasks.

A file is a magic and then blocks, each a fixed header and its payload. A reader splits files
into byte ranges and owns the blocks that start in its range; an index beside the file, with the
place of every so many blocks, lets it start near its range, and a file without one is walked
over its headers from the start. Small files share a task. Options: ``path``; ``kind`` (audio or
video); ``magic``; ``payload`` (true to read the bytes as well); ``splitBytes``; for the writer
``indexEvery`` and ``pack``.

With ``pack`` true a write task puts its files one behind the other into one pack, so very many
small captures make few files on disk. A Parquet table beside the pack has a row for every run of
``indexEvery`` blocks: ``file``, ``start`` and ``length`` of the file in the pack, number of the
run's first block, and where the run's bytes begin and stop.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader,
                                    InputPartition, WriterCommitMessage)

from reelgrid.sources.raw_capture import AUDIO_HEADER, LARGEST_LONG, VIDEO_HEADER

NAME = "raw_capture"
SUFFIX, INDEX = ".raw", ".index"
PACK, MEMBERS = ".pack", ".members"
SPLIT_BYTES = 128 << 20
INDEX_EVERY = 4096
BATCH_ROWS, BATCH_BYTES = 8192, 8 << 20
FILES_MOST = 4096  # files a task reads
READ_BYTES = 1 << 20  # read ahead in a pack
RUNS_HELD = 1 << 16  # rows of a pack's table written at a time
ENTRY = struct.Struct("<QQ")  # block number, byte offset
RUNS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("length", pa.int64()),
                  ("block_seq", pa.int64()), ("place", pa.int64()), ("stop", pa.int64())])

FIELDS = {"audio": (AUDIO_HEADER, ["elapsed_ms", "callback_stream_ns", "capture_stream_ns"]),
          "video": (VIDEO_HEADER, ["elapsed_ms", "display_time_ms", "format_code", "width", "height"])}


def file_system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(path)


@dataclass
class Blocks:
    """Blocks of a file or pack that start at ``start`` or later and before ``stop``."""

    file: str
    size: int
    start: int
    stop: int
    packed: bool


@dataclass
class Ranges(InputPartition):
    """What a task reads: one range, or several small files."""

    ranges: list[Blocks]


class _Layout:
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.kind = options.get("kind", "audio")
        if self.kind not in FIELDS:
            raise ValueError(f"kind is audio or video, not {self.kind}")
        self.header, self.names = FIELDS[self.kind]
        self.head = struct.calcsize(self.header)
        self.magic = options.get("magic", "").encode()
        self.payload = options.get("payload", "false").lower() == "true"

    def columns(self) -> str:
        numbers = ", ".join(f"{n} long" for n in self.names)
        return (f"file string, block_seq long, {numbers}, byte_offset long, byte_count long, "
                f"{'bytes binary, ' if self.payload else ''}error string")

    def arrow(self) -> pa.Schema:
        longs = ["block_seq", *self.names, "byte_offset", "byte_count"]
        fields = [("file", pa.string()), *((n, pa.int64()) for n in longs)]
        fields += [("bytes", pa.binary())] if self.payload else []
        return pa.schema([*fields, ("error", pa.string())])


class CaptureReader(DataSourceReader):
    def __init__(self, options):
        self.layout = _Layout(options)
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[Ranges]:
        """Byte ranges of all files below the path, by name; file sizes are all this reads."""
        from pyarrow import fs

        system, root = file_system(self.layout.root)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        out, held = [], 0
        for info in sorted(found, key=lambda i: i.path):
            packed = info.path.endswith(PACK)
            if not info.is_file or not (packed or info.path.endswith(SUFFIX)):
                continue
            name = info.path[len(root):].lstrip("/")[:-len(PACK if packed else SUFFIX)]
            for start in range(0, max(info.size, 1), self.split):
                cost = max(min(info.size - start, self.split), self.split // FILES_MOST)
                if not out or held + cost > self.split:
                    out.append(Ranges([]))
                    held = 0
                out[-1].ranges.append(Blocks(name, info.size, start, start + self.split, packed))
                held += cost
        return out

    def _entry(self, system, path: str, start: int) -> tuple[int, int]:
        """Number and offset of an indexed block at or before ``start``; the first otherwise."""
        from pyarrow import fs

        first = 0, len(self.layout.magic)
        info = system.get_file_info(path + INDEX)
        if info.type != fs.FileType.File or start <= first[1]:
            return first
        with system.open_input_file(path + INDEX) as f:
            low, high = 0, info.size // ENTRY.size
            while low < high:  # entries ascend; the last one at or before start is sought
                middle = (low + high) // 2
                f.seek(middle * ENTRY.size)
                if ENTRY.unpack(f.read(ENTRY.size))[1] <= start:
                    low = middle + 1
                else:
                    high = middle
            if not low:
                return first
            f.seek((low - 1) * ENTRY.size)
            return ENTRY.unpack(f.read(ENTRY.size))

    def _nothing(self) -> tuple:
        return (None,) * (len(self.layout.names) + (3 if self.layout.payload else 2))

    def _blocks(self, part: Blocks) -> Iterator[tuple]:
        """Rows of the blocks a range owns; a damaged file ends with one row with its error,
        which belongs to the range where the damage starts."""
        layout = self.layout
        system, root = file_system(layout.root)
        path = f"{root}/{part.file}{SUFFIX}"
        with system.open_input_file(path) as f:
            if f.read(len(layout.magic)) != layout.magic:
                if part.start == 0:
                    yield part.file, 0, *self._nothing(), "unsupported file header"
                return
            seq, at = self._entry(system, path, part.start)
            yield from self._walk(f, part, part.file, seq, at, part.size)

    def _packed(self, part: Blocks) -> Iterator[tuple]:
        """The same for a pack: the runs of blocks that reach into the range."""
        import pyarrow.parquet as pq

        layout = self.layout
        system, root = file_system(layout.root)
        path = f"{root}/{part.file}"
        runs = pq.read_table(path + MEMBERS, filesystem=system, filters=[
            ("place", "<", part.stop), ("stop", ">", part.start)]).sort_by("place")
        with io.BufferedReader(system.open_input_file(path + PACK), READ_BYTES) as f:
            last = known = None
            for batch in runs.to_batches(max_chunksize=BATCH_ROWS):
                for file, start, length, seq, place, stop in zip(*(c.to_pylist() for c in batch.columns)):
                    if start != last:
                        f.seek(start)
                        last, known = start, f.read(len(layout.magic)) == layout.magic
                    if known:
                        yield from self._walk(f, part, file, seq, place, start + length, start, stop)
                    elif seq == 0 and place >= part.start:
                        yield file, 0, *self._nothing(), "unsupported file header"

    def _walk(self, f, part: Blocks, file: str, seq: int, at: int, end: int, base: int = 0,
              stop: int | None = None) -> Iterator[tuple]:
        """Rows of a file's blocks from ``at`` on that start in the range; the file begins at
        ``base`` and ends at ``end``."""
        layout, head = self.layout, self.layout.head
        while at < min(end if stop is None else stop, part.stop):
            f.seek(at)
            raw, error = f.read(min(head, end - at)), None
            if len(raw) < head:
                error = "truncated block header"
            else:
                *fields, count = struct.unpack(layout.header, raw)
                if at + head + count > end:
                    error = "truncated block"
            if error:
                if at >= part.start:
                    yield file, seq, *self._nothing(), error
                return
            if at >= part.start:
                if max(fields) > LARGEST_LONG:
                    yield file, seq, *self._nothing(), "header value out of range"
                else:
                    data = (f.read(count),) if layout.payload else ()
                    yield file, seq, *fields, at + head - base, count, *data, None
            seq, at = seq + 1, at + head + count

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        schema = self.layout.arrow()
        place = schema.get_field_index("byte_count")

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        rows, held = [], 0
        for own in part.ranges:
            for row in self._packed(own) if own.packed else self._blocks(own):
                rows.append(row)
                held += (row[place] or 0) if self.layout.payload else 0
                if len(rows) == BATCH_ROWS or held > BATCH_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)


class CaptureWriter(DataSourceArrowWriter):
    """Writes each run of rows of one ``file`` name as one file, in the order the task gets them.

    A file is made under a name of the task's own and moved to its name when it is complete, so
    an attempt that is lost leaves no file and one that runs again replaces it.
    """

    def __init__(self, options, overwrite: bool):
        self.layout = _Layout(options)
        self.every = int(options.get("indexEvery", INDEX_EVERY))
        system, root = file_system(self.layout.root)
        if overwrite and system.get_file_info(root).type.name == "Directory":
            system.delete_dir_contents(root)
        system.create_dir(root, recursive=True)

    def write(self, batches) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, root = file_system(self.layout.root)
        unique = f".{TaskContext.get().taskAttemptId()}.part"
        name = out = None
        index: list[bytes] = []
        seq = at = 0

        def finish():
            out.close()
            path = f"{root}/{name}{SUFFIX}"
            with system.open_output_stream(path + INDEX + unique) as f:
                f.write(b"".join(index))
            system.move(path + INDEX + unique, path + INDEX)
            system.move(path + unique, path)

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("file", *self.layout.names, "bytes")]
            for file, *fields, data in zip(*columns):
                if file != name:
                    if out is not None:
                        finish()
                    name, index, seq, at = file, [], 0, len(self.layout.magic)
                    system.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(f"{root}/{name}{SUFFIX}{unique}")
                    out.write(self.layout.magic)
                if seq % self.every == 0:
                    index.append(ENTRY.pack(seq, at))
                data = data or b""
                out.write(struct.pack(self.layout.header, *fields, len(data)))
                out.write(data)
                seq, at = seq + 1, at + self.layout.head + len(data)
        if out is not None:
            finish()
        return WriterCommitMessage()


class PackWriter(CaptureWriter):
    """Writes all files of a task as one pack with its table of runs. A task that runs again
    replaces its pack; packs of other writes are kept."""

    def __init__(self, options, overwrite: bool):
        super().__init__(options, overwrite)
        self.name = uuid.uuid4().hex

    def write(self, batches) -> WriterCommitMessage:
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        layout = self.layout
        system, root = file_system(layout.root)
        task = TaskContext.get()
        path = f"{root}/{self.name}-{task.partitionId()}"
        unique = f".{task.taskAttemptId()}.part"
        out = table = name = None
        runs: list[tuple] = []  # finished runs: all columns
        own: list[tuple[int, int]] = []  # of the open file: block number and place
        start = seq = at = 0

        def finish_file():
            for (number, place), stop in zip(own, [*(p for _, p in own[1:]), at]):
                runs.append((name, start, at - start, number, place, stop))

        def flush():
            if runs:
                table.write_table(pa.Table.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*runs), RUNS)], schema=RUNS))
                runs.clear()

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("file", *layout.names, "bytes")]
            for file, *fields, data in zip(*columns):
                if out is None:
                    out = system.open_output_stream(path + PACK + unique)
                    listed = system.open_output_stream(path + MEMBERS + unique)
                    table = pq.ParquetWriter(listed, RUNS)
                if file != name:
                    finish_file()
                    if len(runs) >= RUNS_HELD:
                        flush()
                    name, own, seq, start = file, [], 0, at
                    out.write(layout.magic)
                    at += len(layout.magic)
                if seq % self.every == 0:
                    own.append((seq, at))
                data = data or b""
                out.write(struct.pack(layout.header, *fields, len(data)) + data)
                seq, at = seq + 1, at + layout.head + len(data)
        if out is not None:
            finish_file()
            flush()
            table.close()
            listed.close()
            out.close()
            system.move(path + MEMBERS + unique, path + MEMBERS)
            system.move(path + PACK + unique, path + PACK)
        return WriterCommitMessage()


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _Layout(self.options).columns()

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        packed = self.options.get("pack", "false").lower() == "true"
        return (PackWriter if packed else CaptureWriter)(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("raw_capture")`` known to a session."""
    spark.dataSource.register(CaptureSource)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all packs' tables below a folder; no pack is read."""
    return spark.read.schema(
        "file string, start bigint, length bigint, block_seq bigint, place bigint, stop bigint"
    ).option("pathGlobFilter", f"*{MEMBERS}").parquet(path)
