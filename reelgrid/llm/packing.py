"""Packing tokenized documents into windows: bounded-space online best fit, leftovers merged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.rows import bound_batches, raw_texts, slices, stored, table
from reelgrid.llm.word_tokens import word_tokens

WINDOW = 4096
OPEN = 64
END = 2
MERGED_WINDOWS = 256
FLUSH = 1 << 20
TOKENIZER = "word_bpe_49k.json"

PIECES = ("doc_id long, start long, length long, doc_tokens long, ids binary, "
          "sequence_id long, offset long, open boolean")
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                   ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()),
                   ("offset", pa.int64()), ("open", pa.bool_())])


class Packer:
    """A fixed number of open windows. A piece goes to the window it fills best; where none
    has room, the fullest is filled up and closed. A window that is full closes at once."""

    def __init__(self, window: int, most: int, first_id: int):
        self.window, self.most, self.next_id = window, most, first_id
        self.windows: list[list] = []  # tokens held, pieces
        self.rows: list[tuple] = []
        self.tokens = 0

    def _close(self, pieces: list, left_open: bool = False):
        at = 0
        for piece in pieces:
            doc_id, start, ids, doc_tokens = piece
            self.rows.append((doc_id, start, len(ids), doc_tokens, ids.tobytes(), self.next_id,
                              at, left_open))
            at += len(ids)
        self.tokens += at
        self.next_id += 1

    def _best(self, size: int):
        """The fullest window with room for ``size``."""
        best = None
        for w in self.windows:
            if w[0] + size <= self.window and (best is None or w[0] > best[0]):
                best = w
        return best

    def _add(self, held: list, doc_id, start: int, ids: np.ndarray, doc_tokens: int):
        held[0] += len(ids)
        held[1].append((doc_id, start, ids.copy(), doc_tokens))  # not a view of its whole batch
        if held[0] == self.window:
            self.windows.remove(held)
            self._close(held[1])

    def place(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int):
        """One piece of at most a window. A whole window goes straight out. Where no window has
        room and no more may open, the fullest is filled with the head of the piece and closed,
        and the rest is placed."""
        if len(ids) == self.window:
            self._close([(doc_id, start, ids, doc_tokens)])
            return
        best = self._best(len(ids))
        if best is None and len(self.windows) == self.most:
            fullest = max(self.windows, key=lambda w: w[0])
            room = self.window - fullest[0]
            self._add(fullest, doc_id, start, ids[:room], doc_tokens)
            start, ids = start + room, ids[room:]
            best = self._best(len(ids))
        if best is None:
            best = [0, []]
            self.windows.append(best)
        self._add(best, doc_id, start, ids, doc_tokens)

    def document(self, doc_id, ids: np.ndarray):
        """Cuts whole windows off a long document; its rest is one piece."""
        for start in range(0, len(ids), self.window):
            self.place(doc_id, start, ids[start:start + self.window], len(ids))

    def fill(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int):
        """Fills one window after the other, cutting the piece where a window ends."""
        while len(ids):
            room = self.window - (self.windows[0][0] if self.windows else 0)
            self.place(doc_id, start, ids[:room], doc_tokens)
            start, ids = start + min(room, len(ids)), ids[room:]

    def finish(self, left_open: bool):
        for w in self.windows:
            self._close(w[1], left_open)
        self.windows = []

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * len(ARROW)
        self.rows, self.tokens = [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)


def pack(docs: DataFrame, definition: str, doc_id: str = "doc_id", text: str = "text",
         window: int = WINDOW, open_windows: int = OPEN, end: int = END,
         merged_windows: int = MERGED_WINDOWS) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, ids, sequence_id, offset) of all documents.

    ``definition`` is the tokenizer's JSON text; ``ids`` are little-endian unsigned 32-bit.
    A document is its ids and then ``end``; a null or empty text is ``end`` alone. A document
    is cut where it is longer than a window, or where no open window has room for it. The windows a partition still has open
    at its end (``open_windows`` at most) meet in tasks of about ``merged_windows`` of them
    and are filled one after the other, cut where a window ends, so each such task pads one
    window at most. Sequence ids come from partition and count, so a task run again gives
    the same. Repeated rows are packed each; null ids stay null; other columns are dropped.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(definition)  # a tokenizer file, whatever the input

    def first(batches):
        encoder = word_tokens(shared.value)
        packer = Packer(window, open_windows, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for part in slices(batch, "text"):
                found = encoder.encode(raw_texts(part, "text"), end)
                for name, ids in zip(part.column("doc_id").to_pylist(), found):
                    packer.document(name, ids)
                    if packer.tokens > FLUSH:
                        yield packer.batch()
        packer.finish(left_open=True)
        yield packer.batch()

    def merge(batches):
        packer = Packer(window, 1, 1 << 62 | TaskContext.get().partitionId() << 32)
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("doc_id", "start", "ids", "doc_tokens")]
            for name, start, ids, doc_tokens in zip(*columns):
                packer.fill(name, start, np.frombuffer(ids, np.uint32), doc_tokens)
                if packer.tokens > FLUSH:
                    yield packer.batch()
        packer.finish(left_open=False)
        yield packer.batch()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    placed = stored(rows.mapInArrow(first, PIECES), "pieces")
    left = placed.where("open")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-tokens // (window * merged_windows)))
    merged = (left.repartition(tasks, "sequence_id")
              .sortWithinPartitions("sequence_id", "offset").mapInArrow(merge, PIECES))
    return placed.where("NOT open").unionByName(merged).drop("open")


def definition_of(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def packed(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Digests of the packed pieces, by the public tokenizer file or the one at ``tokenizer``."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    return piece_digests(pack(docs, definition_of(tokenizer)))


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"))
