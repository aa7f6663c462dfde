"""Two tokenizers' tokens of the same bytes aligned: groups between common ends, links, counts."""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.llm.pieces import SPACE
from reelgrid.llm.rows import bound_batches, kept, raw_texts, slices, stored, table
from reelgrid.llm.word_tokens import byte_letters
from reelgrid.llm.words import grown

BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"
CHUNK_BYTES = 32 << 20
CACHE_BYTES = 112 << 20
RUN_COST = 320  # rough bytes a kept run takes beside its text
AT_ONCE = 4096  # runs encoded and aligned at a time
PAIR = 1 << 32

# No token of either tokenizer crosses a single space between two other characters.
BORDER = re.compile(r"(?<=\S) (?=\S)")

ROWS = ("chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
        "runs binary, times binary, pairs array<long>, counts array<long>, edges binary, places binary")
ARROW = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()),
                   ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                   ("groups", pa.string()), ("runs", pa.binary()), ("times", pa.binary()),
                   ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
                   ("edges", pa.binary()), ("places", pa.binary())])


def align(a_ends: list[int], b_ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and in B just after each group. A group ends at a byte offset where tokens of
    both end: the keys two end-to-place dictionaries share."""
    a_at = dict(zip(a_ends, range(1, len(a_ends) + 1)))
    b_at = dict(zip(b_ends, range(1, len(b_ends) + 1)))
    common = sorted(a_at.keys() & b_at.keys())
    return (np.fromiter(map(a_at.__getitem__, common), np.int64, len(common)),
            np.fromiter(map(b_at.__getitem__, common), np.int64, len(common)))


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links: places of the A and B tokens that overlap, in order. Between two neighbouring ends
    of either list lies one token of each, and each overlap holds one such stretch."""
    ends = np.union1d(a_ends, b_ends)
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


class Tokenizers:
    """Ids and bytes of both tokenizers' tokens."""

    def __init__(self, byte_definition: str, piece_model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_definition)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=piece_model)
        back = {letter: byte for byte, letter in byte_letters().items()}
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = []
        for k in range(size):
            entry = self.a.id_to_token(k) or ""
            self.a_bytes.append(bytes([back[c] for c in entry]))
        self.b_bytes = []
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else
                                piece.replace(SPACE, " ").encode())
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in spelt], np.int64)
                                      for spelt in (self.a_bytes, self.b_bytes))
        # an id as text, with what may stand after it in a group
        self.a_texts = np.array([[f"{k},", f"{k}|"] for k in range(len(self.a_bytes))], object)
        self.b_texts = np.array([[f"{k},", f"{k};"] for k in range(len(self.b_bytes))], object)

    def encode(self, runs: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of runs that begin with a space; B adds that space itself."""
        a = [e.ids for e in self.a.encode_batch_fast(runs, add_special_tokens=False)]
        return a, self.b.encode([r[1:] for r in runs], num_threads=1)


class Runs:
    """Aligned runs of texts; a run's groups and links are found once and kept."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.clear()

    def clear(self):
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.facts = np.zeros((1 << 12, 4), np.int64)  # tokens of A, of B, groups, links
        self.good = np.zeros(1 << 12, bool)
        self.edges = np.zeros(1 << 12, np.int64)  # where a run's links end
        self.pairs = np.zeros(1 << 14, np.int64)
        self.used = self.held = 0

    def _spelt(self, new: list[str], a_all: list, b_all: list) -> np.ndarray:
        """Which runs both lists of tokens spell."""
        a_bytes, b_bytes = self.tokenizers.a_bytes, self.tokenizers.b_bytes
        return np.array([b"".join([a_bytes[i] for i in a]) == run.encode() == b"".join([b_bytes[j] for j in b])
                         for run, a, b in zip(new, a_all, b_all)], bool)

    def _keep(self, new: list[str]):
        """Aligns runs as one stretch of bytes: every run ends a token of both sides, so no
        group crosses from one to the next."""
        known = self.tokenizers
        a_all, b_all = known.encode(new)
        good = self._spelt(new, a_all, b_all)
        if not good.all():
            a_all, b_all = ([x if g else [] for x, g in zip(side, good)] for side in (a_all, b_all))
        first, total = len(self.groups), len(self.groups) + len(new)
        a_counts, b_counts = (np.fromiter(map(len, side), np.int64, len(new)) for side in (a_all, b_all))
        a, b = (np.fromiter(chain.from_iterable(side), np.int64) for side in (a_all, b_all))
        a_ends, b_ends = np.cumsum(known.a_sizes[a]), np.cumsum(known.b_sizes[b])
        a_to, b_to = align(a_ends.tolist(), b_ends.tolist())
        links = overlaps(a_ends, b_ends)

        # texts: each group's A ids, then its B ids
        a_group, b_group = (np.repeat(np.arange(len(to)), np.diff(to, prepend=0)) for to in (a_to, b_to))
        items = np.empty(len(a) + len(b), object)
        a_last, b_last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_last[a_to - 1] = b_last[b_to - 1] = 1
        b_before, a_before = np.concatenate([[0], b_to])[a_group], a_to[b_group]
        items[np.arange(len(a)) + b_before] = known.a_texts[a, a_last]
        items[np.arange(len(b)) + a_before] = known.b_texts[b, b_last]
        items = items.tolist()

        a_cuts, b_cuts = np.cumsum(a_counts), np.cumsum(b_counts)
        group_cuts = np.searchsorted(a_to, a_cuts, "right")
        link_cuts = np.searchsorted(links[0], a_cuts)
        at = 0
        for end in (a_cuts + b_cuts).tolist():
            text = "".join(items[at:end])[:-1]
            self.groups.append(text)
            self.held += len(text)
            at = end
        self.held += sum(map(len, new)) + RUN_COST * len(new) + 8 * len(links[0])
        self.facts, self.good, self.edges = (grown(x, total + 1) for x in (
            self.facts, self.good, self.edges))
        self.facts[first:total] = np.stack(
            [a_counts, b_counts, np.diff(group_cuts, prepend=0), np.diff(link_cuts, prepend=0)], axis=1)
        self.good[first:total] = good
        self.edges[first + 1:total + 1] = self.used + link_cuts
        self.pairs = grown(self.pairs, self.used + len(links[0]))
        self.pairs[self.used:self.used + len(links[0])] = a[links[0]] * PAIR + b[links[1]]
        self.used += len(links[0])

    def look_up(self, texts: list[bytes]) -> list[np.ndarray | None]:
        """Places of each text's runs; None for a text without tokens."""
        place, new, out = self.place, [], []
        for raw in texts:
            try:
                text = raw.decode()
            except UnicodeDecodeError:  # no text: its bytes are nobody's tokens
                text = ""
            if not text:
                out.append(None)
                continue
            runs = text.split(" ")
            if runs != text.split():  # other white space, or several spaces
                runs = BORDER.split(" " + text)
                runs[0] = runs[0][1:]
            at = []
            for run in runs:
                n = place.get(run)
                if n is None:
                    n = place[run] = len(place)
                    new.append(" " + run)
                at.append(n)
            out.append(np.array(at, np.int64))
        for k in range(0, len(new), AT_ONCE):
            self._keep(new[k:k + AT_ONCE])
        return [at if at is not None and self.good[at].all() else None for at in out]


class Chunk:
    """Documents of one chunk: their runs by the chunk's own numbers, and the pairs of those."""

    def __init__(self, runs: Runs, number: int):
        self.runs, self.number = runs, number
        self.own = np.full(0, -1, np.int64)
        self.members: list[np.ndarray] = []
        self.totals = np.zeros(0, np.int64)
        self.size = 0

    def documents(self, ids: list, texts: list[bytes]) -> pa.RecordBatch:
        runs, found = self.runs, self.runs.look_up(texts)
        more = len(runs.groups) - len(self.own)
        self.own = np.concatenate([self.own, np.full(more, -1, np.int64)])
        self.totals = np.concatenate([self.totals, np.zeros(more, np.int64)])
        facts = np.zeros((len(ids), 4), np.int64)
        groups, numbers, times = [], [], []
        for k, at in enumerate(found):
            if at is None:
                groups.append("")
                numbers.append(b"")
                times.append(b"")
                continue
            facts[k] = runs.facts[at].sum(axis=0)
            groups.append(";".join([runs.groups[n] for n in at.tolist()]))
            distinct, often = np.unique(at, return_counts=True)
            fresh = distinct[self.own[distinct] < 0]
            self.own[fresh] = np.arange(self.size, self.size + len(fresh))
            self.size += len(fresh)
            self.members.append(fresh)
            self.totals[distinct] += often
            own = self.own[distinct]
            order = np.argsort(own)
            numbers.append(own[order].astype("<u4").tobytes())
            times.append(often[order].astype("<u4").tobytes())
        columns = [[self.number] * len(ids), ids, *facts.T, groups, numbers, times]
        columns += [[None] * len(ids)] * (len(ARROW) - len(columns))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)],
                                          schema=ARROW)

    def close(self) -> pa.RecordBatch:
        """One row: the chunk's distinct pairs and how often it links them, and each run's pairs
        as places among them."""
        runs = self.runs
        members = np.concatenate([*self.members, np.zeros(0, np.int64)])
        sizes = runs.edges[members + 1] - runs.edges[members]
        before = np.cumsum(sizes) - sizes
        at = np.repeat(runs.edges[members] - before, sizes) + np.arange(sizes.sum())
        pairs, places = np.unique(runs.pairs[at], return_inverse=True)
        counts = np.bincount(places, np.repeat(self.totals[members], sizes), len(pairs)).astype(np.int64)
        columns = [[self.number], *[[None]] * 8, [pairs], [counts],
                   [np.cumsum(sizes).astype("<i8").tobytes()], [places.astype("<u4").tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)],
                                          schema=ARROW)


def aligned(docs: DataFrame, byte_definition: str, piece_model: bytes, doc_id: str = "doc_id",
            text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of documents (doc_id, n_a, n_b, n_groups, n_links, groups as text) and of chunks.

    A text is encoded by A with a space before it and by B, which adds one. Groups are the
    slices between the byte offsets at which both end a token, links the token occurrences in
    them that overlap. Null and empty texts, and those whose joined A or B bytes are not the
    text (a space sign of B in it, bytes that are no UTF-8), have no tokens: zeros, no groups.

    Texts are cut at single spaces, which no token crosses, and a run's alignment is kept in
    the worker; at CACHE_BYTES the store starts afresh, which changes no result. Documents of
    a task form chunks of about ``chunk_bytes`` of text; a chunk's last row (doc_id's other
    columns null) has its distinct pairs (A id * 2**32 + B id) with ``counts``.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast((byte_definition, piece_model))  # vocabulary files

    def run(batches):
        key = ("aligned", hash(shared.value))
        runs = kept(key, lambda: Runs(Tokenizers(*shared.value)))
        number, held = TaskContext.get().partitionId() << 32, 0
        chunk = Chunk(runs, number)
        for batch in batches:
            for part in slices(batch, "text"):
                if held and (held > chunk_bytes or runs.held > CACHE_BYTES):
                    yield chunk.close()
                    if runs.held > CACHE_BYTES:
                        runs.clear()
                    number, held = number + 1, 0
                    chunk = Chunk(runs, number)
                texts = raw_texts(part, "text")
                held += sum(map(len, texts)) + part.num_rows
                yield chunk.documents(part.column("doc_id").to_pylist(), texts)
        if held:
            yield chunk.close()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, ROWS)


def link_counts(rows: DataFrame) -> DataFrame:
    """(pair, a, b, links, best) corpus-wide: how many links hold an id pair, and whether no
    other pair of its B id is held by more."""
    sums = (rows.where("pairs IS NOT NULL").select(F.inline(F.arrays_zip("pairs", "counts")))
            .groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("links")))
    # a B id has at most as many pairs as A has ids
    most = F.max("links").over(Window.partitionBy("b"))
    return (sums.select("pair", F.expr(f"pair DIV {PAIR}").alias("a"), (F.col("pair") % PAIR).alias("b"),
                        "links").withColumn("best", F.col("links") == most))


def with_counts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Documents of ``aligned`` rows with n_best and count_sum.

    A chunk's distinct pairs are looked up once, and its documents meet the answers in one
    cogroup of the chunk's size; no row per document and pair is made. A very long text is a
    chunk alone.
    """
    asked = rows.where("pairs IS NOT NULL").select(F.col("chunk").alias("asking"), F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(counts.select("pair", "links", "best"), "pair").select(
        "asking", "place", "links", "best")
    held = [c for c in rows.columns if c not in ("pairs", "counts")]
    given = ["doc_id", "n_a", "n_b", "n_groups", "n_links", *(
        c for c in held if c.startswith("groups"))]
    schema = pa.schema([(f.name, pa.int64() if f.dataType.typeName() == "long" else pa.string())
                        for f in rows.select(*given).schema] + [
                            ("n_best", pa.int64()), ("count_sum", pa.int64())])

    def finish(members: pa.Table, found: pa.Table) -> pa.Table:
        is_chunk = members.column("edges").is_valid()
        documents = members.filter(pc.invert(is_chunk))
        key = members.filter(is_chunk)
        links = np.zeros(found.num_rows, np.int64)
        best = np.zeros(found.num_rows, np.int64)
        place = found.column("place").to_numpy()
        links[place] = found.column("links").to_numpy()
        best[place] = found.column("best").to_numpy(zero_copy_only=False)
        edges = np.frombuffer(key.column("edges")[0].as_py(), "<i8")
        places = np.frombuffer(key.column("places")[0].as_py(), "<u4")
        sums = []
        for value in (best, links):
            total = np.concatenate([[0], np.cumsum(value[places])])
            sums.append(np.diff(total[np.concatenate([[0], edges])]))
        out = [[], []]
        for numbers, often in zip(documents.column("runs"), documents.column("times")):
            at = np.frombuffer(numbers.as_py(), "<u4")
            weight = np.frombuffer(often.as_py(), "<u4").astype(np.int64)
            for k in (0, 1):
                out[k].append(int((sums[k][at] * weight).sum()))
        return pa.table([*(documents.column(n) for n in given), *out], schema=schema)

    made = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*given).schema)
    return rows.select(*held).groupBy("chunk").cogroup(answers.groupBy("asking")).applyInArrow(
        finish, made + ", n_best long, count_sum long")


def op11_alignment(spark, sf_dir: str, byte_tokenizer: str | None = None,
                   piece_model: str | None = None) -> DataFrame:
    """Per document: tokens, groups and links of both tokenizers, links of the best pair of
    their B id, sum of pair counts over links, and the digest of its groups."""
    import public_tokenizers

    with open(byte_tokenizer or public_tokenizers.path(BYTE_TOKENIZER), encoding="utf-8") as f:
        definition = f.read()
    with open(piece_model or public_tokenizers.path(PIECE_MODEL), "rb") as f:
        model = f.read()
    rows = aligned(table(spark, sf_dir, "documents"), definition, model)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    rows = stored(rows.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    return with_counts(rows, link_counts(rows)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
