"""SimHash near-duplicates: fingerprints of word shingles, linked within a few differing bits."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid.llm.components import connected_components
from reelgrid.llm.gray_index import GrayIndex, sub_masks
from reelgrid.llm.rows import checkpointed, free_name, raw_texts, stored, with_columns

WORDS = 3
DIFFERENCES = 3
BUCKET = 1 << 14
SEED = 42
_digest = partial(xxhash.xxh64_intdigest, seed=SEED)


def shingles(text: bytes, width: int) -> list[bytes]:
    """Runs of ``width`` words, space-joined; the whole sequence where there are fewer."""
    words = text.lower().split()
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(width)))))


def fingerprints_of(texts: list[bytes], width: int = WORDS) -> np.ndarray:
    """Bit k is set where over half of a text's shingle hashes have it; no shingle gives 0."""
    found = [shingles(t, width) for t in texts]
    counts = np.array([len(x) for x in found], np.int64)
    out = np.zeros(len(texts), np.uint64)
    hashes = np.fromiter((_digest(s) for x in found for s in x), np.uint64, int(counts.sum()))
    some = np.flatnonzero(counts)
    starts = np.cumsum(counts)[some] - counts[some]
    ones = np.zeros((len(some), 64), np.int32)
    for byte in range(8):
        bits = np.unpackbits((hashes >> np.uint64(8 * byte)).astype(np.uint8)[:, None], axis=1,
                             bitorder="little")
        if len(some):
            ones[:, 8 * byte:8 * byte + 8] = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    over = (2 * ones > counts[some, None]).astype(np.uint64)
    out[some] = (over << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = WORDS,
                     name: str = "fingerprint") -> DataFrame:
    """Rows with the 64-bit fingerprint of their whole text as a signed long.

    Only A-Z are lower-cased; words end at the six ASCII white-space characters. A text that
    is null, empty or all white space has fingerprint zero.
    """
    def make():
        return lambda batch: [pa.array(
            fingerprints_of(raw_texts(batch, text), width).view(np.int64))]

    return with_columns(docs, [(name, T.LongType())], text, make)


def fingerprint_text(code):
    """Sixteen lower-case hex digits."""
    return F.lower(F.lpad(F.hex(code), 16, "0"))


def _links_in_buckets(rows: DataFrame, limit: int) -> DataFrame:
    """Links (a, b) that join all codes within ``limit`` bits in each bucket of (mask, code)."""
    def run(batches):
        parts = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.concat_tables(parts)
        masks, codes = (whole[c].to_numpy().view(np.uint64) for c in ("mask", "code"))
        for mask in np.unique(masks):
            a, b = GrayIndex(codes[masks == mask], int(mask)).forest(limit)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    spread = rows.repartition("mask", F.col("code").bitwiseAND(F.col("mask")))
    return spread.mapInArrow(run, "a long, b long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(codes: DataFrame, limit: int = DIFFERENCES, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b: long) between distinct ``code``s that give the components of "differ in at
    most ``limit`` bits"; each is a chain of such pairs.

    The 64 bits are cut in limit + 1 blocks; two codes within the limit agree in one of them,
    so codes meet in buckets of equal block. A bucket of more than ``bucket`` codes is cut
    again by blocks of its remaining bits, which loses no pair, until so few bits are left
    that more codes than that cannot differ. Each bucket is searched by a Gray-order index and
    gives a spanning forest, never all its pairs.
    """
    parents, free, found = [0], 64, []
    rest = codes.select(F.lit(0).cast("long").alias("mask"), "code")
    while True:
        children = {m: sub_masks(m, limit + 1) for m in parents}
        step = F.create_map(*(x for m, below in children.items() for x in (
            F.lit(_signed(m)), F.array(*(F.lit(_signed(c)) for c in below)))))
        rows = rest.select(F.explode(step[F.col("mask")]).alias("mask"), "code")
        parents = sorted({c for below in children.values() for c in below})
        free = 64 - min(p.bit_count() for p in parents)
        if 1 << free <= bucket:
            found.append(_links_in_buckets(rows, limit))
            break
        key = F.col("code").bitwiseAND(F.col("mask")).alias("key")
        large = checkpointed(rows.groupBy("mask", key).count().where(F.col("count") > bucket)
                             .select("mask", "key"))
        if large.isEmpty():
            found.append(_links_in_buckets(rows, limit))
            break
        keyed = rows.withColumn("key", key)
        found.append(_links_in_buckets(
            keyed.join(large, ["mask", "key"], "left_anti").select("mask", "code"), limit))
        rest = keyed.join(large, ["mask", "key"], "left_semi").select("mask", "code")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    width: int = WORDS, limit: int = DIFFERENCES) -> DataFrame:
    """(doc_id, fingerprint text, component_id, code) of every row.

    Rows link when fingerprints differ in at most ``limit`` bits; component_id is the
    smallest doc_id reachable. Equal fingerprints are one code, so copies are never paired.
    Null ids count for no minimum; a component of null ids alone has a null id. Repeated rows
    come back as often as they are given. Other columns are not returned.
    """
    marked = stored(with_fingerprint(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", width,
        "code").select("doc_id", "code"), "fingerprints")
    firsts = marked.groupBy("code").agg(F.min("doc_id").alias("first_doc"))
    firsts = stored(firsts, "codes")
    roots = connected_components(links(firsts.select("code"), limit))
    named = (firsts.join(roots, firsts["code"] == roots["node"], "left")
             .select("code", "first_doc", F.coalesce("root", "code").alias("root")))
    least = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    classes = named.join(least, "root").select("code", "component_id")
    return marked.join(classes, "code").select(
        "doc_id", fingerprint_text("code").alias("fingerprint"), "component_id", "code")


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one row kept of each group of near-duplicates:
    that of the smallest doc_id; a null id counts after all others, and a group of null ids
    keeps one row.

    Rows meet the kept ids by id and text hash, so a text crosses one shuffle and a hot
    fingerprint gathers nothing.
    """
    found = near_duplicates(docs.select(
        F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"),
                 F.xxhash64(text).alias("text_hash")).alias("doc_id"),
        F.col(text).alias("text")), "doc_id", "text")
    kept = found.where("doc_id <=> component_id").select("component_id.*").distinct()
    own_id, own_hash = free_name(docs, "__id"), free_name(docs, "__hash")
    keyed = docs.withColumns({own_id: F.col(doc_id), own_hash: F.xxhash64(text)})
    return (keyed.join(kept, keyed[own_id].eqNullSafe(kept["id"])
                       & (keyed[own_hash] == kept["text_hash"]), "left_semi")
            .dropDuplicates([own_id, own_hash]).drop(own_id, own_hash))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    from reelgrid.llm.rows import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
