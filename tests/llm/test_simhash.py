"""SimHash fingerprints and classes against brute force."""

import re

import numpy as np
import pytest
import xxhash

from reelgrid.llm import simhash as sh
from reelgrid.llm.gray_index import GrayIndex, gray_rank, sub_masks

SMALL = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    runs = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(codes, limit):
    """Smallest place reachable of each code."""
    codes = np.array(codes, np.uint64)
    label = np.arange(len(codes))
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= limit
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def near_codes(n, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n // 4, dtype=np.uint64)
    out = list(base)
    while len(out) < n:
        x = int(out[rng.integers(len(out))])
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return np.unique(np.array(out, np.uint64))


def test_fingerprints_plain():
    texts = ["", None, " \t\n", "one", "One two", "a b c", "ÀB c d e " * 50, "x " * 5,
             "the cat sat on the mat\x0bwith a hat", "\x1cword a b c"]
    got = sh.fingerprints_of([(t or "").encode() for t in texts])
    assert [int(x) for x in got] == [plain_fingerprint(t) for t in texts]


def test_gray_rank_orders_the_sequence():
    n = np.arange(256, dtype=np.uint64)
    assert (gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_sub_masks_cover_every_close_pair():
    masks = sub_masks(0, 4)
    assert sum(masks) == 2**64 - 1
    assert all(m & masks[1] == masks[1] for m in sub_masks(masks[1], 4))


@pytest.mark.parametrize("n", [1, 2, 9, 700])
def test_index_finds_all_pairs(n):
    codes = near_codes(max(16, n))[:n]
    n = len(codes)
    index = GrayIndex(codes)
    found = {(int(a), int(b)) for i, j in index.pairs(3) for a, b in zip(i, j)}
    c = index.codes
    want = {(i, j) for i in range(n) for j in range(i + 1, n)
            if (int(c[i]) ^ int(c[j])).bit_count() <= 3}
    assert found == want


@pytest.mark.parametrize("bucket", [1 << 14, 20])
def test_classes_of_codes(spark, bucket):
    codes = near_codes(400, seed=3)
    df = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "code long")
    roots = dict(map(tuple, sh.connected_components(sh.links(df, 3, bucket)).collect()))
    by = {}
    for x, label in zip(codes.view(np.int64), plain_classes(codes, 3)):
        by.setdefault(label, set()).add(roots.get(int(x), int(x)))
    assert all(len(r) == 1 for r in by.values())
    assert len({min(r) for r in by.values()}) == len(by)


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    codes = [plain_fingerprint(r["text"]) for r in rows]
    label = plain_classes(codes, 3)
    want = {(r["doc_id"], f"{c:016x}", rows[k]["doc_id"]) for r, c, k in zip(rows, codes, label)}
    assert {tuple(r) for r in sh.op2_simhash(spark, SMALL).collect()} == want


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(5, "a b c d", "x"), (5, "a b c d", "y"), (None, "a b c d", "z"), (7, None, "n"),
         (3, "", "e"), (9, "q" * 10 + " w e r t y" * 5000, "l")],
        "doc_id long, text string, fingerprint string")
    got = sorted((tuple(r)[:3] for r in sh.near_duplicates(docs).collect()), key=repr)
    assert [(r[0], r[2]) for r in got] == [(3, 3), (5, 5), (5, 5), (7, 3), (9, 9), (None, 5)]
    kept = sh.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()
                  if r["doc_id"] is not None) == [(False, 3), (False, 9)]
    assert kept.count() == 3


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sh.near_duplicates(docs).count() == 0
    assert sh.first_of_each(docs).count() == 0
