"""Merkle manifest against plain trees built in the test, and its query against SQL."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from oracle import connect, difference
from reelgrid.llm import merkle as mk

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    values = [doc_id, source, lang, n_chars, text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Root and, for each node, its (before, after) pairs."""
    paths = [[] for _ in nodes]
    owners = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, over = [], []
        for k in range(0, len(nodes), 16):
            run = nodes[k:k + 16]
            for j in range(len(run)):
                for owner in owners[k + j]:
                    paths[owner].append(("".join(run[:j]), "".join(run[j + 1:])))
            above.append(h("".join(run)))
            over.append([o for part in owners[k:k + 16] for o in part])
        nodes, owners = above, over
    return nodes[0], paths


def plain(docs):
    if not docs:
        return []
    by_source = defaultdict(list)
    for doc in docs:
        by_source[doc[3]].append(doc)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        rows = sorted(by_source[source], key=lambda d: (d[0] is not None, d[0] or 0, leaf_of(*d)))
        trees[source] = (rows, *tree([leaf_of(*d) for d in rows]))
    root, over = tree([trees[s][1] for s in order])
    out = []
    for source, shared in zip(order, over):
        rows, subroot, paths = trees[source]
        for doc, path in zip(rows, paths):
            told = doc
            if doc[0] is not None and zlib.crc32(str(doc[0]).encode()) % 5 == 0 and doc[1] is not None:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in doc[1])
                told = (doc[0], low, *doc[2:])
            node = leaf_of(*told)
            for before, after in path + shared:
                node = h(before + node + after)
            proof = h("".join(b + a for b, a in path + shared))
            out.append((doc[0], leaf_of(*doc), subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


def check(spark, docs, tmp_path, depth, monkeypatch, columns=COLUMNS):
    spark.createDataFrame(docs, columns).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(mk.manifest, "__defaults__", (depth,))
    rows = mk.op13_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows), key=repr) == plain([d[:5] for d in docs])


def document(k, source, text=None):
    return (k, text or f"Text No {k}", "en", source, k * 3)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_trees_of_all_heights(spark, tmp_path, monkeypatch, depth):
    """Sources of 1, 16, 17, 256, 257 and 300 rows, more than 16 sources: odd last runs at each
    level, several rounds of superblocks where they are small."""
    sizes = {"hot": 300, "b": 16, "c": 17, "dé": 257, "e": 256, None: 2, "": 1}
    sizes |= {f"s{k}": 1 for k in range(12)}
    docs, k = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            k += 1
            docs.append(document(k * 37 % 9973, source))
    check(spark, docs, tmp_path, depth, monkeypatch)


def test_odd_rows(spark, tmp_path, monkeypatch):
    """Null values in every column, repeated rows and ids, empty and long texts, a clashing
    column of another case."""
    docs = [(None, None, None, None, None), (None, "A", "en", None, 1), (5, "", "", "", 0),
            (7, "Ä ÀBC", "fr", "x", -4), (7, "Ä ÀBC", "fr", "x", -4), (7, "other", None, "x", None),
            (8, None, "de", "x", 2), (9, "Long WORD " * 300_000, "en", "x", 3_000_000)]
    docs += [document(11, "same")] * 40
    wide = [(*d, "kept", "T") for d in docs]
    check(spark, wide, tmp_path, 1, monkeypatch, COLUMNS + ", tree string, `at` string")


def test_one_row_and_none(spark, tmp_path, monkeypatch):
    check(spark, [document(3, "only")], tmp_path / "one", 3, monkeypatch)
    check(spark, [], tmp_path / "none", 3, monkeypatch)


def test_query_against_sql(spark):
    found = mk.op13_merkle_manifest(spark, SMALL)
    assert difference(found, connect(SMALL), mk.OP13_SQL) is None


def test_proofs_fold_outside_spark(spark):
    """The returned proof, cut by the run sizes that position and leaves give, leads to the
    subroot."""
    docs = [document(k, "a") for k in range(40)]
    rows = spark.createDataFrame(docs, COLUMNS).select(
        "doc_id", "source", mk.leaf_digest([mk.F.col(f) for f in mk.FIELDS]).alias("leaf"),
        mk.F.lit(None).cast("string").alias("told"))
    for r in mk.manifest(rows, 1).collect():
        node, at, size, proof = r.leaf, r.position, r.leaves, r.proof
        while size > 1:
            run = min(16, size - at // 16 * 16)
            cut, proof = proof[:64 * (run - 1)], proof[64 * (run - 1):]
            node = h(cut[:at % 16 * 64] + node + cut[at % 16 * 64:])
            at, size = at // 16, -(-size // 16)
        assert node == r.subroot == r.root and not proof and r.verified
