"""Merkle manifest of a dataset: leaves of rows, subroots by source, one root, proofs of all rows.

A tree is cut into superblocks of FAN ** DEPTH consecutive nodes. Superblocks are reduced to
one node each; those nodes form the next round's leaves, until a tree has one superblock. On
the way down, each superblock's nodes are cogrouped with the outer nodes that its proofs share.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.llm.rows import stored, table

FAN = 16
DEPTH = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "before array<string>, after array<string>, subroot string, root string"


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(values: list[Column]) -> Column:
    """Lower-case hex digest of a row: each value ``-`` if null, else its UTF-8 byte count, a
    colon and the value as text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t),
                                        F.lit("-")) for t in texts]), 256)


def runs(nodes: list[str], rounds: int) -> list[list[str]]:
    """The joined runs of each level below the result, lowest first: ``rounds`` levels, or
    until one node is left if that comes first and ``rounds`` is 0."""
    out = []
    while len(out) < rounds or (not rounds and len(nodes) > 1):
        joined = ["".join(nodes[k:k + FAN]) for k in range(0, len(nodes), FAN)]
        out.append(joined)
        nodes = [hashed(j) for j in joined]
    return out


def siblings(levels: list[list[str]], place: int) -> tuple[list[str], list[str]]:
    """What stands before and after a node in its run, level by level."""
    before, after = [], []
    for level in levels:
        at = place % FAN * 64
        place //= FAN
        before.append(level[place][:at])
        after.append(level[place][at + 64:])
    return before, after


def fold(leaf: str, before: list[str], after: list[str]) -> str:
    for b, a in zip(before, after):
        leaf = hashed(b + leaf + a)
    return leaf


def superblock(nodes: pd.DataFrame, depth: int) -> list[list[str]]:
    """Levels of a superblock's nodes in order; a tree's only superblock ends at one node."""
    whole = int(nodes["n"].iloc[0]) <= FAN ** depth
    return runs([d.hex() for d in nodes["digest"]], 0 if whole else depth)


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Leaves with ``at``, their place in their ``tree``, and ``n``, the tree's size.

    Rows are sorted over all tasks by tree and ``order`` and numbered in their task; only the
    counts by tree and task are summed up, so a tree may hold any share of the rows.
    """
    keys = ["tree", *order]
    rows = stored(leaves.repartitionByRange(*keys).sortWithinPartitions(*keys)
                  .withColumn("id", F.monotonically_increasing_id())
                  .withColumn("task", F.shiftright("id", 33)), "merkle-leaves")
    counts = rows.groupBy("tree", "task").agg(F.min("id").alias("first"), F.count("*").alias("held"))
    earlier = Window.partitionBy("tree").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "tree", "task", (F.coalesce(F.sum("held").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("held").over(Window.partitionBy("tree")).alias("n"))
    return (rows.join(starts, ["tree", "task"]).withColumn("at", F.col("id") + F.col("shift"))
            .drop("task", "id", "shift"))


class Forest:
    """Trees over placed leaves with columns tree, at, n, digest (32 bytes) and any others."""

    def __init__(self, leaves: DataFrame, depth: int = DEPTH):
        self.block, self.depth = FAN ** depth, depth
        self.rounds = [self._blocks(leaves)]
        largest = leaves.agg(F.max("n")).first()[0] or 1
        self.roots = None
        while True:
            nodes = self.rounds[-1]
            reduced = stored(self._reduced(nodes), "merkle-nodes")
            done = reduced.where("n = 1").select(
                "tree", "digest", F.lit(len(self.rounds) - 1).alias("height"))
            self.roots = done if self.roots is None else self.roots.unionByName(done)
            largest = -(-largest // self.block)
            if largest == 1:
                break
            self.rounds.append(self._blocks(reduced.where("n > 1")))

    def _blocks(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("block", F.expr(f"at DIV {self.block}")).withColumn(
            "place", (F.col("at") % self.block).cast("int"))

    def _reduced(self, nodes: DataFrame) -> DataFrame:
        """One node a superblock: tree, at, n, digest."""
        depth, block = self.depth, self.block

        def reduce(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("place")
            levels = superblock(part, depth)
            top = hashed(levels[-1][0]) if levels else part["digest"].iloc[0].hex()
            return pd.DataFrame({"tree": part["tree"].iloc[:1], "at": part["block"].iloc[:1],
                                 "n": [-(-int(part["n"].iloc[0]) // block)],
                                 "digest": [bytes.fromhex(top)]})

        return nodes.select("tree", "block", "place", "n", "digest").groupBy("tree", "block").applyInPandas(
            reduce, "tree string, at long, n long, digest binary")

    def descend(self, outer: DataFrame, finish, schema: str) -> DataFrame:
        """Rows ``finish`` makes of every leaf superblock and its outer path.

        ``outer`` has, for each tree, its ``height`` and the path above its root (before,
        after, subroot, root). Superblocks of one round and their outer nodes are cogrouped;
        all rounds but the last give the paths of the superblocks below them.
        """
        depth = self.depth

        def path(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
            nodes = nodes.sort_values("place")
            levels = superblock(nodes, depth)
            shared = above.iloc[0]
            found = [siblings(levels, p) for p in nodes["place"]]
            return pd.DataFrame({
                "tree": nodes["tree"], "block": nodes["at"],
                "before": [b + list(shared["before"]) for b, _ in found],
                "after": [a + list(shared["after"]) for _, a in found],
                "subroot": shared["subroot"], "root": shared["root"]})

        def last(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
            nodes = nodes.sort_values("place")
            return finish(nodes, superblock(nodes, depth), above.iloc[0])

        paths = None
        for height in reversed(range(len(self.rounds))):
            tops = outer.where(F.col("height") == height).select(
                "tree", F.lit(0).cast("long").alias("block"), "before", "after", "subroot", "root")
            paths = tops if paths is None else tops.unionByName(paths)
            pairs = self.rounds[height].groupBy("tree", "block").cogroup(
                paths.groupBy("tree", "block"))
            if height:
                paths = stored(pairs.applyInPandas(path, "tree string, block long, " + PATH),
                               "merkle-paths")
        return pairs.applyInPandas(last, schema)


def _outer(nodes: pd.DataFrame, levels: list[list[str]], above: pd.Series) -> pd.DataFrame:
    """Paths from each subroot to the root, in the tree of subroots."""
    found = [siblings(levels, p) for p in nodes["place"]]
    return pd.DataFrame({
        "tree": nodes["own"], "height": nodes["height"],
        "before": [b + list(above["before"]) for b, _ in found],
        "after": [a + list(above["after"]) for _, a in found],
        "subroot": [d.hex() for d in nodes["digest"]], "root": above["root"]})


def _proved(nodes: pd.DataFrame, levels: list[list[str]], above: pd.Series) -> pd.DataFrame:
    over, under = list(above["before"]), list(above["after"])
    shared = "".join([b + a for b, a in zip(over, under)])
    proofs, folded = [], []
    for place, leaf, told in zip(nodes["place"], nodes["digest"], nodes["told"]):
        before, after = siblings(levels, place)
        proofs.append("".join([b + a for b, a in zip(before, after)]) + shared)
        folded.append(fold((leaf if told is None else told).hex(), before + over, after + under))
    return pd.DataFrame({
        "doc_id": nodes["doc_id"], "position": nodes["at"], "leaves": nodes["n"],
        "leaf": [d.hex() for d in nodes["digest"]], "subroot": above["subroot"],
        "root": above["root"], "proof": proofs, "folded_root": folded,
        "verified": [f == above["root"] for f in folded]})


def manifest(leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Proof and check of every row of a dataset.

    ``leaves`` has doc_id (long), source, leaf (hex digest) and told (hex digest the row has
    when checked; null where it is the leaf). The leaves of a source stand by doc_id (null
    first, repeated ids by digest); every FAN consecutive nodes become one until one is left,
    the subroot; the subroots by source (null first, bytewise) give the root likewise.

    Returned per row: doc_id, position among the ``leaves`` of its source, leaf, subroot, root,
    proof (the digests beside its path, from the leaf up, each run from left to right),
    folded_root (told leaf and proof hashed up) and verified. Repeated rows are leaves of their
    own. An empty table gives no rows. A superblock of FAN ** depth nodes is what a task holds.
    """
    # a repeated row keeps its own number, so equal leaves are still spread over tasks
    own = leaves.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"), F.unhex("leaf").alias("digest"),
        F.unhex("told").alias("told"), F.monotonically_increasing_id().alias("row"))
    kept = stored(own, "merkle-rows")
    sources = Forest(placed(kept, ["doc_id", "digest", "row"]), depth)
    subroots = sources.roots.select(F.lit("").alias("tree"), F.col("tree").alias("own"), "digest",
                                    "height")
    top = Forest(placed(subroots, ["own"]), depth)
    none = F.array().cast("array<string>")
    root = F.lower(F.hex("digest"))
    above = top.roots.select("tree", "height", none.alias("before"), none.alias("after"),
                             root.alias("subroot"), root.alias("root"))
    outer = stored(top.descend(above, _outer, "tree string, height int, " + PATH), "merkle-outer")
    return sources.descend(
        outer, _proved, "doc_id long, position long, leaves long, leaf string, subroot string, "
        "root string, proof string, folded_root string, verified boolean")


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every document's proof, with the text's A-Z lower-cased at the check of one id in five."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    changed = [F.translate("text", UPPER, LOWER) if f == "text" else F.col(f) for f in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaves = docs.select("doc_id", "source", leaf_digest([F.col(f) for f in FIELDS]).alias("leaf"),
                         F.when(tampered, leaf_digest(changed)).alias("told"))
    return manifest(leaves).select("doc_id", "leaf", "subroot", "root",
                                   F.sha2("proof", 256).alias("proof_sha256"), "folded_root",
                                   "verified")


def _levels_sql(name: str, leaves: str, height: int) -> str:
    """Levels of trees in ``leaves`` (tree, pos, digest): nodes as they stand at each level, with
    run siblings; a tree of one node stays as it is."""
    parts = [f"{name}0 AS (SELECT tree, pos, digest, count(*) OVER (PARTITION BY tree) AS n FROM {leaves})"]
    for k in range(height):
        parts.append(
            f"{name}{k + 1} AS (SELECT tree, pos // 16 AS pos, CASE WHEN any_value(n) > 1 "
            f"THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE any_value(digest) END AS digest, "
            f"(any_value(n) + 15) // 16 AS n FROM {name}{k} GROUP BY tree, pos // 16)")
        parts.append(
            f"{name}s{k} AS (SELECT tree, pos, n > 1 AS live, coalesce(string_agg(digest, '') OVER (w ROWS "
            f"BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(digest, '') "
            f"OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k} "
            f"WINDOW w AS (PARTITION BY tree, pos // 16 ORDER BY pos))")
    return ",\n".join(parts)


def _sql(height: int = 6, sources: int = 4) -> str:
    """Check SQL for up to 16 ** height rows a source and 16 ** sources sources."""
    value = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
    fields = [value.format(f) for f in FIELDS[:4]]
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    leaf = " || ".join(fields + [value.format("text")])
    told = " || ".join(fields + [value.format(low)])
    crc = ("xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
           "lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda s, x: "
           "CASE WHEN xor(s, x) & 1 = 1 THEN xor(xor(s, x) >> 1, 3988292384) ELSE xor(s, x) >> 1 END), 4294967295)")
    steps, names = "", []
    proof = []
    joins = ""
    for name, tree, pos, levels in (("l", "d.tree", "d.pos", height), ("t", "''", "u.pos", sources)):
        for k in range(levels):
            n = f"{name}s{k}"
            joins += f"\nLEFT JOIN {n} ON {n}.tree = {tree} AND {n}.pos = {pos} // {16 ** k}"
            proof.append(f"CASE WHEN {n}.live THEN {n}.b || {n}.a ELSE '' END")
            names.append(n)
    for k, n in enumerate(names):
        steps += (f",\nz{k + 1} AS (SELECT *, CASE WHEN live{k} THEN sha256(b{k} || f{k} || a{k}) "
                  f"ELSE f{k} END AS f{k + 1} FROM {'base' if k == 0 else f'z{k}'})")
    columns = ", ".join(f"{n}.live AS live{k}, {n}.b AS b{k}, {n}.a AS a{k}" for k, n in enumerate(names))
    return f"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS tree, sha256({leaf}) AS digest,
         CASE WHEN {crc} % 5 = 0 THEN sha256({told}) ELSE sha256({leaf}) END AS told,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, sha256({leaf})) - 1 AS pos
  FROM documents),
{_levels_sql("l", "d", height)},
u AS (SELECT tree AS own, '' AS tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos FROM l{height}),
{_levels_sql("t", "u", sources)},
base AS (SELECT d.doc_id, d.digest AS leaf, u.digest AS subroot, r.digest AS root,
    sha256({" || ".join(proof)}) AS proof_sha256, d.told AS f0, {columns}
  FROM d JOIN u ON u.own = d.tree CROSS JOIN t{sources} r{joins}){steps}
SELECT doc_id, leaf, subroot, root, proof_sha256, f{len(names)} AS folded_root,
       f{len(names)} = root AS verified FROM z{len(names)}
"""


OP13_SQL = _sql()
