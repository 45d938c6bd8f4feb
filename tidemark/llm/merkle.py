"""A Merkle manifest of a dataset, and a proof for every row.

A tree has nodes of up to `ARITY` children: consecutive nodes of a level, the last ones fewer, become
one node of the next, until one is left. Trees are written as postorder append logs by aligned
builders. A builder owns `FAN` (a power of the arity) leaves of a tree, from a multiple of `FAN` on, and
writes each node as soon as its children are complete, so nothing written is ever touched again and
builders share nothing. The roots of a tree's builders are the leaves of its next tier, which is built
alike, until one builder holds a whole tier.

Where a node stands in its log follows from the sizes of the subtrees before it (`position`), with
no search: a level-l node that ends at leaf `e` has ceil(e / ARITY**j) nodes of each level j <= l
up to itself before it, and of each higher level those that were complete when its first leaf came.
Proofs read the siblings of a leaf at these positions: in its own builder's log, then in that of
each tier above; what lies above a builder is the same for all its leaves and is looked up once.

The manifest has a tree for each source, leaves in the order of doc_id, and a tree over the roots of
the sources. A digest is the lower-case hex SHA-256 of its children's digests as text; a leaf's that
of its fields, each written as its UTF-8 byte count, a colon and the value, or `-` for null.

Leaves are numbered without sorting a source in one task: rows are dealt by ranges of (source,
doc_id, digest), numbered inside each range, and shifted by what earlier ranges hold of the source.

Defined cases: null and empty fields differ; a null source is a source of its own and comes first; rows
without doc_id come first in their source; repeated rows are leaves of their own, and rows of one
doc_id are ordered by digest; texts of any length are hashed inside the JVM; an empty table gives no
rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import settled

ARITY = 3
#: Levels below the root of a builder's subtree, and so its leaves.
LEVELS = 6
FAN = ARITY**LEVELS

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of `n` leaves."""
    h = 0
    while ARITY**h < n:
        h += 1
    return h


def position(level: int, index: int, n: int, top: int) -> int:
    """Place of a node in the postorder log of a tree of `n` leaves and `top` levels above them."""
    start, end = index * ARITY**level, min((index + 1) * ARITY**level, n)
    below = sum(-(-end // ARITY**j) for j in range(level + 1))
    return below - 1 + sum(start // ARITY**j for j in range(level + 1, top + 1))


def append_log(leaves: list[str], top: int) -> list[str]:
    """The nodes over `leaves` in the order of their completion, up to level `top`."""
    log: list[str] = []
    open_nodes: list[list[str]] = [[] for _ in range(top + 1)]

    def complete(level: int, node: str) -> None:
        log.append(node)
        if level < top:
            open_nodes[level].append(node)
            if len(open_nodes[level]) == ARITY:
                close(level)

    def close(level: int) -> None:
        children, open_nodes[level] = open_nodes[level], []
        complete(level + 1, digest(children))

    for leaf in leaves:
        complete(0, leaf)
    for level in range(top):
        if open_nodes[level]:
            close(level)
    return log


def path(log: list[str], leaf: int, n: int, top: int) -> list[tuple[list[str], list[str]]]:
    """For each level from the leaf on, the siblings left and right of the node above it."""
    out = []
    for level in range(top):
        count = -(-n // ARITY**level)
        node = leaf // ARITY**level
        first = node - node % ARITY
        side = [log[position(level, k, n, top)] for k in range(first, min(first + ARITY, count)) if k != node]
        out.append((side[: node - first], side[node - first :]))
    return out


def fold(leaf: str, siblings: list[tuple[list[str], list[str]]]) -> str:
    """The root over `leaf` and its siblings."""
    for left, right in siblings:
        leaf = digest([*left, leaf, *right])
    return leaf


def _packed(siblings: list[tuple[list[str], list[str]]]) -> str:
    return ";".join(f"{''.join(a)},{''.join(b)}" for a, b in siblings)


def _unpacked(text: str) -> list[tuple[list[str], list[str]]]:
    return [([a], [b]) for a, b in (x.split(",") for x in text.split(";"))] if text else []


def leaf_digest(columns: dict[str, Column]) -> Column:
    """The digest of a row's fields."""
    parts = []
    for name in FIELDS:
        value = columns[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """`rows` with `index`: 0, 1, 2, ... by `order` in each tree; ranges of rows are numbered each on its own."""
    dealt = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    dealt = settled(dealt.withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}), "merkle-ranges")
    parts = dealt.groupBy(tree, "_part").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start")
    parts = settled(parts.select(tree, "_part", starts), "merkle-starts")
    at = dealt.join(parts.hint("merge"), [tree, "_part"])
    return at.withColumn("index", F.col("_seq") + F.col("_start")).drop("_start", "_part", "_seq")


def build(leaves: DataFrame) -> list[DataFrame]:
    """The tiers of the trees over `leaves` (tree, index, digest), lowest first.

    Each tier: (tree, builder, n, top, nodes, root), one row for each builder, `nodes` its log.
    """
    tiers = []
    while True:
        size = leaves.groupBy("tree").agg((F.max("index") + 1).alias("leaves"))
        dealt = leaves.select("tree", F.expr(f"index div {FAN}").alias("builder"), "index", "digest")

        def write(table: pa.Table) -> pa.Table:
            table = table.sort_by("index")
            nodes = table["digest"].to_pylist()
            builder, n = table["builder"][0].as_py(), len(nodes)
            whole = builder == 0 and n < FAN  # perhaps the only builder of its tree; settled below
            log = append_log(nodes, height(n) if whole else LEVELS)
            return pa.table(
                {
                    "tree": table["tree"].slice(0, 1),
                    "builder": [builder],
                    "n": pa.array([n], pa.int32()),
                    "top": pa.array([height(n) if whole else LEVELS], pa.int32()),
                    "nodes": pa.array([log], pa.list_(pa.string())),
                    "root": [log[-1]],
                }
            )

        built = dealt.groupBy("tree", "builder").applyInArrow(
            write, "tree string, builder long, n int, top int, nodes array<string>, root string"
        )
        tiers.append(settled(built, "merkle-log"))
        many = size.where(F.col("leaves") > FAN).select("tree")
        if many.isEmpty():
            return tiers
        above = tiers[-1].select("tree", F.col("builder").alias("index"), F.col("root").alias("digest"))
        leaves = settled(above.join(many, "tree", "left_semi"), "merkle-tier")


def roots(tiers: list[DataFrame]) -> DataFrame:
    """(tree, root) of every tree: the root in the tier where it has one builder."""
    every = None
    for tier in tiers:
        top = tier.groupBy("tree").agg(F.min("root").alias("root"), F.count(F.lit(1)).alias("builders"))
        top = top.where("builders = 1").select("tree", "root")
        every = top if every is None else every.union(top)
    return every


def paths(logs: DataFrame) -> DataFrame:
    """(tree, index, upper): the siblings from every leaf of the builders' `logs` up to the root of all."""

    def walk(log: pa.Table) -> pa.Table:
        n, top, nodes, upper, builder = (log[c][0].as_py() for c in ("n", "top", "nodes", "upper", "builder"))
        return pa.table(
            {
                "tree": pa.array([log["tree"][0].as_py()] * n, pa.string()),
                "index": pa.array(np.arange(n) + builder * FAN, pa.int64()),
                "upper": pa.array([_packed(path(nodes, i, n, top) + _unpacked(upper)) for i in range(n)], pa.string()),
            }
        )

    return logs.groupBy("tree", "builder").applyInArrow(walk, "tree string, index long, upper string")


def above(tiers: list[DataFrame], beyond: DataFrame) -> DataFrame:
    """For each builder of the lowest tier `beyond`'s columns of its tree, `upper` now from the builder's root on.

    `beyond` has tree and upper, the siblings above the roots of the trees, and perhaps more.
    """
    known = None
    for level in reversed(range(len(tiers))):
        own = tiers[level].select("tree", "builder").join(beyond, "tree")
        if known is not None:
            own = own.join(known, ["tree", "builder"], "left")
            own = own.withColumn("upper", F.coalesce("_upper", "upper")).drop("_upper")
        own = settled(own, "merkle-above")
        if level:
            known = paths(tiers[level].join(own, ["tree", "builder"]))
            known = known.select("tree", F.col("index").alias("builder"), F.col("upper").alias("_upper"))
    return own


def manifest(docs: DataFrame) -> DataFrame:
    """A row with leaf, subroot, root and proof for every row of `docs`, and the fold of a tampered copy.

    In the copy the texts of every other doc_id (by crc32) lose their line feeds. Columns: doc_id, leaf,
    subroot, root, proof_sha256, folded_root, verified.
    """
    columns = {c: F.col(c) for c in FIELDS}
    number = F.col("doc_id").cast("long")
    tampered = F.when(F.crc32(number.cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"),
        number.alias("doc_id"),
        leaf_digest(columns).alias("digest"),
        leaf_digest(columns | {"text": tampered}).alias("tampered"),
    )
    rows = settled(rows, "merkle-digests")
    leaves = settled(numbered(rows, "tree", ["doc_id", "digest", "tampered"]), "merkle-leaves")
    tiers = build(leaves)
    subroots = settled(roots(tiers), "merkle-roots")
    # Over the sources, one tree that is called "".
    sources = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("digest"))
    sources = settled(numbered(sources, "tree", ["source"]), "merkle-sources")
    upper_tiers = build(sources)
    higher = above(upper_tiers, roots(upper_tiers).select("tree", F.col("root").alias("whole"), F.lit("").alias("upper")))
    from_sources = paths(upper_tiers[0].join(higher, ["tree", "builder"])).select("index", "upper")
    whole = roots(upper_tiers).select("tree", F.col("root").alias("whole"))
    beyond = sources.join(from_sources, "index").join(whole, "tree")
    beyond = settled(beyond.select(F.col("source").alias("tree"), F.col("digest").alias("subroot"), "whole", "upper"), "merkle-beyond")
    logs = tiers[0].join(above(tiers, beyond), ["tree", "builder"])

    def prove(table: pa.Table, log: pa.Table) -> pa.Table:
        ((n, top, nodes, upper, subroot, whole),) = zip(
            *(log[c].to_pylist() for c in ("n", "top", "nodes", "upper", "subroot", "whole")), strict=True
        )
        higher = _unpacked(upper)
        proofs, folded = [], []
        for index, leaf in zip(table["index"].to_numpy(), table["tampered"].to_pylist(), strict=True):
            siblings = path(nodes, int(index) % FAN, n, top) + higher
            proofs.append(digest([x for left, right in siblings for x in (*left, *right)]))
            folded.append(fold(leaf, siblings))
        count = table.num_rows
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "leaf": table["digest"],
                "subroot": pa.array([subroot] * count, pa.string()),
                "root": pa.array([whole] * count, pa.string()),
                "proof_sha256": pa.array(proofs, pa.string()),
                "folded_root": pa.array(folded, pa.string()),
                "verified": pa.array([x == whole for x in folded], pa.bool_()),
            }
        )

    return (
        leaves.withColumn("builder", F.expr(f"index div {FAN}"))
        .groupBy("tree", "builder")
        .cogroup(logs.groupBy("tree", "builder"))
        .applyInArrow(
            prove,
            "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
        )
    )
