"""Merkle manifest of a table: each row a leaf, a tree of 16 children a node for each source, and one over the sources' roots.

Checkpoint and recompute: a tree is cut into aligned subtrees of STRIDE levels (256 leaves). Only the lowest nodes of these are stored, a row
for each subtree, so that of the levels above the leaves every STRIDE-th is kept. Proofs come top down: the subtree that holds a node is
computed again from its stored row, its siblings are put before the path of the subtree's top, and the interior nodes are dropped.

A digest is the lower-case hexadecimal text of SHA-256. A path is an array of (left, right): the digests, put together, that
stand before and after the node among its parent's children, from the leaf's parent up to the root.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare, remainder
from .ranks import positioned

#: Children of a node; levels of an aligned subtree, of which the lowest is stored.
ARITY, STRIDE = 16, 2
SPAN = ARITY**STRIDE
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value as it is hashed: `-` for null, else its bytes' number, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(**changed: Column) -> Column:
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def parents(nodes: Column) -> Column:
    """The level above an array of nodes that begins with a parent's first child."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int")), lambda r: F.sha2(F.array_join(F.slice(nodes, r * ARITY + 1, F.lit(ARITY)), ""), 256))


def beside(nodes: Column, i: Column) -> Column:
    """The siblings of the i-th of nodes."""
    first = (F.floor(i / ARITY) * ARITY).cast("int")
    return F.struct(F.array_join(F.slice(nodes, first + 1, i - first), "").alias("left"), F.array_join(F.slice(nodes, i + 2, first + ARITY - i - 1), "").alias("right"))


@dataclass
class Tree:
    """blocks: for each stored level its aligned subtrees (group, block, width: the group's nodes at this level, nodes: array of structs with
    `node`); tops: the groups whose tree ends above that level, with their root (group, node)."""

    blocks: list[DataFrame]
    tops: list[DataFrame]

    def roots(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.tops)


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows (group, pos, width, node, ...) by aligned subtree: at most SPAN rows each."""
    own = [c for c in rows.columns if c not in ("group", "pos", "width")]
    block = F.floor(F.col("pos") / SPAN).cast("long").alias("block")
    out = rows.groupBy("group", block).agg(F.max("width").alias("width"), F.array_sort(F.collect_list(F.struct("pos", *own))).alias("nodes"))
    return materialize(out, "blocks")


def with_levels(blocks: DataFrame) -> DataFrame:
    """blocks with the levels of each subtree as arrays l0, l1, ... up to its top, computed anew from its stored nodes."""
    out = blocks.withColumn("l0", F.transform("nodes", lambda x: x["node"]))
    for j in range(STRIDE):
        out = out.withColumn(f"l{j + 1}", F.when(F.col("width") > ARITY**j, parents(F.col(f"l{j}"))).otherwise(F.col(f"l{j}")))
    return out


def grow(leaves: DataFrame) -> Tree:
    """The tree of each group of leaves (group, pos, width, node, ...); it has as many stored levels as the widest group needs."""
    blocks, tops = [], []
    rows = leaves
    while True:
        blocks.append(in_blocks(rows))
        width = F.when(F.col("width") > ARITY, F.ceil(F.col("width") / SPAN)).otherwise(F.lit(1)).cast("long")
        risen = materialize(with_levels(blocks[-1]).select("group", F.col("block").alias("pos"), width.alias("width"), F.element_at(f"l{STRIDE}", 1).alias("node")), "nodes")
        tops.append(risen.where("width = 1").select("group", "node"))
        rows = risen.where("width > 1")
        if rows.isEmpty():
            return Tree(blocks, tops)


def descend(tree: Tree, start: DataFrame) -> DataFrame:
    """Each leaf's row (group, width, and the fields of nodes) with its path; start: group, path above the group's root, and columns to be handed down."""
    more = [c for c in start.columns if c not in ("group", "path")]
    level = len(tree.blocks) - 1
    above = lambda k: tree.tops[k].select("group").join(start, "group").select("group", F.lit(0).cast("long").alias("block"), "path", *more)
    coming = above(level)
    while True:
        lower = [F.col(f"l{j}") for j in range(STRIDE)]

        def path(i: Column, lower: list[Column] = lower) -> Column:
            own = [F.when(F.col("width") > ARITY**j, F.array(beside(l, F.floor(i / ARITY**j).cast("int")))).otherwise(F.array().cast(PATH)) for j, l in enumerate(lower)]
            return F.concat(*own, F.col("path"))

        each = F.explode(F.transform("nodes", lambda x, i: F.struct(x.alias("x"), path(i).alias("path"))))
        out = with_levels(tree.blocks[level]).join(coming, ["group", "block"]).select("group", *more, each.alias("each")).select("group", *more, "each.x.*", "each.path")
        if not level:
            return out
        level -= 1
        coming = materialize(out.select("group", F.col("pos").alias("block"), "path", *more), "paths").unionByName(above(level))


@dataclass
class Manifest:
    """leaves: a tree for each source (its groups); sources: the tree over their roots, in one group."""

    leaves: Tree
    sources: Tree


def manifest(documents: DataFrame) -> Manifest:
    """The manifest of documents (doc_id, source, lang, n_chars, text). Per source, leaves ascend by doc_id (null first, then by leaf).

    Nulls in any column are hashed as `-`; documents without a source are a source of their own, the first. Rows that repeat a doc_id are
    leaves of their own. An empty table has no root. Other columns take no part.
    """
    prepare(documents.sparkSession)
    changed = leaf_of(text=F.translate("text", UPPER, LOWER))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        # a text that is never null and sorts like the source, nulls first
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("group"),
        leaf_of().alias("node"),
        F.when((remainder(F.col("doc_id"), 5) == 0) & F.col("text").rlike("[A-Z]"), changed).alias("tampered"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = grow(positioned(materialize(rows, "leaves"), "group", ["doc_id", "node", "row"]).drop("row"))
    subroots = materialize(leaves.roots().select(F.lit("").alias("group"), F.col("group").alias("source"), "node"), "subroots")
    return Manifest(leaves, grow(positioned(subroots, "group", ["source"])))


def proofs(m: Manifest) -> DataFrame:
    """For each leaf: group (its source), doc_id, leaf, tampered (the leaf of the row with its text's A-Z lower-cased; null where that is the same
    or the row isn't chosen), subroot, root and the path up to the root."""
    top = m.sources.roots().select("group", F.col("node").alias("root"), F.array().cast(PATH).alias("path"))
    start = descend(m.sources, top).select(F.col("source").alias("group"), F.col("node").alias("subroot"), "root", "path")
    return descend(m.leaves, materialize(start, "start")).withColumnRenamed("node", "leaf")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings along its path give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def checked(documents: DataFrame) -> DataFrame:
    """Of each row: doc_id, leaf, subroot, root, the digest of its proof, the root folded from its (tampered) leaf, and whether that is the root.
    Where a row's doc_id is null, it counts as '' for the choice of what is tampered. Other cases: see manifest."""
    out = proofs(manifest(documents))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    out = out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
