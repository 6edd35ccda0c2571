"""Merkle manifest of a dataset, with proofs by checkpoint and recomputation.

Every group of rows (here a language) has a hash tree over its leaves in a fixed order. Only every STRIDE-th level is written, as
aligned subtrees: a row holds the up to FANOUT^STRIDE consecutive nodes under one node of the next written level. Proofs are
extracted from the top down: a subtree's missing levels are computed again from its written nodes, each node gets its siblings
and what its subtree got from above, and the levels are let go. So a level between two written ones exists only inside a row,
and no row holds more than one subtree and one path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.llm.ranges import running_totals
from findlake.llm.storage import materialize

FANOUT = 8
#: Levels from one written level to the next.
STRIDE = 2


def leaf_digest(*values: Column) -> Column:
    """sha256 (lowercase hex) of the values: each ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _digest_of(nodes: Column) -> Column:
    return F.sha2(F.array_join(nodes, ""), 256)


def _runs(nodes: Column, fanout: int) -> Column:
    """An array cut in runs of ``fanout``."""
    last = F.floor((F.size(nodes) - 1) / fanout).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda r: F.slice(nodes, r * fanout + 1, fanout))


def _height(n: Column, fanout: int) -> Column:
    """Levels above ``n`` leaves until one node remains: the digits of n - 1 in base ``fanout``."""
    return F.when(n > 1, F.length(F.conv(n - 1, 10, fanout))).otherwise(0)


@dataclass
class Tree:
    """Written levels of the trees of all groups, from the leaves up, and ``tops``: group, n, digest."""

    levels: list[DataFrame]
    tops: DataFrame
    fanout: int = FANOUT
    stride: int = STRIDE


def build(leaves: DataFrame, group: str, order: list[str], digest: str, fanout: int = FANOUT, stride: int = STRIDE) -> Tree:
    """The trees over ``leaves``, one a value of ``group`` (null is one), leaves in ``order`` (nulls first), then by digest.

    Of each level every ``fanout`` consecutive nodes (the last run may be shorter, down to one) become the sha256 of their hex
    digests; a group of one leaf is its own tree. Other columns of ``leaves`` stay with them. Rows of a group that are equal in
    order and digest are interchangeable. An empty table gives trees of no group.
    """
    payload = [c for c in leaves.columns if c not in (group, digest)]
    named = leaves.select(F.col(group).alias("part"), F.col(digest).alias("digest"), F.struct(*[F.col(c) for c in payload]).alias("row"), *[F.col(c).alias(f"__by_{i}") for i, c in enumerate(order)])
    placed = running_totals(named, ["part"], [*[f"__by_{i}" for i in range(len(order))], "digest"], F.lit(1), "at", "n")
    placed = placed.select("part", "n", "at", "digest", "row")
    levels, tops, base, wide = [], None, 0, fanout**stride
    while True:
        columns = [c for c in ("at", "digest", "row") if c in placed.columns]
        subtrees = placed.groupBy("part", "n", F.floor(F.col("at") / wide).alias("subtree")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("nodes"))
        table = materialize(subtrees.select("part", "n", "subtree", F.transform("nodes", lambda x: x.dropFields("at")).alias("nodes")), f"merkle-{base}")
        levels.append(table)
        up = table.select("part", "n", "subtree", F.transform("nodes", lambda x: x["digest"]).alias("digests"), _height(F.col("n"), fanout).alias("height"))
        for k in range(stride):
            higher = F.transform(_runs(F.col("digests"), fanout), _digest_of)
            up = up.withColumn("digests", F.when(F.col("height") > base + k, higher).otherwise(F.col("digests")))
        base += stride
        done = up.where(F.col("height") <= base).select("part", "n", F.col("digests")[0].alias("digest"))
        tops = done if tops is None else tops.unionByName(done)
        rest = up.where(F.col("height") > base)
        if rest.isEmpty():
            return Tree(levels, tops, fanout, stride)
        placed = rest.select("part", "n", F.col("subtree").alias("at"), F.col("digests")[0].alias("digest"))


def _split(run: Column, at: Column, fanout: int) -> Column:
    return F.struct(F.slice(run, F.lit(1), at).alias("left"), F.slice(run, at + 2, fanout).alias("right"))


def proofs(tree: Tree, above: DataFrame) -> DataFrame:
    """A row a leaf: ``part``, ``digest``, the columns that came with it, those of ``above``, and ``proof``.

    ``proof`` lists the leaf's siblings from the lowest level up, as arrays ``left`` and ``right`` of each level. ``above`` (part,
    proof and at least one column more; a row a group) has what comes after each group's own levels; it travels down the tree.
    """
    fanout, stride = tree.fanout, tree.stride
    carried = F.struct(*[c for c in above.columns if c not in ("part", "proof")])
    top = above.select(F.col("part").alias("__part"), F.col("proof").alias("path"), carried.alias("carried"))
    paths = None
    for i in reversed(range(len(tree.levels))):
        base = i * stride
        t = tree.levels[i].withColumn("height", _height(F.col("n"), fanout))
        columns = ["part", "height", F.col("subtree").alias("at"), "nodes", "path", "carried"]
        # the one subtree at the top of a group goes on as the group does, others as their node of the level above
        rows = t.where(F.col("height") <= base + stride).join(top, F.col("part").eqNullSafe(F.col("__part"))).select(*columns)
        if paths is not None:
            known = paths.select(F.col("part").alias("__part"), F.col("at").alias("__at"), F.col("proof").alias("path"), "carried")
            inner = t.where(F.col("height") > base + stride).join(known, F.col("part").eqNullSafe(F.col("__part")) & (F.col("subtree") == F.col("__at")))
            rows = rows.unionByName(inner.select(*columns))
        # level after level from the subtree's top: a row holds the nodes below one node, and that node's path
        for k in reversed(range(stride)):
            wide = fanout**k
            last = F.floor((F.size("nodes") - 1) / wide).cast("int")
            rows = rows.withColumn("below", F.transform(F.sequence(F.lit(0), last), lambda r: F.slice("nodes", r * wide + 1, wide)))
            digests = F.transform("below", lambda b: F.transform(b, lambda x: x["digest"]))
            for _ in range(k):
                digests = F.transform(digests, lambda b: F.transform(_runs(b, fanout), _digest_of))
            rows = rows.withColumn("heads", F.transform(digests, lambda b: b[0]))
            rows = rows.select("part", "height", "at", "path", "carried", "heads", F.posexplode("below").alias("place", "nodes"))
            longer = F.concat(F.array(_split(F.col("heads"), F.col("place"), fanout)), "path")
            path = F.when(F.col("height") > base + k, longer).otherwise(F.col("path"))
            rows = rows.select("part", "height", (F.col("at") * fanout + F.col("place")).alias("at"), "nodes", path.alias("path"), "carried")
        paths = rows.select("part", "at", F.col("nodes")[0].alias("node"), F.col("path").alias("proof"), "carried")
        if i:
            # lineage is cut at every written level
            paths = materialize(paths.drop("node"), f"paths-{base}")
    return paths.select("part", F.col("node.digest").alias("digest"), "node.row.*", "carried.*", "proof")


def sibling_digest(proof: Column) -> Column:
    """sha256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.aggregate(proof, F.lit(""), lambda acc, s: F.concat(acc, F.array_join(s["left"], ""), F.array_join(s["right"], ""))), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf's digest and its siblings."""
    return F.aggregate(proof, leaf, lambda acc, s: F.sha2(F.concat(F.array_join(s["left"], ""), acc, F.array_join(s["right"], "")), 256))


#: The columns of a document's leaf, in their order.
LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def document_proofs(docs: DataFrame, given: Column | None = None, group: str = "lang") -> DataFrame:
    """A row a document: doc_id, leaf, given, subroot, root, proof.

    Trees go over the documents of each ``group`` value (null is one), by doc_id (null first), then by leaf; their roots, by
    value (null first, bytewise), are the leaves of the tree of the whole set. ``given`` is a digest to be held against the
    proofs (by default the leaf). Texts are hashed whole. Rows that repeat a doc_id each have a leaf; equal rows have equal leaves
    and each its own place. Nulls in any column have digests of their own, empty texts differ from null ones; other columns of
    ``docs`` play no part. An empty table gives none.
    """
    leaf = leaf_digest(*[F.col(c) for c in LEAF_COLUMNS])
    leaves = docs.select(F.col(group).cast("string").alias("part"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("digest"), (leaf if given is None else given).alias("given"))
    tree = build(leaves, "part", ["doc_id"], "digest")
    subroots = materialize(tree.tops.select("part", "digest"), "subroots")
    upper = build(subroots.select(F.lit(0).alias("all"), F.col("part").alias("name"), "digest"), "all", ["name"], "digest")
    no_proof = F.array().cast("array<struct<left:array<string>,right:array<string>>>")
    ends = proofs(upper, upper.tops.select("part", F.col("digest").alias("root"), no_proof.alias("proof")))
    tops = materialize(ends.select(F.col("name").alias("part"), F.col("digest").alias("subroot"), "root", "proof"), "tops")
    return proofs(tree, tops).select("doc_id", F.col("digest").alias("leaf"), "given", "subroot", "root", "proof")
