"""Merkle manifest of a data set: a hash tree over the rows of each language, and one over the languages' roots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumifield.functions.lookup import attach
from lumifield.functions.stats import running_index
from lumifield.functions.storage import store, store_observed

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FILE_ROWS = 1 << 16  # nodes of a file of a level (some 10 MB)
HEADS = 20_000  # trees up to which their roots are broadcast: rows of about two kilobytes
PROOF = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(values: Sequence[Column]) -> Column:
    """Hash of a row: each value as its length in UTF-8 bytes, a colon and itself, or ``-`` for null."""
    text = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def _level(nodes: DataFrame, fanout: int, keep: Sequence[str] = ()) -> DataFrame:
    """``nodes`` (tree, idx, n, h) with before and after: the hashes of their siblings in the run, in order, on either side.

    Each sibling is fetched by an equality join on the computed index of its slot: idx XOR 1 for pairs, else the
    run's first index plus the slot shifted by 1, 2, ... around the run. The key is unique, so no task gathers a tree.
    """
    slot, out = F.col("idx") % fanout, nodes
    for shift in range(1, fanout):
        target = F.col("idx").bitwiseXOR(F.lit(1)) if fanout == 2 else F.col("idx") - slot + (slot + shift) % fanout
        other = nodes.select(F.col("tree").alias(f"t{shift}"), F.col("idx").alias(f"i{shift}"), F.col("h").alias(f"h{shift}"))
        out = out.join(other, (F.col("tree") == F.col(f"t{shift}")) & (target == F.col(f"i{shift}")), "left")
    at = lambda place: F.coalesce(*[F.when((slot + s) % fanout == place, F.col(f"h{s}")) for s in range(1, fanout)], F.lit(""))
    before = F.concat(*[F.when(slot > place, at(place)).otherwise("") for place in range(fanout)])
    after = F.concat(*[F.when(slot < place, at(place)).otherwise("") for place in range(fanout)])
    return out.select("tree", "idx", "n", "h", before.alias("before"), after.alias("after"), *keep)


def ascend(nodes: DataFrame, rows: int, most: int, fanout: int, keep: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """All levels of the trees with ``nodes`` as leaves, and their roots (tree, idx 0, n 1, h).

    ``n`` is the number of nodes of the tree at the level, ``most`` the largest n. A level is written once; the nodes in slot zero of each run
    emit the parent. A tree that has come down to one node carries it along until the largest tree is done. ``rows`` is the number of
    all nodes; levels are written to fewer files as they get smaller, so that small ones are joined without a shuffle.
    """
    levels = []
    while most > 1:
        level, rows = store(_level(nodes, fanout, () if levels else keep).coalesce(-(-rows // FILE_ROWS)), "level")
        levels.append(level)
        parent = F.when(F.col("n") > 1, digest(F.col("h"), F.col("after"))).otherwise(F.col("h"))
        nodes = level.where(F.col("idx") % fanout == 0).select(
            "tree", F.floor(F.col("idx") / fanout).alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), parent.alias("h"))
        most = -(-most // fanout)
    return levels, nodes


def descend(levels: Sequence[DataFrame], roots: DataFrame, fanout: int, keep: Sequence[str] = ()) -> DataFrame:
    """(tree, idx, h, proof and the columns ``keep``) of every leaf: its siblings from its own level up to the root.

    A node's proof is its own siblings and then its parent's proof, so that proofs are handed down level by level; each level is
    read once, and a row only ever joins its parent.
    """
    if not levels:
        return roots.withColumn("proof", F.array().cast(PROOF))
    proofs = roots.select("tree", "idx", F.array().cast(PROOF).alias("proof"))
    for depth, level in reversed(list(enumerate(levels))):
        up = proofs.select(F.col("tree").alias("t"), F.col("idx").alias("i"), F.col("proof").alias("rest"))
        own = F.when(F.col("n") > 1, F.array(F.struct("before", "after"))).otherwise(F.array().cast(PROOF))
        row = level.join(up, (F.col("tree") == F.col("t")) & (F.floor(F.col("idx") / fanout) == F.col("i")))
        proofs = row.select("tree", "idx", *(("h", *keep) if depth == 0 else ()), F.concat(own, "rest").alias("proof"))
    return proofs


def fold(start: Column, proof: Column) -> Column:
    """The root that follows from a leaf's hash and its proof."""
    return F.aggregate(proof, start, lambda h, s: digest(s["before"], h, s["after"]))


def proof_hash(proof: Column) -> Column:
    """Hash of the siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", fanout: int = 2,
             tampered: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: the ``order`` and ``group`` columns, leaf, subroot, root and proof; with ``tampered`` also tampered.

    The leaf is the hash of ``fields`` (see :func:`leaf`). In each group leaves ascend by ``order`` and then by their hash, and
    every ``fanout`` consecutive nodes become their hash until one is left, the subroot; the last run may be short, even one node. The subroots, by
    group (null first, by UTF-8 bytes), give the root in the same way. ``tampered`` is an expression over ``docs``, such as the
    leaf of a changed row, that is computed in the same pass over the texts.

    Leaves are numbered from a range sort over the whole cluster, not in a task per group, and each level is a join on unique indices,
    so that a group may hold any share of the rows. Texts are read once; from then on rows are a few hashes.

    Nulls in any column are marked in the leaf; rows with a null group are a group, rows with a null ``order`` come first; equal rows are leaves of
    their own; texts of any length are hashed whole; other columns are ignored. A single row is its own root with an empty proof. No rows give no rows.
    """
    named = docs.select(F.col(order).alias("key"), F.col(group).alias("name"),
                        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("sort"), leaf([F.col(f) for f in fields]).alias("h"),
                        *([] if tampered is None else [tampered.alias("changed")]))
    keep = [c for c in named.columns if c not in ("sort", "h")]
    leaves, _ = store(named, "leaves")
    groups, seen = store_observed(leaves.groupBy("sort").agg(F.count(F.lit(1)).alias("n")), "groups", most=F.max("n"))
    trees, _ = store(running_index(groups, [], [F.col("sort")], "tree"), "trees")
    placed = attach(running_index(leaves, ["sort"], [F.col("key"), F.col("h")], "idx"), (trees, seen["n"]), ["sort"], spread_by=("h",), max_rows=HEADS)
    nodes, n = store(placed.select("tree", "idx", "n", "h", *keep), "nodes")
    levels, roots = ascend(nodes, n, seen["most"] or 0, fanout, keep)
    rows = descend(levels, nodes, fanout, keep)
    roots, _ = store(roots.select("tree", "h").coalesce(-(-seen["n"] // FILE_ROWS) or 1), "roots")
    above, top = ascend(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(seen["n"]).alias("n"), "h"), seen["n"], seen["n"], fanout)
    heads = descend(above, top if above else roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "h"), fanout)
    root = top.select("tree", F.col("h").alias("root"))
    heads = attach(heads.select("tree", "idx", F.col("h").alias("subroot"), F.col("proof").alias("rest")), root, ["tree"], spread_by=("idx",)).drop("tree")
    out = attach(rows, heads.withColumnRenamed("idx", "tree"), ["tree"], spread_by=("h",), max_rows=HEADS)
    more = [] if tampered is None else [F.col("changed").alias("tampered")]
    return out.select(F.col("key").alias(order), F.col("name").alias(group), F.col("h").alias("leaf"), "subroot", "root",
                      F.concat("proof", "rest").alias("proof"), *more)
