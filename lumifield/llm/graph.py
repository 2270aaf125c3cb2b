"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumifield.functions.storage import store, store_observed
from lumifield.llm.words import batch

FEW = 1 << 18  # edges (4 MB) that one task finishes by itself, where rounds over the cluster would only cost time


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, comp) of all edges given, comp being the least node reachable."""
    got = [np.c_[np.asarray(b.column("a")), np.asarray(b.column("b"))] for b in batches]
    edges = np.concatenate(got) if got else np.zeros((0, 2), np.int64)
    nodes, place = np.unique(edges, return_inverse=True)
    a, b = place.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:
        low, new = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    yield batch(node=nodes, comp=nodes[root])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b: long); comp is the least node reachable.

    Alternating star contractions: each round keeps only minima per node and joins them back, so that a node with very
    many neighbours is never gathered in one group. Rounds are written to the shared folder and end when the edge table
    no longer changes; their number grows with the logarithm of the longest path. As soon as at most ``few`` edges
    are left to contract, from the start or after some rounds, one task joins them.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, n = store(e, "edges")
    seal = F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))
    last = None
    while n > few:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b")))
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        e, seen = store_observed(small, "edges", seal=seal)
        if last == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()
        last, n = seen, seen["n"]
    return e.coalesce(1).mapInArrow(_join, "node long, comp long")
