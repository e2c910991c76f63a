"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import mapped
from .store import discard, keep

#: Edges that one task joins at once.
CHUNK = 1 << 20


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 under the edges a - b: the least node of each one's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as stars around the least node of each component that they have among themselves."""
    u = v = np.zeros(0, np.int64)

    def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = local_roots(at[: len(u)], at[len(u) :], len(nodes))
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return nodes[moved], nodes[root[moved]]

    fresh: list[pa.RecordBatch] = []
    for batch in batches:
        fresh.append(batch)
        if sum(b.num_rows for b in fresh) >= CHUNK:
            u, v = stars(*(np.concatenate([old, *(np.asarray(b.column(c), np.int64) for b in fresh)]) for old, c in ((u, "u"), (v, "v"))))
            fresh = []
    u, v = stars(*(np.concatenate([old, *(np.asarray(b.column(c), np.int64) for b in fresh)]) for old, c in ((u, "u"), (v, "v"))))
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _contracted(edges: DataFrame) -> tuple[DataFrame, int]:
    """Stars of as few partitions as hold ``CHUNK`` edges each, and how many those are."""
    parts = max(1, -(-edges.count() // CHUNK))
    return keep(edges.coalesce(parts).transform(mapped, _contract, "u long, v long")), parts


def _settled(stars: DataFrame) -> bool:
    """Whether every node is either a centre or hangs on one centre only."""
    ends = stars.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("centre")).unionByName(stars.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("centre")))
    return not ends.groupBy("node").agg(F.sum("hangs").alias("h"), F.max("centre").alias("c")).where("h > 1 or (h = 1 and c = 1)").take(1)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    # the least neighbours are read from a table, so that a node with very many edges is a skewed join that Spark can split
    met = both.join(least, "u").where(F.col("v") > F.col("u") if large else F.col("v") < F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        met = met.unionByName(least.select("u", F.col("m").alias("v")))
    return met.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of 64-bit ids -> node, component: every node of an edge, with the least id that can be reached.

    Partitions first join what they can on their own. Up to ``CHUNK`` edges are one partition, and done; of more, alternating large
    and small stars, each a few aggregations and joins, make stars around each component's least node in a number of rounds that
    grows with the logarithm of the longest path. Self-loops and repeated edges do no harm; edges with a null end are left out; no
    edges give an empty result.
    """
    plain = keep(edges.where("u is not null and v is not null").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")))
    stars, parts = _contracted(plain)
    discard(plain)
    while parts > 1 and not _settled(stars):
        wide = keep(_star(stars, True))
        after = keep(_star(wide, False))
        discard(wide)
        discard(stars)
        stars, _ = _contracted(after)
        discard(after)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
