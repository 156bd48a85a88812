"""Connected components by alternating large-star and small-star steps; of a held graph, in one task.

Each step is one aggregation and one join on the vertex, which a vertex of very many edges doesn't gather in one task;
labels shrink toward the smallest
id in O(log^2 n) rounds whatever the diameter. Every round ends in a reliable checkpoint and
the driver sees only a count and a checksum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut, prepare, release, spread_join

#: Edges that one task may hold.
HELD = 1 << 22


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of the edges in ascending order, and the smallest one reachable from each.

    Each round hooks every root that has a smaller neighbour to its smallest one and flattens the trees; a root that is
    left with edges after two rounds has swallowed another, so O(log n) rounds are enough.
    """
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return ids, ids[root]


def _held(e: DataFrame) -> DataFrame:
    """(id, component) of the (u, v) edges, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if parts:
            found = least_reachable(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            yield from pa.table(list(map(pa.array, found)), ["id", "component"]).to_batches(max_chunksize=1 << 16)

    return e.select("u", "v").repartition(1).mapInArrow(run, "id long, component long")


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if small:
        both = both.where("v < u")
    centre = both.groupBy("u").agg(F.min("v").alias("m"))
    centre = centre.select(F.col("u"), F.least("u", "m").alias("m"))
    moved = spread_join(both if small else both.where("v > u"), centre, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    linked = moved.union(centre.select(F.col("u"), F.col("m").alias("v"))) if small else moved
    return linked.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """(id, component) for every vertex on some edge; component is the smallest id reachable.

    Vertices without edges do not occur in ``edges``; callers left-join and fall back to the own id.
    Self-loops and nulls are ignored. Up to HELD distinct edges one task finds them, with the same result: the plans of
    the rounds would fill the driver.
    """
    e = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if e.count() <= HELD:
        prepare(e.sparkSession)
        return cut(_held(e))
    seen = None
    for _ in range(max_rounds):
        e = cut(_stars(_stars(e, small=False), small=True))
        release(e.sparkSession)
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    leaves = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    centres = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return leaves.union(centres)
