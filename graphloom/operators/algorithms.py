"""Breadth-first distances by frontier expansion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph
from graphloom.session import cut

#: Vertices and directed edges of a graph that every task may hold, distances that a task holds, origins of a task, rows of a batch.
HELD, CELLS, ORIGINS, ROWS = 1 << 23, 1 << 23, 512, 1 << 17


def bfs(g: Graph, origins: DataFrame) -> DataFrame:
    """(origin, id, dist) from each origin to every vertex; -1 if it can't be reached.

    One join with the edges and one anti join per level; only new vertices go on.
    """
    frontier = cut(origins.select(F.col("id").alias("origin"), F.col("id").alias("v"), F.lit(0).alias("dist")).distinct())
    seen, level = frontier, 0
    while not frontier.isEmpty():
        level += 1
        step = frontier.select("origin", F.col("v").alias("src")).join(g.edges, "src").select("origin", F.col("dst").alias("v")).distinct()
        frontier = cut(step.join(seen.select("origin", "v"), ["origin", "v"], "left_anti").withColumn("dist", F.lit(level)))
        seen = cut(seen.union(frontier)) if level % 4 == 0 else seen.union(frontier)
    every = origins.select(F.col("id").alias("origin")).distinct().join(g.nodes.select(F.col("id").alias("v")))
    return every.join(seen, ["origin", "v"], "left").select("origin", F.col("v").alias("id"), F.coalesce("dist", F.lit(-1)).alias("dist"))


def shortest_paths(g: Graph, origin: int) -> DataFrame:
    return bfs(g, g.nodes.where(F.col("id") == origin).select("id")).select("id", "dist")


def all_pairs(g: Graph) -> DataFrame:
    """(origin, id, dist) from every vertex to every vertex; -1 if it can't be reached.

    A graph of up to HELD numbers is broadcast; tasks then search from up to 64 origins at once, one bit for each, and no
    pair is shuffled or written to disk. The origins alternate in the rows, which are written in a fraction of the bytes
    that ids take which run through once for each origin. Larger graphs go level by level through joins.
    """
    if g.n + 2 * g.m > HELD:
        return bfs(g, g.nodes.select("id"))
    spark = g.nodes.sparkSession
    ids = np.sort(g.nodes.select("id").toArrow()["id"].to_numpy().astype(np.int32))
    e = g.edges.select("src", "dst").toArrow()
    src, dst = (np.searchsorted(ids, e[c].to_numpy()) for c in ("src", "dst"))
    order = np.argsort(src, kind="stable")
    shared = spark.sparkContext.broadcast((ids, np.r_[0, np.cumsum(np.bincount(src, minlength=len(ids)))], dst[order].astype(np.int32)))
    lanes = max(1, min(64, CELLS // max(1, len(ids))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, start, near = shared.value
        for b in batches:
            origins = np.searchsorted(ids, b.column(0).to_numpy())
            for at in range(0, len(origins), lanes):
                roots = origins[at : at + lanes]
                dist, size = waves(start, near, roots), max(1, ROWS // len(roots))
                for a in range(0, len(ids), size):
                    to = ids[a : a + size]
                    columns = np.tile(ids[roots], len(to)), np.repeat(to, len(roots)), dist[a : a + size].ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns], ["origin", "id", "dist"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-len(ids) // ORIGINS))
    return g.nodes.select("id").repartitionByRange(tasks, "id").sortWithinPartitions("id").mapInArrow(run, "origin int, id int, dist int")


def waves(start: np.ndarray, near: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """A row of distances to up to 64 roots for each vertex; the neighbours of v are near[start[v] : start[v + 1]]."""
    n, lanes = len(start) - 1, np.arange(len(roots))
    bit = np.uint64(1) << lanes.astype(np.uint64)
    dist = np.full((n, len(roots)), -1, np.int32)
    dist[roots, lanes] = 0
    seen, reach = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    np.bitwise_or.at(seen, roots, bit)
    nodes, level = np.unique(roots), 0
    bits = seen[nodes]
    while len(nodes):
        level += 1
        deg = start[nodes + 1] - start[nodes]
        ends = np.cumsum(deg)
        dst = near[np.repeat(start[nodes] - ends + deg, deg) + np.arange(ends[-1])]
        np.bitwise_or.at(reach, dst, np.repeat(bits, deg))
        nodes = np.flatnonzero(reach) if 8 * len(dst) > n else np.unique(dst)
        bits = reach[nodes] & ~seen[nodes]
        reach[nodes] = 0
        nodes, bits = nodes[bits != 0], bits[bits != 0]
        seen[nodes] |= bits
        found = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : len(roots)]
        dist[nodes] += found * np.int32(level + 1)
    return dist
