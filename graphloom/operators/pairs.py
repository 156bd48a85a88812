"""Pair joins over vertices with coordinates: range joins, boxes, nearest neighbours, samples.

Points are rows (id, p0..p{d-1}, w). A range join of few points is a theta join against a broadcast side; its
size is checked first. Beyond that, points are put in weight classes and grid cells: for each pair of classes
the cell is as wide as the largest radius between them, so partners lie in neighbouring cells, found by an
equi-join; the exact test follows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.random import uniform
from graphloom.functions.spaces import Point, distance, inf_distance, sq_distance, total
from graphloom.operators.graph import Graph
from graphloom.session import cut

#: Up to this many points the theta join is used (its broadcast side is then a few MB at most).
THETA = 20_000
#: Dimensions that cells are made of.
CELL_DIMS = 2


def named(points: DataFrame, prefix: str) -> DataFrame:
    """Columns renamed to prefix_column."""
    return points.toDF(*(f"{prefix}_{c}" for c in points.columns))


def coords(prefix: str, d: int) -> Point:
    return [F.col(f"{prefix}_p{k}") for k in range(d)]


def dimension(points: DataFrame) -> int:
    return sum(c[:1] == "p" and c[1:].isdigit() for c in points.columns)


def flatten(positions: DataFrame, d: int) -> DataFrame:
    """(id, pos array[, w]) as (id, p0.., w)."""
    w = F.col("w") if "w" in positions.columns else F.lit(1.0)
    return positions.select("id", *[F.get("pos", k).cast("double").alias(f"p{k}") for k in range(d)], w.cast("double").alias("w"))


def nest(points: DataFrame) -> DataFrame:
    return points.select("id", F.array(*[f"p{k}" for k in range(dimension(points))]).alias("pos"))


def weight_buckets(points: DataFrame, factor: float = 2.0) -> list[float]:
    """least * factor^k for k from 1 while below the largest weight."""
    r = points.agg(F.min("w").alias("a"), F.max("w").alias("b")).first()
    out: list[float] = []
    if r.a is not None and r.a > 0:
        x = r.a * factor
        while x < r.b:
            out.append(x)
            x *= factor
    return out


def weight_class(w: Column, buckets: list[float]) -> Column:
    """How many buckets the weight reaches."""
    return sum((F.when(w >= b, 1).otherwise(0) for b in buckets), F.lit(0))


def class_maxima(points: DataFrame, buckets: list[float]) -> list[float]:
    top = points.agg(F.max("w")).first()[0]
    return [*buckets, top if top is not None else 0.0]


def against(many: DataFrame, few: DataFrame, test: Column, key: str, theta: int = THETA) -> DataFrame:
    """many x few where the test holds: a theta join in which ``few`` is broadcast in blocks of about theta / 2 rows."""
    blocks = -(-few.count() // max(1, theta // 2)) if few.limit(theta + 1).count() > theta else 1
    if blocks == 1:
        return many.join(F.broadcast(few), test)
    dealt = F.pmod(F.xxhash64(key), F.lit(blocks))
    return reduce(DataFrame.unionAll, [many.join(F.broadcast(few.where(dealt == k)), test) for k in range(blocks)])


def weighted_within(points: DataFrame, radius: float, strict: bool = False, theta: int = THETA, queries: DataFrame | None = None, additive: bool = False) -> DataFrame:
    """(a_*, b_*) ordered pairs, a other than b, with dist <= radius * (w_a w_b)^(1/d); additive: w_a^(1/d) + w_b^(1/d)."""
    d = dimension(points)
    queries = points if queries is None else queries
    a, b = named(queries, "a"), named(points, "b")
    root = F.lit(1.0 / d)
    reach = radius * (F.pow("a_w", root) + F.pow("b_w", root) if additive else F.pow(F.col("a_w") * F.col("b_w"), root))
    gap = distance(coords("a", d), coords("b", d))
    exact = (F.col("a_id") != F.col("b_id")) & ((gap < reach) if strict else (gap <= reach))
    if points.limit(theta + 1).count() <= theta:
        return a.join(F.broadcast(b), exact)
    buckets = weight_buckets(points.select("w").union(queries.select("w")))
    tops = class_maxima(points.select("w").union(queries.select("w")), buckets)
    n = len(tops)
    far = lambda x, y: x ** (1.0 / d) + y ** (1.0 / d) if additive else (x * y) ** (1.0 / d)
    widths = [[max(radius * far(tops[i], tops[j]), 1e-12) * (1 + 1e-9) for j in range(n)] for i in range(n)]
    width = F.array(*[F.array(*[F.lit(x) for x in row]) for row in widths])
    dims = range(min(CELL_DIMS, d))

    def cell(prefix: str, other: str) -> list[Column]:
        side = F.get(F.get(width, F.col("ci")), F.col("cj"))
        return [F.floor(F.col(f"{prefix}_p{k}") / side).alias(f"{other}{k}") for k in dims]

    left = a.withColumn("ci", weight_class(F.col("a_w"), buckets)).withColumn("cj", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    left = left.select("*", *cell("a", "g"))
    around = F.array(*[F.struct(*[F.lit(x).alias(f"s{k}") for k, x in enumerate(step)]) for step in product((-1, 0, 1), repeat=len(dims))])
    left = left.withColumn("s", F.explode(around)).select("*", *[(F.col(f"g{k}") + F.col(f"s.s{k}")).alias(f"c{k}") for k in dims]).drop("s", *[f"g{k}" for k in dims])
    right = b.withColumn("cj", weight_class(F.col("b_w"), buckets)).withColumn("ci", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    right = right.select("*", *cell("b", "c"))
    keys = ["ci", "cj", *[f"c{k}" for k in dims]]
    return left.join(right, keys).where(exact).drop(*keys)


def main_axis(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and unit direction of the largest spread: the first right singular vector of the centred points.

    Partitions add up their moments; the driver gets one d x d matrix.
    """
    d = dimension(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns], axis=1)
            n, one, two = n + len(x), one + x.sum(axis=0), two + x.T @ x
        flat = np.r_[float(n), one, two.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["k", "v"])

    parts = points.select(*[f"p{k}" for k in range(d)]).mapInArrow(run, "k long, v double")
    flat = np.array([r.v for r in parts.groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()])
    if not len(flat) or not flat[0]:
        return np.zeros(d), np.eye(d)[0]
    mean = flat[1 : d + 1] / flat[0]
    spread = flat[d + 1 :].reshape(d, d) / flat[0] - np.outer(mean, mean)
    return mean, np.linalg.eigh(spread)[1][:, -1] if np.isfinite(spread).all() else np.eye(d)[0]


def within(points: DataFrame, queries: DataFrame, theta: int = THETA) -> DataFrame:
    """(qid, id) of points within each query's radius (inclusive); queries: qid, p0.., radius.

    Beyond ``theta`` queries, by bands along the main axis, a median radius wide; a wider query takes more of them.
    """
    d = dimension(points)
    a, b = named(queries, "a"), named(points, "b")
    exact = sq_distance(coords("a", d), coords("b", d)) <= F.col("a_radius") * F.col("a_radius")
    if queries.limit(theta + 1).count() <= theta:
        joined = b.join(F.broadcast(a), exact)
    else:
        mean, axis = main_axis(points)
        r = queries.agg(F.percentile_approx("radius", 0.5), F.max("radius")).first()
        side = r[0] or r[1] or 1.0
        along = lambda x: total([(F.col(f"{x}_p{k}") - float(mean[k])) * float(axis[k]) for k in range(d)])
        reach = F.col("a_radius") * (1 + 1e-9) + 1e-9 * side  # a projection shortens distances, up to rounding
        bands = F.sequence(F.floor((along("a") - reach) / side), F.floor((along("a") + reach) / side))
        joined = a.withColumn("band", F.explode(bands)).join(b.withColumn("band", F.floor(along("b") / side)), "band").where(exact)
    return joined.select(F.col("a_qid").alias("qid"), F.col("b_id").alias("id"))


def within_box(points: DataFrame, radius: float) -> DataFrame:
    """(a_id, b_id) with the largest coordinate gap at most radius * (w_a w_b)^(1/d); by the same cells."""
    d = dimension(points)
    near = weighted_within(points, radius * math.sqrt(d))
    return near.where(inf_distance(coords("a", d), coords("b", d)) <= radius * F.pow(F.col("a_w") * F.col("b_w"), F.lit(1.0 / d))).select("a_id", "b_id")


def nearest(points: DataFrame, queries: DataFrame, k: int, theta: int = THETA) -> DataFrame:
    """(a_id, b_id, rank, dist): k nearest points of each query but itself; ties to smaller ids.

    Queries are broadcast in blocks of checked size; each task keeps its k best by a partial top-k before the shuffle.
    """
    d = dimension(points)
    pairs = against(named(points, "b"), named(queries, "a"), F.col("a_id") != F.col("b_id"), "a_id", theta)
    pairs = pairs.select("a_id", "b_id", distance(coords("a", d), coords("b", d)).alias("dist"))
    rank = F.row_number().over(Window.partitionBy("a_id").orderBy("dist", "b_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def attached(edges: DataFrame, points: DataFrame) -> DataFrame:
    """edges(src, dst) with both ends' columns: a_* and b_*."""
    return edges.select(F.col("src").alias("a_id"), F.col("dst").alias("b_id")).join(named(points, "a"), "a_id").join(named(points, "b"), "b_id")


def non_edges(g: Graph, points: DataFrame, p: float = 1.0, seed: int = 0, theta: int = THETA) -> DataFrame:
    """(a_*, b_*) for pairs a < b that are no edge, each taken with probability p.

    p = 1 gives all; there are n(n-1)/2 of them, made in blocks and never shuffled: each vertex carries its neighbours.
    For p < 1 each vertex jumps over its larger ones in geometric steps, which takes every pair with probability p by
    itself and costs the pairs taken, not all. Ids are those from 0 to n - 1.
    """
    if p >= 1:
        many = cut(named(with_near(g, points), "a").repartition("a_id"))
        return against(many, named(points, "b"), (F.col("a_id") < F.col("b_id")) & ~F.array_contains("a_near", F.col("b_id")), "b_id", theta).drop("a_near")
    pairs = jumps(g.nodes, g.n, p, seed).join(named(points, "a"), "a_id").join(named(points, "b"), "b_id")
    e = g.edges.select(F.col("src").alias("a_id"), F.col("dst").alias("b_id"))
    return pairs.join(e, ["a_id", "b_id"], "left_anti")


def with_near(g: Graph, points: DataFrame) -> DataFrame:
    """points with near: the neighbours that are points, too."""
    ids = points.select(F.col("id").alias("dst"))
    near = g.edges.join(ids, "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("near"))
    return points.join(near, "id", "left").withColumn("near", F.coalesce("near", F.array().cast("array<int>")))


def jumps(nodes: DataFrame, n: int, p: float, seed: int) -> DataFrame:
    """(a_id, b_id), a < b < n: each pair with probability p, the same on any partitioning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in batch.column(0).to_pylist():
                draw, at = np.random.default_rng([seed & 0xFFFFFFFF, a]), a
                while at < n and p > 0:
                    size = min(1 << 20, int(1.1 * p * (n - at)) + 16)
                    steps = at + np.cumsum(draw.geometric(p, size))
                    b = steps[steps < n]
                    if len(b):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), a, np.int32)), pa.array(b.astype(np.int32))], ["a_id", "b_id"])
                    at = int(steps[-1])

    return nodes.select("id").mapInArrow(run, "a_id int, b_id int")


def negative_candidates(g: Graph, k: int, seed: int, iteration: int) -> DataFrame:
    """(src, dst): k random other vertices of each vertex, without repeats and without neighbours."""
    n = g.n
    drawn = g.nodes.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("k"))
    drawn = drawn.select("src", F.floor(uniform(seed, F.col("src"), F.col("k"), iteration) * n).cast("int").alias("dst")).where("src <> dst").distinct()
    return g.not_adjacent(drawn)
