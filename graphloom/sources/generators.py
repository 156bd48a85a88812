"""Random geometric graphs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.random import uniform
from graphloom.operators.graph import Graph
from graphloom.operators.pairs import against, named, within
from graphloom.operators.step import ordered_sums

#: Expected degree of the unit-disc graph.
DEGREE = 20


def disc_points(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(id, p0, p1, w) uniform in a square of area n."""
    side = math.sqrt(n)
    return spark.range(n).select(F.col("id").cast("int").alias("id"), (uniform(seed, F.col("id"), 0) * side).alias("p0"), (uniform(seed, F.col("id"), 1) * side).alias("p1"), F.lit(1.0).alias("w"))


def disc_edges(points: DataFrame, radius: float) -> DataFrame:
    """(src, dst) pairs strictly nearer than the radius, by bands."""
    queries = points.select(F.col("id").alias("qid"), "p0", "p1", F.lit(radius).alias("radius"))
    near = within(points, queries, theta=2000).where("qid < id")
    a, b = named(points, "a"), named(points, "b")
    exact = near.join(a, F.col("qid") == F.col("a_id")).join(b, F.col("id") == F.col("b_id"))
    gap = (F.col("a_p0") - F.col("b_p0")) * (F.col("a_p0") - F.col("b_p0")) + (F.col("a_p1") - F.col("b_p1")) * (F.col("a_p1") - F.col("b_p1"))
    return exact.where(gap < radius * radius).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"))


def random_disc_graph(spark: SparkSession, n: int, seed: int = 0) -> tuple[Graph, DataFrame]:
    """The largest component of a unit-disc graph of expected degree 20, and its points (id, p0, p1)."""
    points = disc_points(spark, n, seed)
    g = Graph.from_edges(disc_edges(points, math.sqrt(DEGREE / math.pi)), points.select("id"))
    largest, mapping = g.largest_component()
    return largest, mapping.join(points, mapping["old"] == points["id"]).select(F.col("new").alias("id"), "p0", "p1")


def girg(spark: SparkSession, n: int = 1000, ple: float = 2.5, degree: float = 15, d: int = 2, temperature: float = 0.1, seed: int = 0, torus: bool = True, largest: bool = False) -> tuple[Graph, DataFrame]:
    """Geometric inhomogeneous random graph: power-law weights, uniform positions in the unit cube.

    Vertices join with probability min(1, (c w_u w_v / W / dist^d)^(1/T)) under the maximum norm, at temperature 0
    if that base reaches 1; c meets the mean degree on the torus. Without the torus positions are halved, so that
    nothing wraps, and weights shrink alike. Returns the graph and (id, p0.., w) with the weights scaled by c;
    ``largest``: only the largest component, its vertices renumbered. All pairs are looked at, in blocks.
    """
    w = F.pow(1 - uniform(seed, F.col("id"), 50), F.lit(-1.0 / (ple - 1)))
    pts = spark.range(n).select(F.col("id").cast("int").alias("id"), *[uniform(seed + 1, F.col("id"), k).alias(f"p{k}") for k in range(d)], w.alias("w"))
    _, sums = ordered_sums(pts, ["w"])
    pairs = against(named(pts, "a"), named(pts, "b"), F.col("a_id") < F.col("b_id"), "b_id")
    chance = F.lit(1.0) if temperature == 0 else F.pow(uniform(seed + 2, F.col("a_id"), F.col("b_id")), F.lit(float(temperature)))

    def need(wraps: bool) -> DataFrame:
        """The least c at which a pair joins: one number for each pair, so the wanted mean degree is a quantile."""
        gaps = [F.abs(F.col(f"a_p{k}") - F.col(f"b_p{k}")) for k in range(d)]
        gaps = [F.least(x, 1 - x) for x in gaps] if wraps else gaps
        far = F.pow(F.greatest(F.greatest(*gaps) if d > 1 else gaps[0], F.lit(1e-12)), F.lit(float(d)))
        return pairs.select("a_id", "b_id", (chance * sums["w"] * far / (F.col("a_w") * F.col("b_w"))).alias("need"))

    share = min(1.0, degree * n / 2 / max(1, n * (n - 1) // 2))
    c = need(True).approxQuantile("need", [share], 1e-4)[0] if n > 1 else 1.0
    edges = need(torus).where(F.col("need") <= c).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"))
    half = 1.0 if torus else 0.5
    pts = pts.select("id", *[(F.col(f"p{k}") * half).alias(f"p{k}") for k in range(d)], (F.col("w") * (c * half**d)).alias("w"))
    g = Graph.from_edges(edges, pts.select("id"), covering=True)
    if not largest:
        return g, pts
    part, mapping = g.largest_component()
    return part, pts.join(mapping.withColumnRenamed("old", "id"), "id").drop("id").withColumnRenamed("new", "id").select(*pts.columns)
