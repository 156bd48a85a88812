"""One gradient step: forces, losses, optimizers, recentring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.random import sample, unit_vector
from graphloom.functions.spaces import distance, safe_divide, total
from graphloom.operators.graph import Graph
from graphloom.operators.pairs import attached, coords, dimension, named, negative_candidates, weighted_within

#: Rows summed one after the other in a deterministic sum.
BLOCK = 4096


def degree_weights(g: Graph) -> DataFrame:
    return g.degrees().select("id", F.greatest("deg", F.lit(1)).cast("double").alias("w"))


def unit_weights(g: Graph) -> DataFrame:
    return g.nodes.select("id", F.lit(1.0).alias("w"))


def rescaled(weights: DataFrame, d: int, hint: float = -1) -> DataFrame:
    """w^(d / hint) if hint is positive, then scaled to mean 1."""
    raised = weights.select("id", (F.pow("w", F.lit(d / hint)) if hint > 0 else F.col("w")).alias("w"))
    n, all_ = ordered_sums(raised, ["w"])
    return raised.select("id", (F.col("w") / F.lit(all_["w"] / n if n and all_["w"] else 1.0)).alias("w"))


@dataclass(frozen=True)
class Forces:
    attraction: float = 1.0
    repulsion: float = 1.0
    centre: float = 0.0
    length: float = 1.0
    additive: bool = False
    negatives: int = -1
    index_size: float = 1.0
    seed: int = 0
    iteration: int = 0


def _parts(pairs: DataFrame, d: int, o: Forces, attract: bool) -> DataFrame:
    """(id, other, f0.., loss) of each ordered pair on which the force acts."""
    a, b = coords("a", d), coords("b", d)
    root = F.lit(1.0 / d)
    if o.additive:
        s = 1 / (F.pow("a_w", root) + F.pow("b_w", root))
    else:
        s = F.pow(F.col("a_w"), -root) * F.pow(F.col("b_w"), -root)
    pairs = pairs.withColumn("gap", distance(a, b)).withColumn("s", s)
    gap, s = F.col("gap"), F.col("s")
    active = (gap * s > o.length) if attract else (gap * s <= o.length)
    scale = o.attraction if attract else o.repulsion
    push = unit_vector(d, o.seed, F.col("a_id"), o.iteration)
    force = [F.when(gap <= 0, u).otherwise(scale * s * ((y - x) if attract else (x - y)) / F.when(gap > 0, gap)) for x, y, u in zip(a, b, push, strict=True)]
    loss = F.when(gap <= 0, 0.0).otherwise((gap - o.length / s) if attract else (o.length / s - gap))
    return pairs.where(active | (gap <= 0)).select(F.col("a_id").alias("id"), F.col("b_id").alias("other"), *[f.alias(f"f{k}") for k, f in enumerate(force)], loss.alias("loss"))


def attraction(g: Graph, points: DataFrame, o: Forces = Forces()) -> DataFrame:
    return _parts(attached(g.edges, points), dimension(points), o, True)


def repulsion(g: Graph, points: DataFrame, o: Forces = Forces()) -> DataFrame:
    """Over ordered pairs that are no edge and differ in color; index_size below 1: only such a part of the vertices,
    drawn anew in each iteration, pushes others."""
    d = dimension(points)
    colored = points.join(g.nodes, "id")
    if o.negatives >= 0:
        pairs = attached(negative_candidates(g, o.negatives, o.seed, o.iteration), colored)
    else:
        every = colored.select(*points.columns, "color")
        some = every if o.index_size >= 1 else sample(every, max(1, int(g.n * o.index_size)), o.seed + o.iteration)
        pairs = weighted_within(some, o.length * (1 + 1e-12), queries=every, additive=o.additive)
    pairs = pairs.where("a_color <> b_color")
    e = g.edges.select(F.col("src").alias("a_id"), F.col("dst").alias("b_id"))
    parts = _parts(pairs.join(e, ["a_id", "b_id"], "left_anti"), d, o, False)
    if o.negatives > 0:
        scale = g.n / o.negatives
        parts = parts.select("id", "other", *[(F.col(f"f{k}") * scale).alias(f"f{k}") for k in range(d)], "loss")
    return parts


def centre(points: DataFrame, o: Forces) -> DataFrame:
    d = dimension(points)
    return points.select("id", F.lit(None).cast("int").alias("other"), *[(-o.centre * F.col(f"p{k}")).alias(f"f{k}") for k in range(d)], F.lit(0.0).alias("loss"))


def fold(value: Column, key: Column) -> Column:
    """Sum of a group in the order of its keys: the same double on any partitioning."""
    return F.aggregate(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v")))), F.lit(0.0), lambda acc, x: acc + x["v"])


def deterministic_sum(df: DataFrame, by: list[str], key: str, values: list[str]) -> DataFrame:
    """Ordered sums: blocks of BLOCK keys one by one, then the blocks; no list is longer than a block."""
    parts = df.withColumn("_b", F.coalesce(F.floor(F.col(key) / BLOCK), F.lit(-1))).groupBy(*by, "_b").agg(*[fold(F.col(v), F.col(key)).alias(v) for v in values])
    return parts.groupBy(*by).agg(*[fold(F.col(v), F.col("_b")).alias(v) for v in values])


def ordered_sums(df: DataFrame, values: list[str], key: str = "id") -> tuple[int, dict[str, float]]:
    """How many rows there are, and the sum of each value: the same doubles on any partitioning."""
    row = deterministic_sum(df.withColumn("_n", F.lit(1.0)), [], key, [*values, "_n"]).first()
    return int(row["_n"] or 0), {v: row[v] for v in values}


def forces(g: Graph, points: DataFrame, o: Forces = Forces()) -> DataFrame:
    """(id, f0.., attract, repel) of every vertex, zero where nothing acts; ordered sums."""
    d = dimension(points)
    f = [f"f{k}" for k in range(d)]
    rows = attraction(g, points, o).withColumn("attract", F.col("loss")).withColumn("repel", F.lit(0.0)).drop("loss")
    rows = rows.unionByName(repulsion(g, points, o).withColumn("repel", F.col("loss")).withColumn("attract", F.lit(0.0)).drop("loss"))
    if o.centre:
        rows = rows.unionByName(centre(points, o).withColumn("attract", F.lit(0.0)).withColumn("repel", F.lit(0.0)).drop("loss"))
    sums = deterministic_sum(rows, ["id"], "other", [*f, "attract", "repel"])
    return points.select("id").join(sums, "id", "left").select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in (*f, "attract", "repel")])


def losses(g: Graph, points: DataFrame, o: Forces = Forces()) -> DataFrame:
    """One row: attractive, repulsive, repelling_pairs; sums in any order."""
    a = attraction(g, points, o).agg(F.coalesce(F.sum("loss"), F.lit(0.0)).alias("attractive"))
    r = repulsion(g, points, o).agg(F.coalesce(F.sum("loss"), F.lit(0.0)).alias("repulsive"), F.count(F.lit(1)).alias("repelling_pairs"))
    return a.join(r)


def adam(state: DataFrame, d: int, lr: float, t: int, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> DataFrame:
    """state(id, p*, m*, v*, f*, w, ...) after step t from 1: moments and positions moved along the force."""
    rest = [c for c in state.columns if not (c[:1] in "pmv" and c[1:].isdigit())]
    m = [b1 * F.col(f"m{k}") + (1 - b1) * F.col(f"f{k}") for k in range(d)]
    v = [b2 * F.col(f"v{k}") + (1 - b2) * F.col(f"f{k}") * F.col(f"f{k}") for k in range(d)]
    p = [F.col(f"p{k}") + lr * (m[k] / (1 - b1**t)) / (F.sqrt(v[k] / (1 - b2**t)) + eps) for k in range(d)]
    return state.select(*rest, *[x.alias(f"p{k}") for k, x in enumerate(p)], *[x.alias(f"m{k}") for k, x in enumerate(m)], *[x.alias(f"v{k}") for k, x in enumerate(v)])


def simple(state: DataFrame, d: int, lr: float, most: float = 1.0) -> DataFrame:
    rest = [c for c in state.columns if not (c[:1] == "p" and c[1:].isdigit())]
    return state.select(*rest, *[(F.col(f"p{k}") + lr * F.greatest(F.lit(-most), F.least(F.lit(most), F.col(f"f{k}")))).alias(f"p{k}") for k in range(d)])


def centroid(points: DataFrame) -> DataFrame:
    """One row (c0, ..): means by ordered sums; null without points."""
    d = dimension(points)
    sums = deterministic_sum(points.withColumn("_n", F.lit(1.0)), [], "id", [*[f"p{k}" for k in range(d)], "_n"])
    return sums.select(*[F.when(F.col("_n") > 0, F.col(f"p{k}") / F.col("_n")).alias(f"c{k}") for k in range(d)])


def recentred(points: DataFrame) -> DataFrame:
    d = dimension(points)
    c = centroid(points).first()
    return points.select(*[(F.col(x) - F.lit(c[int(x[1:])] or 0.0)).alias(x) if x in {f"p{k}" for k in range(d)} else x for x in points.columns])


def displacement(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: mean displacement, RMS radius after, and their ratio (0 at radius 0)."""
    d = dimension(after)
    both = named(before, "a").join(named(after, "b"), F.col("a_id") == F.col("b_id"))
    both = both.select(F.col("a_id").alias("id"), distance(coords("a", d), coords("b", d)).alias("moved"), total([x * x for x in coords("b", d)]).alias("square"), F.lit(1.0).alias("n"))
    one = deterministic_sum(both, [], "id", ["moved", "square", "n"]).select((F.col("moved") / F.col("n")).alias("displacement"), F.sqrt(F.col("square") / F.col("n")).alias("radius"))
    return one.select("displacement", "radius", safe_divide(F.col("displacement"), F.col("radius"), F.lit(0.0)).alias("ratio"))
