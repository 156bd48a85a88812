"""Coarsening: label propagation, aggressive merging, contraction, hierarchies, expansion."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.random import ball_vector
from graphloom.operators.graph import Graph, dense
from graphloom.operators.pairs import dimension
from graphloom.session import cut, wide_batches

SWEEPS, CAPACITY, SMALLEST = 20, 6, 10
#: Vertices and directed edges that one task may hold.
HELD = 1 << 22


def compact(clusters: DataFrame) -> DataFrame:
    """clusters(id, cluster): numbers in the order of first appearance."""
    least = clusters.groupBy("cluster").agg(F.min("id").alias("least"))
    number = least.join(dense(least, "least", "new"), "least").select("cluster", "new")
    return clusters.join(number, "cluster").select("id", F.col("new").cast("int").alias("cluster"))


def contract(weighted: DataFrame, clusters: DataFrame) -> DataFrame:
    """weighted(src, dst, w) with (csrc, cdst) of each directed edge; null inside a cluster."""
    c = clusters.select("id", "cluster")
    both = weighted.join(c.select(F.col("id").alias("src"), F.col("cluster").alias("csrc")), "src").join(c.select(F.col("id").alias("dst"), F.col("cluster").alias("cdst")), "dst")
    inner = F.col("csrc") == F.col("cdst")
    return both.select("src", "dst", "w", F.when(~inner, F.col("csrc")).alias("csrc"), F.when(~inner, F.col("cdst")).alias("cdst"))


def coarsen(g: Graph, clusters: DataFrame) -> tuple[Graph, DataFrame]:
    """The coarse graph and edge_map(eid, coarse_eid), -1 inside a cluster."""
    eids = g.edge_ids()
    mapped = contract(eids.withColumn("w", F.lit(1.0)).select("src", "dst", "w"), clusters)
    nodes = clusters.select(F.col("cluster").alias("id")).distinct().withColumn("color", F.col("id"))
    coarse = Graph(nodes, mapped.where("csrc is not null").select(F.col("csrc").alias("src"), F.col("cdst").alias("dst")).distinct())
    ceids = coarse.edge_ids().select(F.col("eid").alias("coarse_eid"), F.col("src").alias("csrc"), F.col("dst").alias("cdst"))
    edge_map = eids.join(mapped.drop("w"), ["src", "dst"]).join(ceids, ["csrc", "cdst"], "left").select("eid", F.coalesce("coarse_eid", F.lit(-1)).alias("coarse_eid"))
    return coarse, edge_map


def coarse_weights(weighted: DataFrame, clusters: DataFrame) -> DataFrame:
    """(src, dst, w) of the coarse directed edges, weights summed."""
    return contract(weighted, clusters).where("csrc is not null").groupBy(F.col("csrc").alias("src"), F.col("cdst").alias("dst")).agg(F.sum("w").alias("w"))


def label_propagation(g: Graph, weighted: DataFrame, sweeps: int = SWEEPS, capacity: int = CAPACITY) -> DataFrame:
    """(id, cluster): capacity-limited label propagation in distributed rounds, at any size; compacted.

    A sweep has two rounds, in each of which one half of the vertices (dealt by a hash) looks at the labels of the
    round before: so two neighbours don't swap for ever. A vertex takes the heaviest label around it that has room,
    its own one included, of equals the one with the smallest neighbour; where more apply than there is room for, the
    heaviest (then smallest) applicants get it and the others try again in the next sweep. Sweeps end early when
    nothing moves any more, because then nothing ever would. See sequential_labels for sweeps vertex by vertex.

    A graph of up to HELD vertices and directed edges takes all its rounds in one task, with the same result: the plans of
    up to 40 distributed rounds would fill the driver.
    """
    if g.n + weighted.count() <= HELD:
        return compact(cut(_held_labels(g, weighted, sweeps, capacity)))
    label = cut(g.nodes.select("id", F.col("id").alias("cluster")))
    edges = weighted.select("src", "dst", "w")
    for _ in range(sweeps):
        moves = 0
        for half in (0, 1):
            size = label.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
            room = label.join(size, "cluster").select(F.col("id").alias("dst"), "cluster", "size")
            mine = label.where(F.pmod(F.xxhash64("id"), F.lit(2)) == half).select(F.col("id").alias("src"), F.col("cluster").alias("own"))
            near = edges.join(mine, "src").join(room, "dst").groupBy("src", "own", "cluster").agg(F.sum("w").alias("w"), F.min("dst").alias("u"), F.first("size").alias("size"))
            near = near.where((F.col("cluster") == F.col("own")) | (F.col("size") < capacity))
            best = near.groupBy("src", "own").agg(F.max(F.struct("w", (F.col("cluster") == F.col("own")).alias("stays"), (-F.col("u")).alias("u"), "cluster", "size")).alias("b"))
            asked = best.where("not b.stays").select("src", F.col("b.cluster").alias("to"), F.col("b.w").alias("w"), F.col("b.size").alias("size"))
            place = F.row_number().over(Window.partitionBy("to").orderBy(F.desc("w"), "src"))
            taken = cut(asked.withColumn("place", place).where(F.col("place") + F.col("size") <= capacity).select(F.col("src").alias("id"), "to"))
            if n := taken.count():
                moves += n
                label = cut(label.join(taken, "id", "left").select("id", F.coalesce("to", "cluster").alias("cluster")))
        if not moves:
            break
    return compact(label)


def _held_labels(g: Graph, weighted: DataFrame, sweeps: int, capacity: int) -> DataFrame:
    """(id, cluster) of label_propagation's rounds, in one task."""
    nodes = g.nodes.select(F.lit(None).cast("int").alias("src"), F.col("id").cast("int").alias("dst"), F.pmod(F.xxhash64("id"), F.lit(2)).cast("double").alias("w"))
    rows = nodes.unionAll(weighted.select(F.col("src").cast("int"), F.col("dst").cast("int"), F.col("w").cast("double")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        none = t["src"].is_null()
        own, e = t.filter(none), t.filter(pc.invert(none))
        order = np.argsort(own["dst"].to_numpy())
        ids, half = own["dst"].to_numpy()[order], own["w"].to_numpy()[order]
        src, dst, w = (e[c].to_numpy() for c in ("src", "dst", "w"))
        known = np.isin(src, ids) & np.isin(dst, ids)
        src, dst, w = np.searchsorted(ids, src[known]), np.searchsorted(ids, dst[known]), w[known]
        parts = [(src[half[src] == k], dst[half[src] == k], w[half[src] == k]) for k in (0, 1)]
        label = np.arange(len(ids))
        for _ in range(sweeps):
            if not sum([_half_sweep(label, *part, capacity) for part in parts]):
                break
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(ids[label], pa.int32())], ["id", "cluster"])

    wide_batches(g.nodes.sparkSession)
    return rows.repartition(1).mapInArrow(run, "id int, cluster int")


def _half_sweep(label: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, capacity: int) -> int:
    """Changes the labels of one half of the vertices, the sources; how many of them moved."""
    if not len(src):
        return 0
    size = np.bincount(label, minlength=len(label))
    order = np.lexsort((label[dst], src))
    s, c = src[order], label[dst][order]
    at = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (c[1:] != c[:-1])])
    s, c, heavy, first = s[at], c[at], np.add.reduceat(w[order], at), np.minimum.reduceat(dst[order], at)
    stays = c == label[s]
    room = np.flatnonzero(stays | (size[c] < capacity))
    room = room[np.lexsort((-first[room], stays[room], heavy[room], s[room]))]
    best = room[np.r_[s[room][1:] != s[room][:-1], True]] if len(room) else room
    asked = best[~stays[best]]
    asked = asked[np.lexsort((s[asked], -heavy[asked], c[asked]))]
    to = c[asked]
    start = np.searchsorted(to, to)
    taken = asked[np.arange(1, len(to) + 1) - start + size[to] <= capacity]
    label[s[taken]] = c[taken]
    return len(taken)


def sequential_labels(g: Graph, weighted: DataFrame, sweeps: int = SWEEPS, capacity: int = CAPACITY, order: str = "degree", seed: int = 0) -> DataFrame:
    """(id, cluster): the same rule vertex by vertex, labels at once; compacted.

    ``order``: ascending degree (then id), or random, a permutation for each seed.

    Its sweeps depend on their order, so the whole graph is one task: for graphs that one task can hold.
    """
    rows = g.nodes.select("id").join(weighted.select(F.col("src").alias("id"), "dst", "w"), "id", "left").withColumn("one", F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[tuple[int, float]]] = {int(i): [] for i in pdf["id"].unique()}
        for i, dst, w in pdf.dropna().sort_values(["id", "dst"])[["id", "dst", "w"]].itertuples(index=False):
            near[int(i)].append((int(dst), w))
        label, size = {i: i for i in near}, dict.fromkeys(near, 0)
        turns = sorted(near, key=lambda i: (len(near[i]), i))
        if order == "random":
            turns = np.random.default_rng(seed).permutation(turns).tolist()
        for _ in range(sweeps):
            for v in turns:
                weight: dict[int, float] = {}
                for u, w in near[v]:
                    weight[label[u]] = weight.get(label[u], 0.0) + w
                best, top = label[v], 0.0
                for c, w in weight.items():  # labels in the order of the first neighbour that has them
                    if w > top and (size[c] + 1 <= capacity or c == label[v]):
                        best, top = c, w
                size[best] += 1
                size[label[v]] -= 1
                label[v] = best
        return pd.DataFrame({"id": list(label), "cluster": list(label.values())}, dtype="int32")

    return compact(cut(rows.groupBy("one").applyInPandas(run, "id int, cluster int")))


def aggressive_merge(g: Graph, weighted: DataFrame, parents: DataFrame | None) -> DataFrame:
    """(id, cluster): vertices whose last contraction joined at most one finer vertex go to their heaviest neighbour.

    parents(id, cluster): the finer vertices' clusters, these being the vertices here. The neighbour's own id is
    taken, the first of equally heavy ones; lone vertices are paired in id order. Compacted.
    """
    kids = parents.groupBy(F.col("cluster").alias("id")).agg(F.count(F.lit(1)).alias("kids")) if parents is not None else g.nodes.select("id", F.lit(0).alias("kids"))
    state = g.nodes.select("id").join(kids, "id", "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    heavy = weighted.groupBy(F.col("src").alias("id")).agg(F.max_by("dst", F.struct(F.col("w"), -F.col("dst"))).alias("to"))
    state = state.join(heavy, "id", "left")
    lone = state.where("kids <= 1 and to is null").select("id")
    number = dense(lone, "id", "r")
    first = number.groupBy(F.floor(F.col("r") / 2).alias("h")).agg(F.min("id").alias("mate"))
    mates = number.withColumn("h", F.floor(F.col("r") / 2)).join(first, "h").select("id", "mate")
    joined = state.join(mates, "id", "left")
    return compact(joined.select("id", F.when(F.col("kids") > 1, F.col("id")).otherwise(F.coalesce("to", "mate", "id")).alias("cluster")))


@dataclass(frozen=True)
class Layer:
    """A graph, its edge weights, and parents(id, cluster) into the next coarser layer."""

    graph: Graph
    weights: DataFrame
    parents: DataFrame


def hierarchy(g: Graph, smallest: int = SMALLEST, most: int = 60, propagate: Callable = label_propagation) -> list[Layer]:
    """Layers from the graph itself to one that all of ends in one vertex.

    ``propagate``: label_propagation or sequential_labels. More than ``most`` layers are an error.
    """
    layers, ratio, parents = [], 0.0, None
    weights = cut(g.edges.withColumn("w", F.lit(1.0)))
    while g.n > smallest and g.m > 0:
        if len(layers) == most:
            raise RuntimeError(f"more than {most} layers")
        clusters = cut(propagate(g, weights) if ratio < 0.5 else aggressive_merge(g, weights, parents))
        coarse_n = clusters.agg(F.count_distinct("cluster")).first()[0]
        if coarse_n == g.n and ratio >= 0.5:
            break  # a merge that doesn't shrink would never end
        layers.append(Layer(g, weights, clusters))
        ratio, parents = coarse_n / g.n, clusters
        weights = cut(coarse_weights(weights, clusters))
        nodes = cut(clusters.select(F.col("cluster").alias("id")).distinct().withColumn("color", F.col("id")))
        g = Graph(nodes, weights.select("src", "dst"))
    layers.append(Layer(g, weights, g.nodes.select("id", F.lit(0).alias("cluster"))))
    spark = g.nodes.sparkSession
    root = spark.range(1).select(F.col("id").cast("int").alias("id"), F.lit(0).alias("color"))
    none = spark.createDataFrame([], "src int, dst int, w double")
    layers.append(Layer(Graph(root, none.select("src", "dst")), none, root.select("id", F.lit(-1).alias("cluster"))))
    return layers


def layer_tables(layers: list[Layer]) -> tuple[DataFrame, DataFrame]:
    """hier_nodes(layer, id, parent) and hier_children(layer, id, children) of the next finer layer."""
    nodes = None
    for k, layer in enumerate(layers):
        t = layer.parents.select(F.lit(k).alias("layer"), "id", F.col("cluster").alias("parent"))
        nodes = t if nodes is None else nodes.union(t)
    children = nodes.where("parent >= 0").groupBy((F.col("layer") + 1).alias("layer"), F.col("parent").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("children"))
    return nodes, children


def expand(parents: DataFrame, coarse: DataFrame, n_fine: int, n_coarse: int, stretch: float = 1.0, jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """(id, p0..): each fine vertex at its parent's place, stretched by (n_fine / n_coarse)^(1/d)."""
    d = dimension(coarse)
    k = (n_fine / n_coarse) ** (1.0 / d) * stretch
    shift = ball_vector(d, jitter, seed, F.col("child")) if jitter else [F.lit(0.0)] * d
    joined = parents.select(F.col("id").alias("child"), F.col("cluster").alias("id")).join(coarse, "id")
    return joined.select(F.col("child").alias("id"), *[(k * F.col(f"p{i}") + shift[i]).alias(f"p{i}") for i in range(d)])


def sizes(layers: list[Layer]) -> Iterator[int]:
    return (layer.graph.n for layer in layers)
