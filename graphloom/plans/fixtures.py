"""Graphs and layouts made of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph, consecutive
from graphloom.operators.pairs import flatten
from graphloom.operators.step import degree_weights, rescaled
from graphloom.session import cut, table


def succession(spark: SparkSession, sf_dir: str) -> Graph:
    """Users of consecutive purchases."""
    events = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    g = Graph.from_edges(consecutive(events, "user_id", ["ts", "event_id"]))
    return Graph(cut(g.nodes), cut(g.edges))


def copurchase_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) parts that share an order, src < dst."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("int").alias("p")).distinct()
    other = items.select("l_orderkey", F.col("p").alias("q"))
    return items.join(other, "l_orderkey").where("p < q").select(F.col("p").alias("src"), F.col("q").alias("dst")).distinct()


def copurchase(spark: SparkSession, sf_dir: str) -> Graph:
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("id")).union(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("int")))
    return Graph.from_edges(copurchase_pairs(spark, sf_dir), ids, covering=True)


def vectors(spark: SparkSession, sf_dir: str, d: int, scale: float = 1.0) -> DataFrame:
    """(id, p0..p{d-1}) of the first components of embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("id"), *[(F.get("embedding", k).cast("double") * scale).alias(f"p{k}") for k in range(d)])


def layout(spark: SparkSession, sf_dir: str, g: Graph) -> DataFrame:
    """(id, p0, p1, w): two embedding components times 40 and rescaled degree weights."""
    return vectors(spark, sf_dir, 2, 40.0).join(rescaled(degree_weights(g), 2), "id")


__all__ = ["copurchase", "copurchase_pairs", "flatten", "layout", "succession", "vectors"]
