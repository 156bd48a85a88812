"""Undirected graphs as two tables: nodes(id, color) and symmetric, deduplicated edges(src, dst)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.components import connected_components
from graphloom.session import cut


def symmetric(pairs: DataFrame) -> DataFrame:
    """Both directions of every pair, once, without self-loops."""
    p = pairs.select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst")).where("src <> dst")
    return p.union(p.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def from_edges(pairs: DataFrame, vertices: DataFrame | None = None, covering: bool = False) -> Graph:
        """From src, dst rows in any orientation, repeated or not; ids 0..max all exist (gaps are isolated).

        ``covering``: the vertices have the largest id of the pairs, too, which then aren't made just to find it.
        """
        spark = pairs.sparkSession
        ids = vertices.select("id") if covering else pairs.select(F.greatest("src", "dst").alias("id"))
        if vertices is not None and not covering:
            ids = ids.union(vertices.select("id"))
        top = ids.agg(F.max("id")).first()[0]
        nodes = spark.range(0 if top is None else int(top) + 1).select(F.col("id").cast("int").alias("id"))
        return Graph(nodes.withColumn("color", F.col("id")), symmetric(pairs))

    @staticmethod
    def from_adjacency(rows: DataFrame) -> Graph:
        """From (id, nbrs array) rows."""
        pairs = rows.select(F.col("id").alias("src"), F.explode("nbrs").alias("dst"))
        return Graph.from_edges(pairs, rows)

    def with_colors(self, colors: DataFrame) -> Graph:
        """colors(id, color); others keep their own id as color."""
        joined = self.nodes.drop("color").join(colors.select("id", F.col("color").alias("c")), "id", "left")
        return Graph(joined.select("id", F.coalesce("c", "id").cast("int").alias("color")), self.edges)

    def with_unique_colors(self) -> Graph:
        return Graph(self.nodes.select("id", F.col("id").alias("color")), self.edges)

    @cached_property
    def n(self) -> int:
        return self.nodes.count()

    @cached_property
    def m(self) -> int:
        """Undirected edges."""
        return self.edges.where("src < dst").count()

    def canonical(self) -> DataFrame:
        """Each edge once with src < dst."""
        return self.edges.where("src < dst")

    def degrees(self) -> DataFrame:
        counted = self.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
        return self.nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg"))

    def edge_ids(self) -> DataFrame:
        """(eid, src, dst): position in (src, dst) order, each direction its own.

        Offsets by source come from degrees: no global sort, only a running sum over per-block totals.
        """
        deg = self.edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg")).withColumn("block", F.floor(F.col("src") / 4096))
        inside = deg.withColumn("before", F.sum("deg").over(Window.partitionBy("block").orderBy("src").rowsBetween(Window.unboundedPreceding, -1)))
        blocks = deg.groupBy("block").agg(F.sum("deg").alias("all"))
        blocks = blocks.select("block", F.coalesce(F.sum("all").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        start = inside.join(blocks, "block").select("src", (F.col("base") + F.coalesce("before", F.lit(0))).alias("start"))
        rank = F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1
        return self.edges.withColumn("rank", rank).join(start, "src").select((F.col("start") + F.col("rank")).alias("eid"), "src", "dst")

    def edge_contents(self) -> DataFrame:
        """(id, eids): edge ids that leave each vertex, ascending; isolated vertices have none."""
        own = self.edge_ids().groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("eid")).alias("eids"))
        return self.nodes.select("id").join(own, "id", "left").select("id", F.coalesce("eids", F.array().cast("array<bigint>")).alias("eids"))

    def edge_targets(self, eids: DataFrame) -> DataFrame:
        """eids(eid) with the ends (src, dst) of each."""
        return eids.join(self.edge_ids(), "eid").select("eid", "src", "dst")

    def neighbours(self) -> DataFrame:
        """(id, nbrs): ascending; isolated vertices have none."""
        own = self.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))
        return self.nodes.select("id").join(own, "id", "left").select("id", F.coalesce("nbrs", F.array().cast("array<int>")).alias("nbrs"))

    def adjacent(self, pairs: DataFrame) -> DataFrame:
        """pairs(src, dst) that are edges."""
        return pairs.join(self.edges, ["src", "dst"], "left_semi")

    def not_adjacent(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self.edges, ["src", "dst"], "left_anti")

    def same_color(self, pairs: DataFrame) -> DataFrame:
        c = self.nodes
        return pairs.join(c.select(F.col("id").alias("src"), F.col("color").alias("c1")), "src").join(c.select(F.col("id").alias("dst"), F.col("color").alias("c2")), "dst").where("c1 = c2").select("src", "dst")

    def dump(self) -> DataFrame:
        """(id, line): ``id: n1 n2 ...``."""
        return self.neighbours().select("id", F.concat_ws(" ", F.concat(F.col("id").cast("string"), F.lit(":")), F.array_join(F.transform("nbrs", lambda x: x.cast("string")), " ")).alias("line"))

    def components(self) -> DataFrame:
        """(id, comp): dense component ids in the order of their smallest vertices."""
        found = connected_components(self.edges)
        label = self.nodes.select(F.col("id").cast("long").alias("id")).join(found, "id", "left").select("id", F.coalesce("component", "id").alias("least"))
        return label.join(dense(label, "least", "comp"), "least").select(F.col("id").cast("int").alias("id"), F.col("comp").cast("int").alias("comp"))

    def is_connected(self) -> bool:
        return self.components().agg(F.count_distinct("comp")).first()[0] == 1

    def largest_component(self) -> tuple[Graph, DataFrame]:
        """The largest component (the first of equals), ids compacted in order, and mapping(old, new)."""
        comp = self.components()
        sizes = comp.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
        best = sizes.orderBy(F.desc("size"), "comp").limit(1)
        inside = comp.join(F.broadcast(best), "comp").select(F.col("id").alias("old"))
        mapping = dense(inside, "old", "new").select("old", F.col("new").cast("int").alias("new"))
        e = self.edges.join(mapping.select(F.col("old").alias("src"), F.col("new").alias("a")), "src").join(mapping.select(F.col("old").alias("dst"), F.col("new").alias("b")), "dst")
        return Graph(mapping.select(F.col("new").alias("id"), F.col("new").alias("color")), e.select(F.col("a").alias("src"), F.col("b").alias("dst"))), mapping

    def no_gaps(self) -> bool:
        """Whether all ids between the least and the largest exist."""
        r = self.nodes.agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count_distinct("id").alias("n")).first()
        return r.n == 0 or r.b - r.a + 1 == r.n

    def info(self) -> DataFrame:
        return self.nodes.agg(F.count(F.lit(1)).alias("num_nodes")).join(self.canonical().agg(F.count(F.lit(1)).alias("num_edges")))


def dense(df: DataFrame, key: str, name: str, block: int = 1 << 16) -> DataFrame:
    """(key, name): number of each distinct whole key from 0 in ascending order.

    Keys are numbered within blocks of ``block`` values; only the block totals are summed in one place.
    """
    keys = df.select(key).distinct().withColumn("_b", F.floor(F.col(key) / block))
    inside = keys.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1)
    totals = keys.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    base = totals.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return inside.join(base, "_b").select(key, (F.col("_o") + F.col("_r")).alias(name))


def consecutive(rows: DataFrame, value: str, order: list[str]) -> DataFrame:
    """(src, dst) of each two neighbouring values in order, where they differ.

    A range partitioning keeps the order without one big sort: pairs form inside the ranges, and the first
    and last row of each range (as many rows as there are ranges) close the gaps between them. The ranges are
    written down once, since another execution may draw other ones.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*order)
    dealt = cut(rows.select(F.col(value).alias("v"), key.alias("k")).repartitionByRange(n, "k").withColumn("part", F.spark_partition_id()))
    inner = dealt.select(F.lag("v").over(Window.partitionBy("part").orderBy("k")).alias("src"), F.col("v").alias("dst"))
    ends = dealt.groupBy("part").agg(F.min_by("v", "k").alias("first"), F.max_by("v", "k").alias("last"), F.min("k").alias("k"))
    across = ends.select(F.lag("last").over(Window.orderBy("k")).alias("src"), F.col("first").alias("dst"))
    return inner.union(across).where("src is not null and src <> dst")
