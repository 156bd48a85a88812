"""Text sources: edge lists, bipartite lists, coordinates, logs. Malformed lines raise unless skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.vectors import tokens
from graphloom.operators.graph import Graph


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of a text file."""
    return spark.read.text(path)


def parse_edges(rows: DataFrame, comment: str = "#", delimiter: str = " ", skip_invalid: bool = False) -> DataFrame:
    """(src, dst) of lines (value); further tokens are ignored."""
    cut = rows.where(~F.col("value").startswith(comment)).select(tokens(F.col("value"), delimiter).alias("t"))
    if skip_invalid:
        good = cut.select(F.get("t", 0).try_cast("int").alias("src"), F.get("t", 1).try_cast("int").alias("dst"))
        return good.where("src is not null and dst is not null")
    fail = F.raise_error(F.concat(F.lit("edge line needs two ids: "), F.array_join("t", delimiter)))
    need = lambda k: F.when(F.size("t") >= 2, F.get("t", k)).otherwise(fail).cast("int")
    return cut.select(need(0).alias("src"), need(1).alias("dst"))


def read_edge_list(spark: SparkSession, path: str, comment: str = "#", delimiter: str = " ", skip_invalid: bool = False) -> Graph:
    return Graph.from_edges(parse_edges(lines(spark, path), comment, delimiter, skip_invalid))


def read_bipartite(spark: SparkSession, path: str, delimiter: str = " ") -> Graph:
    """First line ``#psizes a b``; ids below a have color 0, the others 1."""
    rows = lines(spark, path)
    head = rows.where(F.col("value").startswith("#psizes")).first()
    if head is None:
        raise ValueError("no #psizes line")
    a, b = (int(x) for x in head[0].split()[1:3])
    body = rows.where(~F.col("value").startswith("#"))
    if not body.where(F.size(tokens(F.col("value"), delimiter)) != 2).isEmpty():
        raise ValueError("a line has not exactly two ids")
    vertices = spark.range(a + b).select(F.col("id").cast("int").alias("id"))
    g = Graph.from_edges(parse_edges(body, "#", delimiter), vertices)
    return g.with_colors(g.nodes.select("id", F.when(F.col("id") < a, 0).otherwise(1).alias("color")))


def parse_coordinates(rows: DataFrame, comment: str = "%", delimiter: str = ",", number: str | None = None) -> DataFrame:
    """(id, pos) of lines ``id,c1,...``; all need as many columns as the first; the last of equal ids wins.

    number: a column with the order of lines; without it, lines in file order as read.
    """
    order = F.col(number) if number else F.monotonically_increasing_id()
    cut = rows.withColumn("_o", order).where(~F.col("value").startswith(comment)).select("_o", tokens(F.col("value"), delimiter).alias("t"))
    first = cut.orderBy("_o").select(F.size("t")).first()
    width = first[0] if first else 0
    fail = F.raise_error(F.concat(F.lit("columns differ from the first line: "), F.array_join("t", delimiter)))
    whole = F.when(F.size("t") == width, F.col("t")).otherwise(fail)
    parsed = cut.select("_o", F.get(whole, 0).cast("int").alias("id"), F.transform(F.slice("t", 2, max(0, width - 1)), lambda x: x.cast("double")).alias("pos"))
    return parsed.groupBy("id").agg(F.max_by("pos", "_o").alias("pos"))


def read_coordinates(spark: SparkSession, path: str, comment: str = "%", delimiter: str = ",") -> DataFrame:
    """As parse_coordinates; lines in the order of files, blocks of a file and lines of a block."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return parse_coordinates(lines(spark, path).select("value", place.alias("place")), comment, delimiter, "place")


def split_last(positions: DataFrame) -> DataFrame:
    """(id, pos, w): the last column is the weight."""
    return positions.select("id", F.slice("pos", 1, F.size("pos") - 1).alias("pos"), F.element_at("pos", -1).alias("w"))


def split_first(positions: DataFrame) -> DataFrame:
    return positions.select("id", F.slice("pos", 2, F.size("pos") - 1).alias("pos"), F.element_at("pos", 1).alias("w"))


def plane(positions: DataFrame) -> DataFrame:
    return positions.select("id", F.get("pos", 0).alias("x"), F.coalesce(F.get("pos", 1), F.lit(0.0)).alias("y"))


#: Embedding types and what their columns mean after the id. Fixed names.
TYPES = {"euclidean": "pos", "infnorm": "pos", "dot": "pos", "cosine": "pos", "poincare": "pos", "weighted": "pos,w", "weighted_inf": "pos,w", "weighted_nodim": "pos,w", "additive": "pos,w", "mercator": "kappa"}


def parse_embedding(kind: str, positions: DataFrame) -> DataFrame:
    """(id, pos, w) or for mercator (id, pos, radius) from raw columns; mercator of three columns is the circle."""
    if kind not in TYPES:
        raise ValueError(f"unknown embedding type {kind}")
    if TYPES[kind] == "pos":
        return positions.select("id", "pos", F.lit(1.0).alias("w"))
    if TYPES[kind] == "pos,w":
        return split_last(positions)
    circle = F.size("pos") == 3
    return positions.select("id", F.when(circle, F.slice("pos", 2, 1)).otherwise(F.slice("pos", 3, F.greatest(F.size("pos") - 2, F.lit(0)))).alias("pos"), F.when(circle, F.element_at("pos", 3)).otherwise(F.element_at("pos", 2)).alias("radius"))


#: A log line that sets a parameter: ``> name=value`` or ``> name(default)=value``.
LOG_LINE = r"^> (\w[\w-]*)(\(default\))?=(.*)$"


def parse_log(rows: DataFrame) -> DataFrame:
    """(name, value) of parameter lines."""
    hit = rows.where(F.col("value").rlike(LOG_LINE))
    return hit.select(F.regexp_extract("value", LOG_LINE, 1).alias("name"), F.regexp_extract("value", LOG_LINE, 3).alias("value"))


def read_config(spark: SparkSession, path: str, kind: str = "log") -> DataFrame:
    """(name, value) from a log, or from a CSV of one line of names and one of values."""
    if kind == "log":
        return parse_log(lines(spark, path))
    table = spark.read.csv(path, header=True)
    return table.limit(1).select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in table.columns]), F.array(*[F.col(f"`{c}`") for c in table.columns]))).alias("name", "value"))


def read_time(spark: SparkSession, path: str | None) -> DataFrame | None:
    """(name, value) of an embedding's time; nothing without a path."""
    if not path:
        return None
    return lines(spark, path).limit(1).select(F.lit("embedding_time").alias("name"), F.col("value"))
