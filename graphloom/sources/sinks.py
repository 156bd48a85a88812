"""Text, CSV and drawings, as DataFrames of lines or cells that Spark writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.vectors import hsv_to_rgb
from graphloom.operators.graph import Graph


def edge_lines(g: Graph) -> DataFrame:
    """(value): ``src dst`` with src < dst."""
    return g.canonical().select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))


def write_edge_list(g: Graph, path: str) -> None:
    edge_lines(g).write.mode("overwrite").text(path)


def coordinate_lines(positions: DataFrame) -> DataFrame:
    """(value): ``id,c1,...[,w]`` with all digits that doubles need."""
    cells = [F.col("id").cast("string"), F.array_join(F.transform("pos", lambda x: x.cast("string")), ",")]
    if "w" in positions.columns:
        cells.append(F.col("w").cast("string"))
    return positions.select(F.concat_ws(",", *cells).alias("value"))


def write_coordinates(positions: DataFrame, path: str) -> None:
    coordinate_lines(positions).write.mode("overwrite").text(path)


def write_rows(df: DataFrame, path: str) -> None:
    """A trace, a metrics row or node scores as CSV with names."""
    df.write.mode("overwrite").csv(path, header=True)


def metrics_text(row: DataFrame) -> str:
    """Names on one line, the first row's values on the next."""
    first = row.first()
    return ",".join(row.columns) + "\n" + ",".join("" if x is None else str(x) for x in first)


def colors(values: DataFrame) -> DataFrame:
    """(id, r, g, b) of (id, value): the hue goes once around with value / max."""
    top = values.agg(F.max("value")).first()[0] or 1.0
    return values.select("id", *[F.floor(c).cast("int").alias(n) for c, n in zip(hsv_to_rgb(F.col("value") / float(top) * 360, F.lit(1.0), F.lit(1.0)), "rgb", strict=True)])


def _frame(points: DataFrame) -> tuple[float, float, float, float]:
    r = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
    x0, x1, y0, y1 = (float(v or 0) for v in r[:4])
    return x0, x1, y0, y1


def svg(spark: SparkSession, g: Graph, points: DataFrame, shades: DataFrame | None = None) -> DataFrame:
    """(ord, value) lines of an SVG: bounds widened by 5 %, edges once, then circles of radius 0.1 sqrt(area / n)."""
    x0, x1, y0, y1 = _frame(points)
    dx, dy = (x1 - x0) * 0.05, (y1 - y0) * 0.05
    w, h = x1 - x0 + 2 * dx, y1 - y0 + 2 * dy
    n = max(1, points.count())
    r = 0.1 * (max(w * h, 1e-12) / n) ** 0.5
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="{x0 - dx} {y0 - dy} {w} {h}">'
    p = points.select("id", "x", "y")
    lines = g.canonical().join(p.toDF("src", "xa", "ya"), "src").join(p.toDF("dst", "xb", "yb"), "dst")
    lines = lines.select(F.lit(1).alias("part"), "src", "dst", F.format_string(f'<line x1="%s" y1="%s" x2="%s" y2="%s" stroke="black" stroke-width="{0.3 * r}"/>', *[F.col(c).cast("string") for c in ("xa", "ya", "xb", "yb")]).alias("value"))
    shade = p.join(shades, "id", "left") if shades is not None else p.selectExpr("*", "0 as r", "0 as g", "0 as b")
    dots = shade.select(F.lit(2).alias("part"), F.col("id").alias("src"), F.lit(0).alias("dst"), F.format_string(f'<circle cx="%s" cy="%s" r="{r}" fill="rgb(%d,%d,%d)"/>', F.col("x").cast("string"), F.col("y").cast("string"), *[F.coalesce(c, F.lit(0)) for c in "rgb"]).alias("value"))
    ends = spark.createDataFrame([(0, 0, 0, head), (3, 0, 0, "</svg>")], "part int, src int, dst int, value string")
    return ends.union(lines).union(dots)


#: The head of an IPE file. Fixed format.
IPE_HEAD = """<?xml version="1.0"?>
<!DOCTYPE ipe SYSTEM "ipe.dtd">
<ipe version="70206" creator="Ipe 7.2.6">
<ipestyle name="dummy">
<symbol name="mark/disk(sx)" transformations="translations">
<path fill="sym-stroke">0.6 0 0 0.6 0 0 e</path>
</symbol>
</ipestyle>
<page>
<layer name="alpha"/>
<view layers="alpha" active="alpha"/>"""


def ipe(spark: SparkSession, g: Graph, points: DataFrame, shades: DataFrame | None = None, scale: float | None = None, margin: float = 50.0) -> DataFrame:
    """(part, src, dst, value) lines of an IPE drawing: edges once, then vertices; positions with one decimal.

    Coordinates times ``scale`` plus ``margin``; without a scale they are put into a square of 500. ``shades``:
    (id, r, g, b) as from colors(); others are black.
    """
    x0 = y0 = 0.0
    if scale is None:
        x0, x1, y0, y1 = _frame(points)
        scale = 500.0 / max(x1 - x0, y1 - y0, 1e-12)
    p = points.select("id", (F.lit(margin) + (F.col("x") - x0) * scale).alias("x"), (F.lit(margin) + (F.col("y") - y0) * scale).alias("y"))
    lines = g.canonical().join(p.toDF("src", "xa", "ya"), "src").join(p.toDF("dst", "xb", "yb"), "dst")
    lines = lines.select(F.lit(1).alias("part"), "src", "dst", F.format_string('<path stroke="black">%.1f %.1f m %.1f %.1f l</path>', "xa", "ya", "xb", "yb").alias("value"))
    shade = p.join(shades, "id", "left") if shades is not None else p.selectExpr("*", "0 as r", "0 as g", "0 as b")
    dots = shade.select(F.lit(2).alias("part"), F.col("id").alias("src"), F.lit(0).alias("dst"), F.format_string('<use name="mark/disk(sx)" pos="%.1f %.1f" size="small" stroke="%.1f %.1f %.1f"/>', "x", "y", *[F.coalesce(c, F.lit(0)) / 255.0 for c in "rgb"]).alias("value"))
    ends = spark.createDataFrame([(0, 0, 0, IPE_HEAD), (3, 0, 0, "</page>\n</ipe>")], "part int, src int, dst int, value string")
    return ends.union(lines).union(dots)


def write_drawing(drawing: DataFrame, path: str) -> None:
    """In one file, in order: a drawing is for one viewer."""
    drawing.orderBy("part", "src", "dst").select("value").coalesce(1).write.mode("overwrite").text(path)
