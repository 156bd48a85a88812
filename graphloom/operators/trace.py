"""Monitors over a finished trace (t, loss): a trace has one row for each step, so it fits in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def smoothed(trace: DataFrame, factor: float = 0.3) -> DataFrame:
    """(t, loss, smoothed): exponential moving average seeded by the first loss."""
    rows = trace.agg(F.array_sort(F.collect_list(F.struct("t", "loss"))).alias("xs"))
    step = lambda acc, x: F.array_append(acc, F.when(F.size(acc) == 0, x["loss"]).otherwise(factor * x["loss"] + (1 - factor) * F.element_at(acc, -1)))
    folded = rows.select("xs", F.aggregate("xs", F.expr("cast(array() as array<double>)"), lambda acc, x: F.when(F.size(acc) == 0, F.array(x["loss"])).otherwise(step(acc, x))).alias("s"))
    return folded.select(F.explode(F.arrays_zip("xs", "s")).alias("z")).select("z.xs.t", "z.xs.loss", F.col("z.s").alias("smoothed"))


def rates(series: DataFrame, window: int = 30) -> DataFrame:
    """Relative improvement over the window; infinite until it is full."""
    old = F.lag("smoothed", max(1, window)).over(Window.orderBy("t"))
    rate = F.when(old.isNull(), float("inf")).otherwise((old - F.col("smoothed")) / F.greatest(F.abs(old), F.lit(1e-12)))
    return series.withColumn("rate", rate)


def patience(series: DataFrame, tol: float) -> DataFrame:
    """Consecutive steps, up to each, at a rate below the tolerance."""
    order = Window.orderBy("t")
    below = F.col("rate") < tol
    breaks = F.sum((~below).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    island = series.withColumn("island", breaks)
    count = F.sum(below.cast("int")).over(Window.partitionBy("island").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return island.select("t", "rate", count.alias("patience"))
