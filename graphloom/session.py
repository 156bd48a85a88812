"""Session defaults, the shared folder, and cutting lineage."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: Used only where the session names no folder (tests, one machine).
OWN_CHECKPOINT_DIR = "/tmp/checkpoints/graphloom"

#: Most bits of a bitmap of ids (8 MB), and bits for each id as long as there are so many.
MARKS, MARKS_EACH = 1 << 26, 16


def build_session(app: str = "graphloom", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested under; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and keep Arrow batches small when texts are long."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])
    for key, value in (("maxRecordsPerBatch", "2000"), ("maxBytesPerBatch", "16m")):
        name = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def wide_batches(spark: SparkSession) -> None:
    """Larger Arrow batches, for rows of a few numbers; the limit in bytes holds, and the next query's prepare() takes them back."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(1 << 15))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder, else our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    return f"file://{OWN_CHECKPOINT_DIR}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder, so a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str]) -> DataFrame:
    """rows x keyed on whole-number keys, where ``keyed`` is an aggregate of the rows and some keys may be hot.

    The join is on a function of the keys, so neither side's earlier partitioning serves it: both get an exchange of
    their own, and those are what Spark divides at run time (adaptive skew join).
    """
    made = [f"{k}__" for k in keys]
    turned = lambda df: df.select(*(F.bitwise_not(F.col(k)).alias(m) for k, m in zip(keys, made, strict=True)), *(c for c in df.columns if c not in keys))
    joined = turned(rows).join(turned(keyed), made)
    return joined.select(*(F.bitwise_not(F.col(m)).alias(k) for k, m in zip(keys, made, strict=True)), *(c for c in joined.columns if c not in made))


def marked(rows: DataFrame, key: Column, ids: DataFrame) -> tuple[DataFrame, Column]:
    """The rows beside a bitmap, and a test that holds where the key, a whole number, is among the ``ids`` (one column).

    It holds for few others: the bitmap is one of hashes, broadcast in parts of 4 kB and of bounded size; the more ids
    beyond that, the more others it holds for.
    """
    size = min(MARKS, max(1 << 15, 1 << (MARKS_EACH * ids.count()).bit_length()))
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit(size - 1))
    at = ids.select(place(F.col(f"`{ids.columns[0]}`")).alias("at"))
    held = at.groupBy(F.shiftright("at", 15).alias("part__")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit((1 << 15) - 1))).alias("bits__"))
    byte = F.substring(F.col("bits__"), F.shiftright(place(key).bitwiseAND(F.lit((1 << 15) - 1)), 3).cast("int") + 1, 1)
    one = F.element_at(F.lit([1 << k for k in range(8)]), place(key).bitwiseAND(F.lit(7)).cast("int") + 1)
    hit = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(one) != 0
    return rows.join(F.broadcast(held), F.shiftright(place(key), 15) == F.col("part__"), "left"), F.coalesce(hit, F.lit(False))


def matching(rows: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """The rows whose key is among the ``ids``; only those that a bitmap lets through are shuffled."""
    name, (beside, hit) = ids.columns[0], marked(rows, key, ids)
    return beside.where(hit).drop("part__", "bits__").join(ids, key == F.col(f"`{name}`"), "left_semi")


def without(rows: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """The rows whose key isn't among the ``ids``; those that a bitmap tells so are not shuffled. The key is never null."""
    name, (beside, hit) = ids.columns[0], marked(rows, key, ids)
    some = beside.where(hit).drop("part__", "bits__").join(ids, key == F.col(f"`{name}`"), "left_anti")
    return beside.where(~hit).drop("part__", "bits__").unionByName(some)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that were cut and are no longer held.

    Its cleaner follows the driver's garbage collection, which a driver that holds only scalars hardly ever needs.
    """
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder in the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder in the shared store when this process ends."""
    import atexit

    def drop() -> None:
        try:
            discard(spark, path)
        except Exception:  # the session may be gone already
            pass

    atexit.register(drop)


def written(df: DataFrame) -> str:
    """Write a Parquet table into the shared folder, for as long as this process runs; its path."""
    import uuid

    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    discard_at_exit(df.sparkSession, path)
    df.write.parquet(path)
    return path


def stash(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder; it goes when this process ends."""
    return df.sparkSession.read.parquet(written(df))
