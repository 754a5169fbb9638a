"""Session settings and the shared folder that long lineages are cut in."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as the tests and the benchmark use it."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", True)
        .config("spark.sql.adaptive.skewJoin.enabled", True)
        .config("spark.sql.execution.arrow.pyspark.enabled", True)
        .config("spark.ui.enabled", False)
        .config("spark.ui.showConsoleProgress", False)
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    A folder of this machine is used only where the setting is absent and the
    master is local, as in tests; a cluster without the setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark, "_tidemark_dir", None)
    if own is None:
        own = spark._tidemark_dir = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "stage", **tallies: Column) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back.

    Cuts the lineage: later stages, and re-runs after a lost executor, start
    from the files. Unlike ``cache`` it costs no executor memory. ``tallies`` are
    aggregates taken on the way, without a pass of their own, and kept as ``_tallies``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    seen = Observation() if tallies else None
    (df.observe(seen, *[c.alias(k) for k, c in tallies.items()]) if seen else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path, out._tallies = path, seen.get if seen else {}
    return out


def discard(spark: SparkSession, *stages: DataFrame | str) -> None:
    """Deletes stages nothing reads any more: materialised frames, or scratch paths."""
    for s in stages:
        path = spark._jvm.org.apache.hadoop.fs.Path(s if isinstance(s, str) else s._tidemark_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def rewrite_parts(df: DataFrame, path: str, parts: str, name: str = "parts") -> None:
    """Puts ``df`` in the place of the partitions of ``path`` it holds rows of; all others stay as they are.

    The new rows are staged first, so ``df`` may read the table it changes; they are rebalanced by
    partition, large ones over several tasks.
    """
    spark = df.sparkSession
    staged = materialise(df.hint("rebalance", parts), name)
    staged.write.partitionBy(parts).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    discard(spark, staged)


def data_path(sf_dir: str, table: str) -> str:
    return os.path.join(sf_dir, f"{table}.parquet")


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(data_path(sf_dir, table))
