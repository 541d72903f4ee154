"""Lineage cuts and scratch folders in the place the cluster names."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; a local one, removed at the end, only on a local master that names none."""
    sc = spark.sparkContext
    named = spark.conf.get(_KEY, None) or sc.getConf().get(_KEY)
    if named:
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError(f"set {_KEY} to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="spark-checkpoints-", dir="/tmp")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    sc.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared scratch folder and read back: survives lost executors, forgets the plan.

    A written table also has its true size, which lets Spark broadcast the short ones.  (A checkpoint
    keeps the estimate of the plan that led to it; in a loop of joins those estimates multiply.)
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the tables of ``cut`` that nothing will read again (others, and None, are left alone)."""
    for df in tables:
        path = getattr(df, "__dict__", {}).get("_cut_at")
        if path:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def placed(df: DataFrame, *keys: str) -> DataFrame:
    """A reliable checkpoint, hash-partitioned and sorted by ``keys``: the rounds of a loop do neither again."""
    spark = df.sparkSession
    root = scratch_root(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    written = cut(df)
    # an adaptive plan does not tell the checkpoint how its rows are placed, and every round would shuffle them again
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = written.repartition(n, *keys).sortWithinPartitions(*keys).checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    discard(written)
    return out
