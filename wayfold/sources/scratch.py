"""Intermediate tables of iterative operators, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Tables of more rows are joined by sorting: their files are small, so Spark would take them for small and gather them in the driver.
MOST_BROADCAST = 100_000


def shared_root(spark: SparkSession) -> str:
    """Return the folder named by spark.checkpoint.dir; where it is unset, a local run gets one of its own and a cluster raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="wayfold-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_folder(spark: SparkSession, name: str) -> str:
    """Return a fresh path under the shared folder, deleted when the driver's JVM ends in order."""
    path = f"{shared_root(spark).rstrip('/')}/wayfold-{uuid.uuid4().hex}-{name}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str, sort: bool = True) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage and keeps costly columns from being computed twice; unlike cached
    blocks, the files outlive the executors that wrote them. Rows are counted on the way, and a table
    of many is never broadcast, nor is what a join's side makes of it. That shuffles the other side too; sort=False
    leaves the choice to Spark, for tables that meet small ones round after round.
    """
    spark = df.sparkSession
    path, seen = new_folder(spark, name), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out.hint("merge") if sort and seen.get["n"] > MOST_BROADCAST else out
