"""What jobs need of a session: lineage cut by files in the shared folder, and this package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Only in local mode, as in tests, one is made where it is unset; on a cluster a
    folder of the driver's machine would be no help, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not folder:
        folder = sc.getCheckpointDir()
        if folder is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, kept as files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from Parquet files in the shared folder: of many rows these take less room than `cut`, and only the columns in use are read."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The same rows in as many partitions as there are cores, where a small file would be read by fewer tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession | None = None) -> None:
    """Give the executors' Python workers this package, once a session; they need no copy of the repository."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    sc = spark.sparkContext
    if getattr(sc, "_corpusloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    # only the driver reads this file: addPyFile serves it to the executors
    target = Path(tempfile.mkdtemp(prefix="corpusloom-py-")) / "corpusloom_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith((".py", ".txt", ".yml", ".json")):
                    path = Path(folder, name)
                    z.write(path, Path(root.name) / path.relative_to(root))
    sc.addPyFile(str(target))
    sc._corpusloom_shipped = True
