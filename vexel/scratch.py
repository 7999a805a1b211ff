"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.checkpoint.dir"


def scratch_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset a local session gets a temporary folder; on a cluster that is an error."""
    folder = spark.conf.get(FOLDER, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{FOLDER} must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='vexel-')}"
        spark.conf.set(FOLDER, folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back.

    The lineage ends there, so a lost executor costs a reread and not a
    recomputation, and every later use sees the same rows.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/vexel-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
