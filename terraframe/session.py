"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, set to a temporary folder only where it is unset and all executors are on this machine; elsewhere a folder of
    one machine would lose tables, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="terraframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return ("file://" if base.startswith("/") else "") + base.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that later steps see the same rows and numbers whatever is lost or planned
    anew."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
