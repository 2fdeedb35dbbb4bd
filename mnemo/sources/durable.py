"""Cutting lineage with tables that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; set here only for local sessions without one (as in tests), elsewhere it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def job_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.conf.get('spark.app.id', 'tables')}"


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back.

    Unlike ``checkpoint()`` it computes the plan once, and later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{job_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the whole tables ``batch=...`` under ``path``: those that Spark has marked as done."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    root = at(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith("batch=") and fs.exists(at(p, "_SUCCESS")))


def drop_tables(spark: SparkSession) -> None:
    """Removes the durable tables of this application, once no result that reads them is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(job_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
