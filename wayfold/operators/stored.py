"""Intermediate tables: they cut plans, and an executor that is lost costs one step."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = f"file://{tempfile.gettempdir()}/wayfold-search"
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df as a table of its own: it cuts the plan."""
    path = f"{folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
