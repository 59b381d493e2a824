"""Intermediate tables in the folder that driver and executors share: lineage is cut, and a lost executor loses nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset (a local session) a folder below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints").rstrip("/")


def staged(rows: DataFrame, name: str) -> DataFrame:
    """rows, written once and read back as often as they are used."""
    path = f"{shared_folder(rows.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
