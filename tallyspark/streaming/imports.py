"""Drop-folder imports: files that arrive are taken once, into a table that batch operators read."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; below the warehouse only where spark.checkpoint.dir is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints").rstrip("/")


def import_available(spark: SparkSession, path: str, keys: list[str], derive: Callable[[DataFrame], DataFrame], target: str | None = None) -> DataFrame:
    """Take the files at path that were not taken before, then derive from the whole table.

    Every micro-batch writes its own partition (batch=<id>, overwritten if the batch is replayed), so the sink is exactly
    once; rows that repeat keys across batches count once. Late files enter by being read: the derivation covers all.
    """
    target = target or f"{shared_dir(spark)}/imports-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).parquet(path if os.path.splitext(path)[1] == "" else _folder(path))

    def take(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/table/batch={batch}")

    stream = source.writeStream.foreachBatch(take).option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    return derive(spark.read.schema(schema).parquet(f"{target}/table").dropDuplicates(keys))


def _folder(path: str) -> str:
    """A glob that names exactly one file or folder, which a file stream accepts where it refuses a plain file."""
    head, tail = os.path.split(path)
    return f"{head}/[{tail[0]}]{tail[1:]}"
