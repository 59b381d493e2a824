"""Documents of a workspace as canonical lines: the manifest, the rate cache, the report of an import.

A line is a JSON object with its keys in order. Lines are dealt by ranges of their order, so the files, read by name, are
in order as a whole, and no task has to hold all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import canonical_json

#: What a line of the manifest and of the rate cache holds (fixed values).
SOURCE = ("source_id", "namespace", "revision", "contract")
RECORD = ("source_id", "record_id", "fingerprint", "state", "locator", "origin_revision", "origin_contract", "origin_locator", "ordinal")
RATE = ("currency", "date", "rate", "providers")


def write_lines(lines: DataFrame, path: str, order: list[str], compression: str = "none") -> None:
    """lines(line, order columns) as text files, in order within and across files; Spark reads compressed ones by their names."""
    ordered = lines.repartitionByRange(max(1, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order)
    ordered.select("line").write.text(path, compression=compression)


def manifest_lines(sources: DataFrame, records: DataFrame) -> DataFrame:
    """source_id, kind, record_id and line: each source by source_id, then its records by record_id, whatever came first."""
    heads = sources.select("source_id", F.lit(0).alias("kind"), F.lit("").alias("record_id"), canonical_json(*(c for c in SOURCE if c in sources.columns)).alias("line"))
    rest = records.select("source_id", F.lit(1).alias("kind"), "record_id", canonical_json(*RECORD).alias("line"))
    return heads.unionByName(rest)


def write_manifest(sources: DataFrame, records: DataFrame, path: str, compression: str = "none") -> None:
    """Lines repeat their keys and sources, so compressed files are a fraction of plain ones; read_manifest takes either."""
    write_lines(manifest_lines(sources, records), path, ["source_id", "kind", "record_id"], compression)


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The sources and the records of a manifest that was written."""
    lines = spark.read.text(path)
    kinds = {"locator": "long", "origin_locator": "long", "ordinal": "int"}
    parsed = lambda columns: F.from_json("value", ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns))
    is_record = F.get_json_object("value", "$.record_id").isNotNull()
    return lines.filter(~is_record).select(parsed(SOURCE).alias("x")).select("x.*"), lines.filter(is_record).select(parsed(RECORD).alias("x")).select("x.*")


def rate_lines(cache: DataFrame) -> DataFrame:
    """currency, date and line of every observation of a merged cache."""
    return cache.select("currency", "date", canonical_json(*(c for c in RATE if c in cache.columns)).alias("line"))


def write_rates(cache: DataFrame, path: str) -> None:
    write_lines(rate_lines(cache), path, ["currency", "date"])


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", "currency string, date date, rate decimal(17,8), providers array<string>").alias("x")).select("x.*")


def import_report(files: DataFrame) -> DataFrame:
    """status, files, rows and warnings by what became of files(path, status, rows, warnings), and all together as `total`.

    examples holds the first five paths of a status, in order.
    """
    size = F.coalesce(F.size("warnings"), F.lit(0))
    sums = lambda df, *by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sum(size).alias("warnings"))
    first = _first(files, 5)
    each = sums(files, "status").join(first, "status", "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))
    total = sums(files).select(F.lit("total").alias("status"), "files", "rows", "warnings", F.array().cast("array<string>").alias("examples"))
    return each.select("status", "files", "rows", "warnings", "examples").unionByName(total.withColumn("warnings", F.coalesce("warnings", F.lit(0))))


def _first(files: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("status").orderBy("path"))
    return files.select("status", "path").withColumn("place", place).filter(F.col("place") <= k).groupBy("status").agg(F.array_sort(F.collect_list("path")).alias("examples"))
