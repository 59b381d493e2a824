"""Ledger tables as spreadsheet-safe CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.text import csv_plain, csv_safe

#: Columns whose cells are canonical numbers or booleans and stay as they are (fixed values).
PLAIN = ("posted_amount", "original_amount", "amount_base", "confidence", "reconciliation_confidence", "statement_opening_balance", "statement_closing_balance", "needs_review", "canonical_slot", "source_occurrence_count")


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """The columns in order, token lists joined by ';', text cells safe for spreadsheets."""
    cells = []
    for c in columns:
        text = F.array_join(c, ";") if dict(rows.dtypes)[c].startswith("array") else F.col(c).cast("string")
        text = F.coalesce(text, F.lit(""))
        cells.append((text if c in PLAIN else csv_safe(text)).alias(c))
    rows.select(*cells).write.option("header", True).option("escape", '"').option("emptyValue", "").mode("overwrite").csv(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Those columns as text, decoded; missing columns and cells are ''."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select(*(F.coalesce(csv_plain(F.col(c)), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in columns))
