"""Batches that a user hands in: accounting decisions, corrections, and categories to compare.

Readers never drop an entry: what is wrong with one stands in `problem`, and refused() makes the first problem an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.text import csv_plain

#: Fields that a correction may set (fixed values).
FIELDS = ["category", "flow_type", "owner", "payment_method", "confidence", "reason", "notes", "needs_review", "review_reasons"]
#: Fields that may be set to nothing.
CLEARABLE = ["notes"]


def _csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Text cells of a CSV file, null where empty or absent, and `odd`: the record, if it has more or fewer cells."""
    schema = ", ".join(f"`{n}` string" for n in [*names, "odd"])
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("columnNameOfCorruptRecord", "odd").csv(path)


def _header(spark: SparkSession, path: str) -> list[str]:
    return [c.removeprefix("﻿") for c in spark.read.option("header", True).option("multiLine", True).csv(path).columns]


def _items(spark: SparkSession, path: str) -> DataFrame:
    """index and item (a variant) of the array in a JSON file; a document that is no array is an error."""
    text = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    whole = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v")).otherwise(F.raise_error(F.lit("the document must be an array")).cast("variant"))
    return text.select(F.posexplode(whole.cast("array<variant>")).alias("index", "item"))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """index, transaction_id, decision and problem of a .csv file with exactly these two columns, or a .json array of such objects."""
    if path.lower().endswith(".json"):
        closed = F.coalesce(_kind("item") == "OBJECT<decision: STRING, transaction_id: STRING>", F.lit(False))
        part = lambda name: F.when(closed, F.try_variant_get("item", f"$.{name}", "string")).alias(name)
        return _items(spark, path).select("index", part("transaction_id"), part("decision"), F.when(~closed, "an entry holds the texts transaction_id and decision only").alias("problem"))
    if not path.lower().endswith(".csv"):
        raise ValueError("decisions come as .csv or .json")
    if _header(spark, path) != ["transaction_id", "decision"]:
        raise ValueError("the columns must be transaction_id,decision")
    rows = _csv(spark, path, ["transaction_id", "decision"])  # a file that is read as a whole is one partition
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select(F.monotonically_increasing_id().cast("int").alias("index"), text("transaction_id"), text("decision"), F.when(F.col("odd").isNotNull() & F.col("decision").isNotNull(), "extra fields").alias("problem"))


def corrections(spark: SparkSession, path: str, ledger_ids: DataFrame) -> DataFrame:
    """index, transaction_id, FIELDS as text (null: not set) and problem of a .json array of correction objects.

    ledger_ids: transaction_id. needs_review is a boolean or its text, confidence a number or text, all else text; only
    CLEARABLE fields may be empty. An id has to be in the ledger and stand once in the batch.
    """
    cells = F.from_json(F.to_json("item"), "map<string,variant>")
    items = _items(spark, path).withColumn("cells", F.when(_kind("item").startswith("OBJECT"), cells))
    text = lambda name: F.trim(F.try_variant_get(F.col("cells")[name], "$", "string"))
    kind = lambda name: _kind(F.col("cells")[name])
    given = lambda name: F.coalesce(F.map_contains_key("cells", name), F.lit(False))
    is_text = lambda name: kind(name) == "STRING"
    number = kind("confidence").isin("BIGINT", "DOUBLE") | kind("confidence").startswith("DECIMAL")
    fits = {f: is_text(f) & ((text(f) != "") | F.lit(f in CLEARABLE)) for f in FIELDS}
    fits["needs_review"] = (kind("needs_review") == "BOOLEAN") | (is_text("needs_review") & F.lower(text("needs_review")).isin("true", "false"))
    fits["confidence"] |= number
    value = {f: F.lower(text(f)) if f == "needs_review" else text(f) for f in FIELDS}
    unknown = F.array_sort(F.array_except(F.map_keys("cells"), F.array(*map(F.lit, ["transaction_id", *FIELDS]))))
    identifier = F.when(is_text("transaction_id"), F.nullif(text("transaction_id"), F.lit("")))
    shape = F.coalesce(
        F.when(F.col("cells").isNull(), "a correction must be an object"),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown fields: "), F.array_join(unknown, ", "))),
        F.when(identifier.isNull(), "transaction_id is missing"),
        *(F.when(given(f) & ~F.coalesce(fits[f], F.lit(False)), f"{f} is not valid") for f in FIELDS),
        F.when(~F.exists(F.array(*map(given, FIELDS)), lambda x: x), "no field is set"),
    )
    rows = items.select("index", identifier.alias("transaction_id"), *(F.when(given(f), value[f]).alias(f) for f in FIELDS), shape.alias("problem"))
    times = rows.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("times"))
    known = ledger_ids.select("transaction_id").distinct().withColumn("known", F.lit(True))
    found = rows.join(times, "transaction_id", "left").join(known, "transaction_id", "left")
    problem = F.coalesce("problem", F.when(F.col("times") > 1, "the transaction_id stands more than once"), F.when(F.col("known").isNull(), "the transaction_id is not in the ledger"))
    return found.select("index", "transaction_id", *FIELDS, problem.alias("problem"))


def categories(spark: SparkSession, path: str) -> DataFrame:
    """transaction_id, category and problem (an id that stands twice) of a .csv file that holds at least these columns."""
    header = _header(spark, path)
    if not {"transaction_id", "category"} <= set(header):
        raise ValueError("the columns transaction_id and category are needed")
    cell = lambda c: F.trim(csv_plain(F.coalesce(c, F.lit("")))).alias(c)
    rows = _csv(spark, path, header).select(cell("transaction_id"), cell("category")).filter("transaction_id <> ''")
    one = rows.groupBy("transaction_id").agg(F.min("category").alias("category"), F.count(F.lit(1)).alias("times"))
    return one.select("transaction_id", "category", F.when(F.col("times") > 1, "the transaction_id stands more than once").alias("problem"))


def refused(entries: DataFrame) -> DataFrame:
    """The entries without their problems; one with a problem is an error."""
    wrong = F.raise_error(F.concat_ws(": ", F.col("transaction_id"), F.col("problem")))
    return entries.withColumn("transaction_id", F.when(F.col("problem").isNull(), F.col("transaction_id")).otherwise(wrong)).drop("problem")
